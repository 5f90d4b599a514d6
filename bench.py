"""Time the headline queries; prints one JSON line.

Each query runs once to warm up (code generation, file listing) and is then timed
writing to the no-op sink, so all rows and columns are produced.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from claimloom import registry  # noqa: E402
from claimloom.session import local_session  # noqa: E402

HEADLINE = (
    "rules_all",
    "envelope_rules",
    "known_facts",
    "missing_fields",
    "candidate_rules_topk",
    "rule_outcomes",
    "rules_matched",
    "flights_refreshed",
    "entitlement_changes",
    "document_sections",
    "section_scores",
    "packed_context",
    "dialogue_state",
    "compensation_letters",
    "case_runs",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = local_session("bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.queries()
    seconds = {}
    for name in names:
        for _ in range(2):
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total seconds of headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
