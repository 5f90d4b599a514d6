import random
from collections import defaultdict

import pytest
from cases import documents, empty, rows, with_clashes

from claimloom.llm import line_dedup as L


def plain(table, min_sites):
    sites = defaultdict(set)
    for r in table:
        for line in (r[1] or "").split("\n"):
            if line.strip(" ") and r[3] is not None:
                sites[line.strip(" ")].add(r[3])
    out = []
    for r in table:
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if len(sites[x.strip(" ")]) < min_sites]
        out.append((r[0], len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("min_sites", [2, 5, 300])
def test_spread(spark, min_sites):
    """Lines on every number of sites around the threshold, and one in a third of all rows."""
    rng = random.Random(min_sites)
    sites = [f"s{k}" for k in range(min_sites * 2 + 3)]
    table = []
    for k, n in enumerate([1, 2, *range(max(1, min_sites - 3), min_sites + 4), min_sites * 2] * 2):
        for site in rng.sample(sites, n):
            table.append((len(table), f"  line {k} \n\nown {len(table)}\n", "en", site, 1))
            table.append((len(table), f"line {k}", "en", site, 1))  # the same site again
    table += [(len(table) + k, "hot line\nx", "en", "s0", 1) for k in range(len(table) // 2)]
    table += [(len(table) + k, f"line {k}", "en", None, 1) for k in range(6)]
    assert rows(L.remove_boilerplate(documents(spark, table, 5), min_sites=min_sites)) == plain(table, min_sites)


def test_awkward_rows(spark):
    table = documents(spark)
    assert rows(L.remove_boilerplate(with_clashes(table), min_sites=2)) == plain([tuple(r) for r in table.collect()], 2)


def test_empty_table(spark):
    assert rows(L.remove_boilerplate(empty(spark))) == []
