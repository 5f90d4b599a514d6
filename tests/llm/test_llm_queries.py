"""Every registered query of the package on the given tables."""

import hashlib
import re
import zlib
from collections import defaultdict
from fractions import Fraction

import compare
import numpy as np
import pytest
from test_decontaminate import plain_with_short
from test_mixing import plain_targets
from test_periodic_runs import plain as plain_runs
from test_periodic_runs import plain_kept
from test_simhash_dedup import plain_components, plain_print
from test_substring_dedup import plain as plain_substrings
from test_url_filter import plain_filter
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from claimloom.llm import queries as Q

COLUMNS = {
    "op1_simhash": ["doc_id", "fingerprint", "component_id"],
    "op2_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op3_substrings": ["doc_id", "n_words", "n_removed", "kept_sha256"],
    "op4_decontaminate": ["doc_id", "item_id", "start", "similarity"],
    "op5_mixing": ["doc_id", "size", "source_size", "target", "taken"],
    "op6_chat": ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
    "op7_tokens": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op8_lines": ["doc_id", "n_lines", "n_removed", "kept_sha256"],
    "op9_urls": ["page_id", "host", "path", "rule", "verdict"],
    "op10_topk": ["query_id", "rank", "vec_id", "score"],
    "op11_pieces": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op12_runs": ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"],
    "op13_divergence": ["lang", "source", "part", "item", "value", "rank"],
}


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return sorted((tuple(r) for r in Q.table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source").collect()))


def test_all_are_registered():
    assert set(COLUMNS) == set(Q.queries())
    assert {*COLUMNS, "pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_against_sql(spark, sf_dir, name):
    got = compare.spark_rows(Q.queries()[name](spark, sf_dir))
    assert got == compare.duck_rows(compare.connect(sf_dir), Q.oracle_sql()[name])
    assert got[1]


def run(spark, sf_dir, name):
    df = Q.queries()[name](spark, sf_dir)
    assert df.columns[: len(COLUMNS[name])] == COLUMNS[name]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    return df.collect()


def test_op1(spark, sf_dir, docs):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in run(spark, sf_dir, "op1_simhash")}
    prints = [plain_print(t) for _, t, *_ in docs]
    want = {d: (f"{p:016x}", docs[g][0]) for (d, *_), p, g in zip(docs, prints, plain_components(prints), strict=True)}
    assert got == want
    assert len({c for _, c in got.values()}) < len(got)


def test_op2(spark, sf_dir, docs):
    got = run(spark, sf_dir, "op2_toxicity")
    assert sorted(r.doc_id for r in got) == [d for d, *_ in docs]
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)


def test_op3(spark, sf_dir, docs):
    got = sorted(tuple(r) for r in run(spark, sf_dir, "op3_substrings"))
    want = sorted((d, n, gone, hashlib.sha256(kept.encode()).hexdigest()) for d, n, gone, kept in plain_substrings(docs))
    assert got == want


def test_op4(spark, sf_dir, docs):
    got = sorted((tuple(r) for r in run(spark, sf_dir, "op4_decontaminate")), key=repr)
    benchmark = [tuple(r) for r in Q.table(spark, sf_dir, "benchmark").select("item_id", "text").collect()]
    assert got == plain_with_short(docs, benchmark)
    assert got


def test_op5(spark, sf_dir, docs):
    got = run(spark, sf_dir, "op5_mixing")
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t, *_ in docs}
    source = {d: s for d, _, _, s in docs}
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for d, n in size.items():
        sizes[source[d]] += n
    want = plain_targets(dict(sizes))
    assert len(got) == len(docs)
    for r in got:
        s = source[r.doc_id]
        assert (r.size, r.source_size) == (size[r.doc_id], sizes[s])
        assert r.target == pytest.approx(want[s])
        assert r.taken <= 3 * r.size
        taken[s] += r.taken
        largest[s] = max(largest[s], r.size)
    assert all(abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6 for s in sizes)


def test_op6(spark, sf_dir):
    got = {r.conv_id: r for r in run(spark, sf_dir, "op6_chat")}
    own = got.pop(-7)
    control = "</s>[INST] ok [/INST]"
    assert own.n_turns == 2 and own.loss_sha256 == hashlib.sha256(control.encode()).hexdigest()
    assert own.turns_sha256 == hashlib.sha256(f"user\n{control}\nassistant\n{control}\n".encode()).hexdigest()
    talks = defaultdict(list)
    for r in Q.table(spark, sf_dir, "conversations").collect():
        talks[r.conv_id].append((r.turn, r.role or "", r.text or ""))
    assert set(talks) == set(got)
    for conv, turns in talks.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        digest = hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
        assert (got[conv].n_turns, got[conv].turns_sha256, got[conv].loss_chars) == (len(turns), digest, len(loss))
        assert got[conv].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_op7(spark, sf_dir, docs):
    got = sorted(tuple(r) for r in run(spark, sf_dir, "op7_tokens"))
    tokenizer, start, want = Tokenizer.from_file(Q.tokenizer_path()), 0, []
    for doc, text, *_ in docs:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want


def test_op9(spark, sf_dir):
    got = sorted((tuple(r) for r in run(spark, sf_dir, "op9_urls")), key=lambda r: repr(r[:6]))
    pages = [tuple(r) for r in Q.table(spark, sf_dir, "pages").select("page_id", "url", "html").collect()]
    labels = [(r.doc_id, None if r.quality is None else 1 - r.quality) for r in Q.table(spark, sf_dir, "labels").collect()]
    assert got == plain_filter(pages, labels, Q.RULES)
    assert {r[4] for r in got} == {"allow", "block"}


def test_op11(spark, sf_dir, docs):
    from sentencepiece import SentencePieceProcessor

    library, want = SentencePieceProcessor(model_file=Q.tokenizer_path("piece_bpe_32k.model")), []
    for doc, text, *_ in docs:
        ids = library.encode(text or "", add_eos=True)
        digests = (hashlib.sha256(t.encode()).hexdigest() for t in (" ".join(map(str, ids)), library.decode(ids)))
        want.append((doc, len(ids), *digests))
    assert sorted(tuple(r) for r in run(spark, sf_dir, "op11_pieces")) == want


def test_op12(spark, sf_dir, docs):
    want = []
    for doc, text, *_ in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h, n = zlib.crc32(str(doc).encode()), len(words)
        if h % 10 == 0 and n:
            a, g = (h // 10) % n, h // 10
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = plain_runs(words)
        top = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None,) * 3)
        milli = 1000 * top[1] // top[2] if runs else None
        digests = ("".join(f"{s},{size},{q}\n" for s, size, q in runs), plain_kept(words, runs))
        want.append((doc, len(runs), *top, milli, *(hashlib.sha256(t.encode()).hexdigest() for t in digests)))
    got = sorted(tuple(r) for r in run(spark, sf_dir, "op12_runs"))
    assert got == want
    assert sum(r[1] > 0 for r in got) > 5


def test_pipeline(spark, sf_dir):
    """Each stage against a plain version on what it is given."""
    frame = Q.table(spark, sf_dir, "documents")
    benchmark = [tuple(r) for r in Q.table(spark, sf_dir, "benchmark").collect()]
    from claimloom.llm.storage import stored
    from test_decontaminate import plain as plain_leaks

    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_duplicates", "decontamination", "mixing", "token_ids"]
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        before, frame = frame, stored(stage(spark, frame, sf_dir), name)
        if name != "token_ids":
            assert frame.columns == before.columns
        after[name] = sorted(tuple(r) for r in frame.collect())
    scores = {r.doc_id: r.score for r in Q.queries()["op2_toxicity"](spark, sf_dir).collect()}
    assert {r[0] for r in after["toxicity"]} == {d for d, s in scores.items() if s < Q.TOXIC}
    groups = plain_components([plain_print(r[1]) for r in after["toxicity"]])
    assert after["near_duplicates"] == [r for k, r in enumerate(after["toxicity"]) if groups[k] == k]
    found = plain_leaks(after["near_duplicates"], benchmark)
    leaks, exact = {r[0] for r in found}, {r[0] for r in found if r[3] == 1}
    gone = {r[0] for r in after["near_duplicates"]} - {r[0] for r in after["decontamination"]}
    assert gone <= leaks and len(gone) >= 0.9 * len(leaks)
    assert exact and exact <= gone
    assert set(after["mixing"]) <= set(after["decontamination"])
    tokenizer, start, want = Tokenizer.from_file(Q.tokenizer_path()), 0, []
    for r in after["mixing"]:
        ids = np.array([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((r[0], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert after["token_ids"] == want
