"""Sectioning and packing: worked examples, and what must hold for any text."""

import random

import pytest
from pyspark.sql import functions as F

from claimloom.functions import vocabulary as v
from claimloom.operators import sections as op

LINES = [
    "Section 1: First", "SECTION 2 Second", "Section 34", "Section 3", "Chapter 2.5:\tTail ",
    "1.2 Alpha", "1.2. Beta", "3.3.2(b) not a header", "4.5.6: Gamma", "1.2 lower",
    "GENERAL CONDITIONS", "GENERAL CONDITIONS of carriage", "TOO SHORT", "plain words",
    "  indented ", "", " \t ", " wide\x1c", "a: b", "Section 7 : Odd", "éà",
]


def sections_of(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {n: [] for n in range(len(texts))}
    for r in op.sections(docs).orderBy("doc_id", "position").collect():
        found[r.doc_id].append(r)
    return found


@pytest.mark.parametrize(
    "text, want",
    [
        ("", [("General", "General Provisions", "")]),
        ("\n\n", [("General", "General Provisions", "")]),
        ("intro\nSection 2: Fees\nten\n\neleven", [("General", "General Provisions", "intro"), ("2", "Fees", "ten\neleven")]),
        # a number that comes again keeps its place and takes the later title and lines
        ("Section 1: A\nold\n1.2 Other\nx\nSection 1: B\nnew", [("General", "General Provisions", ""), ("1", "B", "new"), ("1.2", "Other", "x")]),
        # capitals have no number and are named by their place
        ("GENERAL CONDITIONS\na\nGENERAL CONDITIONS\nb", [("General", "General Provisions", ""), ("section_1", "GENERAL CONDITIONS", "a"), ("section_2", "GENERAL CONDITIONS", "b")]),
    ],
)
def test_worked_examples(spark, text, want):
    got = [(r.section_id, r.title, r.content) for r in sections_of(spark, [text])[0]]
    assert got == want


def test_any_text(spark):
    """Ids are unique, positions count up, no line is invented, doubled or out of order, and
    without repeated headers none is lost."""
    rng = random.Random(7)
    texts = ["\n".join(rng.choice(LINES) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    plain = {"plain words", "indented", "a: b", "éà", "TOO SHORT", "Section 3", "1.2 lower", "3.3.2(b) not a header", "wide"}
    for n, own in sections_of(spark, texts).items():
        assert [r.position for r in own] == list(range(len(own)))
        assert len({r.section_id for r in own}) == len(own)
        assert own[0].section_id == "General"
        source = [x.strip() for x in texts[n].split("\n") if x.strip()]
        for r in own:
            lines = r.content.split("\n") if r.content else []
            assert set(lines) <= plain
            rest = iter(source)
            assert all(x in rest for x in lines)  # a subsequence of the text
        headers = [x for x in source if x not in plain]
        if len(headers) == len({r.title for r in own[1:]}) == len(own) - 1:
            assert sum(len(r.content.split("\n")) if r.content else 0 for r in own) == len(source) - len(headers)


@pytest.mark.parametrize(
    "line, kind, number, title",
    [
        ("Section 34", "word", "3", "4"),
        ("Section 3", None, None, None),
        ("3.3.2(b) text", None, None, None),
        ("1.4. Refund", "number", "1.4", "Refund"),
        ("GENERAL CONDITIONS of carriage", "capitals", None, "GENERAL CONDITIONS"),
        ("SHORT CAPS", None, None, None),
    ],
)
def test_header_patterns(spark, line, kind, number, title):
    docs = spark.createDataFrame([(1, line)], "doc_id long, text string")
    rows = op.section_headers(docs).select("kind", "number", "title").collect()
    assert [tuple(r) for r in rows] == ([(kind, number, title)] if kind else [])


def asked(spark, questions):
    rows = [(n, d, q) for n, (d, q) in enumerate(questions)]
    return spark.createDataFrame(rows, "query_id long, doc_id long, query string")


def test_scores_by_hand(spark):
    """A word of the question counts once per occurrence, a keyword of its group ten times."""
    docs = spark.createDataFrame([(0, "Section 1: Delay\nzebra zebra\nSection 2: Other\nzebra")], "doc_id long, text string")
    (word,) = v.SECTION_KEYWORDS["delay"][:1]
    rows = op.section_scores(asked(spark, [(0, "zebra"), (0, "a zeb"), (0, "xyz delay")]), op.sections(docs)).collect()
    got = {(r.query_id, r.position): r.score for r in rows}
    assert got[0, 1] == 2 and got[0, 2] == 1
    assert not [k for k in got if k[0] == 1]  # words of three letters do not count
    text = "delay zebra zebra"
    assert got[2, 1] == 10 * sum(text.count(k) for k in v.SECTION_KEYWORDS["delay"]) + 1
    assert word


@pytest.mark.parametrize("budget", [20, 60, 120, 300, 3000])
def test_packs_are_greedy(spark, budget):
    """Blocks come by falling score and rising position, fit the budget, and each that was
    left out while there was room would not have fitted."""
    rng = random.Random(budget)
    words = "refund delay meal bag class hotel zzz late cancel refund".split()
    texts = [
        "\n".join(
            rng.choice([f"Section {rng.randint(1, 9)}: {rng.choice(words)}", " ".join(rng.choices(words, k=rng.randint(1, 12)))])
            for _ in range(rng.randint(1, 40))
        )
        for _ in range(40)
    ]
    questions = [(d, q) for d in range(40) for q in ("Cancel and refund", "delay hotel hotel", "zzz", "facility of class, downgrade", "hm")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sections, queries = op.sections(docs).cache(), asked(spark, questions)
    block = {(r.doc_id, r.position): (r.section_id, f"## {r.title}\n{r.content}\n\n") for r in sections.collect()}
    ranked = {n: [] for n in range(len(questions))}
    for r in op.section_scores(queries, sections).collect():
        ranked[r.query_id].append((-r.score, r.position))
    for r in op.packed_contexts(queries, sections, budget).collect():
        order = [block[r.doc_id, place] for _, place in sorted(ranked[r.query_id])]
        taken = r.section_ids.split(",") if r.section_ids else []
        assert r.context.startswith(v.CONTEXT_HEADING) and r.context.endswith(v.CONTEXT_NOTE)
        used = len(v.CONTEXT_HEADING)
        for key, text in order:
            if taken and key == taken[0]:
                assert r.context[used : used + len(text)] == text
                used, taken = used + len(text), taken[1:]
            else:
                assert used + len(text) > budget
        assert not taken and used == r.packed_length == len(r.context) - len(v.CONTEXT_NOTE)
        assert r.packed_length <= max(budget, len(v.CONTEXT_HEADING))
    sections.unpersist()


def test_pages(spark):
    pages = spark.createDataFrame(
        [(1, 2, "b"), (1, 1, "a"), (1, 3, ""), (1, 4, None)], "doc_id long, page_no int, page_text string"
    )
    assert op.documents_from_pages(pages).first().text == "a\n\nb\n\n"


def test_one_document_many_questions(spark):
    """All questions on one document: the hot key is scored once per distinct text."""
    docs = spark.createDataFrame([(1, "Section 1: Refund\nrefund late\n" * 3)], "doc_id long, text string")
    asked = spark.range(2000).select(
        F.col("id").alias("query_id"), F.lit(1).cast("long").alias("doc_id"), F.lit("refund please").alias("query")
    )
    rows = op.section_scores(asked, op.sections(docs))
    assert rows.count() == 2000 and rows.select("score").distinct().count() == 1
