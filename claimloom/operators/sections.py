"""Regulation documents: headers, sections, scoring against questions, packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.functions.text import (
    SPACE_CLASS_IN_LINE,
    count_of,
    strip,
    words,
)
from claimloom.functions.vocabulary import (
    CONTEXT_HEADING,
    CONTEXT_NOTE,
    SECTION_KEYWORD_WEIGHT,
    SECTION_KEYWORDS,
)

GENERAL_ID = "General"
GENERAL_TITLE = "General Provisions"
MAX_CONTEXT = 3000

# The three kinds of header lines, tried in this order at the start of a
# stripped line. White space is spelled out, as Java's \s is not Python's.
_S = SPACE_CLASS_IN_LINE
NUMBERED_WORD = rf"(?:Section|SECTION|Chapter|CHAPTER)[{_S}]+((?U:\d+(?:\.\d+)?))[:{_S}]*([^\n]+)"
DOTTED_NUMBER = rf"((?U:\d+\.\d+(?:\.\d+)?))[:\.{_S}]+([A-Z][^\n]+)"
ALL_CAPITALS = rf"([A-Z][A-Z{_S}]{{10,}})"


def documents_from_pages(pages: DataFrame) -> DataFrame:
    """(doc_id, page_no, page_text) -> (doc_id, text): non-empty pages in order, each
    followed by a blank line."""
    page = F.struct("page_no", F.concat("page_text", F.lit("\n\n")).alias("text"))
    return (
        pages.where(F.col("page_text") != "")
        .groupBy("doc_id")
        .agg(F.sort_array(F.collect_list(page)).alias("pages"))
        .select(
            "doc_id", F.array_join(F.transform("pages", lambda p: p["text"]), "").alias("text")
        )
    )


def _header(line: Column) -> Column:
    """struct(kind, number, title) of a header line; kind is NULL on other lines."""
    def group(pattern, n):
        return F.regexp_extract(line, "^" + pattern, n)

    def is_a(pattern):
        return line.rlike("^" + pattern)

    kind = (
        F.when(is_a(NUMBERED_WORD), "word")
        .when(is_a(DOTTED_NUMBER), "number")
        .when(is_a(ALL_CAPITALS), "capitals")
    )
    number = F.when(is_a(NUMBERED_WORD), group(NUMBERED_WORD, 1)).when(
        is_a(DOTTED_NUMBER), group(DOTTED_NUMBER, 1)
    )
    title = (
        F.when(is_a(NUMBERED_WORD), group(NUMBERED_WORD, 2))
        .when(is_a(DOTTED_NUMBER), group(DOTTED_NUMBER, 2))
        .otherwise(group(ALL_CAPITALS, 1))
    )
    return F.struct(kind.alias("kind"), number.alias("number"), strip(title).alias("title"))


def section_headers(documents: DataFrame) -> DataFrame:
    """(doc_id, line_no, kind, number, title) of every header line."""
    lines = documents.select(
        "doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")
    )
    return (
        lines.select("doc_id", "line_no", _header(strip(F.col("line"))).alias("h"))
        .where("h.kind IS NOT NULL")
        .select("doc_id", "line_no", "h.kind", "h.number", "h.title")
    )


def sections(documents: DataFrame) -> DataFrame:
    """(doc_id, position, section_id, title, content), one row per section.

    Everything happens within the document's row, so no text is shuffled:
    1. lines are stripped and blank ones dropped; the text is cut before each header
       line, giving block 0 (before any header) and one block per header;
    2. blocks of one id sort next to each other; the first gives the section's position
       and the last its title and content (a repeated id replaces the section);
    3. a header of capitals has no number and is always new; its id is its position.
    """
    lines = F.filter(
        F.transform(F.split("text", "\n"), strip), lambda line: line != ""
    )
    header_ahead = f"\n(?=(?:{NUMBERED_WORD}|{DOTTED_NUMBER}|{ALL_CAPITALS}))"
    clean = F.concat(F.lit("\n"), F.array_join(lines, "\n"))
    cut = documents.select("doc_id", F.split(clean, header_ahead).alias("blocks"))

    def head(block, i):
        h = _header(F.substring_index(block, "\n", 1))
        number = F.when(i == 0, F.lit(GENERAL_ID)).otherwise(h["number"])
        return F.struct(
            # a header of capitals gets a key no other block has
            F.coalesce(number, F.lit("")).alias("number"),
            F.when(number.isNull(), i).otherwise(-1).alias("unique"),
            i.alias("i"),
            F.when(i == 0, F.lit(GENERAL_TITLE)).otherwise(h["title"]).alias("title"),
        )

    by_id = cut.select(
        "doc_id", "blocks", F.sort_array(F.transform("blocks", head)).alias("heads")
    )
    before = F.concat(F.array(F.lit(None)), F.col("heads"))
    after = F.concat(F.slice("heads", 2, F.size("heads")), F.array(F.lit(None)))

    def same_id(a, b):
        return F.coalesce((a["number"] == b["number"]) & (a["unique"] == b["unique"]), F.lit(False))

    # zip_with pads the shorter array with NULL, so `before` may be one longer
    firsts = F.filter(
        F.zip_with("heads", before, lambda h, p: F.when(~same_id(h, p), h)), lambda h: h.isNotNull()
    )
    lasts = F.filter(
        F.zip_with("heads", after, lambda h, n: F.when(~same_id(h, n), h)), lambda h: h.isNotNull()
    )
    kept = F.sort_array(
        F.zip_with(
            firsts,
            lasts,
            lambda f, l: F.struct(f["i"].alias("first"), f["number"], l["title"], l["i"].alias("last")),
        )
    )
    placed = by_id.select("doc_id", "blocks", kept.alias("kept"))

    def section(s, position):
        block = F.get("blocks", s["last"])
        body = F.when(
            s["last"] == 0, F.ltrim(block, F.lit("\n"))
        ).otherwise(
            F.when(
                block.contains("\n"), F.substr(block, F.locate("\n", block) + 1)
            ).otherwise("")
        )
        return F.struct(
            position.alias("position"),
            F.when(s["number"] == "", F.concat(F.lit("section_"), position.cast("string")))
            .otherwise(s["number"])
            .alias("section_id"),
            s["title"].alias("title"),
            body.alias("content"),
        )

    return placed.select(
        "doc_id", F.inline(F.transform("kept", section))
    )


def section_overview(sections: DataFrame, n: int = 10) -> DataFrame:
    """The first n section titles of each document, in document order."""
    return sections.where(F.col("position") < n).select(
        "doc_id", "position", F.concat(F.lit("- "), "title").alias("line")
    )


def _block_length() -> Column:
    """Length of '## title', content and the blank line after it."""
    return F.length("title") + F.length("content") + 6


def question_terms(asked: DataFrame) -> DataFrame:
    """(doc_id, question) -> (doc_id, question, term, weight).

    A keyword weighs 10 for each group named in the question; a question word longer
    than three characters weighs 1 for each time it is asked.
    """
    def group(name, keywords):
        terms = F.array(*(F.lit(k) for k in keywords))
        return F.when(F.col("question").contains(name), terms).otherwise(
            F.array().cast("array<string>")
        )

    keywords = F.concat(*(group(g, k) for g, k in SECTION_KEYWORDS.items()))
    long_words = F.filter(words(F.col("question")), lambda w: F.length(w) > 3)

    def weighted(terms, weight):
        return F.transform(terms, lambda t: F.struct(t.alias("term"), F.lit(weight).alias("weight")))

    return (
        asked.select(
            "doc_id",
            "question",
            F.inline(F.concat(weighted(keywords, SECTION_KEYWORD_WEIGHT), weighted(long_words, 1))),
        )
        .groupBy("doc_id", "question", "term")
        .agg(F.sum("weight").alias("weight"))
    )


def _asked(queries: DataFrame) -> DataFrame:
    return queries.select("doc_id", F.lower("query").alias("question")).distinct()


def _score_asked(asked: DataFrame, sections: DataFrame) -> DataFrame:
    """(doc_id, question, position, block_length, score) with score > 0.

    Equal questions are scored once, and a term is counted once per section however
    many questions use it. Texts are joined once, with a row per document.
    """
    terms = question_terms(asked)
    text = sections.select(
        "doc_id",
        "position",
        _block_length().alias("block_length"),
        F.lower(F.concat_ws(" ", "title", "content")).alias("text"),
    )
    # all terms of a document stand in one row, so a section meets one row and is read once
    wanted = terms.groupBy("doc_id").agg(F.collect_set("term").alias("wanted"))
    found = F.filter(
        F.transform("wanted", lambda t: F.struct(t.alias("term"), F.when(F.col("text").contains(t), count_of(F.col("text"), t)).alias("n"))),
        lambda h: h["n"].isNotNull(),
    )
    hits = text.join(wanted, "doc_id").select("doc_id", "position", "block_length", F.inline(found))
    return (
        terms.join(hits, ["doc_id", "term"])
        .groupBy("doc_id", "question", "position", "block_length")
        .agg(F.sum(F.col("weight") * F.col("n")).alias("score"))
    )


def section_scores(queries: DataFrame, sections: DataFrame) -> DataFrame:
    """(query_id, doc_id, position, score) for sections with a positive score.

    queries: (query_id, doc_id, query), the document being the one that is asked.
    """
    scored = _score_asked(_asked(queries), sections)
    return (
        queries.withColumn("question", F.lower("query"))
        .join(scored, ["doc_id", "question"])
        .select("query_id", "doc_id", "position", "score")
    )


def packed_contexts(
    queries: DataFrame, sections: DataFrame, max_length: int = MAX_CONTEXT
) -> DataFrame:
    """(query_id, doc_id, section_ids, packed_length, context).

    Sections are taken by score, ties by position, each as long as it still fits;
    one that does not fit is passed over. The closing note always follows.

    The walk needs an order over all scored sections of a question. Of sections of
    equal length L only the first budget / L can ever be taken, because once one does
    not fit no later one does; the others are dropped before the walk. What remains is
    bounded by the budget (about budget * ln(budget) rows), however many sections match.
    """
    budget = max_length - len(CONTEXT_HEADING)
    asked = _asked(queries)
    scored = _score_asked(asked, sections).where(F.col("block_length") <= budget)
    same_length = Window.partitionBy("doc_id", "question", "block_length").orderBy(
        F.desc("score"), "position"
    )
    shortest_block = 6
    fitting = (
        scored.withColumn("place", F.row_number().over(same_length))
        .where(F.col("place") <= max(budget // shortest_block, 1))
        .where(F.col("place") * F.col("block_length") <= budget)
    )
    candidates = F.sort_array(
        F.collect_list(F.struct((-F.col("score")).alias("rank"), "position", "block_length"))
    )

    def take(state, s):
        fits = state["used"] + s["block_length"] <= budget
        return F.struct(
            F.when(fits, state["used"] + s["block_length"]).otherwise(state["used"]).alias("used"),
            F.when(fits, F.concat(state["taken"], F.array(s["position"])))
            .otherwise(state["taken"])
            .alias("taken"),
        )

    start = F.struct(
        F.lit(0).alias("used"), F.array().cast("array<int>").alias("taken")
    )
    walked = (
        fitting.groupBy("doc_id", "question")
        .agg(candidates.alias("candidates"))
        .select("doc_id", "question", F.aggregate("candidates", start, take).alias("walk"))
    )
    chosen = (
        walked.select(
            "doc_id", "question", F.posexplode("walk.taken").alias("ordinal", "position")
        )
        .join(
            sections.where(_block_length() <= budget).select(
                "doc_id", "position", "section_id",
                F.concat(
                    F.lit("## "), "title", F.lit("\n"), "content", F.lit("\n\n")
                ).alias("block"),
            ),
            ["doc_id", "position"],
        )
        .groupBy("doc_id", "question")
        .agg(
            F.sort_array(F.collect_list(F.struct("ordinal", "section_id", "block"))).alias("parts"),
            F.sum(F.length("block")).alias("used"),
        )
    )
    joined = queries.withColumn("question", F.lower("query")).join(
        chosen, ["doc_id", "question"], "left"
    )

    def parts(name):
        return F.coalesce(F.transform("parts", lambda p: p[name]), F.array().cast("array<string>"))

    return joined.select(
        "query_id",
        "doc_id",
        F.array_join(parts("section_id"), ",").alias("section_ids"),
        (F.coalesce("used", F.lit(0)) + len(CONTEXT_HEADING)).alias("packed_length"),
        F.concat(
            F.lit(CONTEXT_HEADING), F.array_join(parts("block"), ""), F.lit(CONTEXT_NOTE)
        ).alias("context"),
    )
