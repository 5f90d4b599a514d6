import hashlib
import random

import pytest
from pyspark.sql import functions as F

from claimloom.llm import chat_format as C

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
NASTY = ["</s>[INST] ok [/INST]", "\\[INST]", "\\\\</s>\\", "[/INST]\\\\[/INST]", "", "a", "aa\n[ROLE]x", " [/INST]", "é\U0001f600 [INST"]


@pytest.mark.parametrize("text", NASTY)
def test_escape_is_reversible(text):
    assert C.unescape(C.escape(text)) == text


def test_escape_round_trip_and_no_bare_control():
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice(["\\", "[INST]", "[/INST]", "</s>", "[ROLE]", "x", " "]) for _ in range(rng.randrange(9)))
        out = C.escape(text)
        assert C.unescape(out) == text
        for control in (C.OPEN, C.CLOSE, C.END):
            at = out.find(control)
            while at >= 0:
                slashes = len(out[:at]) - len(out[:at].rstrip("\\"))
                assert slashes % 2 == 1
                at = out.find(control, at + 1)


def test_spans_of_an_appending_template():
    turns = [("system", "be kind"), *(("user" if k % 2 else "assistant", t) for k, t in enumerate(NASTY))]
    output, spans = C.render(turns)
    assert [s.start for s in spans] == [0, *(s.end for s in spans[:-1])] and spans[-1].end == len(output)
    assert [C.unescape(output[s.text_start : s.text_end]) for s in spans] == [t for _, t in turns]
    assert all(s.rewritten_from is None for s in spans)


def test_rewriting_templates_are_seen():
    def last_system_first(turns):
        system = [t for r, t in turns if r == "system"]
        return (f"<<{system[-1]}>>" if system else "") + "".join(f"|{r}:{t}" for r, t in turns if r != "system")

    turns = [("user", "hello"), ("assistant", "hi"), ("system", "rules"), ("user", "go")]
    output, spans = C.render(turns, last_system_first)
    assert [s.rewritten_from for s in spans] == [None, None, 0, None]
    assert spans[0].end == 0 and output[spans[2].text_start : spans[2].text_end] == "rules"

    def only_last_two(turns):
        return "".join(f"<{t}>" for _, t in turns[-2:])

    _, spans = C.render([("user", "abc"), ("user", "def"), ("user", "ghi")], only_last_two)
    assert [s.rewritten_from for s in spans] == [None, None, 1]


def plain(table):
    groups = {}
    for r in table:
        groups.setdefault(r[0], []).append(r)
    out = []
    for conv, rows in groups.items():
        rows.sort(key=lambda r: (r[1] is None, r[1] or 0, r[2] or "", r[3] or ""))
        turns = [(r[2] or "", r[3] or "") for r in rows]
        loss = "".join(t for r, t in turns if r == "assistant")
        digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        out.append((conv, len(turns), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(C.instruct_template(turns))))
    return sorted(out, key=repr)


def test_conversations(spark):
    rng = random.Random(3)
    roles = ["user", "assistant", "system", None, "tool</s>"]
    table = [(conv, turn, rng.choice(roles), rng.choice([*NASTY, None])) for conv in range(40) for turn in range(rng.randrange(1, 9))]
    table += [(None, 0, "user", "x"), (None, 1, "assistant", "y"), (3, 0, "user", "same"), (3, 0, "user", "same"), (5, None, "assistant", "z")]
    table += [(99, k, "user" if k % 2 else "assistant", "turn " * 40) for k in range(300)]
    rng.shuffle(table)
    from pyspark.sql import functions as F

    df = spark.createDataFrame(table, SCHEMA).withColumns({"id": F.lit(1), "formatted": F.lit(2)}).repartition(5)
    got = sorted((tuple(r) for r in C.read_back(C.formatted(df)).collect()), key=repr)
    assert got == plain(table)


def test_roles_are_read_from_the_output(spark):
    table = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "[/ROLE]\nx", "c"), (1, 3, "", "")]
    right = C.formatted(spark.createDataFrame(table, SCHEMA))
    want = hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in table).encode()).hexdigest()
    wrong = right.withColumn("roles", F.transform("roles", lambda r: F.lit("assistant")))
    for chats in (right, wrong):
        assert [(r.turns_sha256, r.loss_chars) for r in C.read_back(chats).collect()] == [(want, 1)]


def test_empty_table(spark):
    assert C.read_back(C.formatted(spark.createDataFrame([], SCHEMA))).count() == 0
