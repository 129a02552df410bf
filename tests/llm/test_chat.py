import hashlib

import pytest
from pyspark.sql import functions as F

from fernglass.llm import chat, queries

AWKWARD = ["", "plain", "<turn:x>", "</turn>\n", "</turn>", r"<\turn:", r"<\\/turn> <part:image>", "<", "turn:", "/turn>", "\\", "é𝄞<part:", "a\nb", "$1 \\1", "<<turn:<", "### Assistant:"]
CLASHING = ("formatted", "loss", "n_turns", "_key", "_turn", "_role", "_parts", "attachments")


@pytest.fixture(scope="module")
def chats(spark):
    def make(rows):
        return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("x") for c in CLASHING})

    return make


def read(df):
    f = F.col("formatted")
    return df.select("*", chat.texts(f).alias("texts"), chat.turns(f).alias("turns"), chat.under_loss(f, F.col("loss")).alias("learnt")).collect()


def test_round_trip(chats):
    """Whatever texts and roles say, they come back; no text can make a mark."""
    roles = ["user", "assistant", "a>b", "<turn:y>", "\\", "\\g\\l", "", "assistant"]
    rows = [(i, j, roles[(i + j) % len(roles)], AWKWARD[(i * 7 + j) % len(AWKWARD)]) for i in range(40) for j in range(i % 9 + 1)]
    for r in read(chat.format_chats(chats(rows).repartition(5))):
        own = [(role, text) for i, _, role, text in rows if i == r.conv_id]
        assert [tuple(x) for x in r.texts] == own and [(x.role, [tuple(p) for p in x.parts]) for x in r.turns] == [(a, [("text", b)]) for a, b in own]
        assert r.n_turns == len(own) == r.formatted.count("</turn>\n") == r.formatted.count("<turn:") and "<part:" not in r.formatted
        assert r.learnt == [t for role, t in own if role == "assistant"]
        raw = [r.formatted[x["at"] : x["at"] + x["length"]] for x in r.loss]
        assert [len(t) for t in raw] == [x["length"] for x in r.loss] and all("<turn:" not in t for t in raw)
        assert [t for t in raw if "<" not in t] == [t for t in r.learnt if "<" not in t]


def test_rows(chats):
    rows = [(1, 1, "assistant", None), (1, 0, "user", "q"), (1, 1, "assistant", None), (1, None, "user", "first"), (None, 0, None, "n"), (2, 0, "assistant", "x" * 200_000)]
    got = {r.conv_id: r for r in read(chat.format_chats(chats(rows)))}
    # those without a number first, repeated rows stay, a null text is empty, a null role too
    assert [tuple(t) for t in got[1].texts] == [("user", "first"), ("user", "q"), ("assistant", ""), ("assistant", "")] and got[1].learnt == ["", ""]
    assert [tuple(t) for t in got[None].texts] == [("", "n")] and got[None].loss == [] and got[2].learnt == ["x" * 200_000]
    assert chat.format_chats(chats([])).count() == 0
    # equal numbers go by role and content, however rows lie
    tied = [(1, 0, "b", "2"), (1, 0, "b", "1"), (1, 0, "a", "3")]
    assert len({chat.format_chats(chats(t)).first().formatted for t in (tied, tied[::-1])}) == 1


def test_long_conversation(spark):
    """A conversation of a third of all rows."""
    rows = spark.range(9_000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("t"), "id").alias("text"))
    r = next(r for r in read(chat.format_chats(rows.repartition(8)).where("conv_id = 0")))
    assert r.n_turns == 3_000 and [t.text for t in r.texts] == [f"t{i}" for i in range(0, 9_000, 3)] and r.learnt == [f"t{i}" for i in range(3, 9_000, 6)]
    assert [r.formatted[x["at"] : x["at"] + x["length"]] for x in r.loss] == r.learnt


def part(kind, text=None, ref=None, width=None, height=None, seconds=None, pages=None):
    return (kind, text, ref, width, height, seconds, pages)


def test_typed_parts(spark):
    rows = [
        (1, 0, "user", [part("text", "look <"), part("text", "turn:x> "), part("image", ref="s3://a.png", width=57, height=28), part("text", "and")]),
        (1, 1, "assistant", [part("audio", ref="b.wav", seconds=2.01), None, part("text", "</turn>"), part("document", ref="c.pdf", pages=3), part("image", ref="d"), part("text", "z")]),
        (1, 2, "assistant", None),
        (1, 3, "user", []),
        (2, 0, "user", [part(None, "a"), part("VIDEO", ref="v")]),
    ]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART_TYPE}>")
    got = {r.conv_id: r for r in read(chat.format_chats(df, parts="parts"))}
    r = got[1]
    assert r.formatted.startswith("<turn:user>look <<part:text>turn:x> <part:image><part:text>and</turn>\n<turn:assistant><part:audio><part:text>")
    assert [[tuple(p) for p in t.parts] for t in r.turns] == [
        [("text", "look <"), ("text", "turn:x> "), ("image", ""), ("text", "and")],
        [("audio", ""), ("text", "</turn>"), ("document", ""), ("image", ""), ("text", "z")],
        [("text", "")],
        [("text", "")],
    ]
    assert [tuple(a) for a in r.attachments] == [(0, 2, "image", "s3://a.png", 3), (1, 0, "audio", "b.wav", 51), (1, 2, "document", "c.pdf", 2400), (1, 3, "image", "d", None)]
    assert r.attachment_tokens == 3 + 51 + 2400 and r.learnt == ["</turn>", "z"]
    # the n-th placeholder is the n-th attachment's
    placed = [p.kind for t in r.turns for p in t.parts if p.kind != "text"]
    assert placed == [a.kind for a in r.attachments]
    assert got[2].formatted == "<turn:user>a<part:video></turn>\n" and got[2].attachments[0].tokens is None and got[2].attachment_tokens == 0
    other = chat.format_chats(df, parts="parts", trained=("user",), expansions={"image": lambda p: F.lit(7).cast("bigint")})
    assert {r.conv_id: r.attachment_tokens for r in other.collect()} == {1: 14, 2: 0}


def test_query_against_plain_python(spark, tmp_path):
    rows = [(i, j, ["user", "assistant", "system"][(i + j) % 3], AWKWARD[(i * 5 + j) % len(AWKWARD)]) for i in range(30) for j in range(i % 5 + 1)] + [(50, 0, "assistant", None), (51, 0, "assistant", "é" * 70_000)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4).write.parquet(str(tmp_path / "conversations.parquet"))
    rows += [(-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok")]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r.conv_id: r for r in queries.op12_chat_format(spark, str(tmp_path)).collect()}
    assert len(got) == 33
    for i, r in got.items():
        own = [(role, t or "") for k, _, role, t in rows if k == i]
        learnt = "".join(t for role, t in own if role == "assistant")
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(own), sha("".join(f"{a}\n{b}\n" for a, b in own)), len(learnt), sha(learnt))
        assert r.formatted_chars > sum(len(t) for _, t in own)
