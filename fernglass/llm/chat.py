"""Chat formatting: a visitor flattens the typed parts of each turn into one text, placeholders standing for what isn't text.

A turn is written <turn:role>content</turn> and a line end; an image, audio or document part is a placeholder
<part:kind> in the content, and a text part that isn't the first is led by <part:text>. The n-th placeholder of an
attachment in a conversation belongs to its n-th attachment record. A text in which <turn:, </turn> or <part: stands gets a
backslash after the <, and one more where there are backslashes already, so that what a text says is never taken for
a mark and is read back as it was; all other texts are written as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernglass.functions.text import once

#: What marks a turn and a part.
TURN, TURN_END, PART = "<turn:", "</turn>\n", "<part:"
_CONTROL = r"(turn:|/turn>|part:)"
#: The words of the placeholders of attachments.
ATTACHMENTS = ("image", "audio", "document")


def escaped(text: Column) -> Column:
    """The text without control strings: another backslash after the < of each."""
    return F.regexp_replace(text, rf"<(\\*){_CONTROL}", r"<\\$1$2")


def unescaped(text: Column) -> Column:
    """What escaped() was given."""
    return F.regexp_replace(text, rf"<\\(\\*){_CONTROL}", r"<$1$2")


#: In a role, which stands inside a mark, what could end or begin one is spelt out.
_ROLE = (("\\", "\\b"), ("<", "\\l"), (">", "\\g"))


def _role_in(role: Column) -> Column:
    return reduce(lambda c, x: F.replace(c, F.lit(x[0]), F.lit(x[1])), _ROLE, F.coalesce(role, F.lit("")))


def _role_out(role: Column) -> Column:
    return reduce(lambda c, x: F.replace(c, F.lit(x[1]), F.lit(x[0])), _ROLE[::-1], role)


def image_tokens(part: Column, patch: int = 28) -> Column:
    """One token for each square of so many pixels, begun ones included."""
    return (F.ceil(part["width"] / patch) * F.ceil(part["height"] / patch)).cast("bigint")


def audio_tokens(part: Column, rate: float = 25.0) -> Column:
    """So many tokens a second, rounded up."""
    return F.ceil(part["seconds"] * rate).cast("bigint")


def document_tokens(part: Column, page: int = 800) -> Column:
    return (part["pages"] * page).cast("bigint")


#: How many tokens a placeholder stands for, by kind.
EXPANSIONS: dict[str, Callable[[Column], Column]] = {"image": image_tokens, "audio": audio_tokens, "document": document_tokens}
#: What a part may say of itself.
PART_TYPE = "struct<kind:string,text:string,ref:string,width:bigint,height:bigint,seconds:double,pages:bigint>"


def _visited(parts: Column) -> Column:
    """The parts as (mark, body): null parts are left out; a kind that isn't known stands for itself, in small letters."""

    def visit(part: Column, i: Column) -> Column:
        is_text = F.coalesce(part["kind"], F.lit("text")) == "text"
        kind = F.regexp_replace(F.lower(part["kind"]), r"\W", "")
        mark = F.when(is_text & (i == 0), F.lit("")).when(is_text, F.lit(f"{PART}text>")).otherwise(F.concat(F.lit(PART), kind, F.lit(">")))
        body = F.when(is_text, escaped(F.coalesce(part["text"], F.lit("")))).otherwise(F.lit(""))
        return F.struct(is_text.alias("is_text"), mark.alias("mark"), body.alias("body"))

    return F.transform(F.filter(parts, lambda p: p.isNotNull()), visit)


def _attached(parts: Column, expansions: dict[str, Callable[[Column], Column]]) -> Column:
    """(part, kind, ref, tokens) of the parts that aren't text."""

    def record(part: Column, i: Column) -> Column:
        tokens = reduce(lambda rest, kind: F.when(F.lower(part["kind"]) == kind, expansions[kind](part)).otherwise(rest), expansions, F.lit(None).cast("bigint"))
        return F.struct(i.alias("part"), part["kind"].alias("kind"), part["ref"].alias("ref"), tokens.alias("tokens"))

    made = F.transform(F.filter(parts, lambda p: p.isNotNull()), record)
    return F.filter(made, lambda a: F.coalesce(a["kind"], F.lit("text")) != "text")


def sums_before(values: Column, block: int = 64) -> Column:
    """For each number of an array the sum of those before it. Sums go by blocks, so long arrays don't cost the square."""
    total = lambda part: F.aggregate(part, F.lit(0).cast("bigint"), lambda a, x: a + x)

    def blocks(v: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(v) / block).cast("int") - 1, F.lit(0))), lambda b: total(F.slice(v, b * block + 1, F.lit(block))))

    def leads(sums: Column) -> Column:
        return F.transform(sums, lambda _, b: total(F.slice(sums, F.lit(1), b)))

    def added(v: Column, lead: Column) -> Column:
        first = lambda i: F.floor(i / block).cast("int")
        return F.transform(v, lambda _, i: F.element_at(lead, first(i) + 1) + total(F.slice(v, first(i) * block + 1, i % block)))

    # what a lambda reads is bound to a variable, else it would be computed anew for each element
    return once(values, lambda v: once(blocks(v), lambda sums: once(leads(sums), lambda lead: added(v, lead))))


def format_chats(
    rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", parts: str | None = None,
    trained: Sequence[str] = ("assistant",), expansions: dict[str, Callable[[Column], Column]] = EXPANSIONS,
) -> DataFrame:
    """One row for each conversation.

    rows has one row for each turn; its content is the column `text`, or else the column `parts`, an array of structs with
    the fields of PART_TYPE. Returns key, n_turns, formatted, loss, attachments and attachment_tokens. loss lists the
    text that a model of the conversation learns to write, each text part of a turn of the trained roles: (turn: its
    number from 0, offset: in the turn's own string, at: in formatted, length), in code points. attachments: (turn, part:
    numbers from 0, kind, ref, tokens: what the placeholder expands to, null where its size isn't known).

    Turns go by their number, those without one first; among equal numbers by role and content, so repeated rows stay and
    reruns agree. A null text is empty, and so is an array of no parts; null parts are left out. A null role counts as
    empty, and a null key as a conversation of its own. Other columns aren't read, whatever their names. An empty table
    gives an empty result. A conversation is one row of the result, as it is one text; tasks join the turns they hold
    before they are shuffled, and nothing else needs the turns of a conversation together.
    """
    said, who = F.col(role).cast("string"), F.col(role).isin(*trained)
    if parts:
        visited = _visited(F.coalesce(F.col(parts), F.array().cast(f"array<{PART_TYPE}>")))
        attached = _attached(F.coalesce(F.col(parts), F.array().cast(f"array<{PART_TYPE}>")), expansions)
    else:
        body = escaped(F.coalesce(F.col(text).cast("string"), F.lit("")))
        visited = F.array(F.struct(F.lit(True).alias("is_text"), F.lit("").alias("mark"), body.alias("body")))
        attached = F.array().cast("array<struct<part:int,kind:string,ref:string,tokens:bigint>>")
    seen = rows.select(
        F.col(key).alias("_key"), F.col(turn).alias("_turn"), F.coalesce(said, F.lit("")).alias("_role"), F.coalesce(who, F.lit(False)).alias("_learnt"),
        F.concat(F.lit(TURN), _role_in(said), F.lit(">")).alias("_head"), visited.alias("_parts"), attached.alias("_attached"),
    )
    starts = sums_before(F.transform("_parts", lambda p: F.length(F.concat(p["mark"], p["body"]))))
    spans = F.transform(
        F.arrays_zip(F.col("_parts").alias("p"), starts.alias("s")),
        lambda x: F.struct(x["p"]["is_text"].alias("is_text"), (F.length("_head") + x["s"] + F.length(x["p"]["mark"])).cast("int").alias("offset"), F.length(x["p"]["body"]).alias("length")),
    )
    content = F.array_join(F.transform("_parts", lambda p: F.concat(p["mark"], p["body"])), "")
    learnt = F.when(F.col("_learnt"), F.filter(spans, lambda s: s["is_text"])).otherwise(F.array().cast("array<struct<is_text:boolean,offset:int,length:int>>"))
    line = F.struct("_turn", "_role", F.concat("_head", content, F.lit(TURN_END)).alias("s"), learnt.alias("loss"), F.col("_attached").alias("attached"))
    told = seen.select("_key", line.alias("_line")).groupBy("_key").agg(F.sort_array(F.collect_list("_line")).alias("_lines"))
    starts_of = sums_before(F.transform("_lines", lambda x: F.length(x["s"])))
    loss = once(
        starts_of,
        lambda at: F.flatten(
            F.transform(
                "_lines",
                lambda x, i: F.transform(x["loss"], lambda s: F.struct(i.alias("turn"), s["offset"].alias("offset"), (F.element_at(at, i + 1) + s["offset"]).alias("at"), s["length"].alias("length"))),
            )
        ),
    )
    attachments = F.flatten(
        F.transform("_lines", lambda x, i: F.transform(x["attached"], lambda a: F.struct(i.alias("turn"), a["part"].alias("part"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens"))))
    )
    out = told.select(
        F.col("_key").alias(key), F.size("_lines").cast("bigint").alias("n_turns"), F.array_join(F.transform("_lines", lambda x: x["s"]), "").alias("formatted"),
        loss.alias("loss"), attachments.alias("attachments"),
    )
    total = F.aggregate("attachments", F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x["tokens"], F.lit(0)))
    return out.withColumn("attachment_tokens", total)


def _turn_strings(formatted: Column) -> Column:
    """The strings of the turns, without their ends; after the last there is nothing."""
    return F.filter(F.split(formatted, TURN_END), lambda s, i: s != "")


def turns(formatted: Column) -> Column:
    """Read back: array of (role, parts), parts being (kind, text); a turn's first part is left out where it is an empty text
    before another."""

    def parts_of(content: Column) -> Column:
        marks = F.concat(F.array(F.lit("text")), F.regexp_extract_all(content, F.lit(rf"{PART}(\w*)>"), 1))
        return F.arrays_zip(marks.alias("kind"), F.transform(F.split(content, rf"{PART}\w*>"), unescaped).alias("text"))

    def turn(s: Column) -> Column:
        name, made = F.regexp_extract(s, rf"(?s)^{TURN}([^>]*)>", 1), parts_of(F.regexp_extract(s, rf"(?s)^{TURN}[^>]*>(.*)$", 1))
        kept = once(made, lambda m: F.filter(m, lambda p, i: (i > 0) | (p["text"] != "") | (F.size(m) == 1)))
        return F.struct(_role_out(name).alias("role"), kept.alias("parts"))

    return F.transform(_turn_strings(formatted), turn)


def texts(formatted: Column) -> Column:
    """Read back: array of (role, text) of conversations whose turns are of one text each."""

    def turn(s: Column) -> Column:
        end = F.locate(">", s)
        return F.struct(_role_out(F.substring(s, F.lit(len(TURN) + 1), end - len(TURN) - 1)).alias("role"), unescaped(F.substring(s, end + 1, F.length(s))).alias("text"))

    return F.transform(_turn_strings(formatted), turn)


def under_loss(formatted: Column, loss: Column) -> Column:
    """Read back: the texts under the loss mask, in order, unescaped. They are found by turn and offset, so that a long
    conversation isn't walked through from its start for each."""
    return once(_turn_strings(formatted), lambda s: F.transform(loss, lambda x: unescaped(F.substring(F.element_at(s, x["turn"] + 1), x["offset"] + 1, x["length"]))))
