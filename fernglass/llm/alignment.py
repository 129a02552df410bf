"""Cross-tokenizer alignment by a dangling-suffix transducer.

Two tokenizers cut the same bytes. Read side by side, at any point one side leads the other by a residual: the bytes of
its last token that the other hasn't reached. The side that doesn't lead reads its next token; that shortens the residual,
or empties it, or hands the lead over. Residuals are suffixes of tokens, so there are not many, and a step depends on
the residual and the next token alone: steps are remembered. Where the residual is empty, both sides end together, and a
group closes.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept_table, small_batches

#: Where the vocabularies lie.
FOLDER = "/opt/tokenizers"
BYTE_LEVEL, PIECES = f"{FOLDER}/byte_bpe_50k.json", f"{FOLDER}/piece_bpe_32k.model"
#: Words that a Python worker remembers at most, twice, and steps of the transducer.
MOST_WORDS, MOST_STEPS = 250_000, 1_000_000
_SHIFT = 1 << 32
# --- fixed value: how byte-level tokenizers split a text before they merge ------------------------------------------
SPLITS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# --------------------------------------------------------------------------------------------------------------------


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others from
    U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def byte_level_bytes(spec: dict) -> dict[int, bytes]:
    """The bytes of each id of a byte-level vocabulary, special tokens aside."""
    known = byte_alphabet()
    special = {t["id"] for t in spec.get("added_tokens", []) if t.get("special")}
    return {i: bytes(known[c] for c in t) for t, i in spec["model"]["vocab"].items() if i not in special}


def piece_bytes(pieces: list[str]) -> list[bytes]:
    """The bytes of each piece: U+2581 is a space, <0xHH> a byte."""
    hexed = {f"<0x{b:02X}>": bytes([b]) for b in range(256)}
    return [hexed.get(p) or p.replace("▁", " ").encode() for p in pieces]


class Transducer:
    """Steps between states; a state is the side that leads (0 or 1) and its residual, state 0 the empty residual."""

    def __init__(self, a: dict[int, bytes], b: list[bytes]) -> None:
        self.sides = a, b
        self.forget()

    def forget(self) -> None:
        self.states, self.number, self.steps = [(0, b"")], {(0, b""): 0}, {}

    def step(self, state: int, token: int) -> int:
        """The state after the side that doesn't lead (the first, if none does) has read its next token."""
        lead, rest = self.states[state]
        side = 1 - lead if rest else 0
        read = self.sides[side][token]
        if not rest or len(read) > len(rest):
            if not read.startswith(rest):
                raise ValueError("the tokens differ in their bytes")
            to = side, read[len(rest) :]
        else:
            if not rest.startswith(read):
                raise ValueError("the tokens differ in their bytes")
            to = (lead, rest[len(read) :]) if len(read) < len(rest) else (0, b"")
        if to not in self.number:
            self.number[to] = len(self.states)
            self.states.append(to)
        return self.number[to]

    def groups(self, a: list[int], b: list[int]) -> list[tuple[list[int], list[int]]]:
        """The ids of each group, of both sides. The tokens have the same bytes on both sides, and no token is empty."""
        if len(self.steps) > MOST_STEPS:
            self.forget()
        out, state, i, j, steps, states = [], 0, 0, 0, self.steps, self.states
        from_a = from_b = 0
        while i < len(a) or j < len(b):
            if state and states[state][0] == 0:
                token, j = b[j], j + 1
            else:
                token, i = a[i], i + 1
            at = state * _SHIFT + token
            state = steps.get(at, -1)
            if state < 0:
                state = steps[at] = self.step(at // _SHIFT, token)
            if state == 0:
                out.append((a[from_a:i], b[from_b:j]))
                from_a, from_b = i, j
        return out


def group_text(groups: list[tuple[list[int], list[int]]]) -> str:
    """a1,a2|b1;a3|b2,b3"""
    return ";".join([f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups])


#: n_a, n_b, groups as text, links as bytes: the last ids of each group as a 64-bit number. No token is empty, so these are all
#: pairs that end together.
Described = tuple[int, int, str, bytes]


def _described(groups: list[tuple[list[int], list[int]]]) -> Described:
    links = np.array([x[-1] * _SHIFT + y[-1] for x, y in groups], np.int64)
    return sum([len(x) for x, _ in groups]), sum([len(y) for _, y in groups]), group_text(groups), links.tobytes()


class Aligner:
    """Both tokenizers and the transducer over their tokens.

    Where a single space stands between two characters that aren't white space, neither tokenizer has a token across its left
    side: the byte-level one splits there before it merges, and no piece has its space after another character (looked up in
    the vocabulary; if one has, texts are taken whole). So both end there, the residual is empty, and what lies between two
    such places, a word, can be remembered with its groups.
    """

    def __init__(self, byte_level: bytes, pieces: bytes) -> None:
        import sentencepiece

        spec = json.loads(byte_level)
        self.encode_a = _by_ranks(spec) or _by_merges(byte_level.decode())
        self.b = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        names = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.a_bytes, self.b_bytes = byte_level_bytes(spec), piece_bytes(names)
        self.by_words = not any("▁" in p.lstrip("▁") for p in names)
        self.transducer = Transducer(self.a_bytes, self.b_bytes)
        self.words: dict[str, Described | None] = {}
        self.older: dict[str, Described | None] = {}

    def encode(self, text: str) -> tuple[list[int], list[int]]:
        """The ids of both tokenizers, without special tokens; the first gets a space before the text, the second adds it."""
        return self.encode_a(f" {text}"), self.b.encode(text)

    def groups(self, text: str) -> list[tuple[list[int], list[int]]] | None:
        """The groups of a text; None if a tokenizer changes its bytes."""
        a, b = self.encode(text)
        whole = f" {text}".encode()
        if b"".join(map(self.a_bytes.__getitem__, a)) != whole or b"".join(map(self.b_bytes.__getitem__, b)) != whole:
            return None
        return self.transducer.groups(a, b)

    def described(self, text: str) -> Described | None:
        groups = self.groups(text)
        return None if groups is None else _described(groups)

    def learn(self, words: list[str]) -> None:
        """Makes words known that neither begin nor end with white space: together, as one text. If a word among them changes
        its bytes, in two halves."""
        groups = self.groups(" ".join(words))
        if groups is None:
            if len(words) == 1:
                self.words[words[0]] = None
            else:
                self.learn(words[: len(words) // 2])
                self.learn(words[len(words) // 2 :])
            return
        sizes = np.array([sum([len(self.b_bytes[i]) for i in y]) for _, y in groups])
        ends = np.searchsorted(np.cumsum(sizes), np.cumsum([len(w.encode()) + 1 for w in words])).tolist()
        at = 0
        for w, end in zip(words, ends, strict=True):
            self.words[w] = _described(groups[at : end + 1])
            at = end + 1

    def look_up(self, words: set[str]) -> None:
        """Makes the words known. Remembers the latest MOST_WORDS and more, and as many before them."""
        if len(self.words) > MOST_WORDS:
            self.older, self.words = self.words, {}
        new = []
        for w in words - self.words.keys():
            if w in self.older:
                self.words[w] = self.older[w]
            elif plain(w):
                new.append(w)
            else:
                self.words[w] = self.described(w)
        for i in range(0, len(new), 4096):
            self.learn(new[i : i + 4096])

    def align(self, texts: list[str]) -> Iterator[Described | None]:
        """What described() says of each text; None for an empty one."""
        parts = [split(t) if self.by_words else [] for t in texts]
        self.look_up(set(chain.from_iterable(parts)))
        for text, own in zip(texts, parts, strict=True):
            found = [self.words[w] for w in own]
            if not text:
                yield None
            elif not own or None in found:
                # bytes differ somewhere, or texts are taken whole
                yield self.described(text)
            else:
                a, b, groups, links = zip(*found, strict=True)
                yield sum(a), sum(b), ";".join(groups), b"".join(links)


def _by_ranks(spec: dict) -> Callable[[str], list[int]] | None:
    """The byte-level tokenizer of a JSON file by the ranks of its tokens, which is several times faster than by its merges.
    None unless the file splits words as usual and its merges make the tokens in the order of their ids."""
    import tiktoken

    model, splits = spec["model"], spec.get("pre_tokenizer") or {}
    merges = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    if splits.get("type") != "ByteLevel" or splits.get("add_prefix_space") or not splits.get("use_regex", True) or spec.get("normalizer"):
        return None
    if [model["vocab"].get(m) for m in merges] != list(range(256, 256 + len(merges))):
        return None
    ranks = {t: i for i, t in byte_level_bytes(spec).items()}
    return tiktoken.Encoding("aligned", pat_str=SPLITS, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def _by_merges(model: str) -> Callable[[str], list[int]]:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    made = Tokenizer.from_str(model)
    made.encode_special_tokens = True
    return lambda text: made.encode(text, add_special_tokens=False).ids


def plain(word: str) -> bool:
    """Whether the word is neither empty nor begins or ends with white space."""
    return word != "" and not word[0].isspace() and not word[-1].isspace()


#: A space with white space, or an end of the text, beside it.
_UNEVEN = re.compile(r"  |^ | $| [^\S ]|[^\S ] ")


def split(text: str) -> list[str]:
    """The text cut at single spaces between characters that aren't white space."""
    words = text.split(" ")
    if not _UNEVEN.search(text):
        return words
    out, held = [], [words[0]]
    for w in words[1:]:
        last = held[-1]
        if w and last and not w[0].isspace() and not last[-1].isspace():
            out.append(" ".join(held))
            held = []
        held.append(w)
    return [*out, " ".join(held)]


_MADE: dict[int, Aligner] = {}


def _aligner(files: Broadcast) -> Aligner:
    """The process's own aligner of these files."""
    byte_level, pieces = files.value
    at = hash((byte_level, pieces))
    if at not in _MADE:
        _MADE[at] = Aligner(byte_level, pieces)
    return _MADE[at]


def read_file(spark: SparkSession, path: str) -> bytes:
    """A vocabulary file from any store that Spark reads."""
    return bytes(spark.read.format("binaryFile").load(path if "://" in path else f"file://{path}").first()["content"])


def align(docs: DataFrame, key: str = "doc_id", text: str = "text", byte_level: str = BYTE_LEVEL, pieces: str = PIECES) -> DataFrame:
    """How the tokens of two tokenizers lie over each whole text, led by a space.

    byte_level: a byte-level vocabulary in JSON (A); pieces: a sentencepiece model (B); each task gets both with the
    plan. Returns key, row (a number of the row's own), n_a, n_b, n_groups, groups (`a1,a2|b1;a3|b2,b3`: the ids between two
    places where both end, as text) and links: (a, b, n) the pairs of ids that end together, and how often they do. Special
    tokens aren't added, and their names in a text are plain text. A text that is null or empty, or whose bytes a
    tokenizer changes, has no tokens: zeros, '' and no links. Other columns aren't read; keys may be null or repeated. An
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    files = spark.sparkContext.broadcast((read_file(spark, byte_level), read_file(spark, pieces)))  # of fixed size
    plain = small_batches(docs).select(F.col(key).alias(key), F.col(text).cast("string").alias("_text")).withColumn("_row", F.monotonically_increasing_id())

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(files)
        for batch in batches:
            numbers, groups, codes, times, ends = [], [], [], [], [0]
            for x in aligner.align([t or "" for t in batch.column(1).to_pylist()]):
                n_a, n_b, said, links = x or (0, 0, "", b"")
                numbers.append((n_a, n_b, len(links) // 8))
                groups.append(said)
                code, n = np.unique(np.frombuffer(links, np.int64), return_counts=True)
                codes.append(code)
                times.append(n)
                ends.append(ends[-1] + len(code))
            code, n = np.concatenate(codes), np.concatenate(times)
            pairs = pa.StructArray.from_arrays([pa.array(code // _SHIFT, pa.int32()), pa.array(code % _SHIFT, pa.int32()), pa.array(n, pa.int32())], ["a", "b", "n"])
            counts = np.array(numbers, np.int64)
            columns = [batch.column(0), batch.column(2), *[pa.array(counts[:, i]) for i in range(3)], pa.array(groups, pa.string()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)]
            yield pa.RecordBatch.from_arrays(columns, ["_key", "row", "n_a", "n_b", "n_groups", "groups", "links"])

    kind = plain.schema[key].dataType.simpleString()
    out = plain.mapInArrow(found, f"_key {kind}, row bigint, n_a bigint, n_b bigint, n_groups bigint, groups string, links array<struct<a:int,b:int,n:int>>")
    return out.select(F.col("_key").alias(key), *out.columns[1:])


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(a, b, count, best): how often each pair of ids ends together in all texts, and whether no pair of that b does more often.
    Of two tokens that end together one is a suffix of the other, so there are no more pairs than that (see pair_bound),
    however many texts."""
    each = aligned.select(F.explode("links").alias("x")).groupBy("x.a", "x.b").agg(F.sum("x.n").alias("count"))
    most = each.groupBy(F.col("b").alias("_b")).agg(F.max("count").alias("_most"))
    return each.join(most, F.col("b") == F.col("_b")).select("a", "b", "count", (F.col("count") == F.col("_most")).alias("best"))


def pair_bound(spark: SparkSession, byte_level: str = BYTE_LEVEL, pieces: str = PIECES) -> int:
    """The number of pairs of ids of which one's bytes end with the other's: the most rows that pair_counts can have."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_proto=read_file(spark, pieces))
    a = list(byte_level_bytes(json.loads(read_file(spark, byte_level))).values())
    b = piece_bytes([model.id_to_piece(i) for i in range(model.vocab_size())])
    held = ({}, {})
    for table, tokens in zip(held, (a, b), strict=True):
        for t in tokens:
            table[t] = table.get(t, 0) + 1
    ends = lambda tokens, table, own: sum(table.get(t[i:], 0) for t in tokens for i in range(0 if own else 1, len(t)))
    return ends(a, held[1], True) + ends(b, held[0], False)


#: Rows of pair counts (24 bytes each) that are sent to all tasks at most.
MOST_SENT = 2_000_000


def scored(aligned: DataFrame, bound: int) -> DataFrame:
    """The rows with n_best (links whose pair is the most frequent of its b over all texts) and count_sum (the counts of
    all its links, added up), without links. aligned should be a table, as it is read three times. bound: see pair_bound; up to
    MOST_SENT pairs are sent to all tasks, so that links aren't shuffled."""
    counts = pair_counts(aligned).withColumnsRenamed({"a": "_a", "b": "_b"})
    each = aligned.select("row", F.explode("links").alias("x")).join(F.broadcast(counts) if bound <= MOST_SENT else counts, (F.col("x.a") == F.col("_a")) & (F.col("x.b") == F.col("_b")))
    sums = each.groupBy(F.col("row").alias("_row")).agg(F.sum(F.when(F.col("best"), F.col("x.n")).otherwise(0)).alias("n_best"), F.sum(F.col("x.n") * F.col("count")).alias("count_sum"))
    out = aligned.drop("links").join(sums, F.col("row") == F.col("_row"), "left").drop("_row")
    return out.withColumns({c: F.coalesce(c, F.lit(0)).cast("bigint") for c in ("n_best", "count_sum")})


def align_corpus(docs: DataFrame, key: str = "doc_id", text: str = "text", byte_level: str = BYTE_LEVEL, pieces: str = PIECES) -> DataFrame:
    """align() with the counts of the whole corpus: key, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 (of
    groups; '' without tokens). Texts are tokenised once; what is kept of them are the numbers and the links."""
    found = align(docs, key, text, byte_level, pieces)
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    table = kept_table(found.select(F.col(key).alias("_key"), "row", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), digest.alias("groups_sha256"), "links"))
    out = scored(table, pair_bound(docs.sparkSession, byte_level, pieces))
    return out.select(F.col("_key").alias(key), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
