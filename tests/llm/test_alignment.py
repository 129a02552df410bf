import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fernglass.llm import alignment, queries

pytest.importorskip("sentencepiece")
LETTERS = " \t\n 　ab'sXé漢😀́▁.,<s>1\x1c​\x00"
TEXTS = ["", "hello world", "  two  spaces ", "it's 12,000 <|endoftext|> </s> <s>", "日本語 text\nnew line\r\n\ttab", "▁ is a space to one of them", "é" * 300, "a" * 5_000, "\x00", " ", " ", "end. The the the, then!"]


@pytest.fixture(scope="module")
def tools():
    """Both tokenizers by their own libraries, and the bytes of their tokens."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(alignment.BYTE_LEVEL), sentencepiece.SentencePieceProcessor(model_file=alignment.PIECES)
    a.encode_special_tokens = True
    from tokenizers.pre_tokenizers import ByteLevel

    shown = [a.id_to_token(i) for i in range(a.get_vocab_size())]
    # the character of each byte, as the library itself writes it
    known = {}
    for code in range(0x800):
        if code < 0xD800:
            said = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(chr(code))[0][0]
            known |= dict(zip(said, chr(code).encode(), strict=True))
    for code in range(0x800, 0x110000, 0x400):
        if not 0xD800 <= code < 0xE000:
            said = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(chr(code))[0][0]
            known |= dict(zip(said, chr(code).encode(), strict=True))
    a_bytes = {i: bytes(known[c] for c in t) for i, t in enumerate(shown) if t != "<|endoftext|>" and all(c in known for c in t)}
    b_bytes = {}
    for i in range(b.vocab_size()):
        p = b.id_to_piece(i)
        b_bytes[i] = bytes.fromhex(p[3:5]) if b.is_byte(i) else p.replace("▁", " ").encode()
    return a, b, a_bytes, b_bytes


def plain_alignment(tools, text):
    """(a ids, b ids, groups as text, linked pairs), from the sets of byte offsets where tokens end."""
    a, b, a_bytes, b_bytes = tools
    if not text:
        return [], [], "", []
    x, y = a.encode(f" {text}", add_special_tokens=False).ids, b.encode(text)
    if b"".join(a_bytes[i] for i in x) != f" {text}".encode() or b"".join(b_bytes[i] for i in y) != f" {text}".encode():
        return [], [], "", []

    def ends(ids, table):
        at, out = 0, []
        for i in ids:
            at += len(table[i])
            out.append(at)
        return out

    ex, ey = ends(x, a_bytes), ends(y, b_bytes)
    groups, i, j = [], 0, 0
    for e in sorted(set(ex) & set(ey)):
        k, m = ex.index(e) + 1, ey.index(e) + 1
        groups.append(f"{','.join(map(str, x[i:k]))}|{','.join(map(str, y[j:m]))}")
        i, j = k, m
    pairs = [(p, q) for p, s in zip(x, ex, strict=True) for q, t in zip(y, ey, strict=True) if s == t] if len(x) < 3_000 else None
    return x, y, ";".join(groups), pairs


def test_bytes(tools):
    _, _, a_bytes, b_bytes = tools
    made = alignment.Aligner(open(alignment.BYTE_LEVEL, "rb").read(), open(alignment.PIECES, "rb").read())
    assert made.by_words and all(made.a_bytes[i] == t for i, t in a_bytes.items()) and len(a_bytes) == 50_256 - 13  # bytes that no text has
    assert all(made.b_bytes[i] == t for i, t in b_bytes.items()) and min(map(len, made.b_bytes)) > 0


def test_transducer():
    t = alignment.Transducer({0: b"ab", 1: b"c", 2: b"abcd"}, [b"a", b"bc", b"bcd", b"abc", b"d"])
    assert t.groups([0, 1], [0, 1]) == [([0, 1], [0, 1])]
    assert t.groups([2, 0, 1], [0, 2, 3]) == [([2], [0, 2]), ([0, 1], [3])]
    assert t.groups([], []) == [] and t.groups([2], [3, 4]) == [([2], [3, 4])]
    known = len(t.steps)
    t.groups([2, 0, 1], [0, 2, 3])
    assert len(t.steps) == known  # remembered
    with pytest.raises(ValueError):
        t.groups([1], [0])


def test_split():
    random_ = random.Random(1)
    for _ in range(2_000):
        text = "".join(random_.choice(LETTERS) for _ in range(random_.randint(1, 12)))
        parts = alignment.split(text)
        assert " ".join(parts) == text
        cuts = [i for i, c in enumerate(text) if c == " " and 0 < i < len(text) - 1 and not text[i - 1].isspace() and not text[i + 1].isspace()]
        assert len(parts) == len(cuts) + 1


def test_words_against_whole_texts(tools, monkeypatch):
    """Word by word, remembered and forgotten, or the whole text: the same as the libraries say of the whole text."""
    monkeypatch.setattr(alignment, "MOST_WORDS", 200)
    monkeypatch.setattr(alignment, "MOST_STEPS", 300)
    random_ = random.Random(2)
    texts = TEXTS + ["".join(random_.choice(LETTERS) for _ in range(random_.randint(0, 30))) for _ in range(1_500)]
    made = alignment.Aligner(open(alignment.BYTE_LEVEL, "rb").read(), open(alignment.PIECES, "rb").read())
    for by_words in (True, False):
        made.by_words = by_words
        for i in range(0, len(texts), 100):
            for text, got in zip(texts[i : i + 100], made.align(texts[i : i + 100]), strict=True):
                x, y, groups, _ = plain_alignment(tools, text)
                n_a, n_b, said, _ = got or (0, 0, "", b"")
                assert (n_a, n_b, said) == (len(x), len(y), groups), text
    # by merges, as the file has them, instead of ranks
    made.encode_a = alignment._by_merges(open(alignment.BYTE_LEVEL).read())
    assert all((g or (0, 0, ""))[2] == plain_alignment(tools, t)[2] for t, g in zip(TEXTS, made.align(TEXTS), strict=True))


def expected(tools, rows):
    """The query's rows by plain Python."""
    made = [(k, *plain_alignment(tools, t)) for k, t in rows]
    counts = Counter(p for *_, pairs in made for p in pairs)
    most = {}
    for (_, q), n in counts.items():
        most[q] = max(n, most.get(q, 0))
    out = Counter()
    for k, x, y, groups, pairs in made:
        digest = hashlib.sha256(groups.encode()).hexdigest() if groups else ""
        out[(k, len(x), len(y), len(groups.split(";")) if groups else 0, len(pairs), sum(counts[p] == most[p[1]] for p in pairs), sum(counts[p] for p in pairs), digest)] += 1
    return out


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_query_against_plain_python(spark, tools, tmp_path):
    random_ = random.Random(3)
    words = ["the", "then", "there,", "naïve", "x1", "(a)", "don't", "日本", "\n", "zq"]
    rows = [(i, t) for i, t in enumerate(t for t in TEXTS if len(t) < 3_000)] + [(100 + i, " ".join(random_.choice(words) for _ in range(random_.randint(1, 60)))) for i in range(150)]
    rows += [(300, None), (None, "the end"), (5, "again"), (5, "again")]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit(1)).withColumn("links", F.lit("x")).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op11_token_alignment(spark, str(tmp_path))
    assert Counter(tuple(r[c] for c in COLUMNS) for r in got.collect()) == expected(tools, rows)
    assert {t for c, t in got.dtypes if c != "groups_sha256"} == {"bigint"}


def test_pairs_are_suffixes(spark, tools, documents):
    """No more pairs than the vocabularies allow, so their table may be sent to all tasks."""
    _, _, a_bytes, b_bytes = tools
    aligned = alignment.align(documents([(i, t) for i, t in enumerate(TEXTS)]))
    pairs = alignment.pair_counts(aligned).collect()
    assert pairs and all(a_bytes[p.a].endswith(b_bytes[p.b]) or b_bytes[p.b].endswith(a_bytes[p.a]) for p in pairs)
    bound = alignment.pair_bound(spark)
    assert len(pairs) < bound < alignment.MOST_SENT
    table = aligned.checkpoint()
    # shuffled instead of sent: the same
    assert sorted(alignment.scored(table, bound).collect()) == sorted(alignment.scored(table, alignment.MOST_SENT + 1).collect())


def test_empty_table(spark, documents):
    assert alignment.align_corpus(documents([])).count() == 0
    keyed = spark.createDataFrame([("k", "a b")], "_key string, row string")
    assert alignment.align_corpus(keyed, "_key", "row").first()["n_groups"] == 2
