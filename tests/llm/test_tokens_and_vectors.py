"""Byte-pair coding, alignment of tokenizers and hard negatives, held against plain Python."""

import hashlib
import itertools
import random

import pytest

from granary.llm import byte_bpe

ODD = ["'s", "'S", "'re", "'ll", "'l", "'ve'd", "'", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\xa0", "　", "\x1c", "\x85", "​", "a", "bc", "é", "ß", "12", "²", "½", "!", "..", "<|endoftext|>", "</s>", "<s>", "😀", "日本", "́", "▁", "s", "t", "re", "\x00", "“", "” ", "ﬁ", "<0x41>"]
SCHEMA = "doc_id long, text string, n_tokens string"


def odd_texts(n, seed=1):
    rng = random.Random(seed)
    return [None, "", " ", "\n", "'s", *ODD, "x" * 70_000, " " * 5000, "a\n" * 9000, *("".join(rng.choice(ODD) for _ in range(rng.randrange(1, 20))) for _ in range(n))]


def docs_of(spark, texts):
    return spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], SCHEMA)


# --- byte-level BPE ---


@pytest.fixture(scope="module")
def bpe():
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.token_bytes(byte_bpe.default_ranks()), special_tokens={})


def test_byte_bpe_against_the_library(spark, bpe, tmp_path, monkeypatch):
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    path = str(tmp_path / "docs")
    texts = odd_texts(2000)
    docs_of(spark, texts).select("doc_id", "text").unionByName(real.select(real.doc_id + 1_000_000, "text").toDF("doc_id", "text")).write.parquet(path)
    docs = spark.read.parquet(path)
    want = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for size in (byte_bpe.SLICE, 3000):  # many slices, too
        monkeypatch.setattr(byte_bpe, "SLICE", size)
        got = byte_bpe.decode(byte_bpe.encode(docs)).collect()
        assert len(got) == len(want)
        for r in got:
            assert r["ids"] == bpe.encode_ordinary(want[r["doc_id"]]) and r["n_tokens"] == len(r["ids"])
            assert bytes(r["decoded"]) == want[r["doc_id"]].encode()


def test_byte_bpe_other_patterns_repeats_and_empty(spark, bpe):
    import tiktoken

    pattern = r"\p{N}{1,3}|[^\p{N}]+?(?=\p{N}|$)|\s+"
    other = tiktoken.Encoding("other", pat_str=pattern, mergeable_ranks=byte_bpe.token_bytes(byte_bpe.default_ranks()), special_tokens={})
    df = spark.createDataFrame([(None, "a 1234", "x"), (None, "a 1234", "y"), (3, None, "z"), (3, "b", "z")], SCHEMA)
    got = sorted((r["doc_id"] or 0, r["ids"]) for r in byte_bpe.encode(df, pattern=pattern).collect())
    assert got == sorted([(0, other.encode_ordinary("a 1234"))] * 2 + [(3, []), (3, other.encode_ordinary("b"))])
    assert byte_bpe.digest(byte_bpe.encode(df)).where("doc_id = 3 and n_tokens = 0").first()["ids_sha256"] == hashlib.sha256(b"").hexdigest()
    assert not byte_bpe.digest(byte_bpe.encode(df.limit(0))).collect()


def test_byte_bpe_refuses_changed_input_and_unknown_ids(spark):
    from pyspark.sql import functions as F

    with pytest.raises(Exception, match="other rows|complete"):
        changing = spark.range(4).select(F.col("id").alias("doc_id"), F.expr("uuid()").alias("text"))
        byte_bpe.encode(changing.withColumn("text", F.udf(lambda x: str(random.random()))("text").alias("text"))).collect()
    with pytest.raises(Exception, match="vocabulary"):
        byte_bpe.decode(spark.createDataFrame([(1, [70_000])], "doc_id long, ids array<int>")).collect()


def test_token_table(spark):
    assert byte_bpe.token_table(spark).where("token = ' the'").count() == 1


# --- hard negatives ---

VECTORS = "vec_id long, embedding array<float>, label int, score string"


def brute_negatives(rows, positives=5, negatives=3):
    import math

    clean = [(v, l, [math.floor(256 * x) for x in e]) for v, e, l, *_ in rows if None not in (v, e, l) and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for i, (a, la, x) in enumerate(clean):
        if a % 50:
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, y)), v, lb == la) for j, (v, lb, y) in enumerate(clean) if j != i)
        for score, p, _ in [s for s in scored if s[2]][:positives]:
            window = [(v, -s) for s, v, same in scored if not same and 50 * -score <= 100 * -s <= 95 * -score][:negatives]
            out += [(a, p, k + 1, v, -score, s) for k, (v, s) in enumerate(window)]
    return sorted(out)


def mined(df):
    from granary.llm import hard_negatives

    v = hard_negatives.usable(df)
    return sorted(tuple(r) for r in hard_negatives.mine(v, v.where("vec_id % 50 = 0")).collect())


@pytest.mark.parametrize("cells", [(1 << 13, 1 << 11, 1 << 10), (40, 3, 20)])
def test_hard_negatives_against_brute_force(spark, monkeypatch, cells):
    from granary.llm import hard_negatives

    for name, n in zip(("CELL_ROWS", "CELL_ANCHORS", "LEAST_ROWS"), cells):
        monkeypatch.setattr(hard_negatives, name, n)
    monkeypatch.setattr(hard_negatives, "SCORES_AT_ONCE", 256)
    rng = random.Random(4)
    vector = lambda: [rng.choice([-0.5, -0.004, 0.0, 0.25, 0.5, 1.0]) for _ in range(4)]  # noqa: E731  many ties
    rows = [(k * 5, vector(), rng.randrange(4) if k % 9 else 7 + k, "x") for k in range(-60, 240)]
    rows += [(50, vector(), 1, "x"), (50, [0.5] * 4, 1, "x"), (50, [0.5] * 4, 1, "x"), (7, [0.5] * 3, 2, "x"), (100, [0.0] * 4, 3, "x")]
    rows += [(None, [1.0] * 4, 1, "x"), (150, None, 1, "x"), (200, [1.0, None], 1, "x"), (250, [float("nan")], 1, "x"), (300, [float("inf")] * 4, 1, "x"), (350, [1.0] * 4, None, "x"), (400, [], 2, "x")]
    df = spark.createDataFrame(rows, VECTORS)
    want = brute_negatives(rows)
    assert len(want) > 200 and mined(df) == want
    assert mined(df.limit(0)) == []


def test_hard_negatives_large_values_and_hot_vector(spark):
    rows = [(k, [1.0, 0.0] if k % 3 else [0.0, 0.9], k % 2, "x") for k in range(400)] + [(1000 + k, [2.0**20, -(2.0**20) + k], k % 2, "x") for k in range(6)]
    assert mined(spark.createDataFrame(rows, VECTORS)) == brute_negatives(rows)


# --- alignment of two tokenizers ---


def brute_alignment(texts):
    """Whole texts through both libraries; a row per text."""
    import collections

    import sentencepiece
    from tokenizers import Tokenizer

    from granary.llm import token_alignment

    path_a, path_b = token_alignment.default_tokenizers()
    a = Tokenizer.from_file(path_a)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=path_b)
    shown = {c: i for i, c in enumerate([*range(33, 127), *range(161, 173), *range(174, 256)])}
    plain = {chr(c): c for c in shown} | {chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in shown)}
    of_a = {k: bytes(plain[c] for c in t) for t, k in a.get_vocab().items() if all(c in plain for c in t)}
    of_b = [bytes([int(p[3:5], 16)]) if b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(map(b.id_to_piece, range(b.get_piece_size())))]
    rows, counts = [], collections.Counter()
    for text in texts:
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        if not text or not (b"".join(of_a[i] for i in ids_a) == b"".join(of_b[i] for i in ids_b) == (" " + text).encode()):
            rows.append((0, 0, [], ""))
            continue
        end_a, end_b = (list(itertools.accumulate(len(of[i]) for i in ids)) for ids, of in ((ids_a, of_a), (ids_b, of_b)))
        both = sorted(set(end_a) & set(end_b))
        last_a, last_b = dict(zip(end_a, ids_a)), dict(zip(end_b, ids_b))
        links = [(last_a[e], last_b[e]) for e in both]
        groups, i, j = [], 0, 0
        for e in both:
            x = y = ""
            while i < len(ids_a) and end_a[i] <= e:
                x, i = f"{x},{ids_a[i]}", i + 1
            while j < len(ids_b) and end_b[j] <= e:
                y, j = f"{y},{ids_b[j]}", j + 1
            groups.append(f"{x[1:]}|{y[1:]}")
        counts.update(links)
        rows.append((len(ids_a), len(ids_b), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    top = collections.Counter()
    for (_, y), n in counts.items():
        top[y] = max(top[y], n)
    return [(x, y, len(z), len(z), sum(counts[k] == top[k[1]] for k in z), sum(counts[k] for k in z), h) for x, y, z, h in rows]


def test_alignment_against_whole_texts(spark, monkeypatch):
    from granary.llm import token_alignment

    real = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    texts = odd_texts(1500, 3) + real + [f"a{chr(c)} b{chr(c)}\nc" for c in (0x85, 0xA0, 0x1680, 0x180E, 0x200B, 0x2003, 0x2028, 0x3000, 0xFEFF, 0x1C, 0x7F)] * 2
    want = brute_alignment([t or "" for t in texts])
    for size, memory in ((token_alignment.SLICE, token_alignment.REMEMBERED), (5000, 2000)):
        monkeypatch.setattr(token_alignment, "SLICE", size)
        monkeypatch.setattr(token_alignment, "REMEMBERED", memory)
        got = {r["doc_id"]: tuple(r)[1:] for r in token_alignment.align(docs_of(spark, texts)).collect()}
        assert len(got) == len(texts)
        for k, row in enumerate(want):
            assert got[k] == row, texts[k]


def test_alignment_repeats_nulls_and_empty(spark):
    from granary.llm import token_alignment

    df = spark.createDataFrame([(None, "a b", "x"), (None, "a b", "x"), (3, None, "x")], SCHEMA)
    got = [tuple(r)[1:] for r in token_alignment.align(df).orderBy(*["doc_id"]).collect()]
    assert got[0] == got[1] == brute_alignment(["a b", "a b"])[0] and got[2] == (0,) * 6 + ("",)
    assert not token_alignment.align(df.limit(0)).collect()
    only_void = token_alignment.align(spark.createDataFrame([(1, "", "x"), (2, "ﬁ▁", "x")], SCHEMA)).collect()
    assert [r["n_a"] for r in only_void] == [0, 0]
