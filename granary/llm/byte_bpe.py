"""Byte-level BPE: each distinct word of the corpus coded once, and decoding by a table of token bytes.

Texts are cut into pre-tokens ("words") slice by slice, a slice being some
megabytes of whole texts. A slice sends each of its distinct words once, packed
by buckets of the words' hash, and keeps the positions as numbers of its words.
Buckets meet in one shuffle, where each distinct word of the corpus is coded
once; the ids go back to the slices in a second shuffle and are put at the
words' positions. However often a word occurs, a slice sends it once, so all
buckets get about equally much of every slice; a task holds the distinct words
of one bucket at a time. Decoding joins ids with the token-byte table, which the
vocabulary bounds: all workers have it and batches of ids gather their bytes.

The pattern's matches are found for a whole slice at once, from classes of code
points that tiktoken's own expressions give; other patterns than
``public_tokenizers.PATTERN`` run through the ``regex`` library, text by text.

To save a shuffle, ``docs`` is read twice, for words and for positions, and must
give the same rows again, as a scan of files does. A slice's digest is part of
its key, so an input that changes between the passes is an error.

Defined results: a null or empty text has no ids; rows with equal or null
doc_ids are rows of their own; an empty table gives no rows; bytes that are no
UTF-8 become U+FFFD; other columns play no part. Texts are never cut.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import U64, mix, shuffle_parts, slices, span_hashes

#: Text bytes of a slice.
SLICE = 4 << 20
APOSTROPHE = ord("'")
SPACE = ord(" ")
BLANK, LETTER, NUMBER, OTHER = range(4)
FULL = U64((1 << 64) - 1)


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@functools.lru_cache(2)
def token_bytes(path: str) -> dict[bytes, int]:
    """Ranks by token of a rank file."""
    import base64

    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def token_table(spark: SparkSession, ranks: str | None = None) -> DataFrame:
    """id, token (bytes): a row per entry of the vocabulary."""
    return spark.createDataFrame([(b, a) for a, b in token_bytes(ranks or default_ranks()).items()], "id int, token binary")


# --- words ----------------------------------------------------------------


@functools.lru_cache(1)
def code_point_classes() -> np.ndarray:
    """BLANK, LETTER, NUMBER or OTHER for each code point, as tiktoken's expressions see it."""
    import tiktoken

    single = {bytes([k]): k for k in range(256)}
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    classes = np.full(0x110000, OTHER, np.uint8)
    for kind, expression in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (BLANK, r"\s")):
        found = bytes(tiktoken.Encoding(expression, pat_str=expression, mergeable_ranks=single, special_tokens={}).encode_ordinary(every)).decode()
        classes[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = kind
    return classes


def code_points(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the joined texts, the first byte of each (one more entry at the end), and each text's first code point (likewise)."""
    strings = [t.decode("utf-8", "replace") for t in texts]
    points = np.frombuffer("".join(strings).encode("utf-32-le"), np.uint32)
    size = np.ones(len(points), np.int8)
    for more in (0x80, 0x800, 0x10000):
        size += points >= more
    at = np.zeros(len(points) + 1, np.int32)
    np.cumsum(size, out=at[1:])
    return points, at, np.append(0, np.cumsum(np.fromiter(map(len, strings), np.int64, len(strings))))


def word_starts(points: np.ndarray, text_first: np.ndarray) -> np.ndarray:
    """Where the words of joined texts start, by the public pattern; words leave no gaps.

    Runs of one class are words, but: the last blank before another run leaves
    the blank run, to lead that run if it is a space and to stand alone if not;
    an apostrophe that no space leads takes the letters of a contraction.
    """
    n = len(points)
    if not n:
        return np.empty(0, np.int64)
    kind = code_point_classes()[points]
    edge = np.zeros(n + 1, bool)  # starts of runs
    edge[text_first] = True
    text_edge = edge.copy()
    edge[1:-1] |= kind[1:] != kind[:-1]
    starts = edge[:-1].copy()
    run = np.flatnonzero(edge)  # one more entry at the end
    first, end = run[:-1], run[1:]
    led = (kind[first] == BLANK) & ~text_edge[end]  # blank runs before another run of their text
    last = end[led] - 1
    starts[last] = True
    starts[end[led][points[last] == SPACE]] = False
    quote = (points[first] == APOSTROPHE) & (end - first == 1) & ~text_edge[end]
    quote &= starts[first]
    at = first[quote]
    at = at[kind[at + 1] == LETTER]
    one = points[at + 1]
    two = points[np.minimum(at + 2, n - 1)]
    inside = (at + 2 < n) & ~edge[at + 2]  # a second letter of the same run
    single = np.isin(one, [ord(c) for c in "stmd"])
    double = inside & (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
    taken = np.where(single, 1, np.where(double, 2, 0))
    at, taken = at[taken > 0], taken[taken > 0]
    starts[at + 1] = False
    rest = at + 1 + taken
    rest = rest[rest < n]
    starts[rest[~edge[rest]]] = True
    return np.flatnonzero(starts)


def spans(texts: list[bytes], pattern: str) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Joined texts, first bytes and ends of all words, and each text's first word (one more entry at the end)."""
    if pattern == default_pattern():
        points, at, text_first = code_points(texts)
        found = word_starts(points, text_first)
        joined = points.tobytes().decode("utf-32-le").encode()
        starts, ends = at[found].astype(np.int64), at[np.append(found[1:], len(points))].astype(np.int64)
        return joined, starts, ends[: len(starts)], np.searchsorted(found, text_first)
    import regex

    parts, starts, ends, first, size = [], [], [], [0], 0
    for text in texts:
        text = text.decode("utf-8", "replace")
        for m in regex.finditer(pattern, text):
            if m[0]:
                word = m[0].encode()
                parts.append(word)
                starts.append(size)
                size += len(word)
                ends.append(size)
        first.append(len(starts))
    return b"".join(parts), np.array(starts, np.int64), np.array(ends, np.int64), np.array(first)


def distinct_spans(joined: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each span's content, a span of each content): contents are numbered in order of appearance.

    Contents are told by a 64-bit hash, their length and their first and last
    eight bytes; where equal hashes belong to different contents, all are told
    by their bytes.
    """
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    buf = np.frombuffer(joined, np.uint8)
    size = ends - starts
    number, distinct = pd.factorize(span_hashes(buf, starts, ends) + mix(size.astype(U64)))
    sample = np.empty(len(distinct), np.int64)
    sample[number[::-1]] = np.arange(len(number) - 1, -1, -1)
    words = np.ndarray(len(joined) + 1, "<u8", joined + bytes(8), strides=(1,))
    short = FULL >> (U64(8) * (U64(8) - np.minimum(size, 8).astype(U64)))
    head, tail = words[starts] & short, words[np.maximum(ends - 8, starts)] & short
    own = sample[number]
    if ((size != size[own]) | (head != head[own]) | (tail != tail[own])).any():
        number, distinct = pd.factorize(np.array([joined[a:b] for a, b in zip(starts.tolist(), ends.tolist())], object))
        sample = np.empty(len(distinct), np.int64)
        sample[number[::-1]] = np.arange(len(number) - 1, -1, -1)
    return number, sample


class Slice:
    """Some texts, their words and the words' numbers, most frequent first."""

    def __init__(self, key: int, doc_ids: pa.Array, texts: list[bytes], pattern: str):
        self.key, self.doc_ids = key, doc_ids
        self.joined, starts, ends, first = spans(texts, pattern)
        self.counts = np.diff(first)
        number, sample = distinct_spans(self.joined, starts, ends)
        order = np.argsort(-np.bincount(number, minlength=len(sample)), kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.numbers = rank[number]
        self.starts, self.ends = starts[sample][order], ends[sample][order]
        self.hashes = span_hashes_at(self.joined, self.starts, self.ends)
        self.digest = int((self.hashes * U64(3) + np.bincount(self.numbers, minlength=len(order)).astype(U64)).sum(dtype=U64).astype(np.int64)) ^ len(texts)

    def by_bucket(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Each word's bucket, and the words ordered by bucket."""
        bucket = (self.hashes % U64(buckets)).astype(np.int64)
        return bucket, np.argsort(bucket, kind="stable")


def span_hashes_at(joined: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of spans in any order."""
    order = np.argsort(starts)
    out = np.empty(len(starts), U64)
    out[order] = span_hashes(np.frombuffer(joined, np.uint8), starts[order], ends[order])
    return out


def _cut(batches, pattern: str) -> Iterator[Slice]:
    key = TaskContext.get().partitionId() << 32
    for batch in batches:
        for at, to, texts in slices(batch, "text", SLICE):
            yield Slice(key, batch.column("doc_id").slice(at, to - at), texts, pattern)
            key += 1


def gather(pool: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The entries of ``pool`` from ``at`` on, ``n`` of each, one after another."""
    until = np.cumsum(n)
    took = np.repeat(at - until + n, n)
    took += np.arange(len(took))
    return pool[took]


# --- encoding -------------------------------------------------------------

SENT = "slice long, digest long, bucket long, sizes binary, content binary"


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    """Rows of SENT: per slice and bucket the sizes of some byte strings and their joined bytes, compressed."""
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 5, kinds)], ["slice", "digest", "bucket", "sizes", "content"])


def words_of_slices(docs: DataFrame, pattern: str, buckets: int) -> DataFrame:
    """SENT: the distinct words of each slice by bucket."""

    def run(batches):
        pack = zstandard.ZstdCompressor(level=1)
        for s in _cut(batches, pattern):
            bucket, order = s.by_bucket(buckets)
            sizes = (s.ends - s.starts)[order]
            content = gather(np.frombuffer(s.joined, np.uint8), s.starts[order], sizes).tobytes()
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            at = np.append(0, np.cumsum(sizes))[cuts].tolist()
            cuts = cuts.tolist()
            sizes = sizes.astype("<u4")
            yield _packed([(s.key, s.digest, k, pack.compress(sizes[a:b].tobytes()), pack.compress(content[x:y])) for k, (a, b, x, y) in enumerate(zip(cuts, cuts[1:], at, at[1:])) if b > a])

    return docs.select("doc_id", "text").mapInArrow(run, SENT)


def positions(docs: DataFrame, pattern: str, buckets: int) -> DataFrame:
    """slice, digest, doc_ids, counts (words of each document), low and high (numbers of all words in order), places (of the numbers among the words by bucket)."""
    binary = ("low", "high", "places")

    def run(batches):
        pack = zstandard.ZstdCompressor(level=3)
        for s in _cut(batches, pattern):
            _, order = s.by_bucket(buckets)
            places = np.empty(len(order), "<u4")
            places[order] = np.arange(len(order))
            blobs = ((s.numbers & 0xFF).astype(np.uint8), (s.numbers >> 8).astype("<u4"), places)
            head = [pa.array([s.key], pa.int64()), pa.array([s.digest], pa.int64()), pa.array([s.doc_ids.to_pylist()], pa.list_(pa.int64())), pa.array([s.counts], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*head, *(pa.array([pack.compress(x.tobytes())], pa.binary()) for x in blobs)], ["slice", "digest", "doc_ids", "counts", *binary])

    return docs.select("doc_id", "text").mapInArrow(run, "slice long, digest long, doc_ids array<long>, counts array<long>, low binary, high binary, places binary")


def coded_once(sent: DataFrame, ranks: str) -> DataFrame:
    """SENT with the words' ids in their stead; rows must come bucket by bucket, and a bucket's distinct words are coded once."""

    def run(batches):
        import tiktoken

        coder = tiktoken.Encoding("ranks", pat_str=r"[\s\S]+", mergeable_ranks=token_bytes(ranks), special_tokens={})
        kind = _id_kind(ranks)
        pack, unpack = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
        known: dict[bytes, bytes] = {}
        now = None
        for batch in batches:
            out = []
            for key, digest, bucket, sizes, content in zip(*(batch.column(c).to_pylist() for c in ("slice", "digest", "bucket", "sizes", "content"))):
                if bucket != now:
                    known, now = {}, bucket
                content = unpack.decompress(content)
                ends = np.cumsum(np.frombuffer(unpack.decompress(sizes), "<u4"), dtype=np.int64).tolist()
                found, at = [], 0
                for end in ends:
                    word = content[at:end]
                    ids = known.get(word)
                    if ids is None:
                        ids = known[word] = np.array(coder.encode_ordinary(word.decode()), kind).tobytes()
                    found.append(ids)
                    at = end
                n = np.fromiter(map(len, found), np.int64, len(found)) // np.dtype(kind).itemsize
                out.append((key, digest, bucket, pack.compress(n.astype("<u4").tobytes()), pack.compress(b"".join(found))))
            yield _packed(out)

    return sent.mapInArrow(run, SENT)


def _id_kind(ranks: str) -> str:
    return "<u2" if max(token_bytes(ranks).values()) < 1 << 16 else "<u4"


def _reassemble(coded: pa.Table, rows: pa.Table, kind: str) -> pa.Table:
    """Ids of a slice's documents; ``coded`` is empty where no text has a word."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])
    if rows.num_rows != 1:
        raise ValueError("the documents gave other rows when they were read again; write them to a table first")
    unpack = zstandard.ZstdDecompressor()
    row = rows.to_pylist()[0]
    joined = lambda name: b"".join(unpack.decompress(x) for x in coded.column(name).to_pylist())
    coded = coded.sort_by("bucket")
    n = np.frombuffer(joined("sizes"), "<u4").astype(np.int64)
    pool = np.frombuffer(joined("content"), kind)
    numbers = np.frombuffer(unpack.decompress(row["low"]), np.uint8) + (np.frombuffer(unpack.decompress(row["high"]), "<u4").astype(np.int64) << 8)
    places = np.frombuffer(unpack.decompress(row["places"]), "<u4")
    if len(places) != len(n):
        raise ValueError("a slice's words are not complete")
    own = places[numbers]
    sizes = n[own]
    ids = gather(pool, (np.cumsum(n) - n)[own], sizes)
    offsets = np.append(0, np.cumsum(sizes))[np.append(0, np.cumsum(np.array(row["counts"], np.int64)))]
    return pa.Table.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(np.diff(offsets)), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.astype(np.int32)))], schema=schema)


def encode(docs: DataFrame, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids: every text's ids, as coding each match of the pattern separately gives them."""
    ranks, pattern = ranks or default_ranks(), pattern or default_pattern()
    parts = shuffle_parts(docs.sparkSession)
    buckets, keys = 2 * parts, ["slice", "digest"]
    sent = words_of_slices(docs, pattern, buckets).repartition(parts, "bucket").sortWithinPartitions("bucket")
    coded = coded_once(sent, ranks).groupBy(keys)

    def reassemble(coded: pa.Table, rows: pa.Table) -> pa.Table:
        return _reassemble(coded, rows, _id_kind(ranks))

    return coded.cogroup(positions(docs, pattern, buckets).groupBy(keys)).applyInArrow(reassemble, "doc_id long, n_tokens long, ids array<int>")


# --- decoding -------------------------------------------------------------


def decode(coded: DataFrame, ranks: str | None = None) -> DataFrame:
    """``coded`` with the bytes of its ``ids`` as ``decoded``; null ids give null, an id outside the vocabulary is an error."""
    ranks = ranks or default_ranks()
    names = coded.columns

    def run(batches):
        table = token_bytes(ranks)
        size = np.zeros(max(table.values()) + 1, np.int64)
        for token, k in table.items():
            size[k] = len(token)
        pool = np.frombuffer(b"".join(sorted(table, key=table.__getitem__)), np.uint8)
        at = np.cumsum(size) - size
        for batch in batches:
            out = []
            for ids in batch.column("ids"):
                own = None if not ids.is_valid else ids.values.to_numpy(zero_copy_only=False)
                if own is not None and len(own) and (own.min() < 0 or own.max() >= len(size) or not size[own].all()):
                    raise ValueError("an id is not in the vocabulary")
                out.append(None if own is None else gather(pool, at[own], size[own]).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*names, "decoded"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in coded.schema.fields)
    return coded.mapInArrow(run, f"{kinds}, decoded binary")


def digest(coded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of encoded documents."""
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return decode(coded).select("doc_id", "n_tokens", F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return digest(encode(spark.read.parquet(f"{sf_dir}/documents.parquet")))


#: SQL has no byte-pair merges; tests hold the ids against the tiktoken library.
ORACLE_SQL: dict = {}
QUERIES = {"op13_byte_bpe": op13_byte_bpe}
