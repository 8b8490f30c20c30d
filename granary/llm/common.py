"""What the operators of this subpackage share: scratch tables, word arrays, packed shuffles."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.session import shared_path, staged

#: Bytes that separate words: space and the controls tab to carriage return.
BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"
#: The same for Spark's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]+"

U64 = np.uint64
#: Text bytes hashed at a time, but for longer words.
PIECE = 1 << 20


# --- scratch tables -------------------------------------------------------


#: A new path in the folder that all executors share, and a table written there and read back.
scratch, stage = shared_path, staged


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, text, void (no doc_id), oid: rows without doc_id are told by their text, and come last in the order of (void, oid)."""
    return docs.select("doc_id", "text", F.col("doc_id").isNull().alias("void"), F.coalesce("doc_id", F.xxhash64("text")).alias("oid"))


def in_runs(values: np.ndarray) -> np.ndarray:
    """Which of some sorted values occur twice or more."""
    same = values[1:] == values[:-1]
    return np.concatenate([same, [False]]) | np.concatenate([[False], same]) if len(values) else np.empty(0, bool)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def n_words(text):
    """Number of words (see WORD) of a string column, by built-in functions; null has none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS.decode()))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, BLANK))).cast("long")


# --- word arrays ----------------------------------------------------------


def byte_table(outside: bytes) -> np.ndarray:
    """Which byte values belong to words: all but those given."""
    table = np.ones(256, bool)
    table[list(outside)] = False
    return table


BLANK_WORDS = byte_table(BLANKS)
#: Words of ASCII letters, digits and all that is not ASCII, once A-Z is in lower case.
ALNUM_WORDS = byte_table(bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
SAME = np.arange(256, dtype=np.uint8)

_BASE = U64(0x9E3779B97F4A7C15)
_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, PIECE + PIECE // 4)
        _powers[:] = [np.cumprod(np.full(size, b, U64)) for b in (_BASE, _INVERSE)]
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: spreads each bit over all others."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of ``buf`` in ascending order, about PIECE bytes at a time."""
    out = np.empty(len(starts), U64)
    i = 0
    while i < len(starts):
        low = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, low + PIECE)))
        part = buf[low : int(ends[j - 1])]
        power, inverse = _power_tables(len(part) + 1)
        total = np.empty(len(part) + 1, U64)
        total[0] = 0
        np.cumsum(part.astype(U64) * power[:-1] + power[:-1], out=total[1:])
        s, e = starts[i:j] - low, ends[i:j] - low
        out[i:j] = mix((total[e] - total[s]) * inverse[s])
        i = j
    return out


def word_spans(folded: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First bytes and ends of the words of a buffer."""
    inside = np.zeros(len(folded) + 2, bool)
    inside[1:-1] = words[folded]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[0::2], edge[1::2]


def hash_words(texts: list[bytes], words: np.ndarray = BLANK_WORDS, fold: np.ndarray = SAME, spans: bool = False):
    """Hash every word of some texts.

    Returns the 64-bit hashes of all words in order and the index of each
    text's first word (one more entry at the end); with ``spans`` also the
    words' first bytes and ends in the texts joined by a line feed.
    """
    joined = b"\n".join([*texts, b""]) or b"\n"
    buf = np.frombuffer(joined, np.uint8)
    folded = buf if fold is SAME else fold[buf]
    starts, ends = word_spans(folded, words)
    hashes = span_hashes(folded, starts, ends)
    offsets = np.concatenate([[0], np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))])
    first = np.searchsorted(starts, offsets)
    return (hashes, first, starts, ends, joined) if spans else (hashes, first)


STEP, OTHER_STEP = U64(0xD6E8FEB86659FD93), U64(0xA0761D6478BD642F)


def window_hashes(words: np.ndarray, size: int, seed: int = 0, step: np.uint64 = STEP) -> np.ndarray:
    """Hashes of all runs of ``size`` words; entry i starts at word i. Another ``step`` gives independent ones."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, U64)
    out = np.zeros(n, U64)
    for k in range(size):
        out *= step
        out += words[k : k + n]
    return mix(out ^ U64(seed))


# --- texts from Arrow batches --------------------------------------------


def slices(batch: pa.RecordBatch, column: str, limit: int = 8 << 20) -> Iterator[tuple[int, int, list[bytes]]]:
    """(from, to, texts as UTF-8) over rows of a batch, about ``limit`` bytes at a time; null gives b""."""
    texts = batch.column(column).cast(pa.large_string()).cast(pa.large_binary())
    at = 0
    rows = batch.num_rows
    while at < rows:
        out, size, to = [], 0, at
        while to < rows and (size < limit or to == at):
            out.append(texts[to].as_py() or b"")
            size += len(out[-1])
            to += 1
        yield at, to, out
        at = to


# --- packed shuffles ------------------------------------------------------
# Many small (key, value) numbers travel as a few binary rows per batch and
# bucket; Spark groups these rows by bucket and each bucket is unpacked alone.

#: Numbers that a bucket should hold: at least, if there are few, and on average, if there are many.
LEAST_ROWS, BUCKET_ROWS = 1 << 14, 1 << 18


def pack(bucket: np.ndarray, columns: dict[str, np.ndarray | list[bytes]]) -> pa.RecordBatch:
    """One row per bucket that occurs, its numbers as little-endian binary columns, its byte strings joined by line feeds."""
    order = np.argsort(bucket, kind="stable")
    at = bucket[order]
    cuts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.empty(0, int)
    ends = [*cuts[1:], len(at)]
    arrays = [pa.array(at[cuts].astype(np.int64), pa.int64())]
    for values in columns.values():
        if isinstance(values, list):
            values = [values[k] for k in order.tolist()]
            arrays.append(pa.array([b"\n".join(values[a:b]) for a, b in zip(cuts, ends)], pa.binary()))
        else:
            values = np.ascontiguousarray(values[order])
            arrays.append(pa.array([values[a:b].tobytes() for a, b in zip(cuts, ends)], pa.binary()))
    return pa.RecordBatch.from_arrays(arrays, ["bucket", *columns])


def packed_schema(*names: str) -> str:
    return "bucket long, " + ", ".join(f"{n} binary" for n in names)


def unpack(batches: Iterable[pa.RecordBatch], kinds: dict[str, type]) -> dict[str, np.ndarray]:
    """All numbers of some packed rows, joined."""
    parts: dict[str, list[bytes]] = {n: [] for n in kinds}
    for batch in batches:
        for n in kinds:
            parts[n] += batch.column(n).to_pylist()
    return {n: np.frombuffer(b"".join(parts[n]), kind) for n, kind in kinds.items()}


def bucket_count(spark: SparkSession, rows: int = 0) -> int:
    """Buckets of a packed shuffle of about so many numbers: one to four per shuffle partition, more where the data ask for it.

    Where numbers go on from bucket to bucket, a few to a row would be no packing at all.
    """
    parts = shuffle_parts(spark)
    return max(parts, min(4 * parts, rows // LEAST_ROWS), rows // BUCKET_ROWS)


ARROW = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}


def per_bucket(packed: DataFrame, run: Callable[[list[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``run`` over the packed rows of one bucket after another; a task holds one bucket at a time."""
    kinds = pa.schema([(n, ARROW[k]) for n, k in (c.split() for c in schema.split(", "))])

    def whole(table):
        return pa.Table.from_batches([pa.RecordBatch.from_arrays(b.columns, schema=kinds) for b in run(table.to_batches())], kinds)

    return packed.groupBy("bucket").applyInArrow(whole, schema)


def text_columns(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, so that extra or clashing ones of the input play no part."""
    return docs.select(*[docs[n] for n in names])
