"""Token ids in blocks of a static range asymmetric numeral system (rANS).

Texts are tokenized in place; one pass over all ids counts them, and the
counts, scaled to 2**SCALE, are the frequency table that all blocks share.
Documents are range-partitioned and sorted by doc_id; each task cuts its run
into blocks of whole documents, about ``block_tokens`` ids each. A block is
coded on its own by interleaved coders: lane j holds ids j, j + lanes, ... and
all lanes share one stream of 32-bit words. A block carries a CRC-32 of its
ids and checkpoints (stream place and lane states), from which its stretches
are decoded side by side, or one of them alone.

Files: Parquet tables ``blocks`` (part, block, n_tokens, doc_ids, lengths,
data) and ``freq`` (token, freq) under one path.

Defined results: a null text counts as empty and gives the end id alone; equal
doc_ids stand side by side, ordered by their ids; null doc_ids come first; an
empty table gives no rows; other columns play no part. Texts are never cut: a
document longer than a block has a block to itself.
"""

from __future__ import annotations

import functools
import os
import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.llm.common import U64, byte_table, scratch, shuffle_parts, slices, span_hashes, stage, word_spans

SCALE = 20
LOW = np.uint64(1 << 31)
LANES = 4096
CHECKPOINTS = 4
BLOCK_TOKENS = 1 << 21
END_ID = 2
#: Chunks of text whose ids a worker remembers before it starts anew, and how many are coded as one text.
REMEMBERED = 800_000
AT_ONCE = 1000
#: Bytes of the longest word that is coded as a chunk.
LONGEST = 128
CHUNKS = byte_table(b" \n")
#: Marks that pre-tokenization never joins with a letter or digit before them.
IS_MARK = ~byte_table(b".,;:!?*#$%&|")
IS_ALNUM = ~byte_table(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
KIND_STEP = U64(0xD6E8FEB86659FD93)
FULL = U64((1 << 64) - 1)
HEAD = struct.Struct("<4sHHQQI")
MAGIC = b"rANS"


# --- tokenizing -----------------------------------------------------------


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class ChunkEncoder:
    """Encodes texts with the tokenizers library, each distinct chunk once.

    Byte-level pre-tokenization never joins what stands before a space that
    follows a non-blank, nor what stands before a line feed between non-blanks,
    nor marks with a letter or digit before them. So a text whose blanks are
    single spaces and line feeds is coded chunk by chunk: a word with the blank
    that leads it, or the marks behind a word. Chunks are known by a 64-bit
    hash, their length and their first eight bytes; their ids lie in one array,
    from which a batch's ids are gathered at once. New chunks are coded side by
    side as one text, whose ids are dealt out again by their byte lengths; the
    memory of chunks is bounded. Any other text is coded whole, as are texts
    that hold an added token's content or a word of more than LONGEST bytes.
    """

    SPACE, FEED, MARK = 0, 1, 2

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the threads
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        # In a byte-level vocabulary a token has a character for each byte.
        self.bytes_of = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, at in self.tokenizer.get_vocab().items():
            self.bytes_of[at] = len(token)
        self._forget()

    def _forget(self) -> None:
        self.key = np.empty(0, U64)  # ascending; the others are by the same order
        self.head, self.size = np.empty(0, U64), np.empty(0, np.int64)
        self.at, self.n = np.empty(0, np.int64), np.empty(0, np.int64)
        self.pool = np.empty(0, self.kind)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids if text else [], self.kind)

    @staticmethod
    def _plain(chunk: str) -> bool:
        """No blank of any kind inside."""
        return chunk.isalnum() or (len(chunk.split()) == 1 and not chunk[0].isspace() and not chunk[-1].isspace() and "\u180e" not in chunk)

    def _learn(self, joined: bytes, start: np.ndarray, end: np.ndarray, kind: np.ndarray, key: np.ndarray, head: np.ndarray) -> None:
        """Code new chunks; those that must not be coded apart get no ids."""
        if len(self.key) > REMEMBERED:
            self._forget()
        names = [joined[a:b].decode() for a, b in zip(start.tolist(), end.tolist())]
        n, parts = np.zeros(len(names), np.int64), []
        marks = np.flatnonzero(kind == self.MARK)
        led = np.flatnonzero(kind != self.MARK)
        led = led[np.fromiter((self._plain(names[k]) for k in led), bool, len(led))]
        for a in range(0, len(led), AT_ONCE):
            own = led[a : a + AT_ONCE]
            ids = self.whole("".join([("\n" if kind[k] == self.FEED else " ") + names[k] for k in own]))
            ends = np.cumsum((end - start)[own] + 1)
            cuts = np.searchsorted(np.cumsum(self.bytes_of[ids]), ends) + 1
            n[own] = np.diff(cuts, prepend=0)
            parts.append(ids)
        for k in marks:
            parts.append(self.whole(names[k]))
            n[k] = len(parts[-1])
        order = np.concatenate([led, marks])
        at = np.zeros(len(names), np.int64)
        at[order] = len(self.pool) + np.cumsum(n[order]) - n[order]
        self.pool = np.concatenate([self.pool, *parts])
        into = np.searchsorted(self.key, key)
        for name, values in (("key", key), ("head", head), ("size", end - start), ("at", at), ("n", n)):
            setattr(self, name, np.insert(getattr(self, name), into, values))

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text (UTF-8)."""
        joined = b"\n" + b"\n".join([*texts, b""]) + bytes(8)
        buf = np.frombuffer(joined, np.uint8)[: len(joined) - 8]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        text_start = 1 + np.cumsum(sizes + 1) - sizes - 1
        start, end = word_spans(buf, CHUNKS)
        first = np.searchsorted(start, np.append(text_start, len(buf)))
        alone = np.zeros(len(texts) + 1, bool)  # to be coded whole; one entry more for what is in no text
        n_words = np.diff(first)
        some = np.flatnonzero(n_words)
        text = np.repeat(np.arange(len(texts)), n_words)
        alone[:-1] = (n_words == 0) & (sizes > 0)
        alone[some] |= (start[first[some]] != text_start[some]) | (end[first[some + 1] - 1] != text_start[some] + sizes[some])
        wide = (start[1:] - end[:-1] > 1) & (text[1:] == text[:-1])
        alone[text[1:][wide]] = True
        alone[text[end - start > LONGEST]] = True
        for content in self.added:
            at = joined.find(content)
            while at >= 0:
                alone[np.searchsorted(text_start, at, side="right") - 1] = True
                at = joined.find(content, at + 1)

        # Marks behind an ASCII letter or digit are chunks of their own.
        bare = end.copy()
        more = np.flatnonzero(IS_MARK[buf[end - 1]])
        while len(more):
            bare[more] -= 1
            more = more[(bare[more] > start[more])]
            more = more[IS_MARK[buf[bare[more] - 1]]]
        cut = (bare < end) & (bare > start) & IS_ALNUM[buf[bare - 1]]
        place = np.arange(len(start)) + np.cumsum(cut) - cut
        total = len(start) + int(cut.sum())
        a, b, kind = np.empty(total, np.int64), np.empty(total, np.int64), np.full(total, self.MARK)
        a[place], b[place] = start, np.where(cut, bare, end)
        kind[place] = np.where(buf[start - 1] == 10, self.FEED, self.SPACE)
        a[place[cut] + 1], b[place[cut] + 1] = bare[cut], end[cut]

        size = b - a
        key = span_hashes(buf, a, b) + kind.astype(U64) * KIND_STEP
        head = np.ndarray(len(joined) - 7, "<u8", joined, strides=(1,))[a] & (FULL >> (U64(8) * (U64(8) - np.minimum(size, 8).astype(U64))))
        code, distinct = pd.factorize(key)
        sample = np.empty(len(distinct), np.int64)
        sample[code[::-1]] = np.arange(total - 1, -1, -1)
        known = np.searchsorted(self.key, distinct)
        new = np.append(self.key, FULL)[known] != distinct
        new[known == len(self.key)] = True
        if new.any():
            if len(self.key) > REMEMBERED:
                new[:] = True
            own = sample[new][np.argsort(distinct[new])]
            self._learn(joined, a[own], b[own], kind[own], key[own], head[own])
            known = np.searchsorted(self.key, distinct)
        row = known[code]
        n = self.n[row]
        piece_first = np.append(place, total)[first]
        odd = (n == 0) | (self.head[row] != head) | (self.size[row] != size)
        if odd.any():
            alone[np.searchsorted(piece_first, np.flatnonzero(odd), side="right") - 1] = True
        until = np.cumsum(n)
        took = np.repeat(self.at[row] - until + n, n)
        took += np.arange(len(took))
        ids = self.pool[took]
        cuts = np.append(0, until)[piece_first].tolist()
        # A text's first word is coded behind a line feed, whose id is left out.
        return [self.whole(t.decode()) if w else ids[x + 1 : y] for t, w, x, y in zip(texts, alone, cuts, cuts[1:])]


@functools.lru_cache(1)
def _encoder(path: str) -> ChunkEncoder:
    """One encoder for all tasks that a worker process runs."""
    return ChunkEncoder(path)


def tokenize(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """doc_id, n_tokens, ids, counts.

    ``ids``: zstd of the ids (with the end id) as little-endian numbers. A
    task's last row has no document, but ``counts``: how often each id occurs
    in the task's documents, as zstd of little-endian 64-bit numbers by id.
    """

    def run(batches):
        coder = _encoder(tokenizer or default_tokenizer())
        pack = zstandard.ZstdCompressor(level=1)
        end = np.array([end_id], coder.kind).tobytes()
        total = np.zeros(max(len(coder.bytes_of), end_id + 1), np.int64)
        none = {"doc_id": pa.nulls(1, pa.int64()), "n_tokens": pa.nulls(1, pa.int64()), "ids": pa.nulls(1, pa.binary())}
        for batch in batches:
            for at, to, texts in slices(batch, "text", 4 << 20):
                found = coder.encode(texts)
                seen = np.bincount(np.concatenate(found)) if found else total[:0]
                total[: len(seen)] += seen
                total[end_id] += len(texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(at, to - at),
                        pa.array([len(x) + 1 for x in found], pa.int64()),
                        pa.array([pack.compress(x.tobytes() + end) for x in found], pa.binary()),
                        pa.nulls(to - at, pa.binary()),
                    ],
                    ["doc_id", "n_tokens", "ids", "counts"],
                )
        yield pa.RecordBatch.from_pydict(none | {"counts": pa.array([pack.compress(total.tobytes())], pa.binary())})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids binary, counts binary")


def _ids(blob: bytes, n: int) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4")


# --- the frequency table --------------------------------------------------


def count_ids(tokens: DataFrame) -> DataFrame:
    """token, n: how often each id occurs in all documents, from the rows with ``counts`` alone."""

    def run(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            for blob in batch.column("counts").to_pylist():
                seen = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), "<i8")
                total = total + seen if len(total) else seen
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(total[at], pa.int64())], ["token", "n"])

    rows = tokens.where("counts is not null").select("counts")
    return rows.mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def scale_counts(tokens: np.ndarray, counts: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Frequencies by token id that sum to 2**scale, at least 1 for each id that occurs."""
    freq = np.zeros(int(tokens.max()) + 1 if len(tokens) else 1, np.int64)
    if not len(tokens):
        return freq
    share = np.maximum(1, np.floor(counts / counts.sum() * (1 << scale))).astype(np.int64)
    order = np.lexsort((tokens, -counts))
    spare = (1 << scale) - int(share.sum())
    k = 0
    while spare:  # the most frequent ids give or take the difference
        i = order[k % len(order)]
        step = max(spare, 1 - int(share[i])) if spare < 0 else spare
        share[i] += step
        spare -= step
        k += 1
    freq[tokens] = share
    return freq


class Table:
    """Frequencies with their running sums and the id of each slot."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.base = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
        self.slot = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)


# --- one block ------------------------------------------------------------


def encode_block(ids: np.ndarray, table: Table, lanes: int = LANES, checkpoints: int = CHECKPOINTS) -> bytes:
    n = len(ids)
    lanes = max(1, min(lanes, n // 64))
    steps = -(-n // lanes)
    every = max(1, -(-steps // checkpoints))
    state = np.full(lanes, LOW, np.uint64)
    freq, base = table.freq[ids], table.base[ids]
    limit = freq << np.uint64(63 - SCALE)
    words, marks, emitted = [], [], 0
    for t in range(steps - 1, -1, -1):
        a, b = t * lanes, min((t + 1) * lanes, n)
        x, f = state[: b - a], freq[a:b]
        over = x >= limit[a:b]
        out = x[over].astype(np.uint32)
        x[over] >>= np.uint64(32)
        words.append(out)
        emitted += len(out)
        q = x // f
        x[:] = (q << np.uint64(SCALE)) + (x - q * f) + base[a:b]
        if t % every == 0:
            marks.append((t, emitted, state.copy()))
    stream = np.concatenate(words[::-1]) if words else np.empty(0, np.uint32)
    body = b"".join(struct.pack("<QQ", t, emitted - e) + s.tobytes() for t, e, s in marks[::-1])
    return HEAD.pack(MAGIC, lanes, len(marks), n, emitted, zlib.crc32(ids.astype("<u4").tobytes())) + body + stream.tobytes()


def decode_marks(data: bytes, table: Table, low: int = 0, high: int | None = None) -> np.ndarray:
    """The ids from checkpoint ``low`` to checkpoint ``high`` (or the block's end).

    Each checkpoint starts a stretch of its own; all stretches are decoded side by side.
    """
    _, lanes, marks, n, n_words, _ = HEAD.unpack_from(data)
    size = 16 + 8 * lanes
    words = np.frombuffer(data, np.uint32, n_words, HEAD.size + marks * size)
    heads = [struct.unpack_from("<QQ", data, HEAD.size + m * size) for m in range(marks)]
    high = marks if high is None else high
    state = np.array([np.frombuffer(data, np.uint64, lanes, HEAD.size + m * size + 16) for m in range(low, high)])
    at = np.array([heads[m][1] for m in range(low, high)])
    bounds = [*(t for t, _ in heads), -(-n // lanes)]
    first, lengths = bounds[low], np.diff(bounds[low : high + 1])
    out = np.zeros((int(lengths.sum()), lanes), np.uint32)
    row = np.array(bounds[low:high]) - first
    last = n - (bounds[-1] - 1) * lanes  # lanes in use at the block's last step
    mask = np.uint64((1 << SCALE) - 1)
    for t in range(int(lengths.max())):
        k = int((lengths > t).sum())  # only the last stretch may be shorter than the others
        short = high == marks and t == lengths[-1] - 1 and last < lanes
        x = state[:k]
        slot = x & mask
        ids = table.slot[slot]
        y = table.freq[ids] * (x >> np.uint64(SCALE)) + slot - table.base[ids]
        under = y < LOW
        if short:
            under[-1, last:] = False
        taken = under.sum(1)
        rank = np.cumsum(under, 1)[under] - 1 + np.repeat(at, [*taken, *[0] * (len(at) - k)])
        if len(rank) and rank.max() >= n_words:
            raise ValueError("a block of token ids ends too early")
        y[under] = (y[under] << np.uint64(32)) | words[rank]
        if short:
            y[-1, last:] = x[-1, last:]
        state[:k] = y
        out[row[:k] + t] = ids
        at[:k] += taken
    if high == marks and (state[-1] != LOW).any():
        raise ValueError("a block of token ids does not end as it began")
    return out.ravel()[: min(bounds[high] * lanes, n) - first * lanes]


def decode_block(data: bytes, table: Table) -> np.ndarray:
    magic, _, _, n, _, crc = HEAD.unpack_from(data)
    ids = decode_marks(data, table) if n else np.empty(0, np.uint32)
    if magic != MAGIC or zlib.crc32(ids.tobytes()) != crc:
        raise ValueError("a block of token ids is damaged")
    return ids


# --- files ----------------------------------------------------------------


def _table(freq_rows) -> Table:
    freq = np.zeros(max((r["token"] for r in freq_rows), default=0) + 1, np.int64)
    for r in freq_rows:
        freq[r["token"]] = r["freq"]
    return Table(freq)


def write(docs: DataFrame, path: str, tokenizer: str | None = None, block_tokens: int = BLOCK_TOKENS) -> None:
    """Tokenize ``docs`` (doc_id, text) and write their ids, in ascending doc_id order, under ``path``."""
    spark = docs.sparkSession
    tokens = stage(tokenize(docs, tokenizer), "tokens")
    # The vocabulary bounds these rows.
    counts = count_ids(tokens).orderBy("token").collect()
    freq = scale_counts(np.array([r["token"] for r in counts], np.int64), np.array([r["n"] for r in counts], np.int64))
    rows = [(int(t), int(f)) for t, f in enumerate(freq) if f]
    spark.createDataFrame(rows, "token long, freq long").coalesce(1).write.parquet(f"{path}/freq")

    def cut(batches):
        table, part, number = Table(freq), TaskContext.get().partitionId(), 0
        held, docs_in, lengths, total = [], [], [], 0

        def flush():
            data = encode_block(np.concatenate(held), table)
            cols = [pa.array([x], k) for x, k in ((part, pa.int32()), (number, pa.int32()), (total, pa.int64()), (docs_in, pa.list_(pa.int64())), (lengths, pa.list_(pa.int64())), (data, pa.binary()))]
            return pa.RecordBatch.from_arrays(cols, ["part", "block", "n_tokens", "doc_ids", "lengths", "data"])

        for batch in batches:
            for doc_id, n, blob in zip(batch.column("doc_id").to_pylist(), batch.column("n_tokens").to_pylist(), batch.column("ids")):
                held.append(_ids(blob.as_py(), n))
                docs_in.append(doc_id)
                lengths.append(n)
                total += n
                if total >= block_tokens:
                    yield flush()
                    number += 1
                    held, docs_in, lengths, total = [], [], [], 0
        if held:
            yield flush()

    ordered = tokens.where("ids is not null").drop("counts").repartitionByRange(shuffle_parts(spark), "doc_id").sortWithinPartitions("doc_id", "n_tokens", "ids")
    schema = "part int, block int, n_tokens long, doc_ids array<long>, lengths array<long>, data binary"
    ordered.mapInArrow(cut, schema).write.option("compression", "none").parquet(f"{path}/blocks")


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, place (among equal doc_ids): decoded from the files."""
    table = _table(spark.read.parquet(f"{path}/freq").collect())
    freq = table.freq.astype(np.int64)
    blocks = spark.read.parquet(f"{path}/blocks")

    def decode(batches):
        own = Table(freq)
        for batch in batches:
            for part, block, doc_ids, lengths, data in zip(*(batch.column(c) for c in ("part", "block", "doc_ids", "lengths", "data"))):
                ids = decode_block(data.as_py(), own)
                lengths = np.array(lengths.as_py(), np.int64)
                ends = np.cumsum(lengths)
                crcs = [zlib.crc32(ids[b - n : b].tobytes()) for b, n in zip(ends, lengths)]
                k = len(lengths)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part.as_py()] * k, pa.int32()),
                        pa.array([block.as_py()] * k, pa.int32()),
                        doc_ids.values.slice(0, k) if len(doc_ids.values) == k else pa.array(doc_ids.as_py(), pa.int64()),
                        pa.array(ends - lengths),
                        pa.array(lengths),
                        pa.array(crcs, pa.int64()),
                    ],
                    ["part", "block", "doc_id", "within", "n_tokens", "ids_crc32"],
                )

    decoded = blocks.mapInArrow(decode, "part int, block int, doc_id long, within long, n_tokens long, ids_crc32 long")
    sizes = blocks.select("part", "block", "n_tokens")
    # A row per part, then per block within its part: neither grows with a part's documents.
    before_part = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before_part), F.lit(0)).alias("at_part"))
    before_block = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    places = sizes.select("part", "block", F.coalesce(F.sum("n_tokens").over(before_block), F.lit(0)).alias("at_block")).join(parts, "part")
    return decoded.join(places, ["part", "block"]).select(
        "doc_id",
        (F.col("at_part") + F.col("at_block") + F.col("within")).alias("start"),
        "n_tokens",
        "ids_crc32",
    )


def op9_token_blocks(spark, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-blocks")
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read(spark, path)


#: SQL has no tokenizer; tests hold the result against the tokenizers library.
ORACLE_SQL: dict = {}
QUERIES = {"op9_token_blocks": op9_token_blocks}
