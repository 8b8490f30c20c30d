"""Alignment of two tokenizers over a corpus, and statistics of the aligned ids.

A text is coded by a byte-level tokenizer (A) and a piece tokenizer (B); places
where tokens of both end cut the tokens into groups, and the last tokens of a
group are linked. The corpus-wide count of each linked pair of ids comes first,
then each document's figures rest on it.

Most groups are one token each with the same bytes. An identity map, an array
from each id of A to the id of B with these bytes, knows them: they are counted
in one vector of the vocabulary's length per task. Only links of other groups
are pairs of their own: a slice of texts sends each of its irregular pairs once,
with its number in the slice, to a shuffle that sums them; the counts go back
to the slices by a join, whose large partitions Spark splits, and the documents
of a slice get their sums. Vectors and each id's highest count are bounded by
the vocabularies and are sent to all workers; pairs never are.

Neither tokenizer joins what stands before a space or line feed that follows
another character, so both code texts chunk by chunk there, and a worker aligns
each distinct chunk once (the memory of chunks is bounded). Where the pieces of
B do not allow this, texts are one chunk each.

Defined results: texts that are null, empty, or changed by a tokenizer (their
tokens' bytes differ from a space and the text) have no tokens, zeros and ''.
Of several ids of B with equal bytes the piece that is no byte token, then the
smallest id, is in the identity map; groups with the others are irregular. Rows
with equal or null doc_ids are rows of their own; an empty table gives no rows;
other columns play no part. Texts are never cut.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.byte_bpe import distinct_spans, gather
from granary.llm.common import byte_table, slices, stage

#: Text bytes of a slice, and text bytes of chunks that a worker remembers before it starts anew.
SLICE = 4 << 20
REMEMBERED = 3 << 20
#: How many chunks are coded as one text.
AT_ONCE = 4096
META = "▁"
BREAKS = ~byte_table(b" \n")
#: Ends of multi-byte blanks in UTF-8, which are no place to cut behind; with the zero-width ones.
WIDE_BLANKS = [chr(c).encode() for c in (0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF)]


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _byte_level() -> dict[str, int]:
    """Bytes by the characters that stand for them in byte-level vocabularies: printable ones themselves, the rest from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class Pair:
    """Both tokenizers, the bytes of their tokens, the identity map and the chunks aligned so far."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the threads
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        plain = _byte_level()
        self.bytes_a: list[bytes | None] = [None] * (max(self.a.get_vocab().values()) + 1)
        for token, k in self.a.get_vocab().items():
            self.bytes_a[k] = bytes(map(plain.get, token)) if all(c in plain for c in token) else token.encode()
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace(META, " ").encode() for k, p in enumerate(pieces)]
        usual = {}
        for k in sorted(range(len(pieces)), key=lambda k: (self.b.is_byte(k), k)):
            if not (self.b.is_control(k) or self.b.is_unknown(k)):
                usual.setdefault(self.bytes_b[k], k)
        self.same = np.array([usual.get(x, -1) for x in self.bytes_a], np.int64)
        self.pool_a, self.pool_b = self._pool(self.bytes_a), self._pool(self.bytes_b)
        most = max(len(self.bytes_a), len(pieces))
        self.names = np.array([[f"{k}{mark}" for k in range(most)] for mark in ",|;"], object)
        #: No piece goes on past a blank behind another character, and none holds a line feed.
        self.by_chunk = not any("\n" in p or re.search(f"[^{META}]{META}", p) for p in pieces) and self.b.encode("\n", out_type=str)[:1] == [META]
        self.forget()

    @staticmethod
    def _pool(tokens: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of all tokens, where each starts, and their sizes."""
        size = np.array([len(x or b"") for x in tokens], np.int64)
        return np.frombuffer(b"".join(x or b"" for x in tokens), np.uint8), np.cumsum(size) - size, size

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.held = 0
        # By chunk: tokens of A and B (-1: changed by a tokenizer), links and their place among all links, groups as text.
        self.n_a, self.n_b, self.n_links, self.at = (np.empty(0, np.int64) for _ in range(4))
        self.shown: list[str] = []
        self.links = np.empty((0, 2), np.int64)

    def cuts(self, buf: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Where chunks start in joined texts that each start with a space; ``first``: where the texts do."""
        if not self.by_chunk:
            return first
        before = np.append(np.uint8(32), buf[:-1])
        at = np.flatnonzero(BREAKS[buf] & (before > 0x20) & (before != 0x7F))
        wide = np.flatnonzero(before[at] >= 0x80)
        for blank in WIDE_BLANKS:
            if not len(wide):
                break
            same = np.ones(len(wide), bool)
            for k, byte in enumerate(blank[::-1]):
                same &= buf[np.maximum(at[wide] - 1 - k, 0)] == byte
            at[wide[same]] = -1
        start = np.zeros(len(buf), bool)
        start[at[at >= 0]] = True
        start[first] = True
        return np.flatnonzero(start)

    def learn(self, chunks: list[bytes]) -> None:
        """Align new chunks: many as one text, those that end in blanks or that a tokenizer changes one by one."""
        blank_end = tuple(WIDE_BLANKS)
        firm = [c[-1] > 0x20 and c[-1] != 0x7F and not c.endswith(blank_end) for c in chunks] if self.by_chunk else [False] * len(chunks)
        found, alone = [], [c for c, x in zip(chunks, firm) if not x]
        chunks = [c for c, x in zip(chunks, firm) if x]
        for k in range(0, len(chunks), AT_ONCE):
            some = chunks[k : k + AT_ONCE]
            joined = b"".join(some)
            a, b = self._tokens(joined)
            if self._same(joined, a, b):
                found.append(self._aligned(some, a, b))
            else:
                alone += some
        good, a_of, b_of, changed = [], [], [], []
        for chunk in alone:
            a, b = self._tokens(chunk)
            if self._same(chunk, a, b):
                good.append(chunk)
                a_of.append(a)
                b_of.append(b)
            else:
                changed.append(chunk)
        if good:
            found.append(self._aligned(good, np.concatenate(a_of), np.concatenate(b_of)))
        if changed:
            none = np.zeros(len(changed), np.int64)
            found.append((changed, none - 1, none, none, np.empty((0, 2), np.int64), [""] * len(changed)))
        for names, n_a, n_b, n_links, links, shown in found:
            self.known.update(zip(names, range(len(self.n_a), len(self.n_a) + len(names))))
            self.at = np.append(self.at, len(self.links) + np.cumsum(n_links) - n_links)
            self.n_a, self.n_b, self.n_links = np.append(self.n_a, n_a), np.append(self.n_b, n_b), np.append(self.n_links, n_links)
            self.links = np.concatenate([self.links, links])
            self.shown += shown
            self.held += sum(map(len, names))

    def _tokens(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Ids of both. B puts a space before a text: its own leads it, or none is wanted."""
        string = text.decode()
        a = self.a.encode_batch_fast([string], add_special_tokens=False)[0].ids
        if string[0] == " ":  # B gives an empty text no tokens at all
            b = self.b.encode(string[1:], num_threads=1) if len(string) > 1 else [self.b.piece_to_id(META)]
        else:
            b = self.b.encode(string, num_threads=1)[1:]
        return np.array(a, np.int64), np.array(b, np.int64)

    def _same(self, text: bytes, a: np.ndarray, b: np.ndarray) -> bool:
        return all(gather(pool, at[ids], size[ids]).tobytes() == text for ids, (pool, at, size) in ((a, self.pool_a), (b, self.pool_b)))

    def _aligned(self, chunks: list[bytes], a: np.ndarray, b: np.ndarray):
        """chunks, tokens of A, of B, links, the links, groups as text; the tokens' bytes are the chunks' bytes."""
        chunk_end = np.cumsum(np.fromiter(map(len, chunks), np.int64, len(chunks)))
        end_a, end_b = np.cumsum(self.pool_a[2][a]), np.cumsum(self.pool_b[2][b])
        at = np.searchsorted(end_b, end_a)
        i = np.flatnonzero(end_b[at] == end_a)
        j = at[i]
        per_chunk = lambda ends: np.diff(np.searchsorted(ends, chunk_end, side="right"), prepend=0)
        # A group's tokens of A, then those of B, each with the mark that follows it.
        group_a, group_b = np.searchsorted(i, np.arange(len(a))), np.searchsorted(j, np.arange(len(b)))
        last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        last_a[i], last_b[j] = 1, 2
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        words = self.names[np.concatenate([last_a, last_b])[order], np.concatenate([a, b])[order]].tolist()
        cuts = [0, *np.cumsum(per_chunk(end_a) + per_chunk(end_b)).tolist()]
        shown = ["".join(words[x:y])[:-1] for x, y in zip(cuts, cuts[1:])]
        return chunks, per_chunk(end_a), per_chunk(end_b), per_chunk(end_a[i]), np.stack([a[i], b[j]], 1), shown


@functools.lru_cache(1)
def _pair(path_a: str, path_b: str) -> Pair:
    """One pair of tokenizers for all tasks that a worker process runs."""
    return Pair(path_a, path_b)


PARTS = "slice long, number int, a int, b int, n long, doc_ids array<long>, figures binary, hashes binary, regular binary, irregular binary"
BLOBS = ("figures", "hashes", "regular", "irregular")


def _row(rows: int = 1, /, **columns) -> pa.RecordBatch:
    kinds = {"slice": pa.int64(), "number": pa.int32(), "a": pa.int32(), "b": pa.int32(), "n": pa.int64(), "doc_ids": pa.list_(pa.int64())} | dict.fromkeys(BLOBS, pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(columns[c], k) if c in columns else pa.nulls(rows, k) for c, k in kinds.items()], list(kinds))


def _slice_links(pair: Pair, texts: list[bytes]):
    """(figures per document, hashes, document of each link, a, b): n_a, n_b, n_links, all zero for texts without tokens."""
    marked = [b" " + t if t else b"" for t in texts]
    joined = b"".join(marked)
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    text_first = np.cumsum(sizes) - sizes
    starts = pair.cuts(np.frombuffer(joined, np.uint8), text_first[sizes > 0]) if joined else np.empty(0, np.int64)
    ends = np.append(starts[1:], len(joined))[: len(starts)]
    number, sample = distinct_spans(joined, starts, ends)
    chunks = [joined[a:b] for a, b in zip(starts[sample].tolist(), ends[sample].tolist())]
    if pair.held > REMEMBERED:
        pair.forget()
    pair.learn([c for c in chunks if c not in pair.known])
    at = np.array([pair.known[c] for c in chunks], np.int64)[number] if chunks else np.empty(0, np.int64)
    doc = np.searchsorted(text_first, starts, side="right") - 1  # of equal places, the last text is the one that is not empty
    void = np.zeros(len(texts), bool)
    void[doc[pair.n_a[at] < 0]] = True
    void |= sizes == 0
    cuts = np.searchsorted(doc, np.arange(len(texts) + 1)).tolist()
    shown = [pair.shown[k] for k in at.tolist()]
    hashes = [b"" if v else hashlib.sha256(";".join(shown[x:y]).encode()).hexdigest().encode() for v, x, y in zip(void.tolist(), cuts, cuts[1:])]
    used = ~void[doc]
    at, doc = at[used], doc[used]
    figures = np.stack([np.bincount(doc, x[at], len(texts)).astype(np.int64) for x in (pair.n_a, pair.n_b, pair.n_links)])
    n_links = pair.n_links[at]
    links = pair.links[gather(np.arange(len(pair.links)), pair.at[at], n_links)]
    return figures, hashes, np.repeat(doc, n_links), links[:, 0], links[:, 1]


def aligned_parts(docs: DataFrame, tokenizers: tuple[str, str]) -> DataFrame:
    """PARTS, three kinds of rows.

    Of a slice's documents (doc_ids): their figures and hashes, and their links
    as (document, id of A) and (document, number of the pair in the slice),
    compressed. Of a slice's irregular pairs: number, a, b and n links in the
    slice. Of a task's regular links (no slice): a, b, n, from its vector.
    """

    def run(batches):
        pair = _pair(*tokenizers)
        pack = zstandard.ZstdCompressor(level=3)
        vector = np.zeros(len(pair.same), np.int64)
        key = TaskContext.get().partitionId() << 32
        for batch in batches:
            for low, high, texts in slices(batch, "text", SLICE):
                figures, hashes, doc, a, b = _slice_links(pair, texts)
                is_same = pair.same[a] == b
                vector += np.bincount(a[is_same], minlength=len(vector))
                odd = ~is_same
                pairs, number, n = np.unique(a[odd] << 32 | b[odd], return_inverse=True, return_counts=True)
                of = {"regular": doc[is_same] << 32 | a[is_same], "irregular": doc[odd] << 32 | number}
                blobs = {"figures": figures.astype("<i8").tobytes(), "hashes": b",".join(hashes)} | {k: _pack_codes(v) for k, v in of.items()}
                yield _row(slice=[key], doc_ids=[batch.column("doc_id").slice(low, high - low).to_pylist()], **{k: [pack.compress(v)] for k, v in blobs.items()})
                if len(pairs):
                    yield _row(len(pairs), slice=np.full(len(pairs), key), number=np.arange(len(pairs)), a=pairs >> 32, b=pairs & 0xFFFFFFFF, n=n)
                key += 1
        seen = np.flatnonzero(vector)
        if len(seen):
            yield _row(len(seen), a=seen, b=pair.same[seen], n=vector[seen])

    return docs.select("doc_id", "text").mapInArrow(run, PARTS)


def _pack_codes(codes: np.ndarray) -> bytes:
    """(document, number) codes in ascending order: distinct ones and how often each occurs."""
    distinct, n = np.unique(codes, return_counts=True)
    step = np.diff(distinct, prepend=0)
    return np.concatenate([[len(distinct)], step, n]).astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()  # bytes of equal weight together


def _unpack_codes(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, number, times)."""
    values = np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(8, -1).T).view("<i8").ravel()
    n = int(values[0])
    codes = np.cumsum(values[1 : n + 1])
    return codes >> 32, codes & 0xFFFFFFFF, values[n + 1 :]


def pair_counts(parts: DataFrame) -> DataFrame:
    """a, b, n, regular: how many links of the corpus hold each pair of ids linked."""
    counted = parts.where("n IS NOT NULL").groupBy("a", "b")
    return counted.agg(F.sum("n").alias("n"), F.bool_or(F.col("slice").isNull()).alias("regular"))


def align(docs: DataFrame, tokenizers: tuple[str, str] | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document."""
    tokenizers = tokenizers or default_tokenizers()
    parts = stage(aligned_parts(docs, tokenizers), "aligned")
    counts = stage(pair_counts(parts), "pair-counts")
    best = counts.groupBy("b").agg(F.max("n").alias("top"))  # a row per id of B at most
    scored = counts.join(F.broadcast(best), "b").select("a", "b", "n", (F.col("n") == F.col("top")).alias("best"), "regular")
    # A row per id of A at most.
    known = scored.where("regular").select("a", "n", "best").toPandas()
    vector_n = np.zeros(int(known["a"].max()) + 1 if len(known) else 1, np.int64)
    vector_best = np.zeros(len(vector_n), np.int64)
    vector_n[known["a"]], vector_best[known["a"]] = known["n"], known["best"]
    sent = parts.where("number IS NOT NULL").select("slice", "number", "a", "b")
    back = sent.join(scored.where("NOT regular").drop("regular"), ["a", "b"]).select("slice", "number", "n", "best")
    rows = parts.where("doc_ids IS NOT NULL").select(F.col("slice").alias("of_slice"), "doc_ids", *BLOBS)
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
    schema = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in names), ("groups_sha256", pa.string())])

    def per_document(back: pa.Table, rows: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor()
        n, best = np.zeros(back.num_rows, np.int64), np.zeros(back.num_rows, np.int64)
        number = back.column("number").to_numpy()
        n[number], best[number] = back.column("n").to_numpy(), back.column("best").to_numpy().astype(np.int64)
        out = []
        for row in rows.to_pylist():
            blobs = {k: unpack.decompress(row[k]) for k in BLOBS}
            figures = np.frombuffer(blobs["figures"], "<i8").reshape(3, -1)
            size = figures.shape[1]
            sums = np.zeros((2, size), np.int64)
            for kind, by in (("regular", (vector_best, vector_n)), ("irregular", (best, n))):
                doc, at, times = _unpack_codes(blobs[kind])
                for total, values in zip(sums, by):
                    np.add.at(total, doc, values[at] * times)
            columns = [row["doc_ids"], figures[0], figures[1], figures[2], figures[2], sums[0], sums[1], blobs["hashes"].decode().split(",")]
            out.append(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    kinds = f"doc_id long, {', '.join(f'{n} long' for n in names)}, groups_sha256 string"
    return back.groupBy("slice").cogroup(rows.groupBy("of_slice")).applyInArrow(per_document, kinds)


def op11_token_alignment(spark, sf_dir: str) -> DataFrame:
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: SQL has no tokenizers; tests hold every column against whole texts coded by the libraries.
ORACLE_SQL: dict = {}
QUERIES = {"op11_token_alignment": op11_token_alignment}
