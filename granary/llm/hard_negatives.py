"""Hard negatives by a secondary sort.

Some rows are anchors. An anchor's positives are the rows of its label that
score highest with it; each positive opens a window of scores below its own, and
the best rows of other labels within the window are its hard negatives.

All anchors meet all rows in blocks: cells of some thousand rows and anchors,
whose scores are one matrix product. A cell sends, for each anchor, what can
still matter when the scores of all cells are known (see ``_worth_sending``).
Each score travels as one binary key of (anchor, descending score, whether it
is a negative, id). One shuffle deals the keys out by anchor and sorts them, and a
streaming iterator passes over the sorted keys: the first rows of the same label
open windows, rows of other labels fall into those that are open, and a window
that is full or left is emitted. The iterator holds the open windows of one
anchor, not its rows.

Scores are inner products of whole numbers; vectors of different length are
compared as if the shorter one ended in zeros; sums wrap around at 64 bits.

Defined results: rows with a null id, label, vector or component, or a component
that is not finite, take no part; every other row counts on its own, also if it
repeats another or shares its id, so that each of two anchors with one id has
rows in the result; an anchor without positives has none; an empty table gives
no rows; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import shuffle_parts, stage

#: Rows and anchors of a cell, the least rows that it should have, and scores computed at a time.
CELL_ROWS, CELL_ANCHORS, LEAST_ROWS = 1 << 13, 1 << 11, 1 << 10
SCORES_AT_ONCE = 1 << 21
KEY = np.dtype([("anchor", ">u8"), ("below", ">u8"), ("other", "u1"), ("id", ">u8")])
SIGN = np.uint64(1 << 63)
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def usable(rows: DataFrame, vec_id: str = "vec_id", label: str | Column = "label", vector: str = "embedding", scale: float = 256.0) -> DataFrame:
    """uid, vec_id, label, vector (whole numbers): the rows that take part, as a table that tells each of them."""
    x = F.transform(F.col(vector), lambda x: x.cast("double"))
    finite = F.forall(x, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(x, lambda x: F.floor(x * scale).cast("long"))
    label = F.col(label) if isinstance(label, str) else label
    kept = rows.where(F.col(vec_id).isNotNull() & F.col(vector).isNotNull() & finite).select(F.col(vec_id).cast("long").alias("vec_id"), label.alias("label"), whole.alias("vector"))
    # The numbers are written out at once: later reads see the same ones.
    return stage(kept.where("label is not null").withColumn("uid", F.monotonically_increasing_id()), "vectors")


def _matrix(vectors: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows, filled up with zeros."""
    flat = vectors.combine_chunks()
    n = flat.value_lengths().to_numpy()
    out = np.zeros((len(n), width), np.int64)
    at = np.arange(width)
    out[at < n[:, None]] = flat.flatten().to_numpy()
    return out


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T in 64-bit whole numbers: through floating point where that is exact."""
    bound = float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(b.astype(float)).max(initial=0)) * a.shape[1]
    return np.rint(a.astype(float) @ b.astype(float).T).astype(np.int64) if bound < 2**52 else a @ b.T


def _runs_before(*sorted_columns: np.ndarray) -> np.ndarray:
    """For each entry how many entries before it have the same values in all columns."""
    n = len(sorted_columns[0])
    new = np.zeros(n, bool)
    for c in sorted_columns:
        new[1:] |= c[1:] != c[:-1]
    new[:1] = True
    at = np.arange(n)
    return at - np.maximum.accumulate(np.where(new, at, 0))


def _worth_sending(scores: np.ndarray, same: np.ndarray, itself: np.ndarray, ids: np.ndarray, positives: int, negatives: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, is a negative) of the scores of a cell that may be in the result.

    The cell's best ``positives`` rows of the label hold all that are among the
    best of all cells. Negative scores can be in no window. The last positive of
    all cells scores no less than the cell's last one, so windows end at ``high``
    hundredths of that or above it: of the cell's negatives below that end, only
    the best few can be a window's best. Of equal scores, only those with the
    smallest ids can be.
    """
    n_anchors, n_rows = scores.shape
    by_score = np.lexsort((np.broadcast_to(ids, scores.shape), -scores), axis=1)
    anchor = np.repeat(np.arange(n_anchors), n_rows)
    row = by_score.ravel()
    value, is_same, self_ = scores[anchor, row], same[anchor, row], itself[anchor, row]
    at = np.flatnonzero(is_same & ~self_)
    first = _runs_before(anchor[at]) < positives
    kept_same = at[first]
    count = np.bincount(anchor[kept_same], minlength=n_anchors)
    last = np.full(n_anchors, np.iinfo(np.int64).max)
    np.minimum.at(last, anchor[kept_same], value[kept_same])
    at = np.flatnonzero(~is_same & (value >= 0))
    at = at[_runs_before(anchor[at], value[at]) < negatives]
    # Floating point only decides what is sent in vain, never what is left out: the bound is lowered.
    end = np.where(count >= positives, np.maximum(last, 0) * (high / 100) * (1 - 1e-9) - 1, -np.inf)
    under = value[at] <= end[anchor[at]]
    low = at[under]
    kept_low = low[_runs_before(anchor[low]) < negatives]
    kept_other = np.concatenate([at[~under], kept_low])
    where = np.concatenate([kept_same, kept_other])
    return anchor[where], row[where], np.arange(len(where)) >= len(kept_same)


def _cell(anchors: pa.Table, rows: pa.Table, positives: int, negatives: int, high: int) -> Iterator[pa.RecordBatch]:
    width = max([0, *(t.column("vector").combine_chunks().value_lengths().to_numpy().max(initial=0) for t in (anchors, rows))])
    a, b = _matrix(anchors.column("vector"), int(width)), _matrix(rows.column("vector"), int(width))
    a_uid, b_uid, a_id, b_id, a_label, b_label = (t.column(c).to_numpy() for c in ("uid", "vec_id", "label") for t in (anchors, rows))
    step = max(1, SCORES_AT_ONCE // max(1, len(b)))
    for k in range(0, len(a), step):
        own = slice(k, k + step)
        scores = _product(a[own], b)
        i, j, other = _worth_sending(scores, a_label[own, None] == b_label, a_uid[own, None] == b_uid, b_id, positives, negatives, high)
        keys = np.empty(len(i), KEY)
        keys["anchor"] = a_uid[own][i].view(np.uint64) ^ SIGN
        keys["below"] = ~(scores[i, j].view(np.uint64) ^ SIGN)
        keys["other"] = other
        keys["id"] = b_id[j].view(np.uint64) ^ SIGN
        blob = pa.FixedSizeBinaryArray.from_buffers(pa.binary(KEY.itemsize), len(keys), [None, pa.py_buffer(keys.tobytes())])
        yield pa.RecordBatch.from_arrays([pa.array(a_uid[own][i]), pa.array(a_id[own][i]), blob.cast(pa.binary())], ["uid", "anchor_id", "key"])


def score_keys(vectors: DataFrame, anchors: DataFrame, positives: int, negatives: int, high: int) -> DataFrame:
    """uid, anchor_id, key: packed scores of all anchors with all rows that can matter; cells are groups of bounded size."""
    spark = vectors.sparkSession
    n, m = vectors.count(), anchors.count()
    row_parts = max(1, -(-n // CELL_ROWS), min(shuffle_parts(spark), n // LEAST_ROWS))
    anchor_parts = max(1, -(-m // CELL_ANCHORS))
    own = lambda df, parts: F.pmod(F.xxhash64(df["uid"]), F.lit(parts)).cast("int")
    all_of = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    columns = ("uid", "vec_id", "label", "vector")
    rows = vectors.select(own(vectors, row_parts).alias("r"), all_of(anchor_parts).alias("q"), *columns)
    heads = anchors.select(own(anchors, anchor_parts).alias("q"), all_of(row_parts).alias("r"), *columns)
    schema = pa.schema([("uid", pa.int64()), ("anchor_id", pa.int64()), ("key", pa.binary())])

    def cell(a: pa.Table, b: pa.Table) -> pa.Table:
        return pa.Table.from_batches(_cell(a, b, positives, negatives, high) if a.num_rows and b.num_rows else [], schema)

    return heads.groupBy("r", "q").cogroup(rows.groupBy("r", "q")).applyInArrow(cell, "uid long, anchor_id long, key binary")


class Windows:
    """The open windows of the anchor whose keys pass by, highest score first."""

    def __init__(self, positives: int, negatives: int, low: int, high: int):
        self.positives, self.negatives, self.low, self.high = positives, negatives, low, high
        self.anchor = None
        self.opened = 0
        self.open: list[list] = []
        self.out: list[tuple] = []

    def pass_by(self, anchor: int, anchor_id: int, score: int, other: bool, vec_id: int) -> None:
        if anchor != self.anchor:
            self.anchor, self.opened, self.open = anchor, 0, []
        if not other:
            if self.opened < self.positives:
                self.opened += 1
                if score >= 0:  # below zero, a window ends before it begins
                    self.open.append([vec_id, score, 0])
            return
        closed = False
        for window in self.open:
            positive_id, positive_score, n = window
            if 100 * score <= self.high * positive_score:
                if 100 * score < self.low * positive_score:
                    window[2] = self.negatives
                else:
                    window[2] = n + 1
                    self.out.append((anchor_id, positive_id, n + 1, vec_id, positive_score, score))
                closed |= window[2] >= self.negatives
        if closed:
            self.open = [w for w in self.open if w[2] < self.negatives]

    def take(self) -> pa.RecordBatch:
        kinds = [pa.int32() if c == "rank int" else pa.int64() for c in RESULT.split(", ")]
        columns = zip(*self.out) if self.out else [()] * len(kinds)
        self.out = []
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [c.split()[0] for c in RESULT.split(", ")])


def mine(vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """RESULT: for each anchor and positive, the best rows of other labels whose scores are ``low`` to ``high`` hundredths of the positive's.

    ``vectors`` and ``anchors`` are tables of ``usable`` rows, the anchors some of the vectors.
    """
    keys = score_keys(vectors, anchors, positives, negatives, high)
    ordered = keys.repartition(shuffle_parts(vectors.sparkSession), "uid").sortWithinPartitions("key")

    def run(batches):
        windows = Windows(positives, negatives, low, high)
        for batch in batches:
            packed = np.frombuffer(b"".join(batch.column("key").to_pylist()), KEY)
            score = (~packed["below"].astype(np.uint64) ^ SIGN).view(np.int64).tolist()
            vec_id = (packed["id"].astype(np.uint64) ^ SIGN).view(np.int64).tolist()
            for row in zip(packed["anchor"].tolist(), batch.column("anchor_id").to_pylist(), score, packed["other"].tolist(), vec_id):
                windows.pass_by(*row)
            yield windows.take()

    return ordered.mapInArrow(run, RESULT)


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    label = F.expr("CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE CAST(label AS BIGINT) END")
    vectors = usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), label=label)
    return mine(vectors, vectors.where("vec_id % 50 = 0"))


ORACLE_SQL = {
    "op12_hard_negatives": """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label::BIGINT END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""
}
QUERIES = {"op12_hard_negatives": op12_hard_negatives}
