"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over up to SPAN consecutive words: it hashes the words
at the positions it looks at and ignores the others, so a substituted word at
an ignored position still hits. Test items and training texts are hashed under
all masks and joined on the hash. Each hit fixes an alignment (document
position minus item position); along it the item's and the document's words
are compared one to one. A pair overlaps if some stretch of an alignment is
long and pure enough, or the whole alignment holds nearly the whole item.

No placement of substituted words escapes the masks: of 14, 17, 20 or 24
aligned words with 4, 5, 6 or 7 others among them, wherever these are, some
mask hits; an overlap of 13 words or more has a part of 13 to 25 words with at
most three others in ten, which is one of these or lies in one. SHORT_MASKS do
the same for 7 words with 2 others and 10 with 3, and so for items of 6 to 12.

Training windows reach the join only if a filter of FILTER_BITS bits, built
from the test hashes and of that size whatever the tables, may know their
hash (two bits of it); the join itself is Spark's. Per document and diagonal one alignment is
checked, whatever the number of its hits.

Words are runs of ASCII letters, digits and non-ASCII characters in lower case
(A-Z). Defined results: null and empty texts, and items under MIN_WORDS words,
overlap with nothing; items of MIN_WORDS words are sought word for word; of an
alignment the best-scoring stretch is reported if it qualifies, else the
longest that does, else the whole; repeated rows of one doc_id give one row with the best overlap; an empty
table gives no rows; other columns play no part; texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.common import ALNUM_WORDS, LOWER, U64, hash_words, mix, slices, stage

SPAN = 12
#: Fixed masks of at most SPAN words: 1 looks at a word, 0 ignores it.
MASKS = ("111011", "1100001011", "11010011", "1001111", "1110101", "10001111")
#: Those for items of fewer than LONG_ITEM words, and for items of MIN_WORDS.
SHORT_MASKS = ("10111", "111001", "1001011", "1100101", "1111", "11101")
LONG_ITEM = 13
MIN_WORDS = 5
FILTER_BITS = 1 << 24
#: An overlap: this many aligned words at this purity, or this share of the item.
LEAST_WORDS, PURITY, ITEM_SHARE = 13, 0.8, 0.7
#: What a differing word costs when the best stretch is sought.
MISS_COST = 3


def _masked(words: np.ndarray, mask: str, seed: int) -> np.ndarray:
    n = len(words) - len(mask) + 1
    out = np.zeros(max(n, 0), U64)
    if n > 0:
        for k, use in enumerate(mask):
            if use == "1":
                out *= U64(0xD6E8FEB86659FD93)
                out += words[k : k + n]
    return mix(out ^ U64((seed + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))


def masks_for(n: int) -> list[tuple[str, int]]:
    """The masks for items of n words, each with the number that sets its hashes apart."""
    if n >= LONG_ITEM:
        return [(m, k) for k, m in enumerate(MASKS)]
    if n > MIN_WORDS:
        return [(m, 100 + k) for k, m in enumerate(SHORT_MASKS)]
    return [("1" * n, 200)] if n == MIN_WORDS else []


def item_words(items: DataFrame) -> DataFrame:
    """item_id, words: hashes of each item's words."""

    def run(batches):
        for batch in batches:
            for at, to, texts in slices(batch, "text"):
                hashes, first = hash_words(texts, ALNUM_WORDS, LOWER)
                words = hashes.view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("item_id").slice(at, to - at), pa.array([words[a:b] for a, b in zip(first, first[1:])], pa.list_(pa.int64()))],
                    ["item_id", "words"],
                )

    return items.select("item_id", "text").mapInArrow(run, "item_id long, words array<long>")


def item_seeds(words: DataFrame) -> DataFrame:
    """seed, item_id, item_pos: an item's seeds under all masks for its length."""

    def run(batches):
        for batch in batches:
            seeds, ids, places = [], [], []
            for item_id, own in zip(batch.column("item_id"), batch.column("words")):
                own = np.array(own.as_py(), np.int64).view(U64)
                for mask, k in masks_for(len(own)):
                    got = _masked(own, mask, k)
                    seeds.append(got.view(np.int64))
                    ids += [item_id.as_py()] * len(got)
                    places.append(np.arange(len(got)))
            if seeds:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(seeds)), pa.array(ids, pa.int64()), pa.array(np.concatenate(places).astype(np.int64))],
                    ["seed", "item_id", "item_pos"],
                )

    return words.mapInArrow(run, "seed long, item_id long, item_pos long")


def _regions(hits: np.ndarray, reach: int, n: int) -> Iterator[tuple[int, int, int, int]]:
    """Hit places in runs whose surroundings overlap: (first hit, end hit, first word, end word)."""
    cuts = [0, *(np.flatnonzero(np.diff(hits) > 2 * reach) + 1), len(hits)]
    for a, b in zip(cuts, cuts[1:]):
        if a < b:
            yield a, b, max(0, int(hits[a]) - reach), min(n, int(hits[b - 1]) + SPAN + reach)


def candidate_regions(docs: DataFrame, known: np.ndarray, plan: list[tuple[str, int]], reach: int) -> DataFrame:
    """doc_id, start, words, hits(seed, pos): parts of documents around windows that the filter may know."""
    slots = U64(FILTER_BITS - 1)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(np.packbits(known, bitorder="little"))

    def run(batches):
        bits = np.unpackbits(shared.value, bitorder="little").astype(bool)
        for batch in batches:
            for at, to, texts in slices(batch, "text"):
                words, first = hash_words(texts, ALNUM_WORDS, LOWER)
                seeds, places = [np.empty(0, U64)], [np.empty(0, np.int64)]
                for mask, k in plan:
                    got = _masked(words, mask, k)
                    may = np.flatnonzero(bits[(got & slots).astype(np.int64)])
                    may = may[bits[((got[may] >> U64(32)) & slots).astype(np.int64)]]
                    doc = np.searchsorted(first, may, side="right") - 1
                    may = may[may + len(mask) <= first[doc + 1]]
                    seeds.append(got[may])
                    places.append(may)
                seeds, places = np.concatenate(seeds), np.concatenate(places)
                order = np.argsort(places, kind="stable")
                seeds, places = seeds[order].view(np.int64), places[order]
                ids = batch.column("doc_id").slice(at, to - at)
                rows = []
                for d in np.unique(np.searchsorted(first, places, side="right") - 1):
                    a, b = np.searchsorted(places, [first[d], first[d + 1]])
                    own = places[a:b] - first[d]
                    for p, q, start, end in _regions(own, reach, int(first[d + 1] - first[d])):
                        hits = [{"seed": int(s), "pos": int(x)} for s, x in zip(seeds[a + p : a + q], own[p:q])]
                        rows.append((ids[int(d)].as_py(), start, words[first[d] + start : first[d] + end].view(np.int64), hits))
                if rows:
                    cols = list(zip(*rows))
                    hit = pa.list_(pa.struct([("seed", pa.int64()), ("pos", pa.int64())]))
                    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), hit]
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], ["doc_id", "start", "words", "hits"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, start long, words array<long>, hits array<struct<seed:long,pos:long>>")


def best_stretch(same: np.ndarray) -> tuple[int, int]:
    """The stretch of an alignment with the highest score: 1 per equal word, -MISS_COST per other."""
    score = np.concatenate([[0], np.cumsum(np.where(same, 1, -MISS_COST))])
    low = np.minimum.accumulate(score)
    end = int(np.argmax(score - low))
    return int(np.argmin(score[: end + 1])), end


def longest_stretch(same: np.ndarray) -> tuple[int, int]:
    """The longest stretch of purity PURITY that starts and ends with an equal word; of equal ones the first."""
    starts, ends = np.flatnonzero(same), np.flatnonzero(same) + 1
    if not len(starts):
        return 0, 0
    # In hundredths, so that a stretch is pure enough where this does not fall from its start to its end.
    rise = np.concatenate([[0], np.cumsum(np.where(same, 100 - round(100 * PURITY), -round(100 * PURITY)))])
    low = np.minimum.accumulate(rise[starts])
    first = starts[np.searchsorted(-low, -rise[ends])]
    k = int(np.argmax(ends - first))
    return int(first[k]), int(ends[k])


def overlap(same: np.ndarray, n_item: int) -> tuple[int, int] | None:
    """The stretch of an alignment with an item of n_item words that makes it an overlap, if any does."""
    equal = np.flatnonzero(same)
    if not len(equal):
        return None
    least = max(MIN_WORDS, -(-round(100 * ITEM_SHARE) * n_item // 100))
    for p, q in (best_stretch(same), longest_stretch(same), (int(equal[0]), int(equal[-1]) + 1)):
        matched = int(same[p:q].sum())
        if matched >= least or (q - p >= LEAST_WORDS and 100 * matched >= round(100 * PURITY) * (q - p)):
            return p, q
    return None


def verified(candidates: DataFrame) -> DataFrame:
    """Compare the item's words with the document's along each candidate's diagonal."""

    def run(batches):
        for batch in batches:
            rows = []
            words_at, item_at = (batch.column(c).offsets.to_numpy() for c in ("words", "item_words"))
            all_words, all_items = (batch.column(c).values.to_numpy() for c in ("words", "item_words"))
            for k, (doc_id, item_id, diagonal, start) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "item_id", "diagonal", "start")))):
                words, item = all_words[words_at[k] : words_at[k + 1]], all_items[item_at[k] : item_at[k + 1]]
                a, b = max(0, start - diagonal), min(len(item), start + len(words) - diagonal)
                if a >= b:
                    continue
                same = words[a + diagonal - start : b + diagonal - start] == item[a:b]
                found = overlap(same, len(item))
                if found:
                    p, q = found
                    rows.append((doc_id, item_id, a + p + diagonal, a + q + diagonal, int(same[p:q].sum()), q - p, len(item)))
            if rows:
                names = ["doc_id", "item_id", "start", "end", "n_matched", "n_aligned", "item_words"]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)

    out = "doc_id long, item_id long, start long, end long, n_matched long, n_aligned long, item_words long"
    return candidates.mapInArrow(run, out)


def overlaps(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, start, end, n_matched, n_aligned, item_words: the best overlap of each pair.

    start and end count the document's words.
    """
    words = item_words(items).dropDuplicates(["item_id", "words"])
    seeds = item_seeds(words).distinct()
    parts = F.array(F.col("seed"), F.shiftrightunsigned("seed", 32))
    slot = F.explode(F.transform(parts, lambda x: x.bitwiseAND(F.lit(FILTER_BITS - 1).cast("long")).cast("int")))
    # At most FILTER_BITS numbers and three kinds of lengths, however many items there are.
    slots = seeds.select(slot.alias("slot")).distinct().toPandas()["slot"].to_numpy()
    known = np.zeros(FILTER_BITS, bool)
    known[slots] = True
    sizes = words.select(F.size("words").alias("n"))
    kind = F.when(F.col("n") >= LONG_ITEM, LONG_ITEM).when(F.col("n") > MIN_WORDS, LONG_ITEM - 1).otherwise(MIN_WORDS)
    kinds = sizes.where(F.col("n") >= MIN_WORDS).select(kind.alias("n")).distinct().collect()
    plan = [mask for r in kinds for mask in masks_for(r["n"])]
    reach = sizes.agg(F.max("n")).first()[0] or 0
    regions = stage(candidate_regions(docs, known, plan, reach), "regions")
    hits = regions.select("doc_id", "start", F.explode("hits").alias("hit"))
    hits = hits.select("doc_id", "start", F.col("hit.seed").alias("seed"), F.col("hit.pos").alias("pos"))
    slim = hits.join(seeds, "seed")
    diagonals = slim.select("doc_id", "start", "item_id", (F.col("pos") - F.col("item_pos")).alias("diagonal")).distinct()
    spots = regions.select(F.col("doc_id").alias("r_doc"), F.col("start").alias("r_start"), "words")
    candidates = diagonals.join(spots, F.col("doc_id").eqNullSafe(F.col("r_doc")) & (F.col("start") == F.col("r_start")))
    own = words.select(F.col("item_id").alias("i_item"), F.col("words").alias("item_words"))
    candidates = candidates.join(own, F.col("item_id").eqNullSafe(F.col("i_item")))
    found = verified(candidates.select("doc_id", "item_id", "diagonal", "start", "words", "item_words"))
    rank = Window.partitionBy("doc_id", "item_id").orderBy(F.desc("n_matched"), "n_aligned", "start", "end", "item_words")
    return found.withColumn("rank", F.row_number().over(rank)).where("rank = 1").drop("rank")


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents without an overlap, with their own columns.

    Each row goes by its doc_id and text together, so rows that share a doc_id,
    or have none, are judged one by one.
    """
    marked = docs.select("*", F.xxhash64("doc_id", "text").alias("_row"))
    bad = overlaps(marked.select(F.col("_row").alias("doc_id"), "text"), items).select(F.col("doc_id").alias("_row")).distinct()
    kept = marked.join(bad.hint("shuffle_hash"), "_row", "left_anti")
    return kept.select(*[kept[c] for c in docs.columns])


def op5_decontaminate(spark, sf_dir: str) -> DataFrame:
    return overlaps(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: SQL cannot align words around masked hits in reasonable time; tests hold the result against brute force.
ORACLE_SQL: dict = {}
QUERIES = {"op5_decontaminate": op5_decontaminate}
