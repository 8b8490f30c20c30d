"""Self-join of documents by Jaccard similarity of word n-grams, with several global orders.

A document's set holds its distinct SIZE-word shingles. Two sets with Jaccard
similarity t share a token among the first (1 - t) n + 1 of each, whatever
global order the tokens are put in (prefix filter). Three orders are used and
a pair must pass under each:

1. By hash, ascending, with prefixes longer by a share EXTRA: so each document
   must share several prefix tokens, not one, with others (any others). This
   is counted per document, no pairs are made, and most documents end here.
2. By rarity among the documents that are left, rarest first. Tokens of one
   document take up prefix places but are not indexed. Pairs come from this
   index, if from their token on both sets have enough tokens left.
3. By hash, descending. A pair from order 2 stays a candidate only if the two
   sets' prefixes under order 1 and those under order 3 meet too; prefixes
   travel as 32-bit numbers, so this filter comes before any text is fetched.

Documents with equal sets are one. Of the documents under an index token only
the one chosen as pivot is compared with the others; links found so join into
components, and only tokens whose documents are still in several components
are taken up again: with other pivots, at last with all pairs across
components. So large groups of copies cost about a comparison per document and
token, and yet no link between components is missed. This is for components
alone: ``links`` gives every pair of similar distinct sets, ``link_counts`` how
many other documents each one is similar to.

Sets stand as 64-bit hashes of shingles, and documents with equal sets are told
by a 64-bit hash of the set.

A token that many sets of a batch hold goes on as one row that says so, and is
joined in several salted parts, so that a hot token is not one task's work.
Beyond GROUP_TOKENS, slices of texts are dealt to groups, and what a group's
slices say is joined to one such row before the groups meet: a token that a few
sets of every slice hold sends at most OFTEN rows per group to one bucket.

Defined results: null, empty and blank texts have an empty set and link with
nothing; rows with equal doc_ids are documents of their own; rows without
doc_id rank last, and a component of such rows alone has no id; an empty table gives no rows; other columns play
no part. Texts are read whole.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from granary.llm.common import LOWER, U64, bucket_count, hash_words, identified, in_runs, mix, pack, packed_schema, per_bucket, slices, stage, unpack, window_hashes
from granary.llm.components import joined_components

SIZE = 5
#: The threshold in hundredths, and how much longer the prefixes of order 1 are.
PERCENT = 75
EXTRA = 0.1
PIVOT_ROUNDS = 2
#: Sets with a token from which its frequency counts no further, and parts in which such a token is joined.
OFTEN = 64
SALTS = 32
#: Sets that meet in one cell of a token, and sets to a row of the grid in which all links are verified.
CELL_SETS = 2000
BLOCK_SETS = 4000
#: Tokens to a row of that grid, and tokens of all sets to a group in which frequencies are counted first.
BLOCK_TOKENS = 1 << 23
GROUP_TOKENS = 1 << 32


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Per text its sorted distinct shingle hashes."""
    words, first = hash_words(texts, fold=LOWER)
    grams = window_hashes(words, SIZE)
    out = []
    for a, b in zip(first, first[1:]):
        if b - a >= SIZE:
            out.append(np.unique(grams[a : b - SIZE + 1]))
        elif b > a:
            out.append(window_hashes(words[a:b], int(b - a), seed=int(b - a)))
        else:
            out.append(np.empty(0, U64))
    return out


def set_key(tokens: np.ndarray) -> int:
    return int(mix(np.array([np.add.reduce(mix(tokens ^ U64(0x5851F42D4C957F2D)))], U64)).view(np.int64)[0]) if len(tokens) else 0


def least_shared(n):
    """How many tokens a set of n shares with a similar one at least."""
    return -(-PERCENT * n // 100)


def prefix_length(n: int) -> int:
    return n - least_shared(n) + 1


def extra_length(n: int) -> int:
    return min(n, n - least_shared(n) + max(1, int(EXTRA * n)))


def extra_shared(n: int) -> int:
    """Prefix tokens of order 1 that a set must share: those that the smallest similar set's longer prefix assures."""
    return max(1, int(EXTRA * least_shared(n)))


def outline(rows: DataFrame) -> DataFrame:
    """doc_id, void, oid, n (set size), key (hash of the set)."""

    def run(batches):
        for batch in batches:
            for at, to, texts in slices(batch, "text"):
                sets = shingle_sets(texts)
                ids = [batch.column(n).slice(at, to - at) for n in ("doc_id", "void", "oid")]
                yield pa.RecordBatch.from_arrays(
                    [*ids, pa.array([len(s) for s in sets], pa.int64()), pa.array([set_key(s) for s in sets], pa.int64())],
                    ["doc_id", "void", "oid", "n", "key"],
                )

    return rows.mapInArrow(run, "doc_id long, void boolean, oid long, n long, key long")


# Tokens and keys travel as their upper 48 bits where a chance collision only
# lets a document through to the next filter.


def _short(values: np.ndarray, name: str) -> dict[str, np.ndarray]:
    high = values.view(U64) >> U64(16)
    return {f"{name}_lo": high.astype(np.uint32), f"{name}_hi": (high >> U64(32)).astype(np.uint16)}


def _long(got: dict[str, np.ndarray], name: str) -> np.ndarray:
    return (got[f"{name}_hi"].astype(U64) << U64(32)) | got[f"{name}_lo"]


SHORT = {"token_lo": np.uint32, "token_hi": np.uint16, "key_lo": np.uint32, "key_hi": np.uint16}


def _runs(values: np.ndarray) -> np.ndarray:
    """Starts of runs of equal values, and the end."""
    if not len(values):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1, [len(values)]])


def shared_prefixes(docs: DataFrame, n_tokens: int) -> DataFrame:
    """short (upper 48 bits of key), n_shared: how many of a set's prefix tokens of order 1 are in other sets' prefixes.

    Tokens that several sets of a batch hold are counted there; of each of them
    one row goes on to tell other batches. Counts of copies of a set may come
    out larger, never smaller.
    """
    spark = docs.sparkSession
    buckets = bucket_count(spark, int((1 - PERCENT / 100 + EXTRA) * n_tokens))
    totals = bucket_count(spark, n_tokens // 500)

    def run(batches):
        for batch in batches:
            for _, _, texts in slices(batch, "text"):
                sets = {set_key(s): s[: extra_length(len(s))] for s in shingle_sets(texts) if len(s)}
                if not sets:
                    continue
                tokens = np.concatenate(list(sets.values())) >> U64(16)
                keys = np.repeat(np.array(list(sets), np.int64), [len(s) for s in sets.values()])
                order = np.argsort(tokens, kind="stable")
                tokens, keys = tokens[order], keys[order]
                told = in_runs(tokens)
                ask = ~told | np.concatenate([[True], tokens[1:] != tokens[:-1]])
                rows = _short(tokens[ask] << U64(16), "token") | _short(keys[ask], "key") | {"told": told[ask].astype(np.uint8)}
                yield pack((tokens[ask] % U64(buckets)).astype(np.int64), rows)
                if told.any():  # below zero: counted already; ``told`` has the count's bytes
                    key, n = np.unique(keys[told], return_counts=True)
                    short = key.view(U64) >> U64(16)
                    none = np.zeros(len(key), np.uint64)
                    yield pack(-1 - (short % U64(totals)).astype(np.int64), _short(none, "token") | _short(key, "key") | {"told": n.astype("<u4")})

    def count(batches):
        if batches[0].column("bucket")[0].as_py() < 0:
            got = unpack(batches, {**SHORT, "told": np.uint32})
            key, n = _long(got, "key"), got["told"]
            order = np.lexsort((n, key))
            key, n = key[order], n[order]
            last = np.concatenate([key[1:] != key[:-1], [True]])  # of a set's copies in several batches the most
            yield pack((key[last] % U64(totals)).astype(np.int64), {"key": key[last], "n": n[last]})
            return
        got = unpack(batches, {**SHORT, "told": np.uint8})
        token, key, told = _long(got, "token"), _long(got, "key"), got["told"]
        order = np.lexsort((told, key, token))
        token, key, told = token[order], key[order], told[order]
        stay = np.concatenate([(token[1:] != token[:-1]) | (key[1:] != key[:-1]), [True]])
        token, key, told = token[stay], key[stay], told[stay]
        shared = (in_runs(token) | np.isin(token, token[told == 1])) & (told == 0)
        shared, n = np.unique(key[shared], return_counts=True)
        if len(shared):
            yield pack((shared % U64(totals)).astype(np.int64), {"key": shared, "n": n.astype(np.uint32)})

    def total(batches):
        got = unpack(batches, {"key": np.uint64, "n": np.uint32})
        key, place = np.unique(got["key"], return_inverse=True)
        n = np.bincount(place, got["n"], len(key)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], ["short", "n_shared"])

    packed = docs.select("text").mapInArrow(run, packed_schema(*SHORT, "told"))
    counted = per_bucket(packed, count, packed_schema("key", "n"))
    return per_bucket(counted, total, "short long, n_shared long")


def _numbers(tokens: np.ndarray) -> np.ndarray:
    return tokens.astype(np.uint32).view(np.int32)


def fetch(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """key, n, text, lowest, highest of the sets in ``wanted`` (void, oid, key, n).

    ``lowest`` and ``highest``: the set's prefixes under orders 1 and 3, as the tokens' low 32 bits.
    """
    prefix = pa.list_(pa.int32())

    def run(batches):
        for batch in batches:
            keep, lowest, highest = [], [], []
            wanted = batch.column("key").to_pylist()
            for _, _, texts in slices(batch, "text"):
                for tokens in shingle_sets(texts):
                    keep.append(set_key(tokens) == wanted[len(keep)])
                    if keep[-1]:
                        p = prefix_length(len(tokens))
                        lowest.append(_numbers(tokens[:p]))
                        highest.append(_numbers(tokens[-p:]))
            part = batch.filter(pa.array(keep, pa.bool_()))
            arrays = [*(part.column(n) for n in ("key", "n", "text")), pa.array(lowest, prefix), pa.array(highest, prefix)]
            yield pa.RecordBatch.from_arrays(arrays, ["key", "n", "text", "lowest", "highest"])

    found = rows.select("void", "oid", "text").join(wanted.hint("shuffle_hash"), ["void", "oid"]).select("key", "n", "text")
    return found.mapInArrow(run, "key long, n long, text string, lowest array<int>, highest array<int>")


def rarity_index(kept: DataFrame, n_tokens: int) -> DataFrame:
    """token (upper 48 bits), key, n, left, hot: prefix tokens of order 2 that several sets hold.

    ``left`` counts the set's tokens from this one on in that order; ``hot``
    tokens are those of OFTEN sets or more, whose order goes by hash. Tokens of
    OFTEN sets in a batch, or in a group of batches, are known to be hot there.
    """
    spark = kept.sparkSession
    buckets = bucket_count(spark, n_tokens)
    groups = max(1, n_tokens // GROUP_TOKENS)
    per_group = max(1, buckets // groups)
    sent = {"token_lo": np.uint32, "token_hi": np.uint16, "key": np.int64, "n": np.uint32, "often": np.uint8}

    def told(token, key, n, hot, send, group):
        """Packed rows of ascending tokens: of a hot one a row that says so, of others all; and by key those of ``send``."""
        ask = ~hot
        ask[_runs(token)[:-1]] = True
        rows = lambda own, mark: _short(token[own] << U64(16), "token") | {"key": key[own], "n": n[own], "often": np.where(mark[own], OFTEN, 0).astype(np.uint8)}
        place = token[ask] % U64(buckets) if group is None else token[ask] % U64(per_group) + U64(group * per_group)
        yield pack(place.astype(np.int64), rows(ask, hot))
        if send.any():
            yield pack(-1 - (key[send].view(U64) % U64(buckets)).astype(np.int64), rows(send, hot))

    def tokens(batches):
        for batch in batches:
            for at, to, texts in slices(batch, "text"):
                sets = shingle_sets(texts)
                sizes = [len(s) for s in sets]
                token = np.concatenate(sets) >> U64(16)
                key = np.repeat(batch.column("key").slice(at, to - at).to_numpy(), sizes)
                n = np.repeat(np.array(sizes, np.uint32), sizes)
                order = np.argsort(token, kind="stable")
                token, key, n = token[order], key[order], n[order]
                cuts = _runs(token)
                hot = np.repeat(np.diff(cuts) >= OFTEN, np.diff(cuts))
                # The slice's group, by a key of its own, so that a slice that is made again goes to the same one.
                group = int(key.view(U64).min() % U64(groups)) if groups > 1 and len(key) else None
                yield from told(token, key, n, hot, hot, group)

    def gather(batches):
        """Within a group: tokens that its slices hold often enough together are hot from here on."""
        if batches[0].column("bucket")[0].as_py() < 0:
            yield from batches
            return
        got = unpack(batches, sent)
        token, key, n, known = _long(got, "token"), got["key"], got["n"], got["often"] == OFTEN
        order = np.lexsort((key, token))
        token, key, n, known = token[order], key[order], n[order], known[order]
        sizes = np.diff(_runs(token))
        hot = np.repeat(sizes >= OFTEN, sizes) | np.isin(token, token[known])
        yield from told(token, key, n, hot, hot & ~known, None)

    def rate(batches):
        got = unpack(batches, sent)
        token, key, n, often = _long(got, "token"), got["key"], got["n"], got["often"]
        if batches[0].column("bucket")[0].as_py() >= 0:
            order = np.lexsort((key, token))
            token, key, n, often = token[order], key[order], n[order], often[order]
            cuts = _runs(token)
            sizes = np.diff(cuts)
            told = np.isin(token, token[often == OFTEN])
            most = np.where(told, OFTEN, np.minimum(np.repeat(sizes, sizes), OFTEN))
            keep = (most > 1) & (often != OFTEN)
            token, key, n, often = token[keep], key[keep], n[keep], most[keep].astype(np.uint8)
        if len(token):
            yield pack((key.view(U64) % U64(buckets)).astype(np.int64), _short(token << U64(16), "token") | {"key": key, "n": n, "often": often})

    def choose(batches):
        got = unpack(batches, sent)
        token = _long(got, "token")
        order = np.lexsort((token, got["often"], got["key"]))
        token, key, n, often = token[order], got["key"][order], got["n"][order].astype(np.int64), got["often"][order]
        cuts = _runs(key)
        sizes = np.diff(cuts)
        rank = np.arange(len(key)) - np.repeat(cuts[:-1], sizes)
        # Tokens of one document come first in this order: n - sizes of the prefix's places are theirs.
        room = n - least_shared(n) + 1 - (n - np.repeat(sizes, sizes))
        keep = rank < room
        left = np.repeat(sizes, sizes) - rank
        cols = [token[keep].view(np.int64), *(v[keep].astype(np.int64) for v in (key, n, left, often == OFTEN))]
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in cols], ["token", "key", "n", "left", "hot"])

    first = kept.select("key", "text").mapInArrow(tokens, packed_schema(*sent))
    if groups > 1:
        first = per_bucket(first, gather, packed_schema(*sent))
    second = per_bucket(first, rate, packed_schema(*sent))
    chosen = per_bucket(second, choose, "token long, key long, n long, left long, hot long")
    return chosen.withColumn("hot", F.col("hot") == 1)


def candidates(pairs: DataFrame, kept: DataFrame) -> DataFrame:
    """a, b of the pairs whose prefixes under orders 1 and 3 meet as well."""
    own = kept.select("key", "lowest", "highest")
    with_a = pairs.join(own.toDF("a", "lowest_a", "highest_a"), "a")
    both = with_a.join(own.toDF("b", "lowest_b", "highest_b"), "b")
    return both.where(F.arrays_overlap("lowest_a", "lowest_b") & F.arrays_overlap("highest_a", "highest_b")).select("a", "b")


def verify(pairs: DataFrame, kept: DataFrame) -> DataFrame:
    """a, b of the pairs that are similar."""

    def run(batches):
        for batch in batches:
            hits = []
            for at, to, left in slices(batch, "text_a"):
                right = [t.as_py() for t in batch.column("text_b").slice(at, to - at).cast(pa.large_string()).cast(pa.large_binary())]
                hits += map(similar, shingle_sets(left), shingle_sets(right))
            mask = pa.array(hits, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])

    with_a = pairs.join(kept.select(F.col("key").alias("a"), F.col("text").alias("text_a")), "a")
    with_b = with_a.join(kept.select(F.col("key").alias("b"), F.col("text").alias("text_b")), "b")
    return with_b.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sets of distinct tokens reach the threshold."""
    inter = len(np.intersect1d(x, y, True))
    return 100 * inter >= PERCENT * (len(x) + len(y) - inter)


def _fits(n_a: str, left_a: str, n_b: str, left_b: str):
    """Whether two sets whose first common token is this one can still share enough.

    A similar pair passes at its first common token, so this loses none.
    """
    return (100 + PERCENT) * F.least(F.col(left_a), F.col(left_b)) >= PERCENT * (F.col(n_a) + F.col(n_b))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _salt(index: DataFrame) -> DataFrame:
    return index.withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")).otherwise(0))


def _each_salt(tokens: DataFrame) -> DataFrame:
    """A row for each part in which a token is joined; hot ones have several."""
    parts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return tokens.withColumn("salt", F.explode(parts)).drop("hot")


def pivot_pairs(index: DataFrame, seed: int) -> DataFrame:
    """a, b: each token's pivot with the token's other documents of other components.

    The first pivots are the sets with the smallest share of rarer tokens: of
    sets that share one passage, or are edits of one text, such a set has the
    least of its own and is the most similar to all others. Later ones go by hash.
    """
    order = 1 - F.col("left") / F.col("n") if seed == 0 else F.xxhash64(F.lit(seed), "key")
    pivot = index.groupBy("token").agg(
        F.min(F.struct(order.alias("order"), F.col("key").alias("x"), F.col("n").alias("n_x"), F.col("left").alias("left_x"), F.col("component").alias("c_x"))).alias("pivot"),
        F.max("hot").alias("hot"),
    )
    pairs = _salt(index).join(_each_salt(pivot), ["token", "salt"])
    pairs = pairs.select(F.col("key").alias("y"), "n", "left", "component", "pivot.x", "pivot.n_x", "pivot.left_x", "pivot.c_x")
    return _ordered(pairs.where((F.col("component") != F.col("c_x")) & _fits("n", "left", "n_x", "left_x")))


def open_tokens(index: DataFrame, labels: DataFrame) -> DataFrame:
    """The index with its documents' components, of tokens that hold several components."""
    labelled = index.drop("component").join(labels.toDF("key", "component"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    many = labelled.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.max("hot").alias("hot"))
    many = many.where("low != high").select("token", "hot")
    return _salt(labelled).join(_each_salt(many), ["token", "salt"]).drop("salt")


def indexed(docs: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sets that pass order 1, with their texts, and their index under order 2; ``sets`` has void, oid, key, n of each distinct set."""
    rows = identified(docs)
    short = F.shiftrightunsigned("key", 16).alias("short")
    need = F.greatest(F.lit(1), F.floor(EXTRA * F.ceil(PERCENT * F.col("n") / 100))).cast("long")
    counted = shared_prefixes(rows, sets.agg(F.sum("n")).first()[0] or 0)
    wanted = sets.withColumn("short", short).join(counted, "short").where(F.col("n_shared") >= need).select("void", "oid", "key", "n")
    kept = stage(fetch(rows, wanted).dropDuplicates(["key"]), "kept")
    return kept, stage(rarity_index(kept, kept.agg(F.sum("n")).first()[0] or 0), "index")


def all_pairs(index: DataFrame) -> DataFrame:
    """a, b: all pairs under a token that fit, each once; of different components only, where the index has these.

    Sets meet in cells of a token and a class of sizes: those of similar sets
    are the same or next to each other. A cell of more than CELL_SETS is dealt
    to a square of smaller ones, so that a hot token is not one task's work.
    """
    # Classes are wider than the ratio of similar sets' sizes, so that rounding plays no part.
    size_class = F.floor(F.log(F.col("n")) / F.log(F.lit(100 / PERCENT + 0.01))).cast("int")
    component = "component" if "component" in index.columns else "key"
    own = index.select("token", "key", "n", "left", "hot", F.col(component).alias("part"), size_class.alias("class"))
    larger = own.withColumn("class", F.explode(F.array("class", F.col("class") - 1)))
    cells = larger.groupBy("token", "class").agg(F.ceil(F.count(F.lit(1)) / CELL_SETS).cast("int").alias("side"), F.max("hot").alias("hot"))
    cells = _each_salt(cells)
    place = F.pmod(F.xxhash64("key"), F.col("side")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("side") - 1))

    def rows(df: DataFrame, end: str) -> DataFrame:
        placed = _salt(df).join(cells, ["token", "class", "salt"])
        return placed.select("token", "class", "side", *(F.col(c).alias(f"{c}_{end}") for c in ("key", "n", "left", "part")), place.alias("own"))

    left = rows(own, "x").withColumnRenamed("own", "i").withColumn("j", every)
    right = rows(larger, "y").withColumnRenamed("own", "j").withColumn("i", every).drop("side")
    met = left.join(right, ["token", "class", "i", "j"])
    later = (F.col("n_x") < F.col("n_y")) | ((F.col("n_x") == F.col("n_y")) & (F.col("key_x") < F.col("key_y")))
    fit = met.where(later & (F.col("part_x") != F.col("part_y")) & _fits("n_x", "left_x", "n_y", "left_y"))
    return _ordered(fit.select(F.col("key_x").alias("x"), F.col("key_y").alias("y")))


def verify_in_blocks(pairs: DataFrame, kept: DataFrame) -> DataFrame:
    """a, b of the pairs that are similar, where a set may be in very many pairs.

    Pairs are dealt to the squares of a grid by both keys; a square gets each of
    its sets' texts once, not once per pair. The grid is as fine as the number of
    sets and that of their tokens ask, so long texts are not too many to a square.
    """
    n_sets, n_tokens = kept.agg(F.count(F.lit(1)), F.sum("n")).first()
    side = max(4, -(-n_sets // BLOCK_SETS), -(-(n_tokens or 0) // BLOCK_TOKENS))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(side)).cast("int")
    placed = pairs.select("a", "b", place("a").alias("i"), place("b").alias("j"))
    needed = placed.select(F.col("a").alias("key"), "i", "j").union(placed.select("b", "i", "j")).distinct()
    texts = needed.join(kept.select("key", "text"), "key").select("text", F.col("key").alias("own"), F.col("i").alias("row"), F.col("j").alias("column"))

    def run(own, texts):
        sets = {}
        for batch in texts.select(["own", "text"]).to_batches():
            for at, to, part in slices(batch, "text"):
                sets.update(zip(batch.column("own").slice(at, to - at).to_pylist(), shingle_sets(part)))
        hits = [similar(sets[a], sets[b]) for a, b in zip(own.column("a").to_pylist(), own.column("b").to_pylist())]
        return own.select(["a", "b"]).filter(pa.array(hits, pa.bool_()))

    return placed.groupBy("i", "j").cogroup(texts.groupBy("row", "column")).applyInArrow(run, "a long, b long")


def _outlines(docs: DataFrame) -> DataFrame:
    return stage(outline(identified(docs)), "outline")


def _distinct_sets(outlines: DataFrame) -> DataFrame:
    sets = outlines.where("n > 0").groupBy("key", "n").agg(F.min(F.struct("void", "oid")).alias("rep"), F.count(F.lit(1)).alias("members"))
    return stage(sets.select("key", "n", "rep.void", "rep.oid", "members"), "sets")


def _all_links(docs: DataFrame, sets: DataFrame) -> DataFrame:
    kept, index = indexed(docs, sets)
    return verify_in_blocks(stage(candidates(all_pairs(index), kept), "pairs"), kept)


def links(docs: DataFrame) -> DataFrame:
    """a, b: the keys of every two distinct sets that are similar, a < b; ``join`` has each row's set_key.

    Rows with equal sets are similar to each other too and have one key.
    """
    return _all_links(docs, _distinct_sets(_outlines(docs)))


def link_counts(docs: DataFrame) -> DataFrame:
    """doc_id, n_links for every row: how many other rows it is similar to, those with an equal set included."""
    every = _outlines(docs)
    sets = _distinct_sets(every)
    found = stage(_all_links(docs, sets), "links")
    both = found.union(found.select("b", "a")).toDF("key", "near")
    members = sets.select(F.col("key").alias("near"), F.col("members").alias("others"))
    others = both.join(members, "near").groupBy("key").agg(F.sum("others").alias("others"))
    # A table of its own, as in join().
    counts = stage(sets.join(others, "key", "left").select("key", "n", (F.col("members") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")), "counts")
    return every.join(counts, ["key", "n"], "left").select("doc_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def link_sets(docs: DataFrame, sets: DataFrame) -> DataFrame:
    """key, component of the sets that have links; ``sets`` has void, oid, key, n of each distinct set."""
    spark = docs.sparkSession
    kept, index = indexed(docs, sets)
    index = index.withColumn("component", F.col("key"))

    done = spark.createDataFrame([], "a long, b long")
    labels = None
    open_ = index
    for round_ in range(PIVOT_ROUNDS + 1):
        pairs = pivot_pairs(open_, round_) if round_ < PIVOT_ROUNDS else all_pairs(open_)
        pairs = stage(pairs.join(done, ["a", "b"], "left_anti") if round_ else pairs, "pairs")
        found = stage(verify(candidates(pairs, kept), kept), "found")
        done = done.union(pairs)
        labels = joined_components(labels, found)
        if round_ < PIVOT_ROUNDS:
            open_ = stage(open_tokens(open_, labels), "open")
            if not open_.limit(1).count():
                break
    return labels.toDF("key", "component")


def _joined(docs: DataFrame) -> DataFrame:
    """doc_id, void, oid, n, key for every row, and ``first``: void, oid and key of its component's smallest row."""
    every = _outlines(docs)
    sets = _distinct_sets(every)
    labels = link_sets(docs, sets)
    named = sets.join(labels, "key", "left").withColumn("component", F.coalesce("component", "key"))
    smallest = named.groupBy("component").agg(F.min(F.struct("void", "oid", "key")).alias("first"))
    # A table of its own, so that the join back to all copies of a set is one that Spark can split.
    named = stage(named.join(smallest, "component").select("key", "n", "first"), "named")
    own = F.struct("void", "oid", "key")
    return every.join(named, ["key", "n"], "left").withColumn("first", F.coalesce("first", own))


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, set_key for every row."""
    component = F.when(~F.col("first.void"), F.col("first.oid"))
    return _joined(docs).select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("key").alias("set_key"))


@F.pandas_udf(LongType())
def _key_of(text: pd.Series) -> pd.Series:
    return pd.Series([set_key(s) for s in shingle_sets([(t or "").encode() for t in text])], dtype="int64")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each group of linked ones, with its own columns: that with the smallest doc_id.

    Rows without words link with nothing and stay. Where rows have equal
    doc_ids, or none, each one goes by its text, and of equal ones one stays.
    """
    own = F.struct("void", "oid", "key")
    decided = stage(_joined(docs).select("void", "oid", "key", ((F.col("n") == 0) | (own == F.col("first"))).alias("stays")), "decided")
    ids = decided.groupBy("void", "oid").agg(F.count(F.lit(1)).alias("times"), F.min("stays").alias("stays"))
    listed = stage(ids.where("times > 1 or not stays").toDF("_void", "_oid", "times", "stays"), "listed")
    marked = docs.select("*", F.col("doc_id").isNull().alias("_void"), F.coalesce("doc_id", F.xxhash64("text")).alias("_oid"))
    kept = marked.join(listed.hint("shuffle_hash"), ["_void", "_oid"], "left_anti")
    twice = listed.where("times > 1").select("_void", "_oid")
    if twice.limit(1).count():
        stay = decided.where("stays").select(F.col("void").alias("_void"), F.col("oid").alias("_oid"), F.col("key").alias("_key")).distinct()
        rows = marked.join(twice, ["_void", "_oid"], "left_semi").withColumn("_key", _key_of("text")).join(stay, ["_void", "_oid", "_key"], "left_semi")
        worded = rows.where("_key != 0").dropDuplicates(["_void", "_oid", "_key"])
        kept = kept.unionByName(worded.unionByName(rows.where("_key = 0")).drop("_key"))
    return kept.select(*[kept[c] for c in docs.columns])


def op2_ngram_join(spark, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("set_key")


def op2_ngram_links(spark, sf_dir: str) -> DataFrame:
    return link_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = {
    "op2_ngram_join": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda w: w <> '') AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM d WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * c >= 75 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) m USING (doc_id)
""",
    "op2_ngram_links": r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda w: w <> '') AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM d WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * c >= 75 * (x.n + y.n - c))
SELECT d.doc_id, count(e.b)::BIGINT AS n_links FROM d LEFT JOIN e ON e.a = d.doc_id GROUP BY d.doc_id
""",
}
QUERIES = {"op2_ngram_join": op2_ngram_join, "op2_ngram_links": op2_ngram_links}
