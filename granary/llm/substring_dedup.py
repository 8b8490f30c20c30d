"""Substring deduplication with prefix-partitioned suffix trees.

The tree is sparse: its suffixes start at anchors. The anchor of a window of
DEPTH words is the ANCHOR-word run in it with the smallest hash, so equal
windows have equal anchors at the same offset, neighbours mostly share one,
and few rows tell which anchors occur again. Only suffixes at those are kept.
A suffix carries the words of the windows around its anchor: those behind it
are its path in the tree, those before it tell which leaves of a node agree to
the left as well.

Suffixes are split into groups that fit a task's memory by prefixes of as many
lengths as that takes. A prefix is what all windows of a range of anchor
offsets have in common: ANCHOR words for the whole range. Where more than
``group_rows`` suffixes have a prefix, the range is halved and each half goes
by its own longer prefix (14 or 15 words, then 17 or 18, 19, and DEPTH). Only
suffixes with one whole window in common can still be too many; they are
leaves of one node, whose first leaf comes from partial aggregation.

In a group the suffixes are sorted by their words, and neighbours' common
prefix lengths give the tree. For each anchor offset o the internal nodes at
depth DEPTH - o matter, split by the o words to the left: their leaves are
equal windows. A node's first leaf is the smallest (doc_id, word); runs of
offsets at which a leaf is a later one are its repeats, and repeats that meet
in a text join to its maximal ones. Their words are removed.

Documents with equal words are one: the smallest doc_id stands for them, the
others, if they have a window, are wholly repeats of it.

Defined results: null and blank texts have no words, and keep ""; texts under
DEPTH words are kept; rows with equal doc_ids go by text, so that reruns
agree; rows without doc_id come last; an empty table gives no rows; other
columns play no part. Texts are read whole and no group is cut.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import OTHER_STEP, U64, bucket_count, hash_words, identified, in_runs, mix, pack, packed_schema, per_bucket, slices, stage, unpack, window_hashes

DEPTH = 20
ANCHOR = 8
OFFSETS = DEPTH - ANCHOR
#: The most suffixes in a group, and how many there are on average: a suffix takes about half a kilobyte of a task's memory.
GROUP_ROWS = 1 << 16
MEAN_ROWS = 1 << 12


def _ranges() -> tuple[list[tuple[int, int]], list[tuple[int, ...]]]:
    """Ranges of anchor offsets, halved down to single ones, and each one's halves."""
    ranges, halves = [(0, OFFSETS)], []
    for low, high in ranges:
        middle = (low + high) // 2
        new = [(low, middle), (middle + 1, high)] if low < high else []
        halves.append(tuple(range(len(ranges), len(ranges) + len(new))))
        ranges += new
    return ranges, halves


RANGES, HALVES = _ranges()


def _key(words: np.ndarray) -> tuple[int, int]:
    """Two hashes of a sequence of words."""
    place = mix(np.arange(1, len(words) + 1, dtype=U64))
    both = (np.bitwise_xor.reduce(mix(words + place)) if len(words) else U64(0), np.add.reduce(mix(words ^ place)) if len(words) else U64(1))
    return tuple(int(x.view(np.int64)) for x in np.array(both, U64))


def outline(rows: DataFrame) -> DataFrame:
    """doc_id, void, oid, n_words, key_a, key_b (of all words), kept_sha256 (if nothing goes)."""

    def run(batches):
        for batch in batches:
            for at, to, texts in slices(batch, "text"):
                words, first = hash_words(texts)
                keys = [_key(words[a:b]) for a, b in zip(first, first[1:])]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(n).slice(at, to - at) for n in ("doc_id", "void", "oid")),
                        pa.array(np.diff(first).astype(np.int64)),
                        pa.array([k[0] for k in keys], pa.int64()),
                        pa.array([k[1] for k in keys], pa.int64()),
                        pa.array([hashlib.sha256(b" ".join(t.split())).hexdigest() for t in texts]),
                    ],
                    ["doc_id", "void", "oid", "n_words", "key_a", "key_b", "kept_sha256"],
                )

    schema = "doc_id long, void boolean, oid long, n_words long, key_a long, key_b long, kept_sha256 string"
    return rows.mapInArrow(run, schema)


def _anchors(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per window of DEPTH words its anchor's place, and the hashes of all ANCHOR-word runs."""
    grams = window_hashes(words, ANCHOR)
    span = DEPTH - ANCHOR + 1
    n = len(grams) - span + 1
    if n <= 0:
        return np.empty(0, np.int64), grams
    best = np.arange(n)
    least = grams[:n].copy()
    for k in range(1, span):
        less = grams[k : k + n] < least
        least[less] = grams[k : k + n][less]
        best[less] = np.flatnonzero(less) + k
    return best, grams


def _windows_within(first: np.ndarray) -> np.ndarray:
    """Starts of windows of DEPTH words that do not leave their text."""
    return np.concatenate([np.empty(0, np.int64), *(np.arange(a, b - DEPTH + 1) for a, b in zip(first, first[1:]) if b - a >= DEPTH)])


PLACED = {"gram": np.uint64, "key": np.int64, "place": np.uint32}


def repeated_anchors(docs: DataFrame, n_words: int) -> DataFrame:
    """key_a, places: for each distinct text, the anchors of it that occur elsewhere too.

    Anchors that a batch of texts already repeats are told at once; of each of
    them one row alone goes on to tell the other batches. So a hot passage
    sends a row per batch, not one per document.
    """
    spark = docs.sparkSession
    asks = bucket_count(spark, n_words // 7)
    tells = bucket_count(spark, n_words // 14)

    def run(batches):
        for batch in batches:
            for _, _, texts in slices(batch, "text"):
                words, first = hash_words(texts)
                best, grams = _anchors(words)
                starts = _windows_within(first)
                if not len(starts):
                    continue
                places = np.unique(best[starts])
                doc = np.searchsorted(first, places, side="right") - 1
                keys = np.array([_key(words[a:b])[0] if b - a >= DEPTH else 0 for a, b in zip(first, first[1:])], np.int64)
                once = np.zeros(len(texts), bool)
                once[np.unique(keys, return_index=True)[1]] = True  # of copies in the batch, one
                places, doc = places[once[doc]], doc[once[doc]]
                order = np.argsort(grams[places], kind="stable")
                places, doc = places[order], doc[order]
                gram, key, place = grams[places], keys[doc], (places - first[doc]).astype(np.uint32)
                told = in_runs(gram)
                lead = told & np.concatenate([[True], gram[1:] != gram[:-1]])
                ask = ~told | lead
                bucket = (gram % U64(asks)).astype(np.int64)
                yield pack(bucket[ask], {"gram": gram[ask], "key": key[ask], "place": place[ask], "told": told[ask].astype(np.uint8)})
                if told.any():  # below zero: nothing is asked
                    yield pack(-1 - (key[told].view(U64) % U64(tells)).astype(np.int64), {"gram": gram[told], "key": key[told], "place": place[told], "told": np.ones(int(told.sum()), np.uint8)})

    def again(batches):
        got = unpack(batches, PLACED | {"told": np.uint8})
        gram, key, place, told = (got[n] for n in ("gram", "key", "place", "told"))
        if batches[0].column("bucket")[0].as_py() >= 0:
            order = np.lexsort((told, place, key, gram))
            gram, key, place, told = gram[order], key[order], place[order], told[order]
            copy = (gram[1:] == gram[:-1]) & (key[1:] == key[:-1]) & (place[1:] == place[:-1])
            # Of equal rows one stays, one that others were told of if there is one.
            stay = ~np.concatenate([copy, [False]])
            gram, key, place, told = gram[stay], key[stay], place[stay], told[stay]
            known = np.isin(gram, gram[told == 1])
            keep = (in_runs(gram) | known) & (told == 0)
            key, place = key[keep], place[keep]
        if len(key):
            yield pack((key.view(U64) % U64(tells)).astype(np.int64), {"key": key, "place": place})

    def by_text(batches):
        got = unpack(batches, {"key": np.int64, "place": np.uint32})
        order = np.lexsort((got["place"], got["key"]))
        key, place = got["key"][order], got["place"][order].astype(np.int32)
        cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, int)
        ends = [*cuts[1:], len(key)]
        yield pa.RecordBatch.from_arrays([pa.array(key[cuts]), pa.array([np.unique(place[a:b]) for a, b in zip(cuts, ends)], pa.list_(pa.int32()))], ["key_a", "places"])

    packed = docs.select("text").mapInArrow(run, packed_schema("gram", "key", "place", "told"))
    shared = per_bucket(packed, again, packed_schema("key", "place"))
    return per_bucket(shared, by_text, "key_a long, places array<int>")


# --- suffixes and their groups --------------------------------------------


class _Suffixes:
    """The suffixes of some texts: word index of the anchor, text, and the offsets of the windows that have this anchor."""

    def __init__(self, texts: list[bytes], places: list[np.ndarray]):
        self.words, self.first, self.start, self.end, self.joined = hash_words(texts, spans=True)
        best, self.grams = _anchors(self.words)
        marked = np.zeros(len(self.words) + 1, bool)
        for d, at in enumerate(places):
            at = at + self.first[d]
            marked[at[at < self.first[d + 1]]] = True
        starts = _windows_within(self.first)
        starts = starts[marked[best[starts]]] if len(starts) else starts
        anchor = best[starts]
        cuts = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]])) if len(anchor) else np.empty(0, int)
        self.anchor = anchor[cuts]
        self.high = self.anchor - starts[cuts]
        self.low = self.anchor - starts[np.append(cuts[1:], len(starts)).astype(int) - 1] if len(cuts) else self.high
        self.doc = np.searchsorted(self.first, self.anchor, side="right") - 1

    def groups(self, long: dict[int, np.ndarray], n_slots: int):
        """(range, suffixes, group of each, whether its prefix can be made no longer) until no group is a long one."""
        todo = [(0, np.arange(len(self.anchor)))]
        while todo:
            at, rows = todo.pop()
            low, high = RANGES[at]
            rows = rows[(self.low[rows] <= high) & (self.high[rows] >= low)]
            if not len(rows):
                continue
            size = DEPTH - (high - low)
            prefix = self.grams if size == ANCHOR else window_hashes(self.words, size)
            group = (prefix[self.anchor[rows] - low] % U64(n_slots)).astype(np.int64) + at * n_slots
            over = np.isin(group, long[at]) if at in long else np.zeros(len(rows), bool)
            yield at, rows[~over], group[~over], False
            if HALVES[at]:
                todo += [(half, rows[over]) for half in HALVES[at]]
            elif over.any():
                yield at, rows[over], group[over], True


def _slices_of(batch: pa.RecordBatch):
    """(from, to, suffixes) of a batch with text and places."""
    for at, to, texts in slices(batch, "text", 4 << 20):
        places = batch.column("places").slice(at, to - at)
        yield at, to, _Suffixes(texts, [np.asarray(places[k].values, np.int64) for k in range(to - at)])


def _counts(total: dict[int, int]) -> pa.Array:
    return pa.array([np.array([*total.keys(), *total.values()], np.int64).tobytes()], pa.binary())


def _tally(total: dict[int, int], group: np.ndarray) -> None:
    for k, n in zip(*(x.tolist() for x in np.unique(group, return_counts=True))):
        total[k] = total.get(k, 0) + n


def _chosen(joined: DataFrame, n_slots: int) -> DataFrame:
    """void, oid, text, key_a, places of rows whose text has the key it was joined for: equal doc_ids may carry other texts.

    A task's last row holds only ``counts``: suffixes per group of the shortest prefix.
    """
    names = ["void", "oid", "text", "key_a", "places"]

    def run(batches):
        total: dict[int, int] = {}
        kinds = None
        for batch in batches:
            kinds = batch.schema
            keep = []
            for _, _, own in _slices_of(batch):
                key = np.array([_key(own.words[a:b])[0] for a, b in zip(own.first, own.first[1:])], np.int64)
                right = key == batch.column("key_a").slice(len(keep), len(key)).to_numpy()
                keep += right.tolist()
                for _, rows, group, _ in own.groups({}, n_slots):
                    _tally(total, group[right[own.doc[rows]]])
            part = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.nulls(len(part), pa.binary())], [*names, "counts"])
        if kinds is not None:
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, kinds.field(n).type) for n in names), _counts(total)], [*names, "counts"])

    return joined.select(*names).mapInArrow(run, "void boolean, oid long, text string, key_a long, places array<int>, counts binary")


def _long_groups(counts: DataFrame, group_rows: int) -> np.ndarray:
    """The groups with too many suffixes: at most one in ``group_rows`` suffixes reaches the driver."""

    def run(batches):
        for batch in batches:
            for blob in batch.column("counts").to_pylist():
                both = np.frombuffer(blob, np.int64)
                half = len(both) // 2
                yield pa.RecordBatch.from_arrays([pa.array(both[:half]), pa.array(both[half:])], ["bucket", "n"])

    sums = counts.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    return np.sort(np.array([r["bucket"] for r in sums.where(F.col("n") > group_rows).select("bucket").collect()], np.int64))


def split_groups(chosen: DataFrame, group_rows: int, n_slots: int) -> dict[int, np.ndarray]:
    """Per range of offsets its groups that are split by longer prefixes."""
    found = _long_groups(chosen.where("counts is not null").select("counts"), group_rows)
    long: dict[int, np.ndarray] = {}
    while len(found):
        new = {at: found[found // n_slots == at] for at in np.unique(found // n_slots).tolist()}
        long |= new
        level = {half for at in new for half in HALVES[at]}
        if not level:
            break

        def run(batches, level=level):
            total: dict[int, int] = {}
            for batch in batches:
                for _, _, own in _slices_of(batch):
                    for at, _, group, whole in own.groups(long, n_slots):
                        if at in level and not whole:
                            _tally(total, group)
            yield pa.RecordBatch.from_arrays([_counts(total)], ["counts"])

        found = _long_groups(chosen.where("text is not null").select("text", "places").mapInArrow(run, "counts binary"), group_rows)
    return long


# --- trees ----------------------------------------------------------------

LEAF = {"void": np.uint8, "oid": np.int64, "key": np.int64, "place": np.int32, "low": np.uint8, "high": np.uint8}


def _tree_repeats(got: dict[str, np.ndarray], words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one group's suffixes: (suffix, first offset, last offset) of the repeats; ``words`` has the words of all their windows in order."""
    low, high = got["low"].astype(np.int64), got["high"].astype(np.int64)
    sizes = high - low + DEPTH
    anchor = np.cumsum(sizes) - sizes + high
    reach = np.minimum(anchor[:, None] + np.arange(DEPTH), len(words) - 1)
    right = np.where(np.arange(DEPTH) < (DEPTH - low)[:, None], words[reach], U64(0))
    order = np.lexsort(right.T[::-1])
    equal = right[order][1:] == right[order][:-1]
    common = np.where(equal.all(1), DEPTH, equal.argmin(1))
    rank = np.empty(len(order), np.int64)
    rank[np.lexsort((got["place"], got["key"], got["oid"], got["void"]))] = np.arange(len(order))
    rank, own_low, own_high, own_anchor = rank[order], low[order], high[order], anchor[order]
    left = np.zeros(len(order), U64)
    later = np.zeros((len(order), OFFSETS + 2), np.int8)
    for offset in range(OFFSETS + 1):
        if offset:
            left = mix(left + words[np.maximum(own_anchor - offset, 0)])
        leaf = np.flatnonzero((own_low <= offset) & (offset <= own_high))
        if len(leaf) < 2:
            continue
        node = np.concatenate([[0], np.cumsum(common < DEPTH - offset)])[leaf].astype(U64)
        node = mix(left[leaf] ^ mix(node + U64(1)))
        by_node = np.lexsort((rank[leaf], node))
        again = node[by_node][1:] == node[by_node][:-1]
        later[leaf[by_node[1:][again]], offset] = 1
    turn = np.diff(later, axis=1, prepend=0)
    row, first = np.nonzero(turn == 1)
    _, behind = np.nonzero(turn == -1)
    return order[row], first, behind - 1


def later_leaves(chosen: DataFrame, group_rows: int, n_slots: int, n_words: int) -> DataFrame:
    """key_a, starts, sizes: per text the runs of words that are repeats of earlier ones."""
    spark = chosen.sparkSession
    tells = bucket_count(spark, n_words // 14)
    texts = chosen.where("text is not null").drop("counts")
    long = split_groups(chosen, group_rows, n_slots)

    def leaves(batch, own, at, to, rows, offsets):
        ids = {n: batch.column(c).slice(at, to - at).to_numpy(zero_copy_only=False)[own.doc[rows]] for n, c in (("void", "void"), ("oid", "oid"), ("key", "key_a"))}
        low, high = np.maximum(own.low[rows], offsets[0]), np.minimum(own.high[rows], offsets[1])
        place = (own.anchor[rows] - own.first[own.doc[rows]]).astype(np.int32)
        return ids | {"void": ids["void"].astype(np.uint8), "place": place, "low": low.astype(np.uint8), "high": high.astype(np.uint8)}

    def send(batches):
        for batch in batches:
            for at, to, own in _slices_of(batch):
                for k, rows, group, whole in own.groups(long, n_slots):
                    if whole or not len(rows):
                        continue
                    cols = leaves(batch, own, at, to, rows, RANGES[k])
                    a = own.start[own.anchor[rows] - cols["high"]].tolist()
                    b = own.end[own.anchor[rows] - cols["low"] + DEPTH - 1].tolist()
                    yield pack(group, cols | {"words": [own.joined[x:y] for x, y in zip(a, b)]})

    def tree(batches):
        got = unpack(batches, LEAF)
        words, _ = hash_words([blob for batch in batches for blob in batch.column("words").to_pylist()])
        suffix, low, high = _tree_repeats(got, words)
        if len(suffix):
            key = got["key"][suffix]
            rows = {"key": key, "start": got["place"][suffix] - high.astype(np.int32), "size": (high - low + DEPTH).astype(np.int32)}
            yield pack((key.view(U64) % U64(tells)).astype(np.int64), rows)

    def by_text(batches):
        got = unpack(batches, {"key": np.int64, "start": np.int32, "size": np.int32})
        order = np.lexsort((got["start"], got["key"]))
        key, start, size = (got[n][order] for n in ("key", "start", "size"))
        cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, int)
        ends = [*cuts[1:], len(key)]
        lists = [pa.array([v[a:b] for a, b in zip(cuts, ends)], pa.list_(pa.int32())) for v in (start, size)]
        yield pa.RecordBatch.from_arrays([pa.array(key[cuts]), *lists], ["key_a", "starts", "sizes"])

    packed = texts.mapInArrow(send, packed_schema(*LEAF, "words"))
    near = per_bucket(per_bucket(packed, tree, packed_schema("key", "start", "size")), by_text, "key_a long, starts array<int>, sizes array<int>")
    if all(HALVES[at] for at in long):
        return near

    # Groups of one whole window: its leaves may be in many tasks, so the first one is found by
    # partial aggregation and the others by a join that Spark can split.
    def rows_of(batches):
        for batch in batches:
            for at, to, own in _slices_of(batch):
                for k, rows, _, whole in own.groups(long, n_slots):
                    if whole:
                        cols = leaves(batch, own, at, to, rows, RANGES[k])
                        start = own.anchor[rows] - RANGES[k][0]
                        path = [window_hashes(own.words, DEPTH, step=OTHER_STEP)[start], window_hashes(own.words, DEPTH)[start]]
                        arrays = [*(p.view(np.int64) for p in path), cols["void"].astype(bool), cols["oid"], cols["key"], cols["place"] - np.int32(RANGES[k][0])]
                        yield pa.RecordBatch.from_arrays([pa.array(v) for v in arrays], ["path_a", "path_b", "void", "oid", "key_a", "start"])

    deep = stage(texts.mapInArrow(rows_of, "path_a long, path_b long, void boolean, oid long, key_a long, start int"), "suffixes")
    leaf = F.struct("void", "oid", "key_a", "start")
    nodes = deep.groupBy("path_a", "path_b").agg(F.min(leaf).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    far = deep.join(nodes, ["path_a", "path_b"]).where(leaf != F.col("first"))
    far = far.groupBy("key_a").agg(F.collect_list("start").alias("starts"), F.collect_list(F.lit(DEPTH)).alias("sizes"))
    both = near.unionByName(far)
    return both.groupBy("key_a").agg(F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("sizes")).alias("sizes"))


def _remove(batches):
    """Per text its maximal repeats and what is left of it without them."""
    for batch in batches:
        texts = batch.column("text").cast(pa.large_string()).cast(pa.large_binary())
        removed, kept, repeats = [], [], []
        for k in range(batch.num_rows):
            words = (texts[k].as_py() or b"").split()
            gone = np.zeros(len(words) + 1, np.int64)
            starts = np.asarray(batch.column("starts")[k].values, np.int64)
            np.add.at(gone, starts, 1)
            np.add.at(gone, starts + np.asarray(batch.column("sizes")[k].values, np.int64), -1)
            out = np.cumsum(gone)[:-1] > 0
            turn = np.diff(out.astype(np.int8), prepend=0, append=0)
            begin, end = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
            repeats.append(np.stack([begin, end - begin], 1).tolist())
            removed.append(int(out.sum()))
            kept.append(b" ".join(w for w, x in zip(words, out) if not x).decode())
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(n) for n in ("void", "oid", "key_a")), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), pa.array(repeats, pa.list_(pa.list_(pa.int32())))],
            ["void", "oid", "key_a", "cut_words", "kept", "repeats"],
        )


def dedup(docs: DataFrame, group_rows: int = GROUP_ROWS, mean_rows: int = MEAN_ROWS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept, repeats.

    ``kept`` is the text that stays, null where all of it does; ``repeats`` the
    maximal runs of words that repeat earlier ones, as [start, length].
    """
    rows = identified(docs)
    spark = docs.sparkSession
    every = stage(outline(rows), "outline")
    n_words = every.agg(F.sum("n_words")).first()[0] or 0
    # A table of its own, so that the join back to all copies of a text is one that Spark can split.
    stand = stage(every.groupBy("key_a", "key_b").agg(F.min(F.struct("void", "oid")).alias("rep")), "stand")
    places = repeated_anchors(rows, n_words)
    wanted = stand.join(places, "key_a").select("rep.void", "rep.oid", "key_a", "places")

    # About one suffix for every seven words, and most of them at anchors that do not occur again.
    n_slots = max(bucket_count(spark), n_words // 40 // mean_rows)
    joined = rows.select("void", "oid", "text").join(wanted.hint("shuffle_hash"), ["void", "oid"])
    chosen = stage(_chosen(joined, n_slots), "chosen")
    cut = chosen.where("text is not null").drop("counts", "places").join(later_leaves(chosen, group_rows, n_slots, n_words).hint("shuffle_hash"), "key_a")
    done = cut.select("void", "oid", "key_a", "text", "starts", "sizes").mapInArrow(
        _remove, "void boolean, oid long, key_a long, cut_words long, kept string, repeats array<array<int>>"
    )
    done = done.dropDuplicates(["void", "oid", "key_a"])

    judged = every.join(stand, ["key_a", "key_b"]).join(done, ["void", "oid", "key_a"], "left")
    copy = (F.struct("void", "oid") != F.col("rep")) & (F.col("n_words") >= DEPTH)
    whole = F.array(F.array(F.lit(0), F.col("n_words").cast("int")))
    return judged.select(
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("cut_words", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.sha2(F.lit(""), 256)).when(F.col("kept").isNotNull(), F.sha2("kept", 256)).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
        F.when(copy, F.lit("")).otherwise(F.col("kept")).alias("kept"),
        F.when(copy, whole).otherwise(F.coalesce("repeats", F.array().cast("array<array<int>>"))).alias("repeats"),
    )


def op8_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept", "repeats")


ORACLE_SQL = {
    "op8_substring_dedup": r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda w: w <> '') AS words FROM documents),
s AS (SELECT doc_id, i, array_to_string(words[i:i + 19], ' ') AS win FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS i FROM d WHERE len(words) >= 20)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS k FROM s) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM later),
w AS (SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS p FROM d),
kept AS (
  SELECT w.doc_id, string_agg(w.w, ' ' ORDER BY w.p) FILTER (WHERE gone.p IS NULL) AS t, count(gone.p) AS n
  FROM w LEFT JOIN gone ON w.doc_id = gone.doc_id AND w.p = gone.p GROUP BY w.doc_id)
SELECT d.doc_id, len(d.words)::BIGINT AS n_words, coalesce(kept.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
""",
}
QUERIES = {"op8_substring_dedup": op8_substring_dedup}
