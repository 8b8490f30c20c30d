"""Operators across texts, held against plain Python."""

import collections
import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from granary.llm import common, decontaminate, ngram_join, substring_dedup
from granary.llm.components import components, joined_components

WORD = re.compile("[^\x20\x09-\x0d]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def invented(rng, n, words=400):
    return [f"w{rng.randrange(words)}" for _ in range(n)]


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return words


@pytest.mark.parametrize("piece", [1 << 20, 7])
def test_hash_words_as_python_splits(piece, monkeypatch):
    monkeypatch.setattr(common, "PIECE", piece)
    texts = ["", " ", "a b", "Ä ü\x0bx\x1cy", "x" * 50 + " y", "a\n\na"]
    hashes, first = common.hash_words([t.encode() for t in texts])
    words = [WORD.findall(t) for t in texts]
    assert list(np.diff(first)) == [len(w) for w in words]
    seen = dict(zip(hashes.tolist(), [w for x in words for w in x]))
    assert [seen[h] for h in hashes.tolist()] == [w for x in words for w in x] and len(seen) == len({w for x in words for w in x})


# --- n-gram Jaccard join ---


def brute_components(texts):
    sets = []
    for t in texts:
        w = WORD.findall((t or "").translate(FOLD))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    label = list(range(len(texts)))
    for _ in range(len(texts)):
        before = list(label)
        for i, x in enumerate(sets):
            for j in range(i):
                if x and sets[j] and label[i] != label[j] and 100 * len(x & sets[j]) >= 75 * len(x | sets[j]):
                    low, high = sorted((label[i], label[j]))
                    label = [low if v == high else v for v in label]
        if label == before:
            return [len(s) for s in sets], label


def near_texts(seed):
    rng = random.Random(seed)
    out = [None, "", "  ", "one", "ONE", "one two", "a b c d", "A b c D", "a b c d e"]
    for _ in range(6):
        base = invented(rng, rng.randrange(20, 120))
        chain = base
        for k in range(rng.randrange(1, 9)):
            chain = edited(rng, chain, rng.randrange(3))  # chains: the ends need not be alike
            out.append(" ".join(chain))
        out += [" ".join(edited(rng, base, k)) for k in range(5)] + [" ".join(base).upper()] * 2
    passage = " ".join(invented(rng, 40))
    out += [f"{' '.join(invented(rng, 30))} {passage} {' '.join(invented(rng, rng.randrange(30)))}" for _ in range(12)]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_ngram_join_components(spark, seed):
    texts = near_texts(seed)
    sizes, label = brute_components(texts)
    df = spark.createDataFrame([(i, t, 3) for i, t in enumerate(texts)], "doc_id long, text string, n int").repartition(3)
    got = {r["doc_id"]: r for r in ngram_join.join(df).collect()}
    assert [got[i]["n_shingles"] for i in range(len(texts))] == sizes
    assert [got[i]["component_id"] for i in range(len(texts))] == label


def brute_links(texts):
    sets = []
    for t in texts:
        w = WORD.findall((t or "").translate(FOLD))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return {(i, j) for j, y in enumerate(sets) for i, x in enumerate(sets[:j]) if x and y and 100 * len(x & y) >= 75 * len(x | y)}


@pytest.mark.parametrize(("seed", "cell"), [(1, 2000), (2, 3)])
def test_ngram_join_gives_all_links(spark, seed, cell, monkeypatch):
    monkeypatch.setattr(ngram_join, "CELL_SETS", cell)
    rng = random.Random(seed)
    base = invented(rng, 200)
    texts = near_texts(seed) + [" ".join(edited(rng, base, 3)) for _ in range(20)]  # a family: nearly all pairs are links
    want = brute_links(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    counts = collections.Counter(k for pair in want for k in pair)
    got = {r["doc_id"]: r["n_links"] for r in ngram_join.link_counts(df).collect()}
    assert got == {i: counts[i] for i in range(len(texts))}
    members = collections.defaultdict(list)
    for r in ngram_join.join(df).collect():
        if r["n_shingles"]:
            members[r["set_key"]].append(r["doc_id"])
    pairs = {p for m in members.values() for p in itertools.combinations(sorted(m), 2)}
    rows = ngram_join.links(df).collect()
    for r in rows:
        pairs |= {tuple(sorted((x, y))) for x in members[r["a"]] for y in members[r["b"]]}
    assert pairs == want and len({(r["a"], r["b"]) for r in rows}) == len(rows) and all(r["a"] < r["b"] for r in rows)


def test_ngram_link_counts_odd_rows(spark):
    text = "a b c d e f g"
    df = spark.createDataFrame([(3, text), (3, text), (None, text), (None, None), (4, "q r")], "doc_id long, text string")
    assert sorted((str(r["doc_id"]), r["n_links"]) for r in ngram_join.link_counts(df).collect()) == [("3", 2), ("3", 2), ("4", 0), ("None", 0), ("None", 2)]
    assert not ngram_join.link_counts(df.limit(0)).collect() and not ngram_join.links(df.limit(0)).collect()


def test_ngram_join_odd_rows(spark):
    text = "a b c d e f g"
    df = spark.createDataFrame([(3, text), (3, text), (None, text), (None, None), (4, "q r")], "doc_id long, text string")
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in ngram_join.join(df).collect() if r["component_id"])
    assert got == [(False, 3, 3, 3), (False, 3, 3, 3), (False, 4, 1, 4), (True, 0, 3, 3)]
    assert not ngram_join.join(df.limit(0)).collect()
    assert sorted(str(r["doc_id"]) for r in ngram_join.keep_one(df).collect()) == ["3", "4", "None"]
    rows = [(1, text, 0), (1, "p q r s t u", 1), (2, "P q r s t u", 2), (None, "v w x", 3), (None, "v w x", 4), ((1 << 63) - 1, "v w x", 5), (None, "y z", 6), (6, text, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key int")
    got = ngram_join.keep_one(df)
    assert got.columns == df.columns and sorted(r["key"] for r in got.collect()) == [0, 1, 5, 6]


def test_ngram_filters_of_each_order_cut_candidates(spark):
    rng = random.Random(12)
    passage = invented(rng, 25, 10**6)
    texts = near_texts(3) + [" ".join(invented(rng, 20, 10**6) + passage + invented(rng, 20, 10**6)) for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    sets = ngram_join._distinct_sets(ngram_join._outlines(df))
    kept, index = ngram_join.indexed(df, sets)
    keys = sorted(r["key"] for r in kept.select("key").collect())
    every = spark.createDataFrame(list(itertools.combinations(keys, 2)), "a long, b long")
    pairs = lambda found: {(r["a"], r["b"]) for r in found.collect()}
    links, second, outer = pairs(ngram_join.verify(every, kept)), pairs(ngram_join.all_pairs(index)), pairs(ngram_join.candidates(every, kept))
    # Each order lets every link through and cuts pairs; both are applied before verification.
    assert len(keys) < sets.count() and links <= second & outer
    assert len(second) < every.count() and len(outer) < every.count()


@pytest.mark.parametrize("often", [64, 3])
def test_ngram_join_with_hot_tokens(spark, often, monkeypatch):
    monkeypatch.setattr(ngram_join, "OFTEN", often)
    rng = random.Random(5)
    base = invented(rng, 60)
    texts = [" ".join(edited(rng, base, rng.randrange(12))) for _ in range(90)] + near_texts(4)
    sizes, label = brute_components(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in ngram_join.join(df).collect()}
    assert [got[i]["component_id"] for i in range(len(texts))] == label


@pytest.mark.parametrize("often", [64, 5])
def test_rarity_index_in_groups_of_slices(spark, often, monkeypatch):
    monkeypatch.setattr(ngram_join, "OFTEN", often)
    rng = random.Random(31)
    line = invented(rng, 40, 10**6)  # a line that some sets of every slice hold, though not often in any
    texts = [" ".join(invented(rng, 2, 10**6) + line + invented(rng, 2, 10**6)) for _ in range(72)]
    for _ in range(4):
        words = invented(rng, 40, 10**6)
        texts += [" ".join(words), " ".join(edited(rng, words, 1))]
    sets = ngram_join.shingle_sets([t.encode() for t in texts])
    rows = [(ngram_join.set_key(x), len(x), t) for x, t in zip(sets, texts)]
    kept = spark.createDataFrame(rows, "key long, n long, text string").repartition(24)
    n_tokens = sum(map(len, sets))
    whole = sorted(map(tuple, ngram_join.rarity_index(kept, n_tokens).collect()))
    monkeypatch.setattr(ngram_join, "GROUP_TOKENS", n_tokens // 5)
    assert whole and sorted(map(tuple, ngram_join.rarity_index(kept, n_tokens).collect())) == whole
    held = collections.Counter(t >> 16 for x in sets for t in x.tolist())
    assert all(hot == (held[token & (1 << 64) - 1] >= often) for token, _, _, _, hot in whole)
    assert {hot for *_, hot in whole} == {True, False}


def test_ngram_links_in_groups_and_a_fine_grid(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "GROUP_TOKENS", 500)
    monkeypatch.setattr(ngram_join, "BLOCK_TOKENS", 300)
    texts = near_texts(8)
    want = collections.Counter(k for pair in brute_links(texts) for k in pair)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    assert {r["doc_id"]: r["n_links"] for r in ngram_join.link_counts(df).collect()} == {i: want[i] for i in range(len(texts))}


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(links).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100}


def test_joined_components(spark):
    links = lambda *rows: spark.createDataFrame(list(rows), "a long, b long")
    labels = joined_components(None, links((5, 7), (2, 9)))
    got = {r["node"]: r["component"] for r in joined_components(labels, links((7, 9), (11, 12), (9, 5), (1, 12))).collect()}
    assert got == {5: 2, 7: 2, 2: 2, 9: 2, 11: 1, 12: 1, 1: 1}
    assert {r["node"] for r in joined_components(labels, links((7, 5)).limit(0)).collect()} == {2, 5, 7, 9}


# --- decontamination ---


def test_decontamination_finds_edited_passages(spark):
    rng = random.Random(4)
    items = [invented(rng, rng.randrange(15, 60), 5000) for _ in range(30)] + [invented(rng, 7, 5000), invented(rng, 3, 5000)]
    docs, planted = [], set()
    for d in range(200):
        words = invented(rng, rng.randrange(0, 300), 5000)
        if d % 4 == 0:
            k = rng.randrange(31)
            passage = list(items[k])
            if len(passage) >= 20:
                for at in range(9, len(passage), 10):  # one word in ten
                    passage[at] = "changed"
            at = rng.randrange(len(words) + 1)
            words[at:at] = [w.upper() + "," for w in passage]
            planted.add((d, k))
        docs.append((d, " ".join(words), 0))
    docs += [(900, None, 0), (901, "", 0), (902, " ".join(items[31]), 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, words int").repartition(3)
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)] + [(99, None)], "item_id long, text string")
    rows = decontaminate.overlaps(df, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == planted
    for r in rows:
        words = ALNUM.findall(docs[r["doc_id"]][1].translate(FOLD))[r["start"] : r["end"]]
        assert r["n_aligned"] == len(words) and r["n_matched"] >= 0.8 * len(words)
    kept = decontaminate.drop_contaminated(df, bench)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {d for d, *_ in docs} - {d for d, _ in planted}
    assert not decontaminate.overlaps(df, bench.limit(0)).collect() and not decontaminate.overlaps(df.limit(0), bench).collect()


def test_best_stretch():
    same = np.array([1, 0, 0, 1, 1, 1, 1, 0, 1, 1, 1, 1, 0, 0, 1], bool)
    assert decontaminate.best_stretch(same) == (3, 12)


@pytest.mark.parametrize(("masks", "shapes"), [(decontaminate.MASKS, [(14, 4), (17, 5), (20, 6), (24, 7)]), (decontaminate.SHORT_MASKS, [(7, 2), (10, 3)])])
def test_masks_hit_every_placement_of_substitutions(masks, shapes):
    for n, others in shapes:
        bad = np.array([sum(1 << k for k in c) for c in itertools.combinations(range(n), others)])
        hit = np.zeros(len(bad), bool)
        for mask in masks:
            assert len(mask) <= decontaminate.SPAN
            looks = sum(1 << k for k, use in enumerate(mask) if use == "1")
            for at in range(n - len(mask) + 1):
                hit |= bad & (looks << at) == 0
        assert hit.all(), (n, others)


def brute_overlap(same, n_item):
    """The rules themselves: some stretch is long and pure, or the whole alignment holds enough of the item."""
    on = [k for k, x in enumerate(same) if x]
    stretches = [(p, q + 1) for p in on for q in on if q - p >= 12]
    return sum(same) >= 5 and 10 * sum(same) >= 7 * n_item or any(10 * sum(same[p:q]) >= 8 * (q - p) for p, q in stretches)


def test_overlap_against_brute_force():
    rng = random.Random(6)
    changed = lambda n, *at: [k not in at for k in range(n)]
    cases = [(changed(24, 12, 16, 20), 24), (changed(15, 4, 10), 15), (changed(0), 9), (changed(3, 0, 1, 2), 9)]
    for _ in range(3000):
        n, share = rng.randrange(1, 50), rng.random()
        cases.append(([rng.random() < share for _ in range(n)], n + rng.choice([0, 0, 5, 60])))
    for same, n_item in cases:
        found = decontaminate.overlap(np.array(same, bool), n_item)
        assert bool(found) == brute_overlap(same, n_item), (same, n_item)
        if found:
            p, q = found
            part = sum(same[p:q])
            assert same[p] and same[q - 1] and (10 * part >= 7 * n_item and part >= 5 or q - p >= 13 and 10 * part >= 8 * (q - p))


def test_decontamination_at_random_edit_positions(spark):
    rng = random.Random(9)
    items = [invented(rng, n, 50_000) for n in [*range(5, 13), *[k for k in range(13, 31) for _ in range(8)], 24, 15]]
    docs, planted = [], set()
    for d, item in enumerate(items):
        passage = list(item)
        edits = {len(items) - 2: (12, 16, 20), len(items) - 1: (4, 10)}.get(d) or rng.sample(range(len(item)), min(3 * len(item) // 10, len(item) - 5))
        for at in edits:
            passage[at] = f"changed{d}x{at}"
        docs.append((d, " ".join(invented(rng, 20, 50_000) + passage + invented(rng, 20, 50_000))))
        planted.add((d, d))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.overlaps(df, bench).collect()} == planted


def brute_overlaps(docs, items):
    """The best overlap of each pair over all alignments."""
    best = {}
    for d, text in docs:
        words = np.array(ALNUM.findall((text or "").translate(FOLD)), object)
        for i, item in items:
            item = np.array(ALNUM.findall((item or "").translate(FOLD)), object)
            if len(item) < decontaminate.MIN_WORDS:
                continue
            for diagonal in range(-len(item) + 1, len(words)):
                a, b = max(0, -diagonal), min(len(item), len(words) - diagonal)
                same = words[a + diagonal : b + diagonal] == item[a:b]
                found = decontaminate.overlap(same, len(item)) if a < b else None
                if found:
                    p, q = found
                    row = (-int(same[p:q].sum()), q - p, a + p + diagonal, a + q + diagonal)
                    best[d, i] = min(best.get((d, i), row), row)
    return {k: (start, end, -matched, aligned) for k, (matched, aligned, start, end) in best.items()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_decontamination_against_all_alignments(spark, seed):
    rng = random.Random(seed)
    items = [(k, " ".join(invented(rng, rng.randrange(3, 45), 4000))) for k in range(14)] + [(20, None), (21, "")]
    docs = [(0, None), (1, "")]
    for d in range(2, 60):
        words = invented(rng, rng.randrange(30), 4000)
        for _ in range(rng.randrange(3)):
            passage = rng.choice(items[:14])[1].split()
            a = rng.choice([0, 0, rng.randrange(len(passage))])
            passage = passage[a : a + rng.choice([99, rng.randrange(1, 40)])]
            words += edited(rng, passage, rng.randrange(7)) + invented(rng, rng.randrange(12), 4000)
        docs.append((d, " ".join(words)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["start"], r["end"], r["n_matched"], r["n_aligned"]) for r in decontaminate.overlaps(df, bench).collect()}
    assert got == brute_overlaps(docs, items) and len(got) > 10


def test_decontamination_goes_by_row(spark):
    rng = random.Random(3)
    item = " ".join(invented(rng, 30, 10**6))
    docs = [(None, item, 0), (None, "clean text", 1), (5, f"x {item}", 2), (5, "clean too", 3), (None, None, 4)]
    df = spark.createDataFrame(docs, "doc_id long, text string, _row int".replace("_row", "item_id"))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = decontaminate.drop_contaminated(df, bench)
    assert got.columns == df.columns and sorted(r["item_id"] for r in got.collect()) == [1, 3, 4]


# --- substrings ---


def brute_substrings(rows):
    seen, out = set(), {}
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        words = WORD.findall(text or "")
        gone = set()
        for i in range(len(words) - 19):
            window = tuple(words[i : i + 20])
            if window in seen:
                gone.update(range(i, i + 20))
            seen.add(window)
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out[doc_id] = (len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize("group_rows", [1 << 14, 40, 2])
def test_substring_dedup(spark, group_rows):
    rng = random.Random(7)
    passages = [invented(rng, rng.randrange(18, 70)) for _ in range(5)]
    rows = [(0, None), (1, ""), (2, " \n"), (3, "x " * 300), (4, "short text"), (5, "short text")]
    for d in range(6, 120):
        words = invented(rng, rng.randrange(40))
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            a = rng.randrange(len(p) // 2)
            words += p[a : a + rng.randrange(10, 70)] + invented(rng, rng.randrange(10))
        rows.append((d, " ".join(words)))
    rows += [(200 + k, rows[20][1]) for k in range(5)] + [(300, " ".join(["tick tock"] * 40))]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, places int").repartition(3)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.dedup(df, group_rows).collect()}
    assert got == brute_substrings(rows)


def test_substring_repeats_are_maximal(spark):
    rng = random.Random(4)
    passage, own = invented(rng, 130, 10**6), [invented(rng, 30, 10**6) for _ in range(4)]
    rows = [(1, passage), (2, own[0] + passage[7:90] + own[1]), (3, own[2] + passage[100:119] + own[3] + passage[5:25])]
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id long, text string")
    got = {r["doc_id"]: r["repeats"] for r in substring_dedup.dedup(df).collect()}
    assert got == {1: [], 2: [[30, 83]], 3: [[79, 20]]}


def test_suffix_groups_stay_under_their_bound(spark):
    rng = random.Random(6)
    stem = invented(rng, 24, 10**6)
    rows = [(d, " ".join(invented(rng, 3, 10**6) + stem[d % 3 : 12 + d % 12] + invented(rng, 12, 8) + invented(rng, 6, 10**6))) for d in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    docs = common.identified(df)
    places = substring_dedup.repeated_anchors(docs, 10_000)
    keyed = substring_dedup.outline(docs).select("void", "oid", "key_a").join(docs.select("void", "oid", "text"), ["void", "oid"]).join(places, "key_a")
    chosen = common.stage(substring_dedup._chosen(keyed, 16), "chosen")
    long = substring_dedup.split_groups(chosen, 30, 16)
    assert len({len(substring_dedup.HALVES[k]) for k in long}) and max(long) > 2  # prefixes of at least three lengths
    texts = [(r["text"].encode(), np.array(r["places"])) for r in chosen.where("text is not null").collect()]
    own = substring_dedup._Suffixes([t for t, _ in texts], [p for _, p in texts])
    sizes = collections.Counter(g for _, _, group, whole in own.groups(long, 16) if not whole for g in group.tolist())
    assert sizes and max(sizes.values()) <= 30
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.dedup(df, 30).collect()}
    assert got == brute_substrings(rows)


def test_substring_dedup_odd_rows(spark):
    text = " ".join(f"w{k}" for k in range(30))
    df = spark.createDataFrame([(1, text), (1, text), (None, text), (None, None)], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"]) for r in substring_dedup.dedup(df).collect())
    assert got == [("1", 30, 0), ("1", 30, 0), ("None", 0, 0), ("None", 30, 30)]
    rows = [(None, text), (None, f"a {text} b"), (None, f"c {text} d"), ((1 << 63) - 1, f"e {text}"), (1, f"f {text} g")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"]) for r in substring_dedup.dedup(df).collect())
    assert got == [("1", 32, 0), ("9223372036854775807", 31, 30), ("None", 30, 30), ("None", 32, 30), ("None", 32, 30)]
    assert not substring_dedup.dedup(df.limit(0)).collect()


# --- the pipeline ---


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, function in corpus_pipeline.STAGES[:3]:
        docs = common.stage(function(spark, docs, sf_dir), "t")
        assert docs.columns == columns, name
    kept = {r["doc_id"] for r in docs.collect()}
    _, label = brute_components([before[k] for k in sorted(before)])
    assert len(kept) == len({label[sorted(before).index(k)] for k in kept})
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r["doc_id"] for r in rows} <= kept and sum(r["n_tokens"] for r in rows) == max(r["start"] + r["n_tokens"] for r in rows)
    taken = collections.Counter(r["doc_id"] for r in rows)
    assert max(taken.values()) <= 3
