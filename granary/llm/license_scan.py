"""Fuzzy search for short licence notices.

A notice of m characters that a text holds with at most k edits, cut into
k + 1 pieces, has one piece free of edits (pigeonhole). So each piece is
looked up as an exact seed, all seeds of all notices in one pass of an
automaton. Around its hits a place must still hold enough of the notice's
short grams: k edits spoil at most k * GRAM of them. Only what is left is
verified by the regex library's bounded-error matching, which reports spans
and edits.
Before that, exact phrases are found word by word; they always count. Licence
identifiers behind the words ``spdx license identifier`` add their labels too.

Words are runs of ASCII letters, digits and non-ASCII characters, in lower
case (A-Z only). Each notice and phrase is matched on the text's words joined
by single spaces, so line breaks and punctuation inside a notice cost nothing.

Defined results: a null or empty text has no words, no labels and score 0;
rows are judged one by one, so repeated rows give equal rows; an empty table
gives no rows; other columns play no part. Texts are searched whole, in
overlapping blocks, in time linear in their length but for the hits.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import slices

#: Exact phrases and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: Short notices, in lower-case words, and the labels they add.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "the software is provided as is without warranty of any kind express or implied": "mit",
    "released under the mit license": "mit",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "licensed under the apache license version 2 0": "apache-2",
    "you may not use this file except in compliance with the license": "apache-2",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "redistributions of source code must retain the above copyright notice": "bsd",
    "neither the name of the copyright holder nor the names of its contributors": "bsd-3",
    "under the terms of the gnu general public license": "gpl",
    "licensed under the gnu general public license version 3": "gpl-3",
    "under the terms of the gnu lesser general public license": "lgpl",
    "under the terms of the gnu affero general public license": "agpl",
    "this source code form is subject to the terms of the mozilla public license": "mpl-2",
    "this program and the accompanying materials are made available under the terms of the eclipse public license": "epl",
    "boost software license version 1 0": "bsl-1",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "has waived all copyright and related or neighboring rights": "cc0",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under a creative commons attribution": "cc-by",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution noderivatives": "cc-by-nd",
    "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license": "gfdl",
    "all rights reserved": "all-rights-reserved",
}

#: Licence identifiers, in lower-case words, and their labels.
IDENTIFIERS = {
    "mit": "mit",
    "mit 0": "mit-0",
    "isc": "isc",
    "apache 2 0": "apache-2",
    "bsd 2 clause": "bsd-2",
    "bsd 3 clause": "bsd-3",
    "gpl 2 0 only": "gpl-2",
    "gpl 2 0 or later": "gpl-2",
    "gpl 3 0 only": "gpl-3",
    "gpl 3 0 or later": "gpl-3",
    "lgpl 2 1 only": "lgpl",
    "lgpl 2 1 or later": "lgpl",
    "lgpl 3 0 only": "lgpl",
    "lgpl 3 0 or later": "lgpl",
    "agpl 3 0 only": "agpl",
    "agpl 3 0 or later": "agpl",
    "mpl 2 0": "mpl-2",
    "epl 2 0": "epl",
    "bsl 1 0": "bsl-1",
    "unlicense": "unlicense",
    "zlib": "zlib",
    "wtfpl": "wtfpl",
    "cc0 1 0": "cc0",
    "cc by 4 0": "cc-by",
    "cc by sa 4 0": "cc-by-sa",
    "cc by nc 4 0": "cc-by-nc",
    "cc by nd 4 0": "cc-by-nd",
}
TAG = "spdx license identifier"

#: One edit is allowed for every so many characters of a notice.
CHARS_PER_EDIT = 12
#: Length of the grams of which a notice's place must hold enough.
GRAM = 4


@dataclass(frozen=True)
class Notice:
    text: bytes
    label: str
    edits: int
    seeds: tuple[tuple[bytes, int], ...]
    grams: tuple[bytes, ...]
    least: int
    pattern: object

    def may_stand_in(self, window: bytes) -> bool:
        """False only where too few grams are left for so many edits."""
        return sum(map(window.__contains__, self.grams)) >= self.least


def compile_notice(text: str, label: str, chars_per_edit: int = CHARS_PER_EDIT) -> Notice:
    raw = text.encode()
    edits = len(raw) // chars_per_edit
    cuts = [len(raw) * k // (edits + 1) for k in range(edits + 2)]
    seeds = tuple((raw[a:b], a) for a, b in zip(cuts, cuts[1:]))
    grams = tuple(raw[k : k + GRAM] for k in range(len(raw) - GRAM + 1))
    pattern = regex.compile(rb"(?be)(?<![^ ])(?:%s){e<=%d}(?![^ ])" % (regex.escape(raw), edits))
    return Notice(raw, label, edits, seeds, grams, len(grams) - edits * GRAM, pattern)


def seed_starts(text: bytes, notice: Notice) -> list[int]:
    """Where the notice would start by each hit of its seeds; one notice's part of ``Scanner.starts``."""
    starts = []
    for seed, at in notice.seeds:
        hit = text.find(seed)
        while hit >= 0:
            starts.append(hit - at)
            hit = text.find(seed, hit + 1)
    return starts


def fuzzy_spans(text: bytes, notice: Notice, starts: list[int] | None = None) -> list[tuple[int, int, int]]:
    """(start, end, edits) of a notice in a text of words joined by single spaces; no two overlap.

    ``starts``: where the notice would start by its seeds' hits, if it had no edits; looked up if not given.
    """
    reach = len(notice.text) + notice.edits + 1
    merged: list[list[int]] = []
    for start in sorted(seed_starts(text, notice) if starts is None else starts):
        a, b = max(0, start - notice.edits - 1), min(len(text), start + reach)
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    spans = []
    while merged:  # the best match of a stretch, then those before and behind it
        a, b = merged.pop()
        if not notice.may_stand_in(text[a:b]):
            continue
        m = notice.pattern.search(text, a, b)
        if m is not None:
            spans.append((m.start(), m.end(), sum(m.fuzzy_counts)))
            merged += [[a, m.start() - 1]] * (m.start() - 1 > a) + [[m.end(), b]] * (b > m.end())
    return sorted(spans)


def _phrase_pattern(phrase: str) -> re.Pattern:
    return re.compile(rb"(?<![^ ])(?=" + re.escape(phrase.encode()) + rb"(?![^ ]))")


def word_places(text: bytes, starts: list[int]) -> list[int]:
    """How many words stand before each of some ascending places in words joined by single spaces."""
    out, at, n = [], 0, 0
    for start in starts:
        n += text.count(b" ", at, start)
        at = start
        out.append(n)
    return out


#: A-Z to a-z, and each byte that is in no word to a space.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


class Scanner:
    """Scans texts for phrases and notices; keeps compiled patterns for a task."""

    def __init__(self, phrases: dict[str, str], notices: dict[str, str]):
        self.phrases = [(p.encode(), _phrase_pattern(p), label) for p, label in phrases.items()]
        self.notices = [compile_notice(t, label) for t, label in notices.items()]
        ids = b"|".join(re.escape(i.encode()) for i in sorted(IDENTIFIERS, key=len, reverse=True))
        self.tagged = re.compile(rb"(?<![^ ])" + TAG.encode() + rb" (" + ids + rb")(?![^ ])")
        users: dict[str, list[tuple[int, int]]] = {}
        for k, notice in enumerate(self.notices):
            for seed, at in notice.seeds:
                users.setdefault(seed.decode("latin-1"), []).append((k, at + len(seed) - 1))
        self.seeds = ahocorasick.Automaton()
        for seed, of in users.items():
            self.seeds.add_word(seed, of)
        if users:
            self.seeds.make_automaton()

    def starts(self, joined: bytes) -> dict[int, list[int]]:
        """Of each notice with seeds in the words, where its start would be by every hit."""
        found: dict[int, list[int]] = {}
        if len(self.seeds):
            for end, of in self.seeds.iter(joined.decode("latin-1")):
                for k, back in of:
                    found.setdefault(k, []).append(end - back)
        return found

    def scan(self, raw: bytes) -> tuple[int, list, list]:
        """Number of words, [(first word, label)], [(start, end, edits, label, length)]: exact phrases by word, notices by place in the joined words."""
        words = raw.translate(_WORDS).split()
        joined = b" ".join(words)
        places = []
        for phrase, pattern, label in self.phrases:
            if phrase in joined:
                places += [(k, label) for k in word_places(joined, [m.start() for m in pattern.finditer(joined)])]
        spans = []
        for k, starts in self.starts(joined).items():
            notice = self.notices[k]
            spans += [(a, b, e, notice.label, len(notice.text)) for a, b, e in fuzzy_spans(joined, notice, starts)]
        if TAG.encode() in joined:
            spans += [(m.start(), m.end(), 0, IDENTIFIERS[m[1].decode()], m.end() - m.start()) for m in self.tagged.finditer(joined)]
        return len(words), sorted(places), sorted(spans)


SPANS = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32())]))
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:long,end:long,edits:int>>"


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES) -> DataFrame:
    """Per row its base places, labels, score and the fuzzy notices' spans.

    Spans are bytes of the text's words in lower case joined by single spaces.
    The score is that of the best match: 1 for exact phrases, else 1 less the
    share of edited characters.
    """

    def run(batches):
        scanner = Scanner(phrases, notices)
        for batch in batches:
            for at, to, texts in slices(batch, "text"):
                rows = {k: [] for k in ("n_words", "n_base", "first", "last", "base", "labels", "score", "spans")}
                for raw in texts:
                    n_words, places, spans = scanner.scan(raw)
                    rows["n_words"].append(n_words)
                    base = {label for _, label in places}
                    rows["n_base"].append(len(places))
                    rows["first"].append(places[0][0] if places else None)
                    rows["last"].append(places[-1][0] if places else None)
                    rows["base"].append(",".join(sorted(base)))
                    rows["labels"].append(",".join(sorted(base | {s[3] for s in spans})))
                    rows["score"].append(1.0 if places else max((1 - s[2] / s[4] for s in spans), default=0.0))
                    rows["spans"].append([{"label": s[3], "start": s[0], "end": s[1], "edits": s[2]} for s in spans])
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), SPANS]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(at, to - at), *(pa.array(v, k) for v, k in zip(rows.values(), kinds))],
                    ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def op6_license_scan(spark, sf_dir: str) -> DataFrame:
    """``spans`` lists label:start:end:edits of every fuzzy match."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    shown = F.transform("spans", lambda s: F.concat_ws(":", s["label"], s["start"].cast("string"), s["end"].cast("string"), s["edits"].cast("string")))
    return found.withColumn("spans", F.array_join(shown, ","))


#: SQL has no bounded-error matching; tests hold the result against brute force.
ORACLE_SQL: dict = {}
QUERIES = {"op6_license_scan": op6_license_scan}
