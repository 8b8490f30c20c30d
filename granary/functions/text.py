"""Strings: key=value descriptions, clean-up, verdict and label parsing, signatures."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Blank characters as Unicode counts them, for regular expressions.
BLANKS = r"(?U)[\s\x{3000}]+"
#: The same, one by one.
BLANK = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Fixed values of the description format.
CATEGORY, REMARK, VISIBILITY, TEXT, DISTANCE, READABLE = "类别", "备注", "可见性", "文本", "站点距离", "可读性"
KNOWN_NOTES = ("这里已经帮助修改,请注意参考学习", "这里已经帮助修改，请注意参考学习")
PASS_WORDS, FAIL_WORDS = ("pass", "1", "通过", "审核通过"), ("fail", "2", "不通过", "审核不通过")


def let(value: Column, use) -> Column:
    """use(value) with the value worked out once, however often it is named; Spark's array functions do not share what is repeated inside."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip_blanks(text: Column) -> Column:
    """Without blanks at both ends; only the ends are read."""
    return F.btrim(text, F.lit(BLANK))


def strip_all_blanks(text: Column) -> Column:
    return F.regexp_replace(text, BLANKS, "")


def kv_pairs(desc: Column) -> Column:
    """Ordered (k, v) of the tokens with '=', split at the first one; blanks go, duplicates stay."""
    tokens = F.filter(F.split(desc, ","), lambda t: F.contains(t, F.lit("=")))
    return F.transform(
        tokens,
        lambda t: F.struct(
            strip_all_blanks(F.substring_index(t, "=", 1)).alias("k"),
            strip_all_blanks(F.regexp_replace(t, "^[^=]*=", "")).alias("v"),
        ),
    )


def kv_first(pairs: Column, key: str) -> Column:
    """The value of a key's first pair."""
    return F.get(F.filter(pairs, lambda p: p["k"] == key), F.lit(0))["v"]


def kv_map(pairs: Column) -> Column:
    """A map of the pairs; of equal keys the last wins."""
    last = lambda ps: F.filter(ps, lambda p, i: ~F.exists(F.slice(ps, i + 2, F.size(ps)), lambda q: q["k"] == p["k"]))
    return let(pairs, lambda ps: F.map_from_entries(last(ps)))


def kv_multimap(pairs: Column) -> Column:
    """A map from key to all its values, split at '|', in order."""
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    values = F.transform(
        keys,
        lambda k: F.filter(F.flatten(F.transform(F.filter(pairs, lambda p: p["k"] == k), lambda p: F.split(p["v"], r"\|"))), lambda v: v != ""),
    )
    return F.map_from_arrays(keys, values)


def value_after(desc: Column, key: str) -> Column:
    """What follows the first 'key=' anywhere, up to a comma, trimmed."""
    return F.trim(F.regexp_extract(desc, f"{key}=([^,]*)", 1))


def head(desc: Column) -> Column:
    """The category without what follows its first slash."""
    return F.substring_index(value_after(desc, CATEGORY), "/", 1)


def drop_tokens(desc: Column, marker: str) -> Column:
    return F.array_join(F.filter(F.split(desc, ","), lambda t: ~F.contains(t, F.lit(marker))), ",")


def fold_stray(desc: Column, free_text_keys: tuple[str, ...] = (TEXT, REMARK)) -> Column:
    """Tokens without '=' join the remark, unless they continue a free text to their left."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.array().cast("array<string>").alias("stray"), F.lit("").alias("key"))

    def step(s: Column, raw: Column) -> Column:
        t = F.trim(raw)
        pair = F.contains(t, F.lit("="))
        free = s["key"].isin(*free_text_keys)
        last = F.concat(F.element_at(s["out"], -1), F.lit(","), t)
        longer = F.concat(F.slice(s["out"], 1, F.size(s["out"]) - 1), F.array(last))
        return F.struct(
            F.when(pair, F.concat(s["out"], F.array(t))).when(free, longer).otherwise(s["out"]).alias("out"),
            F.when(pair | free | (t == ""), s["stray"]).otherwise(F.concat(s["stray"], F.array(t))).alias("stray"),
            F.when(pair, F.substring_index(t, "=", 1)).otherwise(s["key"]).alias("key"),
        )

    def done(s: Column) -> Column:
        is_remark = lambda t: F.startswith(t, F.lit(REMARK + "="))
        extra = F.array_join(s["stray"], ",")
        merged = F.transform(s["out"], lambda t: F.when(is_remark(t), F.concat(t, F.lit(","), extra)).otherwise(t))
        added = F.when(F.exists(s["out"], is_remark), merged).otherwise(F.concat(s["out"], F.array(F.concat(F.lit(REMARK + "="), extra))))
        return F.array_join(F.when(F.size(s["stray"]) == 0, s["out"]).otherwise(added), ",")

    return F.aggregate(F.split(desc, ","), start, step, done)


def set_token(desc: Column, key: str, value: str) -> Column:
    """Rewrite the value of tokens that are exactly 'key=…'."""
    return F.array_join(F.transform(F.split(desc, ","), lambda t: F.when(F.startswith(F.trim(t), F.lit(key + "=")), f"{key}={value}").otherwise(t)), ",")


def clean_free_text(text: Column) -> Column:
    """Known notes out, blanks out, comma runs to one comma, no comma at the ends."""
    out = strip_all_blanks(text)
    for note in KNOWN_NOTES:
        out = F.replace(out, F.lit(note), F.lit(""))
    return F.btrim(F.regexp_replace(out, "[,，]{2,}", ","), F.lit(",，"))


def first_digits(text: Column) -> Column:
    """The first run of digits; null if there is none."""
    return F.nullif(F.regexp_extract(text.cast("string"), "([0-9]+)", 1), F.lit(""))


def first_int(text: Column) -> Column:
    """The same as a number, so that leading zeros go."""
    return first_digits(text).try_cast("long")


def full_width_escapes(text: Column) -> Column:
    """The format's own characters as full-width ones."""
    return F.translate(text, ",|=", "，｜＝")


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode NFKC, which Spark has no function for."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def ocr_normal(text: Column) -> Column:
    """Full-width punctuation to ASCII, blanks out, upper case."""
    return F.upper(F.translate(strip_all_blanks(text), "（）：，；－／．", "():,;-/."))


def strip_special(text: Column, tokens: tuple[str, ...] = ("<|endoftext|>", "<|im_end|>")) -> Column:
    for t in tokens:
        text = F.replace(text, F.lit(t), F.lit(""))
    return F.btrim(text, F.lit(" \t\r\n"))


LINE_END = "\\r\\n|[\\n\\r\\x0B\\f\\x1C-\\x1E\\x85\\u2028\\u2029]"


def lines(text: Column) -> Column:
    """Non-blank lines, trimmed at both ends."""
    split = F.transform(F.split(text, LINE_END), lambda x: F.btrim(x, F.lit(" \t　")))
    return F.filter(split, lambda x: x != "")


def drop_header(text: Column, prefix: str = "<DOMAIN=") -> Column:
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: ~F.startswith(F.ltrim(x), F.lit(prefix))), "\n")


def header_of(text: Column) -> Column:
    """(domain, task) of a first line '<DOMAIN=…>, <TASK=…>'."""
    first = F.get(lines(text), F.lit(0))
    pattern = r"^<DOMAIN=([A-Z]+)>, ?<TASK=([A-Z]+)>$"
    got = F.struct(F.regexp_extract(first, pattern, 1).alias("domain"), F.regexp_extract(first, pattern, 2).alias("task"))
    return F.when(first.rlike(pattern), got)


def normal_label(label: Column) -> Column:
    """pass or fail from the words for either; null for others."""
    low = F.lower(F.trim(label.cast("string")))
    return F.when(low.isin(*PASS_WORDS), "pass").when(low.isin(*FAIL_WORDS), "fail")


def verdict_of(text: Column) -> Column:
    """(format_ok, verdict, reason) of exactly two non-blank lines 'Verdict: …' and 'Reason: …'."""
    two = lines(text)
    pattern = r"(?i)^\s*{}\s*[:：]\s*(.*)$"
    verdict = normal_label(F.regexp_extract(F.get(two, F.lit(0)), pattern.format("verdict"), 1))
    reason = F.trim(F.regexp_extract(F.get(two, F.lit(1)), pattern.format("reason"), 1))
    ok = (F.size(two) == 2) & verdict.isNotNull() & (reason != "")
    return F.struct(F.coalesce(ok, F.lit(False)).alias("format_ok"), F.when(ok, verdict).alias("verdict"), F.when(ok, reason).alias("reason"))


def truncate_at(text: Column, stops: tuple[str, ...]) -> Column:
    """The text before the earliest stop string."""
    places = F.filter(F.array(*[F.position(F.lit(s), text) for s in stops]), lambda p: p > 0)
    return F.when(F.size(places) > 0, F.substr(text, F.lit(1), F.array_min(places) - 1)).otherwise(text)


def shorten(text: Column, n: int) -> Column:
    return F.when(F.char_length(text) > n, F.concat(F.left(text, F.lit(n - 1)), F.lit("…"))).otherwise(text)


def signature(text: Column, synonyms: tuple[tuple[str, str], ...] = (("如果", "若"), ("如若", "若"))) -> Column:
    """A rule's text in lower case with synonyms merged and blanks and punctuation out."""
    out = F.lower(text)
    for a, b in synonyms:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.regexp_replace(out, r"(?U)[\p{P}\p{S}\s]+", "")


def tight_cjk(text: Column) -> Column:
    """No blanks between CJK characters or beside CJK punctuation; other runs of blanks are one."""
    out = F.regexp_replace(text, r"(?<=[\x{4E00}-\x{9FFF}])\s+(?=[\x{4E00}-\x{9FFF}])", "")
    out = F.regexp_replace(out, r"\s*([，。；：！？、])\s*", "$1")
    return F.trim(F.regexp_replace(out, r"[ \t]+", " "))


def categories(text: Column, rules: dict[str, str], other: str = "other") -> Column:
    """Names of all rules (name: pattern) that a text matches; ``[other]`` if none does."""
    hits = F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(n)) for n, p in rules.items()]))
    return F.when(F.size(hits) > 0, hits).otherwise(F.array(F.lit(other)))


def any_token(text: Column, tokens: tuple[str, ...]) -> Column:
    return F.exists(F.array(*[F.lit(t) for t in tokens]), lambda t: F.contains(text, t))


def contradiction(base: Column, remark: Column, positive: tuple[str, ...], negative: tuple[str, ...]) -> Column:
    """A positive word in one text and a negative one in the other."""
    return any_token(base, positive) & any_token(remark, negative)


def clean_description(desc: Column) -> Column:
    """Whether a description has no control blanks, double spaces or spaces around its separators."""
    return ~desc.rlike(r"[\n\r\t]| ,|, | /|/ |  |^ | $")


def count_listed(text: Column, separator: str = "，") -> Column:
    """Non-blank parts of a list."""
    return F.size(F.filter(F.split(text, separator), lambda t: F.trim(t) != ""))


def natural_key(name: Column, width: int = 12) -> Column:
    """A key that sorts digit runs by value: each is padded with zeros to ``width``."""
    runs = F.regexp_extract_all(name, F.lit("([0-9]+|[^0-9]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike("^[0-9]+$"), F.lpad(r, width, "0")).otherwise(F.lower(r))), "")


def numbered(items: Column) -> Column:
    """A numbered list, one item a line."""
    return F.array_join(F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")
