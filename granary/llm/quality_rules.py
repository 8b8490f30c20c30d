"""Quality rules as a bitmask ledger, in DataFrame functions only.

``ledger`` measures each text once, evaluates every rule once and stores one
failure bit per rule beside the measurements. A policy is a named and
versioned mask of rules: applying one is a bitwise AND over the ledger, and
``ablation`` tells by bitwise aggregation what each rule of a policy rejects,
alone and together with others, without another look at the texts.

Defined results: a null or empty text has no words, so it fails the rule on
few words; repeated rows and equal doc_ids are judged row by row; an empty
table gives no rows; other columns of the input stay out of the ledger. Work
on a text is near linear in its length (sorting its windows), texts are never
cut, and no rows move between tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import BLANK, BLANKS

WINDOW = 5
#: Lines that begin as list items do, and lines that break off.
BULLET = r"^[ \t]*[-*•‣]"
ELLIPSIS = r"(?:\.\.\.|…)[ \t\r]*\z"


def _words(text: Column) -> Column:
    bare = F.btrim(text, F.lit(BLANKS.decode()))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, BLANK))


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _covered(hashes: Column) -> Column:
    """How many words lie in windows whose hash occurs twice or more in ``hashes``."""

    def of_sorted(s: Column) -> Column:
        again = F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]))
        places = F.sort_array(F.transform(again, lambda x: x["i"]))
        return _let(
            places,
            lambda p: F.aggregate(
                F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)))),
                F.lit(0),
                lambda a, b: a + b,
            ),
        )

    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(_let(pairs, of_sorted))


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and the measurements of its text."""
    text = F.coalesce("text", F.lit(""))
    split = docs.select(
        "doc_id",
        _words(text).alias("words"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(BLANKS.decode())) != "").alias("lines"),
    )
    n = F.size("words")
    # A window is its five words side by side; hashed, it is a long.
    shifted = [F.slice("words", k + 1, F.greatest(n - WINDOW + 1, F.lit(0))) for k in range(WINDOW)]
    zipped = F.arrays_zip(*[s.alias(f"w{k}") for k, s in enumerate(shifted)])
    hashed = split.select(
        "doc_id",
        n.cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.filter("lines", lambda x: x.rlike(BULLET))).cast("long").alias("n_bullets"),
        F.size(F.filter("lines", lambda x: x.rlike(ELLIPSIS))).cast("long").alias("n_ellipses"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(n < WINDOW, F.array().cast("array<bigint>")).otherwise(F.transform(zipped, lambda w: F.xxhash64(w))).alias("hashes"),
    )
    return hashed.select(*[c for c in hashed.columns if c != "hashes"], _covered(F.col("hashes")).cast("long").alias("n_repeat_words"))


@dataclass(frozen=True)
class Rule:
    """A rule's failure condition as SQL over the measurements; its bit is its place in RULES."""

    name: str
    fails: str


#: Bits must keep their meaning: append rules, never reorder them.
RULES = (
    Rule("few_words", "n_words < 10"),
    Rule("repeats", "100 * n_repeat_words > 20 * n_words"),
    Rule("symbols", "10 * n_symbols > 3 * n_words"),
    Rule("duplicate_lines", "2 * n_dup_lines > n_lines"),
    Rule("long_words", "word_chars > 20 * n_words"),
    Rule("bullets", "10 * n_bullets > 9 * n_lines"),
    Rule("ellipses", "10 * n_ellipses > 3 * n_lines"),
    Rule("short_words", "word_chars < 3 * n_words"),
    Rule("crammed", "n_words > 200 * n_lines"),
)


@dataclass(frozen=True)
class Policy:
    """A version of what is rejected: any document with a failure bit inside the mask."""

    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << i for i, r in enumerate(RULES) if r.name in self.rules)


BASE = Policy("base", 1, ("few_words", "repeats"))
#: The one that counts last. What scripts without blanks, lists or single long paragraphs would fail is in the strict one alone.
POLICIES = (BASE, Policy("strict", 1, tuple(r.name for r in RULES)), Policy("web", 1, ("few_words", "repeats", "symbols")), Policy("web", 2, ("few_words", "repeats", "symbols", "duplicate_lines")))


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, measurements and ``fail_bits``: bit i is set where rule i fails."""
    measured = measure(docs)
    bits = F.lit(0).cast("long")
    for i, rule in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return measured.withColumn("fail_bits", bits)


def fails(policy: Policy, bits: str = "fail_bits") -> Column:
    return F.col(bits).bitwiseAND(F.lit(policy.mask).cast("long")) != 0


def keep(docs: DataFrame, policy: Policy = POLICIES[-1]) -> DataFrame:
    """The rows of ``docs`` that a policy does not reject, with their own columns."""
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc_id"), "text")
    # The bits pass through a generator: a filter on them would else move below the
    # measurements and evaluate their expressions again for each rule.
    judged = ledger(rows).select("doc_id", F.explode(F.array("fail_bits")).alias("bits"))
    return judged.where(~fails(policy, "bits")).select("doc_id.*")


def ablation(entries: DataFrame, policies=POLICIES) -> DataFrame:
    """Per policy and rule: documents the rule fails, and those it alone rejects.

    One pass over the ledger for all policies; the result has a row for each
    rule of each policy, whatever the number of documents.
    """
    cells = F.array(
        *[
            F.struct(
                F.lit(p.name).alias("policy"),
                F.lit(p.version).alias("version"),
                F.lit(r.name).alias("rule"),
                F.lit(1 << i).cast("long").alias("bit"),
                F.lit(p.mask).cast("long").alias("mask"),
            )
            for p in policies
            for i, r in enumerate(RULES)
            if r.name in p.rules
        ]
    )
    seen = entries.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    long = seen.select("fail_bits", "n", F.inline(cells))
    within = F.col("fail_bits").bitwiseAND(F.col("mask"))
    return long.groupBy("policy", "version", "rule").agg(
        F.sum("n").alias("n_docs"),
        F.sum(F.when(within.bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_fail"),
        F.sum(F.when(within == F.col("bit"), F.col("n")).otherwise(0)).alias("n_fail_alone"),
        F.sum(F.when(within != 0, F.col("n")).otherwise(0)).alias("n_rejected"),
        F.bit_or("fail_bits").alias("bits_seen"),
    )


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    entries = ledger(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return entries.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        fails(BASE).alias("base_failed"),
        (~fails(POLICIES[-1])).alias("kept"),
        "fail_bits",
    )


def op3_rule_ablation(spark, sf_dir: str) -> DataFrame:
    """What each rule of each policy rejects, alone and with others."""
    return ablation(ledger(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))).drop("bits_seen")


LEDGER_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
a AS (
  SELECT r, doc_id, list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda w: w <> '') AS words,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^ \t\n\x0B\f\r]')) AS lines
  FROM d),
w AS (
  SELECT r, i, words[i:i + 4] AS win FROM (SELECT r, words, unnest(range(1, len(words) - 3)) AS i FROM a WHERE len(words) >= 5)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS c FROM w) WHERE c >= 2),
gap AS (SELECT r, least(5, coalesce(lead(i) OVER (PARTITION BY r ORDER BY i) - i, 5)) AS g FROM twice),
cov AS (SELECT r, sum(g)::BIGINT AS n FROM gap GROUP BY r),
m AS (
  SELECT doc_id, len(list_filter(lines, lambda l: regexp_matches(l, '^[ \t]*[-*•‣]'))) AS n_bullets, len(list_filter(lines, lambda l: regexp_matches(l, '(?:\.\.\.|…)[ \t\r]*\z'))) AS n_ellipses,
    len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
    len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM a LEFT JOIN cov USING (r)),
f AS (
  SELECT *, (n_words < 10)::BIGINT + 2 * (100 * n_repeat_words > 20 * n_words)::BIGINT + 4 * (10 * n_symbols > 3 * n_words)::BIGINT
    + 8 * (2 * n_dup_lines > n_lines)::BIGINT + 16 * (word_chars > 20 * n_words)::BIGINT
    + 32 * (10 * n_bullets > 9 * n_lines)::BIGINT + 64 * (10 * n_ellipses > 3 * n_lines)::BIGINT + 128 * (word_chars < 3 * n_words)::BIGINT + 256 * (n_words > 200 * n_lines)::BIGINT AS fail_bits FROM m)
"""
ORACLE_SQL = {
    "op3_quality_rules": LEDGER_SQL
    + """SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed, (fail_bits & 15) = 0 AS kept, fail_bits
FROM f
""",
    "op3_rule_ablation": LEDGER_SQL
    + f""", p AS (SELECT unnest([{", ".join(f"{{'policy': '{p.name}', 'version': {p.version}, 'rule': '{r.name}', 'bit': {1 << i}, 'mask': {p.mask}}}" for p in POLICIES for i, r in enumerate(RULES) if r.name in p.rules)}], recursive := true))
SELECT policy, "version"::INT AS "version", rule, count(*) AS n_docs, count(*) FILTER (fail_bits & bit <> 0) AS n_fail, count(*) FILTER (fail_bits & mask = bit) AS n_fail_alone, count(*) FILTER (fail_bits & mask <> 0) AS n_rejected
FROM f, p GROUP BY ALL
""",
}
QUERIES = {"op3_quality_rules": op3_quality_rules, "op3_rule_ablation": op3_rule_ablation}
