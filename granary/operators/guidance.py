"""Guidance texts like a given one: the first near match in key order, by the ratio of common blocks."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.functions.text import tight_cjk

SCAFFOLD = r"^\s*S[0-9]+\s*$"
MARKS = r"[，,。.!！？;；:：\-—_()（）\[\]{}<>《》“”\"'·~]"


def guidance_signature(text: Column) -> Column:
    """A text in lower case with marks as blanks and blanks tightened: what is compared."""
    return F.btrim(tight_cjk(F.regexp_replace(F.lower(tight_cjk(text)), MARKS, " ")))


def _ratio(a: str, b: str, least: float) -> float:
    """difflib's ratio of common blocks, or 0 where its quick bound is under ``least``."""
    matcher = difflib.SequenceMatcher(None, a, b)
    return matcher.ratio() if matcher.quick_ratio() >= least else 0.0


def block_ratio(least: float = 0.0):
    """Column function (a, b): twice the length of the longest common blocks, found recursively, over both lengths; 0 under ``least``, null for nulls."""

    @F.pandas_udf(T.DoubleType())
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else _ratio(x, y, least) for x, y in zip(a, b)], dtype="Float64").astype("float64")

    return ratio


def similar_guidance(texts: DataFrame, guidance: DataFrame, key: str, by: str, least: float = 0.9, contained: float = 0.85) -> DataFrame:
    """``key``, guidance_key (null if none is like the text).

    texts: key, by, text; guidance: by, guidance_key, ordinal, text. A book's
    entries are tried in their order, scaffold keys (S and a number) left out:
    the first that equals the text, or holds it or lies in it at a length of at
    least ``contained`` of the longer one, is taken; else the first of the
    highest ratio if that is ``least`` or more. Pairs whose lengths alone rule
    both out are never compared; a text's pairs meet in a partial aggregation.
    """
    a = texts.select(key, by, guidance_signature(F.col("text")).alias("a")).where("a <> ''")
    b = guidance.where(~F.rlike("guidance_key", F.lit(SCAFFOLD))).select(by, "guidance_key", "ordinal", guidance_signature(F.col("text")).alias("b")).where("b <> ''")
    size_a, size_b = F.char_length("a"), F.char_length("b")
    alike = (F.col("a") == F.col("b")) | ((F.contains("a", F.col("b")) | F.contains("b", F.col("a"))) & (F.least(size_a, size_b) / F.greatest(size_a, size_b) >= contained))
    pairs = a.join(b, by).where(alike | (2 * F.least(size_a, size_b) / (size_a + size_b) >= least)).withColumn("alike", alike)
    compared = pairs.withColumn("ratio", block_ratio(least)(F.when(~F.col("alike"), F.col("a")), F.col("b")))
    first = F.min(F.when(F.col("alike"), F.struct("ordinal", "guidance_key")))
    best = F.max(F.when(F.col("ratio") >= least, F.struct("ratio", (-F.col("ordinal")).alias("o"), "guidance_key")))
    found = compared.groupBy(key).agg(F.coalesce(first["guidance_key"], best["guidance_key"]).alias("guidance_key"))
    return texts.select(key).join(found, key, "left")
