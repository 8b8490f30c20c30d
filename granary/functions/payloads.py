"""JSON payloads: deep merges, recursive differences, and records read with lenient types."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.functions.text import let

DIFFERENCES = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("path", "left", "right")]))


def _shown(value) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def _merged(base, override):
    if not (isinstance(base, dict) and isinstance(override, dict)):
        return override
    return base | {k: _merged(base[k], v) if k in base else v for k, v in override.items()}


def _differences(left, right, path: str) -> list[tuple]:
    if isinstance(left, dict) and isinstance(right, dict):
        out = []
        for key in sorted({*left, *right}):
            at = f"{path}.{key}" if path else key
            if key in left and key in right:
                out += _differences(left[key], right[key], at)
            else:
                out.append((at, _shown(left[key]) if key in left else None, _shown(right[key]) if key in right else None))
        return out
    return [] if left == right else [(path, _shown(left), _shown(right))]


@F.pandas_udf(T.StringType())
def deep_merge(base: pd.Series, override: pd.Series) -> pd.Series:
    """Two JSON documents as one, keys in order: objects are merged key by key, anything else of the override wins; a null document adds nothing."""
    return pd.Series([a if b is None else _shown(_merged(json.loads(a) if a is not None else {}, json.loads(b))) if a is not None else _shown(json.loads(b)) for a, b in zip(base, override)], dtype=object)


@F.pandas_udf(DIFFERENCES)
def differences(left: pd.Series, right: pd.Series) -> pd.Series:
    """(path, left, right) where two JSON documents differ: objects are compared key by key, lists and scalars whole; a side without the key is null, and so is a null document's."""

    def of(a, b):
        if a is None or b is None:
            return [] if a is b else [("", None if a is None else _shown(json.loads(a)), None if b is None else _shown(json.loads(b)))]
        return _differences(json.loads(a), json.loads(b), "")

    return pd.Series([of(a, b) for a, b in zip(left, right)], dtype=object)


def merged_documents(base: DataFrame, override: DataFrame, key: str, document: str) -> DataFrame:
    """key, document: the documents of both tables by key, the override's values on top."""
    both = base.select(key, F.col(document).alias("_a")).join(override.select(key, F.col(document).alias("_b")), key, "full")
    return both.select(key, deep_merge("_a", "_b").alias(document))


def document_differences(left: DataFrame, right: DataFrame, key: str, document: str) -> DataFrame:
    """key, path, left, right: a row for each place where the documents of two tables differ."""
    both = left.select(key, F.col(document).alias("_a")).join(right.select(key, F.col(document).alias("_b")), key, "full")
    return both.select(key, F.explode(differences("_a", "_b")).alias("d")).select(key, "d.*")


# --- lenient types --------------------------------------------------------


def _kind(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value), F.lit("VOID"))


def _as(value: Column, kind: str) -> Column:
    return F.try_variant_get(value, F.lit("$"), kind)


def lenient_text(value: Column) -> Column:
    """A variant as text: '' for null, false, zero and empty ones; lists and objects as JSON."""

    def of(x: Column) -> Column:
        zero = F.coalesce(_as(x["v"], "double") == 0, F.lit(False)) & (_kind(x["v"]) != "STRING")
        return F.when(x["t"].isNull() | x["t"].isin("", "false", "[]", "{}"), "").when(_kind(x["v"]).isin("VOID") | zero, "").otherwise(x["t"])

    text = lambda v: F.struct(v.alias("v"), F.btrim(F.coalesce(_as(v, "string"), F.to_json(v))).alias("t"))
    return F.when(value.isNull(), "").otherwise(let(let(value, text), of))


def lenient_int(value: Column) -> Column:
    """A variant as a whole number: numbers are cut to one, booleans are 0 or 1, texts count if they are whole numbers; else null."""

    def of(x: Column) -> Column:
        kind, v = x["k"], x["v"]
        whole = let(F.btrim(_as(v, "string")), lambda t: F.when(F.rlike(t, F.lit(r"^[+-]?[0-9]+(_[0-9]+)*$")), F.replace(t, F.lit("_"), F.lit("")).try_cast("bigint")))
        number = F.coalesce(_as(v, "bigint"), _as(v, "double").try_cast("bigint"))
        return F.when(kind == "STRING", whole).when(kind == "BOOLEAN", _as(v, "boolean").cast("bigint")).when(kind.isin("BIGINT", "DOUBLE", "FLOAT") | F.startswith(kind, F.lit("DECIMAL")), number)

    return let(let(value, lambda v: F.struct(v.alias("v"), _kind(v).alias("k"))), of)


#: The fields of a stored hypothesis.
FIELDS = ("signature", "text", "falsifier", "dimension", "status", "support_cycles", "support_cycle_ids", "support_ticket_keys", "first_seen", "last_seen", "promoted_at", "rejected_at")


def hypothesis(payload: Column) -> Column:
    """A stored hypothesis with lenient types, as a struct; null if the payload is no JSON object.

    A payload is parsed once: all fields leave it in one cast to a struct of
    variants, which is null for what is no object.
    """
    items = lambda x: F.coalesce(_as(x, "array<variant>"), F.array().cast("array<variant>"))
    given = lambda x: F.when(x.isNotNull() & (_kind(x) != "VOID"), lenient_text(x))
    key = lambda x: F.coalesce(_as(x, "string"), F.to_json(x))

    def typed(x: Column) -> Column:
        fields = {
            "signature": lenient_text(x["signature"]),
            "text": lenient_text(x["text"]),
            "falsifier": given(x["falsifier"]),
            "dimension": given(x["dimension"]),
            "status": let(lenient_text(x["status"]), lambda t: F.when(t == "", "candidate").otherwise(t)),
            "support_cycles": F.coalesce(lenient_int(x["support_cycles"]), F.lit(0)),
            "support_cycle_ids": F.filter(F.transform(items(x["support_cycle_ids"]), lenient_int), lambda n: n.isNotNull()),
            "support_ticket_keys": F.filter(F.transform(items(x["support_ticket_keys"]), key), lambda t: F.btrim(t) != ""),
            "first_seen": lenient_text(x["first_seen"]),
            "last_seen": lenient_text(x["last_seen"]),
            "promoted_at": given(x["promoted_at"]),
            "rejected_at": given(x["rejected_at"]),
        }
        return F.when(x.isNotNull(), F.struct(*[fields[n].alias(n) for n in FIELDS]))

    return let(_as(F.try_parse_json(payload), "struct<" + ",".join(f"{n}:variant" for n in FIELDS) + ">"), typed)
