"""JSON in texts: extraction, duplicate keys, summary documents and their facts."""

from __future__ import annotations

import json
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The keys of a summary document.
STATS, NOTES, GROUPS, CATEGORY = "统计", "备注", "分组统计", "类别"
IRRELEVANT = "无关图片"
DOCUMENT = f"struct<`{STATS}`:array<map<string,string>>,`{NOTES}`:array<string>,`{GROUPS}`:map<string,string>>"


def is_object(text: Column) -> Column:
    """A JSON object and nothing behind it: Spark's parser stops at an object's end, but not inside a list."""
    return F.json_object_keys(text).isNotNull() & (F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1)


def object_in(text: Column) -> Column:
    """The JSON object a text holds: all of it, else its last line that is one, else a repaired 'key=[…]', else its widest braces."""
    rows = F.filter(F.split(text, "\n"), lambda x: F.startswith(F.trim(x), F.lit("{")) & is_object(F.trim(x)))
    wide = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    repaired = F.regexp_replace(F.regexp_extract(text, rf"(?s)(({STATS}|{NOTES})\s*[=:]\s*\[.*\])", 1), rf"^({STATS}|{NOTES})\s*[=:]\s*", '{"$1": ')
    repaired = F.when(repaired != "", F.concat(repaired, F.lit("}")))
    return F.coalesce(
        F.when(is_object(F.trim(text)), F.trim(text)),
        F.when(F.size(rows) > 0, F.trim(F.element_at(rows, -1))),
        F.when(is_object(repaired), repaired),
        F.when(is_object(wide), wide),
    )


@F.pandas_udf(T.BooleanType())
def has_duplicate_keys(text: pd.Series) -> pd.Series:
    """A key twice in one object at any depth; null if the text is no JSON. Spark's parser keeps the last silently."""

    def check(t):
        twice = []

        def seen(items):
            twice.append(len({k for k, _ in items}) < len(items))
            return dict(items)

        try:
            json.loads(t, object_pairs_hook=seen)
        except (TypeError, ValueError):
            return None
        return any(twice)

    return text.map(check)


@F.pandas_udf(T.StringType())
def stable_json(text: pd.Series) -> pd.Series:
    """The summary on one line, its own keys first, separators ', ' and ': '."""
    first = {k: i for i, k in enumerate((STATS, NOTES, GROUPS))}

    def show(t):
        try:
            doc = json.loads(t)
        except (TypeError, ValueError):
            return None
        if isinstance(doc, dict):
            doc = dict(sorted(doc.items(), key=lambda kv: (first.get(kv[0], len(first)), 0 if kv[0] in first else 1)))
        return json.dumps(doc, ensure_ascii=False, separators=(", ", ": "))

    return text.map(show)


_shown = json.JSONEncoder(ensure_ascii=False, sort_keys=True).encode


def _ordered(x, name=None):
    """With the items of the lists of statistics and notes in order."""
    if isinstance(x, dict):
        return {k: _ordered(v, k) if isinstance(v, (dict, list)) else v for k, v in x.items()}
    items = [_ordered(v) if isinstance(v, (dict, list)) else v for v in x]
    return sorted(items, key=_shown) if name in (STATS, NOTES) and len(items) > 1 else items


def _canonical(doc) -> str | None:
    try:
        return _shown(_ordered(doc) if isinstance(doc, (dict, list)) else doc)
    except (TypeError, ValueError, RecursionError):
        return None


@F.pandas_udf(T.StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    """Keys sorted at every depth, and the items of the lists of statistics and notes: equality regardless of their order."""

    def show(t):
        try:
            return _canonical(json.loads(t))
        except (TypeError, ValueError, RecursionError):
            return None

    return text.map(show)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, k) for n, k in fields.items()])


_NAME, _NAMES, _FLAG = T.StringType(), T.ArrayType(T.StringType()), T.BooleanType()
#: What a summary holds: ``valid`` JSON, an ``object``, a key ``twice``, top-level ``keys``, entries with
#: their attributes (``mapped``: an object, with its keys), distinct categories with their distinct attribute
#: names, facts with counts, notes and group names.
PARTS = _struct(
    valid=_FLAG,
    object=_FLAG,
    twice=_FLAG,
    keys=_NAMES,
    entries=T.ArrayType(_struct(category=_NAME, attributes=T.ArrayType(_struct(name=_NAME, mapped=_FLAG, keys=_NAMES)))),
    named=T.ArrayType(_struct(category=_NAME, names=_NAMES)),
    facts=T.ArrayType(_struct(f0=_NAME, f1=_NAME, f2=_NAME, f3=_NAME, n=T.LongType())),
    notes=_NAMES,
    groups=_NAMES,
)
#: Two summaries, and whether they are the same object but for order.
PAIR = _struct(mine=PARTS, theirs=PARTS, same=_FLAG)
#: Attributes whose values are free text, and those whose values are numbers in text.
FREE_TEXT, DIGITS = ("文本",), ("站点距离", "组")


def _squeezed(value) -> str:
    return "".join(str(value).split())


def _number_in(value) -> str:
    bare = _squeezed(value)
    found = re.search(r"\d+", bare)
    return str(int(found[0])) if found else bare


def _count(value) -> int:
    """A positive whole number, also one in text; else 0."""
    if type(value) is int:
        return max(value, 0)
    if isinstance(value, bool) or not isinstance(value, (int, float, str)):
        return 0
    try:
        whole = int(value)
    except (ValueError, OverflowError):
        return 0
    return whole if whole > 0 and (isinstance(value, str) or whole == value) else 0


def _facts_of(doc: dict) -> dict[tuple, int]:
    found = {}

    def add(fact, n):
        if n:
            found[fact] = found.get(fact, 0) + n

    if doc.get("dataset") is not None and _squeezed(doc["dataset"]):
        found["dataset", _squeezed(doc["dataset"]), None, None] = 1
    for note in doc.get(NOTES) if isinstance(doc.get(NOTES), list) else []:
        if note is not None and _squeezed(note):
            found[NOTES, _squeezed(note), None, None] = 1
    for group, n in doc.get(GROUPS).items() if isinstance(doc.get(GROUPS), dict) else []:
        if _number_in(group):
            add((GROUPS, _number_in(group), None, None), _count(n))
    for entry in _entries_of(doc):
        category = str(entry.get(CATEGORY, "")).strip() if entry.get(CATEGORY) is not None else ""
        for name, value in entry.items() if category else ():
            attribute = name.strip()
            if name == CATEGORY or not attribute:
                continue
            pairs = value.items() if isinstance(value, dict) else ((v, 1) for v in (value if isinstance(value, list) else [value]))
            for shown, n in pairs:
                shown = str(shown).strip()
                shown = _squeezed(shown) if attribute in FREE_TEXT else _number_in(shown) if attribute in DIGITS else shown
                if shown:
                    add((STATS, category, attribute, shown), _count(n))
    return found


def _entries_of(doc: dict) -> list[dict]:
    stats = doc.get(STATS)
    return [e for e in stats if isinstance(e, dict)] if isinstance(stats, list) else []


def _arrow(values, kind: T.DataType) -> pa.Array:
    """Python values as Arrow, of nulls, texts, numbers, lists and tuples for structs, field by field instead of value by value."""
    if isinstance(kind, T.StructType):
        columns = list(zip(*values)) or [()] * len(kind)
        return pa.StructArray.from_arrays([_arrow(c, f.dataType) for c, f in zip(columns, kind)], kind.names)
    if isinstance(kind, T.ArrayType):
        ends, flat = [0], []
        for row in values:
            flat += row or ()
            ends.append(len(flat))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), _arrow(flat, kind.elementType), mask=pa.array([r is None for r in values], pa.bool_()))
    return pa.array(values, {"string": pa.string(), "boolean": pa.bool_(), "bigint": pa.int64()}[kind.simpleString()])


def _parser():
    """A function from a text to its PARTS as a tuple."""
    twice = []

    def seen(items):
        found = dict(items)
        if len(found) < len(items):
            twice.append(True)
        return found

    read, nothing = json.JSONDecoder(object_pairs_hook=seen).decode, (None,) * 6

    def parts(t) -> tuple:
        twice.clear()
        try:
            doc = read(t)
        except (TypeError, ValueError, RecursionError):
            return (False, False, bool(twice), *nothing)
        if not isinstance(doc, dict):
            return (True, False, bool(twice), *nothing)
        entries, named = [], {}
        for e in _entries_of(doc):
            if isinstance(e.get(CATEGORY), str) and e[CATEGORY].strip():
                attributes = [(k.strip(), isinstance(v, dict), [str(x).strip() for x in v] if isinstance(v, dict) else []) for k, v in e.items() if k != CATEGORY and k.strip()]
                entries.append((e[CATEGORY].strip(), attributes))
                named.setdefault(entries[-1][0], {}).update(dict.fromkeys(a[0] for a in attributes))
        notes, groups = doc.get(NOTES), doc.get(GROUPS)
        return (
            True,
            True,
            bool(twice),
            list(doc),
            entries,
            [(c, list(names)) for c, names in named.items()],
            [(*fact, n) for fact, n in _facts_of(doc).items()],
            [str(x) for x in notes if x is not None] if isinstance(notes, list) else [],
            [k for k in groups if k.strip()] if isinstance(groups, dict) else [],
        )

    return parts


def _same(mine: str, theirs: str, my: tuple, their: tuple) -> bool:
    """As by ``canonical_json``, of two objects; what differs in keys or facts need not be written out."""
    objects, keys, facts = (PARTS.names.index(n) for n in ("object", "keys", "facts"))
    if not (my[objects] and their[objects]) or mine == theirs:
        return my[objects] and their[objects]
    if sorted(my[keys]) != sorted(their[keys]) or set(my[facts]) != set(their[facts]):
        return False
    text = _canonical(json.loads(mine))
    return text is not None and text == _canonical(json.loads(theirs))


@F.arrow_udf(PAIR)
def summary_pair(mine: pa.Array, theirs: pa.Array) -> pa.Array:
    """What two summaries' JSON texts hold, see PARTS, and whether they are the same; null texts are not valid."""
    parts = _parser()
    texts = list(zip(mine.to_pylist(), theirs.to_pylist()))
    found = [(parts(a), parts(b)) for a, b in texts]
    return _arrow([(*both, _same(*pair, *both)) for pair, both in zip(texts, found)], PAIR)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())])))
def string_values(text: pd.Series) -> pd.Series:
    """The top-level string values of an object with their keys, in order; null if the text is no object."""

    def values(t):
        try:
            doc = json.loads(t)
        except (TypeError, ValueError):
            return None
        return [{"key": k, "value": v} for k, v in doc.items() if isinstance(v, str)] if isinstance(doc, dict) else None

    return text.map(values)


def document(text: Column) -> Column:
    """The summary's struct; null where there is no object."""
    found = object_in(text)
    return F.when(found.isNotNull(), F.from_json(found, DOCUMENT))


def facts(doc: Column) -> Column:
    """(f1 category, f2 attribute, f3 value, n) of a document, one per value."""
    entries = F.coalesce(doc[STATS], F.array().cast("array<map<string,string>>"))

    def of_entry(e: Column) -> Column:
        attributes = F.filter(F.map_entries(e), lambda a: a["key"] != CATEGORY)

        def of_attribute(a: Column) -> Column:
            counts = F.coalesce(F.map_entries(F.from_json(a["value"], "map<string,int>")), F.array().cast("array<struct<key:string,value:int>>"))
            return F.transform(counts, lambda c: F.struct(F.element_at(e, CATEGORY).alias("f1"), a["key"].alias("f2"), c["key"].alias("f3"), F.coalesce(c["value"], F.lit(1)).alias("n")))

        return F.flatten(F.transform(attributes, of_attribute))

    return F.flatten(F.transform(entries, of_entry))


def category_names(doc: Column) -> Column:
    entries = F.coalesce(doc[STATS], F.array().cast("array<map<string,string>>"))
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(entries, lambda e: F.try_element_at(e, F.lit(CATEGORY))))))


def attribute_paths(doc: Column) -> Column:
    """Distinct 'category/attribute' of a document."""
    return paths_of(facts(doc))


def paths_of(found: Column) -> Column:
    """Distinct 'category/attribute' of facts."""
    return F.array_distinct(F.transform(found, lambda f: F.concat_ws("/", f["f1"], f["f2"])))


def entry_of(doc: Column, category: str) -> Column:
    return F.get(F.filter(doc[STATS], lambda e: F.try_element_at(e, F.lit(CATEGORY)) == category), F.lit(0))
