"""Scores of a generated summary against its reference, one double per row.

A text should have two lines: a header that names the domain (BBU or RRU) and
the task, and a JSON object. Rows of irrelevant images should say so instead,
and score 0 but for ``format`` and ``header``. ``prepare`` parses both texts
once; each score is a function of a Sample to a Column, and SCORES lists them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions import jsonx, text
from granary.functions.numeric import clamp

BBU, RRU = "BBU", "RRU"


class Sample:
    """Columns that ``prepare`` adds: text, lines, domain, irrelevant, expected, first, line, second, same, pred, ref."""

    def __getattr__(self, part: str) -> Column:
        return F.col(f"_{part}")


_stripped = text.strip_blanks


def prepare(rows: DataFrame, pred: str = "completion", ref: str = "summary_ref", domain: str = "domain", irrelevant: str | None = None) -> DataFrame:
    """The rows with a Sample's columns. ``irrelevant`` names a boolean column; such rows have no domain."""
    s = Sample()
    none = F.lit(None).cast("string")
    rows = rows.withColumns({"_irrelevant": F.coalesce(F.col(irrelevant), F.lit(False)) if irrelevant else F.lit(False), "_text": _stripped(text.strip_special(F.coalesce(F.col(pred), F.lit(""))))})
    rows = rows.withColumns(
        {
            "_domain": F.when(s.irrelevant, none).otherwise(F.col(domain)),
            "_lines": F.when(s.text == "", F.array().cast("array<string>")).otherwise(F.split(s.text, text.LINE_END)),
            "_reference": F.nullif(_stripped(F.col(ref)), F.lit("")),
        }
    )
    rows = rows.withColumns({"_expected": F.concat(F.lit("<DOMAIN="), s.domain, F.lit(">, <TASK=SUMMARY>")), "_first": _stripped(F.get(s.lines, F.lit(0))), "_line": _stripped(F.get(s.lines, F.lit(1)))})
    rows = rows.withColumn("_pair", jsonx.summary_pair(s.line, F.when(s.reference != jsonx.IRRELEVANT, s.reference)))
    rows = rows.withColumns({"_second": s.pair["mine"], "_known": s.pair["theirs"], "_same": s.pair["same"]})
    strict = (F.size(s.lines) == 2) & (s.first == s.expected)
    return rows.withColumns({"_strict": F.coalesce(strict, F.lit(False)), "_pred": F.when(F.coalesce(strict, F.lit(False)), s.second), "_ref": F.when(s.known["object"], s.known)})


# --- parts of the rules ---


def _flag(ok: Column, good=1.0, bad=0.0) -> Column:
    return F.when(F.coalesce(ok, F.lit(False)), F.lit(float(good))).otherwise(F.lit(float(bad)))


def _relevant(s: Sample, score: Column) -> Column:
    return F.when(s.irrelevant, 0.0).otherwise(F.coalesce(score.cast("double"), F.lit(0.0)))


def _objects(s: Sample) -> Column:
    return F.coalesce(s.pred["object"] & s.ref["object"], F.lit(False))


def _allowed(s: Sample) -> Column:
    """Both texts are objects without the other domain's top-level key."""
    banned = F.when(s.domain == RRU, jsonx.NOTES).when(s.domain == BBU, jsonx.GROUPS)
    free = lambda side: ~F.coalesce(F.array_contains(side["keys"], banned), F.lit(False))
    return _objects(s) & free(s.pred) & free(s.ref)


def _compared(s: Sample, score: Column) -> Column:
    return F.when(~s.irrelevant & _allowed(s), score.cast("double")).otherwise(0.0)


def _mean(values: Column) -> Column:
    """Of an array of doubles without nulls; null if it is empty."""
    return text.let(values, lambda vs: F.when(F.size(vs) > 0, F.aggregate(vs, F.lit(0.0), lambda a, v: a + v) / F.size(vs)))


def _shared(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def _both(a: Column, b: Column, use) -> Column:
    """use(a, b) with both worked out once, see ``text.let``."""
    return text.let(F.struct(a.alias("a"), b.alias("b")), lambda x: use(x["a"], x["b"]))


def categories(side: Column) -> Column:
    return F.transform(side["named"], lambda c: c["category"])


def attributes(side: Column, category: Column) -> Column:
    """Distinct attribute names of all entries of a category."""
    return F.coalesce(F.get(F.filter(side["named"], lambda c: c["category"] == category), F.lit(0))["names"], F.array().cast("array<string>"))


def overlap(a: Column, b: Column) -> Column:
    """Size of the intersection of two fact multisets."""
    same = lambda x, y: x["f3"].eqNullSafe(y["f3"]) & x["f2"].eqNullSafe(y["f2"]) & x["f1"].eqNullSafe(y["f1"]) & x["f0"].eqNullSafe(y["f0"])
    one = lambda x, ys: F.least(x["n"], F.coalesce(F.get(F.filter(ys, lambda y: same(x, y)), F.lit(0))["n"], F.lit(0)))
    return _both(a, b, lambda xs, ys: total(xs, lambda x: one(x, ys)))


def total(facts: Column, of=lambda f: f["n"]) -> Column:
    return F.aggregate(facts, F.lit(0).cast("long"), lambda s, f: s + of(f))


# --- scores ---

HEADER = r"^<DOMAIN=[A-Z]+>, <TASK=[A-Z]+>$"


def layout(s: Sample) -> Column:
    """Two lines, a header and what ends like an object; of an irrelevant image the one word for it."""
    two = (F.size(s.lines) == 2) & s.first.rlike(HEADER) & F.endswith(s.line, F.lit("}"))
    return F.when(s.irrelevant, _flag(s.text == jsonx.IRRELEVANT)).otherwise(_flag(two))


def header(s: Sample) -> Column:
    """The first line is the domain's header; -1 for a header where the image is irrelevant."""
    marked = F.startswith(s.first, F.lit("<DOMAIN=")) | F.contains(s.text, F.lit("<TASK="))
    return F.when(s.irrelevant, _flag(marked, -1.0)).otherwise(_flag(s.first == s.expected))


def strict(s: Sample) -> Column:
    """-1 unless there are two lines and the first is the domain's header."""
    right = (F.size(s.lines) == 2) & (s.domain.isNull() | s.strict)
    return F.when(s.irrelevant, 0.0).otherwise(_flag(right, 0.0, -1.0))


def parses(s: Sample) -> Column:
    """-1 where the second line is no JSON."""
    return F.when(s.irrelevant, 0.0).otherwise(_flag((F.size(s.lines) >= 2) & s.second["valid"], 0.0, -1.0))


def dataset(s: Sample) -> Column:
    return F.when(s.irrelevant, 0.0).otherwise(_flag(s.strict & (s.line != "")))


def no_duplicate_keys(s: Sample) -> Column:
    return F.when(s.irrelevant, 0.0).otherwise(_flag(s.pred["twice"], -1.0))


def content_equal(s: Sample) -> Column:
    return _compared(s, _flag(s.same))


def category_recall(s: Sample) -> Column:
    share = lambda a, b: F.when(F.size(b) == 0, _flag(F.size(a) == 0)).otherwise(_shared(a, b) / F.size(b))
    return _compared(s, _both(categories(s.pred), categories(s.ref), share))


def category_f1(s: Sample) -> Column:
    share = lambda a, b: F.when(F.size(a) + F.size(b) == 0, 1.0).otherwise(2 * _shared(a, b) / (F.size(a) + F.size(b)))
    return _compared(s, _both(categories(s.pred), categories(s.ref), share))


def attribute_key_recall(s: Sample) -> Column:
    """Mean over the reference's categories, of those with attributes but label texts, of the share of these."""
    bound = F.transform(s.ref["named"], lambda c: F.struct(c["category"].alias("category"), F.array_except(c["names"], _strings(jsonx.FREE_TEXT)).alias("names")))
    shares = F.transform(F.filter(bound, lambda c: F.size(c["names"]) > 0), lambda c: _shared(attributes(s.pred, c["category"]), c["names"]) / F.size(c["names"]))
    return _compared(s, F.coalesce(_mean(shares), _flag(F.size(s.pred["entries"]) == 0)))


#: Attributes whose values belong to the schema, and the longest value that can.
STABLE = ("捆扎", "可见性", "符合性", "弯曲半径", "套管保护", "保护", "保护措施", "位置", "安装状态", "方向", "安装方向")
LONGEST_VALUE = 32


def attribute_path_recall(s: Sample) -> Column:
    """Mean over shared categories, of those with stable values in the reference, of the share of these."""

    def paths(side: Column) -> Column:
        steady = lambda f: (f["f0"] == jsonx.STATS) & f["f2"].isin(*STABLE) & (F.char_length(f["f3"]) <= LONGEST_VALUE) & ~f["f3"].rlike(r"^\d+$|=")
        return F.transform(F.filter(side["facts"], steady), lambda f: F.struct(f["f1"], f["f2"], f["f3"]))

    def shares(mine: Column, theirs: Column) -> Column:
        own = lambda c: F.filter(theirs, lambda p: p["f1"] == c)
        wanted = F.filter(F.transform(F.array_intersect(categories(s.pred), categories(s.ref)), own), lambda ps: F.size(ps) > 0)
        return F.transform(wanted, lambda ps: _shared(mine, ps) / F.size(ps))

    return _compared(s, F.coalesce(_mean(_both(paths(s.pred), paths(s.ref), shares)), F.lit(0.0)))


#: Per domain its top-level keys, and per category the attributes that it needs, groups of
#: which it needs one, and others that it may have.
SCHEMAS = {
    BBU: (
        ("统计", "备注"),
        {
            "挡风板": (("品牌", "可见性", "安装方向"), (), ()),
            "BBU设备": (("品牌", "可见性", "挡风板需求"), (), ()),
            "BBU安装螺丝": (("可见性", "符合性"), (), ()),
            "BBU端光纤插头": (("可见性", "符合性"), (), ()),
            "ODF端光纤插头": (("可见性", "符合性"), (), ()),
            "机柜处接地螺丝": (("可见性", "符合性"), (), ()),
            "地排处接地螺丝": (("可见性", "符合性"), (), ()),
            "光纤": (("弯曲半径",), (("保护措施", "套管保护", "保护"),), ()),
            "电线": (("捆扎",), (), ()),
            "标签": ((), (("文本", "可读性"),), ()),
        },
    ),
    RRU: (
        ("统计", "分组统计"),
        {
            "站点距离": (("站点距离",), (), ("组",)),
            "RRU设备": ((), (), ()),
            "紧固件": (("安装状态",), (), ()),
            "RRU接地端": (("安装状态",), (), ()),
            "地排接地端螺丝": (("安装状态",), (), ()),
            "尾纤": (("套管保护", "标签"), (), ("组",)),
            "接地线": (("标签",), (), ("组",)),
            "标签": ((), (("文本", "可读性"),), ("组",)),
        },
    ),
}
#: Weights of attributes, categories and top-level keys beyond the schema, and of a distance that is no number.
EXTRA_KEY, EXTRA_CATEGORY, EXTRA_TOP, BAD_DISTANCE = 0.35, 0.25, 0.30, 0.60


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def schema_tree(schemas=SCHEMAS):
    """A score against schemas: mean completeness of the categories that the reference has too, less penalties."""

    def rules(domain: str) -> Column:
        """The domain's known categories in order: what each needs, one of groups, and may have."""
        parts = lambda needs, groups, may: {
            "needs": _strings(needs),
            "groups": F.array(*[_strings(g) for g in groups]) if groups else F.array().cast("array<array<string>>"),
            "allowed": _strings(sorted({*needs, *may, *(a for g in groups for a in g)})),
            "wanted": F.lit(len(needs) + len(groups)),
        }
        return F.array(*[F.struct(F.lit(c).alias("category"), *[v.alias(k) for k, v in parts(*rule).items()]) for c, rule in schemas[domain][1].items()])

    def judged(rule: Column, own: Column) -> Column:
        met = _shared(own, rule["needs"]) + F.size(F.filter(rule["groups"], lambda g: F.arrays_overlap(own, g)))
        beyond = F.size(F.array_except(own, rule["allowed"])) / F.greatest(F.lit(1), F.size(rule["allowed"]))
        complete = F.when(rule["wanted"] > 0, met / rule["wanted"]).otherwise(1.0)
        return F.struct(complete.alias("complete"), F.least(F.lit(1.0), beyond).alias("extra"))

    def domain_score(s: Sample, domain: str) -> Column:
        top = schemas[domain][0]
        distance = "站点距离"
        far = F.filter(s.pred["entries"], lambda e: e["category"] == distance)
        number = lambda a: a["mapped"] & F.forall(a["keys"], lambda k: k.rlike(r"^\d+$"))
        sound = F.forall(far, lambda e: F.exists(e["attributes"], lambda a: a["name"] == distance) & F.forall(e["attributes"], lambda a: (a["name"] != distance) | number(a)))

        def of(mine: Column, theirs: Column) -> Column:
            known = F.filter(rules(domain), lambda r: F.array_contains(mine, r["category"]) & F.array_contains(theirs, r["category"]))
            found = F.transform(known, lambda r: text.let(attributes(s.pred, r["category"]), lambda own: judged(r, own)))
            bad = F.array_contains(mine, distance) & F.array_contains(theirs, distance) & ~sound if domain == RRU else F.lit(False)
            means = text.let(found, lambda cs: _mean(F.transform(cs, lambda c: c["complete"])) - EXTRA_KEY * _mean(F.transform(cs, lambda c: c["extra"])))
            return (
                means
                - EXTRA_CATEGORY * F.size(F.array_except(mine, theirs)) / F.greatest(F.size(theirs), F.lit(1))
                - EXTRA_TOP * F.size(F.array_except(s.pred["keys"], _strings(top))) / max(1, len(top))
                - F.when(bad, BAD_DISTANCE).otherwise(0.0)
            )

        whole = _both(categories(s.pred), categories(s.ref), of)
        return text.let(whole, lambda x: F.when(x.isNotNull(), clamp(x, -1.0, 1.0)))

    def score(s: Sample) -> Column:
        chosen = F.lit(None).cast("double")
        for domain in schemas:
            chosen = F.when(s.domain == domain, domain_score(s, domain)).otherwise(chosen)
        return _compared(s, F.when(F.size(s.ref["entries"]) > 0, F.coalesce(chosen, F.lit(0.0))).otherwise(0.0))

    return score


def _counted(a: Column, b: Column, use) -> Column:
    """use(hit, a, b as a struct) with the sizes of two fact multisets and of their intersection."""
    sizes = lambda x, y: F.struct(overlap(x, y).alias("hit"), total(x).alias("a"), total(y).alias("b"))
    return text.let(_both(a, b, sizes), use)


#: Weights of spurious facts by domain; missing ones weigh 1.
SPURIOUS = {BBU: 0.30, RRU: 0.60}


def content_tversky(s: Sample) -> Column:
    """Facts of both but notes, and in BBU but label texts."""
    kept = lambda f: (f["f0"] != jsonx.NOTES) & ~((s.domain == BBU) & (f["f0"] == jsonx.STATS) & f["f2"].isin(*jsonx.FREE_TEXT))
    alpha = F.when(s.domain == BBU, SPURIOUS[BBU]).otherwise(SPURIOUS[RRU])

    def value(x: Column) -> Column:
        hit, a, b = x["hit"], x["a"], x["b"]
        return F.when(a + b == 0, 1.0).when(b == 0, 0.0).otherwise(hit / (hit + alpha * (a - hit) + (b - hit)))

    return _compared(s, _counted(F.filter(s.pred["facts"], kept), F.filter(s.ref["facts"], kept), value))


def content_f1(s: Sample) -> Column:
    return _compared(s, _counted(s.pred["facts"], s.ref["facts"], lambda x: F.when(x["a"] + x["b"] == 0, 1.0).otherwise(2 * x["hit"] / (x["a"] + x["b"]))))


def ocr_text(x: Column) -> Column:
    return F.upper(F.translate(text.strip_all_blanks(x), "（）－—–−‐／：，", "()-----/:,"))


#: Label texts beyond the reference's number that cost nothing, and what each further one costs.
FREE_TEXTS, PER_TEXT = 2, 0.10


def text_recall(s: Sample) -> Column:
    """BBU: share of the reference's label texts, counted, less a cost for far too many different ones."""

    def texts(side: Column) -> Column:
        own = F.filter(side["facts"], lambda f: (f["f0"] == jsonx.STATS) & f["f2"].isin(*jsonx.FREE_TEXT))
        shown = F.transform(own, lambda f: F.struct(ocr_text(f["f3"]).alias("t"), f["n"].alias("n")))
        # In order of the texts, equal ones lie side by side: one pass adds them up.
        start = F.struct(F.array().cast("array<struct<f0:string,f1:string,f2:string,f3:string,n:bigint>>").alias("done"), F.lit(None).cast("string").alias("t"), F.lit(0).cast("long").alias("n"))
        fact = lambda t, n: F.struct(*(F.lit(None).cast("string").alias(f"f{k}") for k in range(3)), t.alias("f3"), n.alias("n"))
        closed = lambda d: F.when(d["t"] != "", F.concat(d["done"], F.array(fact(d["t"], d["n"])))).otherwise(d["done"])
        step = lambda d, x: F.when(d["t"].eqNullSafe(x["t"]), F.struct(d["done"].alias("done"), d["t"].alias("t"), (d["n"] + x["n"]).alias("n"))).otherwise(F.struct(closed(d).alias("done"), x["t"].alias("t"), x["n"].alias("n")))
        return F.aggregate(F.sort_array(shown), start, step, closed)

    def value(a: Column, b: Column) -> Column:
        share = text.let(total(b), lambda n: F.when(n > 0, overlap(a, b) / n).otherwise(0.0))
        extra = F.greatest(F.lit(0), F.size(a) - F.size(b) - FREE_TEXTS)
        return clamp(share - PER_TEXT * extra, -1.0, 1.0)

    return F.when(s.domain == BBU, _compared(s, _both(texts(s.pred), texts(s.ref), value))).otherwise(0.0)


def notes(s: Sample) -> Column:
    """BBU: share of the reference's notes; -1 for notes where it has none."""
    of = lambda side: F.filter(F.array_distinct(F.transform(side["notes"], ocr_text)), lambda t: t != "")
    value = lambda a, b: F.when(F.size(b) == 0, _flag(F.size(a) > 0, -1.0)).otherwise(_shared(a, b) / F.size(b))
    return F.when(~s.irrelevant & (s.domain == BBU) & _objects(s), _both(of(s.pred), of(s.ref), value)).otherwise(0.0)


def notes_presence(s: Sample) -> Column:
    """BBU: there are notes, where the reference has some."""
    has = lambda side: F.exists(side["notes"], lambda n: text.strip_all_blanks(n) != "")
    return _flag(~s.irrelevant & (s.domain == BBU) & has(s.ref) & has(s.pred))


def groups_presence(s: Sample) -> Column:
    """RRU: there are group counts, where the reference has some."""
    return _flag(~s.irrelevant & (s.domain == RRU) & (F.size(s.ref["groups"]) > 0) & (F.size(s.pred["groups"]) > 0))


#: Scores by name; add to it to extend the set.
SCORES = {
    "format": layout,
    "header": header,
    "strict": strict,
    "parse": parses,
    "content_eq": content_equal,
    "dataset": dataset,
    "no_dup_keys": no_duplicate_keys,
    "category_recall": category_recall,
    "attr_key_recall": attribute_key_recall,
    "attr_path_recall": attribute_path_recall,
    "schema_tree": schema_tree(),
    "content_tversky": content_tversky,
    "text": text_recall,
    "notes": notes,
    "content_f1": content_f1,
    "category_f1": category_f1,
    "notes_presence": notes_presence,
    "group_stats_presence": groups_presence,
}


def score(rows: DataFrame, names=None, pred: str = "completion", ref: str = "summary_ref", domain: str = "domain", irrelevant: str | None = None) -> DataFrame:
    """The rows with a column per score."""
    columns = rows.columns
    ready = prepare(rows, pred, ref, domain, irrelevant)
    return ready.select(*columns, *[SCORES[n](Sample()).alias(n) for n in names or SCORES])
