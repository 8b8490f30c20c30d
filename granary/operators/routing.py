"""Routing of tickets to domains, filters of tickets, evaluation splits, irrelevant images and predicates on summaries."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions import jsonx
from granary.functions.numeric import ceil_to, smart_resize
from granary.operators.joins import exclude

#: Missions that may be named, and the domains there are.
MISSIONS = ("BBU安装方式检查（正装）", "BBU接地线检查", "BBU线缆布放要求", "挡风板安装检查", "RRU安装检查", "RRU位置检查", "RRU线缆")
DOMAINS = ("bbu", "rru")
#: Categories and attributes that the predicates on summaries read.
SITE, DISTANCE, LABEL, LABEL_TEXT, READABLE, UNREADABLE = "站点距离", "距离", "标签", "文本", "可读性", "不可读"
WITHOUT_LABEL = ("无法识别", "没有标签")


def known_mission(mission: Column, missions: tuple[str, ...] = MISSIONS) -> Column:
    """The mission itself; an error where it is none of the known ones, null included."""
    fault = F.concat(F.lit("unsupported mission: "), F.coalesce(mission, F.lit("null")), F.lit(f"; known: {', '.join(missions)}"))
    return F.when(F.coalesce(mission.isin(*missions), F.lit(False)), mission).otherwise(F.raise_error(fault))


def domain_of(mission: Column, domains: dict[str, str], default: str | None = None, known: tuple[str, ...] = DOMAINS) -> Column:
    """A mission's domain by the map, else the default, trimmed and in lower case; an error where that is none of the known.

    An empty entry of the map does not fall back to the default: it is an error.
    """
    entry = F.try_element_at(F.create_map(*[F.lit(x) for kv in domains.items() for x in kv]), mission) if domains else F.lit(None).cast("string")
    domain = F.lower(F.trim(F.coalesce(entry, F.lit(default).cast("string"))))
    missing = F.concat(F.lit("no domain for mission "), F.coalesce(mission, F.lit("null")))
    unknown = F.concat(F.lit("unknown domain "), domain, F.lit(f"; known: {', '.join(known)}"))
    return F.when(domain.isin(*known), domain).when(F.coalesce(domain, F.lit("")) == "", F.raise_error(missing)).otherwise(F.raise_error(unknown))


def without_tickets(tickets: DataFrame, keys: Iterable[str] = (), listed: DataFrame | None = None, on: str = "ticket") -> DataFrame:
    """Tickets that neither ``keys`` nor a table of keys (column key) names; blanks around keys do not count, empty keys name nothing.

    The table is joined, whatever its size; rows without a ticket key stay.
    """
    named = sorted({str(k).strip() for k in keys} - {""})
    kept = tickets.where(~F.coalesce(F.col(on).isin(*named), F.lit(False))) if named else tickets
    if listed is None:
        return kept
    return exclude(kept, listed.select(F.trim("key").alias(on)).where(F.col(on) != "").distinct(), [on])


def evaluation_rows(pools: DataFrame, policies: DataFrame, target: str, clean: bool = False, dataset: str = "dataset") -> DataFrame:
    """The rows of the primary target dataset with its prompts, mode and whether they are augmented.

    policies: dataset, mode ('dense' or 'summary'), system, user, augmented.
    The system prompt goes with its own mode only, the user prompt with both;
    ``clean`` turns augmentation off. A target without a policy gives no rows.
    """
    own = policies.where(F.col(dataset) == target)
    system = lambda mode: F.when(F.col("mode") == mode, F.col("system")).alias(f"system_{mode}")
    summary = F.when(F.col("mode") == "summary", F.col("user")).alias("user_summary")
    use = F.lit(False) if clean else F.coalesce("augmented", F.lit(False))
    chosen = own.select(dataset, "mode", system("dense"), system("summary"), F.col("user").alias("user"), summary, use.alias("augment"))
    return pools.where(F.col(dataset) == target).join(F.broadcast(chosen.dropDuplicates([dataset])), dataset)


def irrelevant_records(images: DataFrame, said: str = "无关图片", factor: int = 32, max_pixels: int = 1 << 20, min_pixels: int = 4 * 32 * 32) -> DataFrame:
    """A record per readable image of an irrelevant scene: one box around it all, and the summary.

    images: path, width, height (as shown, see ``images.image_heads``). Other
    files than .jpg, .jpeg and .png are left out, and unreadable images: those
    without a size, and those too elongated to be resized. Sizes are those after
    resizing, filled up to multiples of ``factor``.
    """
    named = images.where(F.lower("path").rlike("[.](jpg|jpeg|png)$"))
    target = smart_resize(F.col("height"), F.col("width"), factor, min_pixels, max_pixels)
    sized = named.withColumn("t", target).where("t is not null").select("path", ceil_to(F.col("t.width"), factor).alias("width"), ceil_to(F.col("t.height"), factor).alias("height"))
    zero = F.lit(0).cast("long")
    box = F.struct(F.array(zero, zero, F.col("width"), F.col("height")).alias("bbox_2d"), F.lit("irrelevant").alias("desc"))
    return sized.select(F.array("path").alias("images"), F.array(box).alias("objects"), F.lit(said).alias("summary"), "width", "height")


def _names(counts: Column) -> Column:
    """Keys of a JSON object of counts; none where it is no object."""
    return F.coalesce(F.json_object_keys(counts), F.array().cast("array<string>"))


def summary_distances(doc: Column) -> Column:
    """Station distances that a summary counts, in their order: whole numbers as text."""
    entry = jsonx.entry_of(doc, SITE)
    own, other = (F.try_element_at(entry, F.lit(k)) for k in (SITE, DISTANCE))
    counts = F.when(F.json_object_keys(own).isNotNull(), own).otherwise(other)
    return F.filter(_names(counts), lambda k: F.trim(k).rlike("^[0-9]+$"))


def has_label_text(doc: Column) -> Column:
    """Whether a summary's labels have a text that is not blank, or a legibility other than unreadable."""
    entry = jsonx.entry_of(doc, LABEL)
    some = lambda k, of: F.exists(_names(F.try_element_at(entry, F.lit(k))), of)
    said = some(LABEL_TEXT, lambda k: F.trim(k) != "")
    return F.coalesce(said | some(READABLE, lambda k: (F.trim(k) != "") & (k != UNREADABLE)), F.lit(False))


def has_readable_label(summary: Column) -> Column:
    """``has_label_text`` of a JSON summary; of another text, whether it names a label and does not call it missing or unreadable."""
    doc = jsonx.document(summary)
    absent = F.lit(False)
    for phrase in WITHOUT_LABEL:
        absent |= F.contains(summary, F.lit(phrase))
    return F.when(doc.isNotNull(), has_label_text(doc)).otherwise(F.coalesce(F.contains(summary, F.lit(f"{LABEL}/")) & ~absent, F.lit(False)))
