"""Conversion jobs: rows converted and written in one pass that also counts what it did."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from granary.sources.sinks import write_jsonl


def convert(rows: DataFrame, sample: Callable[[DataFrame], DataFrame], path: str, objects: str | Column = "objects", counts: dict[str, Column] | None = None) -> dict[str, int]:
    """Write converted rows as JSON lines to ``path`` and their counts to ``path``_stats; the counts.

    ``sample`` gives the converted rows with a boolean column ``keep``; rows where
    it is not true are skipped, not written. The counts (total_images,
    total_objects, skipped_images, and those of ``counts`` over all rows) are
    observed in the pass that writes, so the input is read once.
    """
    observation = Observation()
    kept = F.coalesce(F.col("keep"), F.lit(False))
    n_objects = F.coalesce(F.size(objects), F.lit(0))
    measures = {
        "total_images": F.count_if(kept),
        "total_objects": F.coalesce(F.sum(F.when(kept, n_objects)), F.lit(0)),
        "skipped_images": F.count_if(~kept),
    } | (counts or {})
    observed = sample(rows).observe(observation, *[c.cast("bigint").alias(n) for n, c in measures.items()])
    write_jsonl(observed.where(kept).drop("keep"), path)
    found = dict(observation.get)
    spark = rows.sparkSession
    stats = spark.createDataFrame([tuple(found[n] for n in measures)], ", ".join(f"{n} bigint" for n in measures))
    write_jsonl(stats.coalesce(1), f"{path.rstrip('/')}_stats")
    return found
