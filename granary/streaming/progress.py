"""Structured Streaming: running metrics, a state machine per hypothesis, packs as rows arrive."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of packs that are sent on at once.
AT_ONCE = 10_000


def read_jsonl(spark: SparkSession, path: str, schema) -> DataFrame:
    """New JSON-lines files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).json(path)


def windowed_counts(events: DataFrame, ts: str = "ts", width: str = "1 day", late: str = "2 days", by: str = "event_type") -> DataFrame:
    """Rows and sums per window and kind, with a bound on late rows."""
    return (
        events.withWatermark(ts, late)
        .groupBy(F.window(ts, width).alias("w"), by)
        .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
        .select(F.col("w.start").alias("start"), by, "n", "total")
    )


def progress(votes: DataFrame, by: list[str]) -> DataFrame:
    """Running counts of right and wrong predictions; for output mode update."""
    return votes.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("pred") == F.col("truth")).alias("correct"))


def promote(proposals: DataFrame, min_cycles: int = 2, min_keys: int = 2) -> DataFrame:
    """signature, status: candidate until its distinct cycles and keys reach both thresholds, then promoted; a rejection ends it.

    proposals: signature, cycle, key, rejected. End states do not change again.
    State per signature is bounded by the thresholds.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        status, cycles, keys = state.get if state.exists else ("candidate", [], [])
        cycles, keys = list(cycles), list(keys)
        before = status if state.exists else None
        for frame in frames:
            for cycle, k, rejected in zip(frame["cycle"], frame["key"], frame["rejected"]):
                if status != "candidate":
                    continue
                if len(cycles) < min_cycles and cycle not in cycles:
                    cycles.append(int(cycle))
                if len(keys) < min_keys and k not in keys:
                    keys.append(k)
                if rejected:
                    status = "rejected"
                elif len(cycles) >= min_cycles and len(keys) >= min_keys:
                    status = "promoted"
        state.update((status, cycles, keys))
        if status != before:
            yield pd.DataFrame({"signature": [key[0]], "status": [status]})

    return proposals.groupBy("signature").applyInPandasWithState(
        step, "signature string, status string", "status string, cycles array<long>, keys array<string>", "update", GroupStateTimeout.NoTimeout
    )


def packs(rows: DataFrame, group: str, length: str, cap: int) -> DataFrame:
    """group, pack, length: sequential packs per group over micro-batches; the open pack's sum is the state.

    A micro-batch's rows of a group come in several frames that are in no order
    among each other, so all of them are put in order of ``ordinal`` (two numbers
    a row are held) before the first is packed.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        pack, total = state.get if state.exists else (-1, 0)
        held = [(frame["ordinal"].to_numpy(), frame[length].to_numpy()) for frame in frames]
        ordinals, lengths = (np.concatenate(part) for part in zip(*held))
        lengths = lengths[np.argsort(ordinals, kind="stable")]
        for first in range(0, len(lengths), AT_ONCE):
            some, out = lengths[first : first + AT_ONCE], []
            for n in map(int, some):
                if pack < 0 or total + n > cap or n >= cap:
                    pack, total = pack + 1, n
                else:
                    total += n
                out.append(pack)
            yield pd.DataFrame({group: key[0], "pack": out, length: some})
        state.update((pack, total))

    return rows.groupBy(group).applyInPandasWithState(step, f"{group} string, pack long, {length} long", "pack long, total long", "append", GroupStateTimeout.NoTimeout)
