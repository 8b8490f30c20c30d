"""Repeated verdicts: majority vote, error metrics, comparison of two voters, gates, bootstrap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.numeric import ratio


def majority(votes: DataFrame, key: str = "ticket", verdict: str = "verdict", truth: str | None = None) -> DataFrame:
    """One row per key: counts, prediction, agreement, difficulty and (with ``truth``) hard_wrong.

    Verdicts other than pass and fail are invalid. Without valid ones the
    prediction is null and the difficulty 0.5; a tie is a fail. One partial
    aggregation, so a key with very many votes costs one row per task.
    """
    v = F.col(verdict)
    more = [F.first(truth, ignorenulls=True).alias(truth)] if truth else []
    counted = votes.groupBy(key).agg(
        F.count_if(v == "pass").alias("n_pass"),
        F.count_if(v == "fail").alias("n_fail"),
        F.count_if(v.isNull() | ~v.isin("pass", "fail")).alias("n_invalid"),
        *more,
    )
    valid = F.col("n_pass") + F.col("n_fail")
    out = (
        counted.withColumn("pred", F.when(valid == 0, F.lit(None)).when(F.col("n_pass") > F.col("n_fail"), "pass").otherwise("fail"))
        .withColumn("agreement", ratio(F.greatest("n_pass", "n_fail"), valid))
        .withColumn("difficulty", F.when(valid == 0, 0.5).otherwise(1 - F.col("agreement")))
    )
    if truth:
        wrong = F.col("pred").isNotNull() & (F.col("pred") != F.col(truth))
        out = out.withColumn("hard_wrong", F.when(wrong, F.col("agreement")).otherwise(0.0))
    return out


def top_reason(votes: DataFrame, key: str, reason: str, order: str, k: int = 5) -> DataFrame:
    """Per key the most common reason (first seen wins ties) and its k most common ones with counts."""
    seen = votes.where(F.col(reason).isNotNull()).groupBy(key, reason).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    rank = Window.partitionBy(key).orderBy(F.desc("n"), "first", reason)
    best = seen.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)
    listed = F.sort_array(F.collect_list(F.struct("rank", reason, "n")))
    return best.groupBy(key).agg(listed.alias("top")).select(key, F.col("top")[0][reason].alias("mode"), "top")


def confusion(judged: DataFrame, pred: str = "pred", truth: str = "truth", by: list[str] | None = None) -> DataFrame:
    """Counts and rates of errors; a null prediction is an error of its true class.

    fn: passes not predicted as such; fp: fails not predicted as such; tp:
    passes predicted. fp over tp is null where tp is 0 (the flag tells).
    """
    p, t = F.col(pred), F.col(truth)
    hit = F.coalesce(p == t, F.lit(False))
    counts = judged.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(hit).alias("correct"),
        F.count_if((t == "pass") & ~hit).alias("fn"),
        F.count_if((t == "fail") & ~hit).alias("fp"),
        F.count_if((t == "pass") & hit).alias("tp"),
        F.count_if((t == "fail") & hit).alias("tn"),
    )
    rate = lambda a, b: F.round(ratio(F.col(a), F.col(b)), 6)
    return (
        counts.withColumn("acc", rate("correct", "n"))
        .withColumn("fn_rate", rate("fn", "n"))
        .withColumn("fp_rate", rate("fp", "n"))
        .withColumn("fn_over_tp", F.when(F.col("tp") > 0, rate("fn", "tp")))
        .withColumn("fp_over_tp", F.when(F.col("tp") > 0, rate("fp", "tp")))
        .withColumn("fp_over_tp_infinite", (F.col("tp") == 0) & (F.col("fp") > 0))
        .withColumn("false_release", F.round(ratio(F.col("fp"), F.col("tp") + F.col("fp")), 6))
        .withColumn("false_block", F.round(ratio(F.col("fn"), F.col("tn") + F.col("fn")), 6))
    )


def compare(base: DataFrame, new: DataFrame, key: str = "ticket", truth: str = "truth") -> DataFrame:
    """key, truth, base, new: predictions of two voters on the keys both have."""
    left = base.select(key, truth, F.col("pred").alias("base"), F.col("agreement").alias("base_agreement"))
    right = new.select(key, F.col("pred").alias("new"), F.col("agreement").alias("new_agreement"))
    return left.join(right, key)


def _wrong(pred: str, truth: str) -> Column:
    return (~F.coalesce(F.col(pred) == F.col(truth), F.lit(False))).cast("int")


def relative_error_reduction(before: Column, after: Column) -> Column:
    return (before - after) / F.greatest(before, F.lit(1e-12))


def comparison(pairs: DataFrame, truth: str = "truth") -> DataFrame:
    """One row: error rates before and after, their relative reduction, the share of changed predictions."""
    one = pairs.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.avg(_wrong("base", truth)), F.lit(0.0)).alias("err_base"),
        F.coalesce(F.avg(_wrong("new", truth)), F.lit(0.0)).alias("err_new"),
        F.coalesce(F.avg((~F.col("base").eqNullSafe(F.col("new"))).cast("int")), F.lit(0.0)).alias("changed"),
    )
    return one.withColumn("rer", relative_error_reduction(F.col("err_base"), F.col("err_new")))


def bootstrap_probability(pairs: DataFrame, theta: float, iterations: int, seed: int = 0, truth: str = "truth", key: str = "ticket") -> DataFrame:
    """One row: the share of resamples whose relative error reduction reaches theta.

    Keys fall into classes by (base wrong, new wrong), so a resample of n keys
    is n hashed places among the classes' cumulative counts (four at most). The
    draws are a distributed range; each is counted where it is made.
    """
    classes = pairs.groupBy(_wrong("base", truth).alias("b"), _wrong("new", truth).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    rows = classes.orderBy("b", "w").collect()
    total = sum(r["n"] for r in rows)
    draws = pairs.sparkSession.range(total * iterations)
    n = max(total, 1)
    r, i = F.floor(F.col("id") / n).cast("long"), F.col("id") % n
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), r.cast("string"), i.cast("string")))
    draws = draws.select(r.alias("r"), (F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") % n).alias("place"))
    pick = lambda c: _pick(F.col("place"), rows, c)
    drawn = draws.groupBy("r").agg(F.avg(pick("b")).alias("e0"), F.avg(pick("w")).alias("e1"))
    passed = relative_error_reduction(F.col("e0"), F.col("e1")) >= theta
    return drawn.agg(F.coalesce(F.avg(passed.cast("int")), F.lit(0.0)).alias("probability"))


def _pick(place: Column, rows: list, column: str) -> Column:
    """The column of the class in whose stretch of the cumulative counts a place lies."""
    out, upto = None, 0
    for row in rows:
        upto += row["n"]
        out = F.when(place < upto, row[column]) if out is None else out.when(place < upto, row[column])
    return F.lit(0) if out is None else out


def gate(stats: DataFrame, min_rer: float, max_changed: float, min_probability: float) -> DataFrame:
    """``passes``: all thresholds hold (columns rer, changed, probability)."""
    return stats.withColumn("passes", (F.col("rer") >= min_rer) & (F.col("changed") <= max_changed) & (F.col("probability") >= min_probability))


def mismatches(judged: DataFrame, k: int, hardest: bool = True, truth: str = "truth", key: str = "ticket") -> DataFrame:
    """The k wrong predictions with the highest (or lowest) agreement, ranked from 1; ties go by key."""
    wrong = judged.where(F.col("pred").isNotNull() & (F.col("pred") != F.col(truth)))
    order = [F.desc("agreement") if hardest else F.asc("agreement"), F.asc(key)]
    top = wrong.orderBy(*order).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def regressions(pairs: DataFrame, k: int = 50, truth: str = "truth", key: str = "ticket") -> DataFrame:
    """Keys right before and wrong now, by the agreement now, then before."""
    right = F.coalesce(F.col("base") == F.col(truth), F.lit(False))
    now = F.coalesce(F.col("new") == F.col(truth), F.lit(False))
    return pairs.where(right & ~now).orderBy(F.desc("new_agreement"), F.desc("base_agreement"), key).limit(k)
