"""Structured Streaming over the events table, run to the end of its files."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from granary.plans.registry import query, table
from granary.session import shared_path
from granary.streaming import ordered, progress


def _run(spark, frame, mode: str):
    """A stream's whole result after its last batch, as a table in the shared folder: a file sink that replaces it with each batch."""
    root = shared_path(spark, "stream")
    newest = {}

    def write(batch, number):
        newest["path"] = f"{root}/{number}"
        batch.write.mode("overwrite").parquet(newest["path"])

    job = frame.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    job.awaitTermination()
    return spark.read.schema(frame.schema).parquet(newest["path"])


def _events(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


@query("SELECT strftime(ts, '%Y-%m-%d') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_windows(spark, sf_dir):
    out = _run(spark, progress.windowed_counts(_events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))), "complete")
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT event_type, count(*) AS n, count(*) FILTER (value > 50) AS correct FROM events GROUP BY 1")
def progress_updates(spark, sf_dir):
    votes = _events(spark, sf_dir).select("event_type", F.lit("pass").alias("pred"), F.when(F.col("value") > 50, "pass").otherwise("fail").alias("truth"))
    return _run(spark, progress.progress(votes, ["event_type"]), "complete")


def _halves(spark, rows, second, make):
    """What a stream appends over two runs from one checkpoint: rows where ``second`` is false, then the others."""
    root = shared_path(spark, "ordered")
    schema = rows.schema
    with ordered.rocksdb(spark):
        for part in (~second, second):
            rows.where(part).write.mode("append").parquet(f"{root}/in")
            made = make(spark.readStream.schema(schema).parquet(f"{root}/in"))
            made.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(made.schema).parquet(f"{root}/out")


@query("SELECT user_id, event_type AS object, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def stream_first_arrivals(spark, sf_dir):
    """Each user's event types when they first come, over a restart."""
    events = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("object"), "event_id")
    middle = events.agg(F.percentile_approx("event_id", 0.5)).first()[0]
    return _halves(spark, events, F.col("event_id") > middle, lambda rows: ordered.first_arrivals(rows, "user_id", "object", "event_id"))


@query(
    """WITH e AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq FROM events)
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY seq) - 1 AS place, seq, event_id::VARCHAR AS payload FROM e WHERE value <= 60"""
)
def stream_in_order(spark, sf_dir):
    """Users' events that come mixed up in two runs, put back in order; those over 60 failed."""
    number = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    events = table(spark, sf_dir, "events").select("user_id", number.alias("seq"), F.col("event_id").cast("string").alias("payload"), (F.col("value") > 60).alias("failed"))
    mixed = events.orderBy(F.xxhash64("payload"))
    return _halves(spark, mixed, F.pmod(F.xxhash64("payload"), F.lit(2)) == 1, lambda rows: ordered.in_order(rows, "user_id", "seq", "payload", "failed"))


@query(
    """WITH e AS (SELECT event_type, user_id, value FROM events)
SELECT 's' || user_id AS signature, CASE WHEN max(value) > 99 THEN 'rejected' WHEN count(DISTINCT event_type) >= 2 AND count(DISTINCT floor(value)) >= 3 THEN 'promoted' ELSE 'candidate' END AS status FROM e GROUP BY 1"""
)
def stream_promotion(spark, sf_dir):
    """Signatures that enough cycles and keys support, or that one row rejects: the status after the last batch."""
    rank = F.dense_rank().over(Window.orderBy("event_type"))  # a row per event type
    kinds = table(spark, sf_dir, "events").select("event_type").distinct().select("event_type", rank.alias("kind"))
    over = F.max(F.col("value") > 99).over(Window.partitionBy("user_id"))
    events = table(spark, sf_dir, "events").join(F.broadcast(kinds), "event_type")
    rows = events.select(F.concat(F.lit("s"), "user_id").alias("signature"), F.col("kind").cast("long").alias("cycle"), F.floor("value").cast("string").alias("key"), over.alias("rejected"))
    root = shared_path(spark, "proposals")
    rows.write.parquet(root)
    return _run(spark, progress.promote(spark.readStream.schema(rows.schema).parquet(root), 2, 3), "update")


@query(
    """WITH RECURSIVE e AS (SELECT event_type, floor(value)::BIGINT AS n, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k FROM events),
p AS (SELECT event_type, k, n, 0::BIGINT AS pack, n AS total FROM e WHERE k = 1
UNION ALL SELECT e.event_type, e.k, e.n, CASE WHEN p.total + e.n > 200 OR e.n >= 200 THEN p.pack + 1 ELSE p.pack END, CASE WHEN p.total + e.n > 200 OR e.n >= 200 THEN e.n ELSE p.total + e.n END FROM p JOIN e ON e.event_type = p.event_type AND e.k = p.k + 1)
SELECT event_type, pack, count(*) AS n, sum(n)::BIGINT AS total FROM p GROUP BY 1, 2"""
)
def stream_packs(spark, sf_dir):
    """Sequential packs of each event type's values as rows arrive."""
    rows = table(spark, sf_dir, "events").select("event_type", F.col("event_id").alias("ordinal"), F.floor("value").cast("long").alias("n"))
    root = shared_path(spark, "packs")
    rows.write.parquet(root)
    packed = _run(spark, progress.packs(spark.readStream.schema(rows.schema).parquet(root), "event_type", "n", 200), "append")
    return packed.groupBy("event_type", "pack").agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("total"))
