"""Sinks: JSON lines, CSV, versions, several outputs of one table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def write_jsonl(rows: DataFrame, path: str, append: bool = False, nulls: bool = False) -> None:
    """JSON lines in UTF-8; null fields are written only if asked for."""
    rows.write.mode("append" if append else "errorifexists").option("ignoreNullFields", not nulls).json(path)


def write_csv(rows: DataFrame, path: str, mark: bool = False) -> None:
    """CSV with a header per file; ``mark`` puts a byte order mark before it, by which spreadsheets know UTF-8."""
    named = rows.withColumnRenamed(rows.columns[0], "\ufeff" + rows.columns[0]) if mark else rows
    named.write.option("header", True).option("encoding", "UTF-8").csv(path)


def replace(rows: DataFrame, path: str, format: str = "json") -> None:
    """Write beside the target, then rename twice; the target may be its own input.

    Between the renames there is no table for a moment, and a writer that dies
    there leaves it in the folder that ends in ``.old``. Tables with readers at
    any time should be versions (``write_version``).
    """
    spark = rows.sparkSession
    staged = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    rows.write.format(format).save(staged)
    fs, target = _fs(spark, path)
    new = spark._jvm.org.apache.hadoop.fs.Path(staged)
    old = spark._jvm.org.apache.hadoop.fs.Path(f"{staged}.old")
    if fs.exists(target):
        fs.rename(target, old)
    if not fs.rename(new, target):
        fs.rename(old, target)
        raise OSError(f"cannot rename {staged} to {path}")
    fs.delete(old, True)


#: Names the current version; Spark's readers skip files that begin with an underscore.
POINTER = "_current"


def _versions(fs, base) -> list[str]:
    names = [s.getPath().getName() for s in fs.listStatus(base)] if fs.exists(base) else []
    return sorted((n for n in names if n[:1] == "v" and n[1:].isdigit()), key=lambda n: int(n[1:]))


def _point_to(spark: SparkSession, root: str, name: str) -> None:
    """The pointer written beside itself and renamed over the old one, a single step where the file system's rename is one."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs, staged = _fs(spark, f"{root}/{POINTER}.{uuid.uuid4().hex}")
    out = fs.create(staged)
    out.write(bytearray(name.encode()))
    out.close()
    rename = getattr(hadoop, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    source = fs.makeQualified(staged)
    hadoop.FileContext.getFileContext(source.toUri(), spark._jsc.hadoopConfiguration()).rename(source, fs.makeQualified(hadoop.Path(f"{root}/{POINTER}")), how)


def current_version(spark: SparkSession, root: str) -> str | None:
    """The folder that the pointer names; without a pointer the newest complete one."""
    fs, base = _fs(spark, root)
    path = spark._jvm.org.apache.hadoop.fs.Path
    if fs.exists(path(f"{root}/{POINTER}")):
        return f"{root}/{spark.sparkContext._jvm.scala.io.Source.fromInputStream(fs.open(path(f'{root}/{POINTER}')), 'UTF-8').mkString()}"
    done = [n for n in _versions(fs, base) if fs.exists(path(f"{root}/{n}/_SUCCESS"))]
    return f"{root}/{done[-1]}" if done else None


def write_version(rows: DataFrame, root: str, keep: int = 5) -> str:
    """A new numbered version under ``root``, current once it is whole; of the others the newest stay, ``keep`` in all.

    Readers see the version before until the pointer is switched, and a writer
    that dies changes nothing for them. Two writers at once cannot take one
    number: the later fails.
    """
    spark = rows.sparkSession
    fs, base = _fs(spark, root)
    names = _versions(fs, base)
    name = f"v{int(names[-1][1:]) + 1 if names else 1:08d}"
    rows.write.parquet(f"{root}/{name}")
    _point_to(spark, root, name)
    for old in [*names, name][:-keep]:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{old}"), True)
    return f"{root}/{name}"


def read_version(spark: SparkSession, root: str) -> DataFrame:
    """The current version's rows."""
    return spark.read.parquet(current_version(spark, root))


def write_outputs(samples: DataFrame, path: str, part: str = "part", objects: str = "objects", invalid: DataFrame | None = None) -> DataFrame:
    """samples/ (JSON lines, a folder per part), vocabulary/ (kind, label), invalid/ and statistics/ under ``path``; the statistics.

    Samples are written in one pass, and labels counted from what was written.
    ``objects`` is an array of structs with a desc.
    """
    from granary.operators.summaries import vocabulary

    spark = samples.sparkSession
    write_splits(samples, f"{path}/samples", part)
    written = spark.read.schema(samples.select(objects).schema).json(f"{path}/samples")
    vocabulary(written.select(F.explode(objects).alias("o")).select("o.desc")).repartitionByRange("kind", "label").sortWithinPartitions("kind", "label").write.json(f"{path}/vocabulary")
    if invalid is not None:
        write_jsonl(invalid, f"{path}/invalid")
    labels = spark.read.schema("kind string, label string").json(f"{path}/vocabulary").groupBy(F.col("kind").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    totals = written.agg(F.count(F.lit(1)).alias("samples"), F.coalesce(F.sum(F.coalesce(F.size(objects), F.lit(0))), F.lit(0)).alias("objects"))
    statistics = labels.unionByName(totals.unpivot([], ["samples", "objects"], "name", "n"))
    statistics.coalesce(1).write.json(f"{path}/statistics")
    return spark.read.schema("name string, n bigint").json(f"{path}/statistics")


def read_vocabulary(spark: SparkSession, path: str, document: bool = False) -> DataFrame:
    """kind, label of a vocabulary written as rows, or (``document``) as one JSON document whose 'vocabulary' has a list per kind."""
    if not document:
        return spark.read.schema("kind string, label string").json(path)
    docs = spark.read.schema("vocabulary map<string,array<string>>").option("multiLine", True).json(path)
    return docs.select(F.explode("vocabulary").alias("kind", "labels")).select("kind", F.explode("labels").alias("label"))


def write_splits(rows: DataFrame, path: str, part: str = "part") -> None:
    """One folder per value of ``part`` in one pass."""
    rows.write.partitionBy(part).json(path)


def write_keys(rows: DataFrame, path: str, category: str, key: str) -> None:
    """Per category its distinct keys, one a line."""
    rows.select(F.col(category), F.col(key).cast("string").alias("value")).distinct().repartition(category).sortWithinPartitions(category, "value").write.partitionBy(category).text(path)
