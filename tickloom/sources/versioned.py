"""Partitioned tables that change by whole commits.

`path`/data holds the rows, by partition and by the version that wrote them; `path`/manifests/v{n} lists the version of
every partition after commit n. A commit writes new partitions beside the old ones and then its manifest, whose _SUCCESS
file makes it visible: a reader sees the table before or after a commit, never a mixture, and what a failed commit left
behind belongs to no manifest. A commit that names a batch which is in already changes nothing, so a batch may be
delivered again. One writer at a time; readers at any time. A manifest has one row for each partition.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def finished(spark: SparkSession, path: str) -> list[int]:
    """The numbers n of the folders `path`/v{n} that were written to their end, ascending."""
    system, folder = _folder(spark, path)
    if not system.exists(folder):
        return []
    done = [s.getPath() for s in system.listStatus(folder) if system.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return sorted(int(p.getName()[1:]) for p in done)


def manifest(spark: SparkSession, path: str) -> DataFrame | None:
    """(partition columns, version, batch) of the newest commit; None for a table without any."""
    held = finished(spark, f"{path}/manifests")
    return spark.read.parquet(f"{path}/manifests/v{held[-1]}") if held else None


def read(spark: SparkSession, path: str, only: DataFrame | None = None) -> DataFrame | None:
    """The rows of the newest commit, or those of the partitions in `only` (partition columns); None if there are none.

    Only the files of these partitions are looked at: their folders are listed, one for each partition.
    """
    listed = manifest(spark, path)
    if listed is None:
        return None
    columns = [c for c in listed.columns if c not in ("version", "batch")]
    if only is not None:
        listed = listed.join(only.select(*columns).distinct(), columns, "left_semi")
    folders = ["/".join(f"{c}={row[c]}" for c in [*columns, "version"]) for row in listed.select(*columns, "version").collect()]
    if not folders:
        return None
    return spark.read.option("basePath", f"{path}/data").parquet(*[f"{path}/data/{f}" for f in folders]).drop("version")


def last_batch(spark: SparkSession, path: str) -> int | None:
    """The greatest batch that was committed."""
    listed = manifest(spark, path)
    return None if listed is None else listed.agg(F.max("batch")).first()[0]


def commit(spark: SparkSession, path: str, rows: DataFrame, partition: list[str], order: list[str], batch: int | None = None, replaced: DataFrame | None = None) -> bool:
    """Put `rows` in the place of the partitions that they touch, and of those in `replaced` (partition columns); False, and no
    change, if `batch` is in already.

    One task writes a partition, sorted by `order`. Partition values are not null and need no escaping in a path.
    """
    before = manifest(spark, path)
    known = last_batch(spark, path)
    if batch is not None and known is not None and batch <= known:
        return False
    held = finished(spark, f"{path}/manifests")
    number = held[-1] + 1 if held else 0
    version = f"{number}-{uuid.uuid4().hex[:12]}"  # another one at each attempt
    placed = rows.withColumn("version", F.lit(version)).repartition(*partition).sortWithinPartitions(*partition, *order)
    placed.write.mode("append").partitionBy(*partition, "version").parquet(f"{path}/data")
    written = spark.read.schema(placed.schema).parquet(f"{path}/data").where(F.col("version") == version).select(*partition).distinct()
    if before is not None and replaced is not None:
        before = before.join(replaced.select(*partition).distinct(), partition, "left_anti")
    _publish(spark, path, number, written, version, partition, before, batch if batch is not None else known)
    return True


def _publish(spark: SparkSession, path: str, number: int, written: DataFrame, version: str, partition: list[str], before: DataFrame | None, batch: int | None) -> None:
    new = written.select(*partition, F.lit(version).alias("version"), F.lit(batch).cast("long").alias("batch"))
    if before is not None:
        new = new.unionByName(before.join(new, partition, "left_anti").withColumn("batch", F.lit(batch).cast("long")))
    new.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifests/v{number}")


def expire(spark: SparkSession, path: str, partition: list[str], keep: int = 1) -> int:
    """Delete the manifests before the last `keep` and the partition folders that none of these lists; their number."""
    system, _ = _folder(spark, path)
    held = finished(spark, f"{path}/manifests")
    kept = held[-keep:]
    if not kept:
        return 0
    named = {tuple(str(row[c]) for c in [*partition, "version"]) for n in kept for row in spark.read.parquet(f"{path}/manifests/v{n}").collect()}
    there = spark.read.parquet(f"{path}/data").select(*partition, "version").distinct().collect()
    gone = [row for row in there if tuple(str(row[c]) for c in [*partition, "version"]) not in named]
    folders = [f"{path}/manifests/v{n}" for n in held[:-keep]] + [f"{path}/data/" + "/".join(f"{c}={row[c]}" for c in [*partition, "version"]) for row in gone]
    for folder in folders:
        system.delete(spark._jvm.org.apache.hadoop.fs.Path(folder), True)
    return len(gone)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, if it is there."""
    system, folder = _folder(spark, path)
    system.delete(folder, True)
