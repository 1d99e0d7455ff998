"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch for Python stages: texts may be long, so batches stay small.
ARROW_ROWS = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Bound the Arrow batches that Python stages of this session receive."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def crc_mod(col: str, modulus: int) -> Column:
    """crc32 of an id written as text, modulo `modulus`; null ids give null."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % modulus


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared checkpoint folder; where none is configured, a local session takes a temporary one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        import tempfile

        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-checkpoint-", dir="/tmp")
    sc.setCheckpointDir(folder)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def swept(df: DataFrame) -> DataFrame:
    """`df`, a checkpoint, after the driver's collector ran: Spark then deletes the shuffle files and checkpoints that no
    frame refers to any more, which otherwise stay on disk until the driver's memory fills."""
    df.sparkSession.sparkContext._jvm.System.gc()
    return df


def stored(df: DataFrame) -> DataFrame:
    """`df`, written once as Parquet in the shared folder: later plans read the columns they need, and a wide column takes
    less room than in a checkpoint."""
    ensure_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().get()}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def thin(df: DataFrame, key: Column, counts: DataFrame, label: str, bound: int) -> DataFrame:
    """About `bound` rows of each label, chosen by a hash of `key`, so the choice does not depend on partitioning.

    `counts` holds one row (label, n) for each label value; it is as small as the set of labels.
    """
    unit = (F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1 << 40)) / F.lit(float(1 << 40))).alias("_u")
    shares = counts.select(F.col(label).alias("_label"), (F.lit(float(bound)) / F.col("n")).alias("_share"))
    return df.join(F.broadcast(shares), df[label] == F.col("_label")).where(unit < F.col("_share")).drop("_label", "_share")


#: Bytes of numbers that are broadcast at most; larger sides are joined by a shuffle.
BROADCAST_BYTES = 16 << 20


#: Small rows that are worth a task.
TASK_ROWS = 1 << 16


def few_tasks(df: DataFrame, rows: int) -> DataFrame:
    """`df`, a checkpoint of so many small rows, read by as many tasks as these are worth. A checkpoint has a partition for
    each one of the shuffle that made it, and the driver keeps records of every task, however few rows it read."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS)))


def if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """`df`, a checkpoint, marked for broadcast and read by few tasks if its rows take at most `limit` bytes."""
    sizes = [F.lit(8 * (1 + len(df.columns)))]
    for name, kind in df.dtypes:
        if kind in ("string", "binary"):
            sizes.append(F.octet_length(name))
        elif kind == "array<string>":
            sizes.append(F.octet_length(F.array_join(name, "  ")))
        elif kind.startswith("array"):
            sizes.append(8 * F.size(name))
    if len(sizes) == 1:  # numbers alone: as many rows as fit need counting, no more
        rows = limit // (8 * (1 + len(df.columns)))
        n = df.limit(rows + 1).count()
        return F.broadcast(few_tasks(df, n)) if n <= rows else df
    total, n = df.agg(F.sum(sum((F.coalesce(x, F.lit(0)).cast("long") for x in sizes[1:]), sizes[0])), F.count(F.lit(1))).first()
    return F.broadcast(few_tasks(df, n)) if (total or 0) <= limit else df


def of_pairs(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows of `texts` (node, ...) that `pairs` (a, b; checkpointed) name; all rows if the pairs are too many to be sent
    to all tasks."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node"))
    rows = BROADCAST_BYTES // 16
    n = nodes.limit(rows + 1).count()
    return texts.join(F.broadcast(few_tasks(nodes, n)), "node", "left_semi") if n <= rows else texts


def fresh(columns: list[str], name: str) -> str:
    """`name`, lengthened until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
