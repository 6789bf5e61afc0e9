"""Shared-folder scratch space, path checks and plan sizes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder of this machine:
    on a cluster the executors could not see it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    root = tempfile.mkdtemp(prefix="loomwright-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def _application_scratch(spark: SparkSession) -> str:
    return f"{scratch_root(spark)}/loomwright/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{_application_scratch(spark)}/{label}-{uuid.uuid4().hex}"


def release_scratch(spark: SparkSession) -> None:
    """Remove all that this application has staged. Frames that read it are void after that."""
    remove(spark, _application_scratch(spark))


def stage(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write ``df`` once and go on from the written table.

    Later passes re-read only the columns they need, and a lost executor
    re-reads files instead of recomputing the upstream joins. Parquet cannot hold
    calendar intervals and untyped nulls; frames with such columns are checkpointed to the same folder.
    """
    spark = df.sparkSession
    if any(kind in repr(df.schema) for kind in ("CalendarIntervalType", "NullType")):
        context = spark.sparkContext._jsc.sc()
        if not context.getCheckpointDir().isDefined():
            spark.sparkContext.setCheckpointDir(scratch_root(spark))
        return df.checkpoint()
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _hadoop(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence through the path's own scheme (local, object store, HDFS)."""
    fs, hadoop_path = _hadoop(spark, path)
    return fs.exists(hadoop_path)


def list_folder(spark: SparkSession, path: str) -> list[str]:
    """Full paths of the entries of a folder, sorted. Metadata only."""
    fs, hadoop_path = _hadoop(spark, path)
    return sorted(status.getPath().toString() for status in fs.listStatus(hadoop_path))


def is_folder(spark: SparkSession, path: str) -> bool:
    fs, hadoop_path = _hadoop(spark, path)
    return fs.getFileStatus(hadoop_path).isDirectory()


def file_uri(spark: SparkSession, path: str) -> str:
    """A path as Spark's file metadata spell it, with escapes."""
    return spark._jvm.org.apache.hadoop.fs.Path(path).toUri().toASCIIString()


def first_line(spark: SparkSession, path: str) -> str | None:
    """The first line of a text file, read by the driver; None for an empty file."""
    fs, hadoop_path = _hadoop(spark, path)
    stream = fs.open(hadoop_path)
    try:
        reader = spark._jvm.java.io.BufferedReader(spark._jvm.java.io.InputStreamReader(stream, "UTF-8"))
        return reader.readLine()
    finally:
        stream.close()


def remove(spark: SparkSession, path: str) -> None:
    fs, hadoop_path = _hadoop(spark, path)
    fs.delete(hadoop_path, True)


def unused_name(*frames: DataFrame) -> str:
    """A column name that none of the frames has."""
    taken, name = {c.lower() for df in frames for c in df.columns}, "_own"
    while name in taken:
        name += "_"
    return name


def stage_counted(df: DataFrame, label: str) -> tuple[DataFrame, int]:
    """``stage``, and the number of rows, observed by the job that writes them."""
    seen = Observation()
    staged = stage(df.observe(seen, F.count(F.lit(1)).alias("rows")), label)
    return staged, seen.get["rows"]


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files and relations the plan starts from.

    Summed over the leaves: estimates of inner nodes multiply at joins.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    total = 0
    for i in range(leaves.size()):
        total += int(leaves.apply(i).stats().sizeInBytes())
    return total


# Input per core below which a scan is likely to give fewer tasks than cores.
SPREAD_BYTES_PER_CORE = 16 << 20


def spread(df: DataFrame) -> DataFrame:
    """Spread a small input over all cores before work that is heavy per row.

    A large input already has more scan tasks than cores; it is left as it is, since
    shuffling it would cost more than it gains.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if input_bytes(df) < cores * SPREAD_BYTES_PER_CORE else df
