"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, as set in the session or its context; a temporary one only where there is none and Spark is local."""
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    root = spark.conf.get("spark.checkpoint.dir", None) or (known.get() if known.isDefined() else None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="loomgraph-")
    if not known.isDefined():
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written to the shared folder now; its lineage ends there."""
    shared_root(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """df, written to the shared folder as columns now: for large tables, of which a checkpoint would keep whole rows."""
    path = new_folder(df.sparkSession, "stored")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, *keys: str, parts: int | None = None) -> DataFrame:
    """df as a table of the shared folder with a file for each bucket of keys: joins by these keys read it where it lies."""
    spark = df.sparkSession
    # with fewer buckets than shuffle partitions, a join may deal them anew
    parts, name = max(parts or 1, int(spark.conf.get("spark.sql.shuffle.partitions"))), f"loomgraph_{uuid.uuid4().hex}"
    df.repartition(parts, *keys).write.bucketBy(parts, *keys).option("path", new_folder(spark, "buckets")).saveAsTable(name)
    return spark.table(name)


@contextmanager
def in_place(spark: SparkSession) -> Iterator[None]:
    """Jobs run within join tables where they lie if they lie by a part of the keys: sample is enough for sample and node."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def laid(df: DataFrame, key: str, parts: int, onto: str | None = None) -> tuple[DataFrame, str]:
    """df, which lies by key in so many parts, as a table in buckets of that key and its name, written without a shuffle; onto: a table of laid() that it is added to."""
    spark, name = df.sparkSession, onto or f"loomgraph_{uuid.uuid4().hex}"
    rows = df.write.bucketBy(parts, key)
    (rows.mode("append") if onto else rows.option("path", new_folder(spark, "buckets"))).saveAsTable(name)
    return spark.table(name), name


def drop_laid(spark: SparkSession, name: str) -> None:
    """Drops a table of laid() and its files."""
    path = spark._jsparkSession.sessionState().catalog().getTableMetadata(spark._jvm.org.apache.spark.sql.catalyst.TableIdentifier(name)).location().toString()
    spark.sql(f"DROP TABLE {name}")
    drop_folder(spark, path)


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/loomgraph/{name}-{uuid.uuid4().hex}"


def _files(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def finished_parts(spark: SparkSession, folder: str) -> list[str]:
    """The numbered parts of a table in a folder that were written to their end, in order."""
    path, files = _files(spark, folder)
    if not files.exists(path):
        return []
    marker = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    found = sorted(x.getPath().toString() for x in files.listStatus(path) if x.isDirectory())
    return [x for x in found if files.exists(marker(f"{x}/_SUCCESS"))]


def write_part(df: DataFrame, folder: str, number: int | None = None) -> str:
    """Writes df as the next part of a table, or a given one over what an unfinished run left of it."""
    number = len(finished_parts(df.sparkSession, folder)) if number is None else number
    path = f"{folder}/part={number:06d}"
    df.write.mode("overwrite").parquet(path)
    return path


def drop_folder(spark: SparkSession, folder: str) -> None:
    path, files = _files(spark, folder)
    files.delete(path, True)
