"""The folder all executors share, and tables written to it."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_local_scratch: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` if the cluster names one.

    Where it is unset, a local master gets a temporary folder (driver and executors are one
    process there) and any other master the warehouse, which is shared as well.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master:
        if not _local_scratch:
            _local_scratch.append(tempfile.mkdtemp(prefix="brindle-"))
        return _local_scratch[0]
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_brindle"


_run: ContextVar[str] = ContextVar("run", default="")


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """What is written between steps inside goes to a folder of its own, which is removed at the end: results must be written elsewhere by then.

    with scratch(spark):
        near_duplicates(documents).write.parquet(out)
    """
    name = f"run-{uuid.uuid4().hex}"
    before = _run.set(name)
    try:
        yield f"{scratch_dir(spark)}/{name}"
    finally:
        _run.reset(before)
        remove_tree(spark, f"{scratch_dir(spark)}/{name}")


def fresh_path(spark: SparkSession, label: str) -> str:
    return "/".join(x for x in (scratch_dir(spark), _run.get(), f"{label}-{uuid.uuid4().hex}") if x)


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = fresh_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settle_counted(df: DataFrame, label: str) -> tuple[DataFrame, int]:
    """The same, and how many rows were written: observed in the write, not counted again."""
    seen = Observation()
    out = settle(df.observe(seen, F.count(F.lit(1)).alias("rows")), label)
    return out, seen.get.get("rows", 0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remove_tree(spark: SparkSession, path: str) -> None:
    """Through Hadoop's file system, so that any store is served."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def tree_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of all files under a path, by the file system's own summary."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(target).getLength()
