"""Streaming forms: a versioned table kept current from a file stream, and late data by event-time windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brindle.operators.incremental import BucketedTable


def stream_upsert(stream: DataFrame, target: BucketedTable, latest: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] | None = None):
    """Upserts each micro-batch; of rows of one key the last by ``latest`` counts, in a batch and over all of them.

    Of rows with equal ``latest`` the largest by all other columns, in order of their names, counts, in both places: the result does
    not depend on the order of batches, and a batch that is played again after a failure changes nothing. A batch reads and
    writes only the buckets of its keys.
    """
    key = target.key

    def apply(batch: DataFrame, _: int) -> None:
        rows = prepare(batch) if prepare else batch
        order = [latest, *sorted(c for c in rows.columns if c not in (*key, latest))]
        last = Window.partitionBy(*key).orderBy(F.desc(F.struct(*order)))
        target.upsert(rows.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n"), newest=order)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_windows(stream: DataFrame, ts: str, group: str, value: str, lookback: str, width: str) -> DataFrame:
    """Counts and sums of event-time windows; rows later than the lookback behind the newest are dropped."""
    rows = stream.withWatermark(ts, lookback)
    return rows.groupBy(F.window(ts, width).alias("w"), group).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(value).cast("decimal(18,4)")).alias("total")).select(F.col("w.start").alias("start"), group, "n", F.col("total").cast("double").alias("total"))


def file_stream(spark: SparkSession, path: str, schema, files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
