"""What the training-data operators share: words, partition counts and the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.sources.shared import fresh_path, settle, table  # noqa: F401

#: A word of the text contracts: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts_for(df: DataFrame) -> int:
    """Partitions for a shuffle of whole rows: those the session asks for, or as many as the scan has splits."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions())


def lower_ascii(column):
    """Lower-cases A-Z and nothing else."""
    return F.translate(column, UPPER, LOWER)


def without(docs: DataFrame, names: list[str]) -> DataFrame:
    """Leaves out columns whose names an operator gives its own results (in any case of letters)."""
    own = {n.lower() for n in names}
    return docs.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() not in own))
