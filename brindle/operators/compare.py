"""Comparison of rows, keys, values and schemas of two tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.sources.shared import settle


#: Tasks that keys are dealt to, at least. Shuffled keys compress so well that tasks joined by bytes would hold tens of millions of them.
LEAST_PARTS = 200


def key_difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys that only one side has, with the side (null keys equal).

    Each side is read and shuffled once. Keys are dealt to as many tasks as the session asks for, ``LEAST_PARTS`` or more, so a task's
    memory is that of its share of the distinct keys; where few keys repeat very often, make them distinct first.
    """
    parts = max(LEAST_PARTS, int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    both = a.select(*keys, F.lit(1).alias("_sides")).unionByName(b.select(*keys, F.lit(2).alias("_sides")))
    sides = both.repartition(parts, *keys).groupBy(*keys).agg(F.bit_or("_sides").alias("_sides")).where("_sides < 3")
    return sides.select(*keys, F.when(F.col("_sides") == 1, "only_a").otherwise("only_b").alias("side"))


def _digests(columns: list[str], there: set[str]) -> list:
    """128 bits of a row's typed values, nulls told from values; a column that the table does not have is null."""
    values = [F.col(f"`{c}`") if c in there else F.lit(None) for c in columns]
    nulls = F.concat_ws(",", *(F.when(v.isNull(), F.lit(c)) for v, c in zip(values, columns, strict=True)))
    return [F.xxhash64(F.lit(seed), *values, nulls).alias(f"_h{seed}") for seed in (0, 1)]


def row_diff(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """A row per key that was added, removed or changed. Keys may repeat: of each key the rows are compared as a bag.

    Other columns are compared typed and null-safe, by 128 bits; a column that only one side has is null on the other, so
    a key is changed where the lost column had a value (``column_diff`` names such columns). Each side is read once; rows
    are counted by key and content before they are shuffled, and a key's counts again.
    """
    others = sorted({*a.columns, *b.columns} - set(keys))
    count = lambda df, x, y: df.select(*keys, *_digests(others, set(df.columns)), F.lit(x).alias("_a"), F.lit(y).alias("_b"))
    both = count(a, 1, 0).unionByName(count(b, 0, 1))
    rows = both.groupBy(*keys, "_h0", "_h1").agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    per_key = rows.groupBy(*keys).agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"), F.bool_or(F.col("_a") != F.col("_b")).alias("_differ"))
    change = F.when(F.col("_b") == 0, "removed").when(F.col("_a") == 0, "added").when(F.col("_differ"), "changed")
    return per_key.select(*keys, change.alias("change")).where("change IS NOT NULL")


def column_diff(a: DataFrame, b: DataFrame) -> list[tuple[str, str]]:
    """(column, ``added`` or ``removed``) of the columns that only one side has, by name."""
    return sorted([(c, "removed") for c in set(a.columns) - set(b.columns)] + [(c, "added") for c in set(b.columns) - set(a.columns)])


def row_diff_summary(a: DataFrame, b: DataFrame, keys: list[str], examples: int = 5) -> DataFrame:
    """change, rows and the first few keys of each; columns that only one side has are changes of their own (``column added``, ``column
    removed``), without rows, and named in place of keys. The tables are compared once: the differing keys are written, then counted and ranked."""
    found = settle(row_diff(a, b, keys), "diff")
    counts = found.groupBy("change").agg(F.count(F.lit(1)).alias("rows"))
    first = lambda change: found.where(F.col("change") == change).orderBy(*keys).limit(examples)
    tops = first("added").unionByName(first("changed")).unionByName(first("removed"))
    key = F.struct(*keys, F.concat_ws(",", *(F.col(k).cast("string") for k in keys)).alias("_shown"))
    shown = tops.groupBy("change").agg(F.transform(F.array_sort(F.collect_list(key)), lambda x: x["_shown"]).alias("examples"))
    out = counts.join(shown, "change")
    columns = [(f"column {side}", None, [c for c, s in column_diff(a, b) if s == side]) for side in sorted({s for _, s in column_diff(a, b)})]
    return out.unionByName(a.sparkSession.createDataFrame(columns, "change string, rows long, examples array<string>")) if columns else out


def value_domain_diff(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Values of a column that were added or removed. Values repeat, so each task makes its own distinct before they are dealt."""
    return key_difference(a.select(column).distinct(), b.select(column).distinct(), [column]).select(F.col(column).cast("string").alias("value"), F.when(F.col("side") == "only_a", "removed").otherwise("added").alias("change"))


#: Metadata of a field that hold its default, as SQL text; the first is Spark's own.
DEFAULTS = ("CURRENT_DEFAULT", "default")


def with_default(df: DataFrame, column: str, default: str) -> DataFrame:
    """The table with a default noted at a column, as SQL text. Snapshots keep it."""
    return df.withMetadata(column, {**df.schema[column].metadata, "default": default})


def schema_rows(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """table, column, type, nullable, default (SQL text of the field's metadata, or null) of a set of tables."""
    default = lambda f: next((f.metadata[k] for k in DEFAULTS if k in f.metadata), None)
    rows = [(name, f.name, f.dataType.simpleString(), f.nullable, default(f)) for name, df in sorted(tables.items()) for f in df.schema]
    return spark.createDataFrame(rows, "table string, column string, type string, nullable boolean, default string")


def schema_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """a, b: rows of ``schema_rows``. object, change, before, after: tables and columns added, removed or modified (type, nullability or default)."""
    tables = key_difference(a, b, ["table"]).select(F.col("table").alias("object"), F.when(F.col("side") == "only_a", "table removed").otherwise("table added").alias("change"), F.lit(None).cast("string").alias("before"), F.lit(None).cast("string").alias("after"))
    text = lambda side: F.concat(F.col(f"{side}.type"), F.when(F.col(f"{side}.nullable"), "").otherwise(" not null"), F.coalesce(F.concat(F.lit(" default "), F.col(f"{side}.default")), F.lit("")))
    both = a.alias("a").join(b.alias("b"), (F.col("a.table") == F.col("b.table")) & (F.col("a.column") == F.col("b.column")), "full_outer")
    change = F.when(F.col("b.column").isNull(), "column removed").when(F.col("a.column").isNull(), "column added").when(text("a") != text("b"), "column modified")
    name = F.concat_ws(".", F.coalesce("a.table", "b.table"), F.coalesce("a.column", "b.column"))
    columns = both.select(F.coalesce("a.table", "b.table").alias("_table"), name.alias("object"), change.alias("change"), text("a").alias("before"), text("b").alias("after")).where("change IS NOT NULL")
    columns = columns.join(tables.select(F.col("object").alias("_gone")), F.col("_table") == F.col("_gone"), "left_anti").drop("_table")
    return tables.unionByName(columns)


def schema_diff_summary(a: DataFrame, b: DataFrame) -> DataFrame:
    """kind (table, column), added, removed, modified: counts of ``schema_diff``, a row for each kind, zeros included."""
    change = F.split("change", " ")
    rows = schema_diff(a, b).select(change[0].alias("kind"), change[1].alias("how"))
    rows = rows.unionByName(a.sparkSession.createDataFrame([("table", "none"), ("column", "none")], "kind string, how string"))
    return rows.groupBy("kind").agg(*(F.count_if(F.col("how") == h).alias(h) for h in ("added", "removed", "modified")))
