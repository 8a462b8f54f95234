"""Reference-data files: strict CSV reading, type inference, casts, loads and validation."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The ladder of types, most specific first, with what a value of each looks like.
LADDER = {
    "boolean": r"(?i)^(true|false|t|f)$",
    "uuid": r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    "bigint": r"^-?[0-9]+$",
    "numeric": r"^-?[0-9.]+$",
    "date": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$",
    "timestamptz": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[ T][0-9]{2}:[0-9]{2}(:[0-9]{2})?(\.[^+Z]*)?([+Z].*)?$",
    "jsonb": r"(?s)^(\{.*\}|\[.*\])$",
}
SPARK_TYPES = {"boolean": "boolean", "uuid": "string", "bigint": "bigint", "date": "date", "timestamptz": "timestamp", "jsonb": "string", "text": "string"}


def read_csv(spark: SparkSession, path: str, line_feeds: bool = False) -> DataFrame:
    """Header row; all fields as trimmed strings, blank ones null; a ragged row raises.

    Files are split among tasks. ``line_feeds``: quoted fields may hold them; then a file is one task's.
    """
    raw = spark.read.csv(path, header=True, inferSchema=False, multiLine=line_feeds, quote='"', escape='"', mode="FAILFAST")
    return raw.select(*(F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")).alias(c.strip()) for c in raw.columns))


#: What a value adds to its column: the kinds it can be cast to, and the digits before and after its point.
_DIGITS = (r"^\s*-?0*([0-9]*)", r"\.([0-9]*)\s*$")
MOST_DIGITS = 38


def _widest(value: Column) -> Column:
    """The first rung of the ladder that all values of a column fit, as an aggregate.

    The types are a lattice: a value that a rung's pattern takes but its type cannot hold moves the column on to the next that can:
    a whole number beyond 64 bits to numeric, digits beyond 38 in all to text, a day that no calendar has to text.
    """
    looks = {k: value.rlike(p) for k, p in LADDER.items()}
    points = F.length(value) - F.length(F.translate(value, ".", ""))
    before, after = (F.coalesce(F.max(F.length(F.regexp_extract(value, p, 1))), F.lit(0)) for p in _DIGITS)
    fits = {k: F.bool_and(t) for k, t in looks.items()}
    for k in ("bigint", "date", "timestamptz"):
        fits[k] = F.bool_and(F.when(value.isNotNull(), looks[k] & value.try_cast(SPARK_TYPES[k]).isNotNull()))
    fits["numeric"] = F.bool_and(looks["numeric"] & (points <= 1) & value.rlike("[0-9]")) & (before + after <= MOST_DIGITS)
    rung = F.coalesce(*(F.when(t, k) for k, t in fits.items()), F.lit("text"))
    return F.when(F.count(value) == 0, "text").otherwise(rung)


def infer_types(df: DataFrame, sample_rows: int | None = 100) -> DataFrame:
    """column, type: the first rung that all values fit, text if none does or there are no values.

    All columns and rungs are one aggregate. ``sample_rows=None`` looks at the whole table; ``apply_schema`` then takes
    whatever was found without raising.
    """
    rows = df if sample_rows is None else df.limit(sample_rows)
    fits = [_widest(F.trim(F.col(f"`{c}`").cast("string"))).alias(f"c{i}") for i, c in enumerate(df.columns)]
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("type")) for i, c in enumerate(df.columns))))
    return rows.agg(*fits).select(pairs.alias("p")).select("p.column", "p.type")


def _numerics(df: DataFrame, columns: list[str], strict: bool = True) -> dict[str, str]:
    """For each column decimal(38, s) with the most digits after the point that any value has, measured in one pass.

    If these and the most digits before the point are over 38 together, no decimal keeps them all: ValueError, or, not ``strict``, fewer are kept.
    """
    if not columns:
        return {}
    digits = lambda c, pattern: F.coalesce(F.max(F.length(F.regexp_extract(F.col(f"`{c}`"), pattern, 1))), F.lit(0))
    found = df.agg(*(x for i, c in enumerate(columns) for x in (digits(c, _DIGITS[0]).alias(f"b{i}"), digits(c, _DIGITS[1]).alias(f"a{i}")))).first()
    if strict and (bad := [c for i, c in enumerate(columns) if found[f"b{i}"] + found[f"a{i}"] > MOST_DIGITS]):
        raise ValueError(f"no decimal of 38 digits holds all values of {bad}")
    return {c: f"decimal(38,{min(found[f'a{i}'], 38 - min(38, found[f'b{i}']))})" for i, c in enumerate(columns)}


def apply_schema(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Casts by declared or inferred type; a value that doesn't fit raises, and so does a numeric column that no decimal holds. Columns that aren't named stay text."""
    out, numerics = [], _numerics(df, [c for c in df.columns if types.get(c) == "numeric"])
    for c in df.columns:
        kind = types.get(c, "text")
        target = numerics[c] if kind == "numeric" else SPARK_TYPES.get(kind, kind)
        out.append(F.col(f"`{c}`").cast(target).alias(c))
    return df.select(*out)


def types_of(df: DataFrame, declared: dict[str, str] | None = None, sample_rows: int | None = 100) -> DataFrame:
    """column, type, origin: a declared type wins over the inferred one."""
    declared = declared or {}
    found = infer_types(df, sample_rows)
    if not declared:
        return found.withColumn("origin", F.lit("inferred"))
    named = F.create_map(*(F.lit(x) for kv in declared.items() for x in kv))
    return found.select("column", F.coalesce(F.try_element_at(named, F.col("column")), "type").alias("type"), F.when(F.col("column").isin(*declared), "schema").otherwise("inferred").alias("origin"))


def validate(df: DataFrame, types: dict[str, str] | None = None, target: str | None = None) -> DataFrame:
    """column, type, rows, nulls, failures: values that a cast to the type would refuse. One pass over the table, and one more to measure
    numeric columns. A ``target`` table that does not exist raises ValueError. ``types`` are those of the seed's schema file: without one
    a warning is given and they are inferred from the whole table. ``validate_seed`` does so for columns that it does not name, and tells
    where each type comes from."""
    if not types:
        warnings.warn("the seed has no schema file: its types are inferred", stacklevel=2)
        types = {r["column"]: r["type"] for r in infer_types(df, None).collect()}  # a row for each column
    if missing := sorted(set(types) - set(df.columns)):
        raise ValueError(f"no such columns in the seed: {missing}")
    if target and not df.sparkSession.catalog.tableExists(target):
        raise ValueError(f"no such table: {target}")
    numerics = _numerics(df, [c for c in types if types[c] == "numeric"], strict=False)
    cast = lambda c: F.col(f"`{c}`").try_cast(numerics[c] if types[c] == "numeric" else SPARK_TYPES.get(types[c], types[c]))
    counts = []
    for i, c in enumerate(types):
        bad = F.col(f"`{c}`").isNotNull() & (~F.col(f"`{c}`").rlike(LADDER["uuid"]) if types[c] == "uuid" else cast(c).isNull())
        counts += [F.count(F.lit(1)).alias(f"r{i}"), F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{i}"), F.count_if(bad).alias(f"f{i}")]
    rows = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.lit(types[c]).alias("type"), F.col(f"r{i}").alias("rows"), F.col(f"n{i}").alias("nulls"), F.col(f"f{i}").alias("failures")) for i, c in enumerate(types))))
    return df.agg(*counts).select(rows.alias("x")).select("x.*")


def validate_seed(df: DataFrame, declared: dict[str, str] | None = None, target: str | None = None) -> DataFrame:
    """The rows of ``validate`` for every column, with ``origin``: ``schema`` for declared types, ``inferred`` for the others."""
    if not declared:
        warnings.warn("the seed has no schema file: its types are inferred", stacklevel=2)
    known = {r["column"]: (r["type"], r["origin"]) for r in types_of(df, declared, None).collect()}  # a row for each column
    origins = F.create_map(*(F.lit(x) for c, (_, origin) in known.items() for x in (c, origin)))
    return validate(df, {c: kind for c, (kind, _) in known.items()}, target).withColumn("origin", F.element_at(origins, F.col("column")))


def replace(tables: dict[str, DataFrame]) -> dict[str, int]:
    """Overwrites the named tables, in order of name; rows written are observed, not counted again. All must exist before any is changed."""
    from pyspark.sql import Observation

    if tables:
        spark = next(iter(tables.values())).sparkSession
        if missing := [t for t in sorted(tables) if not spark.catalog.tableExists(t)]:
            raise ValueError(f"no such table: {', '.join(missing)}")
    written = {}
    for name, df in sorted(tables.items()):
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").saveAsTable(name)
        written[name] = seen.get["rows"]
    return written


def sql_seed(spark: SparkSession, sql: str) -> DataFrame:
    """A seed that is a query, such as one that makes rows with ``range`` or ``sequence``."""
    return spark.sql(sql)
