"""Jobs over sets of tables: anonymised copies, snapshots, storage reports, descriptions."""

from __future__ import annotations

import json
import re
import uuid
import warnings
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from brindle.functions.anonymise import strategy
from brindle.sources import sql_text
from brindle.sources.shared import tree_bytes

# Schemas that no table set takes, and how the names of others that none takes begin.
SYSTEM_SCHEMAS = ("pg_catalog", "information_schema", "pg_toast")
SYSTEM_PREFIX = "pg_"


@dataclass(frozen=True)
class Rule:
    """What becomes of a column; a table rule without column skips the table."""

    table: str
    column: str | None
    strategy: str = "skip"


@dataclass(frozen=True)
class Profile:
    """Which tables a snapshot takes: an include list wins, else all but the excluded."""

    schemas: tuple[str, ...] = ()
    exclude_schemas: tuple[str, ...] = ()
    tables: tuple[str, ...] = ()
    exclude_tables: tuple[str, ...] = ()
    data: bool = True


def chosen(names: DataFrame, profile: Profile) -> DataFrame:
    """names: name (schema.table). Those the profile takes; system schemas never."""
    schema = F.substring_index("name", ".", 1)
    ok = ~(schema.isin(*SYSTEM_SCHEMAS) | schema.startswith(SYSTEM_PREFIX))
    if profile.schemas or profile.tables:
        ok &= schema.isin(*profile.schemas) | F.col("name").isin(*profile.tables)
    return names.where(ok & ~schema.isin(*profile.exclude_schemas) & ~F.col("name").isin(*profile.exclude_tables))


def left_out(name: str, rules: list[Rule]) -> str | None:
    """Why no copy, dump or preview of columns takes a table: a rule skips it, or its schema is the system's."""
    schema, dot, _ = name.partition(".")
    if dot and (schema in SYSTEM_SCHEMAS or schema.startswith(SYSTEM_PREFIX)):
        return "excluded"
    return "skip" if any(r.table == name and r.column is None and r.strategy == "skip" for r in rules) else None


def anonymise(df: DataFrame, rules: dict[str, str], seed: str) -> DataFrame:
    """One projection; columns without a rule stay. An unknown column or strategy raises ValueError."""
    if unknown := set(rules) - set(df.columns):
        raise ValueError(f"no such columns: {sorted(unknown)}")
    return df.select(*(strategy(rules[c], F.col(c), t, seed).alias(c) if c in rules else F.col(c) for c, t in df.dtypes))


def write_order(names: list[str], references: list[tuple[str, str]] = ()) -> list[str]:
    """Names in an order in which they can be loaded: parents first, then by name. references: (table, table it refers to).

    References of a table to itself and to tables outside do not count. With a cycle the order is that of names, and a warning says so.
    These are names of tables, as many as the set has; ``lineage.load_layers`` does the same for edge tables of any size.
    """
    left, done = {n: {p for c, p in references if c == n and p != n and p in set(names)} for n in sorted(names)}, []
    while left:
        free = [n for n, parents in left.items() if not parents & set(left)]
        if not free:
            warnings.warn("the references have a cycle: tables are taken in the order of their names", stacklevel=2)
            return sorted(names)
        done += free
        left = {n: p for n, p in left.items() if n not in free}
    return done


def anonymised(tables: dict[str, DataFrame], rules: list[Rule], seed: str, references: list[tuple[str, str]] = ()) -> Iterator[tuple[str, DataFrame]]:
    """Name and anonymised rows of every table that is not left out, parents first."""
    for name in write_order([n for n in tables if not left_out(n, rules)], references):
        yield name, anonymise(tables[name], {r.column: r.strategy for r in rules if r.table == name and r.column}, seed)


def anonymise_dump(tables: dict[str, DataFrame], rules: list[Rule], seed: str, out: str, references: list[tuple[str, str]] = ()) -> list[str]:
    """Writes the anonymised copy of every table that is not left out, parents first (see ``write_order``); returns their names in that order."""
    written = []
    for name, df in anonymised(tables, rules, seed, references):
        df.write.parquet(f"{out}/{name}")
        written.append(name)
    return written


def anonymise_dump_sql(tables: dict[str, DataFrame], rules: list[Rule], seed: str, out: str, references: list[tuple[str, str]] = ()) -> list[str]:
    """The same as SQL text, a folder for each table, numbered in loading order; see ``sql_text.write_inserts``."""
    written = []
    for k, (name, df) in enumerate(anonymised(tables, rules, seed, references)):
        sql_text.write_inserts(df, name, f"{out}/{k:05d}-{name}")
        written.append(name)
    return written


def anonymise_preview(spark: SparkSession, tables: dict[str, DataFrame], rules: list[Rule]) -> DataFrame:
    """table, rows, column, strategy of every column; those without a rule are ``real``. A table that is left out is one row without column, whose strategy says why."""
    shown = []
    for n, df in sorted(tables.items()):
        if why := left_out(n, rules):
            shown.append((n, None, why))
        else:
            shown += [(n, c, next((r.strategy for r in rules if (r.table, r.column) == (n, c)), "real")) for c in df.columns]
    counts = reduce(DataFrame.unionByName, (df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("table"), "rows") for n, df in sorted(tables.items())))
    return counts.join(spark.createDataFrame(shown, "table string, column string, strategy string"), "table")


def anonymise_preview_totals(spark: SparkSession, tables: dict[str, DataFrame], rules: list[Rule]) -> DataFrame:
    """One row: tables and rows that a dump takes, tables it leaves out, columns that a rule changes, columns that stay real, and their names (table.column, in order)."""
    shown = anonymise_preview(spark, tables, rules)
    taken = F.col("column").isNotNull()
    real = taken & (F.col("strategy") == "real")
    per_table = shown.groupBy("table").agg(F.max("rows").alias("rows"), F.bool_or(taken).alias("taken"), F.count_if(taken & ~real).alias("changed"), F.array_sort(F.collect_list(F.when(real, F.concat_ws(".", "table", "column")))).alias("real"))
    return per_table.agg(
        F.count_if("taken").alias("tables"), F.coalesce(F.sum(F.when(F.col("taken"), F.col("rows"))), F.lit(0)).alias("rows"), F.count_if(~F.col("taken")).alias("left_out"),
        F.coalesce(F.sum("changed"), F.lit(0)).alias("changed"), F.coalesce(F.sum(F.size("real")), F.lit(0)).alias("real"), F.array_join(F.array_sort(F.flatten(F.collect_list("real"))), ",").alias("real_columns"),
    )


def bootstrap_copy(source: dict[str, DataFrame], rules: list[Rule], seed: str, target: str, references: list[tuple[str, str]] = ()) -> list[str]:
    """Tables of a source (Parquet or JDBC frames) that are not left out, anonymised into tables of a target database, parents first; a name's schema is dropped. Returns their names in that order."""
    taken = sorted(n for n in source if not left_out(n, rules))
    if len({n.rpartition(".")[2] for n in taken}) < len(taken):
        raise ValueError(f"tables of one name in several schemas: {taken}")
    copied = []
    for name, df in anonymised(source, rules, seed, references):
        df.sparkSession.sql(f"CREATE DATABASE IF NOT EXISTS {target}")
        df.write.mode("overwrite").saveAsTable(f"{target}.{name.rpartition('.')[2]}")
        copied.append(name)
    return copied


_MANIFEST = "snapshot string, created string, table string, schema string, rows long, data boolean, bytes long, digest string, path string, profile string"


def _digest(df: DataFrame) -> list:
    """rows, and the sums of two 64-bit hashes of each row: whatever order the rows are in, they are the same."""
    shown = F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)), {"ignoreNullFields": "false"}) if df.columns else F.lit("")
    sums = [F.coalesce(F.sum(F.xxhash64(F.lit(seed), shown).cast("decimal(20,0)")), F.lit(0)).cast("string") for seed in (0, 1)]
    return [F.count(F.lit(1)).alias("rows"), F.concat_ws(":", *sums).alias("digest")]


def snapshot_save(spark: SparkSession, tables: dict[str, DataFrame], name: str, root: str, profile: Profile | None = None, created: str = "") -> DataFrame:
    """Writes the tables a profile takes and, last, a manifest: schema, rows, bytes, digest and place of each table, and the profile.

    Rows and digest are observed in the write itself. Each save writes to a folder of its own: one that is interrupted, under a new name
    or one that was saved before, leaves no manifest that points to it, and what was saved before stays as it is.
    """
    profile = profile or Profile()
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_-]{0,63}", name):
        raise ValueError(f"no snapshot name: {name!r}")
    names = spark.createDataFrame([(n,) for n in sorted(tables)], "name string") if tables else None
    taken = [r.name for r in chosen(names, profile).orderBy("name").collect()] if names is not None else []
    rows, own = [], f"data-{uuid.uuid4().hex}"
    for t in taken:
        df, path, seen = tables[t] if profile.data else tables[t].limit(0), f"{own}/{t}", Observation()
        df.observe(seen, *_digest(df)).write.parquet(f"{root}/{name}/{path}")
        rows.append((name, created, t, df.schema.json(), seen.get["rows"], profile.data, tree_bytes(spark, f"{root}/{name}/{path}"), seen.get["digest"], path, json.dumps(asdict(profile))))
    manifest = spark.createDataFrame(rows, _MANIFEST)
    manifest.coalesce(1).write.mode("overwrite").json(f"{root}/{name}/manifest")
    return manifest


def snapshot_read(spark: SparkSession, name: str, root: str) -> dict[str, DataFrame]:
    """The tables of a snapshot with the schema (defaults included) they had, each read once to check it against its manifest's rows and digest."""
    found = {}
    for r in spark.read.schema(_MANIFEST).json(f"{root}/{name}/manifest").collect():  # a row for each table
        df = spark.read.schema(StructType.fromJson(json.loads(r.schema))).parquet(f"{root}/{name}/{r.path}")
        now = df.agg(*_digest(df)).first()
        if (now.rows, now.digest) != (r.rows, r.digest):
            raise ValueError(f"{r.table} of snapshot {name} is not what its manifest says: {now.rows} rows for {r.rows}, or other values")
        found[r.table] = df
    return found


def snapshot_restore(spark: SparkSession, name: str, root: str, confirmed: bool = False) -> list[str]:
    """Replaces tables by those of a snapshot, all of which are checked first; refuses unless confirmed."""
    if not confirmed:
        raise PermissionError("a restore replaces tables: call it with confirmed=True")
    tables = snapshot_read(spark, name, root)
    for t, df in sorted(tables.items()):
        df.write.mode("overwrite").saveAsTable(t)
    return sorted(tables)


def snapshot_list(spark: SparkSession, root: str) -> DataFrame:
    """snapshot, created, tables, rows, bytes; newest first."""
    rows = spark.read.schema(_MANIFEST).json(f"{root}/*/manifest")
    return rows.groupBy("snapshot", "created").agg(F.count(F.lit(1)).alias("tables"), F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes")).orderBy(F.desc("created"), "snapshot")


def storage_report(tables: dict[str, DataFrame], top: int = 10, warn: int = 1 << 40, critical: int = 10 << 40) -> DataFrame:
    """table, bytes, rows, status; largest first. Rows and sizes of files come from the scan's metadata, in one pass of no columns."""
    per = []
    for name, df in sorted(tables.items()):
        files = df.select("_metadata.file_path", "_metadata.file_size").groupBy("file_path", "file_size").agg(F.count(F.lit(1)).alias("n"))
        per.append(files.agg(F.coalesce(F.sum("file_size"), F.lit(0)).alias("bytes"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).select(F.lit(name).alias("table"), "bytes", "rows"))
    state = F.when(F.col("bytes") >= critical, "critical").when(F.col("bytes") >= warn, "warning").otherwise("healthy")
    return reduce(DataFrame.unionByName, per).withColumn("status", state).orderBy(F.desc("bytes"), "table").limit(top)


def describe_table(df: DataFrame, key: list[str]) -> DataFrame:
    """position, column, type, is_key, rows and null values of each column and the bytes of the table's files (0 if it has none), in one pass."""
    try:
        df, names, per = df.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_size").alias("_bytes")), df.columns, ["_path", "_bytes"]
        df.schema  # no files: the metadata column is not there
    except AnalysisException:
        return _described(df, key).withColumn("bytes", F.lit(0).cast("long"))
    files = df.groupBy(*per).agg(F.count(F.lit(1)).alias("rows"), *(F.count_if(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(names)))
    whole = files.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.coalesce(F.sum("_bytes"), F.lit(0)).alias("bytes"), *(F.coalesce(F.sum(f"n{i}"), F.lit(0)).alias(f"n{i}") for i in range(len(names))))
    shown = [F.struct(F.lit(i + 1).alias("position"), F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"), F.lit(f.name in key).alias("is_key"), F.col("rows").alias("rows"), F.col(f"n{i}").alias("nulls"), F.col("bytes").alias("bytes")) for i, f in enumerate(df.schema) if f.name not in per]
    return whole.select(F.explode(F.array(*shown)).alias("x")).select("x.*")


def _described(df: DataFrame, key: list[str]) -> DataFrame:
    counts = [F.count(F.lit(1)).alias("rows"), *(F.count_if(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(df.columns))]
    shown = [F.struct(F.lit(i + 1).alias("position"), F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"), F.lit(f.name in key).alias("is_key"), F.col("rows").alias("rows"), F.col(f"n{i}").alias("nulls")) for i, f in enumerate(df.schema)]
    return df.agg(*counts).select(F.explode(F.array(*shown)).alias("x")).select("x.*")
