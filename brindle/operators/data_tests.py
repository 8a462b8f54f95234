"""Data tests: counts of violations. All plain counts of a table are one pass, all tests of uniqueness one, all references one."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Passes that run at once.
AT_ONCE = 8
#: Types whose values are equal exactly if their texts are: references of these are tested together.
_TEXTS = ("string", "boolean", "tinyint", "smallint", "int", "bigint", "date")


@dataclass(frozen=True)
class Test:
    """kind: not_null, unique, accepted_values or relationships."""

    kind: str
    columns: tuple[str, ...]
    values: tuple = ()
    ref: DataFrame | None = None
    ref_column: str = ""

    @property
    def name(self) -> str:
        return f"{self.kind}({', '.join(self.columns)})"


def _violates(test: Test):
    column = F.col(test.columns[0])
    return column.isNull() if test.kind == "not_null" else ~column.isin(*test.values)


def not_null(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNull())


def unique(df: DataFrame, columns: list[str]) -> DataFrame:
    """Groups of more than one row; nulls form a group."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def accepted_values(df: DataFrame, column: str, values: list) -> DataFrame:
    """Rows of other values; null is no violation."""
    return df.where(~F.col(column).isin(*values))


def relationships(df: DataFrame, column: str, ref: DataFrame, ref_column: str) -> DataFrame:
    """Rows whose value is not null and has no match."""
    return df.where(F.col(column).isNotNull()).join(ref.select(F.col(ref_column).alias("_ref")), F.col(column) == F.col("_ref"), "left_anti")


def plain_counts(df: DataFrame, tests: list[Test]) -> DataFrame:
    """test (its number), violations of ``not_null`` and ``accepted_values`` tests, in one pass."""
    counts = df.agg(*(F.count_if(_violates(t)).alias(f"t{i}") for i, t in enumerate(tests)))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(i).alias("test"), F.col(f"t{i}").alias("violations")) for i in range(len(tests))))).alias("x")).select("x.*")


def unique_counts(df: DataFrame, tests: list[Test]) -> DataFrame:
    """test, violations (groups of more than one row) of ``unique`` tests, by grouping sets over one scan. A test without violation has no row."""
    columns = sorted({c for t in tests for c in t.columns})
    sets = list({tuple(sorted(t.columns)): None for t in tests})
    # the bits of a grouping id are those columns that a set leaves out, the first column's highest
    ids = {own: sum(1 << (len(columns) - 1 - k) for k, c in enumerate(columns) if c not in own) for own in sets}
    groups = df.groupingSets([[F.col(f"`{c}`") for c in own] for own in sets], *(F.col(f"`{c}`") for c in columns)).agg(F.grouping_id().alias("_set"), F.count(F.lit(1)).alias("_rows"))
    per_set = groups.where("_rows > 1").groupBy("_set").agg(F.count(F.lit(1)).alias("violations"))
    numbers = F.array(*(F.struct(F.lit(ids[tuple(sorted(t.columns))]).cast("long").alias("set"), F.lit(i).alias("test")) for i, t in enumerate(tests)))
    own = F.transform(F.filter(numbers, lambda x: x["set"] == F.col("_set")), lambda x: x["test"])
    return per_set.select(F.explode(own).alias("test"), "violations")


def relationship_counts(df: DataFrame, tests: list[Test]) -> DataFrame:
    """test, violations of ``relationships`` tests over one scan of the table and one of each reference. A test without violation has no row.

    Values are counted before they are joined, so that a frequent one is one row.
    """
    pairs = F.explode(F.array(*(F.struct(F.lit(i).alias("test"), F.col(f"`{t.columns[0]}`").cast("string").alias("value")) for i, t in enumerate(tests))))
    values = df.select(pairs.alias("x")).select("x.*").where("value IS NOT NULL").groupBy("test", "value").agg(F.count(F.lit(1)).alias("rows"))
    known = reduce(DataFrame.unionByName, (t.ref.select(F.lit(i).alias("test"), F.col(f"`{t.ref_column}`").cast("string").alias("value")) for i, t in enumerate(tests)))
    return values.join(known, ["test", "value"], "left_anti").groupBy("test").agg(F.sum("rows").alias("violations"))


def _together(df: DataFrame, test: Test) -> str:
    """The pass that a test goes with; those that cannot be planned, or whose two types differ, stand alone."""
    types = dict(df.dtypes)
    if not set(test.columns) <= set(types):
        return "alone"
    if test.kind == "relationships":
        kind = dict(test.ref.dtypes).get(test.ref_column) if test.ref is not None else None
        return "relationships" if kind == types[test.columns[0]] and kind in _TEXTS else "alone"
    return "unique" if test.kind == "unique" else "plain"


PASSES = {"plain": plain_counts, "unique": unique_counts, "relationships": relationship_counts}


def suite(tables: dict[str, tuple[DataFrame, list[Test]]]) -> DataFrame:
    """model, test, violations, status. A test that cannot be planned or fails while it runs is ``error``, with no count; the others go on.

    The tests run here, at most three passes a table however many tests it has, several at once; of a pass that fails each test runs for itself.
    """
    todo: list[tuple[str, DataFrame, str, list[Test]]] = []
    for model, (df, tests) in sorted(tables.items()):
        kinds = [_together(df, t) for t in tests]
        todo += [(model, df, kind, [t for t, k in zip(tests, kinds, strict=True) if k == kind]) for kind in PASSES if kind in kinds]
        todo += [(model, df, "alone", [t]) for t, k in zip(tests, kinds, strict=True) if k == "alone"]

    def run(job: tuple[str, DataFrame, str, list[Test]]) -> list[tuple[str, Test, int | None]]:
        model, df, kind, own = job
        found = _counted(lambda: PASSES[kind](df, own)) if kind in PASSES else None
        if found is None and len(own) > 1:  # one of them fails on some row
            return [x for t in own for x in run((model, df, "alone", [t]))]
        if found is None:
            return [(model, own[0], _count(lambda: _violating(df, own[0])))]
        return [(model, t, found.get(i, 0)) for i, t in enumerate(own)]

    with ThreadPoolExecutor(AT_ONCE) as pool:
        done = {(model, id(t)): n for rows in pool.map(run, todo) for model, t, n in rows}
    shown = [(model, t.name, n, "error" if n is None else "fail" if n else "pass") for model, (_, tests) in sorted(tables.items()) for t in tests for n in (done[model, id(t)],)]
    return SparkSession.active().createDataFrame(shown, "model string, test string, violations long, status string")


def _counted(counts: Callable[[], DataFrame]) -> dict[int, int] | None:
    """test -> violations, a row for each test at most; None if the pass fails."""
    try:
        return {r.test: r.violations for r in counts().collect()}
    except Exception:
        return None


def _count(violating: Callable[[], DataFrame]) -> int | None:
    """The number of rows; None if they cannot be found out: an unknown column or table, or a failure on some row."""
    try:
        return violating().count()
    except Exception:
        return None


def _violating(df: DataFrame, test: Test) -> DataFrame:
    if test.kind == "unique":
        return unique(df, list(test.columns))
    if test.kind == "relationships":
        return relationships(df, test.columns[0], test.ref, test.ref_column)
    return df.where(_violates(test))
