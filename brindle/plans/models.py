"""Models: named transformations in dependency order, materialised as view, table or incremental upsert."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from brindle.operators import incremental
from brindle.sources.shared import remove_tree

KINDS = ("view", "table", "incremental")


@dataclass(frozen=True)
class Model:
    """``name`` is schema.table. ``body``, ``base`` (first runs) and ``later`` (later runs) take the session; ``later`` finds its target as ``this``.
    A model with ``sql`` (view or table) goes into the catalog under its name instead, for all sessions."""

    name: str
    body: Callable[[SparkSession], DataFrame] | None = None
    kind: str = "view"
    deps: tuple[str, ...] = ()
    tags: tuple[str, ...] = ()
    unique_key: tuple[str, ...] = ()
    watermark: tuple[str, ...] = ()
    lookback: str | None = None
    incremental_filter: str | None = None
    base: Callable[[SparkSession], DataFrame] | None = None
    later: Callable[[SparkSession], DataFrame] | None = None
    sql: str | None = None

    def __post_init__(self):
        if len(self.name.split(".")) != 2 or not all(self.name.split(".")):
            raise ValueError(f"a model's name is schema.table, not {self.name!r}")
        if self.kind not in KINDS:
            raise ValueError(f"{self.name}: materialisation is one of {KINDS}")
        if (self.body is None) == (self.sql is None) or self.sql is not None and self.kind == "incremental":
            raise ValueError(f"{self.name}: a model has a body, or SQL text if it is a view or table")
        if self.kind == "incremental" and not self.unique_key:
            raise ValueError(f"{self.name}: an incremental model needs a unique key")
        if self.watermark and self.incremental_filter:
            raise ValueError(f"{self.name}: watermark and incremental filter exclude each other")


def order(models: dict[str, Model]) -> list[str]:
    """Names, parents first, ties by name; a cycle raises ValueError with its members. Dependencies outside are sources."""
    left, done = dict(models), []
    while left:
        free = sorted(n for n, m in left.items() if not any(d in left for d in m.deps))
        if not free:
            raise ValueError(f"models depend on each other: {', '.join(sorted(left))}")
        done += free
        for n in free:
            del left[n]
    return done


def select(models: dict[str, Model], include: list[str] | None = None, exclude: list[str] | None = None) -> list[str]:
    """Names by selector: a name, ``tag:x``, ``deps:x`` (x and what it needs), ``downstream:x``, ``tree:x`` (both ways)."""
    children: dict[str, set[str]] = {n: {m.name for m in models.values() if n in m.deps} for n in models}
    parents = {n: {d for d in m.deps if d in models} for n, m in models.items()}

    def walk(start: str, near: dict[str, set[str]]) -> set[str]:
        seen, todo = set(), [start]
        while todo:
            if (n := todo.pop()) not in seen:
                seen.add(n)
                todo += near[n]
        return seen

    def matching(selector: str) -> set[str]:
        kind, _, name = selector.rpartition(":")
        if kind == "tag":
            return {n for n, m in models.items() if name in m.tags}
        if name not in models:
            raise KeyError(f"no model {name!r}")
        return {"": lambda: {name}, "deps": lambda: walk(name, parents), "downstream": lambda: walk(name, children), "tree": lambda: walk(name, parents) | walk(name, children)}[kind]()

    taken = set().union(*map(matching, include)) if include else set(models)
    return [n for n in order(models) if n in taken - set().union(*map(matching, exclude or []))]


def _target(spark: SparkSession, model: Model, root: str) -> incremental.VersionedTable:
    path = f"{root}/{model.name}"
    return incremental.BucketedTable(spark, path, list(model.unique_key)) if model.kind == "incremental" else incremental.VersionedTable(spark, path)


def build(spark: SparkSession, model: Model, root: str, full_refresh: bool = False, target: incremental.VersionedTable | None = None) -> DataFrame:
    """Materialises one model; the result can be read as ``schema_table`` (a temporary view of this session)."""
    name = model.name.replace(".", "_")
    target = target or _target(spark, model, root)
    if model.kind == "view":
        out = model.body(spark)
        out.createOrReplaceTempView(name)
        if target.version() is not None:  # it was a table: the view takes its place
            remove_tree(spark, target.path)
    else:
        if model.kind == "table":
            out = target.write(model.body(spark))
        elif full_refresh or target.version() is None:
            out = target.first_run((model.base or model.body)(spark), list(model.unique_key))
        else:
            now = target.read()
            now.createOrReplaceTempView("this")
            source = (model.later or model.body)(spark)
            if not model.later and model.watermark:
                source = incremental.watermark_filter(source, now, model.watermark[0], model.lookback, *model.watermark[1:2])
            elif not model.later and model.incremental_filter:
                source = source.where(model.incremental_filter)
            out = target.upsert(source, list(model.unique_key))
    out.createOrReplaceTempView(name)
    return out


def run_pipeline(spark: SparkSession, models: dict[str, Model], root: str, include: list[str] | None = None, exclude: list[str] | None = None, full_refresh: bool = False) -> DataFrame:
    """Builds the chosen models in order, stops at the first that fails. A row per model: what was done, its rows, and the rows that an incremental one inserted and updated.

    Databases that models with SQL text are put in are created if they are missing.
    """
    rows, failed = [], False
    for name in select(models, include, exclude):
        model = models[name]
        if failed:
            rows.append((name, model.kind, "not run", None, None, None))
            continue
        try:
            if model.sql is not None:
                out, counts = put(spark, model), {}
            else:
                target = _target(spark, model, root)
                out, counts = build(spark, model, root, full_refresh, target), getattr(target, "counts", {})
            rows.append((name, model.kind, "ok", out.count(), counts.get("inserted"), counts.get("updated")))
        except Exception as e:  # reported in its row; later models depend on this one
            failed = True
            rows.append((name, model.kind, f"error: {type(e).__name__}", None, None, None))
    return spark.createDataFrame(rows, "model string, kind string, result string, rows long, inserted long, updated long")


def object_kind(spark: SparkSession, name: str) -> str | None:
    """``view``, ``table`` or None: what the catalog holds under schema.name, for every session."""
    if not spark.catalog.databaseExists(name.split(".")[0]) or not spark.catalog.tableExists(name):
        return None
    return "view" if spark.catalog.getTable(name).tableType == "VIEW" else "table"


def put(spark: SparkSession, model: Model, change_kind: bool = True) -> DataFrame:
    """Puts a model of SQL text into the catalog, where other sessions read it, as a view or table; what stands there of the other kind goes first.

    A view is replaced in place. A table is written under a name of its own and renamed once it is whole, so that its body may read
    the old one and a failure leaves that as it was; a session that has read the old one refreshes it (``REFRESH TABLE``). With
    ``change_kind`` False, an object of the other kind raises ValueError and stays.
    """
    schema, _ = model.name.split(".")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{schema}`")
    there = object_kind(spark, model.name)
    if there not in (None, model.kind) and not change_kind:
        raise ValueError(f"{model.name} is a {there}, not a {model.kind}")
    if model.kind == "view":
        spark.sql(f"EXPLAIN {model.sql}")  # an unknown name raises before anything goes
        if there == "table":
            spark.sql(f"DROP TABLE {model.name}")
        spark.sql(f"CREATE OR REPLACE VIEW {model.name} AS {model.sql}")
    else:
        whole = f"{model.name}_{uuid.uuid4().hex[:12]}"
        spark.sql(model.sql).write.saveAsTable(whole)
        if there:
            spark.sql(f"DROP {there.upper()} {model.name}")
        spark.sql(f"ALTER TABLE {whole} RENAME TO {model.name}")
    return spark.table(model.name)


def pipeline_status(spark: SparkSession, models: dict[str, Model], root: str) -> DataFrame:
    """model, kind, state, rows. ``synced``; ``missing``; ``type mismatch``: a table stands where the model is a view now, or only a view where it is stored."""
    rows = []
    for name in order(models):
        if models[name].sql is not None:
            there = object_kind(spark, name)
            state = "missing" if there is None else "synced" if there == models[name].kind else "type mismatch"
            rows.append((name, models[name].kind, state, spark.table(name).count() if state == "synced" else None))
            continue
        view, target = name.replace(".", "_"), _target(spark, models[name], root)
        stored, shown, is_view = target.version() is not None, spark.catalog.tableExists(view), models[name].kind == "view"
        if stored if is_view else shown and not stored:
            rows.append((name, models[name].kind, "type mismatch", None))
        elif shown if is_view else stored:
            rows.append((name, models[name].kind, "synced", (spark.table(view) if is_view else target.read()).count()))
        else:
            rows.append((name, models[name].kind, "missing", None))
    return spark.createDataFrame(rows, "model string, kind string, state string, rows long")
