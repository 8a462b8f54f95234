"""Operational analytics over ordinary tables: top-k workload, usage, waits, headroom, freshness, lag, health."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.operators import lineage

RANKS = {"healthy": 0, "warning": 1, "critical": 2}


def status(value: Column, warn: float, critical: float, low: bool = False) -> Column:
    """healthy, warning or critical, by limits that count from themselves (or from below them, with ``low``)."""
    over = (lambda x: value < x) if low else (lambda x: value >= x)
    return F.when(over(critical), "critical").when(over(warn), "warning").otherwise("healthy")


def safe_percent(part: Column, whole: Column) -> Column:
    return F.round(100.0 * part / F.nullif(whole, F.lit(0)), 2).cast("double")


def workload_topk(log: DataFrame, by: str = "total", n: int = 10, exclude: str | None = None) -> DataFrame:
    """log: statement, ms, rows, hits, reads. Sorted by total, mean or calls, largest first."""
    rows = log.where(~F.col("statement").like(exclude)) if exclude else log
    ms = F.col("ms").cast("decimal(18,4)")
    out = rows.groupBy("statement").agg(F.count(F.lit(1)).alias("calls"), F.sum(ms).cast("double").alias("total"), (F.sum(ms).cast("double") / F.count("ms")).alias("mean"), F.sum("rows").alias("rows"), safe_percent(F.sum("hits"), F.sum("hits") + F.sum("reads")).alias("hit_ratio"))
    return out.withColumn("status", status(F.col("mean"), 1000, 5000)).orderBy(F.desc(by), "statement").limit(n)


def usage_by_state(sessions: DataFrame, group: str, capacity: int, reserved: int = 0) -> DataFrame:
    """sessions: state and a group column. Per group: total, counts by state as a map, percent of the capacity that is not reserved."""
    named = sessions.select(F.coalesce(F.col(group).cast("string"), F.lit("<none>")).alias("grp"), F.coalesce("state", F.lit("null")).alias("state"))
    counts = named.groupBy("grp", "state").agg(F.count(F.lit(1)).alias("n"))
    out = counts.groupBy("grp").agg(F.sum("n").alias("total"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("state", "n")))).alias("states"))
    out = out.withColumn("percent", F.round(100.0 * F.col("total") / (capacity - reserved), 2).cast("double"))
    return out.withColumn("status", status(F.col("percent"), 75, 90))


def wait_chains(edges: DataFrame) -> DataFrame:
    """edges: waiter, blocker, seconds. Roots block and are not blocked: direct waiters, oldest wait; most first."""
    waits = edges.select("waiter", "blocker", "seconds").distinct()
    roots = waits.join(waits.select(F.col("waiter").alias("blocker")).distinct(), "blocker", "left_anti")
    out = roots.groupBy("blocker").agg(F.countDistinct("waiter").alias("waiters"), F.max("seconds").alias("oldest"))
    return out.orderBy(F.desc("waiters"), F.desc("oldest"), "blocker")


def wait_depth(edges: DataFrame, root: DataFrame) -> DataFrame:
    """All that wait for the roots, directly or not, with how many steps away."""
    return lineage.closure(edges.select(F.col("blocker").alias("parent"), F.col("waiter").alias("child")), root, "down")


def long_running(sessions: DataFrame, now: Column, seconds: int, idle: tuple[str, ...] = ("idle",)) -> DataFrame:
    """sessions: id, state, started. Open at least so long and not idle; oldest first."""
    age = (F.unix_timestamp(now) - F.unix_timestamp("started")).alias("age")
    return sessions.where(~F.col("state").isin(*idle)).select("id", "state", age).where(F.col("age") >= seconds).orderBy(F.desc("age"), "id")


def idle_in_transaction(sessions: DataFrame, now: Column, seconds: int, states: tuple[str, ...] = ("idle in transaction", "idle in transaction (aborted)")) -> DataFrame:
    """sessions: id, state, changed. What has kept a transaction open without work for so long; longest first."""
    idle = (F.unix_timestamp(now) - F.unix_timestamp("changed")).alias("idle")
    return sessions.where(F.col("state").isin(*states)).select("id", "state", idle).where(F.col("idle") >= seconds).orderBy(F.desc("idle"), "id")


def key_headroom(keys: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """name -> (table, key): the last key against the largest value of its type."""
    limits = {"smallint": 32767, "int": 2147483647, "bigint": 9223372036854775807}
    rows = [df.agg(F.max(c).cast("long").alias("last")).select(F.lit(name).alias("key"), "last", F.lit(limits[dict(df.dtypes)[c]]).cast("long").alias("most")) for name, (df, c) in sorted(keys.items())]
    out = reduce(DataFrame.unionByName, rows).withColumn("percent", F.round(F.col("last").cast("double") * 100 / F.col("most").cast("double"), 2))
    return out.withColumn("status", status(F.col("percent"), 70, 85))


def hit_ratio_worst(df: DataFrame, group: str, n: int = 10) -> DataFrame:
    """df: hits, reads. Lowest ratio first, groups without traffic left out; ``hit_ratio_overall`` is that of all rows."""
    out = df.groupBy(group).agg(F.sum("hits").alias("hits"), F.sum("reads").alias("reads")).where(F.col("hits") + F.col("reads") > 0)
    out = out.withColumn("ratio", safe_percent(F.col("hits"), F.col("hits") + F.col("reads")))
    return out.withColumn("status", status(F.col("ratio"), 95, 90, low=True)).orderBy("ratio", group).limit(n)


def hit_ratio_overall(df: DataFrame) -> DataFrame:
    """df: hits, reads. One row: their sums, the ratio (100 where there is no traffic) and its status."""
    out = df.agg(F.coalesce(F.sum("hits"), F.lit(0)).alias("hits"), F.coalesce(F.sum("reads"), F.lit(0)).alias("reads"))
    out = out.withColumn("ratio", F.coalesce(safe_percent(F.col("hits"), F.col("hits") + F.col("reads")), F.lit(100.0)))
    return out.withColumn("status", status(F.col("ratio"), 95, 90, low=True))


def freshness(df: DataFrame, group: str, ts: str, now: Column, least: int = 1000) -> DataFrame:
    """Days since the last update of groups of over ``least`` rows; never seen is critical and comes first."""
    out = df.groupBy(group).agg(F.count(F.lit(1)).alias("rows"), F.max(ts).alias("last")).where(F.col("rows") > least)
    out = out.withColumn("days", F.date_diff(now, F.col("last")))
    state = F.when(F.col("last").isNull(), "critical").otherwise(status(F.col("days"), 7, 30))
    return out.withColumn("status", state).orderBy(F.asc_nulls_first("last"), group)


def duplicate_groups(df: DataFrame, key: Column, size: Column) -> DataFrame:
    """Sets of equal key: members, total and wasted size (all but the largest), most wasted first."""
    out = df.select(key.alias("key"), size.cast("long").alias("size")).groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.sum("size").alias("total"), F.max("size").alias("largest")).where("members > 1")
    return out.select("key", "members", "total", (F.col("total") - F.col("largest")).alias("wasted")).orderBy(F.desc("wasted"), "key")


def unused_entities(dimension: DataFrame, key: str, facts: DataFrame, fact_key: str, size: str) -> DataFrame:
    """Rows of the dimension that no fact uses, biggest first."""
    return dimension.join(facts.select(F.col(fact_key).alias("_used")).distinct(), F.col(key) == F.col("_used"), "left_anti").orderBy(F.desc(size), key)


def scan_ratio_topk(df: DataFrame, a: str, b: str, volume: str, least: float = 0, n: int = 10) -> DataFrame:
    """a / b, or a where b is 0, for rows whose volume is over the least; largest volume first."""
    ratio = F.when(F.col(b) == 0, F.col(a).cast("double")).otherwise(F.round(F.col(a).cast("double") / F.nullif(F.col(b).cast("double"), F.lit(0.0)), 4))
    return df.where(F.col(volume) > least).withColumn("ratio", ratio).orderBy(F.desc(volume), *[c for c in df.columns if c not in (a, b, volume)]).limit(n)


def stale_row_ratio(df: DataFrame, key: list[str]) -> DataFrame:
    """Rows that a later version of their key supersedes, over all."""
    keys = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    out = keys.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), (F.coalesce(F.sum("n"), F.lit(0)) - F.count(F.lit(1))).alias("superseded"))
    out = out.withColumn("percent", safe_percent(F.col("superseded"), F.col("rows")))
    bad = (F.col("percent") >= 25) | (F.col("superseded") >= 1_000_000)
    return out.withColumn("status", F.when(bad, "critical").when(F.col("percent") >= 10, "warning").otherwise("healthy"))


def lag_status(df: DataFrame, group: str, produced: str, seen: str) -> DataFrame:
    """Largest lag of each consumer, in seconds."""
    lag = F.unix_timestamp(seen) - F.unix_timestamp(produced)
    return df.groupBy(group).agg(F.max(lag).alias("lag")).withColumn("status", status(F.col("lag"), 30, 300)).orderBy(F.desc("lag"), group)


# The health report's own checks. Their limits, which are exceeded, not reached: minutes, percent of a capacity, percent of a key's type.
OPEN_MINUTES, CAPACITY_PERCENT, KEY_PERCENT = 30, (80, 95), (70, 85)


def _over(value: Column, warn: float, critical: float) -> Column:
    return F.when(value > critical, "critical").when(value > warn, "warning").otherwise("healthy")


def _oldest(rows: DataFrame, seconds: str) -> DataFrame:
    """count, minutes (whole ones of the oldest), status: none is healthy, over ``OPEN_MINUTES`` critical, else a warning."""
    out = rows.agg(F.count(F.lit(1)).alias("count"), F.floor(F.coalesce(F.max(seconds), F.lit(0)) / 60).cast("long").alias("minutes"))
    return out.withColumn("status", F.when(F.col("count") == 0, "healthy").when(F.col("minutes") > OPEN_MINUTES, "critical").otherwise("warning"))


def blocked_check(edges: DataFrame) -> DataFrame:
    """edges: waiter, blocker, seconds. How many wait for others and for how long the oldest does."""
    return _oldest(edges.where("waiter <> blocker").groupBy("waiter").agg(F.max("seconds").alias("seconds")), "seconds")


def open_check(sessions: DataFrame, now: Column, seconds: int = 300) -> DataFrame:
    """sessions: id, state, started. What is open for longer than so many seconds and not idle."""
    age = (F.unix_timestamp(now) - F.unix_timestamp("started")).alias("seconds")
    return _oldest(sessions.where("state <> 'idle'").select(age).where(F.col("seconds") > seconds), "seconds")


def capacity_check(sessions: DataFrame, capacity: int) -> DataFrame:
    """count, percent (whole ones of the capacity), status."""
    out = sessions.agg(F.count(F.lit(1)).alias("count")).withColumn("percent", F.floor(100 * F.col("count") / F.lit(capacity)).cast("long"))
    return out.withColumn("status", _over(F.col("percent"), *CAPACITY_PERCENT))


def keys_check(keys: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """key, percent, status of the key nearest to the end of its type."""
    return key_headroom(keys).orderBy(F.desc("percent"), "key").limit(1).select("key", "percent", _over(F.col("percent"), *KEY_PERCENT).alias("status"))


def health_report(checks: dict, spark) -> DataFrame:
    """name -> callable giving a table with ``status``, of which the worst counts (none: healthy).

    The checks run here, one after the other. One that cannot be planned or fails while it runs is skipped, with the kind of
    failure as its reason; the last row is the worst of all that were not skipped.
    """
    rows, worst, ranks = [], 0, list(RANKS)
    for name, check in sorted(checks.items()):
        try:
            found = [r["status"] for r in check().select("status").distinct().collect()]
            rank = max((RANKS[x] for x in found if x in RANKS), default=0)
            rows.append((name, ranks[rank], None))
            worst = max(worst, rank)
        except Exception as e:  # the report goes on without it
            rows.append((name, "skipped", type(e).__name__))
    return spark.createDataFrame([*rows, ("overall", ranks[worst], None)], "check_name string, status string, reason string")
