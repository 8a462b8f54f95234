"""Incremental tables: first run, high-water marks, upserts into new versions.

A versioned table is a folder of Parquet versions; the largest that is written whole (its success mark) counts. A failed write
leaves a folder without mark, which is never read and whose number is not used again. A bucketed table is one whose
versions hold only the buckets of keys that changed: an upsert reads and writes the buckets of its source.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from brindle.sources.shared import remove_tree, settle


def assert_keys(df: DataFrame, key: list[str]) -> DataFrame:
    """Raises ValueError if a key is null or stands twice."""
    bad = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(" OR ".join(["n > 1", *(f"`{k}` IS NULL" for k in key)])).limit(3).collect()
    if bad:
        raise ValueError(f"null or repeated keys {key}: {[tuple(r[k] for k in key) for r in bad]}")
    return df


def watermark_filter(df: DataFrame, target: DataFrame, column: str, lookback: str | None = None, second: str | None = None, strict: bool = False) -> DataFrame:
    """Rows above the target's maximum, strictly; ``lookback`` (an interval, of the first column) reads late rows again.

    With ``second``, (column, second) is compared with the two maxima, which are taken one by one. The maximum
    is read first and compared as a literal, so the filter reaches the scan. An empty target is a first
    run: all rows pass, or none with ``strict``.
    """
    low = F.max(column) if lookback is None else F.max(column) - F.expr(f"INTERVAL {lookback}")
    top = target.agg(low.alias("a"), F.max(second).alias("b") if second else F.lit(None).alias("b")).first()
    if top["a"] is None:
        return df.where(F.lit(not strict))
    above = F.col(column) > F.lit(top["a"])
    if second:
        above = above | ((F.col(column) == F.lit(top["a"])) & (F.col(second) > F.lit(top["b"])))
    return df.where(above)


def merge_upsert(target: DataFrame, source: DataFrame, key: list[str]) -> DataFrame:
    """Rows of the source replace those of equal key or are added; columns are the target's. With key columns only, a match changes nothing."""
    assert_keys(source, key)
    return target.join(source.select(*key), key, "left_anti").select(*target.columns).unionByName(source.select(*target.columns))


def merge_counts(target: DataFrame, source: DataFrame, key: list[str]) -> DataFrame:
    """inserted, updated."""
    mark = target.select(*key, F.lit(True).alias("_match")).distinct()
    return source.join(mark, key, "left").agg(F.count_if(F.col("_match").isNull()).alias("inserted"), F.count_if(F.col("_match")).alias("updated"))


class VersionedTable:
    """Versions of a table under one folder, v0, v1, ...: the largest with a success mark counts."""

    _NAME = re.compile(r"v([0-9]+)(?:-(part|of[0-9]+))?")

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _list(self, path: str) -> list[str]:
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(path)
        fs = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []

    def _folders(self) -> list[tuple[int, str, bool]]:
        """number, name and whether it is whole, of all versions, oldest first."""
        names = [(int(m[1]), n) for n in self._list(self.path) if (m := self._NAME.fullmatch(n))]
        return [(k, n, "_SUCCESS" in self._list(f"{self.path}/{n}")) for k, n in sorted(names)]

    def version(self) -> int | None:
        return max((k for k, _, whole in self._folders() if whole), default=None)

    def _fresh(self, kind: str = "") -> str:
        """The folder of a new version: past every folder that is there, whole or not."""
        return f"{self.path}/v{max((k for k, _, _ in self._folders()), default=-1) + 1}{kind}"

    def _current(self) -> list[tuple[str, str]]:
        """Name and kind of the folders that count: the newest full one, and the parts after it."""
        whole = [(n, self._NAME.fullmatch(n)[2] or "") for _, n, whole in self._folders() if whole]
        first = max((i for i, (_, kind) in enumerate(whole) if kind != "part"), default=None)
        if first is None:
            raise FileNotFoundError(self.path)
        return whole[first:]

    def layout(self) -> dict[int, str]:
        """bucket -> the folder that counts; a table that was written without buckets is one, of number -1."""
        found = {}
        for name, kind in self._current():
            if not kind:
                found[-1] = f"{self.path}/{name}"
            for inner in self._list(f"{self.path}/{name}") if kind else []:
                if inner.startswith("_bucket="):
                    found[int(inner.removeprefix("_bucket="))] = f"{self.path}/{name}/{inner}"
        return found

    def _schema(self):
        return self.spark.read.parquet(f"{self.path}/{self._current()[0][0]}").drop("_bucket").schema

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The whole table, or some of its buckets."""
        paths = [path for b, path in sorted(self.layout().items()) if buckets is None or b in buckets]
        reader = self.spark.read.schema(self._schema())
        return reader.parquet(*paths) if paths else self.spark.createDataFrame([], self._schema())

    def write(self, df: DataFrame) -> DataFrame:
        """A new version, which counts once it is written whole (its success mark)."""
        df.write.parquet(self._fresh())
        return self.read()

    def clear(self) -> list[str]:
        """Removes versions that nothing current needs, and what failed writes left; frames of older versions can no longer be read. Returns the names."""
        current = {self._current()[0][0], *(path.removeprefix(f"{self.path}/").split("/")[0] for path in self.layout().values())}
        gone = [n for _, n, _ in self._folders() if n not in current]
        for n in gone:
            remove_tree(self.spark, f"{self.path}/{n}")
        return gone

    def first_run(self, df: DataFrame, key: list[str]) -> DataFrame:
        return self.write(assert_keys(settle(df, "source"), key))

    def upsert(self, source: DataFrame, key: list[str]) -> DataFrame:
        if self.version() is None:
            return self.first_run(source, key)
        source = settle(source, "source")  # its keys are checked, matched and its rows taken: computed once
        return self.write(merge_upsert(self.read(), source, key))


class BucketedTable(VersionedTable):
    """A table whose rows lie in buckets by a digest of the key, a folder each. A version is full, or a part that replaces some buckets.

    Of each bucket the newest folder counts. An upsert reads and writes the buckets of its source's keys only; the files of
    others stay. ``buckets`` holds for tables that are begun anew; one that is there keeps its own number. Null keys raise.
    """

    def __init__(self, spark: SparkSession, path: str, key: list[str], buckets: int = 64):
        super().__init__(spark, path)
        self.key, self.asked = list(key), buckets
        #: Rows that the last upsert or first run added and replaced.
        self.counts: dict[str, int] = {}

    def buckets(self) -> int:
        kinds = [kind for _, kind in self._current() if kind.startswith("of")] if self.version() is not None else []
        return int(kinds[0].removeprefix("of")) if kinds else self.asked

    def _bucket(self, n: int):
        return F.pmod(F.xxhash64(*(F.col(f"`{k}`").cast("string") for k in self.key)), F.lit(n)).cast("int")

    def _put(self, df: DataFrame, kind: str, buckets: int, touched: int) -> int:
        """Writes rows to the folders of their buckets, several tasks for each; returns how many they are."""
        spread = max(1, -(-int(self.spark.conf.get("spark.sql.shuffle.partitions")) // touched))
        rows = df.withColumn("_bucket", self._bucket(buckets)).repartition("_bucket", F.pmod(F.xxhash64(F.lit("spread"), *self.key), F.lit(spread)))
        seen = Observation()
        rows.observe(seen, F.count(F.lit(1)).alias("rows")).write.partitionBy("_bucket").parquet(self._fresh(kind))
        return seen.get["rows"]

    def write(self, df: DataFrame) -> DataFrame:
        """A full version."""
        rows = self._put(df, f"-of{self.asked}", self.asked, self.asked)
        self.counts = {"inserted": rows, "updated": 0}
        return self.read()

    def touched(self, source: DataFrame) -> list[int]:
        """Buckets that hold keys of the source: at most as many as there are."""
        return sorted(r.b for r in source.select(self._bucket(self.buckets()).alias("b")).distinct().collect())

    def upsert(self, source: DataFrame, key: list[str] | None = None, newest: list[str] | None = None) -> DataFrame:
        """Rows of the source replace those of equal key or are added. With ``newest``, a row replaces another only if these columns, compared in order, are larger."""
        if self.version() is None:
            return self.first_run(source, self.key)
        layout = self.layout()
        if -1 in layout:  # written without buckets, by an older run: from now on it has them
            self.write(self.spark.read.parquet(layout[-1]))
        source = assert_keys(settle(source, "source"), self.key)
        buckets = self.touched(source)
        if not buckets:
            self.counts = {"inserted": 0, "updated": 0}
            return self.read()
        held = self.read(buckets)
        if newest:
            before = held.select(*self.key, F.struct(*newest).alias("_held"))
            source = source.join(before, self.key, "left").where(F.col("_held").isNull() | (F.struct(*newest) > F.col("_held"))).drop("_held")
            source = settle(source, "source")
        merged = held.join(source.select(*self.key), self.key, "left_anti").select(*held.columns).unionByName(source.select(*held.columns))
        old, new = held.count(), source.count()  # both are files: counts are in their footers
        now = self._put(merged, "-part", self.buckets(), len(buckets))
        self.counts = {"inserted": now - old, "updated": new - (now - old)}
        return self.read()
