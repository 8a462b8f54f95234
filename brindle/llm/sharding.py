"""K-d tree sharding. DataFrame functions only.

Documents of equal text stay together: they form a group, weighted by its bytes. The root holds all
groups and is to give ``shards`` leaves; a node that is to give k is split along its widest metadata
dimension (the extent in the node over the extent in the root) at the weighted quantile floor(k/2)/k,
until a node is to give one: its bytes have then reached the target, total / shards, to within about a
group. All nodes of a level are split together. Quantiles are found by histograms of ``2 ** BITS`` bins,
refined bin in bin until a bin is one coordinate, so no node is gathered or sorted; a coordinate ends in
bits of the text's digest, so that many equal values can be split between groups.

Dimensions are the size of the text and any columns; a column's place is a digest of its value, that of
a group the smallest of its rows. The law is ``bytes``. A null text has no bytes and size 1; a null
value of a column has place 0; repeated rows are rows of one group. An empty table gives no rows.
Texts of any length weigh by all their bytes; a text longer than a shard's target is a group that no cut parts. Only the key, the text and the
dimensions are read: other columns may have any name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brindle.llm.common import settle

#: Bits of a coordinate that one histogram resolves; four of them make up the 60 bits of a coordinate.
BITS, PASSES = 15, 4
#: Bits of a place and of the digest after it.
PLACE, TAIL = 31, 28


def _digest_bits(column):
    return F.conv(F.substring(F.md5(column), 1, 7), 16, 10).cast("long")


def _split_level(groups: DataFrame, extents: list[int], names: list[str]) -> DataFrame:
    """One row for each node of more than one shard: node, dim, cut (groups at or under it go left), k, first."""
    spans = [(F.max(n) - F.min(n)).alias(f"w_{n}") for n in names]
    stats = groups.where("k > 1").groupBy("node", "k", "first").agg(F.sum("bytes").alias("total"), *spans)
    share = [F.col(f"w_{n}") / F.lit(e) if e else F.lit(0.0) for n, e in zip(names, extents, strict=True)]
    widest = F.greatest(*share) if len(share) > 1 else share[0]
    dim = reduce(lambda rest, i: F.when(share[i] == widest, F.lit(i)).otherwise(rest), reversed(range(len(names))), F.lit(0))
    nodes = settle(stats.select("node", "k", "first", "total", dim.alias("dim"), F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("before"), F.lit(0).cast("long").alias("weight")), "nodes")
    place = reduce(lambda rest, i: F.when(F.col("dim") == i, F.col(names[i])).otherwise(rest), range(1, len(names)), F.col(names[0]))
    for p in range(PASSES):
        shift = BITS * (PASSES - 1 - p)
        at = groups.select("node", "bytes", "tail", *names).join(nodes, "node").withColumn("u", F.shiftleft(place, TAIL) + F.col("tail"))
        inside = at.where(F.shiftright("u", shift + BITS) == F.shiftright("low", shift + BITS)) if p else at
        bins = inside.groupBy("node", F.shiftright("u", shift).alias("bin")).agg(F.sum("bytes").alias("own"))
        # at most 2 ** BITS rows a node
        up_to = Window.partitionBy("node").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        sums = bins.join(nodes, "node").withColumn("upto", F.col("before") + F.sum("own").over(up_to))
        reached = sums.where(F.col("k") * F.col("upto") >= F.floor(F.col("k") / 2) * F.col("total"))
        found = reached.groupBy("node").agg(F.min_by(F.struct("bin", "own", "upto"), "bin").alias("f"))
        nodes = settle(nodes.join(found, "node").select("node", "k", "first", "total", "dim", F.shiftleft("f.bin", shift).alias("low"), (F.col("f.upto") - F.col("f.own")).alias("before"), F.col("f.own").alias("weight")), "nodes")
    nearer_left = F.col("k") * (2 * F.col("before") + F.col("weight")) <= 2 * F.floor(F.col("k") / 2) * F.col("total")
    return nodes.select("node", "dim", F.when(nearer_left, F.col("low")).otherwise(F.col("low") - 1).alias("cut"))


def kd_shards(docs: DataFrame, shards: int, dimensions: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per row of ``docs``: key, size, text_crc32, shard and slot (gapless from 0 in each shard)."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    size = (F.octet_length(t) + 1).cast("long")
    places = {f"d{i}": F.coalesce(_digest_bits(F.col(c).cast("string")), F.lit(0).cast("long")) for i, c in enumerate(dimensions)}
    rows = settle(docs.select(F.col(key).alias("key"), size.alias("size"), F.crc32(t).alias("text_crc32"), F.md5(t).alias("digest"), *(v.alias(n) for n, v in places.items())), "rows")
    names = ["d_size", *places]
    groups = rows.groupBy("digest").agg(F.sum("size").alias("bytes"), F.least(F.min("size"), F.lit((1 << PLACE) - 1)).alias("d_size"), *(F.min(n).alias(n) for n in places))
    tail = F.conv(F.substring("digest", 1, 7), 16, 10).cast("long")
    groups = settle(groups.select("digest", "bytes", *names, tail.alias("tail"), F.lit(1).cast("long").alias("node"), F.lit(shards).cast("long").alias("k"), F.lit(0).cast("long").alias("first")), "groups")
    extents = [e or 0 for e in groups.agg(*(F.max(n) - F.min(n) for n in names)).first()]  # a number for each dimension
    place = reduce(lambda rest, i: F.when(F.col("dim") == i, F.col(names[i])).otherwise(rest), range(1, len(names)), F.col(names[0]))
    for _ in range(max(0, shards - 1).bit_length()):
        cuts = _split_level(groups, extents, names)
        left = F.shiftleft(place, TAIL) + F.col("tail") <= F.col("cut")
        half = F.floor(F.col("k") / 2)
        moved = groups.join(cuts, "node", "left").select(
            "digest", "bytes", *names, "tail",
            F.when(F.col("cut").isNull(), F.col("node") * 2).when(left, F.col("node") * 2).otherwise(F.col("node") * 2 + 1).alias("node"),
            F.when(F.col("cut").isNull(), F.col("k")).when(left, half).otherwise(F.col("k") - half).alias("k"),
            F.when(F.col("cut").isNull() | left, F.col("first")).otherwise(F.col("first") + half).alias("first"),
        )
        groups = settle(moved, "groups")
    placed = rows.join(groups.select("digest", F.col("first").cast("int").alias("shard")), "digest")
    return _slots(settle(placed.select("key", "size", "text_crc32", "digest", "shard", F.md5(F.coalesce(F.col("key").cast("string"), F.lit(""))).alias("order")), "placed"))


def _slots(placed: DataFrame) -> DataFrame:
    """Numbers each shard's rows in the order of a digest of the key: within leading digits of it, then summed over them."""
    own = placed.withColumn("lead", F.substring("order", 1, 3))
    counts = own.groupBy("shard", "lead").agg(F.count(F.lit(1)).alias("n"))  # at most 4096 a shard
    before = Window.partitionBy("shard").orderBy("lead").rowsBetween(Window.unboundedPreceding, -1)
    starts = settle(counts.select("shard", "lead", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")), "starts")
    within = Window.partitionBy("shard", "lead").orderBy("order", "key", "size", "text_crc32", "digest")
    return own.withColumn("nth", F.row_number().over(within)).join(starts, ["shard", "lead"]).select("key", "size", "text_crc32", "shard", (F.col("start") + F.col("nth") - 1).alias("slot"))


def op6_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    return kd_shards(docs, 8, ["lang", "source"]).select(F.col("key").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
