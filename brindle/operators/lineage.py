"""Closure, layers and cycles of an edge table, by joins whose steps are written one by one.

The closure doubles: after k rounds it knows all nodes nearer than 2 ** k, by jumps of 2 ** k edges at once. Jumps are made
longer only while they stay few (``GROWTH`` times the edges, from counts before they are made): the closure of a graph in
which many nodes meet goes on by jumps of the length reached, so that no round makes pairs of all with all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.sources.shared import settle, settle_counted

#: Jumps of twice the length are made if there are at most so many for each edge (or so many in all).
GROWTH, FEW = 4, 100_000
#: Members of cycles that an error names.
NAMED = 1000


def _advance(seen: DataFrame, jumps: DataFrame, length: int, known: int) -> tuple[DataFrame, int]:
    """Adds what one jump reaches from nodes at distances known - length and more; every node with its smallest distance, and how many they are."""
    last = seen.where(F.col("depth") >= known - length)
    reached = last.join(jumps, "node").select(F.col("next").alias("node"), (F.col("depth") + length).alias("depth"))
    return settle_counted(seen.unionByName(reached).groupBy("node").agg(F.min("depth").alias("depth")), "closure")


def _twice(jumps: DataFrame, most: int) -> tuple[DataFrame | None, int]:
    """Jumps of twice the length and how many they are, or None if they are more than ``most``."""
    out = jumps.groupBy("node").agg(F.count(F.lit(1)).cast("double").alias("o"))
    into = jumps.groupBy(F.col("next").alias("node")).agg(F.count(F.lit(1)).cast("double").alias("i"))
    walks = out.join(into, "node").agg(F.coalesce(F.sum(F.col("o") * F.col("i")), F.lit(0.0)).alias("n")).first().n
    if walks > most:
        return None, 0
    on = jumps.select(F.col("node").alias("next"), F.col("next").alias("further"))
    return settle_counted(jumps.join(on, "next").select("node", F.col("further").alias("next")).distinct(), "jumps")


def closure(edges: DataFrame, start: DataFrame, direction: str = "down") -> DataFrame:
    """edges: parent, child; start: node. Nodes reachable from the start (itself included), with their distance. Cycles are no harm.

    Rounds are about the logarithm of the largest distance where jumps stay few.
    """
    if direction == "both":
        up, down = closure(edges, start, "up"), closure(edges, start, "down")
        return up.unionByName(down).groupBy("node").agg(F.min("depth").alias("depth"))
    a, b = ("parent", "child") if direction == "down" else ("child", "parent")
    jumps, count = settle_counted(edges.select(F.col(a).alias("node"), F.col(b).alias("next")).where("node IS NOT NULL AND next IS NOT NULL").distinct(), "jumps")
    most = max(FEW, GROWTH * count)
    seen, found = settle_counted(start.select("node").distinct().withColumn("depth", F.lit(0)), "closure")
    length, known, doubling = 1, 1, True
    while count:
        seen, now = _advance(seen, jumps, length, known)
        known += length
        if now == found:
            break
        found = now
        longer, many = _twice(jumps, most) if doubling else (None, 0)
        doubling = longer is not None
        if doubling:
            jumps, count, length = longer, many, 2 * length  # none: no path is that long
    return seen


def layers(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, layer: all parents of a node are in lower layers. A cycle raises ValueError that names its members, and no other node.

    A layer is what has no parents left; each step takes their edges away by counting, for each child, how many of its parents are done.
    """
    done, left, links = _peel(edges, nodes)
    if left is not None:
        members = cycles(links.join(left.select(F.col("node").alias("child")), "child", "left_semi")).orderBy("component", "node")
        shown = [r.node for r in members.limit(NAMED + 1).collect()]
        raise ValueError(f"the edges have a cycle among {shown[:NAMED]}{' and more' if len(shown) > NAMED else ''}")
    return done


def load_layers(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, layer: an order in which to load tables, by layer and then by name; parents come first. A reference of a table to itself
    does not count, and if there is a cycle all stand in layer 0: the order is that of names."""
    done, left, _ = _peel(edges.where("NOT (parent <=> child)"), nodes)
    return done if left is None else nodes.select("node").distinct().withColumn("layer", F.lit(0))


def _peel(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """Nodes in layers, those that no layer takes (None if there are none), and the edges among the nodes."""
    every = settle(nodes.select("node").distinct(), "layers")
    links = edges.select("parent", "child").distinct().join(every.withColumnRenamed("node", "parent"), "parent", "left_semi")
    links = settle(links.join(every.withColumnRenamed("node", "child"), "child", "left_semi"), "links")
    needs = links.groupBy(F.col("child").alias("node")).agg(F.count(F.lit(1)).alias("needs"))
    left = settle(every.join(needs, "node", "left").select("node", F.coalesce("needs", F.lit(0).cast("long")).alias("needs")), "left")
    done, layer = None, 0
    while left.take(1):
        free = settle(left.where("needs = 0").select("node", F.lit(layer).alias("layer")), "layers")
        if not free.take(1):
            return done, left, links
        done = free if done is None else done.unionByName(free)
        met = links.join(free.select(F.col("node").alias("parent")), "parent").groupBy(F.col("child").alias("node")).agg(F.count(F.lit(1)).alias("met"))
        left = settle(left.where("needs > 0").join(met, "node", "left").select("node", (F.col("needs") - F.coalesce("met", F.lit(0).cast("long"))).alias("needs")), "left")
        layer += 1
    return done if done is not None else every.withColumn("layer", F.lit(0)).limit(0), None, links


def _trimmed(links: DataFrame) -> DataFrame:
    """Without edges whose parent has no parent or whose child has no child, over and over: none of them is on a cycle."""
    count = links.count()
    while count:
        inner = links.join(links.select(F.col("child").alias("parent")).distinct(), "parent", "left_semi")
        inner = settle(inner.join(links.select(F.col("parent").alias("child")).distinct(), "child", "left_semi").select("parent", "child"), "trimmed")
        left = inner.count()
        if left == count:
            return inner
        links, count = inner, left
    return links


def _coloured(links: DataFrame) -> DataFrame:
    """node, colour: the largest node from which a path leads to the node."""
    nodes = links.select(F.col("parent").alias("node")).union(links.select("child")).distinct()
    colours = settle(nodes.select("node", F.col("node").alias("colour"), F.lit(True).alias("new")), "colours")
    while colours.where("new").take(1):
        given = links.join(colours.where("new").select(F.col("node").alias("parent"), "colour"), "parent").groupBy(F.col("child").alias("node")).agg(F.max("colour").alias("given"))
        larger = F.col("given").isNotNull() & (F.col("given") > F.col("colour"))
        colours = settle(colours.join(given, "node", "left").select("node", F.when(larger, F.col("given")).otherwise(F.col("colour")).alias("colour"), larger.alias("new")), "colours")
    return colours.select("node", "colour")


def cycles(edges: DataFrame) -> DataFrame:
    """node, component (its smallest member): nodes that are on a cycle, by strongly connected component; a node with an edge to itself is one.

    Edges are trimmed from both ends; then each node takes the largest node that reaches it as its colour, and what of a colour reaches
    back to the node that gave it is one component. Components are taken out, edges between colours fall away, and the rest starts over.
    """
    links = settle(edges.select("parent", "child").where("parent IS NOT NULL AND child IS NOT NULL").distinct(), "links")
    alone = links.where("parent = child").select(F.col("parent").alias("node"), F.col("parent").alias("root"))
    links, found = _trimmed(links.where("parent <> child")), None
    while links.take(1):
        colours = _coloured(links)
        same = links.join(colours.select(F.col("node").alias("parent"), "colour"), "parent").join(colours.select(F.col("node").alias("child"), F.col("colour").alias("_c")), "child")
        same = settle(same.where("colour = _c").select("parent", "child", "colour"), "same")
        back = settle(colours.where("node = colour").select("node", F.col("colour").alias("root")), "back")
        front = back
        while front.take(1):
            step = same.join(front.select(F.col("node").alias("child"), F.col("root").alias("colour")), ["child", "colour"]).select(F.col("parent").alias("node"), F.col("colour").alias("root")).distinct()
            front = settle(step.join(back, ["node", "root"], "left_anti"), "front")
            back = back.unionByName(front)
        back = settle(back, "back")
        found = back if found is None else found.unionByName(back)
        rest = same.join(back.select(F.col("node").alias("parent")), "parent", "left_anti").join(back.select(F.col("node").alias("child")), "child", "left_anti")
        links = _trimmed(settle(rest.select("parent", "child"), "links"))
    members = alone if found is None else found.unionByName(alone.join(found.select("node"), "node", "left_anti"))
    sizes = members.groupBy("root").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("component"))
    real = sizes.join(alone.select("root", F.lit(True).alias("own")), "root", "left").where("size > 1 OR own").select("root", "component")
    return members.join(real, "root").select("node", "component")
