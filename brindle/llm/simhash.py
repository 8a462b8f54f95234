"""SimHash near-duplicates by a hierarchical index in Gray order.

Fingerprints that differ in at most ``max_bits`` bits link. The 64 bits are cut into max_bits + t blocks;
two fingerprints that link agree on t blocks at least, so every choice of t blocks is an upper node's mask
and the bits under it are its pattern: a fingerprint is filed under one upper node for each choice. Under
an upper node fingerprints are sorted by Gray rank and grouped by eights, level over level; each group
keeps the bits on which all below it agree (mask) and their values (pattern). Two groups are compared by
the bits fixed in both: the differences seen so far only grow on the way down, so a pair of groups whose
differences exceed the limit is pruned whole. ``t`` follows from the number of distinct fingerprints (a
finer mask for more of them) and changes no result.

Equal fingerprints are one entry. Spark sorts all entries by (upper node, Gray rank) over ranges, so that a
large node lies in many tasks. Runs of at most ``NODE`` entries of one node are chunks: each is compared
within itself where it is sorted. Nodes of several chunks go on: a chunk is a group with its own mask and
pattern, and only those pairs of chunks are dealt whose differences so far stay within the limit. Of all
links under a node only spanning forests are passed on: at most one row an entry and task. Components are then found by alternating large-star and small-star steps,
written between steps. Nothing but counts reaches the driver.

A null text has no words: fingerprint zero. A null doc_id is in its component but never its name, unless
all are null. Repeated rows share a component. An empty table gives no rows.
Texts of any length give the fingerprint of all their words. Of other columns only ``keep_one`` passes any on: all but those of its own
names (``s_row``, ``s_fp``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import settle, without

SHINGLE = 4
SEED = 42
MAX_BITS = 4
#: Entries of one upper node that lie together in a chunk.
NODE = 2048
#: Entries whose groups are built together.
ROWS = 1 << 16
#: Parts in which the members of a component look up its name.
SALTS = 32
#: Pairs of groups held at a time.
PAIRS = 1 << 20
#: Wished entries of an average upper node.
ENTRIES = 256
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    import xxhash

    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
    if not words:
        return 0
    whole, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends)]
    last = max(1, len(words) - shingle + 1)
    ends = ends[min(shingle, len(words)) - 1 :]
    h64, count = xxhash.xxh64_intdigest, np.zeros(64, "i8")
    for k in range(0, last, 1 << 15):
        h = np.array([h64(whole[a:b], SEED) for a, b in zip(starts[k : min(last, k + (1 << 15))], ends[k:], strict=False)], "<u8")
        count += np.unpackbits(h.view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype="i8")
    return int(np.packbits(2 * count > last, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """key, fp (the 64 bits as a long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], "u8").view("i8")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["key", "fp"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, fp long")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in the reflected Gray sequence."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def masks(max_bits: int, t: int) -> list[int]:
    """The masks of upper nodes: all choices of t of max_bits + t blocks of bits."""
    edges = np.linspace(0, 64, max_bits + t + 1).round().astype(int).tolist()
    blocks = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(chosen) for chosen in combinations(blocks, t)]


def linked_pairs(node: np.ndarray, fps: np.ndarray, max_bits: int, sides: np.ndarray | None = None, fixed: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, places) of entries of one node that link, in bounded portions; entries are sorted by (node, Gray rank).

    With ``sides``, pairs of equal side are left out (they are another task's). With ``fixed``, entries are groups
    themselves: patterns of which these bits are fixed.
    """
    # levels[0] are the entries; a group of a level holds up to eight of the level below, of one node
    levels = [(node, fps, np.full(len(fps), ~np.uint64(0)) if fixed is None else fixed, np.arange(len(fps)), np.arange(len(fps)) + 1)]
    while True:
        own, pattern, mask, _, _ = levels[-1]
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        if len(first) == len(own):
            break
        inside = np.arange(len(own)) - np.repeat(first, np.diff(np.r_[first, len(own)]))
        start = np.flatnonzero(inside % 8 == 0)
        all_of, any_of = np.bitwise_and.reduceat(pattern, start), np.bitwise_or.reduceat(pattern, start)
        agreed = np.bitwise_and.reduceat(mask, start) & ~(all_of ^ any_of)  # fixed in all below, and of one value
        levels.append((own[start], all_of & agreed, agreed, start, np.r_[start[1:], len(own)]))
    top = len(levels) - 1
    every = np.arange(len(levels[top][0]))
    stack = [(top, every, every)]
    while stack:
        level, a, b = stack.pop()
        _, pattern, mask, low, high = levels[level]
        near = np.bitwise_count((pattern[a] ^ pattern[b]) & mask[a] & mask[b]) <= max_bits
        a, b = a[near], b[near]
        if level == 0:
            if sides is not None:
                other = sides[a] != sides[b]
                a, b = a[other], b[other]
            if len(a):
                yield a, b
            continue
        some = PAIRS // 64  # a pair of groups has 64 pairs below it at most
        if len(a) > some:
            stack.append((level, a[some:], b[some:]))
            a, b = a[:some], b[:some]
        na, nb = high[a] - low[a], high[b] - low[b]
        n = na * nb
        which = np.repeat(np.arange(len(a)), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        p, q = low[a][which] + at // nb[which], low[b][which] + at % nb[which]
        keep = (p < q) | ((p == q) & (level > 1))
        stack.append((level - 1, p[keep], q[keep]))


def forest(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray) -> np.ndarray:
    """label[i]: the smallest place reachable; joins what the pairs link, in place."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        x, y = x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up
        a, b = a[apart], b[apart]


def _rank(fp):
    """Gray rank as a column that sorts like an unsigned number."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp.bitwiseXOR(F.lit(-(1 << 63)).cast("long"))


def links(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """distinct: fp (no repeats, settled). Returns u, v (u > v): enough links to connect all that link."""
    spark = distinct.sparkSession
    n = distinct.count()
    t = 1
    while t < 4 and n >> (64 * t // (max_bits + t)) > ENTRIES:
        t += 1
    signed = [m - (1 << 64) if m >> 63 else m for m in masks(max_bits, t)]
    ranked = distinct.select("fp", _rank(F.col("fp")).alias("rank"))
    under = ranked.select("fp", "rank", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in signed))).alias("mask", "pattern"))
    parts, most = int(spark.conf.get("spark.sql.shuffle.partitions")), NODE
    order = ["mask", "pattern", "rank"]
    rows = under.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("mask", "pattern", "fp")
    filed = settle(rows.mapInArrow(lambda batches: _file(batches, max_bits, most), "u long, v long, mask int, pattern long, chunk long"), "filed")
    entries = filed.where(F.col("chunk").isNotNull())
    pairs = settle(near_chunks(entries, max_bits, parts), "pairs")
    dealt = pairs.select("i", "j", F.explode(F.array("i", "j")).alias("chunk")).join(entries.select("chunk", F.col("u").alias("fp")), "chunk")
    dealt = dealt.repartition(parts, "i", "j").sortWithinPartitions("i", "j").select("i", "j", "chunk", "fp")
    between = dealt.mapInArrow(lambda batches: _whole_nodes(batches, ("i", "j"), lambda table: _between(table, max_bits)), "u long, v long")
    return filed.where(F.col("chunk").isNull()).select("u", "v").unionByName(between).distinct()


def near_chunks(entries: DataFrame, max_bits: int, parts: int) -> DataFrame:
    """i, j (i < j): chunks of one upper node that may hold a link, by the bits on which each chunk agrees.

    One task holds the chunks of a node, a row each, not their entries.
    """
    every, some = F.bit_and("u"), F.bit_or("u")
    chunks = entries.groupBy("mask", "pattern", "chunk").agg(every.alias("every"), F.bitwise_not(every.bitwiseXOR(some)).alias("fixed"))
    chunks = chunks.repartition(parts, "mask", "pattern").sortWithinPartitions("mask", "pattern", "chunk")

    def near(table: pa.Table) -> Iterator[pa.RecordBatch]:
        node = np.cumsum(np.r_[0, _changes(table, ("mask", "pattern"))])
        chunk, fixed = table.column("chunk").to_numpy(), table.column("fixed").to_numpy().view("u8")
        for a, b in linked_pairs(node, table.column("every").to_numpy().view("u8") & fixed, max_bits, fixed=fixed):
            yield pa.RecordBatch.from_arrays([pa.array(chunk[a]), pa.array(chunk[b])], names=["i", "j"])

    return chunks.mapInArrow(lambda batches: _whole_nodes(batches, ("mask", "pattern"), near), "i long, j long")


def _changes(table: pa.Table, key: tuple[str, ...]) -> np.ndarray:
    """Whether each row but the first begins another node."""
    new = np.zeros(max(0, table.num_rows - 1), bool)
    for name in key:
        x = table.column(name).to_numpy()
        new |= x[1:] != x[:-1]
    return new


def _last_node(table: pa.Table, key: tuple[str, ...]) -> int:
    """Where the last node of a sorted table begins."""
    at = np.flatnonzero(_changes(table, key))
    return int(at[-1]) + 1 if len(at) else 0


def _whole_nodes(batches: Iterator[pa.RecordBatch], key: tuple[str, ...], work: Callable[[pa.Table], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """Passes sorted rows on in tables of many nodes, none of them cut."""
    held: list[pa.Table] = []
    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        if sum(x.num_rows for x in held) >= ROWS:
            table = pa.concat_tables(held).combine_chunks()
            cut = _last_node(table, key)
            if cut:
                yield from work(table.slice(0, cut))
            held = [table.slice(cut)]
    if held and (table := pa.concat_tables(held).combine_chunks()).num_rows:
        yield from work(table)


def _file(batches: Iterator[pa.RecordBatch], max_bits: int, most: int) -> Iterator[pa.RecordBatch]:
    """Cuts sorted entries into chunks of at most ``most``. Gives the links within each (u, v) and the entries (as u) of chunks whose node has others, or may have in other tasks."""
    from pyspark import TaskContext

    chunk = TaskContext.get().partitionId() << 33
    key = ("mask", "pattern")
    held: list[pa.Table] = []
    begun = True  # the first node may have begun before these rows

    def cut_into_chunks(table: pa.Table, goes_on: bool) -> Iterator[pa.RecordBatch]:
        nonlocal chunk
        first = np.r_[0, np.flatnonzero(_changes(table, key)) + 1]
        size = np.diff(np.r_[first, table.num_rows])
        inside = np.arange(table.num_rows) - np.repeat(first, size)
        own = np.cumsum(inside % most == 0) - 1
        open_node = size > most
        open_node[0] |= begun
        open_node[-1] |= goes_on
        fps = table.column("fp").to_numpy()
        u, v = _forest(own, fps.view("u8"), linked_pairs(own, fps.view("u8"), max_bits))
        kept = np.flatnonzero(np.repeat(open_node, size))
        none = lambda n, kind: pa.nulls(n, kind)
        names = ["u", "v", "mask", "pattern", "chunk"]
        yield pa.RecordBatch.from_arrays([u, v, none(len(u), pa.int32()), none(len(u), pa.int64()), none(len(u), pa.int64())], names=names)
        some = table.take(pa.array(kept)).combine_chunks()
        columns = [pa.array(fps[kept]), none(len(kept), pa.int64()), pa.array(some.column("mask").to_numpy()), pa.array(some.column("pattern").to_numpy()), pa.array(own[kept] + chunk)]
        yield pa.RecordBatch.from_arrays(columns, names=names)
        chunk += int(own[-1]) + 1

    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        if sum(x.num_rows for x in held) >= ROWS + most:
            table = pa.concat_tables(held).combine_chunks()
            start = _last_node(table, key)
            cut = start + (table.num_rows - start - 1) // most * most  # whole chunks of the last node, which goes on
            if cut:
                yield from cut_into_chunks(table.slice(0, cut), cut > start)
                begun = cut > start
            held = [table.slice(cut)]
    if held and (table := pa.concat_tables(held).combine_chunks()).num_rows:
        yield from cut_into_chunks(table, True)


def _forest(node: np.ndarray, fps: np.ndarray, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[pa.Array, pa.Array]:
    """u, v (u > v): a spanning forest of the linked pairs."""
    label = np.arange(len(fps))
    for a, b in pairs:
        forest(len(fps), a, b, label)
    below = np.flatnonzero(label != np.arange(len(fps)))
    x, y = fps[below].view("i8"), fps[label[below]].view("i8")
    return pa.array(np.maximum(x, y)), pa.array(np.minimum(x, y))


def _between(table: pa.Table, max_bits: int) -> Iterator[pa.RecordBatch]:
    """Links between the two chunks of each pair."""
    node = np.cumsum(np.r_[0, _changes(table, ("i", "j"))])
    fps, chunk = table.column("fp").to_numpy().view("u8"), table.column("chunk").to_numpy()
    order = np.lexsort((gray_rank(fps), node))
    node, fps, chunk = node[order], fps[order], chunk[order]
    u, v = _forest(node, fps, linked_pairs(node, fps, max_bits, sides=chunk))
    yield pa.RecordBatch.from_arrays([u, v], names=["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """edges: u, v (u > v, no repeats). Returns node, root (the smallest reachable) for nodes that have an edge and aren't roots."""

    def both(e: DataFrame) -> DataFrame:
        return e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))

    def with_least(e: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The edges with the smallest neighbour of u, and (u, m) itself. The edges of a u are spread by a salt of v, and its smallest neighbour
        stands once for each salt that it has: the hub of a large component is many tasks' work."""
        e = e.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
        per_salt = e.groupBy("u", "salt").agg(F.min("v").alias("m"))
        least = per_salt.groupBy("u").agg(F.min("m").alias("m"), F.collect_list("salt").alias("salts"))
        return e.join(least.select("u", "m", F.explode("salts").alias("salt")), ["u", "salt"]), least.select("u", "m")

    def large_star(e: DataFrame) -> DataFrame:
        near, _ = with_least(both(e))
        return near.where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u > v").distinct()

    def small_star(e: DataFrame) -> DataFrame:
        near, least = with_least(e)
        down = near.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return least.select("u", F.col("m").alias("v")).unionByName(down).distinct()

    state = lambda e: e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    edges = settle(edges, "edges")
    before = state(edges)
    while before[0]:
        edges = settle(small_star(large_star(edges)), "edges")
        now = state(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def name_components(rows: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """rows: key, fp (settled). Returns fp, root (one fp of the component), component (its smallest key)."""
    distinct = settle(rows.groupBy("fp").agg(F.min("key").alias("key")), "distinct")
    roots = components(links(distinct.select("fp"), max_bits)).withColumnRenamed("node", "fp")
    named = distinct.join(roots, "fp", "left").withColumn("joined", F.col("root").isNotNull()).withColumn("root", F.coalesce("root", "fp"))
    named = settle(named, "named")
    # only roots that others joined need a name from elsewhere; each is there once for every salt, as a component may be large
    members = named.where("joined")
    names = members.groupBy("root").agg(F.min("key").alias("least"))
    own = named.where(~F.col("joined")).join(names, "root", "left").withColumn("component", F.coalesce(F.least("key", "least"), "key", "least"))
    own = settle(own.select("fp", "root", "component", F.col("least").isNotNull().alias("large")), "roots")
    salts = own.where("large").select("root", "component", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    spread = members.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int")).join(salts, ["root", "salt"])
    return settle(own.select("fp", "root", "component").unionByName(spread.select("fp", "root", "component")), "components")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """A row per row of ``docs``: key, fp, component (the smallest key reachable)."""
    rows = settle(fingerprints(docs, key, text, shingle), "fingerprints")
    return rows.join(name_components(rows, max_bits), "fp").select("key", "fp", "component")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs``, all columns, that stand for their components: of each the smallest key, nulls last, of repeated rows one."""
    docs = without(docs, ["s_row", "s_fp"])
    column = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in batch.column(column).to_pylist()], "u8").view("i8")
            yield from pa.Table.from_batches([batch]).append_column("s_row", pa.array(np.arange(row, row + batch.num_rows))).append_column("s_fp", pa.array(fps)).to_batches()
            row += batch.num_rows

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    own = settle(docs.mapInArrow(run, f"{kept}, s_row long, s_fp long"), "fingerprints")
    rows = own.select(F.col(key).alias("key"), F.col("s_fp").alias("fp"), "s_row")
    named = rows.join(name_components(rows.select("key", "fp"), max_bits).select("fp", "root"), "fp")
    best = named.groupBy("root").agg(F.min(F.struct(F.col("key").isNull(), "key", "s_row")).alias("best"))
    # most rows are kept, so what names them grows with the corpus: never broadcast, one plan at every size
    kept_rows = best.select(F.col("best.s_row").alias("s_row")).hint("merge")
    return own.join(kept_rows, "s_row", "left_semi").drop("s_row", "s_fp")


def op3_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = near_duplicates(docs)
    return found.select(F.col("key").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
