"""Best-fit packing by minimum bin slack.

Sequences are filled one after the other. The longest piece that is left opens a sequence; a subset
sum over the lengths that are left, kept in the bits of one integer, finds the fullest feasible rest,
and what it takes is removed. Lengths are at most the capacity, so all that the choice depends on is
how many pieces of each length there are: at most ``capacity`` counts, whatever the corpus. Where the
same combination stays feasible, it is taken as often as the counts allow in one step, which is what
single steps would do. The plan is a table of (length, ranks from .. to) -> (sequence, offset); pieces
get their rank within their length from per-task counts and a prefix sum, so no group is collected.

A null or empty text is the end id alone. Repeated rows are packed once each. An empty table gives no
rows. Texts of any length are encoded whole and cut into pieces. Only the key and the text are read: other columns may have any name. Which of several pieces of equal length goes where follows the order of the input files.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brindle.llm.common import settle
from brindle.llm.tokens import encoder

PIECE = "doc_id long, piece int, start long, length long, ids binary"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids: only one over capacity is cut, and only its first piece may be shorter."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """Length -> times, of the available lengths, whose sum is the largest of at most ``room``."""
    mask, reach, steps = (1 << room + 1) - 1, 1, []
    for length in sorted((x for x, n in counts.items() if n and x <= room), reverse=True):
        left, times = min(counts[length], room // length), 1
        while left and not reach >> room & 1:
            times = min(times, left)
            steps.append((reach, length, times))
            reach |= reach << length * times & mask
            left, times = left - times, times * 2
        if reach >> room & 1:
            break
    total, taken = reach.bit_length() - 1, Counter()
    for before, length, times in reversed(steps):
        if not before >> total & 1:
            taken[length] += times
            total -= length * times
    return dict(taken)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int]]:
    """(length, first rank, first sequence, offset) for runs of ranks; a run ends where the next of its length begins."""
    left, used, runs, sequence = {k: n for k, n in counts.items() if n}, Counter(), [], 0
    while left:
        longest = max(left)
        left[longest] -= 1
        taken = Counter(fullest(left, capacity - longest))
        left[longest] += 1
        taken[longest] += 1
        times = min(left[k] // n for k, n in taken.items())
        offset = 0
        for length in sorted(taken, reverse=True):
            for _ in range(taken[length]):
                runs.append((length, used[length], sequence, offset))
                used[length] += times
                offset += length
            left[length] -= taken[length] * times
            if not left[length]:
                del left[length]
        sequence += times
    return sorted(runs)


def pieces_of(docs: DataFrame, tokenizer: str, word_ends: bool, end_id: int, capacity: int, key: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """Encode, append ``end_id`` and cut: a row per piece, with its rank among the pieces of its length in its task."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen, end = TaskContext.get().partitionId(), Counter(), np.asarray([end_id], "<u4").tobytes()
        enc = encoder(tokenizer, word_ends)
        for batch in batches:
            rows = []
            for k, own in zip(batch.column(0).to_pylist(), enc.encode_many(batch.column(1).to_pylist()), strict=True):
                ids = own + end
                for i, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    piece = ids[4 * start : 4 * (start + length)]
                    rows.append((k, i, start, length, piece if with_ids else None, zlib.crc32(piece), part, seen[length]))
                    seen[length] += 1
            columns = list(zip(*rows, strict=True)) or [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids", "ids_crc32", "part", "nth"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(encode, PIECE + ", ids_crc32 long, part long, nth long")


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces (from ``pieces_of``, settled).

    What reaches the driver is one count for each length: at most ``capacity`` rows.
    """
    by_task = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = by_task.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = np.array(plan(counts, capacity), "i8").reshape(-1, 4)
    # runs of length L are those from runs_at[L] to runs_at[L + 1]
    runs_at = np.searchsorted(runs[:, 0], np.arange(capacity + 2))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.zeros(len(length), "i8")
            for x in np.unique(length):
                own = length == x
                low = runs_at[x]
                at[own] = low + np.searchsorted(runs[low : runs_at[x + 1], 1], rank[own], "right") - 1
            out = pa.Table.from_batches([batch]).drop_columns(["rank"])
            out = out.append_column("sequence_id", pa.array(runs[at, 2] + rank - runs[at, 1])).append_column("offset", pa.array(runs[at, 3]))
            yield from out.to_batches()

    ranked = pieces.join(first, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids", "ids_crc32", (F.col("nth") + F.col("first")).alias("rank"))
    return ranked.mapInArrow(place, PIECE + ", ids_crc32 long, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves: ids of the pieces in their order, with where each begins. A sequence has at most ``capacity`` ids."""
    inside = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))
    return packed.groupBy("sequence_id").agg(inside.alias("p")).select("sequence_id", F.expr("aggregate(p, cast('' as binary), (a, x) -> concat(a, x.ids))").alias("ids"), F.col("p.offset").alias("offsets"), F.col("p.doc_id").alias("doc_ids"))


def op4_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def pack_documents(docs: DataFrame, capacity: int = 1024) -> DataFrame:
    """The contract's settings: byte-level vocabulary, end id 2, 1024 ids a sequence."""
    import public_tokenizers

    pieces = settle(pieces_of(docs, public_tokenizers.path("byte_bpe_50k.json"), False, 2, capacity, with_ids=False), "pieces")
    return pack(pieces, capacity).drop("ids")
