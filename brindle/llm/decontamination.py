"""Benchmark decontamination by an FM-index for each shard of documents.

Words are runs of ASCII letters, digits and any other character beyond ASCII, with A-Z in lower case.
A benchmark item gives its windows of ``window`` words, or, if it has fewer, one window of all. A shard
is about ``SHARD_WORDS`` words of whole documents (or one document that is longer): each task reads its
documents in shards, indexes each, searches all windows backwards, locates what occurs and merges the
words covered into spans. Documents are not shuffled.

The benchmark goes to the tasks in blocks of at most ``BLOCK_WORDS`` words (or one longer item), each a broadcast of its
own; a larger benchmark makes more blocks, which each shard goes through in turn, and spans are merged over
all of them. A shard numbers its own words and is indexed once; each block's windows are told in its numbers. Words that no block has,
by a bitmap of ``KNOWN_BITS`` hashed places (a word taken for one by a collision does no harm), end runs and keep the sort short. Driver and tasks hold one block in Python at a time; the others lie in files on their machines, so the sum of
the blocks is bounded by disk, not by memory. Rows of one item_id are one item.

A null or empty text has no words and no hits; an item without words has no window; a null item_id is
the empty string in lists. Repeated rows give equal results. Extra columns pass through; results are
columns prefixed ``d_``, which replace columns of those names. Empty documents give no rows, an empty benchmark no hits.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import without

SHARD_WORDS = 1 << 20
BLOCK_WORDS = 1 << 20
KNOWN_BITS = 1 << 23
WORD_BYTES = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: A-Z to lower case, all that is no part of a word to a space.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else 32 if WORD_BYTES.fullmatch(bytes([c])) is None else c for c in range(256))
ADDED = "d_n_words long, d_n_hit long, d_items array<string>, d_spans array<struct<start: long, end: long>>, d_clean_text string"


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


class Block:
    """Windows of some items: vocabulary, distinct windows by length and the items that have each."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for item, words in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
            for k in range(max(1, len(ids) - window + 1)) if ids else ():
                owners.setdefault(tuple(ids[k : k + window]), set()).add(item)
        self.windows: dict[int, tuple[np.ndarray, list[list[str]]]] = {}
        for length in sorted({len(w) for w in owners}):
            own = [w for w in owners if len(w) == length]
            self.windows[length] = (np.array(own, "i8"), [sorted(owners[w]) for w in own])


def _place(word: bytes) -> int:
    return zlib.crc32(word) % KNOWN_BITS


def blocks_of(spark: SparkSession, benchmark: DataFrame, window: int, item: str, text: str) -> tuple[list, bytes]:
    """Broadcasts of blocks, and the bitmap of their words; the driver holds one block at a time."""
    rows = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")), F.col(text).cast("string"))
    found, held, size, known = [], [], 0, np.zeros(KNOWN_BITS, bool)

    def put() -> None:
        block = Block(held, window)
        known[[_place(w) for w in block.vocabulary]] = True
        found.append(spark.sparkContext.broadcast(block))

    for key, own in rows.toLocalIterator():
        words = words_of(own)
        held.append((key, words))
        size += len(words)
        if size >= BLOCK_WORDS:
            put()
            _put_down(found[-1])
            held, size = [], 0
    if held or not found:
        put()
    return found, np.packbits(known, bitorder="little").tobytes()


def _put_down(block) -> None:
    """Frees the value that this process holds of a broadcast; it is read again from its file when asked for."""
    block.__dict__.pop("_value", None)


class _Numbers(dict):
    """Numbers words as they are met; 0 is every word that the benchmark does not have."""

    def __init__(self, known: bytes):
        super().__init__()
        self.known, self.sigma = known, 1

    def __missing__(self, word: bytes) -> int:
        place = _place(word)
        number = self[word] = self.sigma if self.known[place >> 3] >> (place & 7) & 1 else 0
        self.sigma += number > 0
        return number


class Shard:
    """The words of some documents in one FM-index. Document d begins at starts[d]; a 0 follows each."""

    def __init__(self, texts: list[list[bytes]], known: bytes):
        from brindle.llm.fm_index import FMIndex

        self.sizes = np.array([len(w) for w in texts], "i8")
        self.starts = np.concatenate([[0], np.cumsum(self.sizes + 1)[:-1]]).astype("i8")
        self.numbers = _Numbers(known)
        symbols = np.zeros(int((self.sizes + 1).sum()), "i8")
        for words, start in zip(texts, self.starts.tolist(), strict=True):
            symbols[start : start + len(words)] = [self.numbers[w] for w in words]
        self.hit, self.items = np.zeros(len(symbols), bool), [set() for _ in texts]
        self.index = FMIndex(symbols, self.numbers.sigma) if symbols.any() else None

    def search(self, block: Block) -> None:
        """Marks the words that a window of the block covers, and adds its items."""
        if self.index is None or not block.windows:
            return
        own = np.array([0, *(self.numbers.get(w, 0) for w in block.vocabulary)], "i8")
        change = np.zeros(len(self.hit) + 1, "i8")
        for length, (windows, owners) in block.windows.items():
            phrases = own[windows]
            there = np.flatnonzero((phrases > 0).all(1))  # the shard has all their words
            if not len(there):
                continue
            low, high = self.index.search(phrases[there])
            alive = np.flatnonzero(low < high)
            which, place = self.index.locate(low[alive], high[alive])
            np.add.at(change, place, 1)
            np.add.at(change, place + length, -1)
            doc = np.searchsorted(self.starts, place, "right") - 1
            for d, w in np.unique(np.stack([doc, there[alive[which]]], 1), axis=0).tolist():
                self.items[d].update(owners[w])
        self.hit |= np.cumsum(change[:-1]) > 0


def spans_of(text: str, mask: np.ndarray) -> list[dict]:
    """Code-point spans of runs of marked words."""
    data = text.encode("utf-8", "surrogatepass").lower()
    at = [m.span() for m in WORD_BYTES.finditer(data)]
    edge = np.flatnonzero(np.diff(np.r_[0, mask.astype("i1"), 0]))
    where = np.concatenate([[0], np.cumsum((np.frombuffer(data, "u1") & 0xC0) != 0x80)])
    return [{"start": int(where[at[a][0]]), "end": int(where[at[b - 1][1]])} for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]


def cut_out(text: str, spans: list[dict]) -> str:
    out, last = [], 0
    for s in spans:
        out.append(text[last : s["start"]])
        last = s["end"]
    return "".join([*out, text[last:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """All columns of ``docs`` and: words, words hit, items with occurring windows, merged removal spans, the text without them."""
    spark = docs.sparkSession
    docs = without(docs, ["d_n_words", "d_n_hit", "d_items", "d_spans", "d_clean_text"])
    blocks, words_known = blocks_of(spark, benchmark, window, item, item_text)
    known = spark.sparkContext.broadcast(words_known)  # KNOWN_BITS
    column = docs.columns.index(text)
    added = pa.schema([("d_n_words", pa.int64()), ("d_n_hit", pa.int64()), ("d_items", pa.list_(pa.string())), ("d_spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("d_clean_text", pa.string())])

    def finish(held: list[pa.RecordBatch], words: list[list[bytes]]) -> Iterator[pa.RecordBatch]:
        shard = Shard(words, known.value)
        for block in blocks:
            shard.search(block.value)
            if len(blocks) > 1:
                _put_down(block)
        hit, starts, sizes, items, d = shard.hit, shard.starts, shard.sizes, shard.items, 0
        for batch in held:
            rows = []
            for t in batch.column(column).to_pylist():
                mask = hit[starts[d] : starts[d] + sizes[d]]
                spans = spans_of(t, mask) if mask.any() else []
                rows.append({"d_n_words": int(sizes[d]), "d_n_hit": int(mask.sum()), "d_items": sorted(items[d]), "d_spans": spans, "d_clean_text": cut_out(t, spans) if spans else t})
                d += 1
            more = pa.Table.from_pylist(rows, added)
            table = pa.Table.from_batches([batch])
            for name in added.names:
                table = table.append_column(added.field(name), more.column(name))
            yield from table.to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        words: list[list[bytes]] = []
        size = first = 0
        for batch in batches:
            first = 0
            for i, t in enumerate(batch.column(column).to_pylist()):
                words.append(words_of(t))
                size += len(words[-1])
                if size >= SHARD_WORDS:
                    yield from finish([*held, batch.slice(first, i + 1 - first)], words)
                    held, words, size, first = [], [], 0, i + 1
            if first < batch.num_rows:
                held.append(batch.slice(first))
        if words:
            yield from finish(held, words)

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{kept}, {ADDED}")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    found = decontaminate(docs, benchmark)
    return found.select(
        "doc_id", F.col("d_n_words").alias("n_words"), F.col("d_n_hit").alias("n_hit"), F.size("d_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("d_items", ","), 256).alias("items_sha256"), (F.col("d_n_hit") > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT item, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0))),
dw AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
m AS (SELECT r, i, dw.n, item FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
h AS (SELECT r, count(DISTINCT i + k) AS n_hit FROM (SELECT DISTINCT r, i, n FROM m) AS s, range(0, 10) AS q(k) WHERE k < n GROUP BY r),
x AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM m) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.r = h.r LEFT JOIN x ON d.r = x.r
"""
