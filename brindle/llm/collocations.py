"""Collocations by Toivonen's mining: a sample proposes frequent phrases, a full pass counts them with their negative border.

A phrase of k words can be frequent only if the k - 1 words at its front and at its back are. The first full pass counts every
phrase whose front and back are both proposed (every single word): that is each proposed phrase and the whole negative border
that occurs. Proposed phrases are counted as such; those of the border, almost all of them rare, by keys of 64 bits, and counts by key are
never too small. A key of the border that is frequent was missed by the sample: the second pass counts exactly, by whole phrases, those
of frequent keys and all that only they admit, to its full length. All frequent phrases are so counted over all rows, whatever the
sample was, and no count is of a key.

What is proposed or frequent goes to the tasks as a bitmap of ``BITS`` hashed places, so its size is fixed; a phrase that passes by a
collision is counted for nothing and dropped, none is lost. Within a task phrases are counted by whole ids, not by hashes.
The sample is a share of the rows, ``SAMPLE``, with a threshold lowered to make misses rare.

Scores are floor(1000 * a * n / (l * r)) in decimals of 38 digits, over the weakest cut. Null texts and empty ones have no words, a null
language is ``und``, repeated rows count again, an empty table gives no rows. Texts are read whole, however long. Ties go to more
occurrences, then to the phrase in byte order. Only text and language are read: other columns may have any name.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brindle.llm.common import settle, table

MOST_WORDS = 5
#: Bits of the bitmap of proposals and of a piece of it that one task makes.
BITS, PIECE = 1 << 27, 1 << 19
#: Share of the documents that is mined first, and the part of the threshold's expected count there that proposes a phrase.
SAMPLE, LOWERED = 1 / 8, 0.4
#: Code points of text that a task counts together; phrases, and keys, that it gives out at a time.
TOGETHER, GIVEN, KEYS_GIVEN = 3 << 20, 1 << 15, 1 << 18

#: Lower-cases A-Z, makes a break (a byte that no text has) of marks and line ends.
_BREAK = 0xFF
_LOWER = bytes(_BREAK if c in b".,;:!?\n\x0b\x0c\r" else c + 32 if 65 <= c <= 90 else c for c in range(256))
_ODD, _EVEN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_SCHEMA = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("key", pa.int64()), ("f", pa.int64())])
_KEYS = pa.schema([("key", pa.int64()), ("f", pa.int64())])


def _word_hashes(lang: str, words: list[bytes]) -> np.ndarray:
    seed = xxhash.xxh64_intdigest(lang.encode())
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), "u8", len(words))


def _longer(front: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a phrase from that of its front and of its last word."""
    mixed = (front ^ (front >> np.uint64(29))) * _ODD + word * _EVEN
    return mixed ^ (mixed >> np.uint64(32))


def _key(h: np.ndarray, words: int) -> np.ndarray:
    """Key of a phrase: 61 bits of hash, and its length in the last 3."""
    mixed = (h + np.uint64(words)) * _ODD
    return (mixed ^ (mixed >> np.uint64(31))) & ~np.uint64(7) | np.uint64(words)


class Proposals:
    """The bitmap: which phrases may be proposed."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def has(self, h: np.ndarray, words: int) -> np.ndarray:
        place = ((_key(h, words) >> np.uint64(3)) % np.uint64(8 * len(self.bits))).astype("i8")
        return (self.bits[place >> 3] >> (place & 7).astype("u1") & 1).astype(bool)


def proposals(keys: DataFrame) -> Proposals:
    """keys: key. Pieces of the bitmap are made where they are dealt; the driver joins pieces of fixed number and size."""

    size, piece = BITS, PIECE

    def joined(key: tuple, rows: pa.Table) -> pa.Table:
        bits = np.zeros(piece, bool)
        bits[rows["bit"].to_numpy()] = True
        return pa.table({"piece": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    placed = keys.select((F.shiftrightunsigned("key", 3) % size).alias("place")).selectExpr(f"place div {piece} AS piece", f"place % {piece} AS bit").distinct()
    pieces = placed.groupBy("piece").applyInArrow(joined, "piece long, bits binary")
    whole = np.zeros(size // 8, "u1")
    for r in pieces.collect():  # at most BITS / PIECE rows of PIECE / 8 bytes
        whole[r.piece * piece // 8 : (r.piece + 1) * piece // 8] = np.frombuffer(bytes(r.bits), "u1")
    return Proposals(whole)


class Held:
    """Words of some texts by number, with a break after each piece; number 0 is the break."""

    def __init__(self):
        self.numbers: defaultdict[bytes, int] = defaultdict(count().__next__)
        self.numbers[b"\xff"]
        self.ids: list[np.ndarray] = []

    def add(self, text: str) -> None:
        tokens = text.encode().translate(_LOWER).replace(b"\xff", b" \xff ").split()
        self.ids.append(np.fromiter(map(self.numbers.__getitem__, tokens), "i4", len(tokens)))
        self.ids.append(np.zeros(1, "i4"))


@dataclass
class Found:
    """Distinct phrases of ``size`` words in some texts: hashes, first places, occurrences; ``before``: whether the pass before counted them."""

    size: int
    hashes: np.ndarray
    firsts: np.ndarray
    counts: np.ndarray
    before: np.ndarray


def _count(lang: str, words: list[bytes], ids: np.ndarray, most: int, now: Proposals | None, before: Proposals | None) -> Iterator[Found]:
    """Phrases of up to ``most`` words, by rising length, whose front and back ``now`` has.

    With ``before``, those that the pass before did not count are proposals at once: what is around a missed phrase is counted
    to its full length in one pass.
    """
    # ``starts``: where a phrase of k words begins that is counted; ``code`` numbers the distinct ones, whose hashes are ``held``
    # and whose first places are ``firsts``. ``counted_before``: places, among these, that the pass before counted.
    starts, code, held = np.flatnonzero(ids), ids, _word_hashes(lang, words)
    word_hashes = held
    firsts = np.zeros(len(words), "i8")
    firsts[ids[::-1]] = np.arange(len(ids))[::-1]
    counted_before = np.ones(len(ids), bool)
    for k in range(1, most + 1):
        if k > 1:
            open_now = np.zeros(len(ids) + 1, bool)
            open_now[starts] = True if now is None else now.has(held, k - 1)[code[starts]]
            if before is not None:
                open_before = np.zeros(len(ids) + 1, bool)
                open_before[starts] = counted_before[starts] & before.has(held, k - 1)[code[starts]]
                open_now[starts] |= ~counted_before[starts]
                counted_before = open_before[:-1] & open_before[1:]
            starts = starts[open_now[starts] & open_now[starts + 1]]
            _, at, code_of = np.unique(code[starts] * np.int64(len(words)) + ids[starts + k - 1], return_index=True, return_inverse=True)
            firsts = starts[at]
            held = _longer(held[code[firsts]], word_hashes[ids[firsts + k - 1]])
            code = np.zeros(len(ids), "i8")
            code[starts] = code_of
        if len(starts) == 0:
            return
        yield Found(k, held, firsts, np.bincount(code[starts], minlength=len(held)), counted_before[firsts])


def _per_text(rows: DataFrame, emit, schema: str) -> DataFrame:
    """rows: lang, text. What ``emit`` gives of a language, its words by number and the words' numbers, for ``TOGETHER`` of text at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: defaultdict[str, Held] = defaultdict(Held)
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, texts in waiting.items():
                yield from emit(lang, list(texts.numbers), np.concatenate(texts.ids).astype("i8"))
            waiting.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                waiting[lang].add(text)
                size += len(text)
                if size >= TOGETHER:
                    yield from flush()
                    size = 0
        yield from flush()

    return rows.select("lang", "text").mapInArrow(run, schema)


def _by_key(found: Found, which: np.ndarray, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """key, f of these phrases; other columns of the schema are null."""
    own = {"key": _key(found.hashes[which], found.size).view("i8"), "f": found.counts[which].astype("i8")}
    for at in range(0, len(own["f"]), KEYS_GIVEN):
        part = {k: pa.array(x[at : at + KEYS_GIVEN]) for k, x in own.items()}
        yield pa.RecordBatch.from_arrays([part[c.name] if c.name in part else pa.nulls(len(part["f"]), c.type) for c in schema], schema=schema)


def count_keys(rows: DataFrame, lengths: range, now: Proposals | None = None) -> DataFrame:
    """rows: lang, text. key, f: occurrences by key of the phrases whose front and back ``now`` has (all single words)."""
    shared = rows.sparkSession.sparkContext.broadcast(now)

    def emit(lang: str, words: list[bytes], ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        for found in _count(lang, words, ids, lengths.stop - 1, shared.value, None):
            if found.size in lengths:
                yield from _by_key(found, found.counts > 0, _KEYS)

    return _per_text(rows, emit, "key long, f long").groupBy("key").agg(F.sum("f").alias("f"))


def keys_of(phrases: DataFrame) -> DataFrame:
    """phrases: lang, phrase. key of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = []
            for lang, phrase in zip(*(batch.column(c).to_pylist() for c in range(2)), strict=True):
                hashes = _word_hashes(lang, phrase.encode().split(b" "))
                h = hashes[:1]
                for j in range(1, len(hashes)):
                    h = _longer(h, hashes[j : j + 1])
                keys.append(_key(h, len(hashes)).view("i8")[0])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64())], ["key"])

    return phrases.select("lang", "phrase").mapInArrow(run, "key long")


def count_phrases(rows: DataFrame, now: Proposals, named: Proposals, before: Proposals | None = None) -> DataFrame:
    """rows: lang, text. lang, phrase, key, f: exact counts, by whole phrases, of those that ``named`` has among the phrases whose front and
    back ``now`` has. All others are counted by key, and all words of a language as the phrase ``""``.

    With ``before``, a pass with it in both places went before: what that named is left out, and what it did not count is counted by whole
    phrases; nothing is counted by key.
    """
    shared = rows.sparkSession.sparkContext.broadcast((now, named, before))

    def emit(lang: str, words: list[bytes], ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        admitted, wanted, earlier = shared.value
        if earlier is None:
            yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), pa.array([""], pa.string()), pa.array([None], pa.int64()), pa.array([np.count_nonzero(ids)], pa.int64())], schema=_SCHEMA)
        for found in _count(lang, words, ids, MOST_WORDS, admitted, earlier):
            there, whole = found.counts > 0, wanted.has(found.hashes, found.size)
            if earlier is not None:
                whole = ~found.before | (whole & ~earlier.has(found.hashes, found.size))
            own = np.flatnonzero(there & whole)
            for at in range(0, len(own), GIVEN):
                out = own[at : at + GIVEN]
                parts = [[words[i] for i in ids[found.firsts[out] + j].tolist()] for j in range(found.size)]
                phrases = pa.array(list(map(b" ".join, zip(*parts, strict=True))), pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(out), pa.string()), phrases, pa.nulls(len(out), pa.int64()), pa.array(found.counts[out].astype("i8"))], schema=_SCHEMA)
            if earlier is None:
                yield from _by_key(found, there & ~whole, _SCHEMA)

    return _per_text(rows, emit, "lang string, phrase string, key long, f long").groupBy("lang", "phrase", "key").agg(F.sum("f").alias("f"))


def _proposed_by_sample(rows: DataFrame, threshold: int) -> DataFrame:
    """Keys of the phrases of the sample that reach the lowered threshold, by rising length."""
    sample = settle(rows.where(F.rand(42) < SAMPLE), "sample")
    least = max(1, int(threshold * SAMPLE * LOWERED))
    often = lambda lengths, now=None: settle(count_keys(sample, lengths, now).where(F.col("f") >= least).select("key"), "proposed")
    found = often(range(1, 2))
    found = found.unionByName(often(range(2, 3), proposals(found)))
    # longer ones in one pass: all whose pairs of words are proposed
    return found.unionByName(often(range(3, MOST_WORDS + 1), _pairs_only(proposals(found))))


class _PairsOnly(Proposals):
    """Admits all phrases of three words and more: each new pair of theirs was admitted before."""

    def has(self, h: np.ndarray, words: int) -> np.ndarray:
        return np.ones(len(h), bool) if words > 2 else super().has(h, words)


def _pairs_only(found: Proposals) -> Proposals:
    return _PairsOnly(found.bits)


def frequent_phrases(docs: DataFrame, threshold: int = 100, text: str = "text", lang: str = "lang") -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, f) of all phrases of up to ``MOST_WORDS`` words with f >= threshold, and (lang, n), each language's words."""
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("string").alias("text")).where("text IS NOT NULL")
    proposed = proposals(_proposed_by_sample(rows, threshold))
    # of the border, which is most of what is counted, only keys are shuffled and only what is frequent is written
    counts = settle(count_phrases(rows, proposed, proposed).where((F.col("f") >= threshold) | (F.col("phrase") == "")), "counts")
    length = F.size(F.split("phrase", " ")).alias("words")
    found = counts.where("phrase <> ''").select("lang", "phrase", length, "f")
    missed = counts.where("phrase IS NULL").select("key")
    if missed.take(1):
        # front and back of a frequent phrase are frequent: the first pass counted them and ``frequent`` has them, or it did not and the second does
        frequent = proposals(keys_of(found).unionByName(missed))
        more = count_phrases(rows, frequent, proposals(missed), proposed).where(F.col("f") >= threshold)
        found = found.unionByName(settle(more.select("lang", "phrase", length, "f"), "missed"))
    return found, counts.where("phrase = ''").select("lang", F.col("f").alias("n"))


def score_phrases(found: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, phrase, words, a, l, r, n, score of each frequent phrase of two words and more, by its weakest cut (ties: the first)."""
    parts = F.split("phrase", " ")
    cut = F.explode(F.transform(F.sequence(F.lit(1), F.col("words") - 1), lambda k: F.struct(k.alias("k"), F.array_join(F.slice("parts", F.lit(1), k), " ").alias("first"), F.array_join(F.slice("parts", k + 1, F.col("words") - k), " ").alias("rest"))))
    cuts = found.where("words > 1").withColumn("parts", parts).select("lang", "phrase", "words", F.col("f").alias("a"), cut.alias("c")).select("lang", "phrase", "words", "a", "c.*")
    known = found.select("lang", F.col("phrase").alias("part"), "f")
    cuts = cuts.join(known.select("lang", F.col("part").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(known.select("lang", F.col("part").alias("rest"), F.col("f").alias("r")), ["lang", "rest"]).join(totals, "lang")
    times = lambda x, y: f"cast({x} AS decimal(16,0)) * cast({y} AS decimal(16,0))"
    score = F.expr(f"(cast(1000 AS decimal(4,0)) * ({times('a', 'n')})) div ({times('l', 'r')})")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a", "n", "words")).alias("best"))
    return best.select("lang", "phrase", "best.words", "best.a", "best.l", "best.r", "best.n", "best.score")


def not_inside_longer(scored: DataFrame, percent: int = 100) -> DataFrame:
    """Leaves out what stands inside a longer candidate that has ``percent`` of its occurrences or more."""
    inside = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda size: F.transform(F.sequence(F.lit(1), F.col("words") - size + 1), lambda at: F.array_join(F.slice("parts", at, size), " "))))
    longer = scored.where("words > 2").withColumn("parts", F.split("phrase", " ")).select("lang", F.explode(inside).alias("phrase"), F.col("a").alias("f"))
    most = longer.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    return scored.join(most, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < percent * F.col("a"))).drop("longer")


def collocations(docs: DataFrame, threshold: int = 100, top: int = 2000, text: str = "text", lang: str = "lang") -> DataFrame:
    """The ``top`` collocations of each language with their rank."""
    found, totals = frequent_phrases(docs, threshold, text, lang)
    scored = settle(score_phrases(settle(found, "frequent"), totals), "scored")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return not_inside_longer(scored).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collocations(table(spark, sf_dir, "documents"))
    return found.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH pieces AS (
  SELECT lang, id, unnest(range(len(p))) AS k, unnest(p) AS piece FROM (
    SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS id, string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS p
    FROM documents WHERE text IS NOT NULL)
), words AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces
), totals AS (
  SELECT lang, sum(len(w)) AS n FROM words GROUP BY lang
), spread AS (
  SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, range(1, 6) s(k) WHERE len(w) >= k
), f AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM spread GROUP BY ALL HAVING count(*) >= 100
), cuts AS (
  SELECT lang, k, phrase, f AS a, c, string_split(phrase, ' ') AS w FROM f, range(1, 5) s(c) WHERE k > 1 AND c < k
), scored AS (
  SELECT x.lang, x.phrase, x.k, x.a, x.c, l.f AS l, r.f AS r, t.n, (1000::HUGEINT * x.a * t.n) // (l.f::HUGEINT * r.f) AS score
  FROM cuts x JOIN f l ON l.lang = x.lang AND l.phrase = array_to_string(x.w[1:x.c], ' ') JOIN f r ON r.lang = x.lang AND r.phrase = array_to_string(x.w[x.c + 1:], ' ') JOIN totals t ON t.lang = x.lang
), weakest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1
), kept AS (
  SELECT s.* FROM weakest s WHERE NOT EXISTS (
    SELECT 1 FROM f b WHERE b.lang = s.lang AND b.k > s.k AND b.f >= s.a AND contains(' ' || b.phrase || ' ', ' ' || s.phrase || ' '))
)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) WHERE rank <= 2000
"""
