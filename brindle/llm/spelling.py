"""Spelling variants: words one edit apart, each with the more frequent form it may stand for.

Words come from maximal runs of Latin letters; those of enough code points and occurrences are compared by dense
tiles. A tile is a pair of blocks of words as padded code-point matrices, one aligned left and one aligned right:
where the matrices first differ is the common prefix and the common suffix of each pair, and two different words are
one edit apart exactly if prefix and suffix together reach the longer length m less one.

Which blocks can hold such a pair follows from the same sum: prefix or suffix alone must reach half of m, and what is left
between them is one edit apart again, so that half of the rest is shared as well. Each word therefore stands, for m its
length and its length and one, under four keys (prefix or suffix, twice), about three quarters of its letters each. A pair is
given out under the first key that it shares, so no pair comes twice. Groups of over ``TILE`` words are cut into blocks by digest
and each pair of blocks is a tile of its own, dealt by key and blocks: no task holds a group of any size, and no pair is lost.

Null texts have no words, a null id counts as an empty one, repeated rows count again, an empty table gives no rows.
Texts and words of any length are read whole; words of over ``WIDE`` code points are compared pair by pair, without a matrix.
Ties of frequency go to the smallest word in code-point order. Only the id and the text are read: other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import lower_ascii, parts_for, settle, table

RUN = "[a-zÀ-ÿ]+"
#: Least code points and occurrences of a word.
LEAST_CHARS, LEAST_COUNT = 5, 3
#: Words of a block; code points up to which words are compared as matrices; cells of the matrices that are compared at a time.
TILE, WIDE, CELLS = 1024, 96, 1 << 21
#: Rows whose groups are compared together.
TOGETHER = 1 << 15
#: Which ends a key shares: the first half, then half of the rest.
PATHS = ("pp", "ps", "sp", "ss")


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", drop_every: int | None = None) -> DataFrame:
    """word, n. ``drop_every``: where it divides the CRC-32 of ``<id>:<run>``, the run loses a code point (a planted misspelling)."""
    lowered = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), lower_ascii(F.col(text).cast("string")).alias("t"))
    runs = lowered.select("id", F.explode(F.regexp_extract_all("t", F.lit(RUN), F.lit(0))).alias("run"))
    word = F.col("run")
    if drop_every:
        runs = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run")))
        at = (F.col("h") % F.length("run")).cast("int")
        word = F.when(F.col("h") % drop_every == 0, F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))).otherwise(word)
    words = runs.select(word.alias("word")).where(F.length("word") >= LEAST_CHARS)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_COUNT)


def _shared(path: int, m):
    """Code points of prefix and suffix that words under a key share, for the longer length m (a column or an array)."""
    integral = (lambda x: F.floor(x / 2).cast("int")) if not isinstance(m, np.ndarray) else (lambda x: x // 2)
    half = integral(m)
    rest = integral(m - half)
    nothing = m - m
    return ((half + rest, nothing), (half, rest), (rest, half), (nothing, half + rest))[path]


def _keyed(words: DataFrame) -> DataFrame:
    """m, path, key, word, n: eight rows a word."""
    m = F.explode(F.array(F.length("word"), F.length("word") + 1)).alias("m")
    rows = words.select("word", "n", m)
    keys = []
    for k in range(len(PATHS)):
        first, last = _shared(k, F.col("m"))
        keys.append(F.struct(F.lit(k).alias("path"), F.xxhash64(F.substring(F.col("word"), F.lit(1), first), F.substring(F.col("word"), F.length("word") - last + 1, last)).alias("key")))
    return rows.select("word", "n", "m", F.explode(F.array(*keys)).alias("k")).select("m", "k.path", "k.key", "word", "n")


def _dealt(rows: DataFrame, tile: int) -> DataFrame:
    """Adds the tile (lo, hi) and the block (side) of each word; words of large groups stand in a tile for each other block."""
    sizes = rows.groupBy("m", "path", "key").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > tile)
    blocks = sizes.select("m", "path", "key", F.ceil(F.col("size") / tile).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")
    found = rows.join(blocks, ["m", "path", "key"], "left").withColumn("side", F.coalesce(own, F.lit(0)))
    other = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("blocks"), F.lit(1)) - 1))
    return found.withColumn("other", other).select("m", "path", "key", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"), "side", "word", "n")


def _matrix(words: list[str], lengths: np.ndarray, right: bool) -> np.ndarray:
    """Code points of words, a row each, padded by zeros on the other side."""
    width = int(lengths.max())
    padded = [w.rjust(width, "\0") for w in words] if right else [w.ljust(width, "\0") for w in words]
    return np.frombuffer("".join(padded).encode("utf-32-le"), "<u4").reshape(len(words), width)


def common_ends(words: list[str], a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the common prefix and the common suffix of different words a[k], b[k]."""
    lengths = np.fromiter(map(len, words), "i8", len(words))
    left, right = _matrix(words, lengths, False), _matrix(words, lengths, True)
    prefix, suffix = np.empty(len(a), "i8"), np.empty(len(a), "i8")
    step = max(1, CELLS // left.shape[1])
    for k in range(0, len(a), step):
        some = slice(k, k + step)
        prefix[some] = (left[a[some]] != left[b[some]]).argmax(1)
        suffix[some] = (right[a[some]] != right[b[some]])[:, ::-1].argmax(1)
    return prefix, suffix


def _ends_of(x: str, y: str) -> tuple[int, int]:
    """The same of two words of any length, by halving."""
    most = min(len(x), len(y))

    def reach(same) -> int:
        low, high = 0, most
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if same(middle) else (low, middle - 1)
        return low

    return reach(lambda k: x[:k] == y[:k]), reach(lambda k: x[len(x) - k :] == y[len(y) - k :])


def _pairs(group: np.ndarray, side: np.ndarray, crossing: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the pairs of each tile, by their distance in the (group-sorted) rows; of a tile of two blocks only those across."""
    for shift in range(1, int(np.bincount(group).max())):
        a = np.flatnonzero(group[shift:] == group[:-shift])
        if len(a) == 0:
            return
        a = a[~crossing[a] | (side[a] != side[a + shift])]
        yield a, a + shift


def _near(rows: pa.Table) -> pa.Table:
    """Near pairs, both ways, of whole tiles."""
    words, m, path, n = rows["word"].to_pylist(), rows["m"].to_numpy(), rows["path"].to_numpy(), rows["n"].to_numpy()
    tile = np.stack([m, path, rows["key"].to_numpy(), rows["lo"].to_numpy(), rows["hi"].to_numpy()])
    group = np.r_[0, np.cumsum((tile[:, 1:] != tile[:, :-1]).any(0))]
    lengths = np.fromiter(map(len, words), "i8", len(words))
    crossing = tile[3] != tile[4]
    out_a, out_b = [], []
    for a, b in _pairs(group, rows["side"].to_numpy(), crossing):
        longer = np.maximum(lengths[a], lengths[b]) == m[a]  # the others meet under their own length
        a, b = a[longer], b[longer]
        if len(a) == 0:
            continue
        prefix, suffix = np.zeros(len(a), "i8"), np.zeros(len(a), "i8")
        narrow = m[a] <= WIDE
        if narrow.any():
            used, places = np.unique(np.r_[a[narrow], b[narrow]], return_inverse=True)
            half = len(places) // 2
            prefix[narrow], suffix[narrow] = common_ends([words[i] for i in used.tolist()], places[:half], places[half:])
        for k in np.flatnonzero(~narrow).tolist():
            prefix[k], suffix[k] = _ends_of(words[a[k]], words[b[k]])
        near = prefix + suffix >= m[a] - 1
        a, b, prefix, suffix = a[near], b[near], prefix[near], suffix[near]
        first = np.full(len(a), len(PATHS))
        for k in reversed(range(len(PATHS))):
            least = _shared(k, m[a])
            first = np.where((prefix >= least[0]) & (suffix >= least[1]), k, first)
        mine = first == path[a]
        out_a.append(a[mine])
        out_b.append(b[mine])
    a, b = (np.concatenate(x) if x else np.empty(0, "i8") for x in (out_a, out_b))
    word, other = pa.array(words, pa.string()), np.r_[b, a]
    return pa.table({"word": word.take(pa.array(np.r_[a, b])), "near": word.take(pa.array(other)), "near_n": pa.array(n[other], pa.int64())})


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of their tiles: whole tiles are compared, about ``TOGETHER`` rows at a time, the last one waits for its rest."""
    held: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch]).combine_chunks()
        held = rows if held is None else pa.concat_tables([held, rows]).combine_chunks()
        if len(held) < TOGETHER:
            continue
        tile = np.stack([held[c].to_numpy() for c in ("m", "path", "key", "lo", "hi")])
        begins = np.flatnonzero((tile[:, 1:] != tile[:, :-1]).any(0)) + 1
        if len(begins):
            yield from _near(held.slice(0, int(begins[-1]))).to_batches()
            held = held.slice(int(begins[-1]))
    if held is not None and len(held):
        yield from _near(held).to_batches()


def near_words(words: DataFrame, tile: int = TILE) -> DataFrame:
    """words: word, n. word, near, near_n: all pairs one edit apart, both ways, once each."""
    rows = _dealt(_keyed(words), tile)
    order = ["m", "path", "key", "lo", "hi"]
    return rows.repartition(parts_for(words), *order).sortWithinPartitions(*order).mapInArrow(_compare, "word string, near string, near_n long")


def last_forms(links: DataFrame) -> DataFrame:
    """links: word, form. word, root: where following the forms ends. Each round doubles the steps taken; forms grow in frequency, so there are no cycles."""
    jumps = settle(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = jumps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = settle(jumps.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        jumps = moved.select("word", "root")
        if not moved.where("moved").take(1):
            return jumps


def variants(words: DataFrame, factor: int = 2, tile: int = TILE) -> DataFrame:
    """words: word, n (distinct words). word, n, n_near, form, form_n, root: the form is the near word of largest n that is at least ``factor`` times the word's."""
    words = settle(words, "words")
    best = near_words(words, tile).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    above = -F.col("best.less") >= factor * F.col("n")
    known = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(above, F.col("best.near")).alias("form"), F.when(above, -F.col("best.less")).alias("form_n")
    )
    known = settle(known, "forms")
    roots = last_forms(known.where("form IS NOT NULL"))
    return known.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(vocabulary(table(spark, sf_dir, "documents"), drop_every=97)).select("word", "form", "root", "n", "n_near", "form_n")


#: The CRC-32 byte by byte from a table that a rule makes; near words by the texts that are left when a code point goes.
ORACLE = r"""
WITH RECURSIVE steps AS (
  SELECT list(c ORDER BY k) AS t FROM (
    SELECT k, list_reduce(list_prepend(k::BIGINT, range(8)::BIGINT[]), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END) AS c FROM range(256) r(k))
), runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]+')) AS run FROM documents
), counted AS (
  SELECT id, run, count(*) AS n, hex(encode(id || ':' || run)) AS x FROM runs GROUP BY id, run
), summed AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(x), 2), lambda i: ('0x' || substr(x, i + 1, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) AS h FROM counted, steps
), words AS (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n FROM summed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), cut AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM words, unnest(range(1, length(word) + 1)) u(i)
), pairs AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word
), best AS (
  SELECT word, count(*) AS n_near, max(near_n) AS top FROM pairs GROUP BY word
), chosen AS (
  SELECT b.word, b.n_near, b.top, min(p.near) AS near FROM best b JOIN pairs p ON p.word = b.word AND p.near_n = b.top GROUP BY b.word, b.n_near, b.top
), known AS (
  SELECT w.word, w.n, coalesce(c.n_near, 0) AS n_near, CASE WHEN c.top >= 2 * w.n THEN c.near END AS form, CASE WHEN c.top >= 2 * w.n THEN c.top END AS form_n
  FROM words w LEFT JOIN chosen c ON c.word = w.word
), follow AS (
  SELECT word, word AS root, form AS next FROM known
  UNION ALL SELECT f.word, k.word, k.form FROM follow f JOIN known k ON k.word = f.next
)
SELECT k.word, k.form, f.root, k.n, k.n_near, k.form_n FROM known k JOIN follow f ON f.word = k.word AND f.next IS NULL
"""
