"""Quality rules by cross-document line frequency. DataFrame functions only.

Lines are normalised (A-Z to lower case, digits to 0, white space to single spaces, trimmed) and
hashed. For each host and line, the distinct documents (distinct texts: exact copies count once) that
hold it are counted; a line held by more than ``max_share`` of the host's distinct documents, and by more than
``min_docs``, is above the limits and is removed wherever that host has it. A document is depleted, and
rejected, if more than ``max_removed`` of its words stood in removed lines.

Texts are cut into lines once for counting; their hashes are written. Counting then takes two passes over
these, so that what is shuffled stays small: plain counts of rows, summed before the shuffle, leave few
candidates; distinct texts are counted for those alone. A host has at most (lines a document) / ``max_share``
lines above the limits, which bounds the array it is joined by. Lines, texts and three-word windows are
compared by hashes of 64 bits.

A null text has no words, fails the base rules and counts as an empty one. A null host is a host of its own. Repeated
rows are judged alike. Extra columns pass through, but for those of the results' names (``q_``); an empty table gives no rows.
Texts are judged whole, however long: a text and the arrays of its lines, words and windows are in one task's memory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import lower_ascii, settle, without

SYMBOLS = "#*$%&|<>"
SIGNALS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _words(text):
    return F.array_remove(F.split(F.regexp_replace(text, r"[\x09-\x0D]", " "), " "), "")


def with_line_hashes(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds ``name``: the hashes of normalised lines, one for each line feed and one more; that of the empty line for those without words.

    Step by step, so that no step is spelt out (and run) twice in the next.
    """
    plain = F.regexp_replace(F.regexp_replace(text, r"[\x20\x09\x0B-\x0D]{2,}|[\x09\x0B-\x0D]", " "), "[1-9]", "0")
    ascii_only = F.octet_length(name) == F.length(name)
    df = df.withColumn(name, plain).withColumn(name, F.when(ascii_only, F.lower(name)).otherwise(lower_ascii(F.col(name))))
    return df.withColumn(name, F.transform(F.split(name, "\n"), lambda x: F.xxhash64(F.trim(x))))


def _blank():
    return F.xxhash64(F.lit(""))


def signals(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """Adds the base counts to each row. If hashes of three-word windows repeat, they are sorted within the row, with
    their places; equal neighbours are windows found twice or more, and the places they cover are counted once."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    p = prefix
    df = docs.withColumn(f"{p}t", t).withColumn(f"{p}w", _words(F.col(f"{p}t"))).withColumn(f"{p}n", F.size(f"{p}w"))
    threes = f"arrays_zip(slice({p}w, 1, {p}n - 2), slice({p}w, 2, {p}n - 2), slice({p}w, 3, {p}n - 2))"
    df = df.withColumn(f"{p}s", F.expr(f"if({p}n >= 4, transform({threes}, x -> xxhash64(x)), array())"))
    sorted_ = f"sort_array(arrays_zip({p}s, sequence(0, size({p}s) - 1)))"
    df = df.withColumn(f"{p}s", F.expr(f"if(size(array_distinct({p}s)) < size({p}s), {sorted_}, null)"))
    df = df.withColumn(
        f"{p}r",
        F.expr(f"""filter(zip_with(slice({p}s, 1, size({p}s) - 1), slice({p}s, 2, size({p}s) - 1),
            (x, y) -> if(x.`0` = y.`0`, array(x.`1`, x.`1` + 1, x.`1` + 2, y.`1`, y.`1` + 1, y.`1` + 2), null)), x -> x IS NOT NULL)""".replace("`0`", f"{p}s")),
    )
    lines = F.filter(F.split(F.col(f"{p}t"), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn(f"{p}l", lines)
    return df.withColumns(
        {
            f"{p}n_words": F.col(f"{p}n").cast("long"),
            f"{p}word_chars": F.length(F.array_join(f"{p}w", "")).cast("long"),
            f"{p}n_symbols": F.regexp_count(f"{p}t", F.lit(f"[{SYMBOLS}]")).cast("long"),
            f"{p}n_dup_lines": (F.size(f"{p}l") - F.size(F.array_distinct(f"{p}l"))).cast("long"),
            f"{p}n_repeat_words": F.coalesce(F.size(F.array_distinct(F.flatten(f"{p}r"))), F.lit(0)).cast("long"),
        }
    ).drop(*(f"{p}{c}" for c in "wnsrl"))


def frequent_lines(docs: DataFrame, host: str, text: str, max_share: float, min_docs: int) -> DataFrame:
    """host -> hashes of its lines above the limits."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    hashed = with_line_hashes(docs.select(F.col(host).alias("host"), F.xxhash64(t).alias("text_hash"), t.alias("text")), "text", "lines")
    hashed = settle(hashed.select("host", "text_hash", F.array_remove(F.array_distinct("lines"), _blank()).alias("lines")), "line_hashes")
    lines = hashed.select("host", "text_hash", F.explode("lines").alias("line"))
    sizes = hashed.groupBy("host").agg(F.count_distinct("text_hash").alias("size"))
    limit = F.greatest(F.lit(float(min_docs)), F.col("size") * F.lit(max_share))
    counts = lines.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > min_docs)
    joined = counts.alias("c").join(sizes.alias("s"), F.expr("c.host <=> s.host")).where(F.col("n") > limit)
    candidates = settle(joined.select(F.col("c.host").alias("host"), "line", limit.alias("most")), "lines")
    held = lines.alias("l").join(candidates.alias("k"), F.expr("l.line = k.line AND l.host <=> k.host"))
    held = held.select(F.col("l.host").alias("host"), F.col("l.line").alias("line"), "text_hash", "most").distinct()
    above = held.groupBy("host", "line", "most").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > F.col("most"))
    return settle(above.groupBy("host").agg(F.collect_list("line").alias("lines")), "above")


def quality_rules(
    docs: DataFrame, host: str = "source", text: str = "text", max_share: float = 0.1, min_docs: int = 10, max_removed: float = 0.5,
    min_words: int = 50, max_repeat_percent: int = 50,
) -> DataFrame:
    """All columns of ``docs`` and, prefixed with ``q_``: the base counts, ``q_base_failed``,
    ``q_clean_text`` (the text without lines above the limits), ``q_removed_words`` and ``q_kept``."""
    docs = without(docs, [f"q_{c}" for c in [*SIGNALS, *"t w n s r l p host above pairs all base_failed removed_words clean_text kept".split()]])
    above = frequent_lines(docs, host, text, max_share, min_docs).select(F.col("host").alias("q_host"), F.col("lines").alias("q_above"))
    df = docs.join(above, F.col(host).eqNullSafe(F.col("q_host")), "left").drop("q_host")
    df = signals(df, text, "q_")
    df = with_line_hashes(df.withColumn("q_p", F.when(F.col("q_above").isNotNull(), F.col("q_t"))), "q_p", "q_p")
    # a document's own lines above the limits, by hash: few, where a host may have many
    df = df.withColumn("q_above", F.array_intersect("q_above", "q_p"))
    common = F.transform("q_p", lambda x: F.array_contains("q_above", x))
    pairs = F.arrays_zip(F.split("q_t", "\n").alias("line"), common.alias("common"))
    df = df.withColumn("q_pairs", F.when(F.col("q_above").isNotNull(), pairs))
    removed = F.transform(F.filter("q_pairs", lambda x: x["common"]), lambda x: F.size(_words(x["line"])))
    df = df.withColumns(
        {
            "q_removed_words": F.coalesce(F.aggregate(removed, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long"),
            "q_clean_text": F.coalesce(F.array_join(F.transform(F.filter("q_pairs", lambda x: ~x["common"]), lambda x: x["line"]), "\n"), F.col("q_t")),
            "q_base_failed": (F.col("q_n_words") < min_words) | (100 * F.col("q_n_repeat_words") > max_repeat_percent * F.col("q_n_words")),
        }
    )
    df = df.withColumn("q_kept", ~F.col("q_base_failed") & (F.col("q_removed_words") <= F.col("q_n_words") * F.lit(max_removed)))
    # one row out for one row in: a filter on a verdict stays above this, and isn't spelt out in every expression below
    results = [f"q_{c}" for c in [*SIGNALS, "removed_words", "clean_text", "base_failed", "kept"]]
    return df.select(*docs.columns, F.explode(F.array(F.struct(*results))).alias("q_all")).select(*docs.columns, "q_all.*")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    judged = quality_rules(docs)
    return judged.select("doc_id", *(F.col(f"q_{c}").alias(c) for c in [*SIGNALS, "base_failed", "kept", "removed_words"]))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM d),
p AS (SELECT r, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
m AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM p) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM m, range(0, 3) AS s(k) GROUP BY r),
l AS (SELECT r, source, md5(t) AS h, line, trim(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000'), '[\x20\x09\x0B-\x0D]+', ' ', 'g'), ' ') AS norm
  FROM (SELECT r, source, t, unnest(string_split(t, chr(10))) AS line FROM d)),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
above AS (SELECT source, norm FROM l WHERE norm <> '' GROUP BY source, norm
  HAVING count(DISTINCT h) > greatest(10.0, 0.1 * (SELECT count(DISTINCT md5(d.t)) FROM d WHERE d.source IS NOT DISTINCT FROM l.source))),
gone AS (SELECT r, sum(len(list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda x: x <> ''))) AS removed FROM l JOIN above ON l.norm = above.norm AND l.source IS NOT DISTINCT FROM above.source GROUP BY r),
b AS (SELECT w.r, doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
  CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(removed, 0) AS BIGINT) AS removed_words
  FROM w LEFT JOIN rep ON w.r = rep.r LEFT JOIN dup ON w.r = dup.r LEFT JOIN gone ON w.r = gone.r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND removed_words <= n_words * 0.5 AS kept, removed_words
FROM b
"""
