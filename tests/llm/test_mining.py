"""Toxicity, spelling variants and collocations against plain versions, on odd rows and held-out labels."""

import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.llm import collocations, spelling, toxicity
from conftest import DATA, duck_rows, rows_of

ODD = [(1, "Abc abc, ABC abc.\nabc", "en"), (2, None, "en"), (3, "", None), (4, "  ,. \t", "en"), (5, "Ümlaut ümlaut × ÷ straße", None), (5, "Ümlaut ümlaut × ÷ straße", None), (None, "abcdefgh abcdefgh abcdefg", "fr"), (7, "a" * 3000 + " " + "a" * 2999 + "b", "de")]
SCHEMA = "doc_id long, text string, lang string, word string, n long, score double"


def odd(spark):
    return spark.createDataFrame([(*r, "x", 1, 0.5) for r in ODD], SCHEMA)


# Spelling.


def plain_words(rows, drop_every=97):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % drop_every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 3}


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_variants(words):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, own in near.items():
        best = min(own, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, words[w], len(near[w]), words.get(form[w])))
    return out


def variants_of(spark, words, tile):
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(df, tile=tile).collect()}


@pytest.mark.parametrize("tile", [2, 7, 1024])
def test_variants_equal_all_pairs_compared(spark, tile):
    """Few letters and short words: large groups, many repeated letters, insertions at both ends; blocks of 2 and 7 words too."""
    draw = random.Random(tile)
    words = {"".join(draw.choice("abß𝒳") for _ in range(draw.randint(5, 8))): draw.randint(3, 90) for _ in range(400)}
    words |= {"x" * k: 3 * 2 ** (12 - k) for k in range(5, 12)}  # a chain of forms
    found = variants_of(spark, words, tile)
    assert found == plain_variants(words) and ("x" * 11, "x" * 10, "x" * 5, 6, 1, 12) in found


def test_long_words_are_compared_without_a_matrix(spark):
    base = "lorem" * 60
    words = {base: 50, base[:100] + base[101:]: 9, base + "q": 8, "q" + base: 7, base[:-1] + "z": 3, base[:-2] + "zz": 3, "short": 4}
    assert variants_of(spark, words, 1024) == plain_variants(words)


def test_vocabulary_on_odd_rows_and_whole_tables(spark):
    found = {r.word: r.n for r in spelling.vocabulary(odd(spark).union(odd(spark)), drop_every=97).collect()}
    assert found == plain_words([r[:2] for r in ODD] * 2)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert {r.word: r.n for r in spelling.vocabulary(docs, drop_every=97).collect()} == plain_words([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    none = spelling.variants(spelling.vocabulary(docs.limit(0)))
    assert none.count() == 0 and set(none.columns) == {"word", "form", "root", "n", "n_near", "form_n"}


# Collocations.


def plain_collocations(rows, threshold, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = lang or "und"
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lowered):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, 6):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        often = {p: c for p, c in counts.items() if c >= threshold}
        scored = []
        for p, a in often.items():
            if len(p) == 1:
                continue
            if any(len(q) > len(p) and c >= a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, c in often.items()):
                continue
            score, k = min((Fraction(1000 * a * n[lang], counts[p[:k]] * counts[p[k:]]).__floor__(), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), " ".join(p), a, counts[p[:k]], counts[p[k:]], n[lang], score))
        out += [(lang, rank, *x[3:]) for rank, x in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def collocations_of(df, threshold, top):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in collocations.collocations(df, threshold, top).collect())


@pytest.mark.parametrize(("share", "lowered"), [(1 / 8, 0.4), (1.0, 1.0), (0.0, 0.4), (0.02, 1.0)])
def test_collocations_equal_all_phrases_counted_whatever_the_sample(spark, monkeypatch, share, lowered):
    """Without a sample, or with one that proposes too little, the border fails and further passes close it."""
    monkeypatch.setattr(collocations, "SAMPLE", share)
    monkeypatch.setattr(collocations, "LOWERED", lowered)
    draw = random.Random(5)
    rows = [(draw.choice(["en", "de", None]), " ".join(draw.choice(["a b", "c", "d e f g h", "A", "b,", "é.", "x\t y", "\x1fz"]) for _ in range(draw.randint(0, 30)))) for _ in range(120)]
    rows += [("en", None), ("en", "")] + [("fr", "one two three four five six. ") for _ in range(9)]
    df = spark.createDataFrame([(None, t, lang, "p", 1, 0.0) for lang, t in rows], SCHEMA)
    assert collocations_of(df, 8, 12) == plain_collocations(rows, 8, 12)


def test_a_full_bitmap_loses_nothing(spark, monkeypatch):
    """With few bits many phrases pass that were not proposed; they are counted and dropped."""
    monkeypatch.setattr(collocations, "BITS", 16)
    monkeypatch.setattr(collocations, "PIECE", 8)
    draw = random.Random(6)
    rows = [("en", " ".join(draw.choice("a b c d e f g".split()) for _ in range(40))) for _ in range(60)]
    df = spark.createDataFrame([(None, t, lang, "p", 1, 0.0) for lang, t in rows], SCHEMA)
    assert collocations_of(df, 10, 50) == plain_collocations(rows, 10, 50)


def shuffled_bytes(spark):
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jvm
    stages = store.stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return {stages.apply(k).stageId(): stages.apply(k).shuffleWriteBytes() for k in range(stages.size())}


def test_rare_phrases_are_shuffled_by_key_and_not_as_text(spark):
    """40,000 words of 100 letters that occur once, 4 MB of text that no codec shortens much, beside a frequent pair."""
    draw = random.Random(3)
    rows = [("en", " ".join([f"{draw.getrandbits(400):0100x}" for _ in range(1000)] + ["of course"] * 2)) for _ in range(40)]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(4).localCheckpoint()
    before = shuffled_bytes(spark)
    found, totals = collocations.frequent_phrases(df, 50)
    assert {(r.phrase, r.f) for r in found.collect()} == {("of", 80), ("course", 80), ("of course", 80)}
    assert [r.n for r in totals.collect()] == [40 * 1004]
    assert sum(n for k, n in shuffled_bytes(spark).items() if k not in before) < 1_500_000


def test_collocations_of_odd_rows_and_none(spark):
    assert collocations_of(odd(spark), 2, 10) == plain_collocations([(r[2], r[1]) for r in ODD], 2, 10)
    assert collocations_of(odd(spark).limit(0), 2, 10) == []


# Toxicity.


def grammar():
    return toxicity.Grammar({"moron": 4.0}, {"vile": 3.0})


def outputs(text):
    g = grammar()
    return [(out & ~toxicity._INSULT, w) for out, w in g.clause([g.symbol(w) for w in toxicity._WORD.findall(text)])]


@pytest.mark.parametrize(
    ("clause", "context"),
    [
        ("a moron here", []), ("you are a moron", ["target"]), ("moron that you are", ["target"]), ("you never saw one like that old moron", []), ("he is not a moron", ["target", "negated"]), ("not here but over there a moron", []),
        ("they said moron", ["target", "reported"]), ("\" moron \"", ["reported"]), ("\" well \" moron", []), ("moron said they", ["target"]),
    ],
)
def test_the_composed_automaton_tells_contexts(clause, context):
    bits = {"target": toxicity._TARGET, "negated": toxicity._NEGATED, "reported": toxicity._REPORTED}
    assert outputs(clause) == [(sum(bits[c] for c in context), 4.0)]


def test_threats_need_an_intent_and_stems_a_longer_word():
    assert [out & toxicity._THREAT for out, _ in outputs("i will kill it")] == [toxicity._THREAT]
    assert outputs("they kill it") == [] and outputs("vile") == [] and outputs("vilely") == [(0, 3.0)]


def test_composition_equals_its_transducers_run_one_by_one():
    following, out = toxicity.compose()
    draw = random.Random(3)
    for _ in range(200):
        state, states = 0, [0] * len(toxicity.TRANSDUCERS)
        for symbol in (draw.randrange(8) for _ in range(30)):
            moves = [step(s, symbol) for step, s in zip(toxicity.TRANSDUCERS, states)]
            assert out[state][symbol] == sum(o << k for k, (_, o) in enumerate(moves))
            state, states = following[state][symbol], [s for s, _ in moves]


def test_features_weigh_contexts_and_no_word_outside_a_match():
    g = grammar()
    by_name = lambda text: dict(zip(toxicity.FEATURES, g.features(text)))
    assert by_name("You moron! He is not a moron. Nothing else; here")["targeted"] == 4.0
    assert by_name("You moron! He is not a moron.")["negated"] == 4.0
    assert not any(g.features("they said so. not here, you see")) and not any(g.features(""))
    assert by_name("moron " * 50_000)["hits"] == 50_000


def test_held_out_toxicity_is_found_and_clean_documents_are_left(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = toxicity.train(docs, labels.where(~held_out))
    rows = toxicity.score_toxicity(docs, model).join(labels.where(held_out), "doc_id").select("t_score", "toxic", "lang").collect()
    english = [(r.t_score, r.toxic) for r in rows if r.lang == "en"]
    assert sum(s >= 0.5 for s, y in english if y) >= 0.6 * sum(y for _, y in english)
    assert sum(s >= 0.5 for s, y in ((r.t_score, r.toxic) for r in rows) if not y) <= 0.05 * len(rows)


def test_toxicity_of_odd_rows(spark):
    docs = odd(spark).withColumn("t_score", F.lit("mine")).withColumn("toxic", F.lit("no label"))
    labels = spark.createDataFrame([(1, 1), (2, 0), (5, 0), (5, 1), (None, 1), (99, 1), (4, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    rows = toxicity.score_toxicity(docs, model).collect()
    assert len(rows) == len(ODD) and all(0 <= r.t_score <= 1 for r in rows) and rows[0].toxic == "no label"
    assert len({r.t_score for r in rows if not (r.text or "").strip()}) == 1
    assert rows[4].t_score == rows[5].t_score
    for none in (toxicity.train(docs.limit(0), labels), toxicity.train(docs, labels.limit(0))):
        assert {r.t_score for r in toxicity.score_toxicity(docs, none).collect()} == {0.5}
    assert toxicity.score_toxicity(docs.limit(0), model).count() == 0


def test_scores_do_not_see_labels_language_source_or_id(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    plain = sorted((r.text or "", r.t_score) for r in toxicity.score_toxicity(docs, model).collect())
    other = docs.select((F.col("doc_id") * 7).alias("doc_id"), "text", F.lit("xx").alias("lang"), F.lit(None).alias("source"))
    assert plain == sorted((r.text or "", r.t_score) for r in toxicity.score_toxicity(other, model).collect())


def test_weights_of_the_regression_part_labels():
    features = np.array([[0.0] * 9] * 50 + [[4.0] * 9] * 50)
    model = toxicity.Model(grammar(), toxicity.fit(features, np.r_[np.zeros(50), np.ones(50)]))
    assert (model.scores(features[:50]) < 0.2).all() and (model.scores(features[50:]) > 0.8).all()


@pytest.mark.parametrize("name", ["op12_spelling_variants", "op13_collocations"])
def test_queries_equal_their_sql(spark, duck, name):
    from brindle.llm import registry

    assert rows_of(registry.QUERIES[name](spark, DATA)) == duck_rows(duck, registry.ORACLES[name])
