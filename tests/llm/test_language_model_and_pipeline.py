"""The language model against numeric gradients and exact sums, and the pipeline's stages against what they promise."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.llm import decontamination, gated_lm, packing, simhash
from conftest import DATA

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def small_network(seed=0):
    counts = np.array([50, 40, 30, 20, 10, 8, 6, 4, 2, 1], "f8")
    net = gated_lm.Network(counts, np.array([0, 1, 3, 6, 10]), hidden=4, seed=seed)
    net.weights = {k: w.astype("f8") + (0.1 * np.random.default_rng(9).normal(size=w.shape) if k in ("class", "word") else 0) for k, w in net.weights.items()}
    return net


def loss(net, tokens, begins, valid, state):
    states, _ = net.run(tokens, begins, state)
    flat = np.flatnonzero(valid.ravel())
    return -net.log_softmax(states.reshape(-1, net.hidden).astype("f8")[flat], tokens.ravel()[flat]).sum() / len(flat)


def test_probabilities_sum_to_one():
    net = small_network()
    states = np.random.default_rng(1).normal(size=(3, 4))
    total = sum(np.exp(net.log_softmax(states, np.full(3, i))) for i in range(10))
    assert np.allclose(total, 1)


def test_each_part_of_a_step_stands_in_memory_of_its_own():
    """Steps work on whole blocks of memory, which is what most of their speed comes from."""
    net, keep = gated_lm.Network(np.ones(10), np.array([0, 1, 3, 6, 10]), hidden=4), []
    net.run(np.arange(6, dtype="i4").reshape(2, 3), np.zeros((2, 3), bool), np.zeros((3, 4), "f4"), keep)
    assert len(keep) == 2 and all(part.flags.c_contiguous for step in keep for part in step)


def test_a_unit_of_all_lanes_stands_in_one_piece():
    """Steps work on rows as long as there are lanes, not on rows of a few hidden units."""
    net, keep = gated_lm.Network(np.ones(10), np.array([0, 1, 3, 6, 10]), hidden=4), []
    states, last = net.run(np.arange(6, dtype="i4").reshape(2, 3), np.zeros((2, 3), bool), np.zeros((3, 4), "f4"), keep)
    assert states.shape == (2, 3, 4) and last.shape == (3, 4)
    assert all(part.shape == (4, 3) for step in keep for part in step) and states.transpose(0, 2, 1).flags.c_contiguous


@pytest.mark.parametrize("together", [1, 9, 1 << 23])
def test_slices_hold_the_words_of_each_text_and_its_end(monkeypatch, together):
    import pyarrow as pa

    monkeypatch.setattr(gated_lm, "TOGETHER", together)
    texts = [None, "", " ", "a", " A\x0bb\x0c\x1cc\x85d\u2003E \t", "\x00 B\r\nÉ", "İI " * 40, "\n", None, "x", "x"]
    head = gated_lm.Head(pa.array([b"x", b"a", gated_lm.END], pa.binary()), np.array([0, 5, 6, 2], "i4"), None, 2, 0, 0, np.ones(5), None, None)
    batch, got, seen = pa.record_batch([pa.array(range(len(texts))), pa.array(texts, pa.string())], names=["k", "t"]), [], []
    for own, words, places, sizes in gated_lm._slices(batch, 1):
        ids = gated_lm._ids(words, gated_lm._ranks(words, head), head)[places]
        got += zip(np.split(np.array(words.to_pylist(), object)[places], np.cumsum(sizes)[:-1]), np.split(ids, np.cumsum(sizes)[:-1]), strict=True)
        seen += own.column(0).to_pylist()
    assert seen == list(range(len(texts))) and len(got) == len(texts)
    for text, (words, ids) in zip(texts, got, strict=True):
        assert words.tolist() == [*gated_lm.words_of(text), gated_lm.END]
        assert ids.tolist() == [{b"x": 5, b"a": 6, gated_lm.END: 2}.get(w, zlib.crc32(w) % 5) for w in words]
    assert not list(gated_lm._slices(batch.slice(0, 0), 1))


@pytest.mark.parametrize("name", gated_lm.NAMES)
def test_gradients_equal_differences(name, monkeypatch):
    rng = np.random.default_rng(2)
    tokens, begins, valid = rng.integers(0, 10, (5, 3)), np.zeros((5, 3), bool), np.ones((5, 3), bool)
    begins[2, 1], valid[4, 2] = True, False
    state = rng.normal(size=(3, 4)).astype("f4")
    net = small_network()
    before = {k: w.copy() for k, w in net.weights.items()}
    # with huge sums of squares a step is the gradient, scaled
    net.squares = {k: np.full_like(x, 1e12) for k, x in net.squares.items()}
    net.learn(tokens, begins, valid, state)
    step = (before[name] - net.weights[name]) / gated_lm.RATE * 1e6
    net.weights = before
    for _ in range(12):
        at = tuple(rng.integers(0, s) for s in before[name].shape) if name != "read" else (int(rng.choice(np.unique(tokens))), int(rng.integers(0, 12)))
        ends = []
        for h in (1e-3, -1e-3):
            net.weights = {k: w.copy() for k, w in before.items()}
            net.weights[name][at] += h
            ends.append(loss(net, tokens, begins, valid, state))
        net.weights = before
        assert math.isclose((ends[0] - ends[1]) / 2e-3, step[at], rel_tol=0.02, abs_tol=2e-5)


@pytest.mark.parametrize("longest", [1, 2, 9])
def test_lanes_hold_every_token_once(longest):
    docs = [np.arange(n) + 1 for n in (7, 1, 1, 30, 2, 5)]
    seen = {d: [] for d in range(len(docs))}
    for tokens, begins, valid, doc in gated_lm.windows(docs, 3, 4, longest):
        assert (tokens[begins] == 1).all()
        for k in range(tokens.shape[1]):
            for t in range(len(tokens)):
                if valid[t, k]:
                    seen[doc[t, k]].append(int(tokens[t, k]))
    assert {d: s for d, s in seen.items()} == {d: x.tolist() for d, x in enumerate(docs)}
    assert list(gated_lm.windows([], 3, 4)) == []


def odd_docs(spark):
    base = [None, "", " \n", "The cat", "the CAT sat", "the cat sat on the mat " * 30, "Übung übung 🎉", "the cat sat", "the cat sat"]
    rows = [(i, t, None, None, None) for i, t in enumerate(base)] + [(None, "the mat", None, None, None), (8, "the cat sat", None, None, None)]
    return spark.createDataFrame(rows, DOCS)


def plain_score(net, ids):
    """Token by token, in plain Python."""
    w = {k: x.astype("f8").tolist() for k, x in net.weights.items()}
    n, starts, state, total = net.hidden, net.starts.tolist(), [0.0] * net.hidden, 0.0
    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    for i in ids:
        kind = int(net.of[i])
        scores = [sum(state[h] * w["class"][h][k] for h in range(n)) + w["class"][n][k] for k in range(len(starts) - 1)]
        total += scores[kind] - math.log(sum(map(math.exp, scores)))
        scores = {j: sum(state[h] * w["word"][j][h] for h in range(n)) + w["word"][j][n] for j in range(starts[kind], starts[kind + 1])}
        total += scores[i] - math.log(sum(map(math.exp, scores.values())))
        x, u = w["read"][i], [sum(state[h] * w["gate"][h][j] for h in range(n)) for j in range(3 * n)]
        z, r = ([sigmoid(x[at + h] + u[at + h]) for h in range(n)] for at in (0, n))
        c = [math.tanh(x[2 * n + h] + r[h] * u[2 * n + h]) for h in range(n)]
        state = [z[h] * state[h] + (1 - z[h]) * c[h] for h in range(n)]
    return total


def test_scores_equal_those_of_single_tokens():
    rng = np.random.default_rng(5)
    net = small_network()
    docs = [rng.integers(0, 10, n) for n in (70, 1, 3, 33, 32, 64, 7, 90)]
    state = np.zeros((3, 4), "f4")
    for tokens, begins, valid, _ in gated_lm.windows(docs, 3, 8):
        state = net.learn(tokens, begins, valid, state[: tokens.shape[1]])
    for lanes, steps, longest in ((3, 32, 1), (512, 5, 1), (3, 4, 9), (8, 4, 3)):
        assert np.allclose(gated_lm.log_probability(net, docs, lanes, steps, longest), [plain_score(net, d.tolist()) for d in docs], rtol=1e-4)


@pytest.fixture(scope="module")
def trained(spark):
    """A network that has learnt from four fifths of the documents, and the ids of the others."""
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").select("text").collect()]
    words = [[*gated_lm.words_of(t), gated_lm.END] for t in docs]
    counts = Counter(w for k, d in enumerate(words) if k % 5 for w in d)
    table = spark.createDataFrame([(bytearray(w), n) for w, n in counts.items()], "word binary, n long")
    head = gated_lm.head_of(table)
    ids = [gated_lm._ids(d, gated_lm._ranks(d, head), head) for d in words]
    net, state = gated_lm.Network(head.counts, head.starts), np.zeros((64, gated_lm.HIDDEN), "f4")
    for tokens, begins, valid, _ in gated_lm.windows([d for k, d in enumerate(ids) if k % 5], 64, gated_lm.WINDOW):
        state = net.learn(tokens, begins, valid, state[: tokens.shape[1]], 64 * gated_lm.WINDOW)
    return net, ids[::5]


def test_carried_state_beats_state_that_ends_with_windows(trained):
    net, held = trained
    carried = gated_lm.log_probability(net, held).sum()
    cut = lambda n: gated_lm.log_probability(net, [d[k : k + n] for d in held for k in range(0, len(d), n)]).sum()
    assert carried > cut(gated_lm.WINDOW // 2) > cut(1) and carried > 0.98 * cut(1)


def test_weights_and_sums_of_squares_pass_from_round_to_round():
    net = small_network()
    start = net.flat()
    again = gated_lm.Network(np.ones(10), net.starts, hidden=4, flat=start)
    assert all((again.arrays()[k] == x.astype("f4")).all() for k, x in net.arrays().items())
    rng = np.random.default_rng(3)
    again.learn(rng.integers(0, 10, (6, 2)), np.zeros((6, 2), bool), np.ones((6, 2), bool), np.zeros((2, 4), "f4"))
    assert (again.flat()[sum(w.size for w in net.weights.values()) :] >= start[sum(w.size for w in net.weights.values()) :]).all()
    import pickle

    pieces = [pickle.loads(x) for x in again.changes(start, 12)]
    assert {k for p in pieces for k in p} == set(net.arrays())
    assert np.array_equal(np.sort(np.concatenate([p["read"][1] + 10 * k // 16 for k, p in enumerate(pieces[:-1])])), np.flatnonzero(again.reads))


@pytest.mark.parametrize("head", [200_000, 3])
def test_counts_and_base_score(spark, monkeypatch, head):
    monkeypatch.setattr(gated_lm, "HEAD", head)
    docs = odd_docs(spark)
    rows = docs.collect()
    tokens = lambda t: [*gated_lm.words_of(t), b"\n"]
    fold = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1
    c = Counter(w for r in rows if not fold(r.doc_id) for w in tokens(r.text))
    n, v = sum(c.values()), len(c)
    want = sorted(
        ((str(r.doc_id), fold(r.doc_id), len(tokens(r.text)), sum(c[w] > 0 for w in tokens(r.text)), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(r.text)), 6)) for r in rows), key=repr
    )
    scored = gated_lm.score_documents(docs).collect()
    assert sorted(((str(r.key), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in scored), key=repr) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in scored)
    assert len({r.score for r in scored if r.key == "8"}) == 1


def test_empty_tables_and_no_training_documents(spark):
    docs = odd_docs(spark)
    assert gated_lm.score_documents(docs.limit(0)).count() == 0
    held = docs.where(F.crc32(F.col("doc_id").cast("string")) % 5 == 1)
    assert held.count() == gated_lm.score_documents(held).where("n_known = 0 AND train_tokens = 0").count()


def test_held_out_text_is_more_likely_than_by_counts(spark):
    scored = gated_lm.score_documents(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text"))
    r = scored.where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert r.s > 0.97 * r.b


@pytest.mark.parametrize("n", [5_000, 20_000])
def test_vocabulary_and_classes_grow_with_the_counts(spark, monkeypatch, n):
    rows = [(f"w{i}".encode(), 3 + n // (i + 1)) for i in range(n)] + [(f"rare{i}".encode(), 1 + i % 2) for i in range(900)] + [(gated_lm.END, 7)]
    counts = spark.createDataFrame([(bytearray(w), c) for w, c in rows], "word binary, n long")
    assert gated_lm.head_of(counts).known == min(gated_lm.OWN, n + 1)
    monkeypatch.setattr(gated_lm, "OWN", 1 << 20)
    head = gated_lm.head_of(counts)
    symbols = len(head.rare_totals)
    words = [w for w, _ in rows]
    ids = gated_lm._ids(words, gated_lm._ranks(words, head), head)
    assert head.known == n + 1 and len(set(ids[:n].tolist())) == n and ids[:n].min() >= symbols
    # scores of an average token: classes, and the words of its class; nearly the fewest that classes of equal sums of square roots can give
    p = head.counts[symbols:] / head.counts.sum()
    mass = np.cumsum(np.sqrt(p))

    def scores(edges):
        return len(edges) - 1 + (np.add.reduceat(p, edges[:-1]) * np.diff(edges)).sum()

    fewest = min(scores(np.unique(np.r_[0, np.searchsorted(mass, mass[-1] * np.arange(1, c) / c) + 1, len(p)])) for c in range(5, 400, 5))
    assert scores(head.starts[head.starts >= symbols] - symbols) < 1.1 * fewest < 3 * math.sqrt(n)
    assert ids[n:-1].max() < symbols and len(set(ids[n:-1].tolist())) > 10 and ids[-1] >= symbols
    # each symbol shares its probability among its words and the unknown ones
    total = head.rare_totals - 0.5
    for i, (_, c) in zip(ids[n:-1].tolist(), rows[n:-1], strict=True):
        total[i] -= c + 0.5
    assert np.allclose(total, 0)


# The pipeline.


@pytest.fixture(scope="module")
def stages(spark):
    import corpus_pipeline
    from brindle.sources.shared import settle, table

    docs = table(spark, DATA, "documents")
    extra = docs.selectExpr("doc_id + 5000 AS doc_id", "text", "lang", "source", "n_chars").limit(20)
    odd = spark.createDataFrame([(None, None, None, None, None), (7000, "", None, "s", 0), (7001, "mail a@b.org " + " ".join(f"own{i}" for i in range(80)), "en", None, 1)], DOCS)
    docs = settle(docs.unionByName(extra).unionByName(odd), "t")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(settle(stage(spark, out[-1], DATA), name))
    return out


def test_stages_keep_the_columns_of_documents(spark, stages):
    import corpus_pipeline

    assert all(s.columns == corpus_pipeline.COLUMNS for s in stages[:-1])
    assert "sequence_id" in stages[-1].columns


def test_quality_stage(stages):
    from brindle.llm import quality

    want = {(r.doc_id, r.q_clean_text) for r in quality.quality_rules(stages[0]).where("q_kept").collect()}
    assert {(r.doc_id, r.text) for r in stages[1].collect()} == want and 7001 in {d for d, _ in want} and 7000 not in {d for d, _ in want}


def test_near_duplicate_stage_keeps_one_of_each_component(stages):
    rows = stages[1].collect()
    fps = np.array([simhash.fingerprint(r.text) for r in rows], "u8")
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    label = np.arange(len(rows))
    for _ in range(len(rows)):
        new = np.array([label[near[i]].min() for i in range(len(rows))])
        if (new == label).all():
            break
        label = new
    want = sorted(min(rows[i].doc_id for i in np.flatnonzero(label == k)) for k in np.unique(label))
    assert sorted(r.doc_id for r in stages[2].collect()) == want


def test_decontamination_stage(spark, stages):
    windows = {tuple(w[i : i + 10]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect() for w in [decontamination.words_of(r.text)] for i in range(max(1, len(w) - 9)) if w}
    hit = lambda t: any(tuple(w[i : i + n]) in windows for w in [decontamination.words_of(t)] for n in {len(x) for x in windows} for i in range(len(w) - n + 1))
    before, after = ({r.doc_id: r.text for r in s.collect()} for s in stages[2:4])
    assert any(map(hit, before.values())) and not any(map(hit, after.values()))
    assert all(after[d] == t for d, t in before.items() if not hit(t))


def test_personal_data_stage(stages):
    from brindle.llm import pii

    rows = {r.doc_id: r.text for r in stages[4].collect()}
    assert set(rows) == {r.doc_id for r in stages[3].collect()}
    assert not any(pii.base_spans(t) for t in rows.values()) and rows[7001].startswith("mail <email> own0")


def test_packing_stage_and_run(spark, stages):
    import corpus_pipeline

    ids = {r.doc_id: r.n for r in stages[5].groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert set(ids) == {r.doc_id for r in stages[4].collect()}
    assert stages[5].groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("m")).where("n > 1024 OR n <> m").count() == 0
    assert packing.pack_documents(stages[4].limit(0)).count() == 0
    assert corpus_pipeline.run(spark, DATA).count() > 0


def test_averages_taken_in_a_tree_are_those_of_all_tasks(spark, monkeypatch):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").repartition(7)
    scores = lambda: {r.key: (r.score, r.n_tokens) for r in gated_lm.score_documents(docs).collect()}
    at_once = scores()
    monkeypatch.setattr(gated_lm, "FAN", 2)
    in_a_tree = scores()
    assert at_once.keys() == in_a_tree.keys()
    for k, (score, n) in at_once.items():
        assert abs(score - in_a_tree[k][0]) <= 1e-3 * max(1, n)
