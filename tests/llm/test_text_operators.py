"""Quality rules, decontamination, personal data, SimHash, pages and shards against brute force, with odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from brindle.llm import decontamination, fm_index, html_text, pii, quality, sharding, simhash
from brindle.llm.common import settle
from conftest import DATA, duck_rows, rows_of

ODD = "doc_id long, text string, lang string, source string, n_chars long, q_n string, size long, key string, d_items string, p_spans string, s_fp string, Q_KEPT string"
LONG = " ".join(f"word{i % 977}" for i in range(30_000))


def odd_docs(spark, texts=(), long=LONG):
    base = [None, "", " \n\t", "One two three four five", "one two three four five", long, long, "a b c a b c a b c", "Ünï cödé 🎉 ＊ #*$", *texts]
    rows = [(i, t, None if i % 3 else "en", None if i % 2 else "h", None, None, None, "x", "x", "x", "x", "x") for i, t in enumerate(base)]
    return spark.createDataFrame([*rows, (*[None] * 12,), rows[3], rows[3]], ODD)


@pytest.mark.parametrize("module", [quality, decontamination])
def test_oracles_hold_on_odd_rows(spark, module):
    import duckdb

    con = duckdb.connect()
    docs = odd_docs(spark, ["one two\nshared line\nshared line\nmore", *(f"shared line 7\nown {i} text" for i in range(40))], " ".join(LONG.split()[:1500]))
    items = spark.createDataFrame([(1, "word1 word2 word3 word4 word5 word6 word7 word8 word9 word10 word11"), (2, "three FOUR"), (2, "b c a"), (3, None), (4, ""), (5, "word1 word2 word3")], "item_id long, text string")
    con.register("documents", docs.toPandas().astype({"text": object}))
    con.register("benchmark", items.toPandas())
    if module is quality:
        got = quality.quality_rules(docs, max_share=0.1, min_docs=10).selectExpr("doc_id", *(f"q_{c} AS {c}" for c in [*quality.SIGNALS, "base_failed", "kept", "removed_words"]))
    else:
        got = decontamination.decontaminate(docs, items).selectExpr("doc_id", "d_n_words AS n_words", "d_n_hit AS n_hit", "size(d_items) AS n_items", "sha2(array_join(d_items, ','), 256) AS items_sha256", "d_n_hit > 0 AS contaminated")
    con.execute("CREATE TABLE d2 AS SELECT CAST(doc_id AS BIGINT) AS doc_id, text, source FROM documents")
    assert rows_of(got) == duck_rows(con, module.ORACLE.replace("FROM documents", "FROM d2"))


def test_lines_above_the_limits_go_and_depleted_documents_are_rejected(spark):
    own = "alpha beta gamma " * 2 + " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"Common LINE 7\n{own} {i}", "h") for i in range(15)] + [(99, "\n".join(["common   line 7"] * 30), "h"), (98, own, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in quality.quality_rules(docs).collect()}
    assert got[3].q_clean_text == f"{own} 3" and got[3].q_kept and got[3].q_removed_words == 3
    assert not got[99].q_kept and got[98].q_clean_text == own


def test_exact_copies_count_once(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(i, text, "h") for i in range(50)], "doc_id long, text string, source string")
    assert quality.quality_rules(docs).where("q_kept").count() == 50


def test_limits_are_shares_of_distinct_documents(spark):
    """Against plain counting, with a text that is most of a host's rows."""
    own = " ".join("abcdefghij"[i % 10] * (1 + i // 10) for i in range(60))
    name = lambda i: "".join("abcdefghij"[int(c)] for c in str(i))
    texts = [f"Shared line 1\n{own} {name(i)}" for i in range(40)] + [f"Shared line 1\n{own} {name(0)}"] * 1000 + [f"{own} plain {name(i)}" for i in range(300)]
    texts += [f"Rare line\n{own} rare {name(i)}" for i in range(12)] + [None, ""]
    rows = [(i, t, "h") for i, t in enumerate(texts)] + [(5000 + i, f"Rare line\n{own} {name(i)}", "k") for i in range(12)]
    got = {r.doc_id: r.q_clean_text for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    for host in "hk":
        distinct = {t or "" for _, t, h in rows if h == host}
        lines = Counter(re.sub("[0-9]", "0", line.lower()) for t in distinct for line in set(t.split("\n")) if line)
        above = {line for line, n in lines.items() if n > max(10, 0.1 * len(distinct))}
        for i, t, h in rows:
            if h == host:
                assert got[i] == "\n".join(x for x in (t or "").split("\n") if re.sub("[0-9]", "0", x.lower()) not in above)
        assert len(distinct) == (353 if host == "h" else 12) and above == {"shared line 0" if host == "h" else "rare line"}


# FM-index.


def naive_places(symbols, phrase):
    return [i for i in range(len(symbols) - len(phrase) + 1) if list(symbols[i : i + len(phrase)]) == list(phrase)]


@pytest.mark.parametrize("sigma", [2, 4, 30])
def test_fm_index_finds_every_occurrence(sigma):
    rng = np.random.default_rng(sigma)
    for n in (1, 2, 50, 700):
        s = rng.integers(0, sigma, n)
        if n > 100:
            s[200:300] = s[50:150]
        s[-1] = 0
        index = fm_index.FMIndex(s, sigma)
        assert sorted(fm_index.suffix_order(s).tolist()) == list(range(n))
        for length in (1, 2, 5):
            phrases = rng.integers(1, max(2, sigma), (40, length))
            low, high = index.search(phrases)
            which, place = index.locate(low, high)
            for k, phrase in enumerate(phrases):
                assert sorted(place[which == k].tolist()) == naive_places(s, phrase)


def test_spans_are_removed_and_blocks_change_nothing(spark, monkeypatch):
    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    docs = odd_docs(spark, [f"Before, {passage.upper()}! after it", passage.replace(" ", "\n")])
    items = spark.createDataFrame([(1, passage), (2, "before alpha"), (3, "after it"), (4, "nothing of it")], "item_id long, text string")
    one = {r.doc_id: r for r in decontamination.decontaminate(docs, items).collect()}
    assert one[9].d_clean_text == "" and one[9].d_items == ["1", "2", "3"] and one[10].d_clean_text == ""
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", 1)
    monkeypatch.setattr(decontamination, "SHARD_WORDS", 100)
    many = decontamination.decontaminate(docs, items)
    assert rows_of(many) == rows_of(decontamination.decontaminate(docs, items)) and len(decontamination.blocks_of(spark, items, 10, "item_id", "text")[0]) == 4
    assert {r.doc_id: r for r in many.collect()} == one


def test_decontamination_of_empty_tables(spark):
    docs, items = odd_docs(spark), spark.createDataFrame([], "item_id long, text string")
    assert decontamination.decontaminate(docs, items).where("d_n_hit > 0").count() == 0
    assert decontamination.decontaminate(docs.limit(0), items).count() == 0


# SimHash.


def plain_fingerprint(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    count = Counter(b for s in shingles for b in range(64) if xxhash.xxh64_intdigest(s.encode(), 42) >> b & 1)
    return sum(1 << b for b in range(64) if 2 * count[b] > len(shingles))


def brute_components(keys, fps, limit):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= limit:
                parent[find(i)] = find(j)
    groups = {}
    for i, k in enumerate(keys):
        groups.setdefault(find(i), []).append(k)
    return [min((k for k in groups[find(i)] if k is not None), default=None) for i in range(len(fps))]


def test_fingerprints_and_components(spark):
    docs = odd_docs(spark).unionByName(spark.read.parquet(f"{DATA}/documents.parquet").selectExpr("doc_id + 100 AS doc_id", "text", "lang", "source", "n_chars", "'' AS q_n", "1L AS size", "'' AS key", "'' AS d_items", "'' AS p_spans", "'' AS s_fp", "'' AS Q_KEPT"))
    rows = docs.collect()
    for r in rows[:40]:
        assert simhash.fingerprint(r.text) == plain_fingerprint(r.text)
    for limit in (4, 12):
        want = brute_components([r.doc_id for r in rows], [simhash.fingerprint(r.text) for r in rows], limit)
        got = simhash.near_duplicates(docs, max_bits=limit).collect()
        assert sorted(map(repr, ((r.key, r.component) for r in got))) == sorted(map(repr, zip((r.doc_id for r in rows), want)))
    kept = simhash.keep_one(docs)
    want = brute_components([r.doc_id for r in rows], [simhash.fingerprint(r.text) for r in rows], 4)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want)) and kept.columns == [c for c in docs.columns if c != "s_fp"]


def test_gray_index_equals_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(0)
    fps = np.unique(np.array([int(b) ^ sum(1 << int(k) for k in set(rng.integers(0, 64, n).tolist())) for b in rng.integers(0, 1 << 62, 25, dtype="u8") for n in range(12)], "u8"))
    order = np.argsort(simhash.gray_rank(fps), kind="stable")
    near = np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4, 1)
    want = {frozenset((int(fps[i]), int(fps[j]))) for i, j in zip(*np.nonzero(near))}
    got = {frozenset((int(x), int(y))) for a, b in simhash.linked_pairs(np.zeros(len(fps), int), fps[order], 4) for x, y in zip(fps[order][a], fps[order][b])}
    assert got == want
    df = spark.createDataFrame([(int(x),) for x in fps.view("i8")], "fp long")
    settled = settle(df, "t")
    roots = lambda: dict(r[:] for r in simhash.components(simhash.links(settled)).collect())
    whole = roots()
    monkeypatch.setattr(simhash, "NODE", 4)  # upper nodes are dealt into chunks
    assert roots() == whole
    monkeypatch.setattr(simhash, "ENTRIES", 0)  # finer upper nodes
    assert roots() == whole
    comp = brute_components([int(x) for x in fps.view("i8")], [int(x) for x in fps], 4)
    assert [whole.get(int(x), int(x)) for x in fps.view("i8")] == comp


@pytest.mark.parametrize("rows, most", [(1, 3), (7, 3), (40, 3), (40, 1), (1 << 16, 2048)])
def test_cut_nodes_lose_no_link(monkeypatch, rows, most):
    rng = np.random.default_rng(rows)
    centres = rng.integers(0, 1 << 62, 12, dtype="u8")
    fps = np.unique(np.array([int(c) ^ (1 << int(a)) ^ (1 << int(b)) for c in centres for a, b in rng.integers(0, 64, (25, 2))], "u8"))
    fps = fps[np.argsort(simhash.gray_rank(fps), kind="stable")]
    monkeypatch.setattr(simhash, "ROWS", rows)
    table = pa.table({"mask": np.repeat(np.array([0, 1], "i4"), len(fps)), "pattern": np.zeros(2 * len(fps), "i8"), "fp": np.tile(fps.view("i8"), 2)})
    monkeypatch.setattr("pyspark.TaskContext.get", lambda: type("Task", (), {"partitionId": lambda self: 3})())
    filed = pa.Table.from_batches(simhash._file(iter(table.to_batches(max_chunksize=5)), 4, most)).to_pylist()
    entries = [r for r in filed if r["chunk"] is not None]
    assert len(entries) == 2 * len(fps)  # both nodes are at an end of the partition
    chunks = {}
    for r in entries:
        chunks.setdefault((r["mask"], r["chunk"]), []).append(r["u"])
    assert max(map(len, chunks.values())) <= most and len({c for _, c in chunks}) == len(chunks)
    label = {int(f): int(f) for f in fps.view("i8")}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for mask in (0, 1):
        for r in filed:
            if r["chunk"] is None:
                assert (r["u"] % (1 << 64) ^ r["v"] % (1 << 64)).bit_count() <= 4
                label[find(r["u"])] = find(r["v"])
    for own in chunks.values():  # links within chunks are there
        for a in own:
            assert all(find(a) == find(b) for b in own if ((a ^ b) % (1 << 64)).bit_count() <= 4)


def test_pairs_of_distant_chunks_are_not_dealt(spark):
    rng = np.random.default_rng(5)
    sizes, most = (40, 300), 16  # a dense node of 40 clusters
    base = rng.integers(0, 1 << 62, sizes[0], dtype="u8")
    fps = np.unique(np.array([int(c) ^ (1 << int(a)) ^ (1 << int(b)) for c in base for a, b in rng.integers(0, 64, (sizes[1], 2))], "u8"))
    fps = fps[np.argsort(simhash.gray_rank(fps), kind="stable")]
    rows = [(0, 0, i // most, int(f)) for i, f in enumerate(fps.view("i8"))]
    entries = spark.createDataFrame(rows, "mask int, pattern long, chunk long, u long")
    got = {(r.i, r.j) for r in simhash.near_chunks(entries, 4, 8).collect()}
    a, b = np.nonzero(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4, 1))
    want = {(int(x), int(y)) for x, y in zip(a // most, b // most) if x != y}
    n = len(fps) // most
    assert want <= got and all(i < j for i, j in got)
    assert len(got) < n * n / 8


def test_simhash_of_an_empty_table(spark):
    assert simhash.near_duplicates(odd_docs(spark).limit(0)).count() == 0


# Personal data.


def plain_spans(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for kind, pattern, low, high in (("card", r"[0-9]([\x20-]?[0-9])+", 13, 19), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 9, 15)):
        for m in re.finditer(pattern, t):
            digits = re.sub("[^0-9]", "", m[0])
            if low <= len(digits) <= high and (kind == "phone" or pii.luhn(digits)):
                out.append((kind, *m.span()))
    return out


def test_base_spans_equal_plain_patterns():
    rng = random.Random(0)
    pieces = ["a", "1", ".", "@", "-", "+", " ", "9", "_", "b.c", "é", "0.0", "(", ")", "4111111111111111"]
    for _ in range(20_000):
        t = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 25)))
        assert pii.base_spans(t) == plain_spans(t)


def test_long_runs_take_linear_time():
    for t in ("a" * 200_000 + "@", "1" * 200_000, "1." * 100_000, "+1" * 100_000, "+1" + "(" * 200_000, "a@" * 100_000):
        pii.base_spans(t)


SECRETS = [f"we set token = \"{hashlib.sha1(str(i).encode()).hexdigest()}\" in the {w} file" for i, w in enumerate("old new red blue big small".split() * 20)]
PLAIN = [f"Version 2.0. of the {w} has 7 parts and 12 rules" for w in "old new red blue big small".split() * 20]


def test_field_gives_exact_beliefs_on_a_chain():
    model = pii.fit(SECRETS + PLAIN)
    graph = pii.Graph()
    pii.add_document(graph, 0, "set token = 7f3c5d9a1b2c3d4e5f6a now")
    assert len(graph.doc) <= 5 and not graph.skip
    size, n = len(pii.LABELS), len(graph.doc)
    rows, columns = pii._sums(model.index, graph)
    unary = np.zeros((n, size))
    np.add.at(unary, rows, model.unary[columns])
    unary += np.array(graph.clamped)[:, None] / 2 * (model.chain[0] + model.chain[:, 0])
    want = np.zeros((n, size))
    from itertools import product

    for labels in product(range(size), repeat=n):
        p = np.exp(sum(unary[i, y] for i, y in enumerate(labels)) + sum(model.chain[labels[a], labels[b]] for a, b in graph.chain))
        for i, y in enumerate(labels):
            want[i, y] += p
    assert np.allclose(pii.marginals(graph, model), want / want.sum(1, keepdims=True), atol=2e-3)


def test_field_agrees_with_enumeration_on_graphs_with_loops():
    """Chains with skips: beliefs of loopy message passing are those of all labellings, nearly."""
    from itertools import product

    rng, size = np.random.default_rng(3), len(pii.LABELS)
    for skips in ([(0, 3)], [(0, 2), (2, 4)], [(0, 4), (1, 3)], [(0, 2), (0, 4), (2, 4)]):
        n = 5
        skip = rng.normal(0, 0.4, (size, size))
        model = pii.Model({f"f{i}": i for i in range(n)}, rng.normal(0, 1.5, (n, size)), rng.normal(0, 0.4, (size, size)), (skip + skip.T) / 2)
        graph = pii.Graph([0] * n, [(i, i + 1) for i in range(n)], [[f"f{i}"] for i in range(n)], [0] * n, [(i, i + 1) for i in range(n - 1)], skips)
        want = np.zeros((n, size))
        for labels in product(range(size), repeat=n):
            p = np.exp(sum(model.unary[i, y] for i, y in enumerate(labels)) + sum(model.chain[labels[a], labels[b]] for a, b in graph.chain) + sum(model.skip[labels[a], labels[b]] for a, b in skips))
            for i, y in enumerate(labels):
                want[i, y] += p
        want /= want.sum(1, keepdims=True)
        got = pii.marginals(graph, model)
        assert np.abs(got - want).max() < 0.06 and (got.argmax(1) == want.argmax(1)).mean() >= 0.8


def test_portions_hold_every_row_once_and_are_bounded(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(pii, "TOGETHER", 10)
    texts = ["a" * 4, None, "b" * 30, "", "c" * 6, "d" * 4, "é" * 3, "x"]
    parts = [b.column(0).to_pylist() for b in pii._portions(pa.RecordBatch.from_arrays([pa.array(texts)], names=["t"]), 0)]
    assert [t for p in parts for t in p] == texts and all(len(p) == 1 or sum(len((t or "").encode()) for t in p) <= 10 for p in parts)
    assert list(pii._portions(pa.RecordBatch.from_arrays([pa.array([], pa.string())], names=["t"]), 0)) == []


def test_repeated_tokens_get_the_label_of_the_first():
    model = pii.fit(SECRETS + PLAIN)
    key = "7f3c5d9a1b2c3d4e5f6a7b8c9d0e1f2a3b4c5d6e"
    text = f"we set token = \"{key}\" in the old file. " + "words and words " * 30 + f"later {key} is seen. The 12 rules of Version 2.0. stay"
    (spans,) = pii.added_spans([text], [[]], model)
    assert {text[a:b] for _, a, b in spans} == {key} and len(spans) == 2
    assert pii.added_spans(PLAIN, [[] for _ in PLAIN], model) == [[] for _ in PLAIN]


def test_letters_only_secrets_and_similar_tokens_are_in_the_field():
    value = "correcthorsebatterystaple"
    text = f'we set password = "{value}" in the old file. ' + "words and words " * 30 + f"later {value} is seen"
    graph = pii.Graph()
    pii.add_document(graph, 0, text)
    assert [text[a:b] for a, b in graph.span].count(value) == 2 and len(graph.skip) == 1
    letters = [x.replace(m[1], m[1].translate(str.maketrans("0123456789", "ghijklmnop"))) for x in SECRETS if (m := re.search('"(.*)"', x))]
    (spans,) = pii.added_spans([text], [[]], pii.fit(SECRETS + letters + PLAIN))
    assert ("secret", text.index(value), text.index(value) + len(value)) in spans
    graph = pii.Graph()
    pii.add_document(graph, 0, "user-abc12 came " + "and words " * 9 + "user-abc34 went")
    assert [[graph.span[i][0] for i in pair] for pair in graph.skip] == [[0, 106]]


def test_tokens_proven_to_be_nothing_change_no_span(spark, monkeypatch):
    texts = [r.text for r in spark.read.parquet(f"{DATA.replace('0.001', '0.01')}/documents.parquet").select("text").limit(400).collect() if r.text]
    model = pii.fit([t for t in texts if pii._TELLING.search(t)])
    some = ["", "word", "x" * 50, *texts[:60]]
    base = [pii.base_spans(t) for t in some]
    pruned, graph = pii.added_spans(some, base, model), pii.Graph()
    for d, t in enumerate(some):
        pii.add_document(graph, d, t, model)
    monkeypatch.setattr(pii, "PROVEN", 0.0)  # nothing is proven: all tokens are in the graph
    whole = pii.Graph()
    for d, t in enumerate(some):
        pii.add_document(whole, d, t, model)
    assert len(whole.doc) == sum(len(t.split()) for t in some) and len(graph.doc) < len(whole.doc)
    assert pii.added_spans(some, base, model) == pruned
    p, q = (dict(zip(zip(g.doc, g.span), pii.marginals(g, model))) for g in (graph, whole))
    assert max(np.abs(p[k] - q[k]).max() for k in p) < 0.05
    assert all(q[k][0] > 0.99 for k in q if k not in p)  # what was left out is nothing


def test_scores_of_remembered_tokens_equal_their_features(monkeypatch):
    texts = [f"call +1 555 010 {i:04d} now or mail a{i}@example.com token = {'ab12' * 5}{i}" for i in range(40)]
    model = pii.fit(texts)
    for met in (0, 1 << 17):
        monkeypatch.setattr(pii, "MET", met)
        for t in texts[:5]:
            tokens, size = t.split(), len(pii.LABELS)
            cores = [x[slice(*pii._core(x, 0, len(x)))] for x in tokens]
            score = np.array([sum((model.unary[model.index[f]] for f in pii._features(cores, k) if f in model.index), np.zeros(size)) for k in range(len(tokens))])
            left, right = (max(m[x, y] - m[x, 0] for x in range(size)) for m in (model.chain, model.chain.T) for y in [1])
            most = [2 * max(max(model.chain[x, y] - model.chain[x, 0] for x in range(size)), max(model.chain[y, x] - model.chain[0, x] for x in range(size))) for y in range(1, size)]
            odds = np.exp(score[:, 1:] - score[:, :1] + most).sum(1)
            assert model.doubtful(tokens) == np.flatnonzero(odds >= pii.PROVEN).tolist() and left <= most[0] and right <= most[0]
    assert model.doubtful([]) == []


def test_field_agrees_with_held_out_documents(spark):
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    telling = [t for t in docs if re.search("[0-9@]", t)]
    model, held = pii.fit(telling[::2]), telling[1::2]
    graph = pii.Graph()
    for d, t in enumerate(held):
        pii.add_document(graph, d, t)
    label = pii.weak_labels(graph, dict(enumerate(held)))
    best = pii.marginals(graph, model).argmax(1)
    assert (best == label).mean() > 0.98 and (best[label > 0] == label[label > 0]).mean() > 0.9


def test_pii_of_odd_rows(spark):
    docs = odd_docs(spark, ["mail a.b@c.org or +1 (017) 555-7713, 10.0.0.256 or 10.0.0.255", "card 4111 1111 1111 1111"])
    got = {r.doc_id: r for r in pii.find_pii(docs, pii.train(docs)).collect()}
    assert got[9].p_redacted == "mail <email> or <phone>, 10.0.0.256 or <ip>" and got[10].p_redacted == "card <card>"
    assert got[0].p_spans == [] and got[None].p_redacted is not None
    assert pii.find_pii(docs.limit(0), pii.train(docs.limit(0))).count() == 0


# Pages.

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p><p>no";</script></head><body class="has-sidebar">
<nav><ul><li>Menu</li></ul></nav><header>Site</header><div class="cookie-notice">Accept</div><div id="sidebar">Side</div><div class="ad">Buy</div>
<article><h1>Head &amp;amp; line</h1><p>First&nbsp;  one<br>goes <b>on</b><p>Second &lt;b&gt; &#233;<script>x</script><form><input><button>Send</button></form>
<section class="comments"><p>Nice!</p></section></article><footer>&copy; all</footer></body></html>"""


def test_markup_and_references():
    lines = html_text.page_lines(PAGE.format())
    assert html_text.main_text(lines, set()) == "Head &amp; line\n\nFirst one goes on\n\nSecond <b> é"
    for broken in (None, "", "plain <", "<p", "<!-- open", "<script>open", "a<b", "<p>" * 3000, "<div class='x" * 50):
        html_text.page_lines(broken)


def test_articles_end_the_chrome_of_wrappers():
    text = lambda page: html_text.main_text(html_text.page_lines(page), set())
    for wrapper in ("class='content-sidebar-wrap'", "class='layout has-sidebar'", "class='sidebar'", "id='widget'"):
        assert text(f"<div {wrapper}><div class='menu'>Menu</div><main><article><p>Whole</p></article></main></div>") == "Whole"
        assert text(f"<div {wrapper}><div role='main'><p>Whole</p></div></div>") == "Whole"
    assert text("<article><p class='notice'>One</p><div class='share-price'>Two</div><div class='share-buttons'>Share</div></article>") == "One\n\nTwo"
    assert text("<div class='content has-sidebar'><p>Open</p></div>") == "Open"
    for outside in ("<aside>{}</aside>", "<nav>{}</nav>", "<footer>{}</footer>", "<div class='comments-area'>{}</div>", "<div class='relatedPosts'>{}</div>", "<div role='navigation'>{}</div>"):
        assert text("<article>Own</article>" + outside.format("<article>Other</article>")) == "Own"


def test_words_of_class_names_leave_articles_whole():
    text = lambda page: html_text.main_text(html_text.page_lines(page), set())
    for name in "search-results share-price social-history banner related-work notice-of-intent widget search copyright comment-on-the-law".split():
        for element in ("p", "div", "section"):
            assert text(f"<article><{element} class='{name}'>Whole</{element}></article>") == "Whole", (name, element)
    for name in "ad ads comments share-buttons newsletter cookie-notice".split():
        assert text(f"<article><p>Whole</p><div class='{name}'>Gone</div></article>") == "Whole", name


@pytest.mark.parametrize(
    "page",
    ["<a " * 350_000, '<a "' * 250_000, "<div>" * 100_000 + "</span>" * 100_000, "<p><div>" + "<b>" * 50_000 + "<p></p>" * 50_000, '<a ">"' * 150_000 + '"', "<" * 900_000 + ">", "<a<" * 300_000, "<script>" * 100_000, "<!--" * 200_000, "<a '>" * 200_000 + "'"],
    ids=range(10),
)
def test_broken_pages_take_linear_time(page):
    import time

    began = time.process_time()
    html_text.page_lines(page)
    assert time.process_time() - began < 6  # seconds; quadratic walks take minutes


def test_tags_quotes_and_raw_elements():
    lines = lambda page: [t for t, _ in html_text.page_lines(page)]
    assert lines("<p title='a > b'>one</p><p title=\"x>y'\">two</p>a < b <3 <?php x?><!x>c") == ["one", "two", "a < b <3 c"]
    assert lines("<svg/><p>one<svg><text>no</text></svg> more<style>p > a {}</STYLE >") == ["one more"]
    assert lines('<p>one<a href="x>two</a><p>three') == ["onetwo", "three"]
    assert lines("<ul><li>a<li>b<ul><li>c</ul><li>d</ul><p>e<p>f<table><tr><td>g<td>h<tr><td>i</table>") == list("abcdefghi")


def test_long_alignments_are_halved(monkeypatch):
    rng = random.Random(4)
    for table in (1, 40, 1 << 25):
        monkeypatch.setattr(html_text, "TABLE", table)
        for n in (5, 60):
            a, b = ([rng.randint(0, 6) for _ in range(n)] for _ in range(2))
            size = [[0] * (n + 1) for _ in range(n + 1)]
            for i, x in enumerate(a):
                for j, y in enumerate(b):
                    size[i + 1][j + 1] = size[i][j] + 1 if x == y else max(size[i][j + 1], size[i + 1][j])
            places, rest = sorted(html_text.common_places(a, b)), iter(b)
            assert len(places) == size[-1][-1] and all(a[i] in rest for i in places)
    import tracemalloc

    monkeypatch.undo()
    tracemalloc.start()
    html_text.common_places([rng.randint(0, 300) for _ in range(20_000)], [rng.randint(0, 300) for _ in range(20_000)])
    assert tracemalloc.get_traced_memory()[1] < 30e6
    tracemalloc.stop()


def test_pairs_and_texts_equal_plain_ones_across_partitions(spark):
    rng = random.Random(6)
    pages = []
    for i in range(300):
        host, path = rng.choice("abc"), "/".join(rng.choice("xyz") for _ in range(rng.randint(1, 4)))
        body = "".join(f"<div>{rng.choice(['Top', 'Menu', 'Line', 'End'])} {rng.randint(0, 2)}</div>" for _ in range(rng.randint(0, 9)))
        pages.append((i, f"http://{host}.org/{path}" + rng.choice(["", "?q=1", "#top"]), body + rng.choice(["", f"<article><p>Own {i % 7}</p></article>"])))
    split = lambda url: re.fullmatch(r"http://(.)\.org(/[^?#]*).*", url).groups()
    of = {}
    for i, url, page in pages:
        of.setdefault(split(url), [x for x in html_text.page_lines(page) if x[1] != html_text.CHROME])
    order = sorted(of)
    want = {}
    for i, url, page in pages:
        own, (host, path) = html_text.page_lines(page), split(url)
        at, shared = order.index((host, path)), set()
        sides = [order[j] for j in (at - 1, at + 1) if 0 <= j < len(order) and order[j][0] == host]
        common = lambda other: next((k for k, (x, y) in enumerate(zip(path.split("/"), other.split("/"))) if x != y), min(path.count("/"), other.count("/")) + 1)
        for side in sorted(sides, key=lambda s: -common(s[1])):
            shared = html_text.common_places([html_text._hash(t) for t, _ in own], [html_text._hash(t) for t, _ in of[side]])
            if not html_text._near(own, shared):
                break
        keep = set() if html_text._near(own, shared) else shared
        want[i] = "\n\n".join(t for k, (t, prior) in enumerate(own) if prior == html_text.MAIN or k not in keep)
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(7)
    assert {r.key: r.text for r in html_text.extract_text(df).collect()} == want
    assert len({v for v in want.values()}) > 100


def test_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(500):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(0, 12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        places = sorted(html_text.common_places(a, b))
        rest = iter(b)
        assert len(places) == table[-1][-1] and all(a[i] in rest for i in places)


def test_lines_shared_with_the_nearest_page_go(spark):
    page = lambda body: f"<body><div>Top of site</div><div>{body}</div><div>Bottom</div></body>"
    rows = [(i, f"https://H.org/{p}?q={i}", page(b), "x") for i, (p, b) in enumerate([("a/1", "one"), ("a/2", "two"), ("b/1", "three"), ("b/2", "four")])]
    rows += [(9, "https://other.org/a/1", page("alone"), "x"), (None, None, None, None), (7, "https://k.org/1", page("same"), "x"), (8, "https://k.org/2", page("same"), "x"), rows[0], (10, "https://z.org/1", "<article><p>Quoted</p></article>", "x"), (11, "https://z.org/2", "<article><p>Quoted</p><p>New</p></article>", "x")]
    got = html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    texts = sorted(((r.key, r.text) for r in got), key=repr)
    whole = "Top of site\n\n{}\n\nBottom"
    assert texts == sorted([(0, "one"), (0, "one"), (1, "two"), (2, "three"), (3, "four"), (9, whole.format("alone")), (None, ""), (7, whole.format("same")), (8, whole.format("same")), (10, "Quoted"), (11, "Quoted\n\nNew")], key=repr)


def test_unshared_lines_outside_of_a_card_stay_and_near_copies_are_not_paired(spark):
    page = lambda body: f"<body><div>Top of site</div><article><p>Card</p></article><div>{body}</div></body>"
    long = ["The same long story is told here by two pages of the host"] * 4
    copy = lambda end: "".join(f"<p>{x}</p>" for x in ["Top", *long, end])
    rows = [(1, "https://h.org/a/1", page("Own story")), (2, "https://h.org/a/2", page("Other story")), (3, "https://k.org/a/b/1", copy("x")), (4, "https://k.org/a/b/2", copy("y")), (5, "https://k.org/c", "<p>Top</p><p>Its own story</p>")]
    got = {r.key: r.text for r in html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == "Card\n\nOwn story" and got[2] == "Card\n\nOther story"
    assert got[3] == "\n\n".join(["Top", *long, "x"]) and got[4] == "\n\n".join([*long, "y"]) and got[5] == "Its own story"


def test_pages_equal_their_articles(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    import html

    got = {r.key: r.text for r in html_text.extract_text(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert got[r.page_id] == "\n\n".join(b for b in blocks if b)
    assert html_text.extract_text(pages.limit(0)).count() == 0


# Shards.


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_shards_are_gapless_balanced_and_keep_copies_together(spark, shards):
    docs = odd_docs(spark).unionByName(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").selectExpr("doc_id", "text", "lang", "source", "n_chars", "'' AS q_n", "1L AS size", "'' AS key", "'' AS d_items", "'' AS p_spans", "'' AS s_fp", "'' AS Q_KEPT").where("length(text) < 20000"))
    docs = docs.where("text IS NULL OR length(text) < 20000")
    rows = sharding.kd_shards(docs, shards, ["lang", "source"]).collect()
    size, of = Counter(), {}
    for s in range(shards):
        own = [r for r in rows if r.shard == s]
        assert sorted(r.slot for r in own) == list(range(len(own)))
        size[s] = sum(r.size for r in own)
    for r in rows:
        assert of.setdefault((r.size, r.text_crc32), r.shard) == r.shard
    want = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert Counter((r.key, r.size, r.text_crc32) for r in rows) == want
    assert max(size.values()) - min(size.values()) <= 0.08 * sum(size.values()) / shards


def test_one_hot_group_and_empty_tables_are_sharded(spark):
    docs = odd_docs(spark).limit(0)
    assert sharding.kd_shards(docs, 8, ["lang"]).count() == 0
    same = spark.range(50).selectExpr("id AS doc_id", "'same' AS text", "'en' AS lang")
    assert {r.shard for r in sharding.kd_shards(same, 4, ["lang"]).collect()}.__len__() == 1


def test_repetitions_meet_in_the_first_and_settle_each_for_itself():
    key = "7f3c5d9a1b2c3d4e5f6a"
    graph = pii.Graph()
    pii.add_document(graph, 0, f"a {key} b " * 4)
    hub = graph.skip[0][0]
    assert len(graph.skip) == 3 and {a for a, _ in graph.skip} == {hub}
    rng, size = np.random.default_rng(1), len(pii.LABELS)
    model = pii.fit(SECRETS + PLAIN)
    texts = [f"we set token = \"{key}\" in the old file. later {key} and {key} again", f"only {key} here", "12 rules of 2.0. and 7 parts", f"{key} " * 60]
    together, graph = {}, pii.Graph()
    for d, t in enumerate(texts):
        pii.add_document(graph, d, t)
    p, unsettled = pii.beliefs(graph, model)
    assert not unsettled
    for d, t in enumerate(texts):
        own = pii.Graph()
        pii.add_document(own, d, t)
        together[d] = p[[i for i, x in enumerate(graph.doc) if x == d]]
        assert np.allclose(together[d], pii.marginals(own, model), atol=1e-9)
    # strong opposed potentials on a loop may never settle: such documents are told, others are not
    wild = pii.Model({"f": 0}, np.zeros((1, size)), rng.normal(0, 30, (size, size)), -40 * np.eye(size))
    graph = pii.Graph([0] * 4 + [1], [(i, i + 1) for i in range(5)], [["f"]] * 5, [0] * 5, [(0, 1), (1, 2), (2, 3)], [(0, 2), (0, 3), (1, 3)])
    p, unsettled = pii.beliefs(graph, wild)
    assert unsettled <= {0} and np.isfinite(p).all()


def test_named_values_of_letters_are_found_without_any_in_the_training_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = pii.train(docs)
    for name in ("password", "api_key", "token"):
        for form in ("{} = {} is", "{}: {} is", '{}="{}" is', "the {} = {} is not for you. Later {} is seen in the file"):
            text = form.format(name, *["correcthorsebatterystaple"] * 2)
            (spans,) = pii.added_spans([text], [[]], model)
            values = [m.span() for m in re.finditer("correcthorsebatterystaple", text)]
            assert len(spans) == len(values) and all(kind == "secret" and b == y and a <= x for (kind, a, b), (x, y) in zip(spans, values)), text
    assert pii.added_spans(["the correcthorsebatterystaple of the Rechtsschutzversicherungsgesellschaften"], [[]], model) == [[]]


def test_spans_of_words_are_those_of_the_pattern():
    rng = random.Random(4)
    for _ in range(500):
        t = "".join(rng.choice(["a", "b1", " ", "\n", " ", "\x1c", "é"]) for _ in range(rng.randint(1, 12)))
        words = t.split()
        starts, ends = pii._spans(t, words, np.array([len(w) for w in words], "i8"))
        assert list(zip(starts.tolist(), ends.tolist())) == [m.span() for m in re.finditer(r"\S+", t)]
