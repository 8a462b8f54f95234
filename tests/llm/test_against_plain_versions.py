"""Packing step by step, the k-d tree, indexes, stars, templates, addresses and every registered query, against plain versions."""

import hashlib
import random
from collections import Counter

import pytest

from brindle.llm import chat, decontamination, fm_index, html_text, packing, record_files, registry, sharding, simhash
from conftest import DATA, duck_rows, rows_of


# Packing: the plan of runs is what filling one sequence after the other gives.


def single_steps(counts, capacity):
    left, sizes = Counter(counts), []
    while left := +left:
        longest = max(left)
        left[longest] -= 1
        taken = Counter(packing.fullest(dict(left), capacity - longest))
        left -= taken
        taken[longest] += 1
        sizes.append(tuple(sorted(taken.elements())))
    return Counter(sizes)


def test_the_plan_equals_single_steps():
    draw = random.Random(4)
    for _ in range(300):
        capacity = draw.choice([7, 16, 40])
        counts = {draw.randint(1, capacity): draw.randint(1, 9) for _ in range(draw.randint(0, 8))}
        placed, ranks = {}, {k: set() for k in counts}
        runs = packing.plan(counts, capacity)
        for i, (length, first, sequence, offset) in enumerate(runs):
            end = runs[i + 1][1] if i + 1 < len(runs) and runs[i + 1][0] == length else counts[length]
            for rank in range(first, end):
                ranks[length].add(rank)
                placed.setdefault(sequence + rank - first, []).append((offset, length))
        assert all(ranks[k] == set(range(n)) for k, n in counts.items())
        for own in placed.values():
            at = 0
            for offset, length in sorted(own):
                assert offset == at
                at += length
            assert at <= capacity
        assert Counter(tuple(sorted(x for _, x in own)) for own in placed.values()) == single_steps(counts, capacity)


# Sharding: the tree on one machine.


def plain_tree(groups, shards):
    """groups: digest -> (bytes, places, tail). Shard of each, by weighted quantiles of the widest dimension."""
    dims = len(next(iter(groups.values()))[1])
    extents = [max(g[1][d] for g in groups.values()) - min(g[1][d] for g in groups.values()) for d in range(dims)]
    shard = {}

    def split(own, k, first):
        if k == 1 or not own:
            shard.update(dict.fromkeys(own, first))
            return
        share = [(max(groups[x][1][d] for x in own) - min(groups[x][1][d] for x in own)) / extents[d] if extents[d] else 0.0 for d in range(dims)]
        d = share.index(max(share))
        place = {x: (groups[x][1][d] << sharding.TAIL) + groups[x][2] for x in own}
        total, upto, half = sum(groups[x][0] for x in own), 0, k // 2
        at = Counter()
        for x in own:
            at[place[x]] += groups[x][0]
        for cut in sorted(at):
            if k * (upto + at[cut]) >= half * total:
                break
            upto += at[cut]
        if k * (2 * upto + at[cut]) > 2 * half * total:
            cut -= 1
        split([x for x in own if place[x] <= cut], half, first)
        split([x for x in own if place[x] > cut], k - half, first + half)

    split(list(groups), shards, 0)
    return shard


@pytest.mark.parametrize("shards", [2, 5, 8])
def test_shards_equal_those_of_a_plain_tree(spark, shards):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source")
    bits = lambda t: int(hashlib.md5(t.encode()).hexdigest()[:7], 16)
    groups = {}
    for r in docs.collect():
        t = r.text or ""
        size, digest = len(t.encode()) + 1, hashlib.md5(t.encode()).hexdigest()
        places = [min(size, (1 << sharding.PLACE) - 1), *(0 if v is None else bits(v) for v in (r.lang, r.source))]
        held = groups.get(digest)
        groups[digest] = (size + held[0], [min(a, b) for a, b in zip(held[1], places)], held[2]) if held else (size, places, int(digest[:7], 16))
    want = plain_tree(groups, shards)
    text_of = {r.doc_id: hashlib.md5((r.text or "").encode()).hexdigest() for r in docs.collect()}
    assert {r.key: r.shard for r in sharding.kd_shards(docs, shards, ["lang", "source"]).collect()} == {k: want[d] for k, d in text_of.items()}


# Decontamination: one index a shard, whatever the blocks.


def test_a_shard_is_indexed_once_for_all_blocks(spark, monkeypatch):
    built, whole = [], fm_index.FMIndex
    monkeypatch.setattr(fm_index, "FMIndex", lambda *x: built.append(1) or whole(*x))
    draw = random.Random(9)
    texts = [[draw.choice([b"a", b"b", b"c", b"zz"]) for _ in range(draw.randint(0, 40))] for _ in range(30)]
    items = [(f"i{k}", [draw.choice([b"a", b"b", b"c"]) for _ in range(draw.randint(0, 6))]) for k in range(12)]
    known = bytearray(decontamination.KNOWN_BITS // 8)
    for w in (b"a", b"b", b"c"):
        place = decontamination._place(w)
        known[place >> 3] |= 1 << (place & 7)
    shard = decontamination.Shard(texts, bytes(known))
    for k in range(0, 12, 3):
        shard.search(decontamination.Block(items[k : k + 3], 4))
    assert len(built) == 1
    for d, words in enumerate(texts):
        hit, own = set(), set()
        for name, item in items:
            n = min(4, len(item))
            for i in range(len(words) - n + 1) if n else ():
                if any(words[i : i + n] == item[j : j + n] for j in range(len(item) - n + 1)):
                    hit |= set(range(i, i + n))
                    own.add(name)
        start = shard.starts[d]
        assert {i for i in range(len(words)) if shard.hit[start + i]} == hit and shard.items[d] == own


# Components: hubs.


def test_components_of_hubs_and_chains(spark):
    draw = random.Random(2)
    edges = {(k, 0) for k in range(1, 400)} | {(k + 1, k) for k in range(1000, 1040)} | {(2000 + k, 1040) for k in range(5)} | {tuple(sorted((draw.randrange(3000, 3200), draw.randrange(3000, 3200)), reverse=True)) for _ in range(120)}
    edges = {(u, v) for u, v in edges if u != v}
    root = {n: n for e in edges for n in e}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for u, v in edges:
        a, b = sorted((find(u), find(v)))
        root[b] = a
    found = {r.node: r.root for r in simhash.components(spark.createDataFrame(list(edges), "u long, v long")).collect()}
    assert found == {n: find(n) for n in root if find(n) != n}


# Templates.


def test_templates_whose_marks_a_text_could_hold_are_refused():
    marks = {"opening": "### {role}:\n", "closing": "\n---\n"}
    for bad in (marks, {"opening": "<s>"}, {"opening": "{role}]"}, {"closing": ""}, {"closing": "end"}, {"escapes": (("<", "\\l"),)}, {"escapes": (("\\", "\\\\"), ("<", "l"), ("[", "\\b"), ("]", "\\r"))}, {"escapes": (("\\", "\\\\"), ("l", "\\<"), ("<", "\\l"))}):
        with pytest.raises(ValueError):
            chat.Template(**bad)
    template = chat.Template(**marks, escapes=None)
    assert template.guards == "#-:" and chat.Template(escapes=None).guards == "<]"
    draw = random.Random(8)
    for t in (template, chat.Template(), chat.Template(escapes=None), chat.Template(opening="a{{ {role} |b", closing="c", escapes=None), chat.Template(opening="\n{role}\n", closing="\n\n", escapes=None)):
        for _ in range(100):
            turns = [("".join(draw.choice("ab\\:#-<[]|{}\n c") for _ in range(draw.randint(0, 9))), draw.choice(["", t.closing, t.opening, "\n", t.closing + t.opening.replace("{role}", "user")]) + "".join(draw.choice("ab\\:#-<[]|{}\n c") for _ in range(draw.randint(0, 9)))) for _ in range(draw.randint(0, 4))]
            assert t.parse("".join(s["text"] for role, text in turns for s in t.segments(role, text))) == turns


def test_chats_equal_their_sql_on_odd_rows(spark):
    duckdb = pytest.importorskip("duckdb")
    rows = [(1, 0, "system", "a [b] <c> \\"), (1, 1, "user", None), (1, 2, "assistant", "é\n</s>"), (2, 5, "assistant", ""), (3, 0, "user", "x"), (3, 1, "assistant", "y]")]
    schema = "conv_id long, turn long, role string, text string"
    folder = record_files.fresh_path(spark, "chats")
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet/*.parquet'")
    assert rows_of(registry.QUERIES["op10_chat_format"](spark, folder)) == duck_rows(con, registry.ORACLES["op10_chat_format"])


# Record files: addresses.


@pytest.mark.parametrize(
    ("address", "shown"),
    [("/a/b", "/a/b"), ("file:/a/b", "file:///a/b"), ("file:///a", "file:///a"), ("s3a://k/a b", "s3://k/a b"), ("s3n://k", "s3://k"), ("abfss://c@h/x", "abfs://c@h/x"), ("hdfs://h:8020/a:b", "hdfs://h:8020/a:b"), ("/a:b/c", "/a:b/c")],
)
def test_hadoop_addresses_are_those_of_arrow(address, shown):
    assert record_files.arrow_address(address) == shown


def test_an_address_that_tasks_cannot_open_fails_at_once(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    with pytest.raises(ValueError, match="nowhere"):
        record_files.write_records(docs, "nowhere://x/y", "no tokenizer", True, 1)


# Pages.


def page_text(page):
    return html_text.main_text(html_text.page_lines(page), set())


@pytest.mark.parametrize(
    "inside", ["<div class='content sidebar-right'>{}</div>", "<section id='cookies'>{}</section>", "<section class='dinner-menu'>{}</section>", "<section class='job-promotion'>{}</section>", "<dir><li>{}</li></dir>", "<div id='comments'>{}</div>", "<p class='ad'>{}</p>"]
)
def test_articles_keep_what_compounds_and_ids_name(inside):
    for around in ("<article>{}</article>", "<main>{}</main>"):
        assert page_text(around.format("<p>One</p>" + inside.format("Two"))) == "One\n\nTwo"


def test_inline_chrome_is_cut_out_of_its_block():
    assert page_text("<article><p>one <span class='ad'>buy</span> two</p></article>") == "one two"
    assert page_text("<article><p>one<button>x</button>two <b>three</b></p><p>four</p></article>") == "one two three\n\nfour"
    assert page_text("<article><p>one <span class='ad'>buy<div>more</div></span> two</p></article>") == "one\n\ntwo"
    assert page_text("<p>one <span class='widget'>buy</span> two</p>") == "one two"
    assert page_text("<nav>a <span class='ad'>b</span> c</nav><p>d") == "d"


def test_pages_of_one_path_are_spread(spark):
    rows = [(i, f"http://h/a?q={i}", f"<p>shared line</p><p>own {i}</p>") for i in range(300)] + [(1000, "http://h/b", "<p>shared line</p><p>other</p>"), (None, None, None), (None, None, "<p>x")]
    found = html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert "salt" in found._jdf.queryExecution().toString()
    got = {r.key: r.text for r in found.where("key IS NOT NULL").collect()}
    assert got == {**{i: f"own {i}" for i in range(300)}, 1000: "other"}
    assert sorted(r.text for r in found.where("key IS NULL").collect()) == ["", "x"]


# Every registered query runs.


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_registered_queries_give_a_row_for_each_of_theirs(spark, name):
    found = registry.QUERIES[name](spark, DATA)
    key = {"op2_page_text": ("page_id", "pages"), "op10_chat_format": ("conv_id", "conversations"), "op12_spelling_variants": ("word", None), "op13_collocations": ("lang", None)}.get(name, ("doc_id", "documents"))
    keys = {r[0] for r in found.select(key[0]).distinct().collect()}
    assert keys if key[1] is None else keys - {-1} == {r[0] for r in spark.read.parquet(f"{DATA}/{key[1]}.parquet").select(key[0]).distinct().collect()}
