"""Versioned and bucketed tables, graphs, inference, differences, suites, snapshots, catalog objects and SQL text, on small tables written by hand."""

import datetime
import decimal
import glob
import os
import random
import warnings

import pytest
from pyspark.sql import functions as F

from brindle.functions import redaction
from brindle.operators import compare, data_tests, incremental, lineage
from brindle.plans import models
from brindle.sources import seeds, sql_text, table_sets
from brindle.sources.shared import fresh_path, scratch
from brindle.streaming import upserts

KEYED = "k long, v string"


def keyed(spark, rows):
    return spark.createDataFrame(rows, KEYED)


def held(df):
    return sorted((r.k, r.v) for r in df.collect())


# Versions.


def files(path):
    return {os.path.relpath(f, path): os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/**/part-*", recursive=True)}


@pytest.mark.parametrize("kind", ["whole", "bucketed"])
def test_a_failed_write_leaves_the_table_readable_and_writable(spark, kind):
    path = fresh_path(spark, "t")
    target = incremental.BucketedTable(spark, path, ["k"], 4) if kind == "bucketed" else incremental.VersionedTable(spark, path)
    failing = keyed(spark, [(1, "x")]).withColumn("v", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception, match="no"):
        target.write(failing)  # even the first
    assert target.version() is None
    target.write(keyed(spark, [(1, "a"), (2, "b")]))
    for _ in range(2):
        with pytest.raises(Exception, match="no"):
            target.write(failing)
    assert held(target.read()) == [(1, "a"), (2, "b")]
    assert held(target.upsert(keyed(spark, [(2, "c"), (3, "d")]), ["k"])) == [(1, "a"), (2, "c"), (3, "d")]
    os.makedirs(f"{path}/version-notes")  # another folder is no version
    assert held(target.upsert(keyed(spark, [(3, "e")]), ["k"])) == [(1, "a"), (2, "c"), (3, "e")]
    gone = target.clear()
    assert len(gone) >= (3 if kind == "whole" else 0) and held(target.read()) == [(1, "a"), (2, "c"), (3, "e")] and target.clear() == []


def test_an_upsert_of_one_bucket_leaves_the_files_of_all_others(spark):
    path = fresh_path(spark, "t")
    target = incremental.BucketedTable(spark, path, ["k"], 8)
    target.first_run(keyed(spark, [(i, "a") for i in range(200)]), ["k"])
    before, layout = files(path), target.layout()
    (bucket,) = target.touched(keyed(spark, [(7, "z")]))
    assert held(target.upsert(keyed(spark, [(7, "z")]))) == sorted((i, "z" if i == 7 else "a") for i in range(200))
    now = files(path)
    assert before.items() <= now.items()  # nothing written before was touched
    assert {f.split("/")[1] for f in now.keys() - before.keys()} == {f"_bucket={bucket}"}
    assert {b for b, p in target.layout().items() if p != layout[b]} == {bucket}
    assert target.counts == {"inserted": 0, "updated": 1}
    target.upsert(keyed(spark, [(7, "y"), (1000, "n"), (1001, "n")]))
    assert target.counts == {"inserted": 2, "updated": 1}
    assert target.clear() == ["v1-part"]  # its one bucket was written again
    held_files = [f for f in target.read([bucket]).inputFiles()]
    assert held_files and all(f"_bucket={bucket}" in f for f in held_files)
    assert held(target.upsert(keyed(spark, []))) == held(target.read()) and target.counts == {"inserted": 0, "updated": 0}


def test_bucketed_tables_refuse_bad_keys_keep_their_number_and_take_over_plain_ones(spark):
    path = fresh_path(spark, "t")
    incremental.VersionedTable(spark, path).write(keyed(spark, [(1, "a"), (2, "b")]))
    target = incremental.BucketedTable(spark, path, ["k"], 3)
    assert held(target.upsert(keyed(spark, [(2, "c")]))) == [(1, "a"), (2, "c")]
    assert incremental.BucketedTable(spark, path, ["k"], 99).buckets() == 3
    for rows in ([(1, "a"), (1, "b")], [(None, "a")]):
        with pytest.raises(ValueError, match="null or repeated"):
            target.upsert(keyed(spark, rows))
    assert held(incremental.VersionedTable(spark, path).read()) == [(1, "a"), (2, "c")]
    assert held(incremental.VersionedTable(spark, path).write(keyed(spark, [(9, "z")]))) == [(9, "z")]


def test_upserts_of_random_deltas_equal_a_dictionary(spark):
    target, plain, draw = incremental.BucketedTable(spark, fresh_path(spark, "t"), ["k"], 5), {}, random.Random(1)
    for n in range(6):
        delta = {draw.randrange(30): f"{n}" for _ in range(draw.randrange(1, 12))}
        plain |= delta
        assert held(target.upsert(keyed(spark, list(delta.items())))) == sorted(plain.items())


def test_stream_upserts_do_not_depend_on_the_order_of_batches(spark):
    rows = [(1, 5, "a"), (1, 5, "b"), (2, 1, "x"), (2, 3, None), (2, 3, "y")]
    results = set()
    for order in (rows, rows[::-1], rows[2:] + rows[:2]):
        path = fresh_path(spark, "in")
        for k, row in enumerate(order):
            spark.createDataFrame([row], "k long, t long, v string").coalesce(1).write.mode("append").parquet(path)
            for f in glob.glob(f"{path}/part-*"):  # files are read by their time
                os.utime(f, (1_700_000_000 + k, 1_700_000_000 + k)) if os.stat(f).st_mtime > 1_700_001_000 else None
        target = incremental.BucketedTable(spark, fresh_path(spark, "t"), ["k"], 2)
        stream = upserts.file_stream(spark, path, "k long, t long, v string")
        upserts.stream_upsert(stream, target, "t", fresh_path(spark, "marks")).awaitTermination()
        results.add(tuple(sorted((r.k, r.t, r.v) for r in target.read().collect())))
    assert results == {((1, 5, "b"), (2, 3, "y"))}


# Graphs.


def edges_of(spark, pairs):
    return spark.createDataFrame(pairs, "parent long, child long")


def nodes_of(spark, nodes):
    return spark.createDataFrame([(n,) for n in nodes], "node long")


def test_a_chain_of_4096_takes_at_most_14_rounds(spark, monkeypatch):
    rounds, whole = [], lineage._advance
    monkeypatch.setattr(lineage, "_advance", lambda *x: rounds.append(1) or whole(*x))
    pairs = spark.range(4096).select(F.col("id").alias("parent"), (F.col("id") + 1).alias("child"))
    found = lineage.closure(pairs, nodes_of(spark, [0]))
    assert found.where("depth = node").count() == found.count() == 4097 and len(rounds) <= 14


def plain_closure(pairs, start):
    seen, front = {s: 0 for s in start}, set(start)
    while front:
        front = {b for a, b in pairs if a in front} - seen.keys()
        seen |= {n: max(seen.values()) + 1 for n in front}
    return seen


@pytest.mark.parametrize("few", [0, 30, 100_000])
def test_closures_equal_breadth_first_search_with_long_jumps_and_without(spark, monkeypatch, few):
    monkeypatch.setattr(lineage, "FEW", few)
    monkeypatch.setattr(lineage, "GROWTH", 0 if few == 0 else 4)
    draw = random.Random(few)
    for n, m in ((30, 40), (60, 70), (12, 60)):
        pairs = [(draw.randrange(n), draw.randrange(n)) for _ in range(m)] + [(i, i + 1) for i in range(100, 120)] + [(0, 100), (None, 3), (3, None)]
        found = {r.node: r.depth for r in lineage.closure(edges_of(spark, pairs), nodes_of(spark, [0, 5])).collect()}
        assert found == plain_closure([p for p in pairs if None not in p], [0, 5])


def plain_components(pairs):
    nodes = {n for p in pairs for n in p}
    reach = {n: set(plain_closure(pairs, {b for a, b in pairs if a == n})) for n in nodes}
    return {n: min(m for m in reach[n] if n in reach[m]) for n in nodes if n in reach[n]}


@pytest.mark.parametrize("seed", range(3))
def test_cycles_equal_mutual_reachability(spark, seed):
    draw = random.Random(seed)
    pairs = [(draw.randrange(14), draw.randrange(14)) for _ in range(17)] + [(20, 21), (21, 22), (22, 20), (22, 23), (23, 24), (19, 20), (30, 30), (30, 31), (24, 40), (40, 41), (41, 40)]
    assert {r.node: r.component for r in lineage.cycles(edges_of(spark, pairs)).collect()} == plain_components(pairs)


def test_acyclic_edges_have_no_cycles_and_the_error_names_members_only(spark):
    assert lineage.cycles(edges_of(spark, [(1, 2), (2, 3), (1, 3)])).count() == 0 and lineage.cycles(edges_of(spark, [])).count() == 0
    pairs = [("in", "c1"), ("c1", "c2"), ("c2", "c3"), ("c3", "c1"), ("c3", "a1"), ("a1", "a2"), ("d1", "d2"), ("d2", "d1"), ("d2", "c1")]
    edges = spark.createDataFrame(pairs, "parent string, child string")
    nodes = spark.createDataFrame([(n,) for n in sorted({n for p in pairs for n in p})], "node string")
    with pytest.raises(ValueError) as raised:
        lineage.layers(edges, nodes)
    assert str(raised.value) == "the edges have a cycle among ['c1', 'c2', 'c3', 'd1', 'd2']"
    assert {r.layer for r in lineage.load_layers(edges, nodes).collect()} == {0}


def test_load_layers_ignore_references_to_oneself(spark):
    edges, nodes = edges_of(spark, [(1, 1), (1, 2), (2, 3), (1, 3)]), nodes_of(spark, [1, 2, 3, 4])
    assert {r.node: r.layer for r in lineage.load_layers(edges, nodes).collect()} == {1: 0, 4: 0, 2: 1, 3: 2}


def test_write_order_puts_parents_first_and_falls_back_to_names(spark):
    names = ["a.orders", "a.customer", "a.nation", "b.lines"]
    references = [("a.orders", "a.customer"), ("b.lines", "a.orders"), ("a.customer", "a.nation"), ("a.customer", "a.customer"), ("a.orders", "z.elsewhere"), ("z.other", "a.nation")]
    assert table_sets.write_order(names, references) == ["a.nation", "a.customer", "a.orders", "b.lines"]
    assert table_sets.write_order(["y", "x"]) == ["x", "y"]
    with pytest.warns(UserWarning, match="cycle"):
        assert table_sets.write_order(names, [*references, ("a.nation", "b.lines")]) == sorted(names)
    tables = {n: keyed(spark, [(1, "a")]) for n in ("s.child", "s.parent")}
    assert table_sets.anonymise_dump(tables, [], "s", fresh_path(spark, "d"), [("s.child", "s.parent")]) == ["s.parent", "s.child"]


# Inference.


@pytest.mark.parametrize(
    ("values", "kind"),
    [
        (["12345678901234567890", "1"], "numeric"), (["9" * 38], "numeric"), (["9" * 39], "text"), ([".", "1.5"], "text"), (["-"], "text"), (["1.", ".5", "-.5"], "numeric"), (["2024-13-45"], "text"), (["2023-02-29"], "text"),
        (["2024-02-29"], "date"), (["2024-01-15 25:00"], "text"), (["9" * 20 + ".5", "0." + "1" * 19], "text"), (["007", "9223372036854775807"], "bigint"), (["9223372036854775808"], "numeric"), (["2024-01-15", "2024-01-15 10:00"], "text"),
    ],
)
def test_whatever_is_inferred_is_cast(spark, values, kind):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    types = {r["column"]: r["type"] for r in seeds.infer_types(df, None).collect()}
    assert types == {"v": kind}
    assert [r.v is not None for r in seeds.apply_schema(df, types).collect()] == [True] * len(values)
    assert seeds.validate(df, types).first().failures == 0


def test_random_columns_are_inferred_and_cast(spark):
    draw = random.Random(2)
    columns = {f"c{k}": ["".join(draw.choice("0019.-: T2aZ+{}[]") for _ in range(draw.randint(1, draw.choice([3, 12, 25])))) for _ in range(draw.randint(1, 4))] for k in range(60)}
    columns |= {f"d{k}": [draw.choice(["-", ""]) + str(draw.randrange(10 ** draw.randint(1, 40))) + draw.choice(["", ".", "." + str(draw.randrange(10**9))]) for _ in range(3)] for k in range(30)}
    df = spark.createDataFrame([tuple(v[i] if i < len(v) else None for v in columns.values()) for i in range(4)], ", ".join(f"{c} string" for c in columns))
    seeds.apply_schema(df, {r["column"]: r["type"] for r in seeds.infer_types(df, None).collect()}).collect()


def test_a_seed_without_schema_file_is_a_warning(spark):
    df = spark.createDataFrame([("1", "x")], "a string, b string")
    with pytest.warns(UserWarning, match="no schema file"):
        assert [(r["column"], r.type, r.origin) for r in seeds.validate_seed(df).collect()] == [("a", "bigint", "inferred"), ("b", "text", "inferred")]
    with pytest.warns(UserWarning, match="no schema file"):
        assert seeds.validate(df).count() == 2
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        assert [r.origin for r in seeds.validate_seed(df, {"a": "int"}).collect()] == ["schema", "inferred"]
    with pytest.raises(ValueError, match="no such columns"):
        seeds.validate(df, {"c": "int"})


# Differences.


def test_row_diff_compares_bags(spark):
    a = keyed(spark, [(1, "a"), (1, "a"), (1, "b"), (2, "x"), (2, "x"), (3, None), (None, "n"), (None, "n")])
    assert compare.row_diff(a, a, ["k"]).count() == 0
    b = keyed(spark, [(1, "b"), (1, "a"), (1, "b"), (2, "x"), (3, "k"), (None, "n"), (None, "n"), (4, "q"), (4, "q")])
    assert sorted((r.k or 0, r.change) for r in compare.row_diff(a, b, ["k"]).collect()) == [(1, "changed"), (2, "changed"), (3, "changed"), (4, "added")]


def test_row_diff_sees_columns_that_one_side_lost(spark):
    a, b = keyed(spark, [(1, "a"), (2, None)]), keyed(spark, [(1, "a"), (2, None)]).drop("v")
    assert [(r.k, r.change) for r in compare.row_diff(a, b, ["k"]).collect()] == [(1, "changed")]
    assert compare.column_diff(a, b) == [("v", "removed")] and compare.column_diff(b, a) == [("v", "added")]
    found = {r.change: (r.rows, r.examples) for r in compare.row_diff_summary(a, b.withColumn("w", F.lit(None).cast("int")), ["k"]).collect()}
    assert found == {"changed": (1, ["1"]), "column removed": (None, ["v"]), "column added": (None, ["w"])}


def test_schema_diff_sees_defaults(spark):
    a = compare.with_default(keyed(spark, []), "v", "'x'")
    rows = lambda df: compare.schema_rows(spark, {"t": df})
    assert [r[:] for r in compare.schema_diff(rows(a), rows(keyed(spark, []))).collect()] == [("t.v", "column modified", "string default 'x'", "string")]
    assert {tuple(r[:]) for r in compare.schema_diff_summary(rows(a), rows(keyed(spark, []))).collect()} == {("table", 0, 0, 0), ("column", 0, 0, 1)}


# Suites.


def test_a_suite_scans_a_table_as_often_however_many_tests_it_has(spark):
    df = spark.range(100).selectExpr("id AS a", "id % 7 AS b", "cast(id AS string) AS c", "id % 2 AS d")
    refs = spark.range(50).selectExpr("id AS r", "cast(id AS string) AS s")
    t = data_tests.Test
    unique = [t("unique", c) for c in (("a",), ("b",), ("c", "d"), ("d", "c"), ("b", "d"))]
    related = [t("relationships", ("a",), ref=refs, ref_column="r"), t("relationships", ("b",), ref=refs, ref_column="r"), t("relationships", ("c",), ref=refs, ref_column="s")]
    plan = lambda found: found._jdf.queryExecution().optimizedPlan().toString()
    assert plan(data_tests.unique_counts(df, unique)).count("Range (0, 100") == plan(data_tests.unique_counts(df, unique[:1])).count("Range (0, 100") == 1
    assert plan(data_tests.relationship_counts(df, related)).count("Range (0, 100") == 1
    found = [(r.test, r.violations, r.status) for r in data_tests.suite({"m": (df, [*unique, *related, t("not_null", ("a",))])}).collect()]
    assert found == [("unique(a)", 0, "pass"), ("unique(b)", 7, "fail"), ("unique(c, d)", 0, "pass"), ("unique(d, c)", 0, "pass"), ("unique(b, d)", 14, "fail"), ("relationships(a)", 50, "fail"), ("relationships(b)", 0, "pass"), ("relationships(c)", 50, "fail"), ("not_null(a)", 0, "pass")]


def test_fused_tests_count_nulls_and_types_as_single_ones_do(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (None, "a", 2.0), (None, "a", None), (2, None, 1.0), (2, None, 5.0)], "k long, v string, x double")
    ref = spark.createDataFrame([(1, 1.0)], "r int, y double")
    t = data_tests.Test
    tests = [t("unique", ("k",)), t("unique", ("v",)), t("unique", ("k", "v")), t("relationships", ("k",), ref=ref, ref_column="r"), t("relationships", ("x",), ref=ref, ref_column="y"), t("relationships", ("x",), ref=ref, ref_column="none")]
    single = [data_tests._count(lambda x=x: data_tests._violating(df, x)) for x in tests]
    assert [r.violations for r in data_tests.suite({"m": (df, tests)}).collect()] == single == [2, 2, 2, 2, 2, None]
    assert data_tests.suite({"m": (df.limit(0), tests[:5])}).where("violations <> 0").count() == 0


# Snapshots.


def test_snapshots_refuse_changed_files_and_keep_the_last_whole_save(spark):
    root = fresh_path(spark, "s")
    first = compare.with_default(keyed(spark, [(1, "a"), (2, None)]), "v", "'q'")
    manifest = table_sets.snapshot_save(spark, {"d.t": first}, "x", root).first()
    assert manifest.rows == 2 and manifest.bytes > 0 and manifest.digest and '"tables": []' in manifest.profile
    with pytest.raises(Exception, match="no"):
        table_sets.snapshot_save(spark, {"d.t": first.withColumn("v", F.raise_error(F.lit("no")).cast("string"))}, "x", root)
    back = table_sets.snapshot_read(spark, "x", root)["d.t"]
    assert held(back) == [(1, "a"), (2, None)] and back.schema["v"].metadata == {"default": "'q'"}
    folder = f"{root}/x/{manifest.path}"
    keyed(spark, [(1, "a"), (2, "")]).write.mode("overwrite").parquet(folder)  # as many rows, another value
    with pytest.raises(ValueError, match="manifest"):
        table_sets.snapshot_restore(spark, "x", root, confirmed=True)
    table_sets.snapshot_save(spark, {"d.t": keyed(spark, [(9, "z")])}, "x", root)
    assert held(table_sets.snapshot_read(spark, "x", root)["d.t"]) == [(9, "z")]
    assert [(r.snapshot, r.tables, r.rows) for r in table_sets.snapshot_list(spark, root).collect()] == [("x", 1, 1)]


# The catalog.


def test_catalog_objects_change_kind_both_ways_and_other_sessions_read_them(spark):
    schema = "cat_" + os.path.basename(fresh_path(spark, "x"))[-8:]
    model = lambda kind, sql: models.Model(f"{schema}.o", kind=kind, sql=sql)
    other = spark.newSession()
    for kind, sql, value in (("view", "SELECT 1 AS a", 1), ("table", "SELECT 2 AS a", 2), ("table", f"SELECT a + 1 AS a FROM {schema}.o", 3), ("view", "SELECT 4 AS a", 4), ("view", "SELECT 5 AS a", 5)):
        models.put(spark, model(kind, sql))
        other.catalog.refreshTable(f"{schema}.o")
        assert models.object_kind(other, f"{schema}.o") == kind and other.table(f"{schema}.o").first().a == value
    with pytest.raises(ValueError, match="is a view, not a table"):
        models.put(spark, model("table", "SELECT 6 AS a"), change_kind=False)
    for kind in ("view", "table"):
        with pytest.raises(Exception, match="no_such"):
            models.put(spark, model(kind, "SELECT no_such FROM nowhere"))
        assert spark.table(f"{schema}.o").first().a == 5
    project = {m.name: m for m in (model("view", "SELECT 7 AS a"), models.Model(f"{schema}.p", kind="table", sql=f"SELECT a FROM {schema}.o", deps=(f"{schema}.o",)))}
    assert [(r.model.split(".")[1], r.result, r.rows) for r in models.run_pipeline(spark, project, fresh_path(spark, "p")).collect()] == [("o", "ok", 1), ("p", "ok", 1)]
    assert {r.state for r in models.pipeline_status(spark, project, fresh_path(spark, "p")).collect()} == {"synced"}
    assert [r.state for r in models.pipeline_status(spark, {f"{schema}.o": model("table", "SELECT 1")}, "").collect()] == ["type mismatch"]
    with pytest.raises(ValueError, match="SQL text"):
        models.Model("a.b")


# SQL text.


def test_a_dump_as_sql_text_is_read_back_by_another_engine(spark):
    duckdb = pytest.importorskip("duckdb")
    when = datetime.datetime(2024, 2, 29, 23, 59, 59, 123456)
    rows = [
        (1, "it's; \"q\"\nx", True, decimal.Decimal("-1.50"), 0.1, when.date(), when, when, bytearray(b"\x00'\xff"), ["a'", None]), (None,) * 10,
        (-(2**63), "", False, decimal.Decimal(0), float("inf"), datetime.date(1, 1, 1), datetime.datetime(1970, 1, 1), datetime.datetime(1970, 1, 1), bytearray(), []),
        (2**63 - 1, "ü\\ 𝒳 --", None, None, 1e-300, None, None, None, None, ["x, y", "]"]),
    ]
    df = spark.createDataFrame(rows, "a long, `b c` string, d boolean, e decimal(9,2), f double, g date, h timestamp_ntz, i timestamp, j binary, k array<string>")
    path = fresh_path(spark, "sql")
    sql_text.write_inserts(df, 'main.t"t', path)
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute('CREATE TABLE "t""t" (a BIGINT, "b c" VARCHAR, d BOOLEAN, e DECIMAL(9,2), f DOUBLE, g DATE, h TIMESTAMP, i TIMESTAMPTZ, j BLOB, k VARCHAR[])')
    for f in glob.glob(f"{path}/part-*"):
        con.execute(open(f, encoding="utf-8").read())
    got = con.execute('SELECT a, "b c", d, e, f, g, h, CAST(i AS TIMESTAMP), j, k FROM "t""t"').fetchall()
    plain = lambda rs: sorted(repr([bytes(x) if isinstance(x, (bytes, bytearray)) else x for x in r]) for r in rs)
    assert plain(got) == plain(rows)


@pytest.mark.parametrize(
    ("dsn", "shown"),
    [
        ("postgres://u:p@h:5432/db?sslpassword=s3@cret", "postgres://u:***@h:5432/db"), ("postgres://h:5432/db?email=a@b", "postgres://h:5432/db"), ("postgres://u:p@s@h/db", "postgres://u:***@h/db"), ("postgres://u:@h/db", "postgres://u:***@h/db"),
        ("postgres://u@h/db?password=x", "postgres://u@h/db"), ("postgres://u:a\nb@h/db?c=\nd@e", "postgres://u:***@h/db"), ("u:secret@h/db", "***REDACTED***"), ("postgres://[::1]:5432/db", "postgres://[::1]:5432/db"),
        ("postgres://u:p#w@h/db", "postgres://u:***@h/db"), ("host=h password = s3cret user=u", "host=h password = *** user=u"), ("h?password=x", "h"), (None, None), ("", ""),
    ],
)
def test_redact_dsn_shapes(spark, dsn, shown):
    assert spark.createDataFrame([(dsn,)], "v string").select(redaction.redact_dsn(F.col("v"))).first()[0] == shown


def test_what_a_run_writes_between_steps_goes_at_its_end(spark):
    out = fresh_path(spark, "kept")
    with scratch(spark) as folder:
        lineage.closure(edges_of(spark, [(0, 1), (1, 2)]), nodes_of(spark, [0])).write.parquet(out)
        assert len(os.listdir(folder)) >= 3
    assert not os.path.exists(folder) and spark.read.parquet(out).count() == 3
    with pytest.raises(ValueError), scratch(spark) as folder:
        lineage.layers(edges_of(spark, [(0, 0)]), nodes_of(spark, [0]))
    assert not os.path.exists(folder) and not os.path.dirname(fresh_path(spark, "x")).startswith(folder)
