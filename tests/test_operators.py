"""Exact values, properties and failures of the library's operators, on small tables written by hand."""

import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brindle.functions import anonymise, redaction
from brindle.operators import activity, compare, data_tests, incremental, lineage
from brindle.plans import models
from brindle.sources import seeds, table_sets
from brindle.sources.shared import fresh_path


def column(spark, values, name="v"):
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


@pytest.mark.parametrize(
    ("values", "kind"),
    [
        (["true", "FALSE", "t", "f"], "boolean"), (["yes"], "text"), (["1", "0"], "bigint"), (["-7", "007"], "bigint"), (["1", "2.5"], "numeric"), (["12.34.56"], "text"),
        (["550e8400-e29b-41d4-a716-446655440000"], "uuid"), (["550e8400e29b41d4a716446655440000"], "text"), (["2024-01-15", None], "date"), (["2024-1-15"], "text"),
        (["2024-01-15T10:00:00Z", "2024-01-15 10:00:00.5+00", "2024-01-15 10:00"], "timestamptz"), (['{"a": 1}', "[1, 2]"], "jsonb"), (["{incomplete"], "text"), (["1", "two", "3"], "text"), ([None, None], "text"), ([], "text"),
    ],
)
def test_type_ladder(spark, values, kind):
    assert [r.type for r in seeds.infer_types(column(spark, values)).collect()] == [kind]


def test_inference_looks_at_the_sample_only_if_told_to(spark):
    df = column(spark, ["1"] * 5 + ["x"]).coalesce(1)
    assert seeds.infer_types(df, 5).first().type == "bigint"
    assert seeds.infer_types(df, None).first().type == "text"


def test_ragged_rows_raise(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n1,2\n3\n")
    with pytest.raises(Exception, match="FAILFAST|Malformed|MALFORMED"):
        seeds.read_csv(spark, str(tmp_path)).collect()


def test_decimals_keep_the_digits_the_data_has(spark):
    df = seeds.apply_schema(column(spark, ["1.25", "-3", "0.125"]), {"v": "numeric"})
    assert df.dtypes == [("v", "decimal(38,3)")]
    long = "0.1234567890123456789012345"
    (row,) = seeds.apply_schema(column(spark, [long]), {"v": "numeric"}).collect()
    assert str(row.v) == long
    with pytest.raises(ValueError, match="no decimal"):
        seeds.apply_schema(column(spark, [long, "12345678901234567"]), {"v": "numeric"})
    assert seeds.validate(column(spark, [long, "x", None]), {"v": "numeric"}).first()[2:] == (3, 1, 1)
    with pytest.raises(ValueError, match="no such table"):
        seeds.validate(column(spark, ["1"]), {"v": "bigint"}, "no_such_table")


def test_skipped_and_system_tables_are_never_copied(spark):
    import uuid

    own = f"t{uuid.uuid4().hex[:8]}"
    tables = {f"{s}.{own}_{k}": column(spark, ["Ann"]) for k, s in enumerate(["app", "app", "pg_catalog", "pg_anything", "information_schema"])}
    rules = [table_sets.Rule(f"app.{own}_0", "v", "redact"), table_sets.Rule(f"app.{own}_1", None, "skip")]
    assert table_sets.bootstrap_copy(tables, rules, "s", "brindle_copy") == [f"app.{own}_0"]
    assert [spark.catalog.tableExists(f"brindle_copy.{own}_{k}") for k in range(5)] == [True, False, False, False, False]
    assert spark.table(f"brindle_copy.{own}_0").first().v == "XXX"
    assert table_sets.anonymise_dump(tables, rules, "s", fresh_path(spark, "d")) == [f"app.{own}_0"]
    assert {(r.table, r.strategy) for r in table_sets.anonymise_preview(spark, tables, rules).collect()} == {(f"app.{own}_0", "redact"), (f"app.{own}_1", "skip"), *((n, "excluded") for n in list(tables)[2:])}


def test_quoted_line_feeds_are_read_if_declared(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n1,"x\ny"\n')
    assert seeds.read_csv(spark, str(tmp_path), line_feeds=True).first()[:] == ("1", "x\ny")


@pytest.mark.parametrize(
    ("sql", "shown"),
    [
        ("SELECT * FROM users WHERE name = 'secret'", "SELECT * FROM users WHERE name = '...'"), ("a = 'it''s' AND b = ''", "a = '...' AND b = '...'"), ("x = 'unclosed", "x = '...'"),
        ('SELECT "Col" FROM t', 'SELECT "Col" FROM t'), ("y" * 250, "y" * 200 + "..."), ("q = '" + "z" * 200_000 + "'", "q = '...'"), (None, None),
    ],
)
def test_redact_sql(spark, sql, shown):
    assert column(spark, [sql]).select(redaction.redact_sql(F.col("v"))).first()[0] == shown


@pytest.mark.parametrize(("dsn", "shown"), [("postgres://u:p@ss@host:5432/db?sslpassword=x", "postgres://u:***@host:5432/db"), ("postgres://host/db?a=1", "postgres://host/db"), ("postgres://u@host/db", "postgres://u@host/db")])
def test_redact_dsn(spark, dsn, shown):
    assert column(spark, [dsn]).select(redaction.redact_dsn(F.col("v"))).first()[0] == shown


def test_stand_ins_are_deterministic_and_keep_nulls(spark):
    df = column(spark, ["Ann", "Ann", None])
    for name, f in anonymise.STRATEGIES.items():
        a, b, c = (r[0] for r in df.select(f(F.col("v"), "s")).collect())
        assert a == b and a is not None and c is None, name
        assert "Ann" not in a
    other = df.select(anonymise.fake_uuid(F.col("v"), "t")).first()[0]
    assert other != df.select(anonymise.fake_uuid(F.col("v"), "s")).first()[0] and other[14] == "4" and other[19] == "8"


def test_unknown_strategies_and_columns_raise(spark):
    df = column(spark, ["x"])
    with pytest.raises(ValueError, match="unknown strategy"):
        table_sets.anonymise(df, {"v": "scramble"}, "s")
    with pytest.raises(ValueError, match="no such columns"):
        table_sets.anonymise(df, {"w": "null"}, "s")


KEYED = "k long, v string"


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.dictionaries(st.integers(0, 9), st.sampled_from("ab")), st.dictionaries(st.integers(0, 9), st.sampled_from("cd")))
def test_upserts_are_idempotent_and_keep_keys_unique(spark, old, new):
    target, source = (spark.createDataFrame(list(d.items()), KEYED) for d in (old, new))
    once = incremental.merge_upsert(target, source, ["k"])
    assert dict(r[:] for r in once.collect()) == old | new
    assert sorted(r[:] for r in incremental.merge_upsert(once, source, ["k"]).collect()) == sorted((old | new).items())
    assert incremental.merge_counts(target, source, ["k"]).first()[:] == (len(new.keys() - old), len(new.keys() & old))


def test_repeated_and_null_keys_raise(spark):
    for rows in ([(1, "a"), (1, "b")], [(None, "a")]):
        df = spark.createDataFrame(rows, KEYED)
        with pytest.raises(ValueError, match="null or repeated"):
            incremental.merge_upsert(df, df, ["k"])


def test_watermarks(spark):
    target = spark.createDataFrame([(3, "c"), (5, "a")], KEYED)
    df = spark.createDataFrame([(4, "z"), (5, "b"), (5, "d"), (6, "a")], KEYED)
    ids = lambda d: sorted((r.k, r.v) for r in d.collect())
    assert ids(incremental.watermark_filter(df, target, "k")) == [(6, "a")]
    assert ids(incremental.watermark_filter(df, target, "k", second="v")) == [(5, "d"), (6, "a")]  # maxima are taken one by one: (5, c)
    assert len(ids(incremental.watermark_filter(df, target.limit(0), "k"))) == 4
    assert ids(incremental.watermark_filter(df, target.limit(0), "k", strict=True)) == []


def test_data_tests_and_nulls(spark):
    df = spark.createDataFrame([(1, "a"), (1, None), (None, "b"), (None, "x")], KEYED)
    assert data_tests.not_null(df, "v").count() == 1
    assert sorted((r.k, r.rows) for r in data_tests.unique(df, ["k"]).collect() if r.k) == [(1, 2)] and data_tests.unique(df, ["k"]).count() == 2
    assert data_tests.accepted_values(df, "v", ["a", "b"]).count() == 1
    assert data_tests.relationships(df, "k", spark.createDataFrame([(2,)], "r long"), "r").count() == 2


def test_row_diff_of_a_table_with_itself_is_empty(spark):
    df = spark.createDataFrame([(1, "a"), (None, None), (2, None)], KEYED)
    assert compare.row_diff(df, df, ["k"]).count() == 0
    other = spark.createDataFrame([(1, "b"), (None, None), (3, "c")], KEYED)
    assert sorted((r.k, r.change) for r in compare.row_diff(df, other, ["k"]).collect()) == [(1, "changed"), (2, "removed"), (3, "added")]


def test_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "parent string, child string")
    start = spark.createDataFrame([("b",)], "node string")
    assert sorted((r.node, r.depth) for r in lineage.closure(edges, start).collect()) == [("a", 2), ("b", 0), ("c", 1), ("d", 2)]
    assert {r.node for r in lineage.closure(edges, spark.createDataFrame([("d",)], "node string"), "up").collect()} == set("abcd")
    nodes = spark.createDataFrame([(x,) for x in "abcd"], "node string")
    with pytest.raises(ValueError, match="cycle among"):
        lineage.layers(edges, nodes)


def test_layers_count_parents_and_ignore_edges_from_outside(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "d"), ("c", "d"), ("x", "a"), ("d", "y")], "parent string, child string")
    nodes = spark.createDataFrame([(x,) for x in "abcde"], "node string")
    assert {(r.node, r.layer) for r in lineage.layers(edges, nodes).collect()} == {("a", 0), ("c", 0), ("e", 0), ("b", 1), ("d", 2)}
    assert lineage.layers(edges, nodes.limit(0)).count() == 0


def test_long_closures_go_on_by_short_jumps_where_long_ones_would_be_many(spark, monkeypatch):
    monkeypatch.setattr(lineage, "FEW", 0)
    monkeypatch.setattr(lineage, "GROWTH", 0)
    edges = spark.createDataFrame([(i, i + 1) for i in range(7)], "parent long, child long")
    assert sorted((r.node, r.depth) for r in lineage.closure(edges, spark.createDataFrame([(0,)], "node long")).collect()) == [(i, i) for i in range(8)]


def test_the_diff_summary_joins_once(spark, monkeypatch):
    a, b = spark.createDataFrame([(i, "a") for i in range(9)], KEYED), spark.createDataFrame([(i, "a" if i < 6 else "b") for i in range(1, 30)], KEYED)
    joins = []
    whole = compare.row_diff
    monkeypatch.setattr(compare, "row_diff", lambda *x: joins.append(1) or whole(*x))
    found = compare.row_diff_summary(a, b, ["k"])
    assert "FullOuter" not in found._jdf.queryExecution().toString() and len(joins) == 1
    assert {r.change: (r.rows, r.examples) for r in found.collect()} == {"removed": (1, ["0"]), "changed": (3, ["6", "7", "8"]), "added": (21, ["9", "10", "11", "12", "13"])}


def test_wait_chains_name_roots_and_direct_waiters(spark):
    edges = spark.createDataFrame([(2, 1, 10), (3, 1, 30), (4, 3, 99)], "waiter long, blocker long, seconds long")
    assert [r[:] for r in activity.wait_chains(edges).collect()] == [(1, 2, 30)]


def test_hit_ratios_leave_out_groups_without_traffic(spark):
    df = spark.createDataFrame([("a", 99, 1), ("b", 0, 0), ("c", 50, 50)], "g string, hits long, reads long")
    assert [(r.g, r.ratio, r.status) for r in activity.hit_ratio_worst(df, "g").collect()] == [("c", 50.0, "critical"), ("a", 99.0, "healthy")]


def test_snapshots_round_trip_and_refuse(spark):
    root, df = fresh_path(spark, "s"), spark.createDataFrame([(1, "a"), (2, None)], KEYED)
    table_sets.snapshot_save(spark, {"default.one": df, "default.two": df}, "x", root, table_sets.Profile(tables=("default.one",)))
    (name, back), = table_sets.snapshot_read(spark, "x", root).items()
    assert name == "default.one" and compare.row_diff(df, back, ["k"]).count() == 0
    table_sets.snapshot_save(spark, {"default.one": df}, "empty", root, table_sets.Profile(data=False))
    assert table_sets.snapshot_read(spark, "empty", root)["default.one"].count() == 0
    with pytest.raises(PermissionError):
        table_sets.snapshot_restore(spark, "x", root)
    with pytest.raises(ValueError, match="no snapshot name"):
        table_sets.snapshot_save(spark, {}, "../x", root)


def test_models_are_checked_and_ordered(spark):
    body = lambda s: s.range(1)
    with pytest.raises(ValueError, match="schema.table"):
        models.Model("one", body)
    with pytest.raises(ValueError, match="unique key"):
        models.Model("a.b", body, "incremental")
    with pytest.raises(ValueError, match="exclude each other"):
        models.Model("a.b", body, "incremental", unique_key=("k",), watermark=("k",), incremental_filter="k > 1")
    m = {x.name: x for x in (models.Model("a.x", body, deps=("a.y",), tags=("t",)), models.Model("a.y", body, deps=("src.z",)), models.Model("a.w", body))}
    assert models.order(m) == ["a.w", "a.y", "a.x"]
    assert models.select(m, ["tag:t"]) == ["a.x"] and models.select(m, ["deps:a.x"]) == ["a.y", "a.x"] and models.select(m, ["downstream:a.y"], ["a.x"]) == ["a.y"]
    with pytest.raises(ValueError, match="depend on each other"):
        models.order({x.name: x for x in (models.Model("a.x", body, deps=("a.y",)), models.Model("a.y", body, deps=("a.x",)))})


def test_a_failing_model_stops_the_run(spark):
    def fail(s):
        raise RuntimeError("no")

    m = {x.name: x for x in (models.Model("a.x", fail), models.Model("a.y", lambda s: s.range(1), deps=("a.x",)))}
    assert [(r.model, r.result) for r in models.run_pipeline(spark, m, fresh_path(spark, "m")).collect()] == [("a.x", "error: RuntimeError"), ("a.y", "not run")]


def test_freshness_of_groups_never_seen_comes_first(spark):
    day = datetime.datetime(2024, 1, 1)
    df = spark.createDataFrame([("a", day), ("b", None)], "g string, t timestamp_ntz")
    assert [(r.g, r.status) for r in activity.freshness(df, "g", "t", F.to_date(F.lit("2024-01-05")), 0).collect()] == [("b", "critical"), ("a", "healthy")]


def test_keys_are_dealt_to_many_tasks_however_small_their_bytes(spark):
    a, b = spark.range(0, 100_000, 1, 4).toDF("k"), spark.range(50, 100_050, 1, 4).toDF("k")
    a = a.unionByName(spark.createDataFrame([(None,), (0,), (0,)], "k long"))
    found = compare.key_difference(a, b, ["k"])
    got = sorted(((r.side, r.k is None, r.k) for r in found.collect()), key=str)
    assert len(got) == 101 and ("only_a", True, None) in got and {k for s, _, k in got if s == "only_b"} == set(range(100_000, 100_050))
    assert found.rdd.getNumPartitions() >= compare.LEAST_PARTS  # tasks joined by bytes held millions of keys each


def test_each_step_of_a_redacted_connection_string_is_evaluated_once(spark):
    from brindle.plans import jobs
    from conftest import DATA

    plan = column(spark, ["x"]).select(redaction.redact_dsn(F.col("v")).alias("shown"))._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("regexp") + plan.count("rlike") <= 5
    query = jobs.redact_dsn(spark, DATA)
    assert query.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))  # not as few as the file has splits
