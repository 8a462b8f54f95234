"""Queries of the operators, jobs and streams over the tables, each with its SQL."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import anonymise as anon
from brindle.functions import redaction
from brindle.operators import activity, compare, data_tests, incremental, lineage
from brindle.plans import models
from brindle.sources import seeds, table_sets
from brindle.sources.shared import fresh_path, table
from brindle.streaming import upserts

SEED = "brindle"
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _fresh(name: str) -> str:
    """A table name of its own for each run: another session's table may lie in the same warehouse."""
    return f"{name}_{uuid.uuid4().hex[:12]}"


def _union(frames) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


# Anonymisation. ``pick`` is an entry of a list by eight hex digits of the digest.


def _pick(values: list[str], start: int) -> str:
    names = ", ".join(f"'{v}'" for v in values)
    return f"[{names}][CAST('0x' || substring(h, {start}, 8) AS BIGINT) % {len(values)} + 1]"


_HASHED = f"(SELECT *, sha256(c_name || '{SEED}') AS h FROM customer)"
_UUID = "substring(h, 1, 8) || '-' || substring(h, 9, 4) || '-4' || substring(h, 14, 3) || '-8' || substring(h, 18, 3) || '-' || substring(h, 21, 12)"


def _anon(name: str, expression: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, "customer").select("c_custkey", anon.STRATEGIES[name](F.col("c_name"), SEED).alias("value"))

    QUERIES[f"anon_{name}"] = run
    ORACLES[f"anon_{name}"] = f"SELECT c_custkey, {expression} AS value FROM {_HASHED}"


_anon("fake_email", f"{_pick(anon.EMAIL_FIRST, 1)} || '.' || {_pick(anon.EMAIL_LAST, 9)} || '.' || substring(h, 25, 4) || '@' || {_pick(anon.EMAIL_DOMAINS, 17)}")
_anon("fake_name", f"{_pick(anon.FIRST_NAMES, 1)} || ' ' || {_pick(anon.LAST_NAMES, 9)}")
_anon("fake_first_name", _pick(anon.FIRST_NAMES, 1))
_anon("fake_last_name", _pick(anon.LAST_NAMES, 1))
_anon("fake_uuid", _UUID)
_anon("redact", "regexp_replace(regexp_replace(c_name, '[a-zA-Z]', 'X', 'g'), '[0-9]', '9', 'g')")


@query(f"SELECT c_custkey, {_pick(anon.FIRST_NAMES, 1)} || ' ' || {_pick(anon.LAST_NAMES, 9)} AS c_name, c_nationkey, CAST(NULL AS DOUBLE) AS c_acctbal, regexp_replace(regexp_replace(c_mktsegment, '[a-zA-Z]', 'X', 'g'), '[0-9]', '9', 'g') AS c_mktsegment FROM {_HASHED}")
def anonymize(spark, sf_dir):
    rules = {"c_name": "fake_name", "c_acctbal": "null", "c_mktsegment": "redact", "c_nationkey": "preserve"}
    return table_sets.anonymise(table(spark, sf_dir, "customer"), rules, SEED)


@query("SELECT s_suppkey, CAST(NULL AS VARCHAR) AS s_name FROM supplier")
def anon_null(spark, sf_dir):
    return table_sets.anonymise(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), {"s_name": "null"}, SEED)


@query("SELECT s_suppkey, CAST(0 AS DOUBLE) AS s_acctbal FROM supplier")
def anon_zero(spark, sf_dir):
    return table_sets.anonymise(table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal"), {"s_acctbal": "zero"}, SEED)


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def anon_preserve(spark, sf_dir):
    return table_sets.anonymise(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal"), {"s_name": "preserve"}, SEED)


_RULES = [table_sets.Rule("app.customer", "c_name", "fake_name"), table_sets.Rule("app.supplier", "s_name", "redact"), table_sets.Rule("app.nation", None, "skip")]
_SETS = {"app.customer": "customer", "app.supplier": "supplier", "app.nation": "nation", "pg_temp_3.region": "region"}


@query(f"""SELECT 'customer' AS kind, c_custkey AS id, {_pick(anon.FIRST_NAMES, 1)} || ' ' || {_pick(anon.LAST_NAMES, 9)} AS name FROM {_HASHED}
    UNION ALL SELECT 'supplier', s_suppkey, regexp_replace(regexp_replace(s_name, '[a-zA-Z]', 'X', 'g'), '[0-9]', '9', 'g') FROM supplier""")
def anonymize_dump(spark, sf_dir):
    out = fresh_path(spark, "dump")
    names = table_sets.anonymise_dump({k: table(spark, sf_dir, n) for k, n in _SETS.items()}, _RULES, SEED, out)
    kinds = {"app.customer": ("customer", "c_custkey", "c_name"), "app.supplier": ("supplier", "s_suppkey", "s_name")}
    return _union(spark.read.parquet(f"{out}/{n}").select(F.lit(kinds[n][0]).alias("kind"), F.col(kinds[n][1]).alias("id"), F.col(kinds[n][2]).alias("name")) for n in names)


@query("""SELECT 'app.customer' AS "table", (SELECT count(*) FROM customer) AS rows, c AS "column", CASE c WHEN 'c_name' THEN 'fake_name' ELSE 'real' END AS strategy FROM (SELECT unnest(['c_custkey', 'c_name', 'c_nationkey', 'c_acctbal', 'c_mktsegment']) AS c)
    UNION ALL SELECT 'app.supplier', (SELECT count(*) FROM supplier), c, CASE c WHEN 's_name' THEN 'redact' ELSE 'real' END FROM (SELECT unnest(['s_suppkey', 's_name', 's_nationkey', 's_acctbal']) AS c)
    UNION ALL SELECT 'app.nation', count(*), NULL, 'skip' FROM nation UNION ALL SELECT 'pg_temp_3.region', count(*), NULL, 'excluded' FROM region""")
def anonymize_preview(spark, sf_dir):
    return table_sets.anonymise_preview(spark, {k: table(spark, sf_dir, n) for k, n in _SETS.items()}, _RULES)


@query("""SELECT 2 AS tables, (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) AS rows, 2 AS left_out, 2 AS changed, 7 AS real,
    'app.customer.c_acctbal,app.customer.c_custkey,app.customer.c_mktsegment,app.customer.c_nationkey,app.supplier.s_acctbal,app.supplier.s_nationkey,app.supplier.s_suppkey' AS real_columns""")
def anonymize_preview_totals(spark, sf_dir):
    return table_sets.anonymise_preview_totals(spark, {k: table(spark, sf_dir, n) for k, n in _SETS.items()}, _RULES)


@query(f"""SELECT 0 AS position, 'region' AS "table", 'INSERT INTO "app"."region" ("r_regionkey", "r_name") VALUES (' || r_regionkey || ', ''' || replace(r_name, '''', '''''') || ''');' AS line FROM region
    UNION ALL SELECT 1, 'nation', 'INSERT INTO "app"."nation" ("n_nationkey", "n_name", "n_regionkey") VALUES (' || n_nationkey || ', ''' || replace(n_name, '''', '''''') || ''', ' || n_regionkey || ');' FROM nation
    UNION ALL SELECT 2, 'customer', 'INSERT INTO "app"."customer" ("c_custkey", "c_name", "c_nationkey", "since") VALUES (' || c_custkey || ', ''' || {_pick(anon.FIRST_NAMES, 1)} || ' ' || {_pick(anon.LAST_NAMES, 9)} || ''', ' || c_nationkey || ', '
        || CASE WHEN c_custkey % 2 = 0 THEN 'DATE ''2024-01-' || lpad(CAST(c_custkey % 28 + 1 AS VARCHAR), 2, '0') || '''' ELSE 'NULL' END || ');' FROM {_HASHED}""")
def anonymize_dump_sql(spark, sf_dir):
    """Customers refer to nations, nations to regions: parents come first, whatever their names; a reference of nations to themselves does not count."""
    since = F.when(F.col("c_custkey") % 2 == 0, F.date_add(F.lit("2024-01-01").cast("date"), (F.col("c_custkey") % 28).cast("int")))
    tables = {"app.customer": table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", since.alias("since")), "app.nation": table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"), "app.region": table(spark, sf_dir, "region").select("r_regionkey", "r_name")}
    out = fresh_path(spark, "sql")
    names = table_sets.anonymise_dump_sql(tables, [table_sets.Rule("app.customer", "c_name", "fake_name")], SEED, out, [("app.customer", "app.nation"), ("app.nation", "app.region"), ("app.nation", "app.nation")])
    return _union(spark.read.text(f"{out}/{k:05d}-{n}").select(F.lit(k).alias("position"), F.lit(n.removeprefix("app.")).alias("table"), F.col("value").alias("line")) for k, n in enumerate(names))


@query("SELECT 'customer' AS kind, c_custkey AS id, regexp_replace(regexp_replace(c_name, '[a-zA-Z]', 'X', 'g'), '[0-9]', '9', 'g') AS name FROM customer UNION ALL SELECT 'region', r_regionkey, r_name FROM region")
def bootstrap_copy(spark, sf_dir):
    """Of a source of four tables one is skipped by a rule and one is the system's; the copy has the other two."""
    names = {n: _fresh(f"copied_{n}") for n in ("customer", "supplier", "region", "nation")}
    source = {f"{'pg_temp_3' if n == 'nation' else 'app'}.{names[n]}": table(spark, sf_dir, n) for n in names}
    rules = [table_sets.Rule(f"app.{names['customer']}", "c_name", "redact"), table_sets.Rule(f"app.{names['supplier']}", None, "skip")]
    table_sets.bootstrap_copy(source, rules, SEED, "brindle_copy")
    there = [n for n in names if spark.catalog.tableExists(f"brindle_copy.{names[n]}")]
    keys = {"customer": ("c_custkey", "c_name"), "supplier": ("s_suppkey", "s_name"), "region": ("r_regionkey", "r_name"), "nation": ("n_nationkey", "n_name")}
    return _union(spark.table(f"brindle_copy.{names[n]}").select(F.lit(n).alias("kind"), F.col(keys[n][0]).cast("long").alias("id"), F.col(keys[n][1]).alias("name")) for n in there)


@query("""WITH q AS (SELECT conv_id, turn, 'SELECT * FROM t WHERE a = ''' || replace(text, '''', '''''') || ''' AND "b" = 2' AS sql FROM conversations)
    SELECT conv_id, turn, 'SELECT * FROM t WHERE a = ''...'' AND "b" = 2' AS sql FROM q""")
def redact_sql(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    text = F.concat(F.lit("SELECT * FROM t WHERE a = '"), F.replace("text", F.lit("'"), F.lit("''")), F.lit("' AND \"b\" = 2"))
    return rows.select("conv_id", "turn", redaction.redact_sql(text).alias("sql"))


_DSNS = {  # shape -> (what stands before and after the customer's number, what is shown before and after it)
    "at in password": ("postgres://u", ":p@ss@db:5432/app?sslmode=require", "postgres://u", ":***@db:5432/app"),
    "at in query": ("postgres://u", ":p@db:5432/app?sslpassword=s3@cret", "postgres://u", ":***@db:5432/app"),
    "at in both": ("postgres://u", ":p@ss@db/app?email=a@b&x=c@d", "postgres://u", ":***@db/app"),
    "query without password": ("postgres://db", ":5432/app?email=a@b", "postgres://db", ":5432/app"),
    "port and query only": ("postgres://db", ":5432?email=a@b", "postgres://db", ":5432"),
    "slash in password": ("postgres://u", ":p/a@ss@db/app", "postgres://u", ":***@db/app"),
    "question mark in password": ("postgres://u", ":p?a@db/app?x=1", "postgres://u", ":***@db/app"),
    "line feed in password": ("postgres://u", ":p\na@db/app?x=\n@", "postgres://u", ":***@db/app"),
    "user only": ("postgres://u", "@db/app?password=x", "postgres://u", "@db/app"),
    "no scheme": ("u", ":p@db/app", None, None),
    "words": ("host=db", " password='a b' user=u", "host=db", " password=*** user=u"),
}


@query(" UNION ALL ".join(f"""SELECT '{k}' AS shape, c_custkey, {"'***REDACTED***'" if c is None else f"'{c}' || c_custkey || '{d}'"} AS dsn FROM customer""" for k, (_, _, c, d) in _DSNS.items()))
def redact_dsn(spark, sf_dir):
    # a file of keys is few splits, and each key makes many texts: keys are dealt first
    rows = table(spark, sf_dir, "customer").select("c_custkey").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "c_custkey")
    shape = F.explode(F.array(*(F.struct(F.lit(k).alias("shape"), F.lit(a).alias("a"), F.lit(b).alias("b")) for k, (a, b, _, _) in _DSNS.items()))).alias("x")
    return rows.select("c_custkey", shape).select("x.shape", "c_custkey", redaction.redact_dsn(F.concat("x.a", F.col("c_custkey").cast("string"), "x.b")).alias("dsn"))


# Data tests.


@query("SELECT count(*) AS violations FROM documents AS d LEFT JOIN labels AS l ON d.doc_id = l.doc_id WHERE l.quality IS NULL")
def test_not_null(spark, sf_dir):
    joined = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return data_tests.not_null(joined, "quality").agg(F.count(F.lit(1)).alias("violations"))


@query("SELECT o_custkey, CAST(o_orderdate AS DATE) AS day, count(*) AS rows FROM orders GROUP BY ALL HAVING count(*) > 1")
def test_unique(spark, sf_dir):
    return data_tests.unique(table(spark, sf_dir, "orders").withColumn("day", F.to_date("o_orderdate")), ["o_custkey", "day"])


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus NOT IN ('F', 'O')")
def test_accepted_values(spark, sf_dir):
    return data_tests.accepted_values(table(spark, sf_dir, "orders"), "o_orderstatus", ["F", "O"]).select("o_orderkey", "o_orderstatus")


@query("SELECT d.doc_id FROM documents AS d WHERE d.doc_id IS NOT NULL AND d.doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def test_relationships(spark, sf_dir):
    return data_tests.relationships(table(spark, sf_dir, "documents"), "doc_id", table(spark, sf_dir, "labels"), "doc_id").select("doc_id")


@query("""WITH t(model, test, violations) AS (
    SELECT 'documents', 'not_null(text)', (SELECT count(*) FROM documents WHERE text IS NULL)
    UNION ALL SELECT 'documents', 'relationships(doc_id)', (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))
    UNION ALL SELECT 'orders', 'accepted_values(o_orderstatus)', (SELECT count(*) FROM orders WHERE o_orderstatus NOT IN ('F', 'O'))
    UNION ALL SELECT 'orders', 'not_null(o_custkey)', (SELECT count(*) FROM orders WHERE o_custkey IS NULL)
    UNION ALL SELECT 'orders', 'unique(o_orderkey)', (SELECT count(*) FROM (SELECT 1 FROM orders GROUP BY o_orderkey HAVING count(*) > 1))
    UNION ALL SELECT 'orders', 'accepted_values(halved)', NULL UNION ALL SELECT 'orders', 'unique(no_such_column)', NULL)
    SELECT model, test, violations, CASE WHEN violations IS NULL THEN 'error' WHEN violations = 0 THEN 'pass' ELSE 'fail' END AS status FROM t""")
def test_suite(spark, sf_dir):
    t = data_tests.Test
    return data_tests.suite({
        # ``halved`` fails on some row, while the tests run
        "orders": (table(spark, sf_dir, "orders").withColumn("halved", F.expr("if(o_orderkey % 2 = 0, 1, raise_error('odd'))")), [t("not_null", ("o_custkey",)), t("accepted_values", ("o_orderstatus",), ("F", "O")), t("accepted_values", ("halved",), (1,)), t("unique", ("o_orderkey",)), t("unique", ("no_such_column",))]),
        "documents": (table(spark, sf_dir, "documents"), [t("not_null", ("text",)), t("relationships", ("doc_id",), ref=table(spark, sf_dir, "labels"), ref_column="doc_id")]),
    })


# Incremental tables. ``orders`` up to 2000 is the base; later ones, with changed overlap, the delta.

_SPLIT = "TIMESTAMP '2000-01-01 00:00:00'"
_OVERLAP = "TIMESTAMP '1999-06-01 00:00:00'"
_UPSERTED = f"SELECT o_orderkey, o_custkey, CASE WHEN o_orderdate >= {_OVERLAP} THEN 'N' ELSE o_orderstatus END AS o_orderstatus, CAST(o_orderdate AS DATE) AS day FROM orders"


def _orders(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.to_date("o_orderdate").alias("day"))


def _base(spark, sf_dir) -> DataFrame:
    return _orders(spark, sf_dir).where("day < DATE '2000-01-01'")


def _delta(spark, sf_dir) -> DataFrame:
    return _orders(spark, sf_dir).where("day >= DATE '1999-06-01'").withColumn("o_orderstatus", F.lit("N"))


@query(_UPSERTED)
def merge_upsert(spark, sf_dir):
    target = incremental.BucketedTable(spark, fresh_path(spark, "orders"), ["o_orderkey"], 8)
    target.first_run(_base(spark, sf_dir), ["o_orderkey"])
    return target.upsert(_delta(spark, sf_dir))


@query(f"SELECT count(*) FILTER (WHERE o_orderdate >= {_SPLIT}) AS inserted, count(*) FILTER (WHERE o_orderdate < {_SPLIT}) AS updated FROM orders WHERE o_orderdate >= {_OVERLAP}")
def merge_counts(spark, sf_dir):
    return incremental.merge_counts(_base(spark, sf_dir), _delta(spark, sf_dir), ["o_orderkey"])


@query(f"SELECT o_orderkey, o_custkey, o_orderstatus, CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderdate < {_SPLIT}")
def incremental_first_run(spark, sf_dir):
    return incremental.VersionedTable(spark, fresh_path(spark, "first")).first_run(_base(spark, sf_dir), ["o_orderkey"])


@query(f"WITH m AS (SELECT max(CAST(o_orderdate AS DATE)) AS d FROM orders WHERE o_orderdate < {_SPLIT}) SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders, m WHERE CAST(o_orderdate AS DATE) > d")
def watermark_filter(spark, sf_dir):
    return incremental.watermark_filter(_orders(spark, sf_dir), _base(spark, sf_dir), "day").select("o_orderkey", "day")


@query(f"WITH m AS (SELECT max(CAST(o_orderdate AS DATE)) AS d FROM orders WHERE o_orderdate < {_SPLIT}) SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders, m WHERE CAST(o_orderdate AS DATE) > d - INTERVAL 30 DAYS")
def watermark_lookback(spark, sf_dir):
    return incremental.watermark_filter(_orders(spark, sf_dir), _base(spark, sf_dir), "day", lookback="30 DAYS").select("o_orderkey", "day")


@query(f"""WITH m AS (SELECT max(CAST(o_orderdate AS DATE)) AS a, max(o_orderkey) AS b FROM orders WHERE o_orderdate < {_SPLIT})
    SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders, m WHERE CAST(o_orderdate AS DATE) > a OR (CAST(o_orderdate AS DATE) = a AND o_orderkey > b)""")
def watermark_compound(spark, sf_dir):
    return incremental.watermark_filter(_orders(spark, sf_dir), _base(spark, sf_dir), "day", second="o_orderkey").select("o_orderkey", "day")


def _sections(sf_dir: str, **options) -> models.Model:
    later = lambda s: _delta(s, sf_dir).join(s.table("this").select("o_custkey").distinct(), "o_custkey", "left_semi")
    return models.Model("marts.orders", lambda s: _orders(s, sf_dir), "incremental", unique_key=("o_orderkey",), base=lambda s: _base(s, sf_dir), later=later, **options)


@query(f"""WITH k AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate < {_SPLIT})
    SELECT o_orderkey, o_custkey, CASE WHEN o_orderdate >= {_OVERLAP} THEN 'N' ELSE o_orderstatus END AS o_orderstatus, CAST(o_orderdate AS DATE) AS day FROM orders
    WHERE o_orderdate < {_SPLIT} OR o_custkey IN (SELECT o_custkey FROM k)""")
def incremental_sections(spark, sf_dir):
    root, model = fresh_path(spark, "sections"), _sections(sf_dir)
    models.build(spark, model, root)
    return models.build(spark, model, root)


@query(f"SELECT o_orderkey, o_custkey, o_orderstatus, CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderdate < {_SPLIT}")
def full_refresh(spark, sf_dir):
    root, model = fresh_path(spark, "refresh"), _sections(sf_dir)
    models.build(spark, model, root)
    models.build(spark, model, root)
    return models.build(spark, model, root, full_refresh=True)


def _project(sf_dir: str) -> dict[str, models.Model]:
    m = models.Model
    daily = lambda s: s.sql("SELECT o_custkey, day, COUNT(*) AS n FROM staging_orders GROUP BY o_custkey, day")
    found = [
        m("staging.orders", lambda s: _orders(s, sf_dir), tags=("daily",)),
        m("staging.customers", lambda s: table(s, sf_dir, "customer").select("c_custkey", "c_nationkey")),
        m("marts.activity", daily, "incremental", ("staging.orders",), ("daily",), ("o_custkey", "day"), watermark=("day",), lookback="7 DAYS"),
        m("marts.nations", lambda s: s.sql("SELECT c.c_nationkey, SUM(a.n) AS orders FROM marts_activity AS a JOIN staging_customers AS c ON c.c_custkey = a.o_custkey GROUP BY c.c_nationkey"), "table", ("marts.activity", "staging.customers")),
    ]
    return {x.name: x for x in found}


_DAYS = "SELECT DISTINCT o_custkey, CAST(o_orderdate AS DATE) AS day FROM orders"
_RUN = f"""SELECT 'marts.activity' AS model, 'incremental' AS kind, {{0}} AS {{1}}, (SELECT count(*) FROM ({_DAYS})) AS rows{{2}}
    UNION ALL SELECT 'marts.nations', 'table', {{0}}, (SELECT count(DISTINCT c_nationkey) FROM customer JOIN orders ON c_custkey = o_custkey){{3}}
    UNION ALL SELECT 'staging.customers', 'view', {{0}}, (SELECT count(*) FROM customer){{3}} UNION ALL SELECT 'staging.orders', 'view', {{0}}, (SELECT count(*) FROM orders){{3}}"""
_AGAIN = f"(SELECT count(*) FROM ({_DAYS}) WHERE day > (SELECT max(CAST(o_orderdate AS DATE)) FROM orders) - INTERVAL 7 DAYS)"


@query(_RUN.format("'ok'", "result", f", CAST(0 AS BIGINT) AS inserted, {_AGAIN} AS updated", ", NULL, NULL"))
def run_pipeline(spark, sf_dir):
    root = fresh_path(spark, "project")
    models.run_pipeline(spark, _project(sf_dir), root)
    return models.run_pipeline(spark, _project(sf_dir), root, include=["tree:marts.activity", "marts.nations", "deps:marts.nations"])


@query(_RUN.format("'synced'", "state", "", ""))
def pipeline_status(spark, sf_dir):
    root = fresh_path(spark, "project")
    models.run_pipeline(spark, _project(sf_dir), root)
    return models.pipeline_status(spark, _project(sf_dir), root)


@query("SELECT 'marts.a' AS model, 'view' AS kind, 'type mismatch' AS state, CAST(NULL AS BIGINT) AS rows UNION ALL SELECT 'marts.b', 'table', 'missing', NULL UNION ALL SELECT 'marts.c', 'table', 'type mismatch', NULL UNION ALL SELECT 'marts.d', 'view', 'synced', count(*) FROM region")
def pipeline_mismatches(spark, sf_dir):
    """Models that became a view or a table after they were built, one that never was, and one whose change of kind was built."""
    root = fresh_path(spark, "project")
    model = lambda name, kind: models.Model(f"marts.{name}", lambda s: table(s, sf_dir, "region"), kind)
    for name, kind in (("a", "table"), ("c", "view"), ("d", "table"), ("d", "view")):
        models.build(spark, model(name, kind), root)
    return models.pipeline_status(spark, {m.name: m for m in (model("a", "view"), model("b", "table"), model("c", "table"), model("d", "view"))}, root)


@query("SELECT c_nationkey, count(*) AS customers FROM customer GROUP BY c_nationkey")
def model_view(spark, sf_dir):
    return models.build(spark, models.Model("marts.by_nation", lambda s: table(s, sf_dir, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("customers"))), fresh_path(spark, "v"))


@query("SELECT s_nationkey, count(*) AS suppliers FROM supplier GROUP BY s_nationkey")
def model_table(spark, sf_dir):
    return models.build(spark, models.Model("marts.suppliers", lambda s: table(s, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("suppliers")), "table"), fresh_path(spark, "t"))


@query("SELECT 'view' AS kind, c_nationkey, count(*) AS customers FROM customer GROUP BY c_nationkey UNION ALL SELECT 'table', c_nationkey, count(*) FROM customer WHERE c_acctbal > 0 GROUP BY c_nationkey")
def catalog_objects(spark, sf_dir):
    """A view that was a table and a table that was a view, put into the catalog by one session and read by another."""
    schema, source = _fresh("brindle_marts"), _fresh("default.kept_customer")
    table(spark, sf_dir, "customer").write.saveAsTable(source)
    m = lambda name, kind, where="": models.Model(f"{schema}.{name}", kind=kind, sql=f"SELECT c_nationkey, count(*) AS customers FROM {source} {where} GROUP BY c_nationkey")
    for x in (m("a", "table"), m("b", "view"), m("a", "view"), m("b", "table", "WHERE c_acctbal > 0")):
        models.put(spark, x)
    other = spark.newSession()
    kinds = {models.object_kind(other, f"{schema}.{n}"): other.table(f"{schema}.{n}") for n in "ab"}
    return _union(df.select(F.lit(kind).alias("kind"), "*") for kind, df in kinds.items())


# Lineage: region -> nation -> supplier -> part.

_EDGES = """SELECT 'r' || n_regionkey AS parent, 'n' || n_nationkey AS child FROM nation UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier
    UNION ALL SELECT DISTINCT 's' || l_suppkey, 'p' || l_partkey FROM lineitem"""


def _edges(spark, sf_dir) -> DataFrame:
    named = lambda a, x, b, y, df: df.select(F.concat(F.lit(a), x).alias("parent"), F.concat(F.lit(b), y).alias("child"))
    return _union([
        named("r", "n_regionkey", "n", "n_nationkey", table(spark, sf_dir, "nation")), named("n", "s_nationkey", "s", "s_suppkey", table(spark, sf_dir, "supplier")),
        named("s", "l_suppkey", "p", "l_partkey", table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct()),
    ])


@query(f"WITH RECURSIVE e AS MATERIALIZED ({_EDGES}), c AS (SELECT 'r2' AS node, 0 AS depth UNION SELECT e.child, c.depth + 1 FROM c JOIN e ON e.parent = c.node) SELECT node, min(depth) AS depth FROM c GROUP BY node")
def lineage_closure(spark, sf_dir):
    start = table(spark, sf_dir, "region").where("r_regionkey = 2").select(F.concat(F.lit("r"), "r_regionkey").alias("node"))
    return lineage.closure(_edges(spark, sf_dir), start, "down")


@query(f"""WITH e AS MATERIALIZED ({_EDGES}), v AS (SELECT parent AS node FROM e UNION SELECT child FROM e)
    SELECT node, CASE node[1] WHEN 'r' THEN 0 WHEN 'n' THEN 1 WHEN 's' THEN 2 ELSE 3 END AS layer FROM v""")
def lineage_layers(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    nodes = edges.select(F.col("parent").alias("node")).unionByName(edges.select(F.col("child").alias("node")))
    return lineage.layers(edges, nodes)


# Parts in rings of ten: cycles, with orders before them and suppliers behind them.
_RING = """SELECT DISTINCT 'p' || l_partkey AS parent, 'p' || (CASE WHEN l_partkey % 10 = 9 THEN l_partkey - 9 ELSE l_partkey + 1 END) AS child FROM lineitem WHERE l_partkey < 50
    UNION ALL SELECT DISTINCT 'o' || l_orderkey, 'p' || l_partkey FROM lineitem WHERE l_partkey < 60 UNION ALL SELECT DISTINCT 'p' || l_partkey, 's' || l_suppkey FROM lineitem WHERE l_partkey < 60"""


def _ring(spark, sf_dir) -> DataFrame:
    return spark.sql(_RING.replace("FROM lineitem", "FROM {items}"), items=table(spark, sf_dir, "lineitem"))


@query(f"""WITH RECURSIVE e AS MATERIALIZED ({_RING}), p AS (SELECT parent, child FROM e WHERE parent[1] = 'p' AND child[1] = 'p'),
    r AS (SELECT parent AS node, child AS far FROM p UNION SELECT r.node, p.child FROM r JOIN p ON p.parent = r.far), m AS MATERIALIZED (SELECT * FROM r)
    SELECT a.node, min(a.far) AS component FROM m a JOIN m b ON b.node = a.far AND b.far = a.node GROUP BY a.node""")
def lineage_cycles(spark, sf_dir):
    """Rings of ten parts each, with orders that lead into them and suppliers that they lead to: only the rings are cycles."""
    return lineage.cycles(_ring(spark, sf_dir))


@query(f"""WITH e AS MATERIALIZED ({_EDGES}), v AS (SELECT parent AS node FROM e UNION SELECT child FROM e), x AS MATERIALIZED ({_RING}), y AS (SELECT parent AS node FROM x UNION SELECT child FROM x)
    SELECT 'acyclic' AS kind, node, CASE node[1] WHEN 'r' THEN 0 WHEN 'n' THEN 1 WHEN 's' THEN 2 ELSE 3 END AS layer FROM v UNION ALL SELECT 'cyclic', node, 0 FROM y""")
def lineage_load_layers(spark, sf_dir):
    """The order of loading: by layers for edges without cycle (a table's reference to itself does not count), by name where there is one."""
    nodes = lambda edges: edges.select(F.col("parent").alias("node")).unionByName(edges.select(F.col("child").alias("node")))
    edges, ring = _edges(spark, sf_dir), _ring(spark, sf_dir)
    own = edges.unionByName(edges.select("parent", F.col("parent").alias("child")))
    found = {"acyclic": lineage.load_layers(own, nodes(edges)), "cyclic": lineage.load_layers(ring, nodes(ring))}
    return _union(df.select(F.lit(kind).alias("kind"), "node", "layer") for kind, df in found.items())


# Comparison of ``orders`` with a version in which early rows are gone, later ones changed and keys shifted.

_CHANGED = """SELECT CASE WHEN o_orderdate >= TIMESTAMP '2001-06-01 00:00:00' THEN o_orderkey + 100000000 ELSE o_orderkey END AS o_orderkey, o_custkey,
    CASE WHEN o_orderdate >= TIMESTAMP '2001-01-01 00:00:00' THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderdate >= TIMESTAMP '1995-03-01 00:00:00'"""
_DIFF = f"""WITH b AS ({_CHANGED}), d AS (SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN b.o_orderkey IS NULL THEN 'removed' WHEN a.o_orderkey IS NULL THEN 'added'
    WHEN a.o_orderstatus IS DISTINCT FROM b.o_orderstatus OR a.o_custkey IS DISTINCT FROM b.o_custkey THEN 'changed' END AS change FROM orders AS a FULL OUTER JOIN b ON a.o_orderkey = b.o_orderkey)"""


def _versions(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, sf_dir, "orders")
    return orders.select("o_orderkey", "o_custkey", "o_orderstatus"), spark.sql(_CHANGED.replace("FROM orders", "FROM {o}"), o=orders)


@query(f"{_DIFF} SELECT * FROM d WHERE change IS NOT NULL")
def row_diff(spark, sf_dir):
    return compare.row_diff(*_versions(spark, sf_dir), ["o_orderkey"])


QUERIES["join_full_diff"], ORACLES["join_full_diff"] = row_diff, ORACLES["row_diff"]


@query(f"{_DIFF} SELECT change, count(*) AS rows, array_to_string(list_slice(list(CAST(o_orderkey AS VARCHAR) ORDER BY o_orderkey), 1, 5), ',') AS examples FROM d WHERE change IS NOT NULL GROUP BY change")
def row_diff_summary(spark, sf_dir):
    return compare.row_diff_summary(*_versions(spark, sf_dir), ["o_orderkey"]).withColumn("examples", F.array_join("examples", ","))


_BAGS = "(SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity END AS l_quantity FROM lineitem WHERE l_orderkey % 5 <> 0 AND (l_orderkey % 11 <> 0 OR l_linenumber <> 1))"


@query(f"""WITH a AS (SELECT l_orderkey, l_partkey, l_quantity, l_discount, count(*) AS n FROM lineitem GROUP BY ALL), b AS (SELECT l_orderkey, l_partkey, l_quantity, CAST(NULL AS DOUBLE) AS l_discount, count(*) AS n FROM {_BAGS} GROUP BY ALL),
    u AS (SELECT l_orderkey, l_partkey, l_quantity, l_discount, n AS x, 0 AS y FROM a UNION ALL SELECT l_orderkey, l_partkey, l_quantity, l_discount, 0, n FROM b),
    r AS (SELECT l_orderkey, l_partkey, l_quantity, l_discount, sum(x) AS x, sum(y) AS y FROM u GROUP BY ALL)
    SELECT l_orderkey, CASE WHEN sum(y) = 0 THEN 'removed' WHEN sum(x) = 0 THEN 'added' ELSE 'changed' END AS change FROM r GROUP BY l_orderkey HAVING bool_or(x <> y)""")
def row_diff_bags(spark, sf_dir):
    """Lines by order, whose key repeats, with a version that lost orders, single lines, quantities and a column."""
    items = table(spark, sf_dir, "lineitem")
    after = spark.sql(f"SELECT l_orderkey, l_partkey, l_quantity FROM {_BAGS.replace('FROM lineitem', 'FROM {items}')}", items=items)
    return compare.row_diff(items.select("l_orderkey", "l_partkey", "l_quantity", "l_discount"), after, ["l_orderkey"])


@query(f"WITH b AS ({_CHANGED}) (SELECT o_orderkey, 'only_a' AS side FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM b)) UNION ALL (SELECT o_orderkey, 'only_b' FROM b WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders))")
def set_key_difference(spark, sf_dir):
    return compare.key_difference(*_versions(spark, sf_dir), ["o_orderkey"])


@query(f"WITH b AS ({_CHANGED}), x AS (SELECT DISTINCT o_orderstatus AS s FROM orders), y AS (SELECT DISTINCT o_orderstatus AS s FROM b) SELECT s AS value, 'removed' AS change FROM x WHERE s NOT IN (SELECT s FROM y) UNION ALL SELECT s, 'added' FROM y WHERE s NOT IN (SELECT s FROM x)")
def value_domain_diff(spark, sf_dir):
    return compare.value_domain_diff(*_versions(spark, sf_dir), "o_orderstatus")


# Types of the other engine by the names they have here.
_TYPE = "CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE column_type END"
_SCHEMAS = f"""WITH n AS (SELECT column_name AS c, {_TYPE} AS t FROM (DESCRIBE nation)),
    d AS (SELECT 'nation.' || c AS object, 'column modified' AS change, t AS before, 'bigint' AS after FROM n WHERE c = 'n_regionkey' UNION ALL SELECT 'nation.' || c, 'column removed', t, NULL FROM n WHERE c = 'n_name'
    UNION ALL SELECT 'nation.' || c, 'column modified', t || ' default 0', t || ' default -1' FROM n WHERE c = 'n_nationkey'
    UNION ALL SELECT 'nation.n_extra', 'column added', NULL, 'int not null default 1' UNION ALL SELECT 'region', 'table removed', NULL, NULL UNION ALL SELECT 'part', 'table added', NULL, NULL)"""


def _schema_versions(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Of nations a key's default changed, a column went and one of another type came, one with a default; a table went and one came."""
    nation = compare.with_default(table(spark, sf_dir, "nation"), "n_nationkey", "0")
    after = nation.select("n_nationkey", F.col("n_regionkey").cast("long").alias("n_regionkey"), F.lit(1).alias("n_extra"))
    after = compare.with_default(compare.with_default(after, "n_nationkey", "-1"), "n_extra", "1")
    root = fresh_path(spark, "schemas")
    table_sets.snapshot_save(spark, {"app.nation": nation}, "before", root)  # snapshots keep defaults
    a = compare.schema_rows(spark, {"nation": table_sets.snapshot_read(spark, "before", root)["app.nation"], "region": table(spark, sf_dir, "region")})
    return a, compare.schema_rows(spark, {"nation": after, "part": table(spark, sf_dir, "part")})


@query(f"{_SCHEMAS} SELECT * FROM d")
def schema_diff(spark, sf_dir):
    return compare.schema_diff(*_schema_versions(spark, sf_dir))


@query(f"""{_SCHEMAS} SELECT split_part(change, ' ', 1) AS kind, count(*) FILTER (WHERE change LIKE '% added') AS added, count(*) FILTER (WHERE change LIKE '% removed') AS removed, count(*) FILTER (WHERE change LIKE '% modified') AS modified FROM d GROUP BY 1""")
def schema_diff_summary(spark, sf_dir):
    return compare.schema_diff_summary(*_schema_versions(spark, sf_dir))


@query("""SELECT 1 AS position, 'doc_id' AS "column", 'bigint' AS type, true AS is_key, count(*) AS rows, count(*) - count(doc_id) AS nulls FROM labels UNION ALL SELECT 2, 'quality', 'int', false, count(*), count(*) - count(quality) FROM labels
    UNION ALL SELECT 3, 'toxic', 'int', false, count(*), count(*) - count(toxic) FROM labels""")
def describe_table(spark, sf_dir):
    found = table_sets.describe_table(table(spark, sf_dir, "labels"), ["doc_id"])
    return found.where("bytes > 0").drop("bytes")  # the other engine does not tell sizes


# Snapshots and storage.


@query("SELECT 'public.customer' AS \"table\", (SELECT count(*) FROM customer) AS rows UNION ALL SELECT 'public.orders', (SELECT count(*) FROM orders)")
def snapshot_save(spark, sf_dir):
    tables = {"public.customer": table(spark, sf_dir, "customer"), "public.orders": table(spark, sf_dir, "orders"), "audit.events": table(spark, sf_dir, "events"), "public.part": table(spark, sf_dir, "part")}
    profile = table_sets.Profile(exclude_schemas=("audit",), exclude_tables=("public.part",))
    return table_sets.snapshot_save(spark, tables, "nightly", fresh_path(spark, "snapshots"), profile, "2024-01-01").where("bytes > 0 AND digest <> ''").select("table", "rows")


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def snapshot_restore(spark, sf_dir):
    root, name = fresh_path(spark, "snapshots"), _fresh("default.kept_supplier")
    table_sets.snapshot_save(spark, {name: table(spark, sf_dir, "supplier")}, "one", root)
    table_sets.snapshot_restore(spark, "one", root, confirmed=True)
    return spark.table(name)


@query("SELECT 'later' AS snapshot, '2024-02-01' AS created, 2 AS tables, (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) AS rows UNION ALL SELECT 'sooner', '2024-01-01', 1, (SELECT count(*) FROM orders)")
def snapshot_list(spark, sf_dir):
    root = fresh_path(spark, "snapshots")
    table_sets.snapshot_save(spark, {"a.orders": table(spark, sf_dir, "orders")}, "sooner", root, created="2024-01-01")
    table_sets.snapshot_save(spark, {"a.nation": table(spark, sf_dir, "nation"), "a.customer": table(spark, sf_dir, "customer")}, "later", root, created="2024-02-01")
    return table_sets.snapshot_list(spark, root).where("bytes > 0").drop("bytes")


@query("SELECT 'lineitem' AS \"table\", count(*) AS rows FROM lineitem UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'customer', count(*) FROM customer")
def storage_report(spark, sf_dir):
    return table_sets.storage_report({n: table(spark, sf_dir, n) for n in ("customer", "orders", "lineitem")}).select("table", "rows")


_CATALOG = "(SELECT 'public.' || n_name AS name FROM nation UNION ALL SELECT 'pg_catalog.' || r_name FROM region UNION ALL SELECT 'audit.' || r_name FROM region)"


@query(f"SELECT name FROM {_CATALOG} WHERE name LIKE 'public.%' AND name <> 'public.FRANCE'")
def schema_profile_filter(spark, sf_dir):
    prefix = lambda p, df, c: df.select(F.concat(F.lit(p), c).alias("name"))
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    names = _union([prefix("public.", nation, "n_name"), prefix("pg_catalog.", region, "r_name"), prefix("audit.", region, "r_name")])
    return table_sets.chosen(names, table_sets.Profile(schemas=("public", "pg_catalog"), exclude_tables=("public.FRANCE",)))


# Seeds: a table written as a file and read back strictly.


def _seed_file(spark, sf_dir) -> DataFrame:
    path = fresh_path(spark, "seed")
    shown = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("  "), "c_name", F.lit(' "x", ')).alias("c_name"), F.when(F.col("c_nationkey") > 3, F.col("c_nationkey")).alias("c_nationkey"), "c_acctbal", (F.col("c_acctbal") > 0).alias("good"))
    shown.write.csv(path, header=True, quote='"', escape='"', emptyValue="")
    return seeds.read_csv(spark, path)


_SEED_SQL = "SELECT c_custkey, trim(c_name || ' \"x\", ') AS c_name, CASE WHEN c_nationkey > 3 THEN c_nationkey END AS c_nationkey, c_acctbal, c_acctbal > 0 AS good FROM customer"


@query(f"SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey, CAST(good AS VARCHAR) AS good FROM ({_SEED_SQL})")
def seed_read_csv(spark, sf_dir):
    return _seed_file(spark, sf_dir).select("c_custkey", "c_name", "c_nationkey", "good")


@query("SELECT unnest(['c_custkey', 'c_name', 'c_nationkey', 'c_acctbal', 'good']) AS \"column\", unnest(['bigint', 'text', 'bigint', 'numeric', 'boolean']) AS type")
def seed_infer_types(spark, sf_dir):
    return seeds.infer_types(_seed_file(spark, sf_dir), None)


@query(f"SELECT c_custkey, c_name, CAST(c_nationkey AS INTEGER) AS c_nationkey, c_acctbal, good FROM ({_SEED_SQL})")
def seed_apply_schema(spark, sf_dir):
    types = {"c_custkey": "bigint", "c_nationkey": "int", "c_acctbal": "double", "good": "boolean"}
    return seeds.apply_schema(_seed_file(spark, sf_dir), types)


@query("SELECT c_custkey, '0.' || lpad(CAST(c_custkey AS VARCHAR), 25, '0') AS shown, 25 AS scale FROM customer")
def seed_long_fractions(spark, sf_dir):
    """A numeric column of 25 digits after the point keeps them all."""
    shown = F.concat(F.lit("0."), F.lpad(F.col("c_custkey").cast("string"), 25, F.lit("0")))
    seed = seeds.apply_schema(table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("c_custkey"), shown.alias("v")), {"c_custkey": "bigint", "v": "numeric"})
    return seed.select("c_custkey", F.col("v").cast("string").alias("shown"), F.lit(int(dict(seed.dtypes)["v"].rstrip(")").split(",")[1])).alias("scale"))


_WIDE = """SELECT CAST(c_custkey AS VARCHAR) AS small, CASE WHEN c_custkey % 2 = 0 THEN '1234567890123456' || lpad(CAST(c_custkey AS VARCHAR), 4, '0') ELSE '7' END AS whole, CASE WHEN c_custkey % 3 = 0 THEN '.' ELSE '1.5' END AS point,
    CASE WHEN c_custkey % 3 = 0 THEN '2024-13-45' ELSE '2024-01-15' END AS day, CASE WHEN c_custkey % 3 = 0 THEN '0.' || repeat('1', 30) ELSE '123456789012345' END AS digits, CASE WHEN c_custkey % 2 = 0 THEN '-3' ELSE '12.25' END AS mixed, '2024-02-29' AS leap FROM customer"""


@query(f"""WITH w AS ({_WIDE}) SELECT small, CAST(CAST(whole AS HUGEINT) AS VARCHAR) AS whole, point, day, digits, CAST(CAST(mixed AS DECIMAL(38, 2)) AS VARCHAR) AS mixed, CAST(CAST(leap AS DATE) AS VARCHAR) AS leap,
    'bigint,decimal(38,0),string,string,string,decimal(38,2),date' AS types FROM w""")
def seed_widening(spark, sf_dir):
    """Types that widen: whole numbers beyond 64 bits, a point alone, a day that is not in the calendar, digits beyond 38. What is inferred is cast without failure."""
    rows = spark.sql(_WIDE.replace("FROM customer", "FROM {rows}").replace("AS VARCHAR", "AS STRING"), rows=table(spark, sf_dir, "customer"))
    typed = seeds.apply_schema(rows, {r["column"]: r["type"] for r in seeds.infer_types(rows, None).collect()})
    return typed.select(*(F.col(c).cast("string").alias(c) for c in typed.columns), F.lit(",".join(t for _, t in typed.dtypes)).alias("types"))


@query("""SELECT unnest(['c_custkey', 'c_name', 'c_nationkey', 'c_acctbal', 'good']) AS "column", unnest(['int', 'text', 'bigint', 'numeric', 'boolean']) AS type, (SELECT count(*) FROM customer) AS rows,
    unnest([0, 0, (SELECT count(*) FROM customer WHERE c_nationkey <= 3), 0, 0]) AS nulls, CAST(0 AS BIGINT) AS failures, unnest(['schema', 'inferred', 'inferred', 'inferred', 'inferred']) AS origin""")
def seed_validate_origins(spark, sf_dir):
    return seeds.validate_seed(_seed_file(spark, sf_dir), {"c_custkey": "int"})


@query(f"SELECT c_custkey, c_acctbal FROM ({_SEED_SQL})")
def seed_replace(spark, sf_dir):
    df = seeds.apply_schema(_seed_file(spark, sf_dir), {"c_custkey": "bigint", "c_acctbal": "double"}).select("c_custkey", "c_acctbal")
    name = _fresh("seeded_customer")
    df.limit(0).write.saveAsTable(name)
    seeds.replace({name: df})
    return spark.table(name)


@query("SELECT c_custkey AS id, 'user' || c_custkey || '@example.com' AS email, CASE WHEN c_custkey % 3 = 0 THEN 'admin' ELSE 'member' END AS role FROM customer")
def seed_sql(spark, sf_dir):
    top = table(spark, sf_dir, "customer").agg(F.max("c_custkey").alias("n"))
    top.createOrReplaceTempView("seed_size")
    rows = seeds.sql_seed(spark, "SELECT id, 'user' || id || '@example.com' AS email, CASE WHEN id % 3 = 0 THEN 'admin' ELSE 'member' END AS role FROM (SELECT explode(sequence(0L, n)) AS id FROM seed_size)")
    return rows.join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), "id", "left_semi")


@query("""SELECT 'c_custkey' AS "column", 'bigint' AS type, count(*) AS rows, CAST(0 AS BIGINT) AS nulls, CAST(0 AS BIGINT) AS failures FROM customer UNION ALL SELECT 'c_name', 'bigint', count(*), 0, count(*) FROM customer
    UNION ALL SELECT 'c_nationkey', 'boolean', count(*), count(*) FILTER (WHERE c_nationkey <= 3), count(*) FILTER (WHERE c_nationkey > 3) FROM customer""")
def seed_validate(spark, sf_dir):
    return seeds.validate(_seed_file(spark, sf_dir), {"c_custkey": "bigint", "c_name": "bigint", "c_nationkey": "boolean"})


@query("SELECT unnest(['c_custkey', 'c_name', 'c_nationkey', 'c_acctbal', 'good']) AS \"column\", unnest(['int', 'text', 'bigint', 'numeric', 'boolean']) AS type, unnest(['schema', 'inferred', 'inferred', 'inferred', 'inferred']) AS origin")
def seed_types_of(spark, sf_dir):
    return seeds.types_of(_seed_file(spark, sf_dir), {"c_custkey": "int"}, None)


# Operational analytics: events as a log, sessions and deliveries; orders as waits.


def _log(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("statement"), (F.col("value") * 100).alias("ms"), F.length("props").cast("long").alias("rows"), F.pmod("user_id", F.lit(10)).alias("hits"), F.when(F.col("event_type") != "view", F.pmod("event_id", F.lit(2))).otherwise(0).alias("reads"))


_LOG = "(SELECT event_type AS statement, value * 100 AS ms, length(props) AS rows, user_id % 10 AS hits, CASE WHEN event_type <> 'view' THEN event_id % 2 ELSE 0 END AS reads FROM events)"


@query(f"""SELECT statement, count(*) AS calls, CAST(sum(CAST(ms AS DECIMAL(18, 4))) AS DOUBLE) AS total, CAST(sum(CAST(ms AS DECIMAL(18, 4))) AS DOUBLE) / count(ms) AS mean, CAST(sum(rows) AS BIGINT) AS rows,
    CAST(round(100.0 * sum(hits) / nullif(sum(hits) + sum(reads), 0), 2) AS DOUBLE) AS hit_ratio,
    CASE WHEN CAST(sum(CAST(ms AS DECIMAL(18, 4))) AS DOUBLE) / count(ms) >= 5000 THEN 'critical' WHEN CAST(sum(CAST(ms AS DECIMAL(18, 4))) AS DOUBLE) / count(ms) >= 1000 THEN 'warning' ELSE 'healthy' END AS status
    FROM {_LOG} WHERE statement NOT LIKE '%error%' GROUP BY statement ORDER BY total DESC, statement LIMIT 3""")
def workload_topk(spark, sf_dir):
    return activity.workload_topk(_log(spark, sf_dir), "total", 3, "%error%")


@query("""WITH c AS (SELECT coalesce(CAST(user_id % 7 AS VARCHAR), '<none>') AS grp, coalesce(event_type, 'null') AS state, count(*) AS n FROM events GROUP BY ALL), g AS (SELECT grp, CAST(sum(n) AS BIGINT) AS total, string_agg(state || '=' || n, ',' ORDER BY state) AS states FROM c GROUP BY grp)
    SELECT grp, total, states, CAST(round(100.0 * total / 1990, 2) AS DOUBLE) AS percent, CASE WHEN round(100.0 * total / 1990, 2) >= 90 THEN 'critical' WHEN round(100.0 * total / 1990, 2) >= 75 THEN 'warning' ELSE 'healthy' END AS status FROM g""")
def usage_by_state(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.pmod("user_id", F.lit(7)).alias("app"), F.col("event_type").alias("state"))
    shown = F.array_join(F.transform(F.map_entries("states"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return activity.usage_by_state(rows, "app", 2000, 10).withColumn("states", shown)


_WAITS = "(SELECT o_orderkey AS waiter, min(o_orderkey) OVER (PARTITION BY o_custkey) AS blocker, CAST(date_diff('day', min(o_orderdate) OVER (PARTITION BY o_custkey), o_orderdate) AS BIGINT) AS seconds FROM orders)"


def _waits(spark, sf_dir) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    first = orders.groupBy("o_custkey").agg(F.min("o_orderkey").alias("blocker"), F.min("o_orderdate").alias("since"))
    return orders.join(first, "o_custkey").where("o_orderkey <> blocker").select(F.col("o_orderkey").alias("waiter"), "blocker", F.date_diff("o_orderdate", "since").cast("long").alias("seconds"))


@query(f"SELECT blocker, count(DISTINCT waiter) AS waiters, max(seconds) AS oldest FROM {_WAITS} WHERE waiter <> blocker GROUP BY blocker")
def wait_chains(spark, sf_dir):
    return activity.wait_chains(_waits(spark, sf_dir))


@query(f"SELECT waiter AS node, 1 AS depth FROM {_WAITS} WHERE waiter <> blocker UNION ALL SELECT DISTINCT blocker, 0 FROM {_WAITS} WHERE waiter <> blocker")
def wait_depth(spark, sf_dir):
    waits = _waits(spark, sf_dir)
    return activity.wait_depth(waits, waits.select(F.col("blocker").alias("node")))


@query("""SELECT event_id AS id, event_type AS state, CAST(epoch(TIMESTAMP '2024-02-01 00:00:00') AS BIGINT) - CAST(floor(epoch(ts)) AS BIGINT) AS age FROM events
    WHERE event_type NOT IN ('view') AND CAST(epoch(TIMESTAMP '2024-02-01 00:00:00') AS BIGINT) - CAST(floor(epoch(ts)) AS BIGINT) >= 1000000""")
def long_running(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("state"), F.col("ts").alias("started"))
    return activity.long_running(rows, F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"), 1_000_000, ("view",))


_HEADROOM = "SELECT '{0}' AS key, CAST(max({0}) AS BIGINT) AS last, CAST({2} AS BIGINT) AS most, round(CAST(max({0}) AS DOUBLE) * 100 / CAST({2} AS DOUBLE), 2) AS percent, 'healthy' AS status FROM {1}"


@query(" UNION ALL ".join(_HEADROOM.format(*x) for x in (("o_orderkey", "orders", 9223372036854775807), ("l_linenumber", "lineitem", 2147483647), ("event_id", "events", 9223372036854775807), ("n_nationkey", "nation", 2147483647))))
def key_headroom(spark, sf_dir):
    return activity.key_headroom({k: (table(spark, sf_dir, t), k) for k, t in (("o_orderkey", "orders"), ("l_linenumber", "lineitem"), ("event_id", "events"), ("n_nationkey", "nation"))})


@query(f"""SELECT *, CASE WHEN ratio < 90 THEN 'critical' WHEN ratio < 95 THEN 'warning' ELSE 'healthy' END AS status FROM (SELECT statement, CAST(sum(hits) AS BIGINT) AS hits, CAST(sum(reads) AS BIGINT) AS reads, CAST(round(100.0 * sum(hits) / nullif(sum(hits) + sum(reads), 0), 2) AS DOUBLE) AS ratio
    FROM {_LOG} GROUP BY statement HAVING sum(hits) + sum(reads) > 0) ORDER BY ratio, statement LIMIT 4""")
def hit_ratio_worst(spark, sf_dir):
    return activity.hit_ratio_worst(_log(spark, sf_dir), "statement", 4)


@query(f"""SELECT *, CASE WHEN ratio < 90 THEN 'critical' WHEN ratio < 95 THEN 'warning' ELSE 'healthy' END AS status FROM (SELECT CAST(sum(hits) AS BIGINT) AS hits, CAST(sum(reads) AS BIGINT) AS reads, CAST(round(100.0 * sum(hits) / nullif(sum(hits) + sum(reads), 0), 2) AS DOUBLE) AS ratio FROM {_LOG})""")
def hit_ratio_overall(spark, sf_dir):
    return activity.hit_ratio_overall(_log(spark, sf_dir))


@query("""SELECT event_id AS id, 'idle in transaction' AS state, CAST(epoch(TIMESTAMP '2024-02-01 00:00:00') AS BIGINT) - CAST(floor(epoch(ts)) AS BIGINT) AS idle FROM events
    WHERE event_type = 'view' AND CAST(epoch(TIMESTAMP '2024-02-01 00:00:00') AS BIGINT) - CAST(floor(epoch(ts)) AS BIGINT) >= 2000000""")
def idle_in_transaction(spark, sf_dir):
    state = F.when(F.col("event_type") == "view", "idle in transaction").otherwise(F.col("event_type"))
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), state.alias("state"), F.col("ts").alias("changed"))
    return activity.idle_in_transaction(rows, F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"), 2_000_000)


@query("""SELECT event_type, count(*) AS rows, max(ts) AS last, CAST(date_diff('day', CAST(max(ts) AS DATE), DATE '2024-02-10') AS INTEGER) AS days,
    CASE WHEN max(ts) IS NULL OR date_diff('day', CAST(max(ts) AS DATE), DATE '2024-02-10') >= 30 THEN 'critical' WHEN date_diff('day', CAST(max(ts) AS DATE), DATE '2024-02-10') >= 7 THEN 'warning' ELSE 'healthy' END AS status FROM events GROUP BY event_type HAVING count(*) > 100""")
def freshness(spark, sf_dir):
    return activity.freshness(table(spark, sf_dir, "events"), "event_type", "ts", F.to_date(F.lit("2024-02-10")), 100)


@query("SELECT md5(text) AS key, count(*) AS members, CAST(sum(n_chars) AS BIGINT) AS total, CAST(sum(n_chars) - max(n_chars) AS BIGINT) AS wasted FROM documents GROUP BY md5(text) HAVING count(*) > 1")
def duplicate_groups(spark, sf_dir):
    return activity.duplicate_groups(table(spark, sf_dir, "documents"), F.md5("text"), F.col("n_chars"))


@query("SELECT p_partkey, p_name, p_retailprice FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-06-01 00:00:00')")
def unused_entities(spark, sf_dir):
    facts = table(spark, sf_dir, "lineitem").where("l_shipdate >= TIMESTAMP_NTZ '2001-06-01 00:00:00'")
    return activity.unused_entities(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice"), "p_partkey", facts, "l_partkey", "p_retailprice")


_COUNTS = "(SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS a, count(*) FILTER (WHERE o_orderstatus = 'O') AS b, count(*) AS volume FROM orders GROUP BY o_custkey)"


@query(f"SELECT o_custkey, a, b, volume, CASE WHEN b = 0 THEN CAST(a AS DOUBLE) ELSE round(CAST(a AS DOUBLE) / b, 4) END AS ratio FROM {_COUNTS} WHERE volume > 2 ORDER BY volume DESC, o_custkey LIMIT 25")
def scan_ratio_topk(spark, sf_dir):
    counts = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("a"), F.count_if(F.col("o_orderstatus") == "O").alias("b"), F.count(F.lit(1)).alias("volume"))
    return activity.scan_ratio_topk(counts, "a", "b", "volume", 2, 25)


@query("""SELECT rows, superseded, CAST(round(100.0 * superseded / nullif(rows, 0), 2) AS DOUBLE) AS percent, CASE WHEN 100.0 * superseded / rows >= 25 THEN 'critical' WHEN 100.0 * superseded / rows >= 10 THEN 'warning' ELSE 'healthy' END AS status
    FROM (SELECT count(*) AS rows, count(*) - count(DISTINCT o_custkey) AS superseded FROM orders)""")
def stale_row_ratio(spark, sf_dir):
    return activity.stale_row_ratio(table(spark, sf_dir, "orders"), ["o_custkey"])


_LAG = "CAST(max(CAST(floor(epoch(ts)) AS BIGINT) + user_id % 400 - CAST(floor(epoch(ts)) AS BIGINT)) AS BIGINT)"


@query(f"SELECT event_type, {_LAG} AS lag, CASE WHEN {_LAG} >= 300 THEN 'critical' WHEN {_LAG} >= 30 THEN 'warning' ELSE 'healthy' END AS status FROM events GROUP BY event_type")
def lag_status(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("seen", F.expr("ts + make_dt_interval(0, 0, 0, user_id % 400)"))
    return activity.lag_status(rows, "event_type", "ts", "seen")


@query("""WITH s AS (SELECT 100.0 * (count(*) - count(DISTINCT o_custkey)) / count(*) AS p FROM orders), c(check_name, status) AS (
    SELECT 'stale orders', CASE WHEN p >= 25 THEN 'critical' WHEN p >= 10 THEN 'warning' ELSE 'healthy' END FROM s UNION ALL SELECT 'key headroom', 'healthy' UNION ALL SELECT 'not there', 'skipped' UNION ALL SELECT 'fails on rows', 'skipped')
    SELECT check_name, status, CASE WHEN check_name = 'not there' THEN 'AnalysisException' WHEN status = 'skipped' THEN 'SparkRuntimeException' END AS reason FROM c
    UNION ALL SELECT 'overall', CASE max(CASE status WHEN 'critical' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END) WHEN 2 THEN 'critical' WHEN 1 THEN 'warning' ELSE 'healthy' END, NULL FROM c""")
def health_report(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    checks = {
        "stale orders": lambda: activity.stale_row_ratio(orders, ["o_custkey"]),
        "key headroom": lambda: activity.key_headroom({"o_orderkey": (orders, "o_orderkey")}),
        "not there": lambda: activity.stale_row_ratio(orders, ["no_such_column"]),
        "fails on rows": lambda: activity.stale_row_ratio(orders.withColumn("k", F.expr("if(o_orderkey > 0, raise_error('no'), 1)")), ["k"]),
    }
    return activity.health_report(checks, spark)


_BLOCKED = f"(SELECT waiter, max(seconds) AS seconds FROM {_WAITS} WHERE waiter <> blocker GROUP BY waiter)"
_OPEN = "(SELECT CAST(epoch(TIMESTAMP '2024-02-01 00:00:00') AS BIGINT) - CAST(floor(epoch(ts)) AS BIGINT) AS age, event_type FROM events)"


@query(f"""WITH x AS (SELECT 'blocked' AS name, count(*) AS n, CAST(floor(coalesce(max(seconds), 0) / 60) AS BIGINT) AS value FROM {_BLOCKED} UNION ALL SELECT 'blocked by few', count(*), CAST(floor(coalesce(max(seconds), 0) / 60) AS BIGINT) FROM {_BLOCKED} WHERE seconds < 1860
    UNION ALL SELECT 'open', count(*), CAST(floor(coalesce(max(age), 0) / 60) AS BIGINT) FROM {_OPEN} WHERE age > 300 AND event_type <> 'view' UNION ALL SELECT 'open long', 0, 0),
    p AS (SELECT 'capacity' AS name, count(*) AS n, CAST(floor(100.0 * count(*) / 100) AS BIGINT) AS value FROM customer WHERE c_custkey <= 95 UNION ALL SELECT 'capacity exceeded', count(*), CAST(floor(100.0 * count(*) / 100) AS BIGINT) FROM customer WHERE c_custkey <= 96
    UNION ALL SELECT 'capacity free', count(*), CAST(floor(100.0 * count(*) / 100) AS BIGINT) FROM customer WHERE c_custkey <= 80)
    SELECT name, n, value, CASE WHEN n = 0 THEN 'healthy' WHEN value > 30 THEN 'critical' ELSE 'warning' END AS status FROM x UNION ALL SELECT name, n, value, CASE WHEN value > 95 THEN 'critical' WHEN value > 80 THEN 'warning' ELSE 'healthy' END FROM p
    UNION ALL SELECT 'keys', 0, CAST(floor(100.0 * max(n_nationkey) / 2147483647) AS BIGINT), CASE WHEN 100.0 * max(n_nationkey) / 2147483647 > 85 THEN 'critical' WHEN 100.0 * max(n_nationkey) / 2147483647 > 70 THEN 'warning' ELSE 'healthy' END FROM nation
    UNION ALL SELECT 'keys nearly used', 0, CAST(floor(100.0 * max(n_nationkey * 1200) / 32767) AS BIGINT), CASE WHEN 100.0 * max(n_nationkey * 1200) / 32767 > 85 THEN 'critical' WHEN 100.0 * max(n_nationkey * 1200) / 32767 > 70 THEN 'warning' ELSE 'healthy' END FROM nation""")
def health_limits(spark, sf_dir):
    """The report's own checks, whose limits are exceeded, not reached."""
    waits, customers, nation = _waits(spark, sf_dir), table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    sessions = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_type") == "view", "idle").otherwise(F.col("event_type")).alias("state"), F.col("ts").alias("started"))
    now = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    ages = {"blocked": activity.blocked_check(waits), "blocked by few": activity.blocked_check(waits.where("seconds < 1860")), "open": activity.open_check(sessions, now), "open long": activity.open_check(sessions, now, 1 << 40)}
    shares = {"capacity": 95, "capacity exceeded": 96, "capacity free": 80}
    small = nation.select((F.col("n_nationkey") * 1200).cast("smallint").alias("n_nationkey"))
    keys = {"keys": nation.select(F.col("n_nationkey").cast("int").alias("n_nationkey")), "keys nearly used": small}
    return _union([
        *(df.select(F.lit(n).alias("name"), F.col("count").alias("n"), F.col("minutes").alias("value"), "status") for n, df in ages.items()),
        *(activity.capacity_check(customers.where(F.col("c_custkey") <= k), 100).select(F.lit(n).alias("name"), F.col("count").alias("n"), F.col("percent").alias("value"), "status") for n, k in shares.items()),
        *(activity.keys_check({"k": (df, "n_nationkey")}).select(F.lit(n).alias("name"), F.lit(0).cast("long").alias("n"), F.floor("percent").alias("value"), "status") for n, df in keys.items()),
    ])


# Streams over the files of ``events``.


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1")
def stream_upsert(spark, sf_dir):
    path = fresh_path(spark, "events")
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    events.repartitionByRange(3, "event_id").write.parquet(path)
    target = incremental.BucketedTable(spark, fresh_path(spark, "latest"), ["user_id"], 8)
    stream = upserts.file_stream(spark, path, events.schema)
    upserts.stream_upsert(stream, target, "event_id", fresh_path(spark, "marks")).awaitTermination()
    return target.read().select("user_id", "event_id", "event_type", "value")


@query("""SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18, 4))) AS DOUBLE) AS total FROM events
    WHERE event_id % 10 <> 3 OR date_trunc('day', ts) + INTERVAL 1 DAY > (SELECT max(ts) FROM events WHERE event_id % 10 <> 3) - INTERVAL 10 DAYS GROUP BY ALL""")
def stream_lookback(spark, sf_dir):
    """Files arrive one by one: all rows but every tenth, unsorted; one row that lets the watermark pass; every tenth row, late; and a row far
    ahead that closes all days. Late rows count if their day was still open, ten days behind the newest row before, and are dropped otherwise."""
    path, out = fresh_path(spark, "events"), fresh_path(spark, "windows")
    events = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    late = F.pmod("event_id", F.lit(10)) == 3
    ahead = lambda days: events.agg((F.max("ts") + F.expr(f"INTERVAL {days} DAYS")).alias("ts")).select(F.lit(-1).cast("long").alias("event_id"), "ts", F.lit("closing").alias("event_type"), F.lit(0.0).alias("value"))
    for rows in (events.where(~late), ahead(0), events.where(late), ahead(60)):
        rows.coalesce(1).write.mode("append").parquet(path)
    windows = upserts.stream_windows(upserts.file_stream(spark, path, events.schema), "ts", "event_type", "value", "10 days", "1 day")
    query_ = windows.writeStream.format("parquet").option("path", out).option("checkpointLocation", fresh_path(spark, "marks")).outputMode("append").trigger(availableNow=True).start()
    query_.awaitTermination()
    return spark.read.parquet(out).where("event_type <> 'closing'").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")
