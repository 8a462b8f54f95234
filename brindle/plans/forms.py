"""Projections, filters, joins, aggregates, sorts, set operations and scalar functions as model bodies.

A body is SQL that runs over the tables of a folder; where the other engine writes a function differently,
its own text stands beside it. Sums of money are summed as decimals, so that order does not matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brindle.sources.shared import table

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


#: Tasks that keys are dealt to: at least, and for each split of the largest table.
LEAST_PARTS, PARTS_A_SPLIT = 200, 16


def body(sql: str, *names: str, keys: dict[str, str] | None = None):
    """A query from SQL over the named tables.

    ``keys`` names tables and the key by which the SQL joins and groups them. Their rows are dealt by it to tasks whose number grows with the
    tables; tasks joined by shuffled bytes would hold millions of rows in the sorts and aggregates of one stage.
    """

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        tables = {n: table(spark, sf_dir, n) for n in names}
        if keys:
            splits = max(tables[n].rdd.getNumPartitions() for n in keys)
            parts = max(LEAST_PARTS, int(spark.conf.get("spark.sql.shuffle.partitions")), PARTS_A_SPLIT * splits)
            tables |= {n: tables[n].repartition(parts, key) for n, key in keys.items()}
        return spark.sql(sql, **tables)

    return run


# id -> (tables, SQL, SQL of the other engine or None where it is the same)
FORMS: dict[str, tuple[str, str, str | None]] = {
    "scan_table": ("supplier", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM {supplier}", None),
    "proj_alias": ("customer", "SELECT q.id, q.label, q.segment FROM (SELECT c_custkey AS id, c_name || ' / ' || c_mktsegment AS label, c_mktsegment AS segment FROM {customer}) AS q", None),
    "filter_compare": ("lineitem", "SELECT l_orderkey, l_linenumber, l_quantity FROM {lineitem} WHERE l_quantity >= 45 AND l_discount < 0.02 AND l_returnflag <> 'N' AND l_linenumber <= 3", None),
    "filter_not_in": ("orders", "SELECT o_orderkey, o_orderstatus FROM {orders} WHERE o_orderstatus NOT IN ('P', 'F')", None),
    "filter_null": ("documents, labels", "SELECT d.doc_id, d.lang, l.quality IS NULL AS unlabelled FROM {documents} AS d LEFT JOIN {labels} AS l ON d.doc_id = l.doc_id WHERE l.toxic IS NULL OR d.lang IS NOT NULL", None),
    "filter_like": ("part", "SELECT p_partkey, p_type FROM {part} WHERE p_name NOT LIKE '%0%' OR p_type ILIKE '%STEEL%'", None),
    "case_when": ("customer", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'owing' WHEN c_acctbal = 0 THEN 'even' ELSE 'owed' END AS balance, CASE WHEN c_mktsegment IS NOT NULL THEN 'known' ELSE 'unknown' END AS segment FROM {customer}", None),
    "backfill_case": ("orders", "SELECT o_orderkey, CASE WHEN o_orderstatus IS NULL OR o_orderstatus = 'P' THEN 'pending' ELSE lower(o_orderstatus) END AS status FROM {orders} WHERE o_orderstatus IS NULL OR o_orderstatus <> lower(o_orderstatus)", None),
    "join_inner": ("orders, customer, nation", "SELECT o.o_orderkey, c.c_name, n.n_name, CAST(o.o_orderdate AS DATE) AS ordered FROM {orders} AS o JOIN {customer} AS c ON c.c_custkey = o.o_custkey JOIN {nation} AS n ON n.n_nationkey = c.c_nationkey", None),
    "join_left": ("customer, nation", "SELECT c.c_custkey, c.c_name, n.n_name, n.n_regionkey FROM {customer} AS c LEFT JOIN {nation} AS n ON n.n_nationkey = c.c_nationkey AND n.n_regionkey = 2", None),
    "join_left_residual": (
        "customer, orders",
        """SELECT c.c_custkey, c.c_mktsegment, COUNT(o.o_orderkey) AS open_orders, CAST(COALESCE(SUM(CAST(o.o_totalprice AS DECIMAL(18, 2))), 0) AS DOUBLE) AS open_value,
          CAST(MAX(o.o_orderdate) AS DATE) AS newest, CASE WHEN MAX(o.o_totalprice) >= 100000 THEN 'high' WHEN COUNT(o.o_orderkey) > 0 THEN 'some' ELSE 'none' END AS exposure
        FROM {customer} AS c LEFT JOIN {orders} AS o ON o.o_custkey = c.c_custkey AND o.o_orderstatus = 'O' GROUP BY c.c_custkey, c.c_mktsegment""",
        None,
    ),
    "join_left_chain": (
        "nation, customer, orders",
        """SELECT n.n_nationkey, n.n_name, COUNT(DISTINCT c.c_custkey) AS customers, COUNT(DISTINCT o.o_orderkey) AS orders
        FROM {nation} AS n LEFT JOIN {customer} AS c ON c.c_nationkey = n.n_nationkey LEFT JOIN {orders} AS o ON o.o_custkey = c.c_custkey GROUP BY n.n_nationkey, n.n_name""",
        None,
    ),
    "join_anti": ("part, lineitem", "SELECT p.p_partkey, p.p_name FROM {part} AS p WHERE NOT EXISTS (SELECT 1 FROM {lineitem} AS l WHERE l.l_partkey = p.p_partkey AND l.l_shipdate >= TIMESTAMP '2001-06-01 00:00:00')", None),
    "join_semi": ("supplier, lineitem", "SELECT s.s_suppkey, s.s_name FROM {supplier} AS s WHERE EXISTS (SELECT 1 FROM {lineitem} AS l WHERE l.l_suppkey = s.s_suppkey AND l.l_returnflag = 'R' AND l.l_quantity > 49)", None),
    "join_self": (
        "orders",
        """SELECT a.o_custkey AS custkey, a.o_orderkey AS earlier, b.o_orderkey AS later FROM {orders} AS a JOIN {orders} AS b
        ON a.o_custkey = b.o_custkey AND a.o_orderdate = b.o_orderdate AND a.o_orderkey < b.o_orderkey""",
        None,
    ),
    "join_lateral_explode": (
        "pages",
        "SELECT page_id, u.pos + 1 AS place, u.part FROM {pages} LATERAL VIEW posexplode(split(url, '/')) u AS pos, part WHERE u.part <> ''",
        "SELECT page_id, i AS place, p[i] AS part FROM (SELECT page_id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT page_id, string_split(url, '/') AS p FROM pages)) WHERE p[i] <> ''",
    ),
    "join_array_contains": (
        "customer, orders, nation",
        """SELECT n.n_name, COUNT(*) AS customers FROM (SELECT c_custkey, explode(array(c_nationkey, c_nationkey + 1)) AS k FROM {customer}) AS c JOIN {nation} AS n ON n.n_nationkey = c.k GROUP BY n.n_name""",
        """SELECT n.n_name, COUNT(*) AS customers FROM customer AS c JOIN nation AS n ON list_contains([c.c_nationkey, c.c_nationkey + 1], n.n_nationkey) GROUP BY n.n_name""",
    ),
    "agg_basic": (
        "lineitem",
        """SELECT l_returnflag, l_linestatus, COUNT(*) AS n, CAST(SUM(CAST(l_quantity AS DECIMAL(18, 2))) AS DOUBLE) AS sum_qty, ROUND(CAST(SUM(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) / COUNT(*), 4) AS avg_price,
          MIN(l_discount) AS least, CAST(MAX(l_shipdate) AS DATE) AS latest FROM {lineitem} GROUP BY l_returnflag, l_linestatus""",
        None,
    ),
    "agg_distinct": ("lineitem", "SELECT l_shipmode_key AS linenumber, COUNT(DISTINCT l_orderkey) AS orders, COUNT(DISTINCT l_partkey) AS parts, COUNT(DISTINCT l_suppkey) AS suppliers FROM (SELECT l_linenumber AS l_shipmode_key, * FROM {lineitem}) AS q GROUP BY l_shipmode_key", None),
    # a count of distinct values under a filter would double the rows and shuffle them once more: suppliers are made distinct first
    "agg_filter": (
        "part, lineitem",
        """WITH by_supplier AS (SELECT l_partkey, l_suppkey, COUNT(l_orderkey) FILTER (WHERE l_returnflag NOT IN ('R')) AS n, SUM(CAST(l_quantity AS DECIMAL(18, 2))) FILTER (WHERE l_returnflag NOT IN ('R')) AS units, MAX(l_linestatus = 'O') AS open FROM {lineitem} GROUP BY l_partkey, l_suppkey),
          by_part AS (SELECT l_partkey, SUM(n) AS n, SUM(units) AS units, COUNT(l_suppkey) FILTER (WHERE open) AS suppliers FROM by_supplier GROUP BY l_partkey)
        SELECT p.p_partkey, COALESCE(SUM(l.n), 0) AS times_ordered, CAST(COALESCE(SUM(l.units), 0) AS DOUBLE) AS units, COALESCE(MAX(l.suppliers), 0) AS open_suppliers FROM {part} AS p LEFT JOIN by_part AS l ON l.l_partkey = p.p_partkey GROUP BY p.p_partkey""",
        """SELECT p.p_partkey, COUNT(l.l_orderkey) FILTER (WHERE l.l_returnflag NOT IN ('R')) AS times_ordered, CAST(COALESCE(SUM(CAST(l.l_quantity AS DECIMAL(18, 2))) FILTER (WHERE l.l_returnflag NOT IN ('R')), 0) AS DOUBLE) AS units,
          COUNT(DISTINCT l.l_suppkey) FILTER (WHERE l.l_linestatus = 'O') AS open_suppliers FROM {part} AS p LEFT JOIN {lineitem} AS l ON l.l_partkey = p.p_partkey GROUP BY p.p_partkey""",
    ),
    "agg_having": ("orders", "SELECT o_custkey, COUNT(*) AS n FROM {orders} GROUP BY o_custkey HAVING COUNT(*) > 1", None),
    "agg_ratio_safe": (
        "customer, orders",
        """SELECT c.c_nationkey, CAST(ROUND(100.0 * COUNT(DISTINCT o.o_orderkey) FILTER (WHERE o.o_orderstatus = 'F') / NULLIF(COUNT(DISTINCT o.o_orderkey), 0), 2) AS DOUBLE) AS finished
        FROM {customer} AS c LEFT JOIN {orders} AS o ON o.o_custkey = c.c_custkey GROUP BY c.c_nationkey""",
        None,
    ),
    "agg_coalesce_default": (
        "part, lineitem",
        """SELECT p.p_partkey, CAST(COALESCE(SUM(CAST(l.l_quantity AS DECIMAL(18, 2))), 0) AS DOUBLE) AS units, ROUND(COALESCE(CAST(SUM(CAST(l.l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) / NULLIF(COUNT(l.l_extendedprice), 0), p.p_retailprice), 4) AS price
        FROM {part} AS p LEFT JOIN {lineitem} AS l ON l.l_partkey = p.p_partkey AND l.l_discount = 0.1 GROUP BY p.p_partkey, p.p_retailprice""",
        None,
    ),
    "agg_array_ordered": (
        "nation",
        "SELECT n_regionkey, array_join(transform(array_sort(collect_list(struct(n_name, n_nationkey))), s -> s.n_name), ', ') AS names FROM {nation} GROUP BY n_regionkey",
        "SELECT n_regionkey, array_to_string(array_agg(n_name ORDER BY n_name, n_nationkey), ', ') AS names FROM nation GROUP BY n_regionkey",
    ),
    "agg_count_map": (
        "orders",
        "SELECT custkey, array_join(transform(map_entries(map_from_entries(array_sort(collect_list(struct(status, n))))), e -> e.key || '=' || e.value), ',') AS states FROM (SELECT o_custkey AS custkey, o_orderstatus AS status, COUNT(*) AS n FROM {orders} GROUP BY o_custkey, o_orderstatus) AS q GROUP BY custkey",
        "SELECT custkey, string_agg(status || '=' || n, ',' ORDER BY status) AS states FROM (SELECT o_custkey AS custkey, o_orderstatus AS status, COUNT(*) AS n FROM orders GROUP BY ALL) GROUP BY custkey",
    ),
    "agg_global": ("events", "SELECT COUNT(*) AS n, COUNT(DISTINCT user_id) AS users, MIN(ts) AS first_ts, MAX(ts) AS last_ts FROM {events}", None),
    "sort_multi": ("supplier", "SELECT s_nationkey, s_acctbal, s_suppkey FROM {supplier} ORDER BY s_nationkey ASC, s_acctbal DESC, s_suppkey", None),
    "sort_nulls_first": (
        "customer, orders",
        "SELECT c.c_custkey, CAST(MAX(o.o_orderdate) AS DATE) AS last_order FROM {customer} AS c LEFT JOIN {orders} AS o ON o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P' GROUP BY c.c_custkey ORDER BY last_order ASC NULLS FIRST, c.c_custkey",
        None,
    ),
    "topk": ("orders", "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 20", None),
    "set_union_all": ("customer, supplier", "SELECT c_custkey AS id, 'customer' AS kind FROM {customer} UNION ALL SELECT s_suppkey AS id, 'supplier' AS kind FROM {supplier}", None),
    "fn_string": (
        "customer, part",
        "SELECT c_custkey, c_name || '-' || c_mktsegment AS joined, left(c_name, 5) AS head, substring(c_name, 3, 4) AS middle, lower(c_name) AS low, length(c_name) AS n, trim('  ' || c_name || ' ') AS trimmed, levenshtein(c_name, c_mktsegment) AS distance FROM {customer}",
        None,
    ),
    "fn_regex": ("documents", "SELECT doc_id, length(regexp_replace(text, '[a-zA-Z]', '')) AS others, text RLIKE '[0-9]' AS has_digit FROM {documents}", "SELECT doc_id, length(regexp_replace(text, '[a-zA-Z]', '', 'g')) AS others, regexp_matches(text, '[0-9]') AS has_digit FROM documents"),
    "fn_hash": (
        "documents",
        "SELECT doc_id, sha2(text, 256) AS digest, CAST(conv(substring(sha2(text, 256), 1, 8), 16, 10) AS BIGINT) AS number FROM {documents}",
        "SELECT doc_id, sha256(text) AS digest, CAST('0x' || substring(sha256(text), 1, 8) AS BIGINT) AS number FROM documents",
    ),
    "fn_date": (
        "events",
        """SELECT event_id, CAST(date_trunc('day', ts) AS DATE) AS day, CAST(date_trunc('month', ts) AS DATE) AS month, CAST(ts AS DATE) AS date, extract(HOUR FROM ts) AS hour, unix_timestamp(TIMESTAMP_NTZ '2024-02-01 00:00:00') - unix_timestamp(ts) AS age,
          CAST(ts + INTERVAL 36 HOURS AS DATE) AS later, CAST(extract(DAYS FROM (TIMESTAMP_NTZ '2024-02-01 00:00:00' - ts)) AS BIGINT) AS days FROM {events}""",
        """SELECT event_id, CAST(date_trunc('day', ts) AS DATE) AS day, CAST(date_trunc('month', ts) AS DATE) AS month, CAST(ts AS DATE) AS date, CAST(extract(HOUR FROM ts) AS INTEGER) AS hour, CAST(epoch(TIMESTAMP '2024-02-01 00:00:00') AS BIGINT) - CAST(floor(epoch(ts)) AS BIGINT) AS age,
          CAST(ts + INTERVAL 36 HOURS AS DATE) AS later, CAST(extract(DAYS FROM (TIMESTAMP '2024-02-01 00:00:00' - ts)) AS BIGINT) AS days FROM events""",
    ),
    "fn_math": ("lineitem", "SELECT l_orderkey, l_linenumber, CAST(ROUND(CAST(l_extendedprice AS DECIMAL(18, 2)) * CAST(l_tax AS DECIMAL(4, 2)), 2) AS DOUBLE) AS tax, CAST(CEIL(l_extendedprice) AS BIGINT) AS up, GREATEST(l_quantity, CAST(10 AS DOUBLE)) AS at_least, ROUND(ABS(l_discount - CAST(0.05 AS DOUBLE)), 4) AS off, l_orderkey % 7 AS rest FROM {lineitem}", None),
    "fn_conditional": ("labels, documents", "SELECT d.doc_id, COALESCE(l.quality, -1) AS quality, NULLIF(d.lang, 'en') AS other_lang, CASE WHEN l.toxic = 1 THEN 'toxic' ELSE 'fine' END AS state FROM {documents} AS d LEFT JOIN {labels} AS l ON l.doc_id = d.doc_id", None),
    "fn_cast": ("lineitem", "SELECT l_orderkey, l_linenumber, l_quantity::integer AS whole, l_extendedprice::decimal(18, 2) AS price, l_orderkey::string AS shown FROM {lineitem}", "SELECT l_orderkey, l_linenumber, l_quantity::integer AS whole, l_extendedprice::decimal(18, 2) AS price, l_orderkey::varchar AS shown FROM lineitem"),
    "fn_array": (
        "embeddings",
        "SELECT vec_id, CAST(size(embedding) AS BIGINT) AS n, element_at(embedding, 1) AS first, CAST(array_position(embedding, element_at(embedding, 3)) AS BIGINT) AS place FROM {embeddings}",
        "SELECT vec_id, CAST(len(embedding) AS BIGINT) AS n, embedding[1] AS first, CAST(list_position(embedding, embedding[3]) AS BIGINT) AS place FROM embeddings",
    ),
    "fn_json": ("events", "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k, props RLIKE '^[{{].*[}}]$' AS is_json FROM {events}", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, regexp_full_match(props, '[{{].*[}}]') AS is_json FROM events"),
    "fn_sequence": (
        "orders",
        "SELECT o_orderkey, d AS day FROM (SELECT o_orderkey, explode(sequence(CAST(o_orderdate AS DATE), CAST(o_orderdate AS DATE) + 2)) AS d FROM {orders})",
        "SELECT o_orderkey, CAST(o_orderdate AS DATE) + CAST(i AS INTEGER) AS day FROM orders, generate_series(0, 2) AS g(i)",
    ),
    "incremental_filter": ("orders", "SELECT * FROM (SELECT o_custkey, CAST(o_orderdate AS DATE) AS day, COUNT(*) AS n FROM {orders} GROUP BY o_custkey, CAST(o_orderdate AS DATE)) AS q WHERE day >= DATE '2001-01-01'", None),
}


def _names(names: str) -> list[str]:
    return [n.strip() for n in names.split(",")]


#: Keys by which tables of a query are dealt.
KEYS = {"agg_filter": {"part": "p_partkey", "lineitem": "l_partkey"}}

QUERIES = {k: body(sql, *_names(names), keys=KEYS.get(k)) for k, (names, sql, _) in FORMS.items()}
ORACLES = {k: (other or sql).format(**{n: n for n in TABLES}) for k, (_, sql, other) in FORMS.items()}
