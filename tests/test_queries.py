"""Every query of the library against its SQL in the other engine, on the smallest tables."""

import pytest

from brindle.plans import catalogue
from conftest import DATA, duck_rows, rows_of


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_equals_its_sql(spark, duck, name):
    got = rows_of(catalogue.queries()[name](spark, DATA))
    assert got == duck_rows(duck, catalogue.oracle_sql()[name])


def test_entry_has_rows_and_all_queries_have_sql(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(catalogue.queries()) == set(catalogue.oracle_sql())
    assert set(catalogue.queries()) <= set(entry.queries())


def test_agg_filter_counts_copies_and_nulls_as_its_sql_and_shuffles_lines_once(spark, tmp_path):
    """Parts that repeat or are null, null suppliers, flags, quantities and keys; and no second shuffle of the lines for the distinct count."""
    import duckdb

    parts = spark.createDataFrame([(1,), (1,), (2,), (None,), (None,), (3,)], "p_partkey long")
    lines = [(1, 1, 7, "N", "O", 2.5), (2, 1, 7, "R", "O", 1.0), (3, 1, 8, "A", "F", None), (4, 1, None, "A", "O", 4.0), (None, 1, 9, "N", "O", 8.0), (5, 2, 7, None, None, 3.0), (6, None, 7, "N", "O", 9.0), (7, 2, 5, "R", "F", 3.0)]
    lines = spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_returnflag string, l_linestatus string, l_quantity double")
    con = duckdb.connect()
    for name, df in (("part", parts), ("lineitem", lines)):
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    df = catalogue.queries()["agg_filter"](spark, str(tmp_path))
    assert rows_of(df) == duck_rows(con, catalogue.oracle_sql()["agg_filter"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    initial = plan[plan.index("== Initial Plan ==") :] if "== Initial Plan ==" in plan else plan
    assert initial.count("Exchange hashpartitioning") == 2 and "Expand" not in initial
