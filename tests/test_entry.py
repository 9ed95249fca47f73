import pytest
from tests.oracle import duckdb_rows, spark_rows

import __spark_entry__
from concord import interface_queries, queries  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_its_sql(spark, name):
    assert spark_rows(queries.QUERIES[name](spark, SF)) == duckdb_rows(queries.SQL[name], SF)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_flagship(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert len(rows) == 9 and [r["validation_name"] for r in rows if r["validation_status"] == "fail"] == ["total"]
    got = {(r["group_by_columns"], r["validation_name"]): (r["source_agg_value"], r["target_agg_value"], round(r["pct_difference"], 4)) for r in rows}
    assert got['{"o_orderstatus": "F"}', "n"] == ("493", "494", 0.2028) and got['{"o_orderstatus": "P"}', "total"] == ("122513113.23", "121196797.66", -1.0744)


def test_every_sql_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
