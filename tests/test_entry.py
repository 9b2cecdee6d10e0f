"""The driver's contract, on the smallest tables."""

import __spark_entry__ as entry


def test_names_and_sql():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert len(queries) > 50 and set(sql) <= set(queries)


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 1 and rows[0].rmse_m < rows[0].baseline_rmse_m
