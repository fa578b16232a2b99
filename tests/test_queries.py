"""Registered queries against their SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
CHECKED = [
    "order_payment_status", "payment_ledger_match", "bank_settlement_rules", "derived_ledger",
    "feed_counters", "canonical_orders", "upserted_payments", "audit_unbalanced_references",
    "payment_cases", "keyword_search", "threshold_grid", "grouped_split", "exception_labels",
]


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, name):
    from crosscheck import TABLES, rows_of

    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    res = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in res.description]
    df = entry.queries()[name](spark, FOLDER)
    assert sorted(df.columns) == sorted(columns)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert got and got == rows_of(columns, res.fetchall())
