"""Every query against its SQL on the smallest tables."""

import pytest

from glyphworks.plans.catalog import QUERIES, SQL
from oracle import spark_rows, sql_rows, tables


@pytest.fixture(scope="module")
def db(sf_dir):
    return tables(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf_dir, db, name):
    assert spark_rows(QUERIES[name](spark, sf_dir)) == sql_rows(db, SQL[name])


def test_quota_against_a_loop(spark, sf_dir):
    got = {r.event_id: r.admitted for r in QUERIES["quota_admission"](spark, sf_dir).collect()}
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts", "event_id").collect()
    logs, expected = {}, {}
    for r in sorted(rows, key=lambda r: (r.user_id, r.ts, r.event_id)):
        log = [t for t in logs.get(r.user_id, []) if (r.ts - t).total_seconds() <= 86_400]
        expected[r.event_id] = len(log) < 2
        logs[r.user_id] = log + [r.ts] * expected[r.event_id]
    assert got == expected


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
