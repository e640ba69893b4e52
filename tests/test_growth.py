"""Catalogue queries against their SQL on tables made here, whose keys lie beyond those of the small tables."""

import datetime

import duckdb
import pytest
from docweave import catalog
from test_catalog import plain

KINDS = ("click", "view", "error", "purchase")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Three events for each of 800 users; a fourth of the users end with an error."""
    at = tmp_path_factory.mktemp("tables")
    day = datetime.datetime(2024, 1, 1)
    rows = [(u * 3 + k, day + datetime.timedelta(minutes=u, hours=k), u, KINDS[(u + k) % 4], float(u % 7 + k), '{"k": 1}') for u in range(800) for k in range(3)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{at}/events.parquet")
    return str(at)


def compare(spark, tables, name):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tables}/events.parquet/*.parquet'")
    found = catalog.QUERIES[name](spark, tables)
    names = sorted(found.columns)
    have = sorted(tuple(plain(r[n]) for n in names) for r in found.collect())
    want = sorted(tuple(map(plain, r)) for r in con.execute(f"SELECT {', '.join(names)} FROM ({catalog.ORACLES[name]})").fetchall())
    assert have == want
    return have


def test_every_third_user_is_deleted(spark, tables):
    assert len(compare(spark, tables, "delete_versions")) == 200


def test_a_fifth_is_changed_or_gone(spark, tables):
    found = compare(spark, tables, "merged_tables")
    assert sum(kind == "again" for _, kind, _ in found) == 30
