"""Queries of the catalogue against their SQL on the smallest tables (tools/check.py runs all)."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, rows_of

FOLDER = "/root/testdata/sf0.001"
CHECKED = [
    "films_this_week", "daily_board", "showtimes_by_cinema", "film_details", "consolidate_showings", "normalize_titles", "durations", "absolute_urls",
    "match_natural_key", "upsert_showings", "reconcile_showings", "slot_collisions", "fills", "lifecycle", "validate_films", "page_links", "push_shows", "pushed_source", "rendered_source", "two_phase_source", "long_pushed_films", "nested_links",
    "last_known_good", "export_films",
]


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_its_sql(spark, db, name):
    got, want = entry.queries()[name](spark, FOLDER).toPandas(), db.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_every_oracle_has_a_query_and_parses(db):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    for name, text in entry.oracle_sql().items():
        db.execute(f"EXPLAIN {text}"), name


def test_flagship_query(spark):
    assert entry.entry(spark).columns == ["id", "title", "cinema_names", "cinema_slugs"]


def test_date_filters_and_columns_reach_the_scan(spark):
    plan = entry.queries()["films_this_week"](spark, FOLDER)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(l_shipdate)" in plan
    scans = [line for line in plan.splitlines() if "ReadSchema" in line and "l_partkey" in line]
    assert scans and all("l_extendedprice" not in line for line in scans)
