"""Declared schemas: fixed in code, nothing is inferred at read time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Order numbers of rows inside a source: wide enough to pack page, element and item.
SEQ = "decimal(38,0)"

SHOWING_STRUCT = (
    "struct<cinema:string,cinema_slug:string,date:string,times:array<string>,screen:string,"
    "source_url:string,language:string,session_attributes:array<string>>"
)
HISTORY_STRUCT = "struct<date:string,action:string>"

# One row per film of one source, before entity resolution. ``arrival_seq`` is the position in
# which the films arrived; every "first value wins" rule orders by it.
FILM_RECORD = (
    "source_slug string, arrival_seq bigint, title string, title_normalized string, poster string, "
    "description string, genres array<string>, status string, source_poster string, duration string, "
    "director string, original_title string, year int, wikidata_id string"
)
# Flat showings of those films, linked by ``arrival_seq``.
SHOWING_RECORD = (
    "arrival_seq bigint, showing_seq decimal(38,0), cinema string, cinema_slug string, date string, "
    "times array<string>, screen string, source_url string, language string, session_attributes array<string>"
)

ERROR_RECORD = "cinema string, timestamp string, exception string, phase string, url string, detail string"

# Store tables.
CINEMAS = (
    "slug string, name string, city string, address string, region string, lat double, lon double, "
    "website string, phone string, maps_place_url string"
)
FILMS = (
    "id bigint, title string, title_normalized string, original_title string, year int, runtime_minutes int, "
    "genres string, director string, poster_url string, synopsis string, wikidata_id string, "
    "created_at timestamp, removed_at timestamp"
)
SHOWINGS = (
    "id bigint, film_id bigint, cinema_slug string, date date, times array<string>, language string, "
    "screen string, buy_url string, scraped_at timestamp, removed_at timestamp"
)

# Full life-cycle state: one row per film key with its showings and history nested.
STATE = (
    "title string, title_normalized string, poster string, description string, genres array<string>, "
    "status string, source_poster string, duration string, director string, original_title string, year int, "
    f"wikidata_id string, present_in array<{SHOWING_STRUCT}>, history array<{HISTORY_STRUCT}>"
)

# Snapshot envelopes, as published by the nightly job and read by the loader. Both spellings of
# the fields the loader accepts are declared, so a missing one reads as null.
FILM_ITEM = (
    "struct<id:string,title:string,title_normalized:string,original_title:string,poster:string,poster_url:string,"
    "description:string,synopsis:string,genres:array<string>,director:string,duration:string,"
    "runtime_minutes:string,year:int,wikidata_id:string,status:string,first_seen:string,last_seen:string>"
)
SHOWING_ITEM = (
    "struct<film_id:string,cinema_slug:string,date:string,times:array<string>,screen:string,source_url:string,"
    "buy_url:string,language:string,session_attributes:array<string>>"
)
CINEMA_ITEM = (
    "struct<slug:string,name:string,city:string,address:string,region:string,lat:double,lon:double,"
    "website:string,phone:string,maps_place_url:string>"
)
CINEMAS_ENVELOPE = f"generated_at string, cinemas array<{CINEMA_ITEM}>"
FILMS_ENVELOPE = f"generated_at string, films array<{FILM_ITEM}>"
SHOWINGS_ENVELOPE = f"generated_at string, date_from string, date_to string, showings array<{SHOWING_ITEM}>"

# Landed payloads: what a fetcher wrote, one row per response body, numbered in landing order.
PAYLOADS = "landed_seq bigint, source_slug string, url string, run_date date, target_date string, body string"


def struct_type(ddl: str) -> T.StructType:
    """The StructType of a DDL string."""
    return T.StructType.fromDDL(ddl)


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """Project to a declared schema: missing columns become typed nulls, extra ones go."""
    present = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in struct_type(ddl).fields
        ]
    )


def ensure_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add each missing column as a typed null; columns already there are left alone."""
    missing = {name: F.lit(None).cast(kind) for name, kind in columns.items() if name not in df.columns}
    return df.withColumns(missing) if missing else df


def blank(column: Column) -> Column:
    """True for null and for the empty string, the two spellings of "no value" in payloads."""
    return column.isNull() | (column == "")


def filled(column: Column) -> Column:
    """The value, or null when it is the empty string."""
    return F.nullif(column, F.lit(""))
