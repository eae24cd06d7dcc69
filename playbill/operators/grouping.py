"""Grouping operators: every one is a hash aggregation with map-side partials."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from playbill.schema import filled
from playbill.session import materialise



def _strings() -> Column:
    return F.array().cast("array<string>")


def first_filled(value: Column, seq: Column) -> Column:
    """First non-empty value in arrival order, as an aggregate."""
    usable = filled(value)
    return F.min_by(usable, F.when(usable.isNotNull(), seq))


def first_value(value: Column, seq: Column) -> Column:
    """First non-null value in arrival order, as an aggregate for non-text columns."""
    return F.min_by(value, F.when(value.isNotNull(), seq))


def first_list(value: Column, seq: Column) -> Column:
    """First non-empty list in arrival order, as an aggregate."""
    usable = F.when(F.size(value) > 0, value)
    return F.min_by(usable, F.when(usable.isNotNull(), seq))


def time_set(times: Column) -> Column:
    """Sorted distinct non-empty times over all lists of a group."""
    # In generated code throughout: functions of a lambda are evaluated as objects, row by row.
    blanks = F.array(F.lit(""), F.lit(None).cast("string"))
    return F.sort_array(F.array_except(F.flatten(F.collect_set(times)), blanks))


def consolidate_showings(showings: DataFrame, *owner: str, seq: str = "showing_seq") -> DataFrame:
    """One row per owner, location, date, language, screen and set of attributes.

    Distinct times in order, first known URL. A missing language or screen is a value of its own.
    """
    attributes = F.array_sort(F.coalesce(F.col("session_attributes"), _strings()))
    keyed = showings.withColumns(
        {"language": filled(F.col("language")), "screen": filled(F.col("screen")), "session_attributes": attributes}
    )
    keys = [*owner, "cinema", "cinema_slug", "date", "language", "screen", "session_attributes"]
    return keyed.groupBy(*keys).agg(
        time_set(F.col("times")).alias("times"),
        first_filled(F.col("source_url"), F.col(seq)).alias("source_url"),
        F.min(seq).alias(seq),
    )


def merge_showings_per_key(showings: DataFrame, *keys: str, seq: str = "showing_seq") -> DataFrame:
    """One row per key: distinct sorted times, a screen only if it is the only one, first
    known language and ticket link."""
    # Two distinct screens are enough to know the screen is ambiguous.
    screen = filled(F.col("screen"))
    return showings.groupBy(*keys).agg(
        time_set(F.col("times")).alias("times"),
        first_filled(F.col("language"), F.col(seq)).alias("language"),
        F.when(F.min(screen) == F.max(screen), F.min(screen)).alias("screen"),
        first_filled(F.coalesce(filled(F.col("buy_url")), F.col("source_url")), F.col(seq)).alias("buy_url"),
        F.min(seq).alias(seq),
    )


def union_times(showings: DataFrame, *keys: str) -> DataFrame:
    """Union of the time lists per slot, other columns from the first arrival."""
    rest = [c for c in showings.columns if c not in (*keys, "times", "showing_seq")]
    return showings.groupBy(*keys).agg(
        time_set(F.col("times")).alias("times"),
        F.min("showing_seq").alias("showing_seq"),
        *[F.min_by(c, "showing_seq").alias(c) for c in rest],
    )


def linked_pairs(rows: DataFrame, group: str, row_id: str = "id") -> DataFrame:
    """Rows sharing a group value, as pairs ``a:b`` of the lowest id with each other one.

    The pairs connect every group completely, and their number grows with the rows; listing each
    pair of a group would grow with the square of its size.
    """
    # As a table the summary is a plain shuffle input, which lets AQE split a group that holds a
    # large share of the rows.
    lowest = materialise(rows.groupBy(group).agg(F.min(row_id).alias("a"), F.count("*").alias("n")).filter("n > 1"))
    pairs = lowest.join(rows.select(group, F.col(row_id).alias("b")), group).filter(F.col("b") > F.col("a"))
    return pairs.select(group, "a", "b", F.concat_ws(":", "a", "b").alias("pair"))


def count_future(showings: DataFrame, as_of: Column) -> DataFrame:
    """Showings from a date on, per location."""
    return showings.filter(F.col("date") >= as_of).groupBy("cinema_slug").agg(F.count("*").alias("showings_count"))


def count_active_in_window(showings: DataFrame, date_from: Column, date_to: Column) -> DataFrame:
    """Active showings inside a window, per location."""
    inside = F.col("removed_at").isNull() & F.col("date").between(date_from, date_to)
    return showings.filter(inside).groupBy("cinema_slug").agg(F.count("*").alias("existing"))


def showing_counts(showings: DataFrame) -> DataFrame:
    """Showings per film, archived ones included."""
    return showings.groupBy("film_id").agg(F.count("*").alias("showing_count"))


def latest_scraped_at(showings: DataFrame) -> DataFrame:
    """Newest insertion stamp, one row."""
    return showings.agg(F.max("scraped_at").alias("latest_scraped_at"))


def table_counts(**tables: DataFrame) -> DataFrame:
    """One row with the row count of each table, archived rows included."""
    counts = [table.agg(F.lit(name).alias("name"), F.count("*").alias("n")) for name, table in tables.items()]
    listed = counts[0]
    for other in counts[1:]:
        listed = listed.unionByName(other)
    return listed.agg(*[F.max(F.when(F.col("name") == name, F.col("n"))).alias(name) for name in tables])


def films_with_cinemas(showings: DataFrame, cinemas: DataFrame) -> DataFrame:
    """Per film, the sorted sets of names and slugs of the locations that show it."""
    pairs = showings.select("film_id", F.col("cinema_slug").alias("slug")).distinct()
    named = pairs.join(cinemas.select("slug", "name"), "slug")
    return named.groupBy("film_id").agg(
        F.array_sort(F.collect_set("name")).alias("cinema_names"),
        F.array_sort(F.collect_set("slug")).alias("cinema_slugs"),
    )


def showtimes_by_cinema(showings: DataFrame, cinemas: DataFrame) -> DataFrame:
    """Per film, date and location, the entries (time, screen, language, link) by name."""
    entries = showings.select(
        "film_id", "date", F.col("cinema_slug").alias("slug"), "screen", "language", "buy_url", F.explode("times").alias("time")
    )
    item = F.struct("time", "screen", "language", "buy_url")
    grouped = entries.groupBy("film_id", "date", "slug").agg(F.array_sort(F.collect_set(item)).alias("entries"))
    named = grouped.join(cinemas.select("slug", "name"), "slug", "left")
    return named.select("film_id", "date", "slug", F.coalesce("name", "slug").alias("name"), "entries")


def available_dates(showings: DataFrame) -> DataFrame:
    """Distinct dates in order."""
    return showings.select("date").distinct().orderBy("date")


def programme_report(
    films: DataFrame, showings: DataFrame, date_from=None, date_to=None, slug: str | None = None,
    order: list[str] | None = None, all_status: bool = False,
) -> DataFrame:
    """Per location, its films with sorted times per date; preferred locations come first.

    ``films`` needs ``film_id``, ``title`` and ``status``; no date bound means every date. With a
    ``slug``, the films that location shows, with their times at every location.
    """
    kept = films if all_status else films.filter(F.coalesce("status", F.lit("")) != "rimosso")
    if date_from is not None:
        showings = showings.filter(F.col("date").between(date_from, date_to if date_to is not None else date_from))
    if slug is not None:
        showings = showings.join(showings.filter(F.col("cinema_slug") == slug).select("film_id").distinct(), "film_id", "left_semi")
    slots = showings.groupBy("film_id", "cinema_slug", "date").agg(time_set(F.col("times")).alias("times"))
    position = F.array_position(F.array(*[F.lit(s) for s in order or []]).cast("array<string>"), F.col("cinema_slug"))
    # Listed locations keep their given order, the others follow by slug.
    rank = F.when(position > 0, position).otherwise(F.lit(2**31))
    listed = slots.join(kept.select("film_id", "title"), "film_id")
    return listed.select("cinema_slug", "title", "film_id", "date", "times", rank.alias("rank")).orderBy(
        "rank", "cinema_slug", "title", "film_id", "date"
    )


def programme_totals(report: DataFrame) -> DataFrame:
    """Films listed per location of a programme report."""
    return report.groupBy("cinema_slug").agg(F.count_distinct("film_id").alias("films"))
