"""The published queries over the store tables. Every date is an argument; nothing reads a clock."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from playbill.functions import text as tx
from playbill.operators import grouping as gr, joins as jn
from playbill.plans import search_index as si

FILM_OUT = ("id", "title", "original_title", "year", "runtime_minutes", "genres", "director", "poster_url", "synopsis")
MIN_QUERY_LENGTH = 2
MAX_SEARCH_LIMIT = 100


class NotFound(LookupError):
    """The key of a point lookup does not exist; an empty list means it exists and has no rows."""


def _date(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value).cast("date")


@dataclass(frozen=True)
class Listing:
    """Queries over one version of the three store tables.

    ``index`` names an index of the films' keys (:mod:`playbill.plans.search_index`) that is up to date with them.
    """

    films: DataFrame
    showings: DataFrame
    cinemas: DataFrame
    index: str | None = None

    def films_between(self, date_from, date_to) -> DataFrame:
        """Films in programming in a range, both ends included."""
        return jn.films_in_programming(self.films, self.showings, _date(date_from), _date(date_to))

    def films_today(self, as_of) -> DataFrame:
        return self.films_between(as_of, as_of)

    def films_this_week(self, as_of) -> DataFrame:
        return self.films_between(as_of, F.date_add(_date(as_of), 6))

    def _matches(self, query: str) -> DataFrame:
        # The text is literal: an underscore is no wildcard, and a query of punctuation is empty.
        needle = tx.store_key(F.lit(query))
        found = (needle != "") & F.contains(F.col("title_normalized"), needle)
        wanted = F.lit(len(query.strip()) >= MIN_QUERY_LENGTH)
        films = self.films
        if self.index is not None:
            films = si.only_candidates(films, self.index, films.sparkSession.range(1).select(needle).first()[0])
        return jn.active_films(films).filter(wanted & found)

    def search(self, query: str, limit: int = 20) -> DataFrame:
        """Active films whose key contains the query, by title; a top-k, not a full sort."""
        if not 1 <= limit <= MAX_SEARCH_LIMIT:
            raise ValueError(f"limit must be between 1 and {MAX_SEARCH_LIMIT}")
        return self._matches(query).orderBy("title", "id").limit(limit)

    def search_with_cinemas(self, query: str, as_of, limit: int = 20) -> DataFrame:
        """Search results with the names of the locations that show them in the next days."""
        found = self.search(query, limit)
        coming = self._between(as_of, F.date_add(_date(as_of), 7)).join(found.select(F.col("id").alias("film_id")), "film_id", "left_semi")
        names = gr.films_with_cinemas(coming, self.cinemas).select(F.col("film_id").alias("id"), "cinema_names")
        none = F.array().cast("array<string>")
        return found.join(names, "id", "left").withColumn("cinema_names", F.coalesce("cinema_names", none)).orderBy("title", "id")

    def _between(self, date_from, date_to) -> DataFrame:
        inside = self.showings.filter(F.col("date").between(_date(date_from), _date(date_to)))
        return jn.active_showings(inside, self.films)

    def film_details(self, film_ids: DataFrame, as_of) -> DataFrame:
        """Active films of a key table with their coming showings, one row per showing.

        A film without coming showings has one row with a null ``showing``; an unknown film has
        none. In bulk the showings stay rows, however many one film has.
        """
        found = jn.active_films(self.films).join(film_ids.select("id").distinct(), "id", "left_semi")
        coming = self.showings.filter((F.col("date") >= _date(as_of)) & F.col("removed_at").isNull())
        item = F.struct("date", F.col("id").alias("showing_id"), "cinema_slug", "times", "language", "screen", "buy_url")
        return found.join(coming.select(F.col("film_id").alias("id"), item.alias("showing")), "id", "left")

    def film_detail(self, film_id: int, as_of) -> DataFrame:
        """One film with its coming showings as a list in date order, empty if there are none."""
        one = Listing(self.films.filter(F.col("id") == film_id), self.showings.filter(F.col("film_id") == film_id), self.cinemas)
        rows = one.film_details(one.films, as_of)
        listed = rows.groupBy(*one.films.columns).agg(F.array_sort(F.collect_list("showing")).alias("showings"))
        return _existing(listed, f"film {film_id}")

    def film(self, film_id: int) -> DataFrame:
        return _existing(jn.active_films(self.films).filter(F.col("id") == film_id), f"film {film_id}")

    def showing(self, showing_id: int) -> DataFrame:
        """Archived showings can be looked up too."""
        return _existing(self.showings.filter(F.col("id") == showing_id), f"showing {showing_id}")

    def cinema(self, slug: str) -> DataFrame:
        return _existing(self.cinemas.filter(F.col("slug") == slug), f"cinema {slug}")

    def lookup(self, table: str, keys: DataFrame, key: str) -> DataFrame:
        """Bulk form of the point lookups: rows of a table whose key is in ``keys``."""
        rows = jn.active_films(self.films) if table == "films" else getattr(self, table)
        return rows.join(keys.select(key).distinct(), key, "left_semi")

    def cinema_list(self) -> DataFrame:
        return self.cinemas.orderBy("name", "slug")

    def cinemas_with_count(self, as_of) -> DataFrame:
        """Locations with the number of their coming active showings."""
        coming = self.showings.filter(F.col("date") >= _date(as_of))
        counts = gr.count_future(jn.active_showings(coming, self.films), _date(as_of)).withColumnRenamed("cinema_slug", "slug")
        joined = self.cinemas.join(counts, "slug", "left")
        return joined.withColumn("showings_count", F.coalesce("showings_count", F.lit(0)))

    def cinema_with_count(self, slug: str, as_of) -> DataFrame:
        one = Listing(self.films, self.showings.filter(F.col("cinema_slug") == slug), self.cinema(slug))
        return one.cinemas_with_count(as_of)

    def schedule(self, date_from, date_to=None) -> DataFrame:
        """Showings in a range with film and location, by date; a week by default."""
        last = _date(date_to) if date_to is not None else F.date_add(_date(date_from), 7)
        inside = self.showings.filter(F.col("date").between(_date(date_from), last))
        return jn.denormalise(inside, self.films, self.cinemas).orderBy("date", "id")

    def cinema_schedule(self, slug: str, date_from, date_to=None) -> DataFrame:
        """Programme of one location; an unknown location is an error, not an empty list."""
        one = Listing(self.films, self.showings.filter(F.col("cinema_slug") == slug), self.cinema(slug))
        return one.schedule(date_from, date_to)

    def showings_on(self, date) -> DataFrame:
        return self.schedule(date, date)

    def daily_board(self, date, slug: str | None = None) -> DataFrame:
        """Films of a day over all locations with their names, by title."""
        day = self._between(date, date)
        if slug is not None:
            day = day.join(day.filter(F.col("cinema_slug") == slug).select("film_id"), "film_id", "left_semi")
        places = gr.films_with_cinemas(day, self.cinemas).withColumnRenamed("film_id", "id")
        return jn.active_films(self.films).join(places, "id").orderBy("title", "id")

    def featured(self, date, slug: str | None = None, count: int = 6) -> DataFrame:
        """First films of the board."""
        return self.daily_board(date, slug).limit(count)

    def showtimes(self, film_id: int, date) -> DataFrame:
        """Times of one film on one day, per location by name."""
        mine = self.showings.filter(F.col("film_id") == film_id)
        one = Listing(self.films, mine, self.cinemas)
        return gr.showtimes_by_cinema(one._between(date, date), self.cinemas).orderBy("name", "slug")

    def film_dates(self, film_id: int, as_of) -> DataFrame:
        """Days of the coming week with showings of a film; the first is where a client opens."""
        one = Listing(self.films, self.showings.filter(F.col("film_id") == film_id), self.cinemas)
        return gr.available_dates(one._between(as_of, F.date_add(_date(as_of), 6)))

    def freshness(self, now, stale_after_hours: float = 36) -> DataFrame:
        """One row: newest stamp, its age in hours, whether that is too old, and the counts.

        No data at all is stale. Archived showings count, as they do in the stored totals.
        """
        instant = now if isinstance(now, Column) else F.lit(now).cast("timestamp")
        latest = self.showings.agg(F.max("scraped_at").alias("latest_scraped_at"), F.count("*").alias("showings"))
        age = F.round((F.unix_micros(instant) - F.unix_micros("latest_scraped_at")) / 3_600_000_000, 2)
        aged = latest.withColumns({"age_hours": age, "stale_after_hours": F.lit(float(stale_after_hours))})
        stale = F.col("age_hours").isNull() | (F.col("age_hours") > stale_after_hours)
        return aged.withColumns({"is_stale": stale, "cinemas": gr.table_counts(cinemas=self.cinemas).scalar()})

    def dataset_counts(self) -> DataFrame:
        """One row with the table counts and the newest stamp."""
        counts = gr.table_counts(cinemas=self.cinemas, films=self.films, showings=self.showings)
        return counts.withColumn("latest_scraped_at", gr.latest_scraped_at(self.showings).scalar())


def _existing(rows: DataFrame, what: str) -> DataFrame:
    if rows.isEmpty():
        raise NotFound(what)
    return rows
