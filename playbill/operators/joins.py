"""Key resolution, natural-key matching, keyed upserts and soft-delete reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from playbill.session import materialise

from playbill.schema import filled


def resolve_key(rows: DataFrame, lookup: DataFrame, text_key: str, id_column: str) -> tuple[DataFrame, DataFrame]:
    """(rows with their id, orphans): text key to id; ``lookup`` is (text_key, id_column).

    ``lookup`` has a row per key, so a task's share of it is a small hash table, and the rows need no sorting.
    """
    lookup = lookup.hint("shuffle_hash")
    resolved = rows.join(lookup, text_key).drop(text_key)
    orphans = rows.join(lookup, text_key, "left_anti")
    return resolved, orphans


def active_films(films: DataFrame) -> DataFrame:
    return films.filter(F.col("removed_at").isNull())


def active_showings(showings: DataFrame, films: DataFrame) -> DataFrame:
    """Showings that are active and whose film is active."""
    current = active_films(films).select(F.col("id").alias("film_id"))
    return showings.filter(F.col("removed_at").isNull()).join(current, "film_id", "left_semi")


def films_in_programming(films: DataFrame, showings: DataFrame, date_from: Column, date_to: Column) -> DataFrame:
    """Active films with at least one active showing in a range, by title.

    The semi join needs no distinct, and the date bounds reach the scan of the showings.
    """
    inside = showings.filter(F.col("removed_at").isNull() & F.col("date").between(date_from, date_to))
    shown = inside.select(F.col("film_id").alias("id"))
    return active_films(films).join(shown, "id", "left_semi").orderBy("title", "id")


def denormalise(showings: DataFrame, films: DataFrame, cinemas: DataFrame) -> DataFrame:
    """Active showings with their film and location as nested structs."""
    film_columns = [c for c in films.columns if c not in ("removed_at", "created_at")]
    film = active_films(films).select(F.col("id").alias("film_id"), F.struct(*film_columns).alias("film"))
    cinema = cinemas.select(F.col("slug").alias("cinema_slug"), F.struct(*cinemas.columns).alias("cinema"))
    return showings.filter(F.col("removed_at").isNull()).join(film, "film_id").join(cinema, "cinema_slug")


def match_natural_key(incoming: DataFrame, films: DataFrame, seq: str = "seq") -> DataFrame:
    """(seq, id): the film of each incoming (title_normalized, year).

    An exact match wins (lowest id); otherwise the only candidate whose year, or the incoming
    year, is unknown. Two candidates are a doubt, and a doubt is no match. The candidates are
    summarised per key before the join, so a homonym shared by many films stays one row.
    """
    exact_side = materialise(films.groupBy("title_normalized", "year").agg(F.min("id").alias("exact_id")))
    open_side = films.groupBy("title_normalized").agg(
        F.count("*").alias("all_n"),
        F.min("id").alias("all_id"),
        F.count_if(F.col("year").isNull()).alias("open_n"),
        F.min(F.when(F.col("year").isNull(), F.col("id"))).alias("open_id"),
    )
    rows = incoming.select(seq, "title_normalized", "year")
    exact = rows.alias("i").join(
        exact_side.alias("e"),
        (F.col("i.title_normalized") == F.col("e.title_normalized")) & F.col("i.year").eqNullSafe(F.col("e.year")),
        "left",
    ).select("i.*", "exact_id")
    full = exact.join(materialise(open_side), "title_normalized", "left")
    lone = (
        F.when(F.col("year").isNull() & (F.col("all_n") == 1), F.col("all_id"))
        .when(F.col("year").isNotNull() & (F.col("open_n") == 1), F.col("open_id"))
    )
    return full.select(seq, F.coalesce("exact_id", lone).alias("id")).filter("id is not null")


def match_external_id(incoming: DataFrame, films: DataFrame, seq: str = "seq") -> DataFrame:
    """(seq, id): owner of the external id, lowest id first, archived films included."""
    owners = films.filter(F.col("wikidata_id").isNotNull()).groupBy("wikidata_id").agg(F.min("id").alias("id"))
    return incoming.select(seq, "wikidata_id").join(owners, "wikidata_id").select(seq, "id")


def last_wins(rows: DataFrame, *keys: str, seq: str = "seq") -> DataFrame:
    """Last row per key."""
    rest = [c for c in rows.columns if c not in (*keys, seq)]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("row"), F.max(seq).alias(seq))
    return last.select(*keys, seq, "row.*")


def upsert_by_key(state: DataFrame, incoming: DataFrame, key: str = "slug", seq: str = "seq") -> DataFrame:
    """Insert or overwrite every field; the last duplicate of a key wins."""
    latest = last_wins(incoming, key, seq=seq).drop(seq)
    kept = state.join(latest.select(key), key, "left_anti")
    return kept.select(*state.columns).unionByName(latest.select(*state.columns))


SLOT = ["film_id", "cinema_slug", "date"]


def upsert_showings(state: DataFrame, incoming: DataFrame, now: Column, seq: str | None = None) -> DataFrame:
    """One row per slot: new slots are inserted (id null, stamped now), known ones take times,
    language, screen and link from the snapshot and keep id, ``scraped_at`` and ``removed_at``.

    With ``seq``, rows of listed slots carry it from the snapshot, and ``listing``: 1, or higher for further stored rows of
    the slot. Both are null for rows that the snapshot does not list, so that nobody needs to join it again.
    """
    given = [seq] if seq else []
    fresh = incoming.select(*SLOT, F.struct("times", "language", "screen", "buy_url", *given).alias("new"))
    if seq:
        # In the partitions and in the order that the join asks for anyway.
        state = state.withColumn("_copy", F.row_number().over(Window.partitionBy(*SLOT).orderBy("id")))
    joined = state.join(fresh, SLOT, "full_outer")
    pick = lambda name: F.when(F.col("new").isNotNull(), F.col(f"new.{name}")).otherwise(F.col(name)).alias(name)
    inserted = F.col("id").isNull()
    return joined.select(
        "id", *SLOT, *[pick(c) for c in ("times", "language", "screen", "buy_url")],
        F.when(inserted, now).otherwise(F.col("scraped_at")).alias("scraped_at"), "removed_at",
        *[F.col(f"new.{c}").alias(c) for c in given],
        *[F.when(F.col("new").isNotNull(), F.coalesce("_copy", F.lit(1))).alias("listing") for _ in given],
    )


def reconcile_rows(state: DataFrame, keep: DataFrame, keys: list[str], now: Column, eligible: Column | None = None) -> DataFrame:
    """Archive active rows that are not kept and reactivate archived rows that are.

    Nothing is deleted and a first removal stamp is never moved. Keys compare null-safely. Adds
    ``action``: archived, reactivated or null.
    """
    marks = keep.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct().withColumn("_kept", F.lit(True))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    joined = state.join(marks, on, "left")
    kept = F.col("_kept").isNotNull()
    allowed = F.lit(True) if eligible is None else F.coalesce(eligible, F.lit(False))
    action = F.when(allowed & ~kept & F.col("removed_at").isNull(), "archived").when(
        allowed & kept & F.col("removed_at").isNotNull(), "reactivated"
    )
    moved = joined.withColumn("action", action)
    stamp = F.when(F.col("action") == "archived", now).when(F.col("action").isNull(), F.col("removed_at"))
    return moved.withColumn("removed_at", stamp).select(*state.columns, "action")


def skipped_sources(existing: DataFrame, imported: DataFrame, min_ratio: float) -> DataFrame:
    """Locations whose snapshot looks broken: far fewer showings than are already known.

    ``existing`` is (cinema_slug, existing), ``imported`` is (cinema_slug, imported).
    """
    both = existing.join(imported, "cinema_slug", "left").withColumn("imported", F.coalesce("imported", F.lit(0)))
    return both.filter((F.col("existing") > 0) & (F.col("imported") < F.lit(float(min_ratio)) * F.col("existing")))


def tally_locations(upserted: DataFrame, date_from: Column, date_to: Column) -> DataFrame:
    """(cinema_slug, existing, imported) of rows with their ``listing``: active showings in the window, and listed slots."""
    existing = F.col("date").between(date_from, date_to) & F.col("removed_at").isNull()
    counts = {"existing": existing, "imported": F.col("listing") == 1}
    return upserted.groupBy("cinema_slug").agg(*[F.count_if(c).alias(name) for name, c in counts.items()])


def reconcile_showings(
    state: DataFrame, keep: DataFrame, cinemas: DataFrame, date_from: Column, date_to: Column, min_ratio: float, now: Column, tally: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(showings with ``action``, skipped locations). Only rows inside the window, of listed
    locations whose snapshot is not suspiciously small, are touched.

    With a ``tally`` of the locations over all rows, ``state`` and ``keep`` may be those in doubt only.
    """
    inside = F.col("date").between(date_from, date_to)
    listed = cinemas.select(F.col("slug").alias("cinema_slug")).distinct()
    if tally is None:
        existing = (
            state.filter(inside & F.col("removed_at").isNull())
            .join(listed, "cinema_slug", "left_semi")
            .groupBy("cinema_slug")
            .agg(F.count("*").alias("existing"))
        )
        imported = keep.select(*SLOT).distinct().groupBy("cinema_slug").agg(F.count("*").alias("imported"))
    else:
        existing = tally.select("cinema_slug", "existing").join(listed, "cinema_slug", "left_semi")
        imported = tally.select("cinema_slug", "imported")
    skipped = skipped_sources(existing, imported, min_ratio)
    open_sources = listed.join(skipped, "cinema_slug", "left_anti").withColumn("_open", F.lit(True))
    marked = state.join(open_sources, "cinema_slug", "left")
    done = reconcile_rows(marked, keep, SLOT, now, F.col("_open").isNotNull() & inside)
    return done.select(*state.columns, "action"), skipped


