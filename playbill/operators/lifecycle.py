"""Life cycle of films between runs: added, updated, missing, removed, forgotten.

The state is two flat tables, films with their history and showings linked by ``arrival_seq``, so
no film gathers its showings in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from playbill.functions import text as tx, values as vl
from playbill.operators.grouping import consolidate_showings
from playbill.operators.joins import last_wins
from playbill.schema import FILM_RECORD, HISTORY_STRUCT, SHOWING_RECORD, conform, filled

ACTIVE, REMOVED = "in_programmazione", "rimosso"
GRACE_DAYS = 7

STATE_FILMS = f"{FILM_RECORD}, history array<{HISTORY_STRUCT}>"


def film_key() -> Column:
    """Key under which a run recognises the films of the previous one."""
    return tx.title_key(F.coalesce(filled(F.col("title_normalized")), F.col("title")))


def changed_keys(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Keys whose showings differ as multisets of (location, date, times).

    Counting every signature with a sign compares the two sides exactly and distributed; no list
    of showings is built.
    """
    signature = vl.showing_signature(F.col("cinema_slug"), F.col("date"), F.col("times")).alias("signature")
    both = old.select(key, signature, F.lit(-1).alias("n")).unionByName(new.select(key, signature, F.lit(1).alias("n")))
    balance = both.groupBy(key, "signature").agg(F.sum("n").alias("n")).filter("n <> 0")
    return balance.select(key).distinct()


def merge_lifecycle(
    films: DataFrame, showings: DataFrame, prev_films: DataFrame, prev_showings: DataFrame, today: str, grace_days: int = GRACE_DAYS
) -> tuple[DataFrame, DataFrame]:
    """Full new state (films, showings) from the films of a run and the previous state.

    Known films keep their history, their poster if the run has none and the fuller description.
    Missing films stay without showings while their last date is at most ``grace_days`` old, are
    then marked removed, and are dropped after twice as long.
    """
    films, prev_films = conform(films, STATE_FILMS), conform(prev_films, STATE_FILMS)
    showings, prev_showings = conform(showings, SHOWING_RECORD), conform(prev_showings, SHOWING_RECORD)
    day = F.lit(today).cast("date")
    no_history = F.array().cast(f"array<{HISTORY_STRUCT}>")

    def event(action: str) -> Column:
        return F.array(F.struct(F.lit(today).alias("date"), F.lit(action).alias("action")))

    new = films.withColumn("film_key", film_key())
    old = last_wins(prev_films.withColumn("film_key", film_key()).filter("film_key <> ''"), "film_key", seq="arrival_seq")
    old = old.withColumn("history", F.coalesce("history", no_history))

    def keyed(rows: DataFrame, owners: DataFrame) -> DataFrame:
        plain = consolidate_showings(rows, "arrival_seq")
        return plain.join(owners.select("arrival_seq", "film_key"), "arrival_seq")

    changed = changed_keys(keyed(prev_showings, old), keyed(showings, new), "film_key").withColumn("changed", F.lit(True))
    before = old.select("film_key", F.lit(True).alias("known"), F.col("history").alias("p_history"), F.col("poster").alias("p_poster"), F.col("description").alias("p_description"))
    seen = new.join(before, "film_key", "left").join(changed, "film_key", "left")
    known = F.col("known").isNotNull()
    history = F.when(~known, event("added")).when(F.col("changed"), F.concat("p_history", event("updated"))).otherwise(F.col("p_history"))
    present = seen.withColumns(
        {
            "history": history,
            "status": F.when(known & (F.col("status") == REMOVED), REMOVED).otherwise(ACTIVE),
            "poster": F.coalesce(filled(F.col("poster")), filled(F.col("p_poster"))),
            "description": tx.pick_fuller(F.col("description"), F.col("p_description")),
        }
    ).select(*films.columns)

    last = prev_showings.groupBy("arrival_seq").agg(F.max(filled(F.col("date"))).alias("last_date"))
    gone = old.join(new.select("film_key").distinct(), "film_key", "left_anti").join(last, "arrival_seq", "left")
    removed_for = F.coalesce(F.date_diff(day, vl.last_removal(F.col("history")).try_cast("date")), F.lit(0))
    unseen_for = F.coalesce(F.date_diff(day, F.col("last_date").try_cast("date")), F.lit(grace_days + 1))
    was_removed = F.coalesce(F.col("status") == REMOVED, F.lit(False))
    fate = (
        F.when(was_removed & (removed_for > 2 * grace_days), "forget")
        .when(was_removed, "still removed")
        .when(unseen_for > grace_days, "remove")
        .otherwise("grace")
    )
    told = F.exists("history", lambda h: h["action"] == "removed")
    gone = gone.withColumn("fate", fate).filter("fate <> 'forget'").withColumns(
        {
            "status": F.when(F.col("fate") == "grace", ACTIVE).otherwise(REMOVED),
            "history": F.when((F.col("fate") == "remove") | ((F.col("fate") == "grace") & ~told), F.concat("history", event("removed"))).otherwise(F.col("history")),
        }
    )
    # Films carried over come after those of the run: their numbers move behind the last new one.
    shift = films.agg((F.coalesce(F.max("arrival_seq"), F.lit(-1)) + 1).alias("shift"))
    moved = gone.withColumn("arrival_seq", F.col("arrival_seq") + shift.scalar())
    state_films = present.unionByName(moved.select(*films.columns))

    kept = gone.filter("fate <> 'grace'").select("arrival_seq")
    carried = prev_showings.join(kept, "arrival_seq", "left_semi")
    carried = carried.withColumn("arrival_seq", F.col("arrival_seq") + shift.scalar()).select(*showings.columns)
    return state_films, showings.unionByName(carried)


def published(films: DataFrame, showings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Films that are not removed and have at least one time, with all their showings."""
    timed = showings.filter(F.size("times") > 0).select("arrival_seq")
    shown = films.filter(F.col("status") != REMOVED).join(timed, "arrival_seq", "left_semi")
    return shown, showings.join(shown.select("arrival_seq"), "arrival_seq", "left_semi")


def poster_fallback(films: DataFrame) -> DataFrame:
    """Use the image of the source when nothing better is known."""
    return films.withColumn("poster", F.coalesce(filled(F.col("poster")), filled(F.col("source_poster"))))
