"""The nightly run: sources → one film each → enrichment → life cycle → published tables."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import DataFrame

from playbill.operators import fuse as fz, lifecycle as lc
from playbill.plans import history as hs
from playbill.schema import FILM_RECORD, SHOWING_RECORD, conform
from playbill.session import materialise
from playbill.sources import tables as tb

Source = tuple[DataFrame, DataFrame, DataFrame]


@dataclass(frozen=True)
class NightlyResult:
    """Full state for the next run, and the rows to publish."""

    state_films: DataFrame
    state_showings: DataFrame
    films: DataFrame
    showings: DataFrame
    errors: DataFrame
    worklist: DataFrame


def gather(sources: dict[str, Source]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(films, showings, errors) of all sources, tagged and in source order."""
    films, showings, errors = (tb.union_sources({slug: parts[k] for slug, parts in sources.items()}) for k in range(3))
    return films, showings, errors


def run_nightly(
    sources: dict[str, Source],
    prev_films: DataFrame,
    prev_showings: DataFrame,
    dimension: DataFrame,
    today: str,
    failed: DataFrame | None = None,
    cache: tuple[DataFrame, DataFrame] | None = None,
    aliases: list[tuple[str, str]] | None = None,
) -> NightlyResult:
    """One run over the results of the sources.

    ``cache`` holds the last good (films, showings), substituted for the sources in ``failed``.
    Nothing is written to the store here; the caller publishes the returned tables.
    """
    films, showings, errors = gather(sources)
    if failed is not None and cache is not None:
        films = tb.last_known_good(films, cache[0], failed)
        showings = tb.last_known_good(showings, cache[1], failed)
    films, showings = tb.number_arrivals(films, showings)

    fused, labels = fz.fuse_by_title(films, aliases)
    fused = materialise(conform(fused, FILM_RECORD))
    showings = fz.rekey_showings(showings, labels)

    worklist = fz.enrichment_worklist(fused, dimension)
    enriched = materialise(conform(fz.enrich(fused, dimension), FILM_RECORD))
    single, same_id = fz.fuse_by_external_id(enriched, aliases)
    single = materialise(conform(single, FILM_RECORD))
    showings = materialise(conform(fz.rekey_showings(showings, same_id), SHOWING_RECORD))

    state_films, state_showings = lc.merge_lifecycle(single, showings, prev_films, prev_showings, today)
    state_films, state_showings = materialise(state_films), materialise(state_showings)
    shown, shown_showings = lc.published(state_films, state_showings)
    shown = lc.poster_fallback(shown)
    return NightlyResult(
        state_films, state_showings, tb.export_films(shown), tb.export_showings(shown, shown_showings), errors.drop("source_pos"), worklist
    )


def publish_run(
    result: NightlyResult, cinemas: DataFrame, window: list[str], state_root: str, snapshot_root: str, version: int, today: str, nested_copy: bool = True
) -> None:
    """Write the state, what changed in it that day, the snapshot and the errors of the day.

    ``nested_copy`` also writes the exchange form of the whole state for the day. Large states go without: any past day of theirs is read
    with :func:`past_state`.
    """
    tb.publish({"films": result.state_films, "showings": result.state_showings}, state_root, version, {"showings": "date"})
    tb.write_snapshot(result.films, result.showings, cinemas, window[0], window[-1], snapshot_root, version)
    keys = result.state_films.select("arrival_seq", "title_normalized")
    # Numbers of a run are no part of what is listed: with them every row would be another one each night.
    hs.record_day(result.state_films.drop("arrival_seq"), today, f"{state_root}/days/films")
    hs.record_day(result.state_showings.join(keys, "arrival_seq").drop("arrival_seq", "showing_seq"), today, f"{state_root}/days/showings")
    if nested_copy:
        tb.archive_snapshot(tb.nest_state(result.state_films, result.state_showings), today, f"{state_root}/history")
    tb.replace_errors_for_day(result.errors, today, f"{state_root}/log")


def previous_state(spark, state_root: str) -> tuple[DataFrame, DataFrame]:
    """State of the last run, empty before the first."""
    return tb.read_previous(spark, state_root, "films", lc.STATE_FILMS), tb.read_previous(spark, state_root, "showings", SHOWING_RECORD)


def past_state(spark, state_root: str, day: str) -> tuple[DataFrame, DataFrame]:
    """(films, showings) of the state as it was after the run of a day; showings name their film by ``title_normalized``."""
    return hs.as_of(spark, f"{state_root}/days/films", day), hs.as_of(spark, f"{state_root}/days/showings", day)


def run_window(today: str, days: int = 8) -> list[str]:
    """ISO dates a run covers: today and the following days."""
    first = date.fromisoformat(today)
    return [(first + timedelta(days=n)).isoformat() for n in range(days)]

