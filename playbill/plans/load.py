"""Loading a snapshot into the store: state version n and a snapshot give version n + 1."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from playbill.functions import text as tx, values as vl
from playbill.operators import grouping as gr, joins as jn
from playbill.operators.ranking import assign_ids
from playbill.operators.upsert import upsert_films
from playbill.schema import CINEMAS, FILMS, SHOWINGS, blank, conform, ensure_columns, filled
from playbill.session import groups_of_sorted_rows, materialise
from playbill.sources import manifest as mf

DEFAULT_REGION = "Umbria"
DEFAULT_MIN_RATIO = 0.5


@dataclass(frozen=True)
class Snapshot:
    """Rows of the three published files in file order (``seq``), and the window they cover."""

    cinemas: DataFrame
    films: DataFrame
    showings: DataFrame
    date_from: str
    date_to: str


@dataclass(frozen=True)
class Store:
    """The three tables of one version.

    ``showings`` may be those of some days only, if a load touches no others; ``last_showing`` is then the highest id of all.
    """

    cinemas: DataFrame
    films: DataFrame
    showings: DataFrame
    last_showing: int | None = None

    def tables(self) -> dict[str, DataFrame]:
        return {"cinemas": self.cinemas, "films": self.films, "showings": self.showings}


@dataclass(frozen=True)
class LoadResult:
    """New version, counters (one row), and the tables a person looks at."""

    store: Store
    report: DataFrame
    skipped_cinemas: DataFrame
    identity_conflicts: DataFrame
    duplicate_titles: DataFrame
    shared_external_ids: DataFrame
    orphans: DataFrame
    rejected: DataFrame


def cinema_rows(cinemas: DataFrame) -> DataFrame:
    """Snapshot locations as store rows; a missing region takes the default."""
    rows = conform(cinemas, f"seq bigint, {CINEMAS}")
    return rows.withColumn("region", F.coalesce("region", F.lit(DEFAULT_REGION)))


def film_rows(films: DataFrame) -> DataFrame:
    """Snapshot films as store fields; both spellings of a field are accepted, neither is required."""
    optional = ["id", "original_title", "duration", "runtime_minutes", "director", "poster", "poster_url", "synopsis", "description", "wikidata_id"]
    films = ensure_columns(films, dict.fromkeys(optional, "string") | {"year": "int", "genres": "array<string>"})
    return films.select(
        "seq",
        F.coalesce(filled(F.col("id")), F.col("title")).alias("json_key"),
        "title",
        "original_title",
        "year",
        vl.parse_minutes(F.coalesce(filled(F.col("duration")), F.col("runtime_minutes"))).alias("runtime_minutes"),
        vl.genres_to_csv(F.col("genres")).alias("genres"),
        "director",
        F.coalesce(filled(F.col("poster")), filled(F.col("poster_url"))).alias("poster_url"),
        F.coalesce(filled(F.col("synopsis")), filled(F.col("description"))).alias("synopsis"),
        filled(F.col("wikidata_id")).alias("wikidata_id"),
    )


def identity_conflicts(records: DataFrame, films: DataFrame, lookup: DataFrame) -> DataFrame:
    """(a, b): the film a record resolved to and another film that owns its external id."""
    owners = films.filter("wikidata_id is not null").groupBy("wikidata_id").agg(F.max("id").alias("b"))
    claims = records.filter("wikidata_id is not null").select("json_key", "wikidata_id")
    resolved = claims.join(lookup.select("json_key", F.col("id").alias("a")), "json_key").join(owners, "wikidata_id")
    return resolved.filter("a <> b").select("a", "b", F.concat_ws(":", "a", "b").alias("pair")).distinct()


def duplicate_titles(films: DataFrame) -> DataFrame:
    """Active films with the same key and no year: one film twice, or two nobody dated."""
    doubtful = films.filter("removed_at is null and year is null")
    return gr.linked_pairs(doubtful, "title_normalized")


def shared_external_ids(films: DataFrame) -> DataFrame:
    """Films sharing an external id; the store is sound when this is empty."""
    return gr.linked_pairs(films.filter("wikidata_id is not null"), "wikidata_id")


def load_snapshot(
    store: Store, snapshot: Snapshot, now: Column, archive: bool = True, min_ratio: float = DEFAULT_MIN_RATIO
) -> LoadResult:
    """Upsert a snapshot and reconcile what it no longer lists. Nothing is deleted, and nothing
    is published here: the caller writes the returned version as a whole."""
    cinemas_in = cinema_rows(snapshot.cinemas)
    no_slug = cinemas_in.filter(blank(F.col("slug"))).select(F.lit("cinema without slug").alias("reason"), "seq")
    cinemas_in = cinemas_in.filter(~blank(F.col("slug")))
    films_in = film_rows(snapshot.films)
    no_title = films_in.filter(blank(F.col("title"))).select(F.lit("film without title").alias("reason"), "seq")
    films_in = films_in.filter(~blank(F.col("title")))

    cinemas = materialise(conform(jn.upsert_by_key(conform(store.cinemas, CINEMAS), cinemas_in), CINEMAS))
    films, records = upsert_films(conform(store.films, FILMS), films_in, now)
    films = materialise(films)
    named = films_in.select("seq", "json_key", "wikidata_id").join(records, "seq")
    lookup = materialise(named.groupBy("json_key").agg(F.max_by("id", "seq").alias("id")))

    listed = ensure_columns(snapshot.showings, dict.fromkeys(["screen", "language", "source_url", "buy_url"], "string") | {"times": "array<string>"})
    raw = listed.withColumns({"json_key": F.col("film_id"), "day": F.col("date").cast("string").try_cast("date")}).drop("film_id", "date")
    bad = raw.filter("day is null or cinema_slug is null").select(F.lit("showing without date or location").alias("reason"), "seq")
    good = raw.filter("day is not null and cinema_slug is not null").withColumnRenamed("day", "date")
    resolved, orphans = jn.resolve_key(good, lookup.select("json_key", F.col("id").alias("film_id")), "json_key", "film_id")
    # Nearly every slot is listed once, so partial groups would only be larger than the rows: one exchange and one sort
    # serve both the groups and the join with the store. Ids, guard and reconciliation need no other pass over the slots.
    merged = gr.merge_showings_per_key(resolved.repartition(*jn.SLOT).sortWithinPartitions(*jn.SLOT), *jn.SLOT, seq="seq")
    upserted = jn.upsert_showings(conform(store.showings, SHOWINGS), merged, now.cast("timestamp"), "seq")
    with groups_of_sorted_rows(upserted.sparkSession):
        upserted, highest = materialise(upserted, F.max("id").alias("id"))
    numbered = _number_showings(upserted, highest["id"] if store.last_showing is None else store.last_showing)

    rejected = no_slug.unionByName(no_title).unionByName(bad)
    showings = numbered.drop("listing")
    skipped = showings.select("cinema_slug").limit(0)
    counted = {"archived_films": 0, "reactivated_films": 0, "archived_showings": 0, "reactivated_showings": 0}
    moves = {}
    if archive:
        keep_films = records.select("title_normalized", "year").distinct()
        done_films = jn.reconcile_rows(films, keep_films, ["title_normalized", "year"], now.cast("timestamp"))
        window = [F.lit(d).cast("date") for d in (snapshot.date_from, snapshot.date_to)]
        tally = materialise(jn.tally_locations(upserted.filter(_STAYS), *window))
        # A row changes only if it is active and no longer listed, or listed again: the others pass as they are.
        doubt = F.coalesce(F.col("date").between(*window) & (F.col("listing").isNull() == F.col("removed_at").isNull()), F.lit(False))
        doubtful = numbered.filter(doubt)
        keep = doubtful.filter("listing is not null")
        done_showings, skipped = jn.reconcile_showings(doubtful.drop("listing"), keep, cinemas_in, *window, min_ratio, now.cast("timestamp"), tally)
        actions = [F.count_if(F.col("action") == a).alias(a) for a in ("archived", "reactivated")]
        films, moves["films"] = materialise(done_films, *actions)
        done_showings, moves["showings"] = materialise(done_showings, *actions)
        films = films.drop("action")
        showings = numbered.filter(~doubt).drop("listing").unionByName(done_showings.drop("action"))
        counted = {f"{a}_{t}": moves[t][a] for t in moves for a in ("archived", "reactivated")}

    conflicts = identity_conflicts(films_in, films, lookup)
    doubles, shared = duplicate_titles(films), shared_external_ids(films)
    counts = gr.table_counts(cinemas=cinemas_in, films=films_in, showings=upserted.filter("listing = 1"), orphans=orphans, skipped_cinemas=skipped, identity_conflicts=conflicts, duplicate_titles=doubles, shared_external_ids=shared)
    summary = counts.withColumns({name: F.lit(value).cast("bigint") for name, value in counted.items()})
    return LoadResult(Store(cinemas, films, showings), summary, skipped, conflicts, doubles, shared, orphans, rejected)


#: Upserted rows that have an id or get one.
_STAYS = "id is not null or listing is not null"


def _number_showings(upserted: DataFrame, last: int | None) -> DataFrame:
    """Give ids to inserted showings, in arrival order after the highest known one."""
    showings = upserted.drop("seq")
    numbered = assign_ids(upserted.filter("id is null and listing is not null").drop("id"), "seq", last or 0, keep_seq=False)
    return showings.filter("id is not null").unionByName(numbered.select(*showings.columns))


# ---- loads into a versioned store --------------------------------------------------------

#: Partition keys of showings: days, or months where a store covers many years.
DAY, MONTH = "yyyy-MM-dd", "yyyy-MM"
_TEXT = {DAY: "%Y-%m-%d", MONTH: "%Y-%m"}


def day_key(day: Column, grain: str = DAY) -> Column:
    """The partition key of a date."""
    return F.date_format(day, grain)


def touched_keys(snapshot: Snapshot, grain: str = DAY) -> list[str]:
    """Keys of the showings that a load may change: those of its window, and of the showings it lists outside it.

    They are as many as there are days, whatever the size of the snapshot.
    """
    first, last = date.fromisoformat(snapshot.date_from), date.fromisoformat(snapshot.date_to)
    inside = {(first + timedelta(n)).strftime(_TEXT[grain]) for n in range((last - first).days + 1)}
    listed = snapshot.showings.select(day_key(F.col("date").cast("string").try_cast("date"), grain).alias("key")).filter("key is not null").distinct()
    return sorted(inside | {r["key"] for r in listed.collect()})


def read_store(spark: SparkSession, root: str, version: mf.Manifest | None, keys: list[str] | None = None) -> Store:
    """The tables of a version, or with some keys of its showings only; empty ones before the first."""
    if version is None:
        return Store(*[spark.createDataFrame([], ddl) for ddl in (CINEMAS, FILMS, SHOWINGS)], last_showing=0)
    cinemas, films = (mf.read(spark, root, version.tables[name]) for name in ("cinemas", "films"))
    return Store(cinemas, films, mf.read(spark, root, version.tables["showings"], keys), version.marks.get("last_showing"))


def load_version(spark: SparkSession, root: str, snapshot: Snapshot, now: Column, grain: str = DAY, **options) -> tuple[mf.Manifest, LoadResult]:
    """Load a snapshot into the versioned store under ``root``: the new version and what the load did.

    Showings are kept by day (``grain``). Only the days of the window and those that the snapshot lists are read, changed and
    written; the new version names the folders of all others again. Films and cinemas, which a load may change anywhere,
    are written whole. A store keeps the grain of its first load. Another load that commits first makes this one
    fail with :class:`~playbill.sources.manifest.VersionTaken`, with nothing changed.
    """
    base = mf.latest(spark, root)
    grain = base.marks["grain"] if base else grain
    keys = touched_keys(snapshot, grain)
    result = load_snapshot(read_store(spark, root, base, keys), snapshot, now, **options)
    store = result.store
    showings = mf.write(store.showings, root, "showings", day_key(F.col("date"), grain))
    last = mf.read(spark, root, showings).agg(F.max("id")).first()[0] or 0
    version = (base or mf.FIRST).next(last_showing=max(last, base.marks["last_showing"] if base else 0), grain=grain)
    version = version.with_parts("showings", showings, keys)
    for name, table in (("cinemas", store.cinemas), ("films", store.films)):
        version = version.with_parts(name, mf.write(table, root, name), [""])
    return mf.commit(spark, root, version), result
