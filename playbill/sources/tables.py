"""Snapshot files, versioned tables and run logs."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from playbill.functions import text as tx, values as vl
from playbill.operators.grouping import consolidate_showings
from playbill.operators.ranking import assign_ids
from playbill.plans.load import Snapshot
from playbill.schema import (
    CINEMA_ITEM, CINEMAS, CINEMAS_ENVELOPE, ERROR_RECORD, FILM_ITEM, FILM_RECORD, FILMS_ENVELOPE, HISTORY_STRUCT,
    SEQ, SHOWING_ITEM, SHOWING_RECORD, SHOWINGS_ENVELOPE, conform, ensure_columns, struct_type,
)
from playbill.session import materialise
from playbill.sources import manifest as mf

# ---- reading snapshots ----------------------------------------------------------------


def parse_window(date_from: str | None, date_to: str | None) -> tuple[str, str]:
    """The window of a snapshot; missing, unreadable or inverted is an error."""
    try:
        first, last = date.fromisoformat(date_from), date.fromisoformat(date_to)
    except (TypeError, ValueError) as error:
        raise ValueError(f"snapshot without a valid window: {date_from!r} to {date_to!r}") from error
    if last < first:
        raise ValueError(f"inverted snapshot window: {first} to {last}")
    return first.isoformat(), last.isoformat()


def _items(spark: SparkSession, path: str, schema: str, array: str) -> tuple[DataFrame, DataFrame]:
    envelope = spark.read.schema(schema).option("multiLine", True).json(path)
    rows = envelope.select(F.posexplode(array).alias("seq", "item")).select(F.col("seq").cast("bigint"), "item.*")
    return envelope, rows


def read_envelopes(spark: SparkSession, folder: str) -> Snapshot:
    """The three JSON envelopes of a folder; a missing file raises at once.

    One envelope is one JSON document and cannot be split: this is the exchange format of small
    deployments. Large snapshots use :func:`write_snapshot` and :func:`read_snapshot`.
    """
    _, cinemas = _items(spark, f"{folder}/cinemas.json", CINEMAS_ENVELOPE, "cinemas")
    _, films = _items(spark, f"{folder}/films.json", FILMS_ENVELOPE, "films")
    envelope, showings = _items(spark, f"{folder}/showings.json", SHOWINGS_ENVELOPE, "showings")
    window = envelope.select("date_from", "date_to").first()
    return Snapshot(cinemas, films, showings, *parse_window(window.date_from, window.date_to))


def read_snapshot(spark: SparkSession, root: str, version: int | None = None) -> Snapshot:
    """The same rows from versioned tables, which split and prune."""
    version = latest_version(spark, root) if version is None else version
    if version is None:
        raise FileNotFoundError(f"no published snapshot under {root}")
    tables = {name: read_table(spark, root, name, version) for name in ("cinemas", "films", "showings", "window")}
    window = tables["window"].first()
    return Snapshot(tables["cinemas"], tables["films"], tables["showings"], *parse_window(window.date_from, window.date_to))


def write_snapshot(films: DataFrame, showings: DataFrame, cinemas: DataFrame, date_from: str, date_to: str, root: str, version: int) -> None:
    """Publish exported tables and their window as one version."""
    window = films.sparkSession.createDataFrame([(date_from, date_to)], "date_from string, date_to string")
    publish({"cinemas": cinemas, "films": films, "showings": showings, "window": window}, root, version, {"showings": "date"})


# ---- versioned publishing -------------------------------------------------------------


def publish(tables: dict[str, DataFrame], root: str, version: int, partition_by: dict[str, str] | None = None) -> None:
    """Write every table of a version, then the manifest that makes it exist.

    Readers only follow committed versions, so a failed write is never seen, and the previous version stays readable. Of
    two writers of one version the second is told so, and the first one's tables stay as they are. No rename is
    needed, which object stores do not do atomically.
    """
    spark = next(iter(tables.values())).sparkSession
    if (last := latest_version(spark, root)) is not None and version <= last:
        raise ValueError(f"version {version} is not after the published {last}")
    by = partition_by or {}
    parts = {name: mf.write(table, root, name, F.col(by[name]) if name in by else None) for name, table in tables.items()}
    mf.commit(spark, root, mf.Manifest(version, parts))


def latest_version(spark: SparkSession, root: str) -> int | None:
    """Highest committed version, null before the first."""
    last = mf.latest(spark, root)
    return None if last is None else last.version


def read_table(spark: SparkSession, root: str, name: str, version: int | None = None, keys: list[str] | None = None) -> DataFrame:
    """One table of a version, the latest by default, or only some of its partition keys."""
    found = mf.latest(spark, root) if version is None else mf.load(spark, root, version)
    return mf.read(spark, root, found.tables[name], keys)


def read_previous(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """Latest version of a state table in its declared schema, empty before the first run.

    A column added since the table was written reads as null.
    """
    version = latest_version(spark, root)
    if version is None:
        return spark.createDataFrame([], struct_type(schema))
    stored = read_table(spark, root, name, version)
    return conform(ensure_columns(stored, {f.name: f.dataType.simpleString() for f in struct_type(schema).fields}), schema)


# ---- sources, cache, errors, archive ---------------------------------------------------


def union_sources(sources: dict[str, DataFrame]) -> DataFrame:
    """Rows of all sources under one schema, in source order (``source_pos``); a column a source
    lacks is null."""
    parts = [rows.withColumns({"source_slug": F.lit(slug), "source_pos": F.lit(n)}) for n, (slug, rows) in enumerate(sources.items())]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part, allowMissingColumns=True)
    return result


def number_arrivals(films: DataFrame, showings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Give united films their ``arrival_seq``, by source and then by order within it, and link
    their showings to it."""
    ordered = films.withColumn("_order", F.struct("source_pos", F.col("seq").cast(SEQ).alias("seq")))
    numbered = materialise(assign_ids(ordered, "_order", name="arrival_seq").drop("_order"))
    owner = numbered.select("source_slug", F.col("seq").cast(SEQ).alias("film_seq"), "arrival_seq")
    linked = showings.withColumn("film_seq", F.col("film_seq").cast(SEQ)).join(owner, ["source_slug", "film_seq"])
    return conform(numbered, FILM_RECORD), conform(linked.withColumnRenamed("seq", "showing_seq"), SHOWING_RECORD)


def failed_sources(attempts: DataFrame, compat: bool = False) -> DataFrame:
    """Sources that gave nothing usable: every attempt raised, or (unless ``compat``) the last one
    recorded errors and no rows. ``attempts`` is (source_slug, attempt, raised, errors, rows)."""
    last = attempts.groupBy("source_slug").agg(
        F.bool_and("raised").alias("raised"), F.max_by("errors", "attempt").alias("errors"), F.max_by("rows", "attempt").alias("rows")
    )
    broken = F.col("raised") if compat else F.col("raised") | ((F.col("errors") > 0) & (F.col("rows") == 0))
    return last.filter(broken).select("source_slug")


def last_known_good(current: DataFrame, cache: DataFrame, failed: DataFrame) -> DataFrame:
    """Current rows, with the cached rows of the sources that failed. A source that succeeded
    without rows stays empty."""
    good = current.join(failed, "source_slug", "left_anti")
    return good.unionByName(cache.join(failed, "source_slug", "left_semi"), allowMissingColumns=True)


def refresh_cache(current: DataFrame, failed: DataFrame, path: str) -> None:
    """Keep the rows of every source that worked: only the partitions written are replaced."""
    good = current.join(failed, "source_slug", "left_anti")
    _overwrite_partitions(good, path, "source_slug")


def _overwrite_partitions(rows: DataFrame, path: str, column: str) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


def archive_snapshot(state: DataFrame, run_date: str, path: str) -> None:
    """Dated copy of a state table; running twice on a day replaces that day."""
    _overwrite_partitions(state.withColumn("run_date", F.lit(run_date).cast("date")), path, "run_date")


def make_errors(rows: DataFrame, cinema: Column, exception: Column, phase: str, url: Column, detail: Column, at: Column) -> DataFrame:
    """Error records of rows that could not be used."""
    stamp = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")
    return rows.select(
        cinema.alias("cinema"), stamp.alias("timestamp"), exception.alias("exception"), F.lit(phase).alias("phase"), url.alias("url"), detail.alias("detail")
    )


def replace_errors_for_day(errors: DataFrame, day: str, path: str) -> None:
    """Replace the errors logged for a day and record how the day went, in one commit.

    A clean day only touches a log that exists: no log and no errors means nothing ran here yet. Other days are named
    again, not read; a writer of another day that commits first is taken in.
    """
    spark = errors.sparkSession
    rows = conform(errors, ERROR_RECORD).withColumn("day", F.lit(day).cast("date"))
    clean = errors.isEmpty()
    if clean and mf.latest(spark, path) is None:
        return
    part = mf.Part(rows.schema.json(), {}) if clean else mf.write(rows, path, "errors", F.col("day"))
    mf.amend(spark, path, lambda base: base.next(**{f"day {day}": "clean" if clean else "errors"}).with_parts("errors", part, [day]))


def read_errors(spark: SparkSession, path: str) -> DataFrame:
    """Logged errors of all days."""
    log = mf.latest(spark, path)
    if log is None:
        return spark.createDataFrame([], f"{ERROR_RECORD}, day date")
    return mf.read(spark, path, log.tables["errors"])


def error_summary(spark: SparkSession, path: str) -> DataFrame:
    """One row: last clean day and last day with errors."""
    log = mf.latest(spark, path)
    days = [(name.removeprefix("day "), status) for name, status in (log.marks if log else {}).items()]
    known = spark.createDataFrame(days, "day string, status string").withColumn("day", F.to_date("day"))
    return known.agg(
        F.max(F.when(F.col("status") == "clean", F.col("day"))).alias("last_clean_date"),
        F.max(F.when(F.col("status") == "errors", F.col("day"))).alias("last_error_date"),
    )


# ---- exports --------------------------------------------------------------------------


def export_films(films: DataFrame) -> DataFrame:
    """Published film rows: the key as id, decoded texts, first and last sighting."""
    return films.select(
        F.col("arrival_seq").alias("seq"),
        F.col("title_normalized").alias("id"),
        tx.decode_entities(F.col("title")).alias("title"),
        "title_normalized",
        "original_title",
        vl.clean_image_url(F.col("poster")).alias("poster"),
        tx.decode_entities(F.col("description")).alias("description"),
        F.coalesce("genres", F.array().cast("array<string>")).alias("genres"),
        "director",
        vl.normalize_duration(F.col("duration")).alias("duration"),
        "year",
        "wikidata_id",
        "status",
        vl.first_seen(F.col("history")).alias("first_seen"),
        vl.last_seen(F.col("history")).alias("last_seen"),
    )


def export_showings(films: DataFrame, showings: DataFrame) -> DataFrame:
    """Published showing rows: consolidated, with the key of their film."""
    keys = films.select("arrival_seq", F.col("title_normalized").alias("film_id"))
    merged = consolidate_showings(conform(showings, SHOWING_RECORD), "arrival_seq").join(keys, "arrival_seq")
    return merged.select(
        F.col("showing_seq").alias("seq"), "film_id", "cinema_slug", "date", "times", "screen", "source_url", "language", "session_attributes"
    )


def cinema_rows(locations: DataFrame) -> DataFrame:
    """Published location rows of a table of locations; columns it lacks are null, others are left out."""
    return conform(locations, f"seq bigint, {CINEMAS}")


def export_cinemas(spark: SparkSession, locations: dict[str, dict]) -> DataFrame:
    """A configured dictionary of locations as rows with their slug."""
    names = [f.name for f in struct_type(CINEMAS).fields]
    rows = [(seq, *({"slug": slug, **data}.get(n) for n in names)) for seq, (slug, data) in enumerate(locations.items())]
    return spark.createDataFrame(rows, f"seq bigint, {CINEMAS}")


def nest_state(films: DataFrame, showings: DataFrame) -> DataFrame:
    """One document per film with its consolidated showings and history; empty fields omitted.

    This is the exchange form. Jobs read and write the flat tables.
    """
    merged = consolidate_showings(conform(showings, SHOWING_RECORD), "arrival_seq")
    item = F.struct(
        "showing_seq", "cinema", "cinema_slug", "date", vl.drop_empty_list(F.col("times")).alias("times"), "screen",
        vl.drop_empty(F.col("source_url")).alias("source_url"), "language", vl.drop_empty_list(F.col("session_attributes")).alias("session_attributes"),
    )
    nested = merged.groupBy("arrival_seq").agg(F.array_sort(F.collect_list(item)).alias("present_in"))
    nested = nested.withColumn("present_in", F.transform("present_in", lambda s: s.dropFields("showing_seq")))
    joined = films.join(nested, "arrival_seq", "left")
    empty = F.array().cast(nested.schema["present_in"].dataType)
    return joined.select(
        tx.decode_entities(F.col("title")).alias("title"),
        tx.decode_entities(F.col("title_normalized")).alias("title_normalized"),
        vl.clean_image_url(F.col("poster")).alias("poster"),
        tx.decode_entities(F.col("description")).alias("description"),
        vl.drop_empty_list(F.col("genres")).alias("genres"),
        "status", "director", "original_title", vl.normalize_duration(F.col("duration")).alias("duration"), "year", "wikidata_id",
        F.coalesce("present_in", empty).alias("present_in"),
        F.coalesce("history", F.array().cast(f"array<{HISTORY_STRUCT}>")).alias("history"),
    )


def write_json_lines(rows: DataFrame, folder: str, name: str) -> None:
    """Write rows as JSON Lines, the splittable form of an envelope; empty fields are omitted."""
    rows.write.mode("overwrite").option("ignoreNullFields", True).json(f"{folder}/{name}")


def read_json_lines(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Rows written by :func:`write_json_lines`, in the declared schema of their envelope."""
    item = {"films": FILM_ITEM, "showings": SHOWING_ITEM, "cinemas": CINEMA_ITEM}[name]
    fields = struct_type(f"item {item}")["item"].dataType.fields
    return spark.read.schema(T.StructType([T.StructField("seq", T.LongType()), *fields])).json(f"{folder}/{name}")
