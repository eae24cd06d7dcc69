"""Data-quality rules: each yields rows (level, rule, entity, detail), never an exception."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from playbill.operators.lifecycle import ACTIVE, REMOVED
from playbill.schema import blank

# The shapes a published file must have.
DATE_SHAPE = r"^\d{4}-\d{2}-\d{2}$"
TIME_SHAPE = r"^\d{2}:\d{2}$"
PLACE_URL_SHAPE = r"^https://www\.google\.com/maps/place/[^\s]+"

FINDING = "level string, rule string, entity string, detail string"


def findings(rows: DataFrame, entity: Column, rules: list[tuple[str, str, Column, Column]]) -> DataFrame:
    """Apply rules (level, name, condition, detail) in one pass over the rows."""
    cases = [
        F.when(condition, F.struct(F.lit(level).alias("level"), F.lit(name).alias("rule"), detail.cast("string").alias("detail")))
        for level, name, condition, detail in rules
    ]
    hits = F.filter(F.array(*cases), lambda c: c.isNotNull())
    return rows.select(entity.cast("string").alias("entity"), F.explode(hits).alias("f")).select("f.level", "f.rule", "entity", "f.detail")


def validate_films(films: DataFrame, showings: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """Findings on films, on their showings (linked by ``arrival_seq``) and on recorded errors."""
    none = F.lit(None)
    shown = showings.select("arrival_seq").distinct().withColumn("_shown", F.lit(True))
    judged = films.join(shown, "arrival_seq", "left")
    active = F.coalesce(F.col("status") == ACTIVE, F.lit(False))
    film = findings(
        judged,
        F.col("arrival_seq"),
        [
            ("error", "no title", blank(F.col("title")), none),
            ("warning", "no key", blank(F.col("title_normalized")), none),
            ("warning", "unknown status", ~F.coalesce(F.col("status").isin(ACTIVE, REMOVED), F.lit(False)), F.col("status")),
            ("warning", "active without poster", active & blank(F.col("poster")), none),
            ("error", "active without showings", active & F.col("_shown").isNull(), none),
        ],
    )
    wrong = F.filter(F.coalesce("times", F.array().cast("array<string>")), lambda t: ~F.coalesce(t.rlike(TIME_SHAPE), F.lit(False)))
    date = F.coalesce(F.col("date").cast("string"), F.lit(""))
    showing = findings(
        showings.withColumn("_wrong", wrong),
        F.col("arrival_seq"),
        [
            ("error", "bad date", ~date.rlike(DATE_SHAPE), date),
            ("warning", "no times", F.coalesce(F.size("times") <= 0, F.lit(True)), none),
            ("error", "no location name", blank(F.col("cinema")), none),
            ("warning", "no location slug", blank(F.col("cinema_slug")), none),
        ],
    )
    times = showings.select("arrival_seq", F.explode(wrong).alias("time"))
    bad_times = findings(times, F.col("arrival_seq"), [("error", "bad time", F.lit(True), F.col("time"))])
    found = film.unionByName(showing).unionByName(bad_times)
    if errors is not None:
        count = errors.agg(F.count("*").alias("n")).filter("n > 0")
        found = found.unionByName(findings(count, F.lit("run"), [("warning", "source errors", F.lit(True), F.col("n"))]))
    return found


def validate_cinemas(cinemas: DataFrame) -> DataFrame:
    """Findings on locations; an empty table is itself an error."""
    none = F.lit(None)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)) == 0
    place = F.col("maps_place_url")
    found = findings(
        cinemas,
        F.coalesce("slug", "name"),
        [
            ("error", "no slug", blank(F.col("slug")), none),
            ("warning", "no coordinates", zero("lat") | zero("lon"), none),
            ("warning", "no website", blank(F.col("website")), none),
            ("warning", "no place url", blank(place), none),
            ("error", "bad place url", ~blank(place) & ~place.rlike(PLACE_URL_SHAPE), place),
        ],
    )
    empty = cinemas.agg(F.count("*").alias("n")).filter("n = 0")
    return found.unionByName(findings(empty, F.lit("cinemas"), [("error", "no locations", F.lit(True), none)]))


def verdict(found: DataFrame) -> DataFrame:
    """One row: error and warning counts, and whether the run fails."""
    errors = F.count_if(F.col("level") == "error")
    return found.agg(errors.alias("errors"), F.count_if(F.col("level") == "warning").alias("warnings"), (errors > 0).alias("failed"))


COVERED = ("poster", "description", "genres", "director", "duration")


def field_coverage(films: DataFrame, showings: DataFrame) -> DataFrame:
    """One row per field: films that have it and their floor percentage, plus status counts."""
    shown = showings.select("arrival_seq").distinct().withColumn("_shown", F.lit(True))
    judged = films.join(shown, "arrival_seq", "left")
    has = {c: ~blank(F.col(c)) for c in COVERED if c != "genres"}
    has["genres"] = F.coalesce(F.size("genres") > 0, F.lit(False))
    has["showings"] = F.col("_shown").isNotNull()
    has["status_active"] = F.coalesce(F.col("status") == ACTIVE, F.lit(False))
    has["status_removed"] = F.coalesce(F.col("status") == REMOVED, F.lit(False))
    counts = judged.agg(F.count("*").alias("total"), *[F.count_if(condition).alias(name) for name, condition in has.items()])
    pairs = F.array(*[F.struct(F.lit(name).alias("field"), F.col(name).alias("films")) for name in has])
    long = counts.select("total", F.explode(pairs).alias("p")).select("p.field", "p.films", "total")
    percent = F.when(F.col("total") > 0, F.floor(100 * F.col("films") / F.col("total"))).otherwise(0)
    return long.withColumn("percent", percent.cast("int"))
