"""What plans must not do: send tables through the driver on an estimate, or read pages twice."""

from pyspark.sql import functions as F

from playbill.operators import similarity as sm
from playbill.session import configure
from playbill.sources import pages as pg, payloads as pl

FILM = '{\\"id\\":%s,\\"title\\":\\"t\\",\\"slug\\":\\"s\\",\\"permalink\\":\\"https://h.org/films/%s\\",\\"shows\\":%s}'


def planned(frame):
    return frame._jdf.queryExecution().sparkPlan().toString()


def test_venues_are_not_broadcast_before_they_are_measured(spark):
    configure(spark)
    number = F.col("id").cast("string")
    rows = spark.range(20_000)
    sources = rows.select(F.concat(F.lit("s"), number).alias("source_slug"), F.concat(F.lit("The Venue "), number).alias("name"), F.concat(F.lit("https://h.org/cinema/c"), number).alias("cinema_url"), F.lit(-1).cast("bigint").alias("venue_id"))
    node = F.to_json(F.struct(F.col("id").alias("cinemaId"), F.concat(F.lit("Venue "), number).alias("cinemaName")))
    venues = rows.select(F.col("id").alias("node_seq"), node.alias("node"))
    assert "Broadcast" not in planned(pl.resolve_venues(sources, venues))


def test_windows_of_keys_are_not_broadcast_before_they_are_measured(spark):
    configure(spark)
    keys = spark.range(20_000).select(F.md5(F.col("id").cast("string")).alias("key"))
    assert "Broadcast" not in planned(sm.containment_pairs(keys))


def test_pushed_pages_are_read_once(spark):
    film = lambda k, shows: F.concat(F.lit('<script>self.__next_f.push([1,"'), F.format_string(FILM, k, k, F.lit(shows)), F.lit('"])</script>'))
    day = '[{\\"date\\":\\"19980302\\",\\"orario\\":\\"20:30\\"}]'
    k = F.col("id").cast("string")
    body = F.when(F.col("id") == 1, film(k, "[]")).when(F.col("id") == 2, film(k, "[null]")).otherwise(F.concat(film(k, "[]"), film(k, day)))
    pages = spark.range(4).select(F.when(F.col("id") < 3, F.concat(F.lit("p"), k)).alias("url"), body.alias("body"))
    entries, shows = pg.extract_push_payload(pages)
    assert "MapInPandas" not in planned(entries.unionByName(entries)) + planned(shows)
    assert "Join" not in planned(entries)
    # No show, a show that says nothing, and a page without address: as when entries were joined with their shows.
    assert sorted(r.page_id for r in entries.collect()) == ["p0", "p2"]
    assert sorted((r.page_id or "", r.orario or "") for r in shows.collect()) == [("", "20:30"), ("p0", "20:30"), ("p2", "")]
