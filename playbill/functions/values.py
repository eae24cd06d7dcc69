"""Genres, durations, dates, URLs, codecs and history: built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from playbill.functions.text import strip
from playbill.schema import blank, filled

# ---- genres ---------------------------------------------------------------------------


def split_genres(text: Column) -> Column:
    """List of a ``a, b / c`` string; null and blanks give the empty list."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), "[,/]"), strip)
    return F.filter(parts, lambda g: g != "")


def clean_genres(items: Column, field: str | None = None) -> Column:
    """List form: of strings, or of objects whose ``field`` holds the name."""
    names = F.transform(F.filter(items, lambda g: g.isNotNull()), lambda g: F.coalesce(g[field], F.lit(""))) if field else F.filter(items, lambda g: ~blank(g))
    return F.coalesce(names, F.array().cast("array<string>"))


def variant_genres(value: Column) -> Column:
    """Genres of an unstable payload: string, list of strings or list of objects with ``name``."""
    objects = F.try_variant_get(value, "$", "array<struct<name:string>>")
    strings = F.try_variant_get(value, "$", "array<string>")
    kind = F.schema_of_variant(value)
    return (
        F.when(kind == "STRING", split_genres(F.try_variant_get(value, "$", "string")))
        .when(kind.startswith("ARRAY<OBJECT"), clean_genres(objects, "name"))
        .when(kind.startswith("ARRAY"), clean_genres(strings))
        .otherwise(F.array().cast("array<string>"))
    )


def genres_to_csv(items: Column) -> Column:
    """Comma-separated text; the empty list is null."""
    return F.when(F.size(items) > 0, F.array_join(items, ","))


def csv_to_genres(text: Column) -> Column:
    """List of a comma-separated text, trimmed; null gives the empty list."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), ","), strip)
    return F.filter(parts, lambda g: g != "")


# ---- durations ------------------------------------------------------------------------


def _group(text: Column, pattern: str, index: int) -> Column:
    # An absent group is the empty string; it counts as zero.
    return F.coalesce(F.regexp_extract(text, pattern, index).try_cast("bigint"), F.lit(0))


def _minutes(total: Column) -> Column:
    return F.concat(total.cast("string"), F.lit(" min"))


def normalize_duration(text: Column) -> Column:
    """``N min`` from ``H:MM[:SS]``, ``1h 49m`` or the first integer; null if there is none."""
    text = strip(text)
    clock, spoken = r"^(\d{1,2}):(\d{2})(?::(\d{2}))?$", r"(?i)(\d+)\s*h\s*(\d+)?\s*m?"
    clock_total = _group(text, clock, 1) * 60 + _group(text, clock, 2) + (_group(text, clock, 3) >= 30).cast("bigint")
    spoken_total = _group(text, spoken, 1) * 60 + _group(text, spoken, 2)
    return (
        F.when(text.rlike(clock), _minutes(clock_total))
        .when(text.rlike(spoken), _minutes(spoken_total))
        .when(text.rlike(r"\d"), _minutes(_group(text, r"(\d+)", 1)))
    )


def iso_duration(text: Column) -> Column:
    """``N min`` from ISO ``PT…``; an unreadable or zero ISO value is null, other text passes."""
    text = strip(text)
    pattern = r"(?i)^PT(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?$"
    total = _group(text, pattern, 1) * 60 + _group(text, pattern, 2) + (_group(text, pattern, 3) >= 30).cast("bigint")
    iso = F.when(text.rlike(pattern) & (total > 0), _minutes(total))
    return F.when(F.upper(text).startswith("PT"), iso).otherwise(filled(text))


def parse_minutes(text: Column) -> Column:
    """First integer of a text or number as minutes."""
    return F.regexp_extract(text.cast("string"), r"(\d+)", 1).try_cast("int")


# ---- dates and times ------------------------------------------------------------------


_ISO_START = r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}(?::?\d{2}(?::?\d{2}(?:[.,]\d+)?)?)?(?:Z|[+-]\d{2}:?\d{2}(?::?\d{2})?)?)?$"


# Stamps that are certain to be right, as they stand: a day that exists in every year, hours and minutes in range.
_DAY = r"[1-9]\d{3}-(?:(?:0[1-9]|1[0-2])-(?:0[1-9]|1\d|2[0-8])|(?:0[13-9]|1[0-2])-(?:29|30)|(?:0[13578]|1[02])-31)"
_CLOCK = r"[T ](?:[01]\d|2[0-3]):[0-5]\d(?::\d{2}(?:\.\d+)?)?(?:Z|[+-]\d{2}:?\d{2})?"


def _start_text(text: Column) -> Column:
    text = strip(text)
    day = F.substring(text, 1, 10).try_cast("date")
    hour = _group(text, r"^.{11}(\d{2})", 1)
    minute = _group(text, r"^.{11}\d{2}:?(\d{2})", 1)
    return F.when(text.rlike(_ISO_START) & day.isNotNull() & (hour < 24) & (minute < 60), text)


def start_date(text: Column) -> Column:
    """Calendar date (ISO text) of a start stamp, as written: the offset is never applied."""
    day = F.substring(text, 1, 10)
    return F.when(text.rlike(rf"^{_DAY}(?:{_CLOCK})?\z"), day).otherwise(F.substring(_start_text(text), 1, 10))


def start_time(text: Column) -> Column:
    """Wall-clock ``HH:MM`` of a start stamp, as written; a bare date starts at 00:00."""
    usual = F.when(text.rlike(rf"^{_DAY}{_CLOCK}\z"), F.substring(text, 12, 5))
    text = _start_text(text)
    hour = F.regexp_extract(text, r"^.{11}(\d{2})", 1)
    minute = F.regexp_extract(text, r"^.{11}\d{2}:?(\d{2})", 1)
    padded = F.concat_ws(":", *[F.when(part == "", "00").otherwise(part) for part in (hour, minute)])
    return F.coalesce(usual, F.when(text.isNotNull(), padded))


def compact_date(text: Column) -> Column:
    """ISO date of a ``YYYYMMDD`` text, null if it is not one."""
    return F.when(text.rlike(r"^\d{8}$"), F.date_format(F.try_to_date(text, "yyyyMMdd"), "yyyy-MM-dd"))


def parse_year(text: Column) -> Column:
    """First 19xx or 20xx of a text."""
    return F.regexp_extract(text, r"((?:19|20)\d{2})", 1).try_cast("int")


def window_dates(day: Column, days: int = 8) -> Column:
    """Array of consecutive dates; eight is the collection window, seven the client's week."""
    return F.sequence(day, F.date_add(day, days - 1))


def local_date(instant: Column, zone: str = "Europe/Rome") -> Column:
    """Calendar day of a UTC instant in a time zone."""
    return F.to_date(F.from_utc_timestamp(instant, zone))


# ---- URLs -----------------------------------------------------------------------------


def without_dots(url: Column) -> Column:
    """An absolute address with ``.`` and ``..`` segments of its path carried out.

    Segments go onto a stack from left to right; a ``..`` takes the last one off again, and does nothing at the root.
    """
    origin, path, rest = (F.regexp_extract(url, r"(?s)^([^:]+://[^/?#]*)([^?#]*)(.*)$", k) for k in (1, 2, 3))
    segments = F.split(F.substring(path, 2, 2**31 - 1), "/", -1)
    empty = F.array().cast("array<string>")

    def step(stack: Column, segment: Column) -> Column:
        up = F.when(F.size(stack) > 0, F.slice(stack, 1, F.size(stack) - 1)).otherwise(stack)
        return F.when(segment == "..", up).when(segment == ".", stack).otherwise(F.array_append(stack, segment))

    done = F.aggregate(segments, empty, step)
    # A path that ends in a dot segment names a folder.
    folder = F.when(F.element_at(segments, -1).isin(".", "..") & (F.size(done) > 0), F.lit("/")).otherwise(F.lit(""))
    dotted = url.rlike(r"^[^?#]*/\.\.?(?:[/?#]|$)")
    return F.when(dotted, F.concat(origin, F.lit("/"), F.array_join(done, "/"), folder, rest)).otherwise(url)


def absolute_url(url: Column, base: Column) -> Column:
    """Resolve a link against its page: absolute, scheme-relative, rooted, query or relative.

    Dot segments are removed, however many there are.
    """
    scheme = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*):", 1)
    origin = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    page = F.regexp_replace(base, r"[?#].*$", "")
    folder = F.when(page.rlike(r"^[^:]+://[^/]*$"), F.concat(page, F.lit("/"))).otherwise(
        F.regexp_replace(page, r"[^/]*$", "")
    )
    joined = (
        F.when(url.startswith("//"), F.concat(scheme, F.lit(":"), url))
        .when(url.startswith("/"), F.concat(origin, url))
        .when(url.startswith("?"), F.concat(page, url))
        .when(url.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), url))
        .otherwise(F.concat(folder, url))
    )
    # No dot segment comes from elsewhere; telling so is cheaper than reading the address once more.
    dots = F.contains(url, F.lit("/.")) | url.startswith(".") | F.contains(base, F.lit("/."))
    joined = F.when(dots, without_dots(joined)).otherwise(joined)
    return (
        F.when(blank(url), None)
        .when(url.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), url)
        .when(blank(base), url)
        .otherwise(joined)
    )


def clean_image_url(url: Column) -> Column:
    """Unwrap an image-optimiser link to the original it was asked for."""
    inner = F.regexp_extract(url, r"[?&]url=([^&#]+)", 1)
    decoded = F.try_url_decode(inner)
    return F.when(F.contains(url, F.lit("/_next/image")) & (inner != ""), F.coalesce(decoded, url)).otherwise(
        filled(url)
    )


def maps_url(place_url: Column, lat: Column, lon: Column) -> Column:
    """The saved place, or a search by coordinates when there is none."""
    search = F.concat(
        F.lit("https://www.google.com/maps/search/?api=1&query="),
        F.coalesce(lat.cast("string"), F.lit("")),
        F.lit(","),
        F.coalesce(lon.cast("string"), F.lit("")),
    )
    return F.coalesce(filled(place_url), search)


# ---- codecs ---------------------------------------------------------------------------


def times_to_json(times: Column) -> Column:
    """JSON text of a list of times."""
    return F.to_json(times)


def times_from_json(text: Column) -> Column:
    """List of times of a JSON text; unreadable text gives the empty list."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def drop_empty(column: Column) -> Column:
    """Null for an empty text, so that JSON output omits the field."""
    return filled(column)


def drop_empty_list(column: Column) -> Column:
    """Null for an empty list, so that JSON output omits the field."""
    return F.when(F.size(column) > 0, column)


# ---- showings and history -------------------------------------------------------------


def showing_signature(slug: Column, date: Column, times: Column) -> Column:
    """``slug:date:t1,t2``, the unit of change detection."""
    texts = [F.coalesce(c.cast("string"), F.lit("")) for c in (slug, date)]
    return F.concat_ws(":", *texts, F.coalesce(F.array_join(times, ","), F.lit("")))


def signatures(showings: Column) -> Column:
    """Sorted multiset of signatures of a nested list of showings."""
    listed = F.transform(showings, lambda s: showing_signature(s["cinema_slug"], s["date"], s["times"]))
    return F.array_sort(F.coalesce(listed, F.array().cast("array<string>")))


def showings_changed(old: Column, new: Column) -> Column:
    """The two nested lists differ as multisets of signatures."""
    return signatures(old) != signatures(new)


def _event_dates(history: Column, *actions: str) -> Column:
    kept = F.filter(history, lambda h: h["action"].isin(*actions))
    return F.transform(kept, lambda h: h["date"])


def first_seen(history: Column) -> Column:
    """Date of the first ``added`` event."""
    return F.try_element_at(_event_dates(history, "added"), F.lit(1))


def last_seen(history: Column) -> Column:
    """Date of the last ``added`` or ``updated`` event, else the first appearance."""
    return F.coalesce(F.try_element_at(_event_dates(history, "added", "updated"), F.lit(-1)), first_seen(history))


def last_removal(history: Column) -> Column:
    """Date of the last ``removed`` event, null if there was none."""
    return F.try_element_at(_event_dates(history, "removed"), F.lit(-1))


def last_showing_date(showings: Column) -> Column:
    """Latest date among nested showings, null if none is dated."""
    return F.array_max(F.transform(showings, lambda s: filled(s["date"])))
