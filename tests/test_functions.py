"""Scalar functions against known values."""

import html
import re
import unicodedata
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from playbill.functions import text as tx, values as vl


def table(apply, function, cases, kind="string"):
    got = apply(function(F.col("x")), [(c[0],) for c in cases], f"x {kind}")
    assert dict(zip([str(c[0]) for c in cases], got)) == {str(c[0]): c[1] for c in cases}


def test_normalize_title(apply):
    table(
        apply,
        tx.normalize_title,
        [
            ("  Hello   World  ", "Hello World"),
            ("Film (2024)", "Film"),
            ("Amori e incantesimi 2", "Amori e incantesimi 2"),
            ("", ""),
            (None, ""),
            ("Avatar - 3D - IMAX", "Avatar"),
            ("Dune – VOST", "Dune"),
            ("Il Padrino 4K (RIED. 1972) C.A.", "Padrino"),
            ("STAR WARS: Andor", "Andor"),
            ("Romeo and Juliet", "Romeo Juliet"),
            ("1917", ""),
            ("L’ultimo “bacio”", "L'ultimo \"bacio\""),
        ],
    )
    assert apply(tx.normalize_title(F.col("x"), compat=False), [("1917",), ("Dune (2021)",)], "x string") == ["1917", "Dune"]


def test_title_key_and_match(apply):
    table(apply, tx.title_key, [("Hello World", "helloworld"), ("Dune – Parte 2", "duneparte2")])
    pairs = [
        ("DUNE", "dune", True),
        ("Dune (2021)", "Dune", True),
        ("Dune", "Dune Part Two", True),
        ("Oppenheimer", "Openheimer", True),
        ("", "", True),
        ("Amori e incantesimi 2", "Amori e incantesimi", False),
        ("Oppenheimer", "Barbie", False),
        ("Dune", "Ring", False),
    ]
    got = apply(tx.fuzzy_match(F.col("a"), F.col("b")), [p[:2] for p in pairs], "a string, b string")
    assert got == [p[2] for p in pairs]


def test_durations(apply):
    table(
        apply,
        vl.normalize_duration,
        [
            (None, None), ("120", "120 min"), ("100 minuti", "100 min"), ("01:45", "105 min"), ("1:45:30", "106 min"),
            ("1h 30m", "90 min"), ("2h", "120 min"), ("PT1H49M", "109 min"), ("boh", None), ("", None),
        ],
    )
    table(
        apply,
        vl.iso_duration,
        [("PT1H49M", "109 min"), ("PT102M", "102 min"), ("PTM", None), ("109 min", "109 min"), ("PT0M", None), ("PT9M30S", "10 min"), (None, None)],
    )
    table(apply, vl.parse_minutes, [("109 min", 109), (None, None), ("x", None)])


def test_store_key_known_values(apply):
    table(
        apply,
        tx.store_key,
        [
            ("Città Perduta", "citta perduta"),
            ("Ricchi…da morire – Delitti", "ricchi da morire delitti"),
            ("It's Wonderful!", "it s wonderful"),
            ("AMORI & INCANTESIMI 2", "amori e incantesimi 2"),
            ("Amori e incantesimi 2", "amori e incantesimi 2"),
            ("a_b", "a_b"),
        ],
    )


def test_store_key_equals_unicode_rule(apply):
    """Every assigned character outside Hangul decomposes as the Unicode database says."""

    def rule(text):
        plain = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
        plain = re.sub(r"[^\w\s]", " ", plain.replace("&", " e ").lower())
        return re.sub(r"\s+", " ", plain).strip()

    words = [f"a{chr(c)}b" for c in (*range(0x20, 0x600), *range(0x2000, 0x2600), *range(0xF900, 0xFE00)) if unicodedata.category(chr(c))[0] in "LNPSZ"]
    got = apply(tx.store_key(F.col("x")), [(w,) for w in words], "x string")
    wrong = [(w, g, rule(w)) for w, g in zip(words, got) if g != rule(w)]
    assert not wrong, wrong[:20]


def test_descriptions(apply):
    table(apply, tx.is_truncated, [("abc...", True), ("abc… ", True), ("abc.", False), (None, False)])
    cases = [("", "b", "b"), (None, None, None), ("cut...", "x", "x"), ("abc", "abd", "abc"), ("ab", "abc", "abc"), ("a", None, "a"), ("aaa...", "b...", "aaa...")]
    assert apply(tx.pick_fuller(F.col("a"), F.col("b")), [c[:2] for c in cases], "a string, b string") == [c[2] for c in cases]


def test_markup(apply):
    table(apply, tx.strip_html, [("<p>A test film</p>", "A test film"), ("&lt;b&gt;x&lt;/b&gt; &amp; y", "x & y"), (None, None)])
    table(apply, lambda c: tx.decode_entities(c, code_units=True), [("a \\u0026amp; b", "a & b"), ("plain", "plain")])
    table(apply, tx.clean_director, [(" (Mario Rossi) ", "Mario Rossi"), ("()", None), (None, None)])


def test_dates(apply):
    cases = [
        ("2026-09-20T18:30:00+02:00", "2026-09-20", "18:30"), ("2026-09-20T18:30:00Z", "2026-09-20", "18:30"),
        ("2026-09-20", "2026-09-20", "00:00"), ("2026-02-30T10:00", None, None), ("x", None, None), (None, None, None),
        ("2026-09-20 21:15", "2026-09-20", "21:15"),
    ]
    rows = [(c[0],) for c in cases]
    assert apply(vl.start_date(F.col("x")), rows, "x string") == [c[1] for c in cases]
    assert apply(vl.start_time(F.col("x")), rows, "x string") == [c[2] for c in cases]
    table(apply, vl.compact_date, [("20260920", "2026-09-20"), ("2026092", None), ("20260230", None)])
    table(apply, vl.parse_year, [("+2021-10-22T00:00:00Z", 2021), ("12", None), (None, None)])
    week = apply(vl.window_dates(F.to_date("x")), [("2026-09-25",)], "x string")[0]
    assert [str(week[0]), str(week[-1]), len(week)] == ["2026-09-25", "2026-10-02", 8]
    midnight = apply(vl.local_date(F.to_timestamp("x")).cast("string"), [("2026-06-10 22:30:00",), ("2026-06-10 21:30:00",)], "x string")
    assert midnight == ["2026-06-11", "2026-06-10"]


URLS = ["/a/b", "c/d.jpg", "../x", "../../../y", "./z", "?q=1", "//cdn.org/i.png", "https://o.org/p", "#top", "a/../b/./c", "mailto:x@y.z"]


@pytest.mark.parametrize("base", ["https://h.org", "https://h.org/", "https://h.org/one/two?p=1#f", "http://h.org/one/"])
def test_absolute_url_equals_the_rfc(apply, base):
    got = apply(vl.absolute_url(F.col("x"), F.lit(base)), [(u,) for u in URLS], "x string")
    assert dict(zip(URLS, got)) == {u: urljoin(base, u) for u in URLS}


def test_image_and_map_urls(apply):
    table(apply, vl.clean_image_url, [("https://h/_next/image?url=https%3A%2F%2Fx%2Fy.jpg&w=1", "https://x/y.jpg"), ("/_next/image?w=1&url=%2Fq", "/q"), ("https://x/y.jpg", "https://x/y.jpg"), (None, None)])
    got = apply(vl.maps_url(F.col("p"), F.col("a"), F.col("o")), [(None, 43.1, 12.3), ("https://m", 1.0, 2.0)], "p string, a double, o double")
    assert got == ["https://www.google.com/maps/search/?api=1&query=43.1,12.3", "https://m"]


def test_genres(apply):
    table(apply, vl.split_genres, [("Drammatico, Thriller / Noir,", ["Drammatico", "Thriller", "Noir"]), (None, [])])
    v = lambda c: vl.variant_genres(F.try_parse_json(c))
    table(apply, v, [('"a, b"', ["a", "b"]), ('[{"name":"x"},{"name":"y"}]', ["x", "y"]), ('["p","q"]', ["p", "q"]), ("null", []), ("[]", [])])
    assert apply(vl.genres_to_csv(vl.csv_to_genres(F.col("x"))), [("a, b",), (None,)], "x string") == ["a,b", None]


def test_history(apply):
    ddl = "h array<struct<date:string,action:string>>"
    rows = [([("2026-06-10", "added"), ("2026-06-11", "removed")],), ([("2026-06-10", "added"), ("2026-06-12", "updated")],), ([],)]
    assert apply(vl.last_removal(F.col("h")), rows, ddl) == ["2026-06-11", None, None]
    assert apply(vl.last_seen(F.col("h")), rows, ddl) == ["2026-06-10", "2026-06-12", None]
    assert apply(vl.first_seen(F.col("h")), rows, ddl) == ["2026-06-10", "2026-06-10", None]


def test_showings_changed(apply):
    item = "array<struct<cinema_slug:string,date:string,times:array<string>>>"
    one, two = [("c", "2026-06-10", ["18:00"])], [("c", "2026-06-10", ["18:00", "20:30"])]
    rows = [(one, one), (one, two), (one + two, two + one)]
    assert apply(vl.showings_changed(F.col("a"), F.col("b")), rows, f"a {item}, b {item}") == [False, True, False]


def test_times_codec(apply):
    assert apply(vl.times_from_json(vl.times_to_json(F.col("t"))), [(["18:00"],), ([],)], "t array<string>") == [["18:00"], []]
    table(apply, vl.times_from_json, [("bad", []), ('["1"]', ["1"]), (None, [])])


def test_entity_decoder_is_the_standard_one(apply):
    words = ["&agrave;", "&#39;", "&notit;", "&amp;amp;", "&CounterClockwiseContourIntegral;", "no"]
    assert apply(tx.decode_entities(F.col("x")), [(w,) for w in words], "x string") == [html.unescape(w) for w in words]


def test_plain_values_equal_the_whole_rule(apply):
    words = ["Film 12x", "Alien 3", "Film 1999", "Alien1984", "Fish and Chips", "Andorra", "The Wall", "Theory", "IL Sole", "LA  X", "Dc Comics", "Marvel", "a  b", " a", "a ", "", "Dune - 3D", "Pixar X"]
    # A closing letter outside ASCII sends the same title through every pattern.
    told = apply(F.struct(tx.normalize_title(F.col("t")), tx.normalize_title(F.concat("t", F.lit("\u2003")))), [(w,) for w in words], "t string")
    assert all(fast == whole for fast, whole in told)
    stamps = ["2024-02-29", "2023-02-29", "2024-04-31", "2024-12-31T23:59", "2024-12-31T24:00", "2024-01-01T20:61", "2024-01-01T20:15:00.5+01:00", "2024-01-01 09:05Z", "2024-01-01T2015", "2024-01-01T20+01:00", "x", None]
    read = apply(F.struct(vl.start_date(F.col("s")), vl.start_time(F.col("s")), vl.start_date(F.concat("s", F.lit("\n"))), vl.start_time(F.concat("s", F.lit("\n")))), [(s,) for s in stamps], "s string")
    assert [tuple(r[:2]) for r in read] == [tuple(r[2:]) for r in read]
    assert tuple(read[0][:2]) == ("2024-02-29", "00:00") and read[1][0] is None and read[3][1] == "23:59"
