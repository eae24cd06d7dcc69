"""Building blocks of the reference SQL: the same tables and text rules, written for DuckDB."""

from playbill.functions import text as tx

FILMS = """films AS (SELECT p_partkey AS id, p_name || ' ' || p_type AS title, lower(p_name || ' ' || p_type) AS title_normalized,
 CASE WHEN p_size > 30 THEN p_type END AS original_title, CASE WHEN p_size <= 40 THEN 1990 + p_size // 20 END AS year, p_size AS runtime_minutes,
 p_type AS genres, CASE WHEN p_size > 3 THEN p_brand END AS director, CASE WHEN p_retailprice > 920 THEN 'http://img/' || p_brand END AS poster_url,
 CASE WHEN p_size > 25 THEN p_name END AS synopsis, CASE WHEN p_size <= 8 THEN 'Q' || p_brand || p_type || p_size END AS wikidata_id,
 CASE WHEN p_size = 50 THEN DATE '1999-01-01' END AS removed_at FROM part)"""

CINEMAS = """cinemas AS (SELECT 's' || s_suppkey AS slug, s_name AS name, n_name AS city, 'via ' || n_name AS address, r_name AS region, s_acctbal AS lat,
 CAST(s_nationkey AS DOUBLE) AS lon, CASE WHEN s_acctbal > 0 THEN 'http://' || s_name END AS website,
 CASE WHEN s_acctbal > 5000 THEN 'https://www.google.com/maps/place/' || s_suppkey WHEN s_acctbal > 4000 THEN 'http://elsewhere' END AS maps_place_url
 FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

CLOCK = "lpad(CAST(l_linenumber + 14 AS VARCHAR), 2, '0') || ':' || lpad(CAST(CAST(l_quantity AS INT) AS VARCHAR), 2, '0')"
SHOWINGS = f"""showings AS (SELECT (l_orderkey * 8 + l_linenumber) * 1048576 + (l_partkey * 131 + l_suppkey) % 1048576 AS id, l_partkey AS film_id, 's' || l_suppkey AS cinema_slug, CAST(l_shipdate AS DATE) AS date,
 {CLOCK} AS clock, l_returnflag AS language, l_linestatus AS screen, CASE WHEN l_tax < 0.04 THEN 'http://buy/' || l_orderkey END AS buy_url,
 CAST(l_shipdate AS DATE) - l_linenumber AS scraped_on, CASE WHEN l_tax >= 0.08 THEN DATE '1999-01-01' END AS removed_at FROM lineitem)"""

STORE = f"WITH {FILMS}, {CINEMAS}, {SHOWINGS}"
STORE_RECURSIVE = f"WITH RECURSIVE {FILMS}, {CINEMAS}, {SHOWINGS}"
# A showing counts if it is active and its film is.
ACTIVE = "active AS (SELECT s.* FROM showings s WHERE s.removed_at IS NULL AND EXISTS (SELECT 1 FROM films f WHERE f.id = s.film_id AND f.removed_at IS NULL))"

_FORMATS = "|".join(tx.FORMAT_SUFFIXES)
_LEADING = "|".join(tx.LEADING_WORDS).replace("'", "''")
_EDGE = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def normalize_title(text: str) -> str:
    """SQL of the readable canonical title."""
    out = _EDGE.format(f"translate(coalesce({text}, ''), '’‘“”–—', '''''\"\"--')")
    steps = [rf"\s*[-–]\s*({_FORMATS})$"] * 3 + [
        r"\s+4K\s*\(RIED\.?\s*\d{4}\)\s*(C\.A\.?)?\s*$",
        r"\s*[\(\[]?\s*(?:19|20)\d{2}\s*[\)\]]?\s*$",
        r"\s+C\.A\.?\s*$",
        r"\bAND\b",
        f"^(?:{_LEADING})",
    ]
    for pattern in steps:
        out = _EDGE.format(f"regexp_replace({out}, '(?i){pattern}', '', 'g')")
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'), ' .,;:!?-–—')"


def title_key(text: str) -> str:
    return rf"regexp_replace(lower({normalize_title(text)}), '[^\p{{L}}\p{{N}}_]', '', 'g')"


def store_key(text: str) -> str:
    """SQL of the accent-free key, for texts without compatibility characters."""
    return rf"trim(regexp_replace(regexp_replace(lower(replace(strip_accents({text}), '&', ' e ')), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def sequel(a: str, b: str) -> str:
    stem = lambda k: f"regexp_replace({k}, '[0-9]+$', '')"
    return f"({a} <> '' AND {b} <> '' AND {stem(a)} = {stem(b)} AND ({stem(a)} <> {a} OR {stem(b)} <> {b}))"
