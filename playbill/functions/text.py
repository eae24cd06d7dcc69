"""Title and text functions, all as column expressions that stay inside code generation.

The single exception is :func:`decode_entities`: HTML has over two thousand named entities, so it
uses the standard library through Arrow, and only for rows that hold an ampersand.
"""

from __future__ import annotations

import html
import json
import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from playbill.schema import blank

# ---- Fixed values: they decide the keys, so they must not change between releases. ----

# Screening-format labels that may close a title after a dash.
FORMAT_SUFFIXES = [
    "3D", "IMAX", "HFR", "4DX", "ScreenX", "EPIC", "Dolby Atmos", "Dolby Cinema", "VIP", "Gold", "OV", "VOST", "VO",
    "VF", "Versione Originale", "Sottotitolato", "Sub ITA", "Live", "Event", "F&S", "Family", "Kids", "Matinée",
    "Sera", "Notte",
]
# Franchise names and articles dropped from the front of a title, as patterns.
LEADING_WORDS = [
    r"STAR WARS:\s*", r"MARVEL(?:'S)?\s+", r"DC\s+", r"PIXAR\s+", r"Disney\s+", r"THE\s+", r"IL\s+", r"LA\s+",
]
REISSUE_SUFFIX = r"\s+4K\s*\(RIED\.?\s*\d{4}\)\s*(C\.A\.?)?\s*$"
OPEN_AIR_SUFFIX = r"\s+C\.A\.?\s*$"
LOOSE_YEAR_SUFFIX = r"\s*[\(\[]?\s*(?:19|20)\d{2}\s*[\)\]]?\s*$"
BRACKETED_YEAR_SUFFIX = r"\s*[\(\[]\s*(?:19|20)\d{2}\s*[\)\]]\s*$"
EDGE_PUNCTUATION = " .,;:!?-–—"
MAX_STACKED_SUFFIXES = 3
# Verified alternative titles: (form seen in a source, form to show).
TITLE_ALIASES = [("CARS - MOTORI RUGGENTI - 20MO ANNIVERSARIO", "Cars – 20esimo anniversario")]
TRUNCATED_TAIL = r"(\.{3}|…)\s*$"
# Titles that no rule changes: ASCII words with single spaces, no word that is dropped and no year at the end.
_PLAIN_TITLE = rf"^(?!(?i:{'|'.join(LEADING_WORDS)}))(?!(?i:.*\bAND\b))[A-Za-z0-9]++(?: [A-Za-z0-9]++)*+(?<!(?:19|20)\d\d)\z"

# ---------------------------------------------------------------------------------------


def _sub(column: Column, pattern: str, replacement: str = "") -> Column:
    # (?U): \w, \s, \d and \b follow Unicode; Java's defaults are ASCII only.
    return F.regexp_replace(column, f"(?iU){pattern}", replacement)


def strip(column: Column) -> Column:
    """Trim any Unicode white space; the SQL ``trim`` only knows the space character."""
    return F.regexp_replace(column, r"(?U)^\s+|\s+$", "")


def normalize_title(title: Column, compat: bool = True) -> Column:
    """Readable canonical form of a title, case kept; null gives the empty string.

    ``compat`` strips a trailing year with or without brackets ("1917" becomes empty), which is
    how existing keys were made; without it a year must stand in brackets to be dropped.
    """
    formats = "|".join(re.escape(label) for label in FORMAT_SUFFIXES)
    plain = title.rlike(_PLAIN_TITLE)
    text = F.translate(strip(F.coalesce(title, F.lit(""))), "’‘“”–—", "''\"\"--")
    for _ in range(MAX_STACKED_SUFFIXES):
        text = strip(_sub(text, rf"\s*[-–]\s*({formats})$"))
    year = LOOSE_YEAR_SUFFIX if compat else BRACKETED_YEAR_SUFFIX
    for pattern in (REISSUE_SUFFIX, year, OPEN_AIR_SUFFIX, r"\bAND\b", f"^(?:{'|'.join(LEADING_WORDS)})"):
        text = strip(_sub(text, pattern))
    # Twenty patterns in a row; most titles need only the one that tells so.
    return F.when(plain, title).otherwise(F.trim(_sub(text, r"\s+", " "), F.lit(EDGE_PUNCTUATION)))


def title_key(title: Column, compat: bool = True) -> Column:
    """Comparison key: normalised, lower case, no punctuation, no spaces."""
    return F.regexp_replace(F.lower(normalize_title(title, compat)), r"(?U)[^\p{L}\p{N}_]", "")


def titles_match(a: Column, b: Column) -> Column:
    """Equality of comparison keys, hence usable as an equi-join condition."""
    return title_key(a) == title_key(b)


def is_numbered_sequel(key_a: Column, key_b: Column) -> Column:
    """One key is the other plus closing digits ("x2" and "x")."""
    stem_a, stem_b = (F.regexp_replace(k, "[0-9]+$", "") for k in (key_a, key_b))
    return (key_a != "") & (key_b != "") & (stem_a == stem_b) & ((stem_a != key_a) | (stem_b != key_b))


def typo_budget(length: Column) -> Column:
    """Tolerated edits for a key length: one per four characters, never fewer than two."""
    return F.greatest(F.lit(2), F.floor(length / 4).cast("int"))


def within_distance(a: Column, b: Column, budget: Column) -> Column:
    """Bounded Levenshtein test: Spark stops early and answers -1 beyond the budget."""
    return F.call_function("levenshtein", a, b, budget) >= 0


def fuzzy_keys(key_a: Column, key_b: Column) -> Column:
    """Tolerant match of two comparison keys; ``key_a`` arrived first and sets the budget."""
    near = (
        F.contains(key_a, key_b)
        | F.contains(key_b, key_a)
        | within_distance(key_a, key_b, typo_budget(F.length(key_a)))
    )
    return (key_a == key_b) | (~is_numbered_sequel(key_a, key_b) & near)


def fuzzy_match(a: Column, b: Column) -> Column:
    """Tolerant match of two titles."""
    return fuzzy_keys(title_key(a), title_key(b))


def edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance."""
    return F.levenshtein(a, b)


# ---- descriptions ---------------------------------------------------------------------


def is_truncated(text: Column) -> Column:
    """The text ends in an ellipsis: a CMS cut it. Null is not truncated."""
    return F.coalesce(text.rlike(f"(?U){TRUNCATED_TAIL}"), F.lit(False))


def pick_fuller(a: Column, b: Column) -> Column:
    """The whole text beats the cut one, then the longer wins, then the first."""
    prefer_a = F.when(is_truncated(a) != is_truncated(b), is_truncated(b)).otherwise(F.length(a) >= F.length(b))
    return F.when(blank(a), b).when(blank(b), a).when(prefer_a, a).otherwise(b)


def fullest(text: Column, seq: Column) -> Column:
    """Aggregate form of :func:`pick_fuller` over a group ordered by ``seq``.

    The pairwise rule is a total order, so a single ``max_by`` with partial aggregation replaces a
    fold, whatever the size of the group.
    """
    usable = F.when(~blank(text), text)
    rank = F.when(usable.isNotNull(), F.struct((~is_truncated(text)).cast("int"), F.length(text), -seq))
    return F.max_by(usable, rank)


# ---- store key ------------------------------------------------------------------------


@lru_cache(maxsize=1)
def _decompositions() -> tuple[str, str, str, dict[str, str]]:
    """Compatibility decomposition without combining marks, derived from the Unicode database.

    Returns (mapped characters, their single replacements, characters to delete, expansions).
    Hangul syllables stay composed: they would need a table of eleven thousand rows, and two
    titles are equal in one form exactly when they are in the other.
    """
    source, target, dropped, expanded = [], [], [], {}
    for code in (*range(0x80, 0x3100), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800)):
        char = chr(code)
        plain = "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c))
        if plain == char:
            continue
        if len(plain) == 1:
            source.append(char)
            target.append(plain)
        elif not plain:
            dropped.append(char)
        else:
            expanded[char] = plain
    return "".join(source), "".join(target), "".join(dropped), expanded


def _strip_marks(text: Column) -> Column:
    source, target, dropped, expanded = _decompositions()
    # The class is given by escaped code points: some members mean something inside brackets.
    rare = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in expanded) + "]"
    # A folded JSON constant plans much faster than a map expression with a child per entry.
    table = F.from_json(F.lit(json.dumps(expanded)), "map<string,string>")
    spelled = F.array_join(
        F.transform(F.split(text, ""), lambda c: F.coalesce(F.try_element_at(table, c), c)), ""
    )
    # translate() deletes the characters that have no counterpart in the third argument.
    return F.translate(F.when(text.rlike(rare), spelled).otherwise(text), source + dropped, target)


def store_key(title: Column) -> Column:
    """Accent-free key of the store: marks dropped, ``&`` read as "e", punctuation to spaces."""
    # ASCII titles, the large majority, skip the Unicode tables.
    plain = F.when(title.rlike(r"^\p{ASCII}*$"), title).otherwise(_strip_marks(title))
    words = F.regexp_replace(F.lower(F.replace(plain, F.lit("&"), F.lit(" e "))), r"(?U)[^\p{L}\p{N}_\s]", " ")
    return F.trim(F.regexp_replace(words, r"(?U)\s+", " "))


# ---- markup ---------------------------------------------------------------------------


@F.pandas_udf(T.StringType())
def _unescape(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


@F.pandas_udf(T.StringType())
def _unescape_code_units(texts: pd.Series) -> pd.Series:
    unit = re.compile(r"\\u([0-9a-fA-F]{4})")
    return texts.map(lambda text: html.unescape(unit.sub(lambda m: chr(int(m[1], 16)), text)), na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _unescape_lists(lists: pd.Series) -> pd.Series:
    return lists.map(lambda texts: [None if t is None else html.unescape(t) for t in texts], na_action="ignore")


def decode_entities_of(texts: list[Column]) -> Column:
    """The texts as one list with HTML entities decoded: many columns of a row cross to the function at once."""
    listed = F.array(*texts)
    marked = F.exists(listed, lambda t: F.coalesce(F.contains(t, F.lit("&")), F.lit(False)))
    return F.when(marked, _unescape_lists(F.when(marked, listed))).otherwise(listed)


def decode_entities(text: Column, code_units: bool = False) -> Column:
    """Decode HTML entities, and before them literal ``\\uXXXX`` sequences when asked."""
    marked = F.contains(text, F.lit("&")) | (F.contains(text, F.lit("\\u")) if code_units else F.lit(False))
    decoder = _unescape_code_units if code_units else _unescape
    # The function only receives the rows that need it; the rest cross as nulls.
    return F.when(marked, decoder(F.when(marked, text))).otherwise(text)


def strip_html(text: Column) -> Column:
    """Decode entities, then remove tags and outer white space."""
    return strip(F.regexp_replace(decode_entities(text), "<[^>]+>", ""))


def clean_director(text: Column) -> Column:
    """Drop white space and brackets around a name; nothing left means null."""
    return F.nullif(strip(F.trim(strip(text), F.lit("()"))), F.lit(""))
