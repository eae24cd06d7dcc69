"""Web pages as relational tables.

A small tokeniser (standard library, through Arrow) turns each page into one row per element of
interest with its place in the tree. What the elements mean, which item owns which property, which
event shows which film, is decided by joins on those rows.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from html.parser import HTMLParser
from itertools import islice
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from playbill.session import materialise

ELEMENTS = (
    "page_id string, eid int, end int, parent int, tag string, classes array<string>, attrs map<string,string>, scope int, movie int, "
    "text string, spaced string"
)
#: Rows handed back to Spark at once, so that a worker never holds the elements of a whole batch of pages.
ROWS = 5000
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Tags whose start closes an open element of the same kind.
SELF_CLOSING = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
# Elements whose content is markup like any other, by every release of the standard parser.
ORDINARY = VOID | frozenset(
    "a abbr address article aside b blockquote body button caption dd del details div dl dt em fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header html "
    "i ins label legend li main nav ol optgroup option p picture pre q s section select small span strong sub summary sup table tbody td tfoot th thead time tr u ul video".split()
)
# Elements whose text is worth keeping even without markup on them.
TEXT_TAGS = frozenset("title h1 h2 h3 p time script a".split())
# A start tag as most are written: names, and values in double quotes without references.
_NAME = r"[a-zA-Z][a-zA-Z0-9_:-]*+"
_PLAIN_START = re.compile(rf'<([a-zA-Z][a-zA-Z0-9]*+)((?:[ \n]++{_NAME}(?:="[^"&]*+")?+)*+)>')
_PLAIN_ATTRIBUTE = re.compile(rf'({_NAME})(?:="([^"&]*+)")?+')


class _Tokeniser(HTMLParser):
    """Numbers elements in document order and records where each one ends."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[dict] = []
        self.open: list[dict] = []
        self.keepers: list[dict] = []  # open elements whose text is kept
        self.tags: Counter[str] = Counter()  # of open elements

    def parse_starttag(self, i: int) -> int:
        """As the standard parser, which is slow, does; all but plain start tags are left to it."""
        plain = _PLAIN_START.match(self.rawdata, i)
        tag = plain and plain[1].lower()
        if not plain or tag not in ORDINARY:
            return super().parse_starttag(i)
        self.lasttag = tag
        self.handle_starttag(tag, [(name.lower(), value) for name, value in _PLAIN_ATTRIBUTE.findall(plain[2])] if plain[2] else [])
        return plain.end()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        for closed in SELF_CLOSING.get(tag, ()):
            if self.open and self.open[-1]["tag"] == closed:
                self._close()
        known = {name: value or "" for name, value in reversed(attrs)}
        parent = self.open[-1] if self.open else None
        types = {part.rstrip("/").rsplit("/", 1)[-1] for part in known["itemtype"].split()} if "itemtype" in known else ()
        labels = [known[name] for name in ("class", "data-test") if name in known]
        row = {
            "eid": len(self.rows), "end": len(self.rows), "parent": None if parent is None else parent["eid"], "tag": tag, "attrs": known, "types": types,
            "scope": None if parent is None else parent["eid"] if "itemscope" in parent["attrs"] else parent["scope"],
            "movie": None if parent is None else parent["eid"] if "Movie" in parent["types"] else parent["movie"],
            "keeps": tag in TEXT_TAGS or "itemprop" in known or any("title" in k or "time" in k or "synopsis" in k or "description" in k for k in labels),
            "parts": [],
        }
        self.rows.append(row)
        if tag not in VOID:
            self.open.append(row)
            self.tags[tag] += 1
            if row["keeps"]:
                self.keepers.append(row)

    def handle_endtag(self, tag: str) -> None:
        if self.tags[tag]:
            while self.open[-1]["tag"] != tag:
                self._close()
            self._close()

    def handle_data(self, data: str) -> None:
        for row in self.keepers:
            row["parts"].append(data)

    def _close(self) -> None:
        row = self.open.pop()
        row["end"] = len(self.rows) - 1
        self.tags[row["tag"]] -= 1
        if row["keeps"]:
            self.keepers.pop()

    def finish(self) -> list[dict]:
        self.close()
        while self.open:
            self._close()
        return self.rows


def _is_marked(row: dict) -> bool:
    attrs = row["attrs"]
    return "itemprop" in attrs or "itemtype" in attrs or (row["tag"] == "script" and "json" in attrs.get("type", "").lower())


def in_frames(rows: Iterator[tuple], columns: list[str], kinds: dict[str, str]) -> Iterator[pd.DataFrame]:
    """Rows as frames of bounded size."""
    while held := list(islice(rows, ROWS)):
        yield pd.DataFrame(held, columns=columns).astype(kinds)


def _element_rows(marked_only: bool):
    """Tokenising function over batches of pages."""
    columns = ["page_id", "eid", "end", "parent", "tag", "classes", "attrs", "scope", "movie", "text", "spaced"]

    def tokenised(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for batch in batches:
            for page_id, body in zip(batch["page_id"], batch["body"]):
                tokens = _Tokeniser()
                tokens.feed(body or "")
                yield from ((page_id, *_columns(r)) for r in tokens.finish() if not marked_only or _is_marked(r))

    return lambda batches: in_frames(tokenised(batches), columns, dict.fromkeys(("parent", "scope", "movie"), "Int32"))


def _columns(row: dict) -> tuple:
    text = spaced = None
    if row["keeps"]:
        pieces = [p.strip() for p in row["parts"]]
        text = "".join(row["parts"] if row["tag"] == "script" else pieces)
        spaced = " ".join(filter(None, pieces))
    classes = row["attrs"].get("class", "").split()
    return (row["eid"], row["end"], row["parent"], row["tag"], classes, row["attrs"], row["scope"], row["movie"], text, spaced)


def elements(pages: DataFrame, page_id: str = "url", body: str = "body", marked_only: bool = False) -> DataFrame:
    """One row per element: (page_id, eid, end, parent, tag, classes, attrs, scope, movie,
    text, spaced).

    ``eid`` to ``end`` spans the element and its descendants; ``scope`` is the nearest enclosing
    ``itemscope``, ``movie`` the nearest enclosing item of that type. ``marked_only`` keeps the
    elements that carry structured data.
    """
    source = pages.select(F.col(page_id).cast("string").alias("page_id"), F.col(body).alias("body"))
    return source.mapInPandas(_element_rows(marked_only), ELEMENTS)


# Comments and elements whose content is no markup, up to the end of the page if they are left open.
_CONTENT = r"[^<]*+(?:<(?!/(?:script|style)\s*+>)[^<]*+)*+"
_OPAQUE = rf"(?is)<!--.*?(?:-->|\z)|<(?:script|style)(?=[\s/>])[^>]*+>{_CONTENT}(?:</(?:script|style)\s*+>)?+"
_ATTRIBUTE = r"""(?:\s+[\w:.-]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'<>=`]+))?)"""
_START = rf"(?is)^(<(script|style){_ATTRIBUTE}*+\s*>)"
_TYPE = r"""(?is)^<script(?:(?!\s+type[\s=>])""" + _ATTRIBUTE + r""")*+\s+type\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'<>=`]+))"""
# What is left of a page without them and can't be told from a tag, an attribute or another such element for certain.
_DOUBTFUL = (
    r"(?i)<(?:script|style)[\s/>]|<!--|<!\[|<\?|<(?:iframe|noembed|noframes|plaintext|xmp)[\s/>]"
    r"|<[a-zA-Z/!][^<>]*\x00|<(?:title|textarea)\b[^>]*>[^<]*\x00"
    r"|=\s*\"[^\">]*>|=\s*'[^'>]*>"
)


def linked_scripts(pages: DataFrame, page_id: str = "url", body: str = "body") -> DataFrame:
    """(page_id, eid, text): linked-data scripts of the pages; ``eid`` orders those of a page.

    Comments, scripts and styles are cut out by a pattern. Where that could go wrong (unclosed or nested ones, quotes that
    hold brackets, start tags that are not plain lists of attributes) the page is tokenised instead.
    """
    source = pages.select(F.col(page_id).cast("string").alias("page_id"), F.col(body).alias("body"))
    listing = source.filter(F.contains(F.lower("body"), F.lit("json")))

    def started(cut: Column) -> Column:
        return F.struct(cut.alias("cut"), F.regexp_extract(cut, _START, 1).alias("start"))

    def read(part: Column) -> Column:
        kind = F.concat(*[F.regexp_extract(part["start"], _TYPE, k) for k in (1, 2, 3)])
        text = F.regexp_extract(F.substr(part["cut"], F.length(part["start"]) + 1), f"(?is)^{_CONTENT}", 0)
        return F.struct(part["cut"].alias("cut"), part["start"].alias("start"), F.lower(kind).alias("kind"), text.alias("text"))

    def certain(part: Column) -> Column:
        comment = part["cut"].rlike(r"(?s)^<!--.*-->$") & ~part["cut"].rlike(r"^<!--+>|--\s+>|--!>")
        closed = (part["start"] != "") & ~part["start"].endswith("/>") & (F.length(part["cut"]) > F.length(part["start"]) + F.length(part["text"]))
        # The pattern ends either element at either end tag; that must be its own.
        own = F.lower(F.regexp_extract(part["start"], _START, 2)) == F.lower(F.regexp_extract(F.substr(part["cut"], F.length(part["start"]) + F.length(part["text"]) + 1), r"(?i)</(script|style)", 1))
        bracket = F.contains(part["text"], F.lit("<"))
        plain = F.when(bracket, ~part["text"].rlike(r"(?i)</\s*(?:script|style)|<script")).otherwise(True) & ~F.contains(part["kind"], F.lit("&"))
        return F.when(part["cut"].startswith("<!--"), comment).otherwise(closed & own & plain)

    cut = listing.select("page_id", F.regexp_extract_all("body", F.lit(_OPAQUE), 0).alias("cuts"), F.regexp_replace("body", _OPAQUE, "\x00").alias("rest"))
    parts = cut.select("page_id", "rest", F.transform(F.transform("cuts", started), read).alias("parts"))
    regular = F.forall("parts", certain) & ~F.col("rest").rlike(_DOUBTFUL)
    numbered = F.transform("parts", lambda p, k: F.struct(k.alias("eid"), p["kind"].alias("kind"), p["text"].alias("text")))
    wanted = F.filter(numbered, lambda p: p["kind"] == "application/ld+json")
    # Small next to the pages, which are read for it once.
    told = parts.select("page_id", regular.alias("regular"), wanted.alias("scripts"))
    found = materialise(told.select("page_id", "regular", F.when(F.col("regular"), F.col("scripts")).alias("scripts")))
    plain = found.filter("regular").select("page_id", F.inline("scripts")).select("page_id", "eid", "text")
    doubtful = elements(source.join(found.filter("not regular"), "page_id", "left_semi"), "page_id", marked_only=True)
    kind = F.lower(F.coalesce(attr("type"), F.lit("")))
    scripts = plain.unionByName(doubtful.filter((F.col("tag") == "script") & (kind == "application/ld+json")).select("page_id", "eid", "text"))
    scripts.held = found  # the table it reads, for who is done with it
    return scripts


def attr(name: str) -> Column:
    """An attribute, null when absent or empty."""
    return F.nullif(F.try_element_at("attrs", F.lit(name)), F.lit(""))


def has_class(name: str) -> Column:
    return F.array_contains("classes", name)


def class_like(text: str) -> Column:
    return F.contains(F.coalesce(F.try_element_at("attrs", F.lit("data-test")), F.lit("")), F.lit(text))


# Elements are intervals (eid, end) that nest and never cross, so one ordered pass over a page tells what lies in what.


def _along(order: Column | str) -> WindowSpec:
    return Window.partitionBy("page_id").orderBy(order)


def inside(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """Inner elements with each outer element of the same page that contains them.

    ``outer``, which has ``eid`` and ``end``, is prefixed ``o_``. The inner elements of a page are numbered in order, those in an outer
    one have consecutive numbers, and an equi-join on the numbers takes as many rows as there are pairs.
    """
    numbered = inner.withColumn("_n", F.row_number().over(_along("eid")))
    starts = outer.select("page_id", "eid", F.col("eid").alias("at"), F.lit(0).alias("side"))
    ends = outer.select("page_id", "eid", F.col("end").alias("at"), F.lit(1).alias("side"))
    points = inner.select("page_id", F.lit(None).cast("int").alias("eid"), F.col("eid").alias("at"), F.lit(None).cast("int").alias("side"))
    # How many inner elements there are up to the start and up to the end of each outer one.
    passed = F.sum(F.when(F.col("side").isNull(), 1).otherwise(0)).over(_along("at").rangeBetween(Window.unboundedPreceding, 0))
    counted = starts.unionByName(ends).unionByName(points).withColumn("passed", passed).filter("side is not null")
    spans = counted.groupBy("page_id", "eid").agg(F.min("passed").alias("before"), F.max("passed").alias("last")).filter("before < last")
    held = spans.select("page_id", F.col("eid").alias("o_eid"), F.explode(F.sequence(F.col("before") + 1, F.col("last"))).alias("_n"))
    around = outer.select(*[F.col(c).alias(c if c == "page_id" else f"o_{c}") for c in outer.columns])
    pairs = held.join(numbered, ["page_id", "_n"]).drop("_n")
    return pairs if set(outer.columns) <= {"page_id", "eid", "end"} else pairs.join(around, ["page_id", "o_eid"])


def first_inside(outer: DataFrame, inner: DataFrame, parts: dict[str, tuple[Column, Column]]) -> DataFrame:
    """(page_id, eid, a column for each part): of every outer element, the value of the first inner element in it for which the
    part's condition holds; null if there is none.

    One pass from the end of a page to its start: the first element after an outer one is in it, or none is.
    """
    seen = [F.when(condition, F.struct("eid", value.alias("value"))).alias(name) for name, (condition, value) in parts.items()]
    candidates = inner.filter(reduce(or_, (condition for condition, _ in parts.values()))).select("page_id", "eid", *seen)
    rows = candidates.unionByName(outer.select("page_id", "eid", "end"), allowMissingColumns=True)
    later = _along(F.desc("eid")).rangeBetween(Window.unboundedPreceding, -1)
    nearest = rows.withColumns({name: F.last(name, ignorenulls=True).over(later) for name in parts}).filter("end is not null")
    return nearest.select("page_id", "eid", *[F.when(F.col(name)["eid"] <= F.col("end"), F.col(name)["value"]).alias(name) for name in parts])


def within_any(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """Inner elements that at least one outer element of their page contains, in one pass over the page."""
    rows = inner.withColumn("_end", F.lit(None).cast("int")).unionByName(outer.select("page_id", "eid", F.col("end").alias("_end")), allowMissingColumns=True)
    reach = F.max("_end").over(_along("eid").rangeBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("_reach", reach).filter("_end is null and _reach >= eid").drop("_end", "_reach")


#: A call that pushes a text; the text is a JSON string.
_PUSH = re.compile(r'self\.__next_f\.push\(\[\s*1\s*,\s*("(?:[^"\\]++|\\.)*+")\s*\]\)', re.DOTALL)
PUSH_ENTRIES = "page_id string, seq int, id string, title string, slug string, permalink string, content string, details string, shows string"
_FILM = ("title", "slug", "permalink")


_TOKEN = re.compile(r'\s*(?:([{}\[\],:])|("(?:[^"\\]|\\.)*")|(-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null))', re.DOTALL)


def _broken(text: str, at: int) -> tuple[list, int]:
    """What is whole inside an object that is not, and the place where it breaks off.

    One token after the other, with the containers that are open on a list: nothing is read twice, and depth is no matter. An
    object that is whole after all, only too deep for the decoder, is returned as such.
    """
    open_: list[tuple] = []  # each container with its key in the one around it, which it joins when it is closed
    key, wants, last = None, "value", None
    while True:
        token, before = _TOKEN.match(text, at), last
        sign, quoted, plain = token.groups() if token else (None, None, None)
        inner = open_[-1][0] if open_ else None
        if sign in ("{", "[") and wants in ("value", "first"):
            open_.append(({} if sign == "{" else [], key))
            wants = "key" if sign == "{" else "first"
        elif sign and (sign, wants) in ((":", "colon"), (",", "next")):
            wants = "value" if sign == ":" or isinstance(inner, list) else "name"
        elif quoted and wants in ("key", "name"):
            key, wants = _text(quoted), "colon"
        elif (sign == "}" and isinstance(inner, dict) and wants in ("key", "next")) or (sign == "]" and isinstance(inner, list) and wants in ("first", "next")):
            value, key = open_.pop()
            if not open_:
                return [value], token.end()
            _put(open_[-1][0], key, value)
            wants = "next"
        elif (quoted or plain) and wants in ("value", "first"):
            _put(inner, key, _text(quoted) if quoted else json.loads(plain))
            wants = "next"
        else:  # no JSON from here on
            whole = [v for c, _ in open_ for v in (c.values() if isinstance(c, dict) else c) if isinstance(v, (dict, list))]
            # What follows an unclosed quote reads as its text, so a text just before is looked into.
            return whole, at if before is None else before
        at, last = token.end(), token.start(2) + 1 if quoted else None


def _text(quoted: str) -> str:
    try:
        return json.loads(quoted, strict=False)
    except ValueError:  # an escape that JSON does not know
        return quoted[1:-1]


def _put(container, key, value) -> None:
    if isinstance(container, dict):
        container[key] = value
    else:
        container.append(value)


def _objects(text: str) -> Iterator:
    """The JSON objects of a text that is a mix of JSON and other things, outermost first, in time linear in its length."""
    decode, at = json.JSONDecoder(strict=False).raw_decode, text.find("{")
    while at >= 0:
        try:
            value, at = decode(text, at)
            yield value
        except (ValueError, RecursionError):  # cut off, no object, or too deep: what it holds is looked at by itself
            whole, end = _broken(text, at)
            yield from whole
            at = max(end, at + 1)
        at = text.find("{", at)


def _stream(body: str) -> str:
    """The pushed texts of a page, put together in their order: one may go on where another stops."""
    texts = []
    for pushed in _PUSH.findall(body):
        try:
            texts.append(json.loads(pushed, strict=False))
        except ValueError:  # a text that cannot be read is a gap in the stream
            texts.append("\n")
    return "".join(texts)


def _films(value) -> Iterator[dict]:
    """Objects with the fields of a film, in order, at any depth."""
    todo = [value]
    while todo:
        node = todo.pop()
        if isinstance(node, dict):
            if "id" in node and all(isinstance(node.get(f), str) and node[f] for f in _FILM):
                yield node
            todo += reversed([v for v in node.values() if isinstance(v, (dict, list))])
        elif isinstance(node, list):
            todo += reversed(node)


def _push_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def entries() -> Iterator[tuple]:
        for batch in batches:
            for page_id, body in zip(batch["page_id"], batch["body"]):
                films = (film for value in _objects(_stream(body or "")) for film in _films(value))
                for seq, film in enumerate(films):
                    content = film.get("content")
                    details, shows = (json.dumps(film[f]) if isinstance(film.get(f), kind) else None for f, kind in (("details", dict), ("shows", list)))
                    yield (page_id, seq, str(film["id"]), *(film[f] for f in _FILM), content if isinstance(content, str) else None, details, shows)

    return in_frames(entries(), [c.split()[0] for c in PUSH_ENTRIES.split(", ")], {"seq": "int32"})


def push_entries(pages: DataFrame, page_id: str = "url", body: str = "body") -> DataFrame:
    """Film entries inside the pushed script texts of each page, read as one stream: texts as such, details and shows as JSON."""
    source = pages.select(F.col(page_id).cast("string").alias("page_id"), F.col(body).alias("body"))
    return source.mapInPandas(_push_rows, PUSH_ENTRIES)
