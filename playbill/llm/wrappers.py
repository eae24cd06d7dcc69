"""HTML extraction with wrappers inferred from pages of the same host.

A wrapper is a regular expression over tags and text without unions: a sequence of tags, fixed texts, text slots,
optional parts and repeated parts. It starts as one page of a host and is aligned with further ones. Where texts
differ, a slot takes their place; where tags differ, the tag before the mismatch closes a square: if what follows
on one side repeats the square before it, the square becomes a repeated part; otherwise the side that catches up
with the other first marks an optional part. The finished wrapper tells where a host's main text lies: the
deepest element that holds all varying text once menus, adverts and the like are left out. That element is
then cut out of every page of the host, whole.
"""

from __future__ import annotations

import html
import json
import re
import zlib
from dataclasses import dataclass, field
from functools import cache
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from playbill.llm.tables import map_rows
from playbill.session import materialise

#: Pages of a host that one wrapper is inferred from, at least and on average at most twice as many. They are aligned whole.
PAGES = 6

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
#: Elements whose content is never text of the page, and those that end with their own tag whatever they hold.
RAW = {"script", "style", "noscript", "template", "iframe", "object", "svg", "math", "canvas", "audio", "video", "textarea", "title", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements within a line of text.
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "br"}
#: Elements beside the main text, and the classes, ids and roles, as whole tokens, that mark such containers.
BESIDE = {"nav", "footer", "aside", "form", "button", "select", "dialog", "menu", "head", "fieldset"}
BESIDE_WORDS = re.compile(
    r"(?:^|\s)(?:ads?|advert\w*|banner|breadcrumbs?|byline|captcha|comments?|consent|cookies?|disqus|footer|form|gdpr|masthead|menus?|modal|nav|navbar|navigation|newsletter|notices?|pagination|popup|promo\w*|related|replies|respond|search|share|sharing|sidebar|signup|skip|social|sponsor\w*|subscribe|toolbar|widget)(?:$|\s)",
    re.I,
)
MAIN_TAGS = ("article", "main")
#: Ids of these name a passage, and a heading is no container.
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
NAMED = {*HEADINGS, "section", "article", "main"}
#: A start tag that ends an open one of the same group.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
SCOPES = {"ul", "ol", "dl", "table", "article", "main", "section", "div", "body", "td", "th"}
ATTRIBUTE = re.compile(r"([a-zA-Z][\w-]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")


@dataclass(slots=True)
class Token:
    """A start tag (``<``), an end tag (``>``) or a text (``#``)."""

    kind: str
    name: str
    marks: str = ""  # class, id and role of a start tag

    @property
    def sign(self) -> str:
        """What two tokens must share to match: texts always do, ids do not count."""
        return self.kind if self.kind == "#" else f"{self.kind}{self.name}"


def tokens(page: str) -> list[Token]:
    """The tokens of a page, end tags supplied where they may be left out, so that they nest."""
    out: list[Token] = []
    open_: list[str] = []
    at = 0

    def close(name: str) -> None:
        while open_:
            last = open_.pop()
            out.append(Token(">", last))
            if last == name:
                return

    def text(raw: str) -> None:
        if raw and not raw.isspace():
            out.append(Token("#", html.unescape(raw)))
        elif raw and out and out[-1].kind == "#":
            out[-1].name += " "

    def blank(raw: str) -> None:  # white space between two inline elements separates words
        if raw:
            out.append(Token("#", " "))

    while True:
        found = TOKEN.search(page, at)
        raw = page[at : found.start()] if found else page[at:]
        (blank if raw.isspace() else text)(raw)
        if not found:
            break
        at = found.end()
        end, name, rest = found[1], (found[2] or "").lower(), found[3] or ""
        if not name:
            continue
        if end:
            if name in open_:
                close(name)
            elif name == "br":
                out.append(Token("<", "br"))
                out.append(Token(">", "br"))
            continue
        if name in RAW:
            if not rest.rstrip().endswith("/") or name not in ("svg", "math"):
                over = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.I).search(page, at)
                at = over.end() if over else len(page)
            continue
        ends = CLOSES.get(name, set()) | ({"p"} if name in ENDS_P else set())
        for k in range(len(open_) - 1, -1, -1):
            if open_[k] in ends:
                for _ in range(len(open_) - k):
                    out.append(Token(">", open_.pop()))
                break
            if open_[k] in SCOPES:
                break
        marks = ""
        if "=" in rest:
            marks = " ".join(v for k, *vs in ATTRIBUTE.findall(rest) if k.lower() in ("class", "role") or k.lower() == "id" and name not in NAMED for v in vs if v)
        out.append(Token("<", name, marks))
        if name in VOID or rest.endswith("/"):
            out.append(Token(">", name))
        else:
            open_.append(name)
    while open_:
        out.append(Token(">", open_.pop()))
    return out


def beside(token: Token) -> bool:
    """Whether an element is one of those beside the main text."""
    return token.name in BESIDE or bool(token.marks and token.name not in ("body", "html", *HEADINGS) and BESIDE_WORDS.search(token.marks))


@dataclass(slots=True)
class Node:
    """Part of a wrapper: a tag, a fixed text, a slot (``*``), an optional (``?``) or a repeated part (``+``)."""

    kind: str
    name: str = ""
    marks: str = ""
    parts: list[Node] = field(default_factory=list)
    mass: int = 0  # characters of text that went into a slot

    @property
    def sign(self) -> str:
        return "#" if self.kind in "#*" else f"{self.kind}{self.name}"


def started(page: list[Token]) -> list[Node]:
    """The wrapper of one page: the page. Blank texts say nothing about structure."""
    return [Node(t.kind, t.name, t.marks) for t in page if t.kind != "#" or not t.name.isspace()]


def _flat(node: Node) -> list[str]:
    return [node.sign] if node.kind in "<>#*" else [s for p in node.parts for s in _flat(p)]


def _meets(node: Node, token: Node) -> bool:
    return node.sign == token.sign


def _take(node: Node, page: list[Node], at: int) -> int | None:
    """Where a part of a wrapper, matched at ``at``, ends; None if it doesn't match. Texts may be missing."""
    if node.kind in "#*":
        if at < len(page) and page[at].kind == "#":
            if node.kind == "#" and node.name != page[at].name:
                node.kind, node.mass = "*", node.mass + len(node.name)
            node.mass += len(page[at].name) * (node.kind == "*")
            return at + 1
        return at
    if node.kind in "<>":
        return at + 1 if at < len(page) and _meets(node, page[at]) else None
    end, times = at, 0
    while True:
        here = end
        for part in node.parts:
            end = _take(part, page, end)
            if end is None:
                break
        if end is None or end == here:
            end = here
            break
        times += 1
        if node.kind == "?":
            break
    return end if times or node.kind == "?" else None


def _square(line: list[str], at: int, before: list[str]) -> int | None:
    """The end of a square that starts at ``at`` and repeats what ``before`` ends with."""
    if not before or at >= len(line):
        return None
    last = before[-1]
    depth = 0
    for end in range(at, len(line)):
        depth += {"<": 1, ">": -1}.get(line[end][0], 0)
        if depth < 0:
            return None
        if depth == 0 and line[end] == last and end > at:
            size = _matching(before, line[at : end + 1])
            return end + 1 if size else None
    return None


def _ahead(wrapper: list[Node], at: int, before: list[str]) -> list[str]:
    """The signs from ``at`` on, parts aside, as far as :func:`_square` looks at them."""
    line, depth = [], 0
    for k in range(at, len(wrapper)):
        if wrapper[k].kind in "<>#*":
            line.append(wrapper[k].sign)
            depth += {"<": 1, ">": -1}.get(line[-1][0], 0)
            if depth < 0 or depth == 0 and len(line) > 1 and before and line[-1] == before[-1]:
                break
    return line


def _matching(before: list[str], square: list[str]) -> int | None:
    """How many signs at the end of ``before`` the square repeats, texts aside."""
    k, j = len(before) - 1, len(square) - 1
    while j >= 0:
        if k >= 0 and before[k] == square[j]:
            k, j = k - 1, j - 1
        elif square[j] == "#":
            j -= 1
        elif k >= 0 and before[k] == "#":
            k -= 1
        else:
            return None
    return len(before) - 1 - k


def _repeated(wrapper: list[Node], before: list[str], square: list[str]) -> bool:
    """Make the end of ``wrapper``, whose signs are ``before``, that the square repeats a repeated part."""
    if wrapper and wrapper[-1].kind == "+" and _matching(_flat(wrapper[-1]), square):
        return True
    size = _matching(before, square)
    count, k = 0, len(wrapper)
    while k > 0 and count < (size or 0):
        k -= 1
        count += len(_flat(wrapper[k]))
    if not size or count != size:
        return False
    parts = wrapper[k:]
    for p in parts:
        if p.kind == "#":
            p.kind, p.mass = "*", p.mass + len(p.name)
    wrapper[k:] = [Node("+", parts=parts)]
    return True


def align(wrapper: list[Node], page: list[Node]) -> list[Node]:
    """The wrapper of everything that ``wrapper`` and ``page`` match; blank texts are not in ``page``."""
    out: list[Node] = []
    i = j = 0
    signs = [n.sign for n in page]
    before: list[str] = []  # the signs of what is in ``out``; making a repeated part does not change them
    while i < len(wrapper):
        node = wrapper[i]
        end = _take(node, page, j)
        if end is not None and not (node.kind == "?" and end == j and j < len(page) and i + 1 < len(wrapper) and _take_sign(wrapper[i + 1], page[j]) is False and node.parts[0].sign == page[j].sign):
            out.append(node)
            before += _flat(node)
            i, j = i + 1, end
            continue
        # Does the page repeat the square before? Then so does the wrapper.
        end = _square(signs, j, before)
        if end is not None and _repeated(out, before, signs[j:end]):
            while (more := _take(out[-1], page, j)) is not None and more > j:
                j = more
            if j >= end:
                continue
        # Or does the wrapper, where the page has fewer?
        line = _ahead(wrapper, i, before) if node.kind in "<>#*" else []
        end = _square(line, 0, before) if line and all(n.kind in "<>#*" for n in wrapper[i : i + 1]) else None
        if end is not None and all(n.kind in "<>#*" for n in wrapper[i : i + end]) and _repeated(out, before, line[:end]):
            i += end
            continue
        # Otherwise one side has a part that the other lacks: whichever is over sooner.
        skip_page = _until(signs, j, node.sign) if node.kind in "<>" else None
        skip_own = _skipped(wrapper, i, page[j]) if j < len(page) else None
        if skip_page is not None and (skip_own is None or skip_page - j <= skip_own - i):
            out.append(Node("?", parts=[Node(n.kind if n.kind != "#" else "*", n.name if n.kind != "#" else "", n.marks, mass=len(n.name) * (n.kind == "#")) for n in page[j:skip_page]]))
            j = skip_page
        elif skip_own is not None:
            out.append(Node("?", parts=wrapper[i:skip_own]))
            i = skip_own
        else:  # only this one: it may or may not be there
            out.append(Node("?", parts=[node]) if node.kind in "<>" else node)
            i += 1
        before += _flat(out[-1])
    if j < len(page):
        out.append(Node("?", parts=page[j:]))
    return out


def _take_sign(node: Node, token: Node) -> bool | None:
    return node.sign == token.sign if node.kind in "<>" else None


def _skipped(wrapper: list[Node], at: int, token: Node) -> int | None:
    """Where the wrapper meets ``token`` next at the depth of ``at``, with something in between."""
    depth = 0
    for k in range(at, len(wrapper)):
        if depth == 0 and k > at and wrapper[k].kind in "<>" and _meets(wrapper[k], token):
            return k
        for s in _flat(wrapper[k]):
            depth += {"<": 1, ">": -1}.get(s[0], 0)
            if depth < 0:
                return None
    return None


def _until(line: list[str], at: int, sign: str) -> int | None:
    """Where ``sign`` comes next at the depth of ``at``, with something in between."""
    depth = 0
    for k in range(at, len(line)):
        if depth == 0 and k > at and line[k] == sign:
            return k
        depth += {"<": 1, ">": -1}.get(line[k][0], 0)
        if depth < 0:
            return None
    return None


def infer(pages: list[str]) -> list[Node]:
    """The wrapper of some pages, aligned one after the other."""
    streams = [started(tokens(p)) for p in pages]
    wrapper = streams[0]
    for page in streams[1:]:
        wrapper = align(wrapper, page)
    return wrapper


def main_path(wrapper: list[Node]) -> list[str]:
    """The path of the element that holds the main text, as names below each other; empty if there is none.

    It is an article or main element, or else the deepest element that holds all varying text: what is in slots or in
    optional and repeated parts, or any text if nothing varies. Elements beside the main text don't count.
    """
    mass: dict[tuple[str, ...], int] = {}
    varying: set[tuple[str, ...]] = set()
    stack: list[tuple[str, bool]] = []

    def visit(nodes: list[Node], part: bool = False) -> None:
        for n in nodes:
            if n.kind == "<":
                stack.append((n.name, beside(Token("<", n.name, n.marks))))
            elif n.kind == ">":
                if any(name == n.name for name, _ in stack):
                    while stack and stack.pop()[0] != n.name:
                        pass
            elif n.kind in "#*":
                if not any(b for _, b in stack):
                    path = tuple(name for name, _ in stack if name not in INLINE)
                    if "header" not in path and (n.kind == "*" or part):
                        varying.add(path)
                    for k in range(1, len(path) + 1):
                        mass[path[:k]] = mass.get(path[:k], 0) + n.mass + (len(n.name) if n.kind == "#" else 0)
            else:
                visit(n.parts, True)

    visit(wrapper)
    if not mass:
        return []
    named = [p for p in mass if p[-1] in MAIN_TAGS and mass[p] > 0]
    if named:
        return list(min(named, key=lambda p: (len(p), -mass[p])))
    holders = varying or {p for p in mass if "header" not in p}
    path = commonprefix([list(p) for p in holders]) if holders else []
    while path and (path[-1] in CLOSES or re.fullmatch(r"h[1-6]|html", path[-1])):
        path.pop()
    return path


def extract(page: str, path: list[str]) -> str:
    """The text of the element at ``path`` of a page, a line for each block, without elements beside the main text.

    A page without that element gives what its article, main or body element holds.
    """
    stream = tokens(page)
    return (path and _blocks(stream, path)) or next((t for name in (*MAIN_TAGS, "body") if (t := _blocks(stream, [name], anywhere=True))), "") or _blocks(stream, [])


def _blocks(stream: list[Token], path: list[str], anywhere: bool = False) -> str:
    lines, words = [], []
    stack: list[str] = []
    inside = 0 if path else 1  # depth at which the element was entered, plus one
    skipped = 0

    def flush() -> None:
        line = " ".join("".join(words).split())
        if line:
            lines.append(line)
        words.clear()

    for t in stream:
        if t.kind == "<":
            stack.append(t.name)
            # A header names the article within it, and the site elsewhere.
            if not skipped and (beside(t) or t.name == "header" and not set(MAIN_TAGS) & set(stack)):
                skipped = len(stack)
            if not inside and not skipped and t.name == path[-1] and (anywhere or [n for n in stack if n not in INLINE] == path):
                inside = len(stack)
            if inside and not skipped:
                if t.name == "br":
                    words.append(" ")
                elif t.name not in INLINE:
                    flush()
        elif t.kind == ">":
            if inside and not skipped and t.name not in INLINE:
                flush()
            if skipped == len(stack):
                skipped = 0
                if inside and t.name not in INLINE:
                    flush()
            if path and inside == len(stack):
                flush()
                inside = 0
            stack.pop()
        elif inside and not skipped:
            words.append(t.name)
    flush()
    return "\n".join(lines)


def host(url: str | Column) -> Column:
    """The host of an address; empty if there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, path): where each host's main text lies, from all of its pages.

    A host's pages are dealt by a hash to groups of a few; each group is aligned to a wrapper, and the path that the wrappers of most
    different pages give is the host's. Of equal paths in number the shortest wins, as it holds most.
    """
    given = pages.select(host("url").alias("host"), F.coalesce("html", F.lit("")).alias("html"), F.xxhash64("page_id", "url", "html").alias("deal")).filter("html <> ''")
    # A row for each host, whose size is known once it is written.
    groups = materialise(given.groupBy("host").agg(F.greatest(F.lit(1), F.floor(F.count("*") / PAGES)).alias("groups")))
    dealt = given.join(groups, "host").select("host", F.pmod("deal", "groups").alias("group"), "html")

    def learn(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        found = sorted(set(group["html"].to_pylist()), key=lambda h: (zlib.crc32(h.encode()), h))
        return pa.table({"host": [key[0].as_py()], "path": [json.dumps(main_path(infer(found)))], "votes": pa.array([len(found)], pa.int64())})

    told = dealt.groupBy("host", "group").applyInArrow(learn, "host string, path string, votes long")
    votes = told.groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    return votes.groupBy("host").agg(F.max_by("path", F.struct("votes", -F.length("path"), "path")).alias("path"))


@cache
def _path(text: str) -> list[str]:
    return json.loads(text)


def main_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of every row: its main text by its host's wrapper; empty for a null or empty page.

    Pages are not moved while the paths of all hosts are few enough to be sent to them; more are joined by host.
    """
    given = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host("url").alias("host"))
    joined = given.join(materialise(wrappers(pages)), "host", "left").select("page_id", "url", "html", "path")

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [extract(h, _path(p or "[]")) if h else "" for h, p in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        return pa.record_batch([batch.column(0), batch.column(1), pa.array(found, pa.string())], names=["page_id", "url", "text"])

    return map_rows(joined, of, "page_id long, url string, text string")
