"""Main text and markdown of HTML pages, on the standard library's parser, as vectorised UDFs.

A page becomes a small element tree once. Three extractors look at it: the part that says it is the
content (article, main), the element with the densest text, and the whole body without the parts
around the content. The first that finds enough text is taken; where it keeps less than a share of
the page's text and the second finds more, the second is. Each pass goes over the tree once, with a
list of what is still to do instead of recursion, so time grows with the page however it is nested.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Elements that aren't content, that stand alone, that break lines; least lengths and shares.
DROP = {"script", "style", "nav", "header", "footer", "aside", "form", "iframe", "svg", "button", "noscript", "meta", "link", "head"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCK = {"p", "div", "section", "article", "main", "ul", "ol", "li", "table", "tr", "pre", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6", "body", "br", "hr"}
AROUND = re.compile(r"(?i)\b(nav|menu|sidebar|footer|header|advert|ad|ads|cookie|banner|breadcrumb|share|social)\b")
MIN_CONTENT, THIN, MIN_RATIO = 200, 500, 0.3
#: Which open element a start tag ends, and the elements it doesn't look beyond.
ENDS = {"li": ("li", ("ul", "ol")), "tr": ("tr", ("table",)), "td": ("td", ("table",)), "th": ("th", ("table",)), "a": ("a", ("table",))}
ENDS |= {tag: ("p", ("table", "td", "th", "button", "object")) for tag in BLOCK - {"br", "body", "li", "tr"}}
#: Lists and quotes beyond this many levels aren't indented any further; a table's cells are padded up to this width.
INDENTED, PADDED = 24, 60
DATES = ("article:published_time", "datepublished", "date", "dc.date", "dc.date.issued", "pubdate", "publish-date")


@dataclass(slots=True)
class Node:
    tag: str
    attrs: dict[str, str]
    children: list[Node | str] = field(default_factory=list)

    def walk(self) -> Iterator[Node]:
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo += [c for c in reversed(node.children) if isinstance(c, Node)]

    def find(self, *tags: str) -> Node | None:
        return next((n for n in self.walk() if n.tag in tags), None)


class TreeParser(HTMLParser):
    """Lenient: an end tag closes up to its start tag, or nothing if there is none; raw text stays text."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("html", {})
        self.open = [self.root]
        self.places: dict[str, list[int]] = defaultdict(list)

    def close_from(self, k: int) -> None:
        while len(self.open) > k:
            self.places[self.open.pop().tag].pop()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        ended, within = ENDS.get(tag, (None, ()))
        if ended and (own := self.places[ended]) and all(not (x := self.places[w]) or x[-1] < own[-1] for w in within):
            self.close_from(own[-1])
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.places[tag].append(len(self.open))
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.open[-1].children.append(Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag: str) -> None:
        if self.places[tag]:
            self.close_from(self.places[tag][-1])

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


def tree(html: str) -> Node:
    """The element tree of a page. What follows the last tag's end can't hold a tag, and is text."""
    end = html.rfind(">") + 1
    parser = TreeParser()
    parser.feed(html[:end])
    parser.close()
    if html[end:]:
        parser.open[-1].children.append(html[end:])
    return parser.root


def decoded(raw: bytes, declared: str = "") -> str:
    """A page's text: by its byte order mark, the charset it or its header declares, UTF-8, or else Windows-1252."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if raw.startswith(mark):
            return raw.decode(name, "replace")
    named = re.search(rb"(?i)charset=[\"']?\s*([\w.:-]+)", declared.encode() + b" " + raw[:2048])
    for name in ([named[1].decode()] if named else []) + ["utf-8", "cp1252"]:
        try:
            return raw.decode(name)
        except (LookupError, UnicodeDecodeError):
            continue
    return raw.decode("utf-8", "replace")


def text_of(node: Node, drop: set[str] = DROP) -> str:
    """Text with a line for each block; white space within lines as it is shown."""
    parts: list[str] = []
    todo: list[tuple[Node | str, str]] = [(c, node.tag) for c in reversed(node.children)]
    while todo:
        c, inside = todo.pop()
        if isinstance(c, str):
            parts.append(c if inside in ("pre", "") else re.sub(r"\s+", " ", c))
        elif c.tag not in drop:
            if c.tag in BLOCK:
                parts.append("\n")
                todo.append(("\n", ""))
            todo += [(x, c.tag) for x in reversed(c.children)]
    lines = (line.strip() for line in "".join(parts).split("\n"))
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def raw_text(node: Node) -> str:
    todo, parts = list(reversed(node.children)), []
    while todo:
        c = todo.pop()
        if isinstance(c, str):
            parts.append(c)
        else:
            todo += reversed(c.children)
    return "".join(parts)


def densest(root: Node) -> Node | None:
    """The element whose own paragraphs hold the most text that isn't links."""
    nodes, todo = [], [(root, 0, False)]
    while todo:  # parents before children
        node, up, linked = todo.pop()
        me = len(nodes)
        nodes.append([node, up, sum(len(" ".join(c.split())) for c in node.children if isinstance(c, str)), 0, 0])
        linked = linked or node.tag == "a"
        if linked:
            nodes[me][3] = nodes[me][2]
        todo += [(c, me, linked) for c in reversed(node.children) if isinstance(c, Node) and c.tag not in DROP]
    for node, up, size, links, _ in reversed(nodes[1:]):  # [2] text, [3] of links, [4] of own paragraphs but links twice
        parent = nodes[up]
        parent[2] += size
        parent[3] += links
        if node.tag in ("p", "pre", "blockquote"):
            parent[4] += size - 2 * links
    best, most = None, 0
    for node, _, _, _, own in nodes:
        if own > most and node.tag in ("div", "section", "td", "body", "article", "main") and not AROUND.search(node.attrs.get("class", "") + " " + node.attrs.get("id", "")):
            best, most = node, own
    return best


def bare_length(html: str) -> int:
    """Characters outside tags; a `<` without a `>` after it is text."""
    end = html.rfind(">") + 1
    return len((re.sub(r"<[^>]+>", "", html[:end]) + html[end:]).strip())


def extract(html: str | bytes | None, url: str = "", links: bool = True) -> dict:
    """title, author, description, date, extractor, content_text, content_markdown, ratio and warnings of a page."""
    size = len(html) if isinstance(html, bytes) else len((html or "").encode("utf-8", "surrogatepass"))
    page = decoded(html) if isinstance(html, bytes) else html or ""
    root = tree(page)
    metas: dict[str, str] = {}
    for n in root.walk():
        if n.tag == "meta":
            metas[(n.attrs.get("name") or n.attrs.get("property") or n.attrs.get("itemprop") or "").lower()] = n.attrs.get("content", "")
    named, time = root.find("title"), root.find("time")
    dated = [metas[d] for d in DATES if d in metas] + ([time.attrs.get("datetime", "")] if time else [])
    date = next((m[0] for m in (re.match(r"\s*\d{4}-\d{2}-\d{2}", d) for d in dated) if m), None)
    whole = bare_length(page)
    raw = root.find("body") or root
    tries = [("article", root.find("article", "main")), ("densest", densest(root)), ("raw", raw)]
    found = [(name, node, text_of(node)) for name, node in tries if node is not None]
    name, node, text = next((x for x in found if x[0] == "raw" or len(x[2]) >= MIN_CONTENT))
    if name == "article" and whole and len(text) / whole < MIN_RATIO:
        second = next((x for x in found if x[0] == "densest" and len(x[2]) > len(text)), None)
        name, node, text = second or (name, node, text)
    md = markdown(node, url, links)
    kept = len(md.encode("utf-8", "surrogatepass"))
    short = f"Only {len(text)} characters of content were found: the page may need a script or a login."
    return {
        "title": metas.get("og:title") or (text_of(named, set()) if named else "") or None,
        "author": metas.get("author") or None, "description": metas.get("description") or None, "date": date and date.strip(), "extractor": name,
        "content_text": text, "content_markdown": md, "ratio": size / kept if kept else 1.0, "warnings": [short] if len(text) < THIN else [],
    }


class Writer:
    """Markdown as it grows: white space, line breaks and opening marks are held until text follows them."""

    def __init__(self, flat: int = 0) -> None:
        self.out: list[str] = []
        self.flat, self.gap, self.space, self.begun = flat, 0, False, False
        self.opened: list[list[str]] = []
        #: for each list item or quote that is open: what its next line begins with, if that differs, and any other line
        self.prefixes: list[list[str | None]] = []
        self.low = 0

    def lead(self) -> None:
        if not self.begun or self.gap:
            blank = "".join(rest or "" for _, rest in self.prefixes[: self.low]).rstrip()
            self.out.append(("\n" + blank) * (self.gap - 1) + "\n" if self.begun else "")
            for p in self.prefixes:
                self.out.append(p[1] if p[0] is None else p[0])
                p[0] = None
        elif self.space:
            self.out.append(" ")
        self.out += [mark for (mark,) in self.opened]
        self.begun, self.gap, self.space, self.low, self.opened = True, 0, False, len(self.prefixes), []

    def text(self, s: str) -> None:
        body = " ".join(s.split())
        self.space = self.space or s[:1].isspace()
        if body:
            self.lead()
            self.out.append(body)
            self.space = s[-1].isspace()

    def line(self, s: str) -> None:
        """A line as it is, after a line break."""
        self.breaks(1)
        self.lead()
        self.out.append(s)
        self.breaks(1)

    def breaks(self, n: int) -> None:
        if self.flat:
            self.space = True
        else:
            self.gap = max(self.gap, n)

    def open(self, mark: str) -> list[str]:
        self.opened.append([mark])
        return self.opened[-1]

    def close(self, mark: list[str], end: str) -> None:
        if any(m is mark for m in self.opened):  # nothing came of it
            self.opened = [m for m in self.opened if m is not mark]
        else:
            self.out.append(end)

    def push(self, first: str | None, rest: str) -> bool:
        if len(self.prefixes) >= INDENTED:
            return False
        self.prefixes.append([first, rest])
        return True

    def pop(self) -> None:
        self.prefixes.pop()
        self.low = min(self.low, len(self.prefixes))


MARKS = {"b": "**", "strong": "**", "i": "*", "em": "*", "code": "`"}


def markdown(node: Node, base: str = "", links: bool = True) -> str:
    """An element as markdown: ATX headings, dashes for bullets, fenced code, tables with bars, no images.

    A mark within a mark of its kind, and a table within a cell, give only their text.
    """
    w, spare = Writer(), Writer(1)  # spare: where a table's text outside its cells goes
    writers, inside, lists, tables = [w], set(), [], []
    todo: list = [node]

    def marked(key: str, start: str, end: str) -> None:
        own = writers[-1]
        if key in inside:
            return
        mark = own.open(start)
        own.flat += 1
        inside.add(key)

        def done() -> None:
            own.flat -= 1
            inside.discard(key)
            own.close(mark, end)

        todo.append(done)

    def block(n: int = 2) -> None:
        own = writers[-1]
        own.breaks(n)
        todo.append(lambda: own.breaks(n))

    def prefixed(first: str | None, rest: str) -> None:
        own = writers[-1]
        if own.push(first, rest):
            todo.append(own.pop)
        elif first:
            own.open(first)

    def cell() -> None:
        own, rows = Writer(1), tables[-1]
        writers.append(own)

        def done() -> None:
            writers.pop()
            if rows:
                rows[-1].append("".join(own.out).replace("|", "\\|"))

        todo.append(done)

    def table_() -> None:
        own, rows = writers[-1], []
        tables.append(rows)
        writers.append(spare)

        def done() -> None:
            writers.pop()
            tables.pop()
            own.breaks(2)
            for line in table(rows).split("\n") if rows else ():
                own.line(line)
            own.breaks(2)

        todo.append(done)

    while todo:
        c = todo.pop()
        if callable(c):
            c()
            continue
        own = writers[-1]
        if isinstance(c, str):
            if own is not spare:
                own.text(c)
            continue
        tag = c.tag
        if tag in DROP or tag in ("img", "figure"):
            continue
        children = reversed(c.children)
        if tag in MARKS:
            marked({"strong": "b", "em": "i"}.get(tag, tag), MARKS[tag], MARKS[tag])
        elif tag == "a":
            to = resolved(base, c.attrs.get("href", ""))
            if links and to:
                marked("a", "[", f"]({to})")
        elif tag in ("br", "hr"):
            if tag == "hr" and not own.flat:
                own.breaks(2)
                own.line("---")
                own.breaks(2)
            else:
                own.breaks(1)
        elif re.fullmatch("h[1-6]", tag):
            block()
            if not own.flat:
                marked("h", f"{'#' * int(tag[1])} ", "")
        elif tag == "pre":
            children = ()
            if own.flat:
                own.text(" " + raw_text(c) + " ")
            else:
                own.breaks(2)
                for line in ["```", *raw_text(c).strip("\n").split("\n"), "```"]:
                    own.line(line)
                own.breaks(2)
        elif tag in ("ul", "ol"):
            block()
            lists.append([tag, 0])
            todo.append(lists.pop)
        elif tag == "li":
            block(1)
            kind = lists[-1] if lists else ["ul", 0]
            kind[1] += 1
            if not own.flat:
                prefixed("- " if kind[0] == "ul" else f"{kind[1]}. ", "  ")
        elif tag == "blockquote":
            block()
            if not own.flat:
                prefixed(None, "> ")
        elif tag == "table" and not own.flat:
            table_()
        elif tag in ("td", "th") and tables and own is spare:
            cell()
        elif tag == "tr" and tables and own is spare:
            tables[-1].append([])
        elif tag in BLOCK or tag in ("td", "th"):
            block()
        todo += children
    return clean("".join(w.out))


def resolved(base: str, to: str) -> str:
    try:
        return urljoin(base, to) if base else to
    except ValueError:  # not an address
        return to


def table(rows: list[list[str]]) -> str:
    """A markdown table, its columns aligned by width; only the head has a cell for every column."""
    rows = [r for r in rows if r]
    if not rows:
        return ""
    rows[0] = rows[0] + [""] * (max(map(len, rows)) - len(rows[0]))
    width = [3] * len(rows[0])
    for r in rows:
        for k, c in enumerate(r):
            width[k] = max(width[k], min(PADDED, len(c)))
    line = lambda r: "| " + " | ".join(c.ljust(w) for c, w in zip(r, width)) + " |"
    return "\n".join([line(rows[0]), "|" + "|".join("-" * (w + 2) for w in width) + "|", *map(line, rows[1:])])


def clean(md: str) -> str:
    """Tidy markdown: blank lines, empty links, images, heads without a blank, repeated rules, lists of bare links."""
    md = "\n".join(line.rstrip() for line in re.sub(r"\n{3,}", "\n\n", md).splitlines())
    md = re.sub(r"!\[[^\[\]]*\]\([^()]*\)|\[[ \t]*\]\([^()]*\)", "", md)
    md = re.sub(r"^(#{1,6})([^# \n])", r"\1 \2", md, flags=re.M)
    md = re.sub(r"(\n---\n){2,}", "\n---\n", md)
    return re.sub(r"\n{3,}", "\n\n", without_link_lists(unescaped(md))).strip()


def unescaped(md: str) -> str:
    """Brackets without backslashes, but in fenced code."""
    fenced, out = False, []
    for line in md.split("\n"):
        fenced ^= line.startswith("```")
        out.append(line if fenced else re.sub(r"\\([()\[\]])", r"\1", line))
    return "\n".join(out)


def without_link_lists(md: str) -> str:
    """Without lists whose items are all bare short links, as menus are."""
    bare = re.compile(r"^- \[[^\]]{0,40}\]\([^)]*\)\s*$")
    out: list[str] = []
    held: list[str] = []
    for line in [*md.split("\n"), ""]:
        if line.startswith("- [") or held and (line.startswith("- ") or line.startswith("  ")):
            held.append(line)
            continue
        if not all(bare.match(x) and len(x.split()) < 7 for x in held):
            out += held
        held = []
        out.append(line)
    return "\n".join(out[:-1])


_text = ("title", "author", "description", "date", "extractor", "content_text", "content_markdown")
PAGE = T.StructType(
    [*(T.StructField(n, T.StringType()) for n in _text), T.StructField("ratio", T.DoubleType()), T.StructField("warnings", T.ArrayType(T.StringType()))]
)


def extract_pages(pages: DataFrame, url: str = "url", html: str = "html", links: bool = True) -> DataFrame:
    """pages with a struct `page` of what extract() finds; html is text or bytes. One pass in Arrow batches, no shuffle."""

    def run(urls: pd.Series, texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([extract(t, u or "", links) for u, t in zip(urls, texts)], columns=PAGE.names)

    return pages.withColumn("page", F.pandas_udf(run, PAGE)(F.col(url), F.col(html)))
