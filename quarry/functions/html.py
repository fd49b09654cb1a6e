"""HTML to title, links, visible text and Markdown, by the standard library's parser over Arrow batches; simple parts as native expressions.

Markdown has a fixed form: ``#`` headings, blank lines between blocks, ``[text](href)``, ``**b**``, ``_i_``, code in backticks or fences,
``*`` and numbered lists, pipe tables; images, scripts, styles and comments are left out.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTENT = ("main", "article", "body")
SKIP = ("nav", "footer", "header", "aside")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("p div section article main header footer nav aside ul ol table blockquote form figure dl dd dt h1 h2 h3 h4 h5 h6 pre li tr".split())
_DROPPED = frozenset(("script", "style", "template", "noscript"))
_CLOSES = {"p": frozenset(("p",)), "li": frozenset(("li",)), "tr": frozenset(("tr", "td", "th")), "td": frozenset(("td", "th")), "th": frozenset(("td", "th")), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "option": frozenset(("option",))}


DEPTH = 200  # elements nested deeper are siblings: no text is lost, and no page can exhaust the stack


@dataclass
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list[Node | str] = field(default_factory=list)

    def walk(self):
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack += [c for c in reversed(n.children) if isinstance(c, Node)]

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                out.append(n)
            elif n.tag not in _DROPPED:
                stack += reversed(n.children)
        return "".join(out)


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("")
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        close = _CLOSES.get(tag) or (frozenset(("p",)) if tag in _BLOCK else frozenset())
        while len(self.open) > 1 and self.open[-1].tag in close:
            self.open.pop()
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in _VOID and len(self.open) < DEPTH:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


def parse(html: str) -> Node:
    t = _Tree()
    t.feed(html)
    t.close()
    return t.root


def matches(node: Node, selector: str) -> bool:
    """``tag``, ``.class``, ``#id``, ``[attr*='x']``, each alone."""
    if selector.startswith("."):
        return selector[1:] in node.attrs.get("class", "").split()
    if selector.startswith("#"):
        return node.attrs.get("id") == selector[1:]
    m = re.fullmatch(r"\[([\w-]+)([*^$]?)=['\"]?(.*?)['\"]?\]", selector)
    if m:
        have = node.attrs.get(m[1])
        return have is not None and {"*": m[3] in have, "^": have.startswith(m[3]), "$": have.endswith(m[3]), "": have == m[3]}[m[2]]
    return node.tag == selector


def content(root: Node, selectors=CONTENT, skip=SKIP) -> Node | None:
    """The first selector's first match, else the body, or all where the page names none, without what ``skip`` selects; the tree itself loses that, too."""
    found = next((n for s in (*selectors, "body") for n in root.walk() if n.tag and matches(n, s)), root if root.children else None)
    if found is not None:
        for n in found.walk():
            n.children = [c for c in n.children if isinstance(c, str) or not any(matches(c, s) for s in skip)]
    return found


def title(root: Node) -> str:
    """The first h1, else the title, up to a pipe."""
    for tag in ("h1", "title"):
        n = next((n for n in root.walk() if n.tag == tag), None)
        if n is not None and n.text().strip():
            return n.text().split("|")[0].strip()
    return "Untitled"


def hrefs(root: Node) -> list[str]:
    return [n.attrs["href"].strip() for n in root.walk() if n.tag == "a" and "href" in n.attrs]


def _inline(n: Node | str, base: str) -> str:
    if isinstance(n, str):
        return re.sub(r"\s+", " ", n)
    if n.tag in _DROPPED or n.tag == "img":
        return ""
    if n.tag == "br":
        return "  \n"
    if n.tag == "code":
        return f"`{n.text()}`"
    inner = "".join(_inline(c, base) for c in n.children)
    if n.tag in ("b", "strong") and inner.strip():
        return f"**{inner.strip()}**"
    if n.tag in ("i", "em") and inner.strip():
        return f"_{inner.strip()}_"
    if n.tag == "a" and n.attrs.get("href"):
        return f"[{inner.strip()}]({urljoin(base, n.attrs['href']) if base else n.attrs['href']})"
    return inner


def _blocks(n: Node, base: str, out: list[str], indent: str = "") -> None:
    run: list[str] = []

    def flush() -> None:
        text = re.sub(r" *\n *", "\n", "".join(run)).strip()
        run.clear()
        if text:
            out.append(indent + text)

    for c in n.children:
        if isinstance(c, str) or c.tag not in _BLOCK and c.tag not in ("html", "head", "body"):
            if isinstance(c, Node) and any(x.tag in _BLOCK for x in c.walk() if x is not c):
                flush()
                _blocks(c, base, out, indent)
            else:
                run.append(_inline(c, base))
            continue
        flush()
        if c.tag == "head":
            continue
        if re.fullmatch(r"h[1-6]", c.tag):
            out.append("#" * int(c.tag[1]) + " " + "".join(_inline(x, base) for x in c.children).strip())
        elif c.tag == "pre":
            out.append("```\n" + c.text().strip("\n") + "\n```")
        elif c.tag in ("ul", "ol"):
            items = [x for x in c.children if isinstance(x, Node) and x.tag == "li"]
            lines = []
            for k, x in enumerate(items):
                sub: list[str] = []
                _blocks(x, base, sub)
                lines.append(("* " if c.tag == "ul" else f"{k + 1}. ") + "\n".join(sub).replace("\n", "\n  "))
            if lines:
                out.append("\n".join(lines))
        elif c.tag == "table":
            rows = [[_inline_text(x, base) for x in r.children if isinstance(x, Node) and x.tag in ("td", "th")] for r in c.walk() if r.tag == "tr"]
            rows = [r for r in rows if r]
            if rows:
                width = max(map(len, rows))
                text = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
                out.append("\n".join([text[0], "| " + " | ".join(["---"] * width) + " |", *text[1:]]))
        elif c.tag == "blockquote":
            sub = []
            _blocks(c, base, sub)
            out.append("\n".join("> " + x for x in "\n\n".join(sub).split("\n")))
        else:
            _blocks(c, base, out, indent)
    flush()


def _inline_text(n: Node, base: str) -> str:
    return re.sub(r"\s+", " ", "".join(_inline(c, base) for c in n.children)).strip()


def to_markdown(n: Node, base: str = "") -> str:
    """T5"""
    out: list[str] = []
    _blocks(n, base, out)
    return "\n\n".join(out)


def visible(html: Column) -> Column:
    """T31, native: text without tags, scripts, styles and comments."""
    out = F.regexp_replace(html, r"(?is)<(script|style|template|noscript)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    return F.trim(F.regexp_replace(out, r"(?U)\s+", " "))


def native_title(html: Column) -> Column:
    """T1, native: for pages whose h1 and title hold no tags; the five XML entities are decoded."""
    raw = F.coalesce(F.nullif(F.trim(F.regexp_extract(html, r"(?is)<h1\b[^>]*>(.*?)</h1>", 1)), F.lit("")), F.nullif(F.trim(F.regexp_extract(html, r"(?is)<title\b[^>]*>(.*?)</title>", 1)), F.lit("")))
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        raw = F.replace(raw, F.lit(entity), F.lit(char))
    return F.coalesce(F.trim(F.substring_index(raw, "|", 1)), F.lit("Untitled"))


def native_hrefs(html: Column) -> Column:
    """T3, native: the href of each ``a``, in double or single quotes or bare."""
    attributes = r"""(?:[^>"']|"[^"]*"|'[^']*')*?"""
    found = F.regexp_extract_all(html, F.lit(rf"""(?is)<a(?=\s){attributes}\shref\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""), F.lit(1))
    return F.transform(found, lambda h: F.trim(F.when(h.rlike("^[\"']"), F.substring(h, F.lit(2), F.length(h) - 2)).otherwise(h)))


def extract(pages: DataFrame, selectors=CONTENT, skip=SKIP, thin: int = 200, short: int = 80) -> DataFrame:
    """url, title, markdown, hrefs, error: what a fetch makes of each page.

    Null html counts as empty. A page with fewer than ``thin`` visible characters is an error and has no
    links; one of less than ``short`` Markdown is dropped without one: its markdown is null. Links inside skipped elements of the content are lost.
    """

    def one(url: str, html: str) -> tuple:
        root = parse(html)
        if len(re.sub(r"\s+", " ", root.text()).strip()) < thin:
            return (url, None, None, None, "thin page")
        name = title(root)
        body = content(root, selectors, skip)
        md = re.sub(r"\n{4,}", "\n\n\n", to_markdown(body, url or "")) if body is not None else ""
        md = "\n".join(x.rstrip() for x in md.split("\n")).strip()
        if len(md) < short:
            return (url, name, None, None, None)
        return (url, name, md, hrefs(root), None)

    schema = pa.schema([("url", pa.string()), ("title", pa.string()), ("markdown", pa.string()), ("hrefs", pa.list_(pa.string())), ("error", pa.string())])

    def run(batches):
        for b in batches:
            rows = [one(u, h or "") for u, h in zip(b.column("url").to_pylist(), b.column("html").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], f.type) for f in schema], schema=schema)

    return pages.select("url", "html").mapInArrow(run, "url string, title string, markdown string, hrefs array<string>, error string")
