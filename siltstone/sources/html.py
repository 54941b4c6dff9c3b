"""HTML pages as titles and markdown."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Elements that hold no content, elements without an end, and elements that end an open paragraph.
NOISE = ("script", "style", "nav", "footer", "header", "aside", "noscript", "svg")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
BLOCKS = ("p", "div", "section", "article", "main", "ul", "ol", "table", "blockquote", "pre", "h1", "h2", "h3", "h4", "h5", "h6", "hr")


class _Element:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str | None]):
        self.tag, self.attrs, self.children = tag, attrs, []


class _Tree(HTMLParser):
    """The elements of a page. An open paragraph ends before a block, a list item before the next; what is left open at the end
    of a page ends there."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = _Element("", {})
        self.open = [self.root]

    def _close(self, tag: str, within: tuple[str, ...] = ()) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return
            if self.open[i].tag in within:
                return

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self._close("p", ("li", "td", "div", "blockquote"))
        elif tag == "li":
            self._close("li", ("ul", "ol"))
        element = _Element(tag, dict(attrs))
        self.open[-1].children.append(element)
        if tag not in VOID:
            self.open.append(element)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._close(tag)

    def handle_endtag(self, tag):
        self._close(tag)

    def handle_data(self, data):
        self.open[-1].children.append(data)


def _tree(page: str) -> _Element:
    parser = _Tree()
    parser.feed(page)
    parser.close()
    return parser.root


def _first(element: _Element, tag: str) -> _Element | None:
    """The first element of a kind, in the order of the page."""
    todo = [element]
    while todo:
        at = todo.pop()
        if at.tag == tag:
            return at
        todo += [c for c in reversed(at.children) if not isinstance(c, str)]
    return None


def _text(element: _Element) -> str:
    """All text of an element, as written."""
    out, todo = [], [element]
    while todo:
        at = todo.pop()
        if isinstance(at, str):
            out.append(at)
        else:
            todo += reversed(at.children)
    return "".join(out)


def _code(element: _Element) -> str:
    inner = next((c for c in element.children if not isinstance(c, str) and c.tag == "code"), None)
    names = ((inner.attrs.get("class") or "").split()) if inner else []
    lang = next((n[len("language-") :] for n in names if n.startswith("language-")), "")
    return f"\n\n```{lang}\n{_text(inner or element)}\n```\n\n"


def _written(element: _Element, inner: str) -> str:
    """An element as markdown, given its content."""
    tag, own, get = element.tag, inner.strip(), lambda name: element.attrs.get(name) or ""
    if re.fullmatch("h[1-6]", tag):
        return f"\n\n{'#' * int(tag[1])} {own}\n\n"
    if tag == "a":
        return f"[{own}]({get('href')})" if own and get("href") else own
    if tag == "img":
        return f"![{get('alt')}]({get('src')})"
    marks = {"strong": "**", "b": "**", "em": "*", "i": "*", "code": "`"}
    if tag in marks:
        return marks[tag] + own + marks[tag]
    shapes = {"p": f"\n\n{own}\n\n", "li": f"\n- {own}", "ul": f"\n{inner}\n", "ol": f"\n{inner}\n", "br": "\n"}
    return shapes.get(tag, inner)


def _markdown(root: _Element) -> str:
    """Depth first without recursion, as pages may be nested at any depth."""
    stack: list[tuple[_Element, list[str], Iterator]] = [(root, [], iter(root.children))]
    while True:
        element, parts, left = stack[-1]
        child = next(left, None)
        if child is None:
            stack.pop()
            inner = "".join(parts)
            done = inner if element is root else _written(element, inner)
            if not stack:
                return done
            stack[-1][1].append(done)
        elif isinstance(child, str):
            parts.append(re.sub("[ \\t\\n\\f\\r]+", " ", child))
        elif child.tag == "pre":
            parts.append(_code(child))
        elif child.tag not in NOISE and child.tag not in ("head", "title"):
            stack.append((child, [], iter(child.children)))


def tidied(text: str) -> str:
    """Lines without outer white space, and one empty line at most between others."""
    lines = "\n".join(line.strip() for line in text.splitlines())
    return re.sub(r"\n{3,}", "\n\n", lines).strip()


def decode_entities(text: str) -> str:
    import html

    return html.unescape(text)


def strip_tags(page: str) -> str:
    """The text of a page or fragment, without any element's tags."""
    return _text(_tree(page))


def title(page: str) -> str:
    """The title, else the first main heading, else the first line of text, cut to 200 characters; empty without any."""
    root = _tree(page)
    for tag in ("title", "h1"):
        found = _first(root, tag)
        if found and (named := _text(found).strip()):
            return named
    return next((line.strip()[:200] for line in _text(root).splitlines() if line.strip()), "")


def markdown(page: str) -> str:
    """The content of a page - its article, else its main part, else its body - as markdown."""
    tree = _tree(page)
    root = next((found for tag in ("article", "main", "body") if (found := _first(tree, tag))), tree)
    return tidied(_markdown(root))


def pages_to_markdown(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, title, markdown; null pages give nulls."""
    schema = T.StructType([pages.select(key).schema[0], T.StructField("title", T.StringType()), T.StructField("markdown", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if t is None else title(t) for t in texts], pa.string()), pa.array([None if t is None else markdown(t) for t in texts], pa.string())], names=schema.names)

    return pages.select(key, html).mapInArrow(run, schema)
