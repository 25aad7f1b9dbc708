"""Raw texts picked out of HTML, one Arrow-batched pass per page.

The Python side only finds elements and returns their texts and attributes; what they mean is decided
by Spark columns (see operators/extraction.py). Whole pages are read; nothing is shuffled.

A field is "<selector>|<selector>..." with an optional "@" value:
    @name        the attribute of every match       @a,b,c   these attributes of the first match
    @-sup        text without <sup> parts           @trail   links of the enclosing list items
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

FOUND = T.MapType(T.StringType(), T.ArrayType(T.MapType(T.StringType(), T.ArrayType(T.StringType()))))
_ARROW = pa.map_(pa.string(), pa.list_(pa.map_(pa.string(), pa.list_(pa.string()))))

# Fixed values of the HTML standard: elements that have no end tag.
VOID = set("area base br col embed hr img input link meta source track wbr".split())
_PART = re.compile(r"([a-zA-Z][\w-]*)|\.([\w-]+)|#([\w-]+)|\[([\w-]+)(?:([\^$]?=)\"([^\"]*)\")?\]|:not\(\.([\w-]+)\)")


class _Node:
    __slots__ = ("tag", "attrs", "classes", "parent", "end", "pieces")

    def __init__(self, tag, attrs, parent):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.classes = attrs.get("class", "").split()
        self.end = 0
        self.pieces = []


class _Page(HTMLParser):
    """Elements in document order; a node's subtree is nodes[i:node.end]."""

    def __init__(self, html):
        super().__init__(convert_charrefs=True)
        self.nodes, self.open, self.said = [], [], 0
        self.feed(html)
        self.close()
        while self.open:
            self._shut()

    def _shut(self):
        self.nodes[self.open.pop()].end = len(self.nodes)

    def handle_starttag(self, tag, attrs):
        if tag in ("li", "p"):
            for i in reversed(self.open):
                if self.nodes[i].tag == tag:
                    self.handle_endtag(tag)
                    break
                if tag == "p" or self.nodes[i].tag in ("ul", "ol"):
                    break
        parent = self.open[-1] if self.open else None
        self.nodes.append(_Node(tag, {k: v or "" for k, v in attrs}, parent))
        self.nodes[-1].end = len(self.nodes)
        if tag not in VOID:
            self.open.append(len(self.nodes) - 1)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if any(self.nodes[i].tag == tag for i in self.open):
            while self.nodes[self.open[-1]].tag != tag:
                self._shut()
            self._shut()

    def handle_data(self, data):
        if self.open and data.strip() and self.nodes[self.open[-1]].tag not in ("script", "style"):
            self.said += 1
            self.nodes[self.open[-1]].pieces.append((self.said, data.strip()))


def _compound(text):
    return [m.groups() for m in _PART.finditer(text)]


def _fits(node, compound):
    for tag, cls, ident, attr, op, value, unwanted in compound:
        if tag and node.tag != tag or cls and cls not in node.classes:
            return False
        if ident and node.attrs.get("id") != ident or unwanted and unwanted in node.classes:
            return False
        if attr:
            have = node.attrs.get(attr)
            if have is None:
                return False
            if op == "=" and have != value or op == "^=" and not have.startswith(value):
                return False
            if op == "$=" and not have.endswith(value):
                return False
    return True


def _field(spec):
    """Split a field into its selectors (each a list of compounds) and its value."""
    selectors, _, value = spec.rpartition("@") if "@" in spec else (spec, "", "")
    return [[_compound(p) for p in s.split()] for s in selectors.split("|")], value


def _key(compound):
    """A class, id, attribute or tag that every element matching a compound has."""
    for at, mark in ((1, "."), (2, "#"), (3, "["), (0, "")):
        for part in compound:
            if part[at]:
                return mark + part[at]
    return ""


def _index(fields):
    """Selectors by the key of their last compound, so that an element meets only those it may match."""
    index = {}
    for name, (selectors, _) in fields.items():
        for selector in selectors:
            index.setdefault(_key(selector[-1]), []).append((name, selector))
    return index


def _keys(node):
    yield node.tag
    yield from ["." + c for c in node.classes]
    yield from ["[" + a for a in node.attrs]
    if "id" in node.attrs:
        yield "#" + node.attrs["id"]


def _matches(nodes, i, selector, stop):
    if not _fits(nodes[i], selector[-1]):
        return False
    at = nodes[i].parent
    for compound in reversed(selector[:-1]):
        while at is not None and at >= stop and not _fits(nodes[at], compound):
            at = nodes[at].parent
        if at is None or at < stop:
            return False
        at = nodes[at].parent
    return True


def _text(nodes, i, skip=None):
    pieces, j = [], i
    while j < nodes[i].end:
        if nodes[j].tag == skip:
            j = nodes[j].end
            continue
        pieces += nodes[j].pieces
        j += 1
    return " ".join(text for _, text in sorted(pieces))


def _trail(nodes, i, stop):
    links, at = [], nodes[i].parent
    while at is not None and at > stop:
        if nodes[at].tag == "li":
            own = next((j for j in range(at + 1, nodes[at].end) if nodes[j].parent == at and nodes[j].tag == "a"), None)
            if own is not None and own != i:
                links.append(nodes[own].attrs.get("href", ""))
        at = nodes[at].parent
    return "\n".join(reversed(links))


def _values(nodes, hits, value, stop):
    if value == "trail":
        return [_trail(nodes, i, stop) for i in hits]
    if value.startswith("-"):
        return [_text(nodes, i, value[1:]) for i in hits]
    if "," in value:
        return [nodes[hits[0]].attrs.get(a, "") for a in value.split(",")] if hits else []
    if value:
        return [nodes[i].attrs.get(value, "") for i in hits]
    return [_text(nodes, i) for i in hits]


def _find(html, wanted):
    nodes = _Page(html).nodes if html else []
    found = {}
    for name, (container, fields, index) in wanted.items():
        records = []
        for c in range(len(nodes)) if container else [None]:
            if c is not None and not any(_matches(nodes, c, s, 0) for s in container[0]):
                continue
            start, end, stop = (0, len(nodes), 0) if c is None else (c, nodes[c].end, c)
            hits = {field: [] for field in fields}
            for i in range(start, end):
                for key in _keys(nodes[i]):
                    for field, selector in index.get(key, ()):
                        if hits[field][-1:] != [i] and _matches(nodes, i, selector, stop):
                            hits[field].append(i)
            records.append({f: _values(nodes, hits[f], value, stop) for f, (_, value) in fields.items()})
        found[name] = records
    return found


def find(html: Column, wanted: dict[str, tuple[str, dict[str, str]]]) -> Column:
    """map<name, array<record>>: for each name, one record per container element ('' = the page).

    A record maps each field to the list of its values; an element that is not there gives [].
    """
    compiled = {}
    for name, (container, fields) in wanted.items():
        parsed = {k: _field(v) for k, v in fields.items()}
        compiled[name] = (_field(container) if container else None, parsed, _index(parsed))

    @F.arrow_udf(FOUND)
    def pick(pages: pa.Array) -> pa.Array:
        found = (_find(html.as_py(), compiled) for html in pages)
        return pa.array([[(name, [list(r.items()) for r in records]) for name, records in f.items()] for f in found], type=_ARROW)

    return pick(html)


def first(record: Column, field: str) -> Column:
    """The first value of a field, null when the element is absent."""
    return F.get(record[field], F.lit(0))


def present(record: Column, field: str) -> Column:
    return F.size(record[field]) > 0
