"""A small HTML tree on the standard library's tokenizer, with the selectors the operators need."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Start tags that end an open paragraph, and what each start tag closes among its siblings.
BLOCKS = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}}
SCOPES = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "thead": {"table"}, "tbody": {"table"}, "option": {"select"}}


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None) -> None:
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def text(self, skip: frozenset[int] = frozenset()) -> str:
        out, stack = [], [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out.append(x)
            elif id(x) not in skip:
                stack.extend(reversed(x.children))
        return "".join(out)

    def walk(self, skip: frozenset[int] = frozenset()) -> Iterator[Node]:
        """Elements below in document order."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            x = stack.pop()
            if id(x) in skip:
                continue
            yield x
            stack.extend(c for c in reversed(x.children) if isinstance(c, Node))

    def find(self, *tags: str, skip: frozenset[int] = frozenset()) -> list[Node]:
        return [n for n in self.walk(skip) if n.tag in tags]

    def following(self) -> list[Node]:
        """Element siblings after this one."""
        if not self.parent:
            return []
        at = next(i for i, c in enumerate(self.parent.children) if c is self)
        return [c for c in self.parent.children[at + 1 :] if isinstance(c, Node)]

    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", {}, None)

    def _close(self, tags: set[str], stop: set[str]) -> None:
        x = self.at
        while x.parent and x.tag not in stop:
            if x.tag in tags:
                self.at = x.parent
            x = x.parent

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self._close({"p"}, {"td", "th", "li", "div", "article", "section", "main", "body", "button"})
        if tag in CLOSES:
            self._close(CLOSES[tag], SCOPES[tag])
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.at = self.at.parent or self.root

    def handle_endtag(self, tag):
        x = self.at
        while x.parent and x.tag != tag:
            x = x.parent
        if x.parent:
            self.at = x.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str) -> Node:
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.root


def matches(node: Node, simple: str) -> bool:
    """tag, .class, [attr="x"] or [attr*="x"]."""
    if simple.startswith("."):
        return simple[1:] in node.classes()
    if m := re.fullmatch(r'\[(\w+)(\*?)="([^"]*)"\]', simple):
        value = node.attrs.get(m[1], "")
        return m[3] in value if m[2] else value == m[3]
    return node.tag == simple


def select(root: Node, selector: str, skip: frozenset[int] = frozenset()) -> list[Node]:
    """Elements that match a simple selector or a chain of them by descent."""
    parts = selector.split()
    out = []
    for n in root.walk(skip):
        if matches(n, parts[-1]):
            x, rest = n.parent, parts[:-1]
            while rest and x:
                if matches(x, rest[-1]):
                    rest = rest[:-1]
                x = x.parent
            if not rest:
                out.append(n)
    return out
