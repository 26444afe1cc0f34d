"""HTML on the standard library's parser: a tree, the few selectors that listings need, text."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html.parser import HTMLParser

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_SILENT = {"script", "style", "template"}
_BLOCKS = {"p", "div", "li", "h1", "h2", "h3", "h4", "h5", "h6"}


@dataclass
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list = field(default_factory=list)

    def walk(self):
        for c in self.children:
            if isinstance(c, Node):
                yield c
                yield from c.walk()

    @property
    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def strings(self):
        for c in self.children:
            if isinstance(c, str):
                yield c
            elif c.tag not in _SILENT:
                yield from c.strings()

    def text(self, between: str = "") -> str:
        return between.join(s for s in (x.strip() for x in self.strings()) if s)

    def find(self, tag: str | None = None, cls: str | None = None, has: str | None = None, href: re.Pattern | None = None) -> Node | None:
        for n in self.walk():
            if (tag is None or n.tag == tag) and (cls is None or cls in n.classes) and (has is None or has in n.attrs) and (href is None or href.search(n.attrs.get("href", ""))):
                return n
        return None


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("")
        self.path = [self.root]

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.path[-1].children.append(node)
        if tag not in _VOID:
            self.path.append(node)

    def handle_startendtag(self, tag, attrs):
        self.path[-1].children.append(Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        for i in range(len(self.path) - 1, 0, -1):
            if self.path[i].tag == tag:
                del self.path[i:]
                return

    def handle_data(self, data):
        self.path[-1].children.append(data)


def parse(html: str) -> Node:
    b = _Builder()
    b.feed(html)
    b.close()
    return b.root


def _fits(node: Node, simple: str) -> bool:
    tag, marks = re.match(r"([a-z0-9]*)(.*)", simple).groups()
    if tag and node.tag != tag:
        return False
    return all((m[1:] in node.classes) if m[0] == "." else node.attrs.get("id") == m[1:] for m in re.findall(r"[.#][\w-]+", marks))


def select(root: Node, selector: str) -> list[Node]:
    """Nodes that a selector of tags, classes, ids and descent picks, in document order."""
    steps = selector.split()
    out = []

    def visit(node: Node, done: int) -> None:
        for c in node.children:
            if isinstance(c, Node):
                last = done == len(steps) - 1
                if last and _fits(c, steps[-1]):
                    out.append(c)
                visit(c, done + 1 if not last and _fits(c, steps[done]) else done)

    visit(root, 0)
    return out


def first_selected(root: Node, selectors: tuple[str, ...], with_tag: str | None = None) -> list[Node]:
    """What the first selector that picks anything picks; ``with_tag``: nodes that hold such a tag."""
    for s in selectors:
        if found := [n for n in select(root, s) if with_tag is None or n.find(with_tag)]:
            return found
    return []


class _Text(HTMLParser):
    """Text as it comes; of open elements only their tags are held, however deep they lie."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.path: list[str] = []
        self.silent = 0

    def _break(self, tag: str) -> None:
        if not self.silent and tag in _BLOCKS:
            self.out.append("\n\n")

    def handle_starttag(self, tag, attrs):
        if tag == "br" and not self.silent:
            self.out.append("\n")
        self._break(tag)
        if tag not in _VOID:
            self.path.append(tag)
            self.silent += tag in _SILENT

    def handle_startendtag(self, tag, attrs):
        if tag == "br" and not self.silent:
            self.out.append("\n")
        self._break(tag)
        self._break(tag)

    def handle_endtag(self, tag):
        if tag in self.path:
            while self._leave() != tag:
                pass

    def _leave(self) -> str:
        tag = self.path.pop()
        self.silent -= tag in _SILENT
        self._break(tag)
        return tag

    def handle_data(self, data):
        if not self.silent:
            self.out.append(data)

    def close(self):
        super().close()
        while self.path:
            self._leave()


def plain_text(html: str) -> str:
    """Text of a page: line breaks for br, blank lines around blocks, no scripts or comments."""
    reader = _Text()
    reader.feed(html)
    reader.close()
    return "".join(reader.out)


def has_next(root: Node) -> bool:
    """Whether a listing links to a next page."""
    for n in root.walk():
        if n.tag == "a" and ("next" in n.attrs.get("rel", "").split() or re.search(r"\bnext\b", "".join(n.strings()), re.I)):
            return True
        if n.tag == "li" and "next" in n.classes and "disabled" not in n.classes:
            return True
    return False
