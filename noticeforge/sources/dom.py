"""A small tree of a page's elements, for parsers that follow its structure."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser

from noticeforge.sources.html import VOID

#: Elements that end where the next one of their kind begins.
SELF_CLOSING = frozenset(("li", "p", "tr", "td"))


class Node:
    def __init__(self, tag: str, attrs: dict[str, str]) -> None:
        self.tag, self.attrs = tag, attrs
        self.children: list[Node | str] = []

    @property
    def classes(self) -> set[str]:
        return set((self.attrs.get("class") or "").split())

    def walk(self) -> Iterator[Node]:
        """The elements below, in the order of the page."""
        for child in self.children:
            if isinstance(child, Node):
                yield child
                yield from child.walk()

    def all(self, tag: str = "", css: str = "", where: Callable[[Node], bool] = lambda n: True) -> list[Node]:
        return [n for n in self.walk() if (not tag or n.tag == tag) and (not css or css in n.classes) and where(n)]

    def one(self, tag: str = "", css: str = "", where: Callable[[Node], bool] = lambda n: True) -> Node | None:
        return next(iter(self.all(tag, css, where)), None)

    def text(self) -> str:
        parts = [c if isinstance(c, str) else c.text() for c in self.children]
        return " ".join(" ".join(parts).split())


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        if tag in SELF_CLOSING and self.open[-1].tag == tag:
            self.open.pop()
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_endtag(self, tag):
        if any(n.tag == tag for n in self.open[1:]):
            while self.open.pop().tag != tag:
                pass

    def handle_data(self, data):
        if self.open[-1].tag not in ("script", "style"):
            self.open[-1].children.append(data)


def tree(html: str | None) -> Node:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root
