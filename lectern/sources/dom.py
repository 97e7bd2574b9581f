"""A small element tree over the standard library's HTML tokenizer.  Walks are loops, so depth is no limit."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset(("script", "style"))


class Node:
    __slots__ = ("tag", "attrs", "kids", "up")

    def __init__(self, tag: str, attrs: dict, up: Node | None):
        self.tag, self.attrs, self.kids, self.up = tag, attrs, [], up

    def stream(self) -> Iterator[Node | str]:
        """Elements and strings below, in document order."""
        left = self.kids[::-1]
        while left:
            item = left.pop()
            yield item
            if isinstance(item, Node):
                left.extend(reversed(item.kids))

    def walk(self) -> Iterator[Node]:
        return (n for n in self.stream() if isinstance(n, Node))

    def where(self, test: Callable[[Node], bool]) -> list[Node]:
        return [n for n in self.walk() if test(n)]

    def find_all(self, *tags: str) -> list[Node]:
        return self.where(lambda n: n.tag in tags)

    def find(self, *tags: str) -> Node | None:
        return next((n for n in self.walk() if n.tag in tags), None)

    def has(self, *classes: str) -> bool:
        return set(classes) <= set(self.attrs.get("class", "").split())

    def styled(self, what: str) -> bool:
        return what in self.attrs.get("style", "").replace(" ", "")

    def inside(self, *tags: str) -> bool:
        """Whether an element above has one of these tags."""
        node = self.up
        while node is not None and node.tag not in tags:
            node = node.up
        return node is not None

    def text(self, sep: str = " ") -> str:
        return squeeze(sep.join(s.strip() if sep else s for s in self.stream() if isinstance(s, str)))


def squeeze(text: str) -> str:
    return " ".join(text.split())


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", {}, None)
        self.open: dict[str, int] = {}

    def handle_starttag(self, tag, attrs):
        self.handle_startendtag(tag, attrs)
        if tag not in VOID:
            self.at = self.at.kids[-1]
            self.open[tag] = self.open.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.at.kids.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        while self.open.get(tag):  # a stray end tag costs nothing
            node, self.at = self.at, self.at.up
            self.open[node.tag] -= 1
            if node.tag == tag:
                break

    def handle_data(self, data):
        if self.at.tag not in SILENT:
            self.at.kids.append(data)


def parse_dom(source: str) -> Node:
    builder = _Builder()
    builder.feed(source)
    builder.close()
    return builder.root
