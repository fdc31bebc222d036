"""A small tree of HTML elements for readers of landed pages."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements whose start ends an open element of the same group.
SIBLINGS = {"li": ("li",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "p": ("p",), "option": ("option",)}
WALLS = frozenset("ul ol table dl div section article body html".split())


_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "attributes", "parent", "children", "raw")

    def __init__(self, tag: str, attributes: dict[str, str], parent: Node | None, raw: str = ""):
        self.tag, self.attributes, self.parent, self.children, self.raw = tag, attributes, parent, [], raw

    def get(self, name: str) -> str:
        return self.attributes.get(name) or ""

    def walk(self) -> Iterator[Node | str]:
        """What lies below, in document order; texts are strings."""
        todo = list(reversed(self.children))
        while todo:
            node = todo.pop()
            yield node
            if isinstance(node, Node):
                todo.extend(reversed(node.children))

    def nodes(self, *tags: str) -> Iterator[Node]:
        return (n for n in self.walk() if isinstance(n, Node) and (not tags or n.tag in tags))

    def text(self, sep: str = "") -> str:
        """All text below with white space collapsed."""
        return " ".join(sep.join(n for n in self.walk() if isinstance(n, str)).split())

    def inside(self, *tags: str) -> bool:
        node = self.parent
        while node is not None:
            if node.tag in tags:
                return True
            node = node.parent
        return False


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("html", {}, None)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("html", "body"):
            return
        node = self.at
        while tag in SIBLINGS and node.parent is not None and node.tag not in WALLS:
            if node.tag in SIBLINGS[tag]:
                self.at = node.parent
                break
            node = node.parent
        child = Node(tag, {k: v or "" for k, v in reversed(attrs)}, self.at, self.get_starttag_text() or "")
        self.at.children.append(child)
        if tag not in VOID:
            self.at = child

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.at.tag == tag:
            self.at = self.at.parent or self.root

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node.parent is not None:
            if node.tag == tag:
                self.at = node.parent
                return
            node = node.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def parse(html: str | None) -> Node:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


def short_texts(root: Node, most: int) -> dict[int, str | None]:
    """For each element below, by ``id``, its text with white space collapsed if that has fewer than ``most`` characters, else None.

    Texts are put together from the leaves up, so that a page costs its size, however deep it is.
    """
    held: dict[int, str | None] = {}  # with a space at an end where white space stands there
    order = [root]
    for node in order:
        order.extend(c for c in node.children if isinstance(c, Node))
    for node in reversed(order):
        parts, size = [], 0
        for child in node.children:
            text = _SPACE.sub(" ", child) if isinstance(child, str) else held[id(child)]
            size += most + 2 if text is None else len(text) - text.count(" ")
            if size >= most:
                break
            parts.append(text)
        held[id(node)] = None if size >= most else _SPACE.sub(" ", "".join(parts))
    return {k: v.strip(" ") if v is not None and len(v.strip(" ")) < most else None for k, v in held.items()}


def below(root: Node, *tags: str) -> set[int]:
    """The ``id`` of all nodes that lie in an element of ``tags``."""
    found, todo = set(), [(root, False)]
    while todo:
        node, inside = todo.pop()
        if inside:
            found.add(id(node))
        inside = inside or node.tag in tags
        todo.extend((c, inside) for c in node.children if isinstance(c, Node))
    return found


def joined(base: str, href: str) -> str:
    """Absolute address of a link; empty if either is no address."""
    try:
        return urljoin(base, href.strip())
    except ValueError:
        return ""


def split(url: str):  # noqa: ANN201
    """Parts of an address; None if it is none."""
    try:
        parts = urlsplit(url)
        return parts if parts.scheme in ("http", "https") and parts.hostname else None
    except ValueError:
        return None
