"""A small document tree from html.parser, for what needs ancestors and document order."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser

# Elements without content, elements whose text is none of the page's, and what an opening tag closes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style noscript template".split())
CLOSED_BY = {
    "li": ("li",),
    "tr": ("tr", "td", "th"),
    "td": ("td", "th"),
    "th": ("td", "th"),
    "option": ("option",),
    "dt": ("dt", "dd"),
    "dd": ("dt", "dd"),
} | dict.fromkeys("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split(), ("p",))
SCOPES = frozenset("html body table ul ol dl td th div article section main".split())


class Element:
    """A tag, its attributes, its children (elements and strings) and its parent."""

    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Element | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self) -> Iterator[Element]:
        """The elements below, in document order; what is inside a template is no part of the document."""
        stack = [iter(self.children)]
        while stack:
            for child in stack[-1]:
                if isinstance(child, Element):
                    yield child
                    if child.tag != "template":
                        stack.append(iter(child.children))
                        break
            else:
                stack.pop()

    def first(self, test: Callable[[Element], bool]) -> Element | None:
        return next((e for e in self.walk() if test(e)), None)

    def ancestors(self, most: int | None = None) -> Iterator[Element]:
        at = self.parent
        while at is not None and at.tag != "#root" and (most is None or most > 0):
            yield at
            at, most = at.parent, None if most is None else most - 1

    def strings(self, skip: frozenset[str] = frozenset({"template"})) -> Iterator[str]:
        """The text nodes below, in order, but for those inside ``skip``."""
        stack = [iter(self.children)]
        while stack:
            for child in stack[-1]:
                if isinstance(child, str):
                    yield child
                elif child.tag not in skip:
                    stack.append(iter(child.children))
                    break
            else:
                stack.pop()

    def text(self) -> str:
        return "".join(self.strings())

    def clean_text(self) -> str:
        """Text nodes parted by spaces, without scripts, styles, noscript and templates."""
        return " ".join(self.strings(UNSEEN))


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("#root", {}, None)

    def handle_starttag(self, tag, attrs):
        if closes := CLOSED_BY.get(tag):
            at = self.at
            while at.tag not in closes and at.tag not in SCOPES and at.parent is not None:
                at = at.parent
            if at.tag in closes:
                self.at = at.parent
        node = Element(tag, {k: v or "" for k, v in reversed(attrs)}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        at = self.at
        while at.parent is not None and at.tag != tag:
            at = at.parent
        if at.parent is not None:
            self.at = at.parent

    def handle_data(self, data):
        if self.at.children and isinstance(self.at.children[-1], str):
            self.at.children[-1] += data
        else:
            self.at.children.append(data)


def parse_html(html: str) -> Element:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def body_of(root: Element) -> Element:
    return root.first(lambda e: e.tag == "body") or root
