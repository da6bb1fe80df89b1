"""The article of a page (F7): blocks of running text score for what they are in, and the best element with its kin is the article.

A block of text scores by its length and its sentence marks, less what is linked. Its ancestors get the score too, each half of what the one below got, weighed by their
tag, class and id. The element with the highest score is the article's, with siblings that score well or are paragraphs themselves. What is
named or shaped like the furniture of a page is left out first; if too little text remains, it is let in again step by step.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from tidemark.sources.dom import UNSEEN, Element, body_of

# Tags and roles of the furniture of pages, and words of class names and ids that speak against and for an article.
FURNITURE = frozenset("nav footer aside button iframe svg select input textarea dialog menu".split()) | UNSEEN
FURNITURE_ROLES = frozenset("navigation banner menu menubar complementary contentinfo dialog alertdialog search".split())
AGAINST = frozenset(
    "ad ads adsense advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header masthead menu modal nav navbar navigation newsletter "
    "outbrain pager pagination popup promo promoted promotion recommended related remark share shares sharing sidebar signup social sponsor sponsored subscribe subscription taboola toolbar widget widgets".split()
)
FOR = frozenset("article blog body content entry hentry main page post story text".split())
BLOCKS = frozenset("address article aside blockquote br dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_MARKS = re.compile("[.,;:!?、。，；：！？]")
_NAME_WORD = re.compile("[A-Z]?[a-z]+|[A-Z]+")
_TITLE_PARTS = re.compile(r"\s+[|\-–—»/·]\s+")

#: Characters of a block that scores, from which its length scores no more, of an article found at the first go, and ancestors that share a score.
LEAST, MOST, ENOUGH, ANCESTORS = 25, 600, 500, 4
#: What furniture is left out: by name, by shape. Each pass leaves out less.
PASSES = ((True, True), (False, True), (False, False))


@dataclass(frozen=True)
class Article:
    title: str
    text: str
    excerpt: str


class _Facts:
    """Of an element: its visible characters, those in links, its sentence marks, its place in document order, and whether blocks are in it."""

    __slots__ = ("blocks", "chars", "linked", "marks", "place")

    def __init__(self, place: int):
        self.place, self.chars, self.linked, self.marks, self.blocks = place, 0, 0, 0, False

    def density(self) -> float:
        return self.linked / self.chars if self.chars else 0.0


def name_words(e: Element) -> set[str]:
    return {w.lower() for w in _NAME_WORD.findall(f"{e.attrs.get('class', '')} {e.attrs.get('id', '')}")}


def _is_hidden(e: Element) -> bool:
    style = e.attrs.get("style", "").replace(" ", "").lower()
    return "hidden" in e.attrs or e.attrs.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style


def _is_furniture(e: Element, names: bool) -> bool:
    if e.tag in ("html", "body", "main", "article", "a"):
        return False
    if e.tag in FURNITURE or e.attrs.get("role") in FURNITURE_ROLES or _is_hidden(e):
        return True
    if not names:
        return False
    words = name_words(e)
    return bool(words & AGAINST) and not words & FOR


def _weight(e: Element) -> float:
    words = name_words(e)
    by_name = 1 + 0.25 * bool(words & FOR) - 0.75 * bool(words & AGAINST)
    return max(0.25, by_name) * {"article": 2.0, "main": 1.5, "body": 0.5, "html": 0.25, "form": 0.75, "li": 0.5}.get(e.tag, 1.0)


class _Page:
    """A page as one pass sees it: facts of the elements that it does not leave out."""

    def __init__(self, root: Element, names: bool, shapes: bool):
        self.names, self.shapes = names, shapes
        self.seen: list[Element] = []
        self.facts: dict[int, _Facts] = {}
        stack: list[tuple[Element, bool]] = [(body_of(root), False)]
        while stack:
            e, linked = stack.pop()
            facts = self.facts[id(e)] = _Facts(len(self.seen))
            self.seen.append(e)
            linked = linked or e.tag == "a"
            for child in reversed(e.children):
                if isinstance(child, str):
                    chars = len(" ".join(child.split()))
                    facts.chars += chars
                    facts.linked += chars if linked else 0
                    facts.marks += len(_MARKS.findall(child))
                elif not _is_furniture(child, names):
                    stack.append((child, linked))
        for e in reversed(self.seen[1:]):
            own, above = self.facts[id(e)], self.facts[id(e.parent)]
            above.chars += own.chars
            above.linked += own.linked
            above.marks += own.marks
            above.blocks = above.blocks or own.blocks or e.tag in BLOCKS and e.tag != "br"

    def scores(self) -> dict[int, tuple[float, Element]]:
        """Elements above blocks of text, with their scores."""
        points: dict[int, float] = {}
        above: dict[int, Element] = {}
        for e in self.seen:
            f = self.facts[id(e)]
            if f.chars >= LEAST and (e.tag in ("p", "pre", "blockquote") or e.tag in ("div", "section", "td", "dd", "article") and not f.blocks):
                share = (min(f.chars, MOST) / 100 + f.marks / 2) * (1 - f.density())
                for a in ([e] if e.tag != "p" else []) + list(e.ancestors(ANCESTORS)):
                    if id(a) not in self.facts:
                        break
                    points[id(a)] = points.get(id(a), 0.0) + share
                    above[id(a)] = a
                    share /= 2
        return {i: (p * _weight(above[i]) * (1 - self.facts[i].density()), above[i]) for i, p in points.items()}

    def parts(self) -> list[Element]:
        """The elements that are the article, in order."""
        scores = self.scores()
        if not scores:
            return [] if self.shapes else [self.seen[0]]
        best, top = max(scores.values(), key=lambda s: (s[0], -self.facts[id(s[1])].place))
        if top.parent is None or id(top.parent) not in self.facts:
            return [top]
        named = name_words(top)
        out = []
        for e in top.parent.children:
            f = self.facts.get(id(e))
            if e is top:
                out.append(e)
            elif f is not None and not isinstance(e, str):
                alike = bool(named) and name_words(e) == named
                scored = scores.get(id(e), (0.0, e))[0] >= best * (0.1 if alike else 0.2)
                told = e.tag == "p" and f.density() < 0.25 and (f.chars > 80 or f.marks > 0 and not f.linked)
                prose = e.tag in ("div", "section") and f.density() < 0.1 and f.chars > 80 and f.marks > 1 and not name_words(e) & AGAINST
                if scored or told or prose:
                    out.append(e)
        return out

    def _is_list_of_links(self, e: Element) -> bool:
        f = self.facts[id(e)]
        return e.tag in ("ul", "ol", "dl", "table", "div", "section", "form", "fieldset") and f.chars > 0 and f.density() > 0.5

    def lines(self, parts: list[Element]) -> list[str]:
        """The text of the parts: a line for each block and after each line break; only preformatted blocks keep their own lines."""
        out: list[str] = []
        line: list[str] = []

        def end() -> None:
            if text := " ".join("".join(line).split()):
                out.append(text)
            line.clear()

        stack: list = list(reversed(parts))
        while stack:
            node = stack.pop()
            if node is None:
                end()
            elif isinstance(node, str):
                line.append(node)
            elif id(node) in self.facts and not (self.shapes and self._is_list_of_links(node)):
                if node.tag == "pre":
                    end()
                    out += [s for raw in node.text().split("\n") if (s := raw.rstrip())]
                elif node.tag in BLOCKS:
                    end()
                    stack.append(None)
                    stack += reversed(node.children)
                else:
                    stack += reversed(node.children)
        end()
        return out


def _line(e: Element | None) -> str:
    return " ".join(e.text().split()) if e is not None else ""


def _meta(root: Element, *names: str) -> str:
    for name in names:
        found = root.first(lambda e, n=name: e.tag == "meta" and n in (e.attrs.get("property"), e.attrs.get("name")) and e.attrs.get("content", "").strip() != "")
        if found is not None:
            return " ".join(found.attrs["content"].split())
    return ""


def page_title(root: Element) -> str:
    """What the page says it is called for sharing, else its title without the site's name if a heading shows which part that is, else its first heading."""
    if shared := _meta(root, "og:title", "twitter:title"):
        return shared
    title = _line(root.first(lambda e: e.tag == "title"))
    headings = [_line(e) for e in root.walk() if e.tag in ("h1", "h2")]
    if not title:
        return next(iter(headings), "")
    parts = _TITLE_PARTS.split(title)
    return next((h for h in headings if len(parts) > 1 and h in parts), title)


def find_article(root: Element) -> Article:
    """Title, text and excerpt of a page. A heading that repeats the title is no part of the text; a page without text gives empty strings.

    The first pass with ENOUGH characters counts, else the one with most.
    """
    title, text = page_title(root), ""
    for names, shapes in PASSES:
        page = _Page(root, names, shapes)
        lines = page.lines(page.parts())
        if lines and lines[0] == title:
            lines = lines[1:]
        found = "\n".join(lines)
        text = max(text, found, key=len)
        if len(found) >= ENOUGH:
            text = found
            break
    return Article(title, text, _meta(root, "description", "og:description") or text.split("\n", 1)[0])
