"""Elements of a landed page by selector: a small tree of one page and a matcher, for use inside Arrow batches.

Selectors are lists (,) of compounds joined by descent (blank) or childhood (>). A compound has a tag or *, #id,
.class and attribute tests: [a], [a=v], [a~=v], [a^=v], [a$=v], [a*=v], values bare or quoted.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: A start tag ends the outermost open element of these tags that no one of the second kind parts from it.
_ENDS = {
    "li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    **{t: ({"p"}, {"button", "table", "td", "th", "div", "li", "article", "section", "a"}) for t in _BLOCKS},
}


class Element:
    """number is its place among the page's elements, end that of the first element behind its subtree."""

    __slots__ = ("attributes", "content", "end", "number", "parent", "tag")

    def __init__(self, tag: str, attributes: dict[str, str], parent: Element | None, number: int):
        self.tag, self.attributes, self.parent, self.number, self.end = tag, attributes, parent, number, number + 1
        self.content: list[Element | str] = []

    def text(self) -> str:
        """All text below, white space squeezed."""
        out, todo = [], [self]
        while todo:
            at = todo.pop()
            if isinstance(at, str):
                out.append(at)
            else:
                todo.extend(reversed(at.content))
        return squeezed("".join(out))


def squeezed(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


class Page(HTMLParser):
    """A page's elements in document order; the first is the page itself, without a tag."""

    def __init__(self, html: str | None):
        super().__init__(convert_charrefs=True)
        self.elements = [Element("", {}, None, 0)]
        self.open = [self.elements[0]]
        self.feed(html or "")
        self.close()
        self._leave(0)

    def _leave(self, depth: int) -> None:
        for e in self.open[depth:]:
            e.end = len(self.elements)
        del self.open[depth:]

    def handle_starttag(self, tag: str, attrs) -> None:
        ends, walls = _ENDS.get(tag, ((), ()))
        ended = 0
        for i in range(len(self.open) - 1, 0, -1) if ends else ():
            if self.open[i].tag in walls:
                break
            if self.open[i].tag in ends:
                ended = i
        if ended:
            self._leave(ended)
        known: dict[str, str] = {}
        for name, value in attrs:
            known.setdefault(name, value or "")
        e = Element(tag, known, self.open[-1], len(self.elements))
        self.open[-1].content.append(e)
        self.elements.append(e)
        if tag not in VOID:
            self.open.append(e)

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)  # the slash means nothing in HTML

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                self._leave(i)
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].content.append(data)

    def find(self, selector: str, within: Element | None = None) -> list[Element]:
        """Elements below `within` that match, in document order; ancestors named in the selector may lie above it."""
        top = within or self.elements[0]
        match = matcher(selector)
        return [e for e in self.elements[top.number + 1 : top.end] if match(e)]

    @staticmethod
    def closest(e: Element, selector: str) -> Element | None:
        """The element itself or its nearest ancestor that matches."""
        match = matcher(selector)
        while e is not None and not (e.tag and match(e)):
            e = e.parent
        return e


_PART = re.compile(r"""\s*(?P<child>>)\s*|(?P<below>\s+)|(?P<tag>[a-zA-Z][\w-]*|\*)|\#(?P<id>[\w-]+)|\.(?P<class>[\w-]+)|\[\s*(?P<name>[\w-]+)\s*(?:(?P<how>[~^$*]?=)\s*(?:"(?P<q>[^"]*)"|'(?P<s>[^']*)'|(?P<bare>[^\]\s]+))\s*)?\]""")
_HOW: dict[str | None, Callable[[str, str], bool]] = {
    None: lambda v, w: True, "=": lambda v, w: v == w, "~=": lambda v, w: w in v.split(), "^=": lambda v, w: w != "" and v.startswith(w), "$=": lambda v, w: w != "" and v.endswith(w), "*=": lambda v, w: w != "" and w in v,
}


def _compounds(selector: str) -> list[tuple[str, list[Callable[[Element], bool]]]]:
    """(how it hangs on the one before: "", " " or ">", tests) in order."""
    out: list[tuple[str, list]] = [("", [])]
    at, text = 0, selector.strip()
    while at < len(text):
        m = _PART.match(text, at)
        if m is None:
            raise ValueError(f"not a selector: {selector!r}")
        at = m.end()
        tests = out[-1][1]
        if m["child"] or m["below"]:
            out.append((">" if m["child"] else " ", []))
        elif m["tag"]:
            tests.append(lambda e, t=m["tag"].lower(): t in ("*", e.tag))
        elif m["id"]:
            tests.append(lambda e, i=m["id"]: e.attributes.get("id") == i)
        elif m["class"]:
            tests.append(lambda e, c=m["class"]: c in e.attributes.get("class", "").split())
        else:
            value = next((v for v in (m["q"], m["s"], m["bare"]) if v is not None), "")
            tests.append(lambda e, n=m["name"].lower(), f=_HOW[m["how"]], w=value: n in e.attributes and f(e.attributes[n], w))
    if any(not tests for _, tests in out):
        raise ValueError(f"not a selector: {selector!r}")
    return out


def _hangs(e: Element, parts: list[tuple[str, list]], last: int) -> bool:
    if not all(test(e) for test in parts[last][1]):
        return False
    how, up = parts[last][0], e.parent
    if how == "":
        return True
    while up is not None and up.tag:
        if _hangs(up, parts, last - 1):
            return True
        if how == ">":
            return False
        up = up.parent
    return False


@lru_cache(maxsize=256)
def matcher(selector: str) -> Callable[[Element], bool]:
    ways = [_compounds(s) for s in re.findall(r"""(?:\[[^\]]*\]|[^,\[])+""", selector)]
    return lambda e: any(_hangs(e, w, len(w) - 1) for w in ways)
