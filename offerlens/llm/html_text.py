"""Operator 3, HTML extraction: layout-aware rendering of raw pages.

A tree builder closes and opens the tags that authors leave out (p, li, dt, dd, option, table parts), moves stray
text out of tables and ignores unmatched end tags. Invisible subtrees (head, script, hidden elements, ...) are dropped;
all other text is rendered: blocks on lines of their own with blank lines where browsers put margins, list markers
with indents, preformatted text as it stands, and table cells in aligned columns. Neither step recurses, so deep
nesting is no danger.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlens.llm import common

# Element classes of the HTML standard's parsing and rendering sections.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head title meta link base script style template noscript noframes noembed iframe object canvas audio video svg math datalist param source track area rp col colgroup".split())
RAW = frozenset("script style xmp iframe noembed noframes title textarea".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu dir blockquote pre xmp listing table figure hr".split())
BLOCK = SPACED | frozenset("html body div section article header footer nav main aside address center form fieldset legend details summary figcaption hgroup search li dt dd optgroup option select caption tr thead tbody tfoot td th".split())
CLOSES_P = (SPACED | frozenset("div section article header footer nav main aside address center form fieldset details summary figcaption hgroup search li dt dd".split())) - {"table"}
LISTS = frozenset("ul ol menu dir".split())
PREFORMATTED = frozenset("pre xmp listing textarea".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SECTIONS = frozenset("thead tbody tfoot".split())
#: Start tag -> (elements that it ends if open, elements that it doesn't look beyond).
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir", "table", "td", "th"}),
    "dt": ({"dt", "dd"}, {"dl", "table", "td", "th"}),
    "dd": ({"dt", "dd"}, {"dl", "table", "td", "th"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th", "caption"}, {"tr", "table"}),
    "th": ({"td", "th", "caption"}, {"tr", "table"}),
    "tr": ({"td", "th", "tr", "caption"}, {"table"}),
    "thead": ({"td", "th", "tr", "thead", "tbody", "tfoot", "caption"}, {"table"}),
    "tbody": ({"td", "th", "tr", "thead", "tbody", "tfoot", "caption"}, {"table"}),
    "tfoot": ({"td", "th", "tr", "thead", "tbody", "tfoot", "caption"}, {"table"}),
    "rt": ({"rt", "rp"}, {"ruby"}),
    "rp": ({"rt", "rp"}, {"ruby"}),
}
WALLS = frozenset("table td th caption button".split())
HEAD_ONLY = frozenset("title meta link base style script template noscript".split())

#: Elements below this depth become siblings, as in browsers.
DEPTH = 512

_TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPACE = re.compile(r"[ \t\n\f\r]+")


class Node:
    __slots__ = ("tag", "attributes", "children", "parent", "depth")

    def __init__(self, tag: str, attributes: dict[str, str], parent: Node | None):
        self.tag, self.attributes, self.children, self.parent = tag, attributes, [], parent
        self.depth = parent.depth + 1 if parent else 0


def attributes_of(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    if text:
        for m in _ATTRIBUTE.finditer(text):
            out.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return out


def parse(source: str) -> Node:
    """The tree below a root node; children are nodes and strings."""
    root = Node("#root", {}, None)
    now, at, head = root, 0, None

    def close(upto: Node) -> Node:
        return upto.parent or root

    def ended(node: Node, tags: set, walls) -> Node:
        """Where to go on after ending the nearest of tags, or node itself if a wall or the root comes first."""
        x = node
        last = None
        while x is not root and x.tag not in walls:
            if x.tag in tags:
                last = x
            x = x.parent
        return close(last) if last is not None else node

    def text(data: str, raw: bool = False) -> None:
        nonlocal now, head
        if not data:
            return
        data = data if raw else html.unescape(data)
        if now.tag in ("table", "tr") or now.tag in SECTIONS:
            if data.strip():
                table = now
                while table.tag != "table" and table is not root:
                    table = table.parent
                home = table.parent or root
                home.children.insert(home.children.index(table) if table in home.children else len(home.children), data)
            return
        if head is not None and now is head:
            if not data.strip():
                return
            now, head = close(head), None
        now.children.append(data)

    n = len(source)
    while at < n:
        m = _TOKEN.search(source, at)
        if m is None:
            text(source[at:])
            break
        text(source[at : m.start()])
        at = m.end() if m.end() > m.start() else m.start() + 1
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "p" and ended(now, {"p"}, WALLS) is now:
                now.children.append(Node("p", {}, now))
                continue
            if tag == "br":
                now.children.append(Node("br", {}, now))
                continue
            x = now
            walls = {"table"} if tag in ("td", "th", "tr") or tag in SECTIONS else () if tag in ("table", "body", "html") else WALLS
            while x is not root and x.tag != tag and not (tag in HEADINGS and x.tag in HEADINGS) and x.tag not in walls:
                x = x.parent
            if x is not root and (x.tag == tag or tag in HEADINGS and x.tag in HEADINGS):
                if x is head:
                    head = None
                now = close(x)
            continue
        if head is not None and now is head and tag not in HEAD_ONLY:
            now, head = close(head), None
        if tag in CLOSES_P or tag == "table":
            now = ended(now, {"p"}, WALLS)
        if tag in ENDS:
            now = ended(now, *ENDS[tag])
        if tag in HEADINGS and now.tag in HEADINGS:
            now = close(now)
        if tag == "tr" and now.tag == "table":
            now.children.append(Node("tbody", {}, now))
            now = now.children[-1]
        if tag in ("td", "th") and (now.tag == "table" or now.tag in SECTIONS):
            if now.tag == "table":
                now.children.append(Node("tbody", {}, now))
                now = now.children[-1]
            now.children.append(Node("tr", {}, now))
            now = now.children[-1]
        node = Node(tag, attributes_of(m[3]), now)
        now.children.append(node)
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(source, at)
            body = source[at : end.start() if end else n]
            at = end.end() if end else n
            if tag not in HIDDEN:
                node.children.append(html.unescape(body) if tag == "textarea" else body)
            elif tag == "title":
                node.children.append(html.unescape(body))
            continue
        if tag == "plaintext":
            node.children.append(source[at:])
            break
        if tag == "head":
            head = node
        if node.depth < DEPTH:
            now = node
    return root


_INVISIBLE_STYLE = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)|content-visibility\s*:\s*hidden)", re.I)


def visible(node: Node) -> bool:
    a = node.attributes
    if node.tag in HIDDEN or "hidden" in a and a["hidden"].lower() != "until-found":
        return False
    if node.tag == "input":
        return a.get("type", "").lower() in ("submit", "button", "reset") and bool(a.get("value"))
    if node.tag == "dialog" and "open" not in a:
        return False
    return not (a and _INVISIBLE_STYLE.search(a.get("style", "")))


class Flow:
    """Lines of one block context; `pad` goes before every line, `marker` before the next one only."""

    def __init__(self):
        self.lines: list[str] = []
        self.run: list[str] = []
        self.pad = ""
        self.marker = ""
        self.gap = False

    def words(self, data: str) -> None:
        self.run.append(data)

    def line(self, data: str) -> None:
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = False
        if self.marker:
            data, self.marker = self.pad[: len(self.pad) - len(self.marker)] + self.marker + data, ""
        else:
            data = self.pad + data
        self.lines.append(data.rstrip())

    def flush(self) -> None:
        if self.run:
            data = _SPACE.sub(" ", "".join(self.run)).strip(" ")
            self.run = []
            if data:
                self.line(data)

    def block(self, spaced: bool) -> None:
        self.flush()
        self.gap = self.gap or spaced


def grid_lines(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Rows of (lines, column span, row span) as text columns that line up.

    Columns that a cell above still reaches into are kept as ranges, and only columns where a cell begins or ends have
    a width, so the work follows the cells and not the spans.
    """
    placed: list[list[tuple[int, list[str]]]] = []
    wide: list[tuple[int, int, list[str]]] = []
    taken: list[tuple[int, int, int]] = []  # from, to, the row that is free again; by from
    width: dict[int, int] = {}
    for r, row in enumerate(rows):
        taken = [t for t in taken if t[2] > r]
        cells, fresh, c, i = [], [], 0, 0
        for lines, across, down in row:
            while i < len(taken) and taken[i][0] <= c:
                c = max(c, taken[i][1])
                i += 1
            cells.append((c, lines))
            if across > 1:
                wide.append((c, across, lines))
                width.setdefault(c, 0)
                width.setdefault(c + across - 1, 0)
            else:
                width[c] = max([width.get(c, 0), *map(len, lines)])
            if down > 1:
                fresh.append((c, c + across, min(r + down, len(rows))))
            c += across
        placed.append(cells)
        if fresh:
            fresh, taken = sorted(taken + fresh), []
            for t in fresh:
                if taken and taken[-1][2] == t[2] and taken[-1][1] >= t[0]:
                    taken[-1] = (taken[-1][0], max(taken[-1][1], t[1]), t[2])
                else:
                    taken.append(t)
    columns = sorted(width)
    sizes = [width[c] for c in columns]
    for c, across, lines in wide:
        a, b = bisect_left(columns, c), bisect_left(columns, c + across)
        need = max(map(len, lines), default=0) - sum(sizes[a:b]) - 2 * (across - 1)
        if need > 0:
            sizes[b - 1] += need
    start, at = {}, 0
    for c, size in zip(columns, sizes):
        start[c] = at
        at += size + 2 if size else 0
    out = []
    for cells in placed:
        for i in range(max((len(lines) for _, lines in cells), default=0)):
            s = ""
            for c, lines in cells:
                if i < len(lines) and lines[i]:
                    s = s.ljust(start[c]) + lines[i]
            out.append(s.rstrip())
    return out


def _span(node: Node, name: str, most: int) -> int:
    value = node.attributes.get(name, "").strip()
    return min(most, max(1, int(value))) if value.isascii() and value.isdigit() and len(value) < 9 else 1


def render(root: Node) -> str:
    """All visible text of a tree."""
    flows = [Flow()]
    tables: list[list[list[tuple[list[str], int, int]]]] = []
    lists: list[list] = []
    preformatted = 0
    todo: list[tuple] = [("in", root)]
    while todo:
        step, node = todo.pop()
        flow = flows[-1]
        if isinstance(node, str):
            if preformatted:
                parts = node.replace("\r\n", "\n").split("\n")
                for i, part in enumerate(parts):
                    if part:
                        flow.run.append(part.replace("\t", "    "))
                    if i < len(parts) - 1:
                        flow.line("".join(flow.run))
                        flow.run = []
            else:
                flow.words(node)
            continue
        tag = node.tag
        if step == "in":
            if not visible(node):
                continue
            if tag == "br":
                if flow.run and "".join(flow.run).strip():
                    flow.flush()
                elif flow.lines and flow.lines[-1]:
                    flow.lines.append("")
                continue
            if tag == "input":
                flow.words(node.attributes["value"])
                continue
            if tag in BLOCK:
                flow.block(tag in SPACED and not (tag in LISTS and lists) and not (tag == "table" and tables))
            if tag in LISTS:
                first = node.attributes.get("start", "1")
                lists.append([tag == "ol", int(first) if re.fullmatch(r"-?\d{1,8}", first) else 1])
            elif tag == "li":
                own = lists[-1] if lists else [False, 1]
                value = node.attributes.get("value", "")
                if own[0] and re.fullmatch(r"-?\d{1,8}", value):
                    own[1] = int(value)
                marker = f"{own[1]}. " if own[0] else "- "
                own[1] += 1
                todo.append((("pad", flow.pad), node))
                flow.pad += " " * len(marker)
                flow.marker = marker
            elif tag in ("dd", "blockquote"):
                todo.append((("pad", flow.pad), node))
                flow.pad += "  "
            elif tag in PREFORMATTED:
                preformatted += 1
            elif tag == "table":
                tables.append([])
            elif tag == "tr" and tables:
                tables[-1].append([])
            elif tag in ("td", "th") and tables:
                if not tables[-1]:
                    tables[-1].append([])
                flows.append(Flow())
                todo.append((("lists", lists, preformatted), node))
                lists, preformatted = [], 0
            elif tag == "q":
                flow.words("“")
            if not (tag == "li" or tag in ("dd", "blockquote") or tag in ("td", "th") and tables):
                todo.append(("out", node))
            todo.extend(("in", child) for child in reversed(node.children))
            continue
        if isinstance(step, tuple) and step[0] == "pad":
            flow.block(tag == "blockquote")
            flow.pad, flow.marker = step[1], ""
        elif isinstance(step, tuple):
            flow.flush()
            flows.pop()
            lists, preformatted = step[1], step[2]
            tables[-1][-1].append((flow.lines, _span(node, "colspan", 1000), _span(node, "rowspan", 65534)))
        elif tag in PREFORMATTED:
            preformatted -= 1
            if flow.run:
                flow.line("".join(flow.run))
                flow.run = []
            flow.block(tag in SPACED)
        elif tag == "table":
            rows = tables.pop()
            flow.flush()
            for line in grid_lines(rows):
                flow.line(line)
            flow.block(not tables)
        elif tag in LISTS:
            lists.pop()
            flow.block(not lists)
        elif tag == "q":
            flow.words("”")
        elif tag in BLOCK:
            flow.block(tag in SPACED)
    flows[0].flush()
    lines = flows[0].lines
    while lines and not lines[-1]:
        lines.pop()
    return "\n".join(lines)


def title_of(root: Node) -> str | None:
    todo = [root]
    while todo:
        node = todo.pop()
        if node.tag == "title":
            return _SPACE.sub(" ", "".join(x for x in node.children if isinstance(x, str))).strip(" ")
        todo.extend(x for x in reversed(node.children) if isinstance(x, Node))
    return None


def extract(pages: DataFrame, column: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns in keep, title and text of every page.

    Null html gives a null title and text, html without visible text an empty one. Any bytes parse: broken markup
    is text or is ignored, as the tree builder says. Repeated rows are each rendered; an empty table gives no rows;
    other columns are left out.
    """
    common.bound_batches(pages.sparkSession)
    source = pages.select(*keep, F.col(column).cast("string").alias("__html"))
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.select(*keep).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            titles, texts = [], []
            for cell in batch.column("__html"):
                page = cell.as_py()
                tree = parse(page) if page is not None else None
                titles.append(title_of(tree) if tree else None)
                texts.append(render(tree) if tree else None)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(titles, pa.string()), pa.array(texts, pa.string())], names=[*keep, "title", "text"])

    return source.mapInArrow(run, f"{head}, title string, text string")
