"""Layout-aware text of HTML pages.

Method: a tree builder with implied tags (head and body, unclosed paragraphs,
list items, options, rows and cells, void elements, stray end tags) and a
renderer.  All visible text comes out: blocks start on lines of their own,
paragraph-like blocks are set off by a blank line, lists have bullets or numbers
and indents, table cells stand under each other, spans over columns and rows
included.  Styles count: what display makes a block, and what a flex or grid box
holds, stands in lines of its own, what it puts in a line does not; white-space
keeps blanks or line ends.  Invisible are head, script, style, template and similar elements,
hidden attributes, closed dialogs, what follows the summary of closed details,
definitions and descriptions of svg and math, and what inline styles or the page's
own style sheets set to display:none or, unless an element inside says
visibility:visible, to visibility:hidden.  Style rules count by specificity and
order; selectors are tags, classes and ids, also joined by descent.  Lists count
from ``start``, backwards if ``reversed``, and go on from an item's ``value``.

Map-only: pages are rendered one by one in the task that reads them.  The scanner
goes through a page once and never back, whatever is left unclosed.

Defined cases: null or empty html gives an empty text; malformed markup is
rendered as browsers would (an unclosed quote or comment takes the rest);
elements nested deeper than ``DEEP`` become siblings at that depth, as in
browsers, with all their text; columns are padded to at most ``PAD`` characters,
longer cells push their own row only, and beyond ``COLUMNS`` columns cells just
follow each other; other columns of the table pass through, one named like the
output is replaced.
"""

from __future__ import annotations

import html
import re
import sys
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_arrow

#: Depth at which browsers stop nesting (fixed value).
DEEP = 512
PAD, COLUMNS = 120, 1000
#: Spans of a table cell are at most these (fixed values of the HTML standard).
MOST_COLUMNS, MOST_ROWS = 1000, 65_534
# Fixed values of the HTML standard: names of elements by role.
VOID = set("area base br col embed hr img input link meta source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = set("head script style template title noembed noframes iframe datalist object audio video canvas rp".split())
# Hidden inside svg or math only; elements in which HTML goes on; HTML elements that end svg and math.
FOREIGN_UNSEEN = set("desc defs metadata symbol clippath mask marker pattern annotation annotation-xml".split())
INTEGRATION = set("foreignobject desc title mi mo mn ms mtext annotation-xml".split())
BREAKOUT = set("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
BUTTONS = {"submit", "button", "reset"}
SPACED = set("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure fieldset hr menu".split())
BLOCK = SPACED | set("html body div section article aside header footer nav main address form li dt dd tr caption figcaption details summary legend center option optgroup search hgroup dialog thead tbody tfoot plaintext listing xmp".split())
CLOSES_P = BLOCK - set("html body tr caption thead tbody tfoot option optgroup".split())
HEAD_ONLY = set("base link meta title style script template".split())
# An open element of the first kind is closed by a start tag of the second, up to the third.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
}
SCOPE = {"table", "td", "th", "caption", "button", "html", "template"}
TAG = re.compile(r"[a-zA-Z][^\s/>]*")
NAME = re.compile(r"[^\s/>][^\s/>=]*")
VALUE = re.compile(r"[^\s>]*")
NOTE_END = re.compile("--!?>")
SPACE = re.compile(r"\s*")
BETWEEN = re.compile(r"[\s/]*")
BLANK = re.compile(r"[ \t\n\r\f]+")
CSS_PART = re.compile(r"([^{};]*)([{};]|\Z)")
CSS_NOTE = re.compile(r"/\*(?:[^*]|\*(?!/))*+(?:\*/|\Z)")
SIMPLE = re.compile(r"(\*|[a-z][\w-]*)?((?:[.#][\w-]+)*)\Z", re.I)
DECLARED = re.compile(r"(?:^|;)\s*(display|visibility|white-space)\s*:\s*([a-z-]+(?:\s+[a-z-]+)?)\s*(!\s*important)?", re.I)
# Fixed values of CSS: what makes a box of its own lines or one within a line, and what keeps white space.
OWN_LINES = set("block flex grid table list-item flow-root table-row table-caption table-row-group table-header-group table-footer-group".split())
IN_LINE = set("inline inline-block inline-flex inline-grid inline-table contents ruby".split())
SPACE_KEPT = {"pre": "all", "pre-wrap": "all", "break-spaces": "all", "pre-line": "lines", "normal": "", "nowrap": ""}
KEEPS_SPACE = set("pre textarea listing xmp plaintext".split())


def attributes(page: str, at: int) -> tuple[dict[str, str], bool, int] | None:
    """Attributes from a place behind a tag's name, whether it closes itself, and
    the place behind it; nothing where the page ends inside."""
    found: dict[str, str] = {}
    while True:
        at, before = BETWEEN.match(page, at).end(), at
        if at >= len(page):
            return None
        if page[at] == ">":
            return found, page[at - 1] == "/" and at > before, at + 1
        m = NAME.match(page, at)
        name, at = m[0].lower(), m.end()
        value = ""
        behind = SPACE.match(page, at).end()
        if page.startswith("=", behind):
            at = SPACE.match(page, behind + 1).end()
            if page.startswith(('"', "'"), at):
                end = page.find(page[at], at + 1)
                if end < 0:
                    return None
                value, at = page[at + 1 : end], end + 1
            else:
                m = VALUE.match(page, at)
                value, at = m[0], m.end()
        found.setdefault(name, html.unescape(value) if "&" in value else value)


def tokens(page: str):
    """(kind, tag, attributes, closes itself, place behind) of each piece: kind is
    text (tag: the text), start or end.  The reader may send a new place to go on."""
    at, n = 0, len(page)
    while at < n:
        mark = page.find("<", at)
        while 0 <= mark < n - 1 and not (page[mark + 1] in "!?/" or page[mark + 1].isascii() and page[mark + 1].isalpha()):
            mark = page.find("<", mark + 1)
        if mark < 0 or mark == n - 1:
            yield "text", page[at:], None, False, n
            return
        if mark > at:
            yield "text", page[at:mark], None, False, mark
        at = mark
        if page.startswith("<!--", at):
            if page.startswith((">", "->"), at + 4):
                at = page.index(">", at) + 1
                continue
            m = NOTE_END.search(page, at + 4)
            at = m.end() if m else n
            continue
        end = page[at + 1] == "/"
        m = TAG.match(page, at + 1 + end)
        if not m:
            if end and at + 2 >= n:
                yield "text", page[at:], None, False, n
                return
            at = page.find(">", at) + 1 or n
            continue
        told = attributes(page, m.end())
        if not told:
            return
        own, closed, at = told
        went = yield "end" if end else "start", m[0].lower(), own, closed, at
        if went is not None:
            at = went


class Styles:
    """Rules of the page that set display, visibility or white space.

    A rule is found by a name (id, class or tag) of the element that it ends at
    and, if it has more parts, by one of the part before, which some ancestor must
    have.  Rules that end at ``*`` are found at the element in which their part
    before is met and are handed down from there.  Rules of the same parts are one,
    of which the last counts.
    """

    def __init__(self):
        self.alone: dict[str, list] = {}
        self.below: dict[str, dict[str, list]] = {}
        self.starred: dict[str, list] = {}
        self.known: dict[tuple, list] = {}
        self.n = 0

    def read(self, sheet: str) -> None:
        counts, prelude = [True], ""
        for m in CSS_PART.finditer(CSS_NOTE.sub(" ", sheet)):
            text, end = m[1], m[2]
            if end == "{":
                name = text.strip().lower()
                if name.startswith("@media"):
                    counts.append(counts[-1] and name[6:].strip() in ("", "all", "screen", "only screen", "screen, print", "all, screen"))
                elif name.startswith("@supports") or name.startswith("@layer"):
                    counts.append(counts[-1])
                elif name.startswith("@"):
                    counts.append(False)
                else:
                    counts.append(counts[-1])
                    prelude = text
                    body: list[str] = []
            elif prelude:
                body.append(text)
                if end != ";":
                    if counts[-1]:
                        self._add(prelude, ";".join(body))
                    prelude = ""
                    counts = counts[:-1] or [True]
            elif end == "}":
                counts = counts[:-1] or [True]

    def _add(self, selectors: str, body: str) -> None:
        said = [(p.lower(), v.lower(), bool(i)) for p, v, i in DECLARED.findall(body)]
        if not said:
            return
        for selector in selectors.split(","):
            chain, direct = [], False
            for word in selector.replace(">", " > ").split():
                if word == ">":
                    direct = True
                    continue
                m = SIMPLE.match(word)
                if not m or not word:
                    chain = []
                    break
                names = re.findall(r"[.#][\w-]+", m[2])
                chain.append((m[1].lower() if m[1] and m[1] != "*" else "", frozenset(x[1:] for x in names if x[0] == "."), tuple(x[1:] for x in names if x[0] == "#"), direct))
                direct = False
            if not chain:
                continue
            self.n += 1
            key = tuple(chain)
            if (rule := self.known.get(key)) is None:
                weight = (sum(len(i) for _, _, i, _ in chain), sum(len(c) for _, c, _, _ in chain), sum(bool(t) for t, _, _, _ in chain))
                rule = self.known[key] = [chain, weight, {}]
                last, before = _name(chain[-1]), _name(chain[-2]) if len(chain) > 1 else None
                if before is None:
                    self.alone.setdefault(last, []).append(rule)
                elif not last and before:
                    self.starred.setdefault(before, []).append(rule)
                else:
                    self.below.setdefault(last, {}).setdefault(before, []).append(rule)
            for p, v, important in said:
                rule[2][p] = max(rule[2].get(p, (False, -1, "")), (important, self.n, v))

    def _matches(self, node: Node, chain: list, i: int) -> bool:
        """Whether part i is the element and the others stand above it, the nearest
        that fits being taken for each."""
        if not _is(node, chain[i]):
            return False
        while i:
            direct = chain[i][3]
            i -= 1
            node = node.up
            while node and not _is(node, chain[i]):
                node = None if direct else node.up
            if not node:
                return False
        return True

    def _above(self, node: Node) -> tuple[frozenset, dict, dict]:
        """Names of an element and those above it, what rules that end at ``*`` say
        of all that it holds, and of its children; kept with the element."""
        todo = []
        while node and node.above is None:
            todo.append(node)
            node = node.up
        told = node.above if node else (frozenset(), {}, {})
        for x in reversed(todo):
            own = _names(x)
            held, kids = told[1], {}
            for name in own if self.starred else ():
                for chain, weight, said in self.starred.get(name, ()):
                    if self._matches(x, chain, len(chain) - 2):
                        if chain[-1][3]:
                            _best(kids, weight, said)
                        else:
                            held = dict(held) if held is told[1] else held
                            _best(held, weight, said)
            told = x.above = (told[0] | own if self.below else told[0], held, kids)
        return told

    def of(self, node: Node) -> dict[str, str]:
        """What is set of an element, where something sets it."""
        inline = node.attrs.get("style")
        if not inline and not self.known:
            return {}
        best: dict[str, tuple] = {}
        if self.known:
            above = self._above(node.up) if node.up and (self.below or self.starred) else (frozenset(), {}, {})
            for told in above[1:]:
                for p, x in told.items():
                    best[p] = max(best.get(p, ((),)), x)
            for key in ("", *_names(node)):
                rules = self.alone.get(key, ())
                if held := self.below.get(key):
                    few = [n for n in held if not n or n in above[0]] if len(held) <= len(above[0]) else [n for n in ("", *above[0]) if n in held]
                    rules = [*rules, *(r for n in few for r in held[n])]
                for chain, weight, said in rules:
                    if self._matches(node, chain, len(chain) - 1):
                        _best(best, weight, said)
        for n, (p, v, important) in enumerate(DECLARED.findall(inline or "")):
            p = p.lower()
            best[p] = max(best.get(p, ((),)), ((bool(important), True, (), n), v.lower()))
        return {p: x[1] for p, x in best.items()}


def _best(best: dict, weight: tuple, said: dict) -> None:
    for p, (important, n, v) in said.items():
        best[p] = max(best.get(p, ((),)), ((important, False, weight, n), v))


def _name(part: tuple) -> str:
    """The rarest kind of name that an element must have to be the part."""
    tag, classes, ids, _ = part
    return "#" + ids[0] if ids else "." + min(classes) if classes else tag


def _names(node: Node) -> frozenset[str]:
    a = node.attrs
    return frozenset((node.tag, *("." + c for c in a.get("class", "").split()), *(("#" + a["id"],) if "id" in a else ())))


def _is(node: Node, part: tuple) -> bool:
    tag, classes, ids, _ = part
    return (not tag or node.tag == tag) and (not classes or classes <= set(node.attrs.get("class", "").split())) and all(node.attrs.get("id") == x for x in ids)


class Node:
    __slots__ = ("above", "attrs", "kids", "tag", "up")

    def __init__(self, tag: str, attrs: dict[str, str], up: Node | None = None):
        self.tag, self.attrs, self.kids, self.up = tag, attrs, [], up
        self.above: tuple | None = None


def tree(page: str) -> tuple[Node, Styles]:
    """The document's root, and its style rules."""
    root = Node("html", {})
    stack, styles, has_body, has_foreign = [root], Styles(), False, False

    def top() -> Node:
        return stack[-1]

    def close(names: set[str], stop: set[str]) -> None:
        """Pops up to the outermost open element of these names above a stop."""
        cut = None
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in stop:
                break
            if stack[i].tag in names:
                cut = i
        if cut is not None:
            del stack[cut:]

    def start(tag: str, attrs: dict[str, str]) -> Node:
        node = Node(tag, attrs, top())
        top().kids.append(node)
        if tag not in VOID and len(stack) < DEEP:
            stack.append(node)
        return node

    def foreign() -> int:
        """The place of the open svg or math whose rules hold here, or 0."""
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in ("svg", "math"):
                return i
            if stack[i].tag in INTEGRATION:
                return 0
        return 0

    def body() -> None:
        nonlocal has_body
        if not has_body:
            del stack[1:]
            start("body", {})
            has_body = True

    def text(value: str) -> None:
        if value:
            if not has_body and len(stack) <= 2 and top().tag in ("html", "head") and value.strip():
                body()
            if top().tag not in ("html", "head", "table", "tr") or value.strip():
                top().kids.append(html.unescape(value) if "&" in value else value)

    reader = tokens(page)
    go_to = None
    while True:
        try:
            kind, tag, attrs, closed, at = reader.send(go_to)
        except StopIteration:
            break
        go_to = None
        if kind == "text":
            text(tag)
            continue
        if kind == "end":
            if tag == "p" and not any(n.tag == "p" for n in stack):
                body()
                start("p", {})
            if tag in ("html", "body"):
                continue
            if tag == "br":
                start("br", {})
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag or tag[0] == "h" and len(tag) == 2 and re.fullmatch("h[1-6]", stack[i].tag):
                    del stack[i:]
                    break
                if stack[i].tag in SCOPE and tag not in ("table", "tr", "tbody", "thead", "tfoot", "td", "th", "caption"):
                    break
            continue
        has_foreign = has_foreign or tag in ("svg", "math")
        if has_foreign and tag in BREAKOUT and (i := foreign()):
            del stack[i:]
        if tag == "html":
            root.attrs = {**attrs, **root.attrs}
            continue
        if tag == "body":
            if not has_body:
                body()
                top().attrs = attrs
            continue
        if tag == "head":
            if not has_body and len(stack) == 1:
                start("head", attrs)
            continue
        if not has_body and tag not in HEAD_ONLY:
            body()
        elif not has_body and len(stack) == 1:
            start("head", {})
        if tag in CLOSES_P:
            close({"p"}, SCOPE)
        if tag in IMPLIED:
            close(*IMPLIED[tag])
        if tag in ("td", "th") and top().tag in ("table", "thead", "tbody", "tfoot"):
            start("tr", {})
        inside = has_foreign and (foreign() or tag in ("svg", "math"))
        if inside and tag in FOREIGN_UNSEEN:
            attrs["hidden"] = ""
        node = start(tag, attrs)
        if inside and closed:
            if top() is node:
                stack.pop()
            continue
        if tag == "plaintext":  # all the rest is its text
            node.kids.append(page[at:])
            go_to = len(page)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            inner = page[at : end.start()] if end else page[at:]
            go_to = end.end() if end else len(page)
            if top() is node:
                stack.pop()
            if tag == "style":
                if attrs.get("media", "all").strip().lower() in ("", "all", "screen"):
                    styles.read(inner)
            else:
                node.kids.append(html.unescape(inner) if tag in ("textarea", "title") else inner)
    return root, styles


class Look:
    """How an element's own text is shown: whether it is visible, what display says
    (nothing: as its tag), which white space is kept."""

    __slots__ = ("display", "shown", "space")

    def __init__(self, shown: bool = True, space: str = "", display: str = ""):
        self.shown, self.space, self.display = shown, space, display


def displayed(node: Node, styles: Styles, held: Look) -> Look | None:
    """The look of an element, nothing if it takes no part; held: that of its parent."""
    a = node.attrs
    if node.tag in UNSEEN or node.tag == "dialog" and "open" not in a or node.tag == "input" and a.get("type", "").lower() not in BUTTONS:
        return None
    style = styles.of(node)
    display = style.get("display", "none" if "hidden" in a else "").partition(" ")[0]
    if display == "none":
        return None
    # what a flex or grid box holds stands in lines of its own
    if held.display in ("flex", "grid", "inline-flex", "inline-grid") and display not in OWN_LINES:
        display = "block"
    said, space = style.get("visibility"), style.get("white-space", "")
    shown = held.shown if said in (None, "inherit", "unset", "revert") else said not in ("hidden", "collapse")
    return Look(shown, SPACE_KEPT.get(space, "all" if node.tag in KEEPS_SPACE else held.space), display)


class Page:
    """Lines under construction: white space collapses, blank lines don't pile up."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.gap = False

    def put(self, text: str, space: str) -> None:
        """Text with white space collapsed, kept (``all``) or kept between lines (``lines``)."""
        if space == "lines" and "\n" in text:
            for i, line in enumerate(text.split("\n")):
                if i:
                    self.flush(True)
                self.put(line, "")
            return
        if space == "all":
            first, *rest = text.replace("\r\n", "\n").split("\n")
            if first:
                self.now.append(first)
            for line in rest:
                self.flush(True)
                if line:
                    self.now.append(line)
            return
        text = BLANK.sub(" ", text)
        if not self.now or self.now[-1][-1] == " ":
            text = text.lstrip(" ")
        if text:
            self.now.append(text)

    def line(self, text: str) -> None:
        """A line that is ready."""
        self.now = [text] if text else []
        self.flush(True)

    def flush(self, keep: bool = False) -> None:
        line = "".join(self.now).rstrip()
        self.now = []
        if line or keep:
            if self.gap and self.lines:
                self.lines.append("")
            self.gap = False
            self.lines.append(line)

    def space(self) -> None:
        self.flush()
        self.gap = True


class Renderer:
    """Lines of a page's tree under its style rules."""

    def __init__(self, styles: Styles):
        self.styles = styles

    def lines(self, node: Node, held: Look) -> list[str]:
        page = Page()
        for kid in node.kids:
            self.render(kid, page, 0, held)
        page.flush()
        return page.lines

    def _rows(self, node: Node, before: Page, held: Look) -> list[tuple[int, list]]:
        """(section, cells) of each row, a cell as (lines, columns, rows); text
        that stands in no cell goes before."""
        rows: list[tuple[int, list]] = []

        def gather(part: Node, section: int, held: Look) -> None:
            for kid in part.kids:
                if isinstance(kid, str):
                    if held.shown:
                        before.put(kid, "")
                    continue
                own = displayed(kid, self.styles, held)
                if own is None:
                    continue
                if kid.tag == "tr":
                    cells: list = []
                    for x in kid.kids:
                        if isinstance(x, str):
                            if own.shown:
                                before.put(x, "")
                        elif x.tag not in ("td", "th"):
                            self.render(x, before, 0, own)
                        elif (seen := displayed(x, self.styles, own)) is not None:
                            cells.append((self.lines(x, seen), _span(x, "colspan", 1, MOST_COLUMNS), _span(x, "rowspan", 0, MOST_ROWS)))
                    rows.append((section, cells))
                elif kid.tag in ("thead", "tbody", "tfoot"):
                    gather(kid, id(kid), own)
                else:
                    self.render(kid, before, 0, held)

        gather(node, 0, held)
        return rows

    def table(self, node: Node, held: Look) -> list[str]:
        """Rows with cells padded to their columns; captions and stray text first.

        Columns that cells above still take are kept as ranges, so a row costs
        as many steps as it has cells and ranges, however wide they are.
        """
        before = Page()
        rows = self._rows(node, before, held)
        before.flush()
        grid: list[list[tuple[int, int, list[str]]]] = []  # (column, columns, lines)
        down: list[tuple[int, int, int]] = []  # (column, behind it, rows left) that cells above still take, by column
        last = None
        for section, cells in rows:
            if section != last:
                down, last = [], section
            k, row, fresh, waits = 0, [], [], 0
            for lines, wide, high in cells:
                while waits < len(down) and down[waits][0] <= k:
                    hi = down[waits][1]
                    waits += 1
                    if hi > k:
                        row.append((k, hi - k, []))
                        k = hi
                row.append((k, wide, lines))
                if high != 1 and k < COLUMNS:
                    fresh.append((k, min(k + wide, COLUMNS), high - 1 if high else MOST_ROWS))
                k += wide
            for lo, hi, _ in down[waits:]:
                if hi > k:
                    k = max(lo, k)
                    row.append((k, hi - k, []))
                    k = hi
            left = sorted([(lo, hi, n - 1) for lo, hi, n in down if n > 1] + fresh)
            down = []
            for lo, hi, n in left:
                if down and down[-1][1:] == (lo, n):  # neighbours that end together are one
                    lo = down.pop()[0]
                down.append((lo, hi, n))
            grid.append(row)
        widths = [0] * min(COLUMNS, max((k + wide for row in grid for k, wide, _ in row), default=0))
        for row in grid:
            for k, wide, lines in row:
                if wide == 1 and k < COLUMNS:
                    widths[k] = max(widths[k], *(min(len(x), PAD) for x in lines), 0)
        upto = [0, *accumulate(widths)]
        out = before.lines
        for row in grid:
            for i in range(max((len(lines) for _, _, lines in row), default=0)):
                parts = []
                filled = max((j for j, (_, _, lines) in enumerate(row) if i < len(lines) and lines[i].strip()), default=-1)
                for k, wide, lines in row[: filled + 1]:
                    room = upto[min(k + wide, len(widths))] - upto[min(k, len(widths))] + 3 * (min(wide, COLUMNS) - 1)
                    parts.append((lines[i] if i < len(lines) else "").ljust(min(room, PAD * wide)))
                out.append(" | ".join(parts).rstrip())
        return out

    def render(self, node, page: Page, depth: int, held: Look) -> None:
        if isinstance(node, str):
            if held.shown:
                page.put(node, held.space)
            return
        look = displayed(node, self.styles, held)
        if look is None:
            return
        tag = node.tag
        if tag == "br":
            page.flush(True)
            return
        if tag == "table":
            page.space()
            for line in self.table(node, look):
                page.line(line)
            page.space()
            return
        if tag in ("ul", "ol", "menu"):
            self._list(node, page, depth, look)
            return
        if tag in ("img", "input"):
            if look.shown:
                page.put(node.attrs.get("alt" if tag == "img" else "value", ""), look.space)
            return
        if tag == "hr":
            page.space()
            return
        own = look.display in OWN_LINES or tag in BLOCK and look.display not in IN_LINE
        apart = page.space if tag in SPACED else page.flush
        if own:
            apart()
        if tag in ("td", "th", "text", "rt"):  # outside of a table; labels of an svg; readings
            page.put(" ", "")
        kids = node.kids
        if tag == "details" and "open" not in node.attrs:
            kids = [x for x in kids if isinstance(x, Node) and x.tag == "summary"][:1]
        for kid in kids:
            self.render(kid, page, depth, look)
        if own:
            apart()

    def _list(self, node: Node, page: Page, depth: int, held: Look) -> None:
        apart = page.flush if depth or held.display in IN_LINE else page.space
        apart()
        step = -1 if node.tag == "ol" and "reversed" in node.attrs else 1
        n = _whole(node.attrs.get("start"), sum(isinstance(x, Node) and x.tag == "li" for x in node.kids) if step < 0 else 1)
        for kid in node.kids:
            if not isinstance(kid, Node) or kid.tag != "li":
                self.render(kid, page, depth, held)
                continue
            look = displayed(kid, self.styles, held)
            if look is None:
                continue
            inner = Page()
            for x in kid.kids:
                self.render(x, inner, depth + 1, look)
            inner.flush()
            n = _whole(kid.attrs.get("value"), n)
            head = f"{n}. " if node.tag == "ol" else "- "
            n += step
            if not look.shown and not inner.lines:
                continue
            for i, line in enumerate(inner.lines or [""]):
                page.line((head if not i else " " * len(head) if line else "") + line)
        apart()


def _whole(value: str | None, other: int) -> int:
    return int(value) if value and re.fullmatch(r"\s*-?[0-9]{1,9}\s*", value) else other


def _span(cell: Node, name: str, least: int, most: int) -> int:
    value = cell.attrs.get(name, "").strip()
    return min(most, max(least, int(value[:9]))) if re.fullmatch("[0-9]+", value) else 1


def page_text(page: str | None) -> str:
    """The visible text of a page."""
    if not page:
        return ""
    if sys.getrecursionlimit() < 20 * DEEP:  # a few calls for each open element
        sys.setrecursionlimit(20 * DEEP)
    root, styles = tree(page.replace("\r\n", "\n").replace("\0", "\ufffd"))
    return "\n".join(Renderer(styles).lines(root, Look())).strip("\n")


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """``pages`` with ``text_col`` in place of the html."""
    names = [c for c in pages.columns if c not in (html_col, text_col)]

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array([page_text(x.as_py()) for x in b.column(html_col)], pa.string())], names=[*names, text_col])

    kinds = "".join(f"`{n}` {pages.schema[n].dataType.simpleString()}, " for n in names)
    return map_arrow(pages, run, f"{kinds}`{text_col}` string")
