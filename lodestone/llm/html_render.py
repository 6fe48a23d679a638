"""Visible text of HTML pages, laid out.

A tokenizer and a tree builder that closes implied tags (p before blocks, li, dt and dd, rows and cells, options),
supplies the tbody and tr that a table lacks, and puts text and elements that have no place in a table before it.

Visibility: elements that browsers do not show; `hidden`, closed dialogs and details; display and visibility from inline
styles and style elements by the cascade (!important, inline, specificity, order) of selectors made of tags, classes, ids
and attributes with descendant and child combinators. Rules that depend on a condition (other media than screens, supports,
container, nesting) and selectors with pseudo-classes or sibling combinators are passed over, so that text stays. Not
read: linked style sheets, text that only styles make invisible (colour, size, position).

The renderer collapses white space, keeps pre, starts blocks (also elements that styles make blocks) on new lines with a
blank line around paragraphs and the like, marks list items by bullets or numbers with indentation, and pads table cells
so that columns line up: by display width (wide characters count 2, combining ones 0), with colspan and rowspan. Columns
are padded to 200 places at most; the text of wider cells is whole.

Defined results: a null or empty page gives an empty text; broken markup never fails: unknown end tags are dropped and
what is open at the end is closed; pages of any length and nesting of any depth are walked without recursion (indentation
stops at 16 levels); rules that tie go by their order; repeated rows get equal results; empty tables give empty tables;
other columns of the input are not read, and the kept ones may have any name but that of the result and
__page.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import pieces, small_batches

# fixed values: sets of element names of the HTML standard
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes title textarea".split())
HIDDEN = frozenset("head script style template noscript iframe noembed noframes title datalist object video audio canvas area rp".split())
BLOCK = frozenset("html body address article aside blockquote center details dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol optgroup option p pre section summary table ul xmp caption tr".split())
SPACED = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 ol p pre table ul hr menu xmp fieldset".split())
CLOSES_P = BLOCK - {"html", "body", "option", "optgroup", "legend", "tr", "caption"}
#: a start tag of the first closes an open one of the second, up to the nearest of the third
IMPLIED = {
    "li": ("li", "ul ol menu"),
    "dt": ("dt dd", "dl"),
    "dd": ("dt dd", "dl"),
    "option": ("option", "select datalist"),
    "optgroup": ("option optgroup", "select datalist"),
    "tr": ("tr td th caption colgroup", "table"),
    "td": ("td th caption", "tr table"),
    "th": ("td th caption", "tr table"),
    "tbody": ("tbody thead tfoot tr td th caption colgroup", "table"),
    "thead": ("tbody thead tfoot tr td th caption colgroup", "table"),
    "tfoot": ("tbody thead tfoot tr td th caption colgroup", "table"),
    "body": ("head", "html"),
}
IMPLIED = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in IMPLIED.items()}
HEAD_ONLY = frozenset("base link meta title style script noscript template head".split())

TOKEN = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))|[^>])*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
EDGE = re.compile(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|[{};]", re.S)
COMPOUND = re.compile(r"(?:([a-zA-Z][\w-]*)|\*)?((?:[.#][\w-]+|\[[^\]]*\])*)")
CONDITION = re.compile(r"([.#])([\w-]+)|\[\s*([\w-]+)\s*(?:([~|^$*]?=)\s*(?:\"([^\"]*)\"|'([^']*)'|([^\]\s]*))\s*)?\]")
IN_TABLE = frozenset("table tbody thead tfoot tr".split())
TABLE_PARTS = frozenset("caption colgroup col tbody thead tfoot tr td th script style template form".split())
BLOCK_DISPLAYS = frozenset("block flex grid list-item table flow-root".split())
SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("attrs", "kids", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.kids = tag, attrs, []


def parse(page: str) -> tuple[Node, list[str]]:
    """The tree and the texts of its style elements."""
    root = Node("html", {})
    stack, styles, at = [root], [], 0
    open_: Counter = Counter()

    def push(node: Node) -> None:
        stack.append(node)
        open_[node.tag] += 1

    def cut_at(k: int) -> None:
        for node in stack[k:]:
            open_[node.tag] -= 1
        del stack[k:]

    def text(s: str) -> None:
        if s:
            if stack[-1].tag == "head" and s.strip():
                cut_at(len(stack) - 1)
            put(html.unescape(s), not s.strip())

    def put(kid: Node | str, fits: bool) -> None:
        """As the last child of what is open, or before the table that has no place for it."""
        if fits or stack[-1].tag not in IN_TABLE or not open_["table"]:
            stack[-1].kids.append(kid)
            return
        k = max(k for k, node in enumerate(stack) if node.tag == "table")
        kids = stack[k - 1].kids
        kids.insert(next((i for i in range(len(kids) - 1, -1, -1) if kids[i] is stack[k]), len(kids)), kid)

    def supply(tag: str) -> None:
        node = Node(tag, {})
        stack[-1].kids.append(node)
        push(node)

    def close(tags: frozenset, until: frozenset) -> None:
        """Close all open elements of the tags that are nearer than the nearest of until."""
        if not any(open_[t] for t in tags):
            return
        lowest = None
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in until:
                break
            if stack[k].tag in tags:
                lowest = k
        if lowest is not None:
            cut_at(lowest)

    while at < len(page):
        m = TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        if m[1]:
            tag = m[1].lower()
            if tag == "p" and not open_["p"]:
                stack[-1].kids.append(Node("p", {}))
            elif tag == "br":
                stack[-1].kids.append(Node("br", {}))
            elif open_[tag]:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        cut_at(k)
                        break
                    if stack[k].tag in ("td", "th", "table") and tag not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html", "div", "section", "article", "main"):
                        break
                    if stack[k].tag == "table" and tag != "table":
                        break
        elif m[2]:
            tag, rest = m[2].lower(), m[3] or ""
            if tag == "html":
                continue
            if stack[-1].tag == "head" and tag not in HEAD_ONLY:
                cut_at(len(stack) - 1)
            if tag == "body":
                continue
            attrs = {k.lower(): html.unescape(a or b or c) for k, a, b, c in ATTRIBUTE.findall(rest)} if rest.strip(" /\n\t") else {}
            if tag in IMPLIED:
                close(*IMPLIED[tag])
            if tag in CLOSES_P:
                close(frozenset(["p"]), frozenset(["td", "th", "table", "button", "object"]))
            if tag in ("td", "th", "tr") and stack[-1].tag == "table":
                supply("tbody")
            if tag in ("td", "th") and stack[-1].tag in ("tbody", "thead", "tfoot"):
                supply("tr")
            node = Node(tag, attrs)
            put(node, tag in TABLE_PARTS)
            if tag in RAW:
                end = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(page, at)
                body = page[at : end.start()] if end else page[at:]
                at = page.find(">", end.start()) + 1 or len(page) if end else len(page)
                if tag == "style" and _always(f"@media {SPACE.sub(' ', attrs.get('media', '')).strip().lower()}"):
                    styles.append(body)
                elif tag in ("textarea", "title"):
                    node.kids.append(html.unescape(body))
                elif tag == "xmp":
                    node.kids.append(body)
            elif tag not in VOID:
                push(node)
    return root, styles


def _declared(body: str) -> list[tuple[str, str, bool]]:
    """(property, value, important) of the declarations that bear on visibility."""
    out = []
    for part in body.split(";"):
        name, _, value = part.partition(":")
        name, (value, bang, _) = name.strip().lower(), value.lower().partition("!")
        if name in ("display", "visibility") and value.strip():
            out.append((name, value.strip(), bool(bang)))
    return out


def _always(prelude: str) -> bool:
    """Whether an at-rule's block holds for any screen: layers, and media lists that name all or screen without conditions."""
    name, _, rest = prelude.partition(" ")
    if name == "@layer":
        return True
    return name == "@media" and (not rest.strip() or any(x.strip() in ("all", "screen", "only all", "only screen") for x in rest.split(",")))


def rules(sheet: str) -> Iterator[tuple[str, str]]:
    """(selectors, declarations) of the rules that hold for any screen; blocks of other at-rules and nested rules are passed over."""
    sheet = re.sub(r"/\*.*?(?:\*/|\Z)", " ", sheet, flags=re.S)
    blocks: list[tuple[str, bool]] = []  # (prelude, whether rules in it count)
    at = 0
    for m in EDGE.finditer(sheet):
        edge = m[0]
        if len(edge) > 1 or (edge == ";" and blocks and blocks[-1][0][:1] != "@"):
            continue
        said, at = sheet[at : m.start()].strip(), m.end()
        if edge == "{":
            said = SPACE.sub(" ", said)
            fine = not blocks or (blocks[-1][1] and blocks[-1][0][:1] == "@")
            blocks.append((said, fine and (said[:1] != "@" or _always(said.lower()))))
        elif edge == "}" and blocks:
            prelude, fine = blocks.pop()
            if fine and prelude[:1] != "@":
                yield prelude, said


def _chain(selector: str) -> tuple[list[tuple], tuple[int, int, int]] | None:
    """([(combinator to the left, tag, conditions)], from the last compound to the first, and the specificity; None if there is more to it."""
    at, out, ids, others, tags, combinator = 0, [], 0, 0, 0, ""
    while at < len(selector):
        m = COMPOUND.match(selector, at)
        if not m[0]:
            return None
        found = list(CONDITION.finditer(m[2] or ""))
        if sum(len(x[0]) for x in found) != len(m[2] or ""):
            return None
        conditions = [(x[1] or "", x[2] or x[3], x[4] or "", x[5] or x[6] or x[7] or "") for x in found]
        out.append((combinator, (m[1] or "").lower(), conditions))
        ids += sum(k == "#" for k, *_ in conditions)
        others += sum(k != "#" for k, *_ in conditions)
        tags += bool(m[1])
        at = m.end()
        gap = re.compile(r"\s*(>?)\s*").match(selector, at)
        if at < len(selector) and not gap[0]:
            return None
        combinator, at = gap[1] or " ", gap.end()
    return (out[::-1], (ids, others, tags)) if out else None


def _fits(node: Node, tag: str, conditions: list[tuple]) -> bool:
    if tag and tag != node.tag:
        return False
    for kind, name, op, value in conditions:
        if kind == "#":
            fine = node.attrs.get("id") == name
        elif kind == ".":
            fine = name in node.attrs.get("class", "").split()
        else:
            have = node.attrs.get(name.lower())
            tests = {"": lambda h, v: True, "=": str.__eq__, "~=": lambda h, v: v in h.split(), "|=": lambda h, v: h == v or h.startswith(v + "-"), "^=": lambda h, v: v and h.startswith(v), "$=": lambda h, v: v and h.endswith(v), "*=": lambda h, v: v and v in h}
            fine = have is not None and bool(tests[op](have, value))
        if not fine:
            return False
    return True


def _matches(chain: list[tuple], node: Node, above: list[Node]) -> bool:
    """Whether the selector fits a node below the ancestors (outermost first)."""
    todo = [(0, node, len(above))]  # (compound, node to fit, number of its ancestors)
    while todo:
        k, node, n = todo.pop()
        if not _fits(node, *chain[k][1:]):
            continue
        if k + 1 == len(chain):
            return True
        reach = range(n) if chain[k][0] == " " else range(max(0, n - 1), n)
        todo += [(k + 1, above[i], i) for i in reach]
    return False


class Styles:
    """Rules by what their last compound names; the cascade picks one value for each property."""

    def __init__(self, texts: list[str]):
        self.rules: dict[str, list[tuple]] = {}
        order = 0
        for text in texts:
            for selectors, body in rules(text):
                if said := _declared(body):
                    for s in selectors.split(","):
                        if found := _chain(s.strip()):
                            chain, weight = found
                            _, tag, conditions = chain[0]
                            key = next((k + x for k, x, *_ in conditions if k), tag or "*")
                            self.rules.setdefault(key, []).append((chain, weight, order, said))
                            order += 1

    def of(self, node: Node, above: list[Node]) -> dict[str, str]:
        """Winning values by property."""
        best: dict[str, tuple] = {}

        def offer(said: list, inline: bool, weight: tuple, order: int) -> None:
            for name, value, important in said:
                rank = (important, inline, weight, order)
                if name not in best or rank >= best[name][0]:
                    best[name] = (rank, value)

        if self.rules:
            for key in {node.tag, "*", "#" + node.attrs.get("id", ""), *("." + c for c in node.attrs.get("class", "").split())}:
                for chain, weight, order, said in self.rules.get(key, ()):
                    if _matches(chain, node, above):
                        offer(said, False, weight, order)
        if "style" in node.attrs:
            offer(_declared(node.attrs["style"]), True, (0, 0, 0), 0)
        return {k: v for k, (_, v) in best.items()}


class Lines:
    """Text as lines; gap: blank lines that are due before the next one."""

    def __init__(self):
        self.lines: list[str] = []
        self.now, self.space, self.gap, self.marker, self.indent = [], False, 0, "", 0

    def word(self, s: str) -> None:
        """Collapsed text."""
        first, last = s[0] in " \t\n\r\f", s[-1] in " \t\n\r\f"
        s = SPACE.sub(" ", s).strip(" ")
        self.space |= first
        if s:
            if self.space and self.now:
                self.now.append(" ")
            self.now.append(s)
            self.space = False
        self.space |= last

    def exact(self, s: str) -> None:
        """Text whose line ends and spaces stay."""
        head, *more = s.replace("\r\n", "\n").split("\n")
        self.now.append(head)
        for x in more:
            self.end(True)
            self.now.append(x)

    def end(self, forced: bool = False) -> None:
        line = "".join(self.now)
        self.now, self.space = [], False
        if line.strip() or forced:
            if self.gap and self.lines:
                self.lines.append("")
            self.gap = 0
            lead = "  " * min(self.indent, 16)
            if self.marker:
                lead = lead[: max(0, len(lead) - 2)] + self.marker
                self.marker = ""
            self.lines.append((lead + line).rstrip() if line.strip() else "")

    def blank(self) -> None:
        self.end()
        self.gap = 1

    def add(self, lines: list[str]) -> None:
        self.end()
        for x in lines:
            self.now.append(x)
            self.end(True)

    def done(self) -> list[str]:
        self.end()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


def display_width(line: str) -> int:
    """Places on a screen: wide characters take two, combining ones none."""
    if line.isascii():
        return len(line)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in line)


def _number(value: str, least: int, most: int) -> int:
    """A span as the HTML standard reads it: digits, else 1, within its limits."""
    m = re.match(r"\s*(\d{1,9})", value)
    return min(max(int(m[1]), least), most) if m else 1


class Grid:
    """Cells at (row, column) with their spans and lines."""

    def __init__(self):
        self.cells: list[tuple[int, int, int, int, list[str]]] = []
        self.caption: list[str] = []
        self.row, self.column, self.group = -1, 0, 0
        #: column -> rows it is taken up to (not included) by cells above
        self.taken: dict[int, int] = {}

    def next_row(self) -> None:
        self.row, self.column = self.row + 1, 0

    def next_group(self) -> None:
        """Cells do not reach beyond their group of rows."""
        self.cells = [(r, c, min(h, self.row + 1 - r), w, lines) if r + h > self.row + 1 else (r, c, h, w, lines) for r, c, h, w, lines in self.cells]
        self.taken.clear()

    def add(self, lines: list[str], rows: int, columns: int) -> None:
        if self.row < 0:
            self.next_row()
        while self.taken.get(self.column, 0) > self.row:
            self.column += 1
        self.cells.append((self.row, self.column, rows, columns, lines))
        if rows > 1:
            for c in range(self.column, self.column + columns):
                self.taken[c] = self.row + rows
        self.column += columns

    def lines(self, most: int = 200) -> list[str]:
        self.next_group()
        width: dict[int, int] = {}
        height = [0] * (self.row + 1)
        for r, c, h, w, lines in self.cells:
            if w == 1:
                width[c] = max(width.get(c, 0), min(most, max(map(display_width, lines), default=0)))
            if h == 1:
                height[r] = max(height[r], len(lines))
        # spans widen their last column and lengthen their last row by what is missing
        for r, c, h, w, lines in sorted(self.cells, key=lambda x: (x[1] + x[3], x[0])):
            if w > 1 and (used := [k for k in range(c, c + w) if k in width] or [c]):
                need = min(most, max(map(display_width, lines), default=0)) - sum(width.get(k, 0) + 2 for k in used) + 2
                width[used[-1]] = width.get(used[-1], 0) + max(0, need)
        for r, c, h, w, lines in sorted(self.cells, key=lambda x: (x[0] + x[2], x[1])):
            if h > 1:
                height[r + h - 1] += max(0, len(lines) - sum(height[r : r + h]))
        top, start, at = [0], {}, 0
        for h in height:
            top.append(top[-1] + h)
        for k in sorted(width):
            start[k], at = at, at + width[k] + 2
        out: list[list[tuple[int, str]]] = [[] for _ in range(top[-1])]
        for r, c, _, _, lines in self.cells:
            for i, x in enumerate(lines):
                if x:
                    out[top[r] + i].append((start.get(c, at), x))
        done = []
        for parts in out:
            line, used = [], 0
            for begin, x in sorted(parts, key=lambda p: p[0]):
                gap = max(begin - used, 2 if line else 0)
                line.append(" " * gap + x)
                used += gap + display_width(x)
            done.append("".join(line).rstrip())
        return self.caption + done


def _marker(kind: str, k: int) -> str:
    """A list item's number in the style of its list."""
    if kind in ("a", "A") and k > 0:
        out = ""
        while k:
            k, r = divmod(k - 1, 26)
            out = chr(97 + r) + out
        return out if kind == "a" else out.upper()
    if kind in ("i", "I") and 0 < k < 4000:
        out = ""
        for n, x in zip((1000, 900, 500, 400, 100, 90, 50, 40, 10, 9, 5, 4, 1), ("m", "cm", "d", "cd", "c", "xc", "l", "xl", "x", "ix", "v", "iv", "i"), strict=True):
            out, k = out + x * (k // n), k % n
        return out if kind == "i" else out.upper()
    return str(k)


def render(page: str | None) -> str:
    """The visible text of a page."""
    if not page:
        return ""
    root, texts = parse(page)
    styles = Styles(texts)
    out = Lines()
    writers, grids, lists, pre = [out], [], [], 0
    above: list[Node] = []
    # (node, entering, visible, state)
    todo: list = [(root, True, True, None)]
    while todo:
        node, entering, visible, state = todo.pop()
        w = writers[-1]
        if isinstance(node, str):
            if visible and node and not (grids and state):
                w.exact(node) if pre else w.word(node)
            continue
        tag = node.tag
        if entering:
            if tag in HIDDEN or (tag == "input" and node.attrs.get("type", "").lower() == "hidden"):
                continue
            said = styles.of(node, above)
            display = said.get("display", "none" if "hidden" in node.attrs or (tag == "dialog" and "open" not in node.attrs) else "")
            if display == "none":
                continue
            if (seen := said.get("visibility")) in ("visible", "hidden", "collapse", "initial"):
                visible = seen in ("visible", "initial")
            if tag == "br":
                w.end(bool(w.now) or not w.gap)
                continue
            if tag == "wbr":
                continue
            if tag == "input":
                kind = node.attrs.get("type", "text").lower()
                if visible and kind in ("submit", "button", "reset", "text", "search", "email", "url", "tel", "number") and node.attrs.get("value"):
                    w.word(" " + node.attrs["value"] + " ")
                continue
            if tag in SPACED and not (tag in ("ul", "ol", "menu") and lists):
                w.blank()
            elif tag in BLOCK or display in BLOCK_DISPLAYS:
                w.end()
            made = None
            if tag in ("ul", "ol", "menu"):
                back = tag == "ol" and "reversed" in node.attrs
                start = node.attrs.get("start", str(sum(isinstance(k, Node) and k.tag == "li" for k in node.kids)) if back else "1")
                lists.append([node.attrs.get("type", "1") if tag == "ol" else "", int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1, -1 if back else 1])
                w.indent += 1
            elif tag == "li":
                if lists and re.fullmatch(r"-?\d{1,9}", node.attrs.get("value", "")):
                    lists[-1][1] = int(node.attrs["value"])
                kind, k, step = lists[-1] if lists else ("", 0, 0)
                w.marker = f"{_marker(kind, k)}. " if kind else "- "
                if lists:
                    lists[-1][1] += step
            elif tag in ("dd", "blockquote"):
                w.indent += 1
            elif tag in ("pre", "xmp", "textarea"):
                pre += 1
                if node.kids and isinstance(node.kids[0], str) and node.kids[0].startswith("\n"):
                    node.kids[0] = node.kids[0][1:]
            elif tag == "table":
                grids.append(Grid())
            elif tag == "tr" and grids:
                grids[-1].next_row()
            elif tag in ("tbody", "thead", "tfoot") and grids:
                grids[-1].next_group()
            elif tag in ("td", "th", "caption") and grids:
                made = (Lines(), lists, pre)
                writers.append(made[0])
                lists, pre = [], 0
            todo.append((node, False, visible, (made, display in BLOCK_DISPLAYS)))
            above.append(node)
            kids = node.kids
            if tag == "details" and "open" not in node.attrs:
                kids = next(([k] for k in kids if isinstance(k, Node) and k.tag == "summary"), [])
            loose = tag in ("table", "tbody", "thead", "tfoot", "tr")
            for k in reversed(kids):
                todo.append((k, True, visible, loose and isinstance(k, str) and not k.strip()))
            continue
        above.pop()
        made, as_block = state
        if tag in ("td", "th", "caption") and grids and made:
            cell, lists, pre = made
            writers.pop()
            if tag == "caption":
                grids[-1].caption += cell.done()
            else:
                rows = _number(node.attrs.get("rowspan", "1"), 0, 65534)
                grids[-1].add(cell.done(), rows or 65534, _number(node.attrs.get("colspan", "1"), 1, 1000))
            continue
        if tag == "table" and grids:
            w.end()
            w.add(grids.pop().lines())
        elif tag in ("ul", "ol", "menu"):
            w.end()
            lists.pop()
            w.indent -= 1
        elif tag == "li":
            w.end()
            w.marker = ""
        elif tag in ("dd", "blockquote"):
            w.end()
            w.indent -= 1
        elif tag in ("pre", "xmp", "textarea"):
            if w.now:
                w.end()
            pre -= 1
        if tag in SPACED and not (tag in ("ul", "ol", "menu") and lists):
            w.blank()
        elif tag in BLOCK or as_block:
            w.end()
    return "\n".join(out.done())


def extract(df: DataFrame, page: str = "html", keep: tuple[str, ...] = ("page_id",), out: str = "text") -> DataFrame:
    """The kept columns and the visible text of each page."""
    base = df.select(*[F.col(c) for c in keep], F.col(page).cast("string").alias("__page"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "__page", 8 << 20):
                texts = [render(x and x.decode("utf-8", "replace")) for x in part.column("__page").cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(texts, pa.string())], names=[*keep, out])

    fields = "".join(f"`{c}` {t}, " for c, t in base.dtypes if c != "__page")
    return small_batches(base).mapInArrow(run, f"{fields}`{out}` string")
