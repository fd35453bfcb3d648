"""Visible text of HTML pages, laid out: a tree builder with implied tags, visibility rules, and a renderer.

The builder turns markup into balanced open, text and close events; the renderer keeps a stack of boxes (the
page, table cells) and writes blocks with their spacing, list items with markers and indents, and tables with
aligned columns. Both are loops over one page, so neither depth nor length of a page is limited.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TAGS = (
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|</(?P<end>[a-zA-Z][^\s/>]*+)[^>]*+>?"
    r"|<(?P<start>[a-zA-Z][^\s/>]*+)(?P<attrs>%s)>|(?P<text>[^<]++|<)"
)
TAG = re.compile(_TAGS % r"(?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+", re.DOTALL)
#: After a quote that never ends, tags end at the next >.
PLAIN_TAG = re.compile(_TAGS % "[^>]*+", re.DOTALL)
ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
HIDING = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))", re.IGNORECASE)

# The sets of elements that the HTML standard and its suggested style sheet treat alike.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
NEVER = frozenset("head script style template title noscript iframe noembed noframes object canvas audio video datalist annotation annotation-xml mphantom".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl menu table figure fieldset hr".split())
BLOCKS = SPACED | frozenset(
    "address article aside body center dd details dialog dir div dt figcaption footer form header hgroup html legend li main nav optgroup option search section summary caption".split()
)
CLOSES_P = BLOCKS - frozenset("body html option optgroup legend caption".split())
#: An element that starts ends open ones of these names, unless one of the second names lies between.
IMPLIED = {
    "li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "option": ("option", "select"), "optgroup": ("option optgroup", "select"),
    "tr": ("tr td th caption colgroup", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"),
    "thead": ("thead tbody tfoot tr td th caption colgroup", "table"), "tbody": ("thead tbody tfoot tr td th caption colgroup", "table"),
    "tfoot": ("thead tbody tfoot tr td th caption colgroup", "table"), "body": ("head", ""),
}
IMPLIED |= dict.fromkeys("input select textarea".split(), ("select", ""))
IMPLIED = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in IMPLIED.items()}
#: What may come in a head; any other start tag, and text, ends an open one.
IN_HEAD = frozenset("html head base basefont bgsound link meta title style script noscript noframes template".split())
#: Parts of a drawing that are not drawn where they stand, and those that show text.
UNDRAWN = frozenset("defs symbol clippath mask pattern marker desc metadata".split())
LABELS = frozenset(["text", "foreignobject"])
#: Start tags that end an open drawing or formula, unless in one of its elements that hold HTML.
BREAKS_OUT = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split()
)
FOREIGN = frozenset(["svg", "math"])
HOLDS_HTML = frozenset("foreignobject desc title mi mo mn ms mtext annotation-xml".split())
CELLS = frozenset(["td", "th"])
SCOPE = frozenset("table td th caption button object template".split())
TABLE_TAGS = frozenset("table thead tbody tfoot tr td th caption".split())


def events(html: str) -> Iterator[tuple[str, str, str]]:
    """Balanced ("open", name, attributes), ("text", text, "") and ("close", name, "") events; missing tags are implied."""
    stack: list[str] = []
    open_: Counter[str] = Counter()

    def pop() -> tuple[str, str, str]:
        name = stack.pop()
        open_[name] -= 1
        return "close", name, ""

    def close(names: frozenset[str], stop: frozenset[str], furthest: bool) -> Iterator[tuple[str, str, str]]:
        if not any(open_[n] for n in names):
            return
        at = -1
        for i in range(len(stack) - 1, -1, -1):
            if stack[i] in names:
                at = i
                if not furthest:
                    break
            elif stack[i] in stop:
                break
        while 0 <= at < len(stack):
            yield pop()

    def start(name: str, attrs: str) -> Iterator[tuple[str, str, str]]:
        stack.append(name)
        open_[name] += 1
        yield "open", name, attrs

    def leave_head() -> Iterator[tuple[str, str, str]]:
        while stack and stack[-1] == "head":
            yield pop()

    at, tag, last = 0, TAG, html.rfind(">")
    while m := tag.match(html, at):
        if m["text"] == "<" and html[at + 1 : at + 2].isalpha():
            if last < at:  # no tag can end any more
                yield from leave_head()
                yield "text", unescape(html[at:]), ""
                break
            if tag is TAG:
                tag = PLAIN_TAG
                continue
        at = m.end()
        if m["text"] is not None:
            if not m["text"].isspace():
                yield from leave_head()
            yield "text", unescape(m["text"]) if "&" in m["text"] else m["text"], ""
        elif m["start"] is not None:
            name, attrs = m["start"].lower(), m["attrs"]
            if name in BREAKS_OUT and (open_["svg"] or open_["math"]) and not any(open_[n] for n in HOLDS_HTML):
                yield from close(FOREIGN, frozenset(), True)
            if name not in IN_HEAD:
                yield from leave_head()
            if name in CLOSES_P:
                yield from close(frozenset(["p"]), SCOPE, False)
            if name in IMPLIED:
                yield from close(*IMPLIED[name], True)
            if name in CELLS and open_["table"] and not open_["tr"]:
                yield from start("tr", "")
            yield from start(name, attrs)
            if name in VOID or (attrs.endswith("/") and name not in BLOCKS and (name not in RAW or open_["svg"])):
                yield pop()
            elif name in RAW:
                end = re.compile(rf"</{name}[\s/>]", re.IGNORECASE).search(html, at)
                first, at = at, end.start() if end else len(html)
                if name == "textarea":
                    yield "text", unescape(html[first:at]).replace("\r\n", "\n").removeprefix("\n"), ""
        elif m["end"] is not None:
            name = m["end"].lower()
            if name == "br":
                yield from leave_head()
                yield from start("br", "")
                yield pop()
            else:
                yield from close(frozenset([name]), frozenset() if name in TABLE_TAGS else SCOPE - {name}, False)
    while stack:
        yield pop()


def attributes(text: str) -> dict[str, str]:
    return {k.lower(): unescape(a or b or c or "") for k, a, b, c in ATTR.findall(text)}


def hidden(name: str, attrs: dict[str, str]) -> bool:
    return name in NEVER or "hidden" in attrs or (name == "dialog" and "open" not in attrs) or bool(HIDING.search(attrs.get("style", "")))


def shown(options: list[dict], all_: bool) -> list[str]:
    """What a closed-up list shows: the last selected option, else the first that can be chosen; a list box shows all."""
    if not all_:
        options = [o for o in options if o["selected"]][-1:] or [o for o in options if not o["disabled"]][:1]
    return [" ".join((o["label"] or o["text"]).split()) for o in options]


def width(text: str) -> int:
    """Columns of a fixed-width font."""
    return len(text) if text.isascii() else sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


@dataclass
class Box:
    lines: list[str] = field(default_factory=list)
    line: str = ""
    gap: int = 0
    indents: list[str] = field(default_factory=list)
    marker: str = ""

    def write(self, text: str, keep: bool) -> None:
        if keep:
            first, *rest = text.split("\n")
            self.line += first
            for part in rest:
                self.end_line(True)
                self.line = part
            return
        words = text.split()
        if not words:
            if text and self.line and not self.line[-1].isspace():
                self.line += " "
            return
        if text[0].isspace() and self.line and not self.line[-1].isspace():
            self.line += " "
        self.line += " ".join(words) + (" " if text[-1].isspace() else "")

    def end_line(self, forced: bool = False) -> None:
        text, self.line = self.line.rstrip(), ""
        if not text and not forced:
            return
        if self.lines and self.gap:
            self.lines += [""] * self.gap
        self.gap = 0
        indent = "".join(self.indents)
        if self.marker:
            indent, self.marker = indent[: len(indent) - len(self.marker)] + self.marker, ""
        self.lines.append((indent + text).rstrip())

    def block(self, gap: int) -> None:
        self.end_line()
        self.gap = max(self.gap, gap)


def aligned(rows: list[list[str]]) -> list[str]:
    """Cells padded to the width of their column; the last of a row is not."""
    widths: list[int] = []
    for row in rows:
        widths += [0] * (len(row) - len(widths))
        for i, cell in enumerate(row[:-1]):
            widths[i] = max(widths[i], width(cell))
    return ["  ".join([c + " " * (widths[i] - width(c)) for i, c in enumerate(row[:-1])] + row[-1:]).rstrip() for row in rows]


def visible_text(html: str) -> str:
    """The laid-out text of one page; '' for an empty one."""
    boxes, tables, lists = [Box()], [], []
    skipped: list[str] = []  # open elements from the outermost hidden one on
    pre = 0
    drawn: list[bool] = []  # open drawings and texts in them: whether text shows
    choice: dict | None = None  # an open select
    details: list[list[bool]] = []  # open ones: whether closed up, and whether in the summary
    for kind, name, attrs in events(html):
        box = boxes[-1]
        if skipped:
            if kind == "open":
                skipped.append(name)
            elif kind == "close":
                skipped.pop()
            continue
        if choice is not None:
            if kind == "text":
                if choice["open"]:
                    choice["options"][-1]["text"] += name
            elif kind == "open":
                known = attributes(attrs) if attrs else {}
                if hidden(name, known):
                    skipped.append(name)
                elif name == "optgroup":
                    choice["disabled"] = "disabled" in known
                    if choice["all"] and known.get("label"):
                        choice["options"].append({"selected": False, "disabled": True, "label": known["label"], "text": ""})
                elif name == "option":
                    choice["open"] = True
                    choice["options"].append({"selected": "selected" in known, "disabled": choice["disabled"] or "disabled" in known, "label": known.get("label", ""), "text": ""})
            elif name == "option":
                choice["open"] = False
            elif name == "optgroup":
                choice["disabled"] = False
            elif name == "select":
                for text in shown(choice["options"], choice["all"]):
                    box.write(f" {text} ", False)
                choice = None
        elif kind == "text":
            if drawn and not drawn[-1]:
                continue
            if not (details and details[-1] == [True, False]) and not (tables and tables[-1]["box"] is box and not name.strip()):
                box.write(name, pre > 0)
        elif kind == "open":
            known = attributes(attrs) if attrs else {}
            if hidden(name, known) or (details and details[-1] == [True, False] and name != "summary"):
                skipped.append(name)
                continue
            if drawn and (name in UNDRAWN or known.get("display") == "none" or known.get("visibility") in ("hidden", "collapse")):
                skipped.append(name)
            elif name == "svg" or (drawn and name in LABELS):
                drawn.append(name != "svg")
                box.write(" " * (name != "svg"), False)
            elif name == "textarea":
                box.write(" ", False)
                pre += 1
            elif name == "select":
                size = known.get("size", "1")
                choice = {"all": "multiple" in known or (size.isdecimal() and int(size) > 1), "options": [], "open": False, "disabled": False}
            elif name == "br":
                box.end_line(True)
            elif name == "hr":
                box.block(1)
            elif name in CELLS and tables and tables[-1]["box"] is box:
                boxes.append(Box())
                span = known.get("colspan", "1")
                tables[-1]["span"] = min(int(span), 1000) if span.isdecimal() else 1
            elif name == "tr" and tables and tables[-1]["box"] is box:
                tables[-1]["rows"].append([])
            elif name in BLOCKS:
                nested = name in ("ul", "ol", "menu") and lists
                box.block(1 if name in SPACED and not nested else 0)
                if name == "table":
                    tables.append({"rows": [], "box": box, "span": 1})
                elif name in ("ul", "ol", "menu"):
                    first = known.get("start", "1")
                    lists.append([name, int(first) if re.fullmatch(r"-?\d{1,9}", first) else 1])
                elif name == "li":
                    mark = "- "
                    if lists and lists[-1][0] == "ol":
                        mark = f"{lists[-1][1]}. "
                        lists[-1][1] += 1
                    box.indents.append(" " * len(mark))
                    box.marker = mark
                elif name in ("dd", "blockquote"):
                    box.indents.append("    ")
                elif name == "pre":
                    pre += 1
                elif name == "details":
                    details.append(["open" not in known, False])
                elif name == "summary" and details:
                    details[-1][1] = True
        elif name == "svg" or (drawn and name in LABELS):
            drawn.pop()
            box.write(" " * (name != "svg"), False)
        elif name == "textarea":
            pre -= 1
            box.write(" ", False)
        elif name in CELLS and len(boxes) > 1 and tables and tables[-1]["box"] is boxes[-2]:
            box.end_line()
            boxes.pop()
            table = tables[-1]
            if not table["rows"]:
                table["rows"].append([])
            table["rows"][-1] += [" ".join(x.strip() for x in box.lines if x.strip())] + [""] * (table["span"] - 1)
            table["span"] = 1
        elif name in BLOCKS:
            box.block(1 if name in SPACED and not (name in ("ul", "ol", "menu") and len(lists) > 1) else 0)
            if name == "table" and tables and tables[-1]["box"] is box:
                for text in aligned([r for r in tables.pop()["rows"] if any(r)]):
                    box.line = text
                    box.end_line()
                box.gap = max(box.gap, 1)
            elif name in ("ul", "ol", "menu") and lists:
                lists.pop()
            elif name in ("li", "dd", "blockquote") and box.indents:
                box.indents.pop()
                box.marker = ""
            elif name == "pre":
                pre -= 1
            elif name == "details" and details:
                details.pop()
            elif name == "summary" and details:
                details[-1][1] = False
    boxes[0].end_line()
    return "\n".join(boxes[0].lines)


def extract_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Each row with ``text``, the laid-out visible text of its page.

    A null page has null text, an empty one ''. Formulas give their text without annotations, drawings their text
    elements, a textarea its content, a select the option that it shows, or all in a list box. Broken markup is read as browsers do, as far as names of open
    elements tell. Equal pages have equal texts, repeated rows stay, and other columns are kept; one that is
    called ``text`` is replaced.
    """
    keep = [c for c in pages.columns if c != "text"]
    data = pages.select(F.struct(*[c for c in keep if c != html_col] or [F.lit(None).alias("none")]).alias("row"), F.col(html_col).alias("html"))
    row_type = data.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            html = b.column("html")
            text = pa.array([None if h is None else visible_text(h) for h in html.to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("row"), text], ["row", "text"])

    out = data.mapInArrow(run, f"row {row_type}, text string")
    return out.select(*[F.col(f"row.{c}") for c in keep if c != html_col], "text")
