"""Text of web pages as they are laid out: a tree with implied tags, visibility rules, and a renderer.

All visible text is kept, menus and footers too. Blocks stand on lines of their own, with a blank line where a browser
leaves a margin; white space collapses outside ``pre``; list items have markers and indents; cells of a table stand in
columns (cells are padded up to ``PAD`` characters, longer ones stick out). Hidden: head, scripts, styles, templates,
closed dialogs, elements with ``hidden``, ``display:none`` or ``visibility:hidden`` in their style or by a rule of a
style sheet in the page whose selector is one tag, class or id. Of several declarations the cascade's winner counts; media
queries are answered for a screen of ``SCREEN`` pixels.

Edge cases: a null or empty page has the empty text; text without tags is one paragraph; broken or unclosed markup is
mended as the tree is built; equal pages give equal texts; pages of any length and nesting are rendered whole, without
recursion. Columns beside ``page_id`` and ``html`` are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

PAD = 40
SCREEN = {"width": 1280.0, "height": 800.0}

# Fixed values of the HTML language.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "xmp", "iframe", "noembed", "noframes", "noscript"}
RAW_TEXT = {"title", "textarea"}
HEAD_ONLY = {"base", "link", "meta", "title", "style", "script", "noscript", "template"}
HIDDEN = {"head", "script", "style", "template", "title", "noscript", "iframe", "noembed", "noframes", "datalist", "object",
          "audio", "video", "canvas", "svg", "rp"}
MARGIN = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "dl", "pre", "blockquote", "table", "figure", "hr", "menu",
          "xmp"}
PLAIN_BLOCK = {"html", "body", "div", "article", "section", "nav", "header", "footer", "main", "aside", "li", "dt", "dd",
               "address", "fieldset", "form", "legend", "figcaption", "details", "summary", "dialog", "center", "caption",
               "hgroup", "search", "option", "optgroup", "select"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
GROUPS = {"thead", "tbody", "tfoot"}
#: A start tag ends the open elements named here, up to the nearest of the tags behind the bar.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
        "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
        "td": ({"td", "th", "caption"}, {"table"}), "th": ({"td", "th", "caption"}, {"table"}),
        "tr": ({"tr", "caption"}, {"table"}), **{g: ({"tr", "caption", "colgroup", *GROUPS}, {"table"}) for g in GROUPS},
        **{h: (HEADINGS, {"td", "th", "table"}) for h in HEADINGS}, "body": ({"head"}, set())}
ENDS_PARAGRAPH = (MARGIN | PLAIN_BLOCK) - {"html", "body", "option", "optgroup", "select", "legend", "caption"}
SCOPE = {"td", "th", "table", "caption"}

TAG = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
BLANKS = re.compile(r"[ \t\n\r\f]+")
COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
STOP = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|[{};]", re.S)
MATTERS = re.compile(r"display|visibility", re.I)
DECLARED = re.compile(
    r"(?:^|(?<=;))\s*(?:(display)\s*:\s*(none|contents|block|flow(?:-root)?|flex|grid|list-item|ruby[\w-]*|table[\w-]*|inline[\w -]*|initial|inherit|unset|"
    r"revert[\w-]*)|(visibility)\s*:\s*(visible|hidden|collapse|initial|inherit|unset|revert[\w-]*))\s*(!\s*important)?\s*(?=;|\Z)", re.I)
SIMPLE = re.compile(r"[.#]?[\w-]+")
GROUPING = {"media", "supports", "layer", "container", "document"}
LENGTH_FEATURE = re.compile(r"(min-|max-)?(?:device-)?(width|height)\s*:\s*([\d.]+)\s*(px|r?em)?")
RANGE_FEATURE = re.compile(r"(?:([\d.]+)(px|r?em)?\s*(<=?)\s*)?(width|height)\s*(?:([<>]=?|=)\s*([\d.]+)(px|r?em)?)?")
SCREEN_HAS = {"color", "hover", "hover:hover", "any-hover:hover", "pointer:fine", "any-pointer:fine", "orientation:landscape", "grid:0", "scripting:enabled",
              "prefers-color-scheme:light", "prefers-reduced-motion:no-preference", "prefers-contrast:no-preference", "update:fast"}


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: str = "") -> None:
        self.tag, self.attributes, self.children = tag, attributes, []


class Tree:
    """Builds the tree of a page from its tags and texts."""

    def __init__(self) -> None:
        self.root = Node("html")
        self.path, self.open = [self.root], Counter(["html"])
        self.sheets: list[str] = []

    def push(self, tag: str, attributes: str = "") -> None:
        node = Node(tag, attributes)
        self.path[-1].children.append(node)
        self.path.append(node)
        self.open[tag] += 1

    def pop(self) -> None:
        self.open[self.path.pop().tag] -= 1

    def end(self, tags: set[str], within: set[str]) -> None:
        """End the open elements of ``tags`` above the nearest one of ``within``, and all inside them."""
        if not any(self.open[t] for t in tags):
            return
        cut = 0
        for i in range(len(self.path) - 1, 0, -1):
            if self.path[i].tag in tags:
                cut = i
            elif self.path[i].tag in within:
                break
        while cut and len(self.path) > cut:
            self.pop()

    def start_tag(self, tag: str, attributes: str) -> None:
        if tag == "html":
            self.root.attributes = self.root.attributes or attributes
            return
        if tag == "body" and self.open["body"] or tag == "head" and (self.open["head"] or self.open["body"]):
            return
        if self.open["head"] and tag not in HEAD_ONLY:
            self.end({"head"}, set())
        if self.open["p"] and tag in ENDS_PARAGRAPH:
            self.end({"p"}, SCOPE)
        if tag in ENDS:
            self.end(*ENDS[tag])
        if self.open["table"]:
            if tag in ("td", "th") and self.path[-1].tag != "tr":
                self.start_tag("tr", "")
            elif tag == "tr" and self.path[-1].tag == "table":
                self.push("tbody")
        if tag in VOID:
            self.path[-1].children.append(Node(tag, attributes))
        else:
            self.push(tag, attributes)

    def end_tag(self, tag: str) -> None:
        if tag in ("br", "p") and not self.open[tag]:
            self.start_tag(tag, "")
        if tag in ("html", "body") or not self.open[tag]:
            return
        for i in range(len(self.path) - 1, 0, -1):
            if self.path[i].tag == tag:
                while len(self.path) > i:
                    self.pop()
                return
            if self.path[i].tag in SCOPE and tag not in SCOPE | GROUPS | {"tr"}:
                return

    def text(self, text: str) -> None:
        if text:
            if self.open["head"] and not BLANKS.fullmatch(text):
                self.end({"head"}, set())
            text = unescape(text) if "&" in text else text
            if self.path[-1].tag == "pre" and not self.path[-1].children:
                text = re.sub(r"^\r?\n", "", text)
            self.path[-1].children.append(text)

    def read(self, html: str) -> Tree:
        at = 0
        while m := TAG.search(html, at):
            self.text(html[at : m.start()])
            at = m.end()
            if not m[2]:
                continue
            tag = m[2].lower()
            if m[1]:
                self.end_tag(tag)
            elif tag in RAW or tag in RAW_TEXT:
                stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(html, at)
                body = html[at : stop.start() if stop else len(html)]
                at = stop.end() if stop else len(html)
                if tag == "style" and on_screen(attributes(m[3]).get("media", "")):
                    self.sheets.append(body)
                self.start_tag(tag, m[3])
                if tag in RAW_TEXT or tag == "xmp":
                    self.path[-1].children.append(body if tag == "xmp" else unescape(body))
                self.end_tag(tag)
            else:
                self.start_tag(tag, m[3])
        self.text(html[at:])
        return self


def _feature(feature: str) -> bool:
    """Whether the screen has a media feature; unknown ones are false, as in browsers."""
    pixels = lambda n, unit: float(n) * (16 if unit in ("em", "rem") else 1)
    try:
        if m := LENGTH_FEATURE.fullmatch(feature):
            have, asked = SCREEN[m[2]], pixels(m[3], m[4])
            return have >= asked if m[1] == "min-" else have <= asked if m[1] else have == asked
        if m := RANGE_FEATURE.fullmatch(feature):
            compare = {"<": float.__lt__, "<=": float.__le__, ">": float.__gt__, ">=": float.__ge__, "=": float.__eq__, None: lambda *_: True}
            left = compare[m[3]](pixels(m[1], m[2]), SCREEN[m[4]]) if m[3] else True
            return left and (compare[m[5]](SCREEN[m[4]], pixels(m[6], m[7])) if m[5] else True)
    except ValueError:
        return False
    return re.sub(r"\s*:\s*", ":", feature) in SCREEN_HAS


def on_screen(queries: str) -> bool:
    """Whether a list of media queries applies to a screen; the empty list does."""
    for query in queries.lower().split(","):
        query = query.strip()
        turned = query.startswith("not ")
        query = re.sub(r"^(?:not|only)\s+", "", query)
        holds = True
        for any_of in re.split(r"\s+and\s+", query) if query else ():
            either = [x.strip() for x in re.split(r"\s+or\s+", any_of)]
            holds &= any(_feature(x[1:-1].strip()) if x.startswith("(") and x.endswith(")") else x in ("all", "screen") for x in either)
        if holds != turned:
            return True
    return False


def rules(sheet: str) -> Iterator[tuple[str, str]]:
    """Selectors and body of the rules of a style sheet that apply to a screen."""
    sheet = COMMENT.sub(" ", sheet)
    at, applies, body = 0, [True], None
    for m in STOP.finditer(sheet):
        if len(m[0]) > 1:  # a string
            continue
        if m[0] == "{":
            prelude, at = sheet[at : m.start()].strip(), m.end()
            name = re.match(r"@([\w-]+)", prelude)
            if name and name[1].lower() in GROUPING:
                kind, asked = name[1].lower(), prelude[name.end() :].strip()
                applies.append(applies[-1] and (on_screen(asked) if kind == "media" else not asked.lower().startswith("not")))
            else:
                body = (prelude, at) if applies[-1] and not name else None
                applies.append(False)  # nothing inside a rule is a rule of its own
        elif m[0] == "}":
            if body:
                yield body[0], sheet[body[1] : m.start()]
            body, at = None, m.end()
            if len(applies) > 1:
                applies.pop()
        elif not body:
            at = m.end()
    if body:
        yield body[0], sheet[body[1] :]


def declared(source: str, weight: int, order: int = 0) -> Iterator[tuple[str, tuple[bool, int, int, str]]]:
    """``display`` and ``visibility`` of a list of declarations, as (important, weight, order, value)."""
    for k, m in enumerate(DECLARED.finditer(source)):
        yield (m[1] or m[3]).lower(), (bool(m[5]), weight, order + k, (m[2] or m[4]).lower())


def styles(sheets: list[str]) -> dict[str, dict[str, tuple[bool, int, int, str]]]:
    """By simple selector, the winning declarations."""
    out: dict[str, dict] = {}
    order = 0
    for sheet in sheets:
        for selectors, body in rules(sheet) if MATTERS.search(sheet) else ():
            if MATTERS.search(body):
                order += len(body)
                for s in {s.strip() for s in selectors.split(",")}:
                    if SIMPLE.fullmatch(s):
                        own = out.setdefault(s if s[0] in ".#" else s.lower(), {})
                        for name, value in declared(body, 1 + ".#".find(s[0]) + 1, order):
                            own[name] = max(own.get(name, value), value)
    return out


def attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(source)}


class Lines:
    """Text laid out line by line."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.indent, self.marker = 0, ""
        self.space = self.margin = False

    def end_line(self) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip(" "))
            self.line = []
        self.space = False

    def block(self, margin: bool) -> None:
        self.end_line()
        self.margin = self.margin or margin

    def begin(self) -> None:
        if not self.line:
            if self.margin and self.lines:
                self.lines.append("")
            self.margin = False
            self.line.append(" " * max(0, self.indent - len(self.marker)) + self.marker)
            self.marker = ""

    def add(self, text: str, keep: bool) -> None:
        if keep:
            for i, part in enumerate(text.replace("\r\n", "\n").split("\n")):
                if i:
                    self.begin()
                    self.end_line()
                if part:
                    self.begin()
                    self.line.append(part)
            return
        text = BLANKS.sub(" ", text)
        if text[:1] == " ":
            self.space, text = True, text[1:]
        if not text:
            return
        trail = text[-1] == " "
        fresh = not self.line
        self.begin()
        if self.space and not fresh:
            self.line.append(" ")
        self.line.append(text[:-1] if trail else text)
        self.space = trail

    def done(self) -> list[str]:
        self.end_line()
        return self.lines


def aligned(rows: list[list[list[str]]]) -> list[str]:
    """Lines of a table's rows. A cell is a list of lines."""
    width = [0] * max(map(len, rows), default=0)
    for row in rows:
        for i, cell in enumerate(row):
            width[i] = max([width[i], *(min(PAD, len(x)) for x in cell)])
    out = []
    for row in rows:
        for k in range(max([1, *map(len, row)])):
            out.append(" | ".join((c[k] if k < len(c) else "").ljust(w) for c, w in zip(row, width)).rstrip(" "))
    return out


def render(html: str) -> str:
    """The visible text of a page as it is laid out."""
    tree = Tree().read(html)
    sheet = styles(tree.sheets)
    writers, tables, lists, keep = [Lines()], [], [], 0
    todo: list[tuple] = [(tree.root, True, False)]
    while todo:
        node, visible, leaving = todo.pop()
        out = writers[-1]
        if isinstance(node, str):
            if visible:
                out.add(node, keep > 0)
            continue
        tag = node.tag
        if not leaving:
            if tag in HIDDEN:
                continue
            given = attributes(node.attributes) if node.attributes.strip(" /") else {}
            if given or sheet:
                won: dict[str, tuple] = {}
                for key, value in declared(COMMENT.sub(" ", given["style"]), 4) if "style" in given else ():
                    won[key] = max(won.get(key, value), value)
                for name in {tag, "#" + given.get("id", "")} | {"." + c for c in given.get("class", "").split()} if sheet else ():
                    for key, value in sheet.get(name, {}).items():
                        won[key] = max(won.get(key, value), value)
                display = won["display"][3] if "display" in won else "none" if "hidden" in given else ""
                if display == "none":
                    continue
                if "visibility" in won and won["visibility"][3] in ("visible", "initial", "hidden", "collapse"):
                    visible = won["visibility"][3] in ("visible", "initial")
            if tag == "dialog" and "open" not in given or tag == "input":
                continue
            if tag == "br":
                out.begin()
                out.end_line()
                continue
            if tag in MARGIN or tag in PLAIN_BLOCK:
                out.block(tag in MARGIN and not (lists and tag in ("ul", "ol", "menu")))
            if tag in ("ul", "ol", "menu"):
                start = given.get("start", "1")
                lists.append(int(start) if tag == "ol" and re.fullmatch(r"-?\d{1,9}", start) else 1 if tag == "ol" else None)
                out.indent += 3 if tag == "ol" else 2
            elif tag == "li":
                if lists and lists[-1] is not None:
                    out.marker, lists[-1] = f"{lists[-1]}. ", lists[-1] + 1
                else:
                    out.marker = "- "
            elif tag in ("dd", "blockquote"):
                out.indent += 2
            elif tag in ("pre", "xmp"):
                keep += 1
            elif tag == "table":
                tables.append([])
            elif tag == "tr" and tables:
                tables[-1].append([])
            elif tag in ("td", "th") and tables and tables[-1]:
                writers.append(Lines())
            todo.append((node, visible, True))
            todo.extend((c, visible, False) for c in reversed(node.children))
            continue
        if tag in ("ul", "ol", "menu"):
            lists.pop()
            out.indent -= 3 if tag == "ol" else 2
        elif tag == "li":
            out.marker = ""
        elif tag in ("dd", "blockquote"):
            out.indent -= 2
        elif tag in ("pre", "xmp"):
            keep -= 1
        elif tag in ("td", "th") and tables and tables[-1]:
            tables[-1][-1].append(writers.pop().done())
        elif tag == "table":
            for line in aligned([r for r in tables.pop() if any(any(c) for c in r)]):
                out.begin()
                out.line.append(line)
                out.end_line()
        if tag in MARGIN or tag in PLAIN_BLOCK:
            out = writers[-1]
            out.block(tag in MARGIN and not (lists and tag in ("ul", "ol", "menu")))
    return "\n".join(writers[0].done()).strip("\n")


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, text) of ``pages(page_id, html)``, a row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = pa.array([render(h.as_py() or "") for h in part.column(1)], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), texts], ["page_id", "text"])

    return pages.select("page_id", "html").mapInArrow(run, "page_id long, text string")
