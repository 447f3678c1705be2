"""p1: markup taken out of notes, with headings, lists, code and formulas kept.

A note is read line by line into blocks, and the blocks into a tree of HTML containers, such as
articles, menus and footers, and of sections under headings. Paragraphs pass points for length and
commas to the containers around them, discounted by link density; the best container is kept with
those beside it that score well, and with what stands in no container, as that is the note's own.
"""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html.entities import html5

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.terms import sliced

FAMILIES = ("html", "latex", "markdown", "wiki")
#: Element names of HTML.
TAGS = set(
    """a abbr acronym address applet area article aside audio b base basefont bdi bdo big blink blockquote body br button canvas caption center cite code col
    colgroup data datalist dd del details dfn dialog dir div dl dt em embed fieldset figcaption figure font footer form frame frameset h1 h2 h3 h4 h5 h6 head header
    hgroup hr html i iframe img input ins kbd label legend li link main map mark marquee math menu meta meter nav nobr noframes noscript object ol optgroup option
    output p param picture pre progress q rb rp rt rtc ruby s samp script search section select slot small source span strike strong style sub summary sup svg
    table tbody td template textarea tfoot th thead time title tr track tt u ul var video wbr xmp""".split()
)
#: Elements that hold parts of a page.
CONTAINERS = set("article aside body center dialog div fieldset footer form header main menu nav search section".split())
CONTAINER = re.compile(rf"<\s*/?\s*(?:{'|'.join(sorted(CONTAINERS))})\b", re.IGNORECASE)
#: Marks in a line that is cut at containers: where one opens or closes, and where the label of a link begins and ends.
EDGE, LABEL = re.compile("\ue002(/?)([a-z]+[1-6]?)\ue003"), re.compile("\ue004([^\ue005]*)\ue005?")
#: Elements at which such a line is cut as well.
LINES = {"p", "li", "tr", "br", "dt", "dd", "h1", "h2", "h3", "h4", "h5", "h6"}
#: Characters for private use that mark places here, and what stands for them where a note has them itself.
OWN = str.maketrans({chr(0xE000 + k): chr(0x10FFF0 + k) for k in range(6)})
BACK = str.maketrans({chr(0x10FFF0 + k): chr(0xE000 + k) for k in range(6)})
#: LaTeX environments whose content is code, and commands whose arguments are no text.
VERBATIM = {"verbatim", "verbatim*", "lstlisting", "minted", "alltt", "Verbatim"}
NO_TEXT = {"label", "ref", "eqref", "cite", "citep", "citet", "pageref", "begin", "end", "bibliography", "bibliographystyle", "includegraphics", "input", "include", "usepackage", "documentclass", "vspace", "hspace", "index", "pagestyle", "footnotemark", "maketitle", "noindent", "centering", "autoref", "nocite"}
MATH = {"equation", "equation*", "align", "align*", "gather", "gather*", "multline", "multline*", "eqnarray", "eqnarray*", "displaymath", "math", "flalign", "alignat"}
SECTIONS = {"part": 1, "chapter": 1, "section": 2, "subsection": 3, "subsubsection": 4, "paragraph": 5, "subparagraph": 6}
#: LaTeX accent signs and the combining marks that they set.
ACCENTS = {"'": "́", "`": "̀", "^": "̂", '"': "̈", "~": "̃", "=": "̄", ".": "̇", "c": "̧", "v": "̌", "u": "̆", "H": "̋", "r": "̊", "k": "̨"}

SPECIAL = re.compile(r"[<&*_`~=|\[\]{}$\\#%>]|''|^\s*(?:[-+]|\d{1,9}[.)])(?:\s|$)|^\s*-{2,}\s*$|^\s*(?:-\s*){3,}$")
FENCE = re.compile(r"^((?:\s*>)*\s*(?:[-*+]\s+|\d{1,9}[.)]\s+)?)(`{3,}(?=[^`]*$)|~{3,})(.*)$")
TAG = re.compile(r"""<\s*(/?)\s*([A-Za-z][\w:-]*)((?:\s+[A-Za-z_:@][\w:.-]*(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'=<>`]+))?)*)\s*(/?)>""")
OPAQUE = re.compile(r"<\s*(pre|script|style|code|textarea|xmp|samp|kbd|tt)(?:\s[^<>]*)?>", re.IGNORECASE)
DOCTYPE = re.compile(r"<(?:!DOCTYPE|\?xml)\b[^<>]*>", re.IGNORECASE)
ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9A-Fa-f]{1,6}|([A-Za-z][A-Za-z0-9]{1,31}))(?:;|(?![A-Za-z0-9]))")
#: What opens and closes a span of inline markup, whatever its length; an end is the same sign as the start.
CODE = re.compile(r"(?<![`\\])`+"), re.compile(r"`+")
PATH = re.compile(r"(?<![A-Za-z])[A-Za-z]:\\[^\s]*|\\\\[\w.-]+\\[^\s]+")
INLINE_MATH = re.compile(r"(?<![\\$\w])\$(?=[^\s$\d]|\d[^$]*[\\^_=+])((?:[^$\\]|\\.)*?[^\s$\\]|[^\s$\\])\$(?![\d$])|\\\((.+?)\\\)")
VERB = re.compile(r"\\verb\*?([^\sA-Za-z*])(.*?)\1")
COMMAND = re.compile(r"(?<!\\)\\([A-Za-z]+)(\*?)((?:\[[^\[\]\n]*\])*)((?:\{[^{}\n]*\})*)")
OPEN_COMMAND = re.compile(r"(?<!\\)\\([A-Za-z]+)\*?(?=[^A-Za-z]|$)")
SWITCH = re.compile(r"\{\\(bf|it|em|sc|tt|rm|sf|sl|bfseries|itshape|small|large|Large|tiny)\b\s*([^{}\n]*)\}")
ACCENT = re.compile(r"""\\(['`^"~=.])\s*(?:\{\\?([A-Za-z])\}|\\?([A-Za-z]))|\\([cvuHrk])\{([A-Za-z])\}""")
LATEX_SIGN = re.compile(r"\\([%&,;:!/@ ])|(?<=\s)\\\\(?=\s*(?:\[|$))|\\\\\s*$")
ESCAPE = re.compile(r"\\([*_#+\-.!~`>|{}<()\[\]$'\"^\\=?])")
TEMPLATE = re.compile(r"\{\{\{([^{}]*)\}\}\}|\{\{([^{}]*)\}\}")
WIKI_LINK = re.compile(r"(!?)\[\[([^\[\]\n]+)\]\]")
APOSTROPHES = re.compile(r"(?<!')(?:'{5}|'{2,3})(?=[^\s'])"), re.compile(r"(?<=[^\s'])(?:'{5}|'{2,3})(?!')")
IMAGE = re.compile(r"!\[([^\[\]]*)\](?:\((?:<[^<>]*>|[^()\s]*(?:\([^()]*\)[^()\s]*)*)(?:\s+(?:\"[^\"]*\"|'[^']*'))?\)|\[[^\[\]]*\])")
LINK = re.compile(r"\[([^\[\]\n]*)\](?:\(\s*(?:<[^<>]*>|[^()\s]*(?:\([^()]*\)[^()\s]*)*)(?:\s+(?:\"[^\"]*\"|'[^']*'|\([^()]*\)))?\s*\)|\[[^\[\]\n]*\])")
FOOTNOTE = re.compile(r"\[\^[^\[\]\s]+\]:?|\^\[[^\[\]]+\]")
AUTOLINK = re.compile(r"<((?:https?|ftp|mailto):[^\s<>]+|[\w.+-]+@[\w-]+\.[\w.-]+)>")
DEFINITION = re.compile(r"^\s{0,3}\[[^\[\]\n]+\]:\s*\S+")
STARS = re.compile(r"(?<![A-Za-z0-9*\\])\*{1,3}(?=[^\s*])"), re.compile(r"(?<=[^\s*\\])\*{1,3}(?!\*)")
UNDERS = re.compile(r"(?<![^\W_]|_|\\)_{1,3}(?=[^\s_])"), re.compile(r"(?<=[^\s_\\])_{1,3}(?![^\W_]|_)")
MARKS = re.compile(r"(?<![\w~])~~(?=[^\s~])|(?<![A-Za-z0-9=])==(?=[^\s=])"), re.compile(r"(?<=[^\s~])~~(?!~)|(?<=[^\s=])==(?![=A-Za-z0-9])")
HEADING = re.compile(r"^\s{0,3}(#{1,6})(?:\s+(.*?))?(?:\s+#+)?\s*$")
WIKI_HEADING = re.compile(r"^\s*(={1,6})(?!=)\s*(\S.*?)\s*(?<!=)\1\s*$")
LIST = re.compile(r"^(\s*)([-*+]|\d{1,9}[.)])\s+(?:(\[[ xX/>!?-]\])\s+)?(.*)$")
BARE_LIST = re.compile(r"^\s*(?:[-*+]|\d{1,9}[.)])\s*$")
QUOTE = re.compile(r"^\s{0,3}((?:>\s?)+)(\[![\w-]+\][+-]?)?(.*)$")
RULE = re.compile(r"^\s{0,3}(?:(?:\*\s*){3,}|(?:-\s*){3,}|(?:_\s*){3,})$")
UNDERLINE = re.compile(r"^\s{0,3}(?:=+|-+)\s*$")
TABLE_RULE = re.compile(r"^\s*\|?\s*:?-+:?\s*(?:\|\s*:?-+:?\s*)*\|?\s*$")


def spans(line: str, signs: tuple[re.Pattern[str], re.Pattern[str]], put: Callable[[str], str]) -> str:
    """The line with what stands between each start and the next end of the same sign put otherwise, in one scan."""
    ends: dict[str, list[int]] = {}
    for m in signs[1].finditer(line):
        ends.setdefault(m.group(), []).append(m.start())
    out, at = [], 0
    for m in signs[0].finditer(line):
        own = ends.get(m.group(), [])
        k = bisect_right(own, m.end())
        if m.start() >= at and k < len(own):
            out += [line[at : m.start()], put(line[m.end() : own[k]])]
            at = own[k] + len(m.group())
    return "".join(out) + line[at:]


def stretches(line: str, signs: tuple[tuple[str, str], ...], least: int, put: Callable[[str], str]) -> str:
    """The line with each stretch from a start to its next end, signs and all, put otherwise, in one scan.

    At least ``least`` characters stand between. A start without end leaves none to later ones.
    """
    out, at = [], 0
    nexts = {s: line.find(s[0]) for s in signs}
    while nexts := {s: a if a >= at else line.find(s[0], at) for s, a in nexts.items() if a >= 0}:
        sign, a = min(nexts.items(), key=lambda x: x[1] if x[1] >= 0 else len(line))
        if a < 0:
            break
        end = line.find(sign[1], a + len(sign[0]) + least)
        if end < 0:
            del nexts[sign]
            continue
        out += [line[at:a], put(line[a : end + len(sign[1])])]
        at = end + len(sign[1])
    return "".join(out) + line[at:]


@dataclass
class Block:
    """One line of a note: what it is, its plain text, and what markup stood on it."""

    row: int
    kind: str = "paragraph"
    level: int = 0
    text: str = ""
    linked: int = 0
    families: set[str] = field(default_factory=set)
    parts: list[Block | str] | None = None  # what stands between containers on this line, and ``name`` or ``/name`` of them


class Reader:
    """Reads the lines of one note, with the state that goes over lines."""

    def __init__(self) -> None:
        self.until: re.Pattern[str] | None = None
        self.inside = ""  # fence, pre, comment, math, verbatim, template, hidden
        self.table = 0
        self.cut = False  # whether the line has containers
        self.environments: list[str] = []
        self.blocks: list[Block] = []

    def read(self, text: str) -> list[Block]:
        for row, line in enumerate(text.split("\n")):
            block = Block(row)
            self.line(line.rstrip("\r"), block)
            self.blocks.append(block)
        return self.blocks

    def line(self, line: str, b: Block) -> None:
        if self.inside:
            line = self.within(line, b)
            if line is None:
                return
        elif not SPECIAL.search(line):
            b.text = line.strip()
            b.kind = "paragraph" if b.text else "blank"
            if self.environments and self.environments[-1] in MATH and b.text:
                b.kind = "formula"
            if self.table and b.text:
                b.kind = "table"
                b.families.add("wiki")
            return
        if self.table or line.lstrip().startswith("{|"):
            self.wiki_table(line, b)
            return
        if m := FENCE.match(line):
            mark = re.escape(m.group(2)[0])
            self.inside, self.until = "fence", re.compile(rf"^[\s>]*{mark}{{{len(m.group(2))},}}\s*$")
            b.kind, b.text = "fence", "```" + m.group(3).strip(" `~")
            b.families.add("markdown")
            return
        self.block(line, b)

    def within(self, line: str, b: Block) -> str | None:
        """A line that begins inside a block of code, comment or formula; what of it comes after."""
        m = self.until.search(line)
        kind = self.inside
        family = {"fence": "markdown", "pre": "html", "comment": "html", "math": "latex", "verbatim": "latex", "template": "wiki", "hidden": "markdown"}[kind]
        b.kind = {"fence": "code", "pre": "code", "verbatim": "code", "math": "formula"}.get(kind, "blank")
        before = line[: m.start()] if m else line
        if kind in ("fence", "pre", "verbatim"):
            b.text = before
        elif kind == "math":
            b.text = line if m is None else line[: m.end()]
            if re.search(r"[\\^_&{}]", before):
                b.families.add("latex")
        elif kind == "template" and re.match(r"\s*\|", before):
            b.families.add("wiki")
        if m is None:
            return None
        b.families.add(family)
        self.inside, self.until = "", None
        if kind == "fence":
            b.kind, b.text = "fence", "```"
            return None
        rest = line[m.end() :]
        if not rest.strip():
            if kind in ("pre", "verbatim"):
                b.kind, b.text = ("code" if before.strip() else "fence"), before or "```"
            return None
        return rest

    def wiki_table(self, line: str, b: Block) -> None:
        b.families.add("wiki")
        bare = line.strip()
        self.table += bare.startswith("{|")
        end = bare.startswith("|}")
        self.table -= end
        b.kind = "table"
        if end or bare.startswith(("{|", "|-")):
            b.kind = "blank"
            return
        cells = re.split(r"\|\||!!", bare.lstrip("|!+ "))
        plain = [self.inline(c.split("|")[-1], Block(b.row)).strip() for c in cells]
        b.text = " | ".join(c for c in plain if c)

    def open(self, kind: str, until: str) -> None:
        self.inside, self.until = kind, re.compile(until, re.IGNORECASE)

    def block(self, line: str, b: Block) -> None:
        """A line outside code: its block markup, then what is inline."""
        seen = b.families
        before = self.blocks[-1] if self.blocks else None
        if m := HEADING.match(line):
            seen.add("markdown")
            b.kind, b.level = "heading", len(m.group(1))
            line = m.group(2) or ""
        elif m := WIKI_HEADING.match(line):
            seen.add("wiki")
            b.kind, b.level = "heading", len(m.group(1))
            line = m.group(2)
        elif UNDERLINE.match(line) and before and before.kind == "paragraph" and before.text:
            seen.add("markdown")
            before.kind, before.level = "heading", 1 if "=" in line else 2
            b.kind = "blank"
            return
        elif RULE.match(line) or TABLE_RULE.match(line) and "|" in line:
            seen.add("markdown")
            b.kind = "blank"
            return
        elif re.fullmatch(r"\s*(?:={2,}|-{2,})\s*", line):
            seen.add("markdown" if "-" in line else "wiki")
            b.kind = "blank"
            return
        elif re.match(r"\s*\|.*\|\s*$", line):
            seen.add("markdown")
            b.kind = "table"
            line = " | ".join(c.strip() for c in line.strip().strip("|").split("|"))
        else:
            if m := QUOTE.match(line):
                seen.add("markdown")
                b.kind = "quote"
                line = m.group(3)
                if (m2 := HEADING.match(line)) and m2.group(2):
                    line = m2.group(2)
            if m := LIST.match(line):
                seen.add("markdown")
                b.kind, b.level = "list", len(m.group(1)) // 2
                line = m.group(4)
            elif BARE_LIST.match(line):
                seen.add("markdown")
                line = ""
            elif DEFINITION.match(line) and not line.lstrip().startswith("[^"):
                seen.add("markdown")
                b.kind = "blank"
                return
        self.cut = CONTAINER.search(line) is not None
        text = self.inline(line, b)
        if self.cut:
            text, self.cut = self.between(text, b), False
        if b.kind == "list":
            text = "  " * b.level + "- " + text.strip()
        if b.kind == "heading":
            text = "#" * b.level + " " + text.strip()
        if b.kind == "paragraph" and not text.strip():
            b.kind = "blank"
        if self.environments and self.environments[-1] in MATH and text.strip():
            b.kind = "formula"
        b.text = text.strip() if b.kind not in ("code", "list") else text.rstrip()

    def between(self, text: str, b: Block) -> str:
        """The text of a line without the marks of containers and labels; its parts go to the block."""
        parts: list[Block | str] = []
        kind, level, at = b.kind, b.level, 0
        for m in [*EDGE.finditer(text), None]:
            own = text[at : m.start() if m else len(text)]
            plain = LABEL.sub(r"\1", own).replace("\ue005", "").strip()
            if plain:
                lead = "#" * level + " " if kind == "heading" else "- " if kind == "list" else ""
                parts.append(Block(b.row, kind, level, lead + plain, sum(len(x) - x.count(" ") for x in LABEL.findall(own))))
            if m:
                name, at = m.group(2), m.end()
                if name in CONTAINERS:
                    parts.append(m.group(1) + name)
                kind, level = "paragraph", 0
                if not m.group(1) and name[0] == "h" and name[1:].isdigit():
                    kind, level = "heading", int(name[1])
                elif not m.group(1) and name == "li":
                    kind = "list"
        b.parts = parts
        b.kind = "paragraph" if b.kind in ("heading", "list") else b.kind
        b.linked += sum(p.linked for p in parts if isinstance(p, Block))
        return " ".join(p.text for p in parts if isinstance(p, Block))

    def inline(self, line: str, b: Block) -> str:
        """The line without inline markup; formulas and code stay as they are."""
        seen, kept = b.families, []
        foreign = re.search("[\ue000-\ue005]", line) is not None
        line = line.translate(OWN) if foreign else line

        def keep(text: str) -> str:
            kept.append(text)
            return f"\ue000{len(kept) - 1}\ue001"

        def note(family: str, text: str, link: bool = False) -> str:
            seen.add(family)
            if link and self.cut:
                return f"\ue004{text}\ue005"
            if link:
                b.linked += len(text) - text.count(" ")
            return text

        if "`" in line:
            line = spans(line, CODE, lambda t: keep(note("markdown", t.strip() or t)))
        if "\\" in line:
            line = PATH.sub(lambda m: keep(m.group()), line)
            line = VERB.sub(lambda m: keep(note("latex", m.group(2))), line)
        if "](<" in line:
            line = re.sub(r"(?<=\]\()<[^<>\n]*>", lambda m: keep(m.group()), line)
        if "<" in line or "&" in line:
            line = self.tags(line, b, keep, note)
        if "$" in line or "\\" in line:
            line = self.latex(line, b, keep, note)
        if "{{" in line or "}}" in line:
            while True:
                new = TEMPLATE.sub(lambda m: note("wiki", (m.group(1) or m.group(2) or "").rstrip("|").rpartition("|")[2].rpartition("=")[2]), line)
                if new == line:
                    break
                line = new
            at = line.find("{{")
            if at >= 0 and not self.inside:
                note("wiki", "")
                self.open("template", r"\}\}+")
                line = line[:at]
        if "[" in line:
            while True:
                new = WIKI_LINK.sub(lambda m: note("wiki", m.group(2).rpartition("|")[2].removeprefix("Category:").strip("/."), True), line)
                if new == line:
                    break
                line = new
            line = FOOTNOTE.sub(lambda m: note("markdown", ""), line)
            line = IMAGE.sub(lambda m: note("markdown", m.group(1), True), line)
            line = LINK.sub(lambda m: note("markdown", m.group(1), True) if m.group(1).strip() else m.group(), line)
        if "''" in line:
            while (new := spans(line, APOSTROPHES, lambda t: note("wiki", t))) != line:
                line = new
        if "\\" in line:
            line = ESCAPE.sub(lambda m: keep(note("markdown", m.group(1))), line)
            if line.endswith("\\") and len(line) > 1:
                line = note("markdown", line[:-1])
        if "%%" in line:
            line = stretches(line, (("%%", "%%"),), 0, lambda t: note("markdown", ""))
            at = line.find("%%")
            if at >= 0 and not self.inside:
                note("markdown", "")
                self.open("hidden", "%%")
                line = line[:at]
        if "~~" in line or "==" in line:
            line = spans(line, MARKS, lambda t: note("markdown", t))
        if "*" in line or "_" in line:
            while True:
                new = spans(spans(line, STARS, lambda t: note("markdown", t)), UNDERS, lambda t: note("markdown", t))
                if new == line:
                    break
                line = new

        def put_back(text: str, upto: int) -> str:
            """What was kept, in its place; a text holds only such as were kept before it."""
            return re.sub("\ue000(\\d{1,9})\ue001", lambda m: put_back(kept[k], k) if (k := int(m.group(1))) < upto else m.group(), text)

        line = put_back(line, len(kept)) if kept else line
        return line.translate(BACK) if foreign else line

    def tags(self, line: str, b: Block, keep: Callable[[str], str], note: Callable[..., str]) -> str:
        line = re.sub(r"<!--.*?-->", lambda m: note("html", ""), line)
        at = line.find("<!--")
        if at >= 0:
            note("html", "")
            self.open("comment", "-->")
            line = line[:at]
        line = DOCTYPE.sub(lambda m: note("html", ""), line)
        line = AUTOLINK.sub(lambda m: note("markdown", m.group(1), True), line)
        out, at, unclosed = [], 0, set()
        while m := OPAQUE.search(line, at):
            note("html", "")
            name = m.group(1).lower()
            close = None if name in unclosed else re.compile(rf"<\s*/\s*{name}\s*>", re.IGNORECASE).search(line, m.end())
            out.append(line[at : m.start()])
            at = m.end()
            if close:
                inner, at = line[m.end() : close.start()], close.end()
                out.append("" if name in ("script", "style") else keep(TAG.sub("", inner) if name == "pre" else inner))
                if name == "pre":
                    b.kind = "code"
            elif name in ("code", "samp", "kbd", "tt"):
                unclosed.add(name)
            else:
                rest, at = re.sub(r"<\s*code[^<>]*>", "", line[m.end() :]), len(line)
                out.append(keep(rest) if name in ("pre", "xmp", "textarea") else "")
                if name in ("pre", "xmp"):
                    b.kind = "code" if rest.strip() else "fence"
                    if not rest.strip():
                        out.append(keep("```"))
                self.open("pre" if name in ("pre", "xmp", "textarea") else "comment", rf"(?:<\s*/\s*code\s*>)?\s*<\s*/\s*{name}\s*>")
        line = "".join(out) + line[at:]

        def tag(m: re.Match[str]) -> str:
            name = m.group(2).lower()
            if name not in TAGS and ":" not in name and "-" not in name:
                return m.group()
            note("html", "")
            if self.cut and (name in CONTAINERS or name in LINES):
                return f"\ue002{m.group(1)}{name}\ue003"
            if name[0] == "h" and name[1:].isdigit() and not m.group(1):
                b.kind, b.level = "heading", int(name[1])
            elif name == "li" and b.kind == "paragraph":
                b.kind = "list"
            elif name in ("td", "th") and not m.group(1) and m.start():
                return " "
            elif self.cut and name == "a":
                return "\ue005" if m.group(1) else "\ue004"
            elif name == "a" and not m.group(1):
                end = line.find("<", m.end())
                b.linked += max(0, end - m.end())
            return "\n" if name in ("br", "p", "div", "li", "tr") and m.start() and m.group(1) == "" else ""

        line = re.sub(r"\s*\n\s*", " ", TAG.sub(tag, line))

        def entity(m: re.Match[str]) -> str:
            if m.group(1) and m.group(1) + m.group()[1 + len(m.group(1)) :] not in html5:
                return m.group()
            return keep(note("html", html.unescape(m.group())))

        return ENTITY.sub(entity, line)

    def latex(self, line: str, b: Block, keep: Callable[[str], str], note: Callable[..., str]) -> str:
        def formula(m: re.Match[str]) -> str:
            return keep(note("latex", m.group()))

        line = stretches(line, (("$$", "$$"), ("\\[", "\\]")), 1, lambda t: keep(note("latex", t)))
        for start, end in (("$$", r"\$\$"), ("\\[", r"\\\]")):
            at = line.find(start)
            if at >= 0 and not self.inside and (start == "$$" or not line[at + 2 :].strip() or not line[:at].strip()) and (start == "$$" or "\\]" not in line):
                note("latex", "")
                self.open("math", end)
                b.kind = "formula"
                line = line[:at] + keep(line[at:])
                break
        line = INLINE_MATH.sub(formula, line)
        if "\\" not in line:
            return line
        for m in re.finditer(r"\\(begin|end)\s*\{([^{}]*)\}", line):
            note("latex", "")
            if m.group(1) == "begin":
                if m.group(2) in VERBATIM:
                    self.open("verbatim", rf"\\end\s*\{{{re.escape(m.group(2))}\}}")
                    b.kind = "fence"
                    return keep("```")
                self.environments.append(m.group(2))
            elif m.group(2) in self.environments:
                while self.environments.pop() != m.group(2):
                    pass
        if self.environments and self.environments[-1] in MATH and COMMAND.search(line) and "\\begin" not in line and "\\end" not in line:
            b.kind = "formula"
            return keep(note("latex", line))
        line = ACCENT.sub(lambda m: note("latex", unicodedata.normalize("NFC", (m.group(2) or m.group(3) or m.group(5)) + ACCENTS[m.group(1) or m.group(4)])), line)
        while True:
            new = SWITCH.sub(lambda m: note("latex", m.group(2)), line)
            new = COMMAND.sub(lambda m: self.command(m, b, note), new)
            if new == line:
                break
            line = new
        line = LATEX_SIGN.sub(lambda m: note("latex", (" " if m.group(1) in ",;:! /@" else m.group(1)) if m.group(1) else ""), line)
        return line

    def command(self, m: re.Match[str], b: Block, note: Callable[..., str]) -> str:
        name, arguments = m.group(1), re.findall(r"\{([^{}\n]*)\}", m.group(4))
        before = m.string[m.start() - 1] if m.start() else " "
        if before.isalnum() and before.isascii() and not m.group(4) and not m.group(3):
            return m.group()
        if not arguments and m.string[m.end() : m.end() + 1] == "{" and "}" in m.string[m.end() :]:
            return m.group()  # an argument with something nested; it is taken when that is done
        note("latex", "")
        if name in SECTIONS:
            b.kind, b.level = "heading", SECTIONS[name]
        elif name == "item":
            b.kind = "list"
        if name in NO_TEXT or not arguments:
            return ""
        return arguments[-1] if name != "frac" else "/".join(arguments)


def families(blocks: list[Block]) -> list[tuple[int, str]]:
    """``(row_no, family)`` of the markup that stood on each line."""
    return [(b.row, f) for b in blocks for f in sorted(b.families)]


@dataclass
class Node:
    """A part of the tree: the note, a container (level -1), or a heading with what stands under it."""

    level: int
    name: str = ""
    outer: Node | None = None  # what it stands in
    children: list[Node | list[Block]] = field(default_factory=list)
    score: float = 0.0
    size: int = 0
    linked: int = 0
    stray: bool = False  # a tag that is never closed holds nothing

    @property
    def container(self) -> bool:
        return self.level <= 0 and not self.stray

    @property
    def around(self) -> Node:
        """The container that its parts stand in."""
        node = self
        while not node.container and node.outer is not None:
            node = node.outer
        return node


def tree(blocks: list[Block]) -> Node:
    """Blocks under their headings and in their containers, runs of lines of one kind together.

    A closing tag ends the innermost container of its name; one without a beginning does nothing, and
    a beginning without an end is no container.
    """
    root = Node(0)
    path, run = [root], None
    for whole in blocks:
        for b in whole.parts if whole.parts is not None else [whole]:
            if isinstance(b, str):
                run = None
                if not b.startswith("/"):
                    node = Node(-1, b, path[-1])
                    path[-1].children.append(node)
                    path.append(node)
                elif (k := next((k for k in range(len(path) - 1, 0, -1) if path[k].name == b[1:]), 0)) > 0:
                    for node in path[k + 1 :]:
                        node.stray = True
                    del path[k:]
            elif b.kind == "heading":
                while path[-1].level >= max(1, b.level):
                    path.pop()
                section = Node(max(1, b.level), "", path[-1], [[b]])
                path[-1].children.append(section)
                path.append(section)
                run = None
            elif b.kind == "blank":
                run = None
            else:
                group = "code" if b.kind in ("code", "fence") else b.kind
                if run is None or run[0] != group:
                    run = (group, [])
                    path[-1].children.append(run[1])
                run[1].append(b)
    for node in path[1:]:
        node.stray = True
    return root


def link_density(lines: list[Block]) -> float:
    """The share of a part's characters, blanks aside, that are labels of links."""
    size = sum(len(b.text) - b.text.count(" ") for b in lines)
    return min(1.0, sum(b.linked for b in lines) / size) if size else 0.0


def points(lines: list[Block]) -> float:
    """A paragraph's points: one, one for each comma, one for each hundred characters up to three,
    all times the share of its text that is no link."""
    text = " ".join(b.text for b in lines)
    density = link_density(lines)
    return (1 + len(re.findall("[,，、]", text)) + min(3, len(text) // 100)) * (1 - density)


def score(root: Node) -> Node:
    """Sets the scores of the containers and gives the best, the outermost of equal ones.

    A part passes its points to the container around it, half of them to the next one out, and a
    sixth, a ninth and so on to those further out. A container's sum counts by the share of its text
    that is no label of a link. Headings are no containers of their own.
    """
    found, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.container:
            found.append(node)
        for c in node.children:
            if isinstance(c, Node):
                continue
            own, size, linked = points(c), sum(len(b.text) - b.text.count(" ") for b in c), sum(b.linked for b in c)
            outer, k = node.around, 0
            while outer is not None:
                outer.score += own if k == 0 else own / 2 if k == 1 else own / (3 * k)
                outer.size += size
                outer.linked += linked
                outer, k = outer.outer and outer.outer.around, k + 1
        todo += [c for c in reversed(node.children) if isinstance(c, Node)]
    for node in found:
        node.score *= 1 - min(1.0, node.linked / node.size) if node.size else 0
    return max(found, key=lambda n: n.score)  # the first of equal ones, so the outermost


#: The share of the best container's score that one beside it needs, and the characters that make it prose if few are labels.
BESIDE, PROSE = 0.2, 80


def kept(root: Node) -> list[Block]:
    """The best container whole, those beside it that score a fifth of it or are prose with at most a
    quarter of labels, and what stands in no container at all.

    Of these, blocks of mere links go: parts other than headings and lists with over four fifths of
    labels and under a fiftieth of the best score, so code, formulas and tables aren't lost for
    scoring low; and inner containers that are mostly labels and score under a fifth.
    """
    best = score(root)
    top, out = best.score, []
    towards, at = set(), best
    while at is not None:
        towards.add(id(at))
        at = at.outer and at.outer.around
    todo: list[tuple[Node | list[Block], bool]] = [(root, False)]
    while todo:
        node, inside = todo.pop()
        if not isinstance(node, Node):
            if node[0].kind in ("heading", "list") or points(node) >= top / 50 or link_density(node) <= 0.8:
                out.extend(node)
        elif not node.container or id(node) in towards or node.score >= BESIDE * top or 4 * node.linked <= node.size >= PROSE or inside and 2 * node.linked <= node.size:
            todo += [(c, inside or node is best) for c in reversed(node.children)]
    return out


def clean(text: str) -> tuple[str, list[tuple[int, str]]]:
    """The clean text of a note, and the markup families of its lines."""
    blocks = Reader().read(text)
    lines, last = [], None
    for b in kept(tree(blocks)):
        if last is not None and (b.row > last.row + 1 or b.kind == "heading" or last.kind == "heading"):
            lines.append("")
        if b.text or b.kind == "code":
            lines.append(b.text)
        last = b
    return "\n".join(lines).strip("\n"), families(blocks)


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, "content"):
        out = [clean(t) for t in batch.column("content").to_pylist()]
        marks = [[{"row_no": r, "family": f} for r, f in m] for _, m in out]
        yield pa.RecordBatch.from_arrays(
            [batch.column("note_id"), pa.array([t for t, _ in out], pa.string()), pa.array(marks, pa.list_(pa.struct([("row_no", pa.int32()), ("family", pa.string())])))],
            ["note_id", "clean", "marks"],
        )


def cleaned(notes: DataFrame) -> DataFrame:
    """``(note_id, clean, marks)``: each row's clean content and the markup of its lines.

    ``marks`` is an array of ``(row_no, family)``. Headings come out as ``#`` lines, list items as
    ``-`` lines, code between fences, formulas as they stand; rows without content are left out, a
    content of markup alone gives an empty text. One row per row of the table: nothing is shuffled.
    """
    return notes.select("note_id", "content").where("content is not null").mapInArrow(_run, "note_id bigint, clean string, marks array<struct<row_no: int, family: string>>")


def found(notes: DataFrame) -> DataFrame:
    """p1_found: the markup families of each line of each note."""
    marks = cleaned(notes).select("note_id", F.explode("marks").alias("m"))
    return marks.select("note_id", "m.row_no", "m.family").distinct()


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines sorted by note and row: one reader for each note, kept from batch to batch.

    The last line waits for the next, which may make it a heading, so memory holds one slice and
    that line with its repeated rows, however long a note is.
    """
    reader, place, line, rows = Reader(), None, None, []

    def cleaned_rows(part: list[tuple[int | None, int | None, bool, Block]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [
                pa.array([n for n, _, _, _ in part], pa.int64()), pa.array([r for _, r, _, _ in part], pa.int32()),
                pa.array([b.text if there else None for _, _, there, b in part], pa.string()), pa.array([b.kind if there else None for _, _, there, b in part], pa.string()),
            ],
            ["note_id", "row_no", "clean", "kind"],
        )

    for batch in sliced(batches, "text"):
        for n, r, t in zip(*(batch.column(c).to_pylist() for c in ("note_id", "row_no", "text")), strict=True):
            if n is None or r is None:
                rows.append((n, r, t is not None, Reader().read((t or "").replace("\n", " "))[0]))
                continue
            if place is None or place[0] != n:
                reader = Reader()
            if place != (n, r) or line != t:
                block = Block(r)
                reader.line((t or "").replace("\n", " ").rstrip("\r"), block)
                reader.blocks = [block]
            place, line = (n, r), t
            rows.append((n, r, t is not None, reader.blocks[-1]))
        last = reader.blocks[-1] if reader.blocks else None
        done = len(rows)
        while done and rows[done - 1][3] is last:
            done -= 1
        yield cleaned_rows(rows[:done])
        rows = rows[done:]
    yield cleaned_rows(rows)


def cleaned_lines(lines: DataFrame) -> DataFrame:
    """``(note_id, row_no, clean, kind)``: each line of the lines' table, read in its note's order.

    So lines inside code, comments, formulas and tables are known as such, as in ``cleaned``. Null
    lines count as blank ones and stay null. One row per row of the table: a repeated row of a line
    comes out as the line does, another text under the same number is read after it. A line without
    note or number is read on its own. The lines are shuffled by note and sorted, as a line may be
    out of place; a note is read as a stream, so its length has no limit.
    """
    own = lines.select("note_id", "row_no", "text").repartition("note_id").sortWithinPartitions("note_id", "row_no", "text")
    return own.mapInArrow(_lines, "note_id bigint, row_no int, clean string, kind string")
