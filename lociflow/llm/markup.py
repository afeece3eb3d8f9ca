"""Markup residue: HTML/XML, Markdown, MediaWiki and LaTeX to clean text that keeps headings, lists, tables, code and formulas.

A text goes through four passes: opaque regions (code, formulas, comments, transcription marks) are set aside; the
events of the standard library's streaming HTML parser give tags and references; lines and inline marks of the other
families follow; then everything set aside returns in one plain notation. Content regions are selected in every text by
the text-to-tag ratio of its lines, smoothed with a Gaussian and cut at a threshold.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterator
from html.entities import html5
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociflow.runtime import ship

HTML, MD, WIKI, TEX = "html", "markdown", "wiki", "latex"
HEAD, ITEM, CODE, FORMULA, TABLE, INLINE = "heading", "list_item", "code_block", "formula", "table", "inline"

# Names of the markup languages.
_TAGS = {t: HEAD for t in "h1 h2 h3 h4 h5 h6 head".split()}
_TAGS |= {t: ITEM for t in "ul ol dl li dt dd list item".split()}
_TAGS |= {t: TABLE for t in "table tr td th thead tbody tfoot caption colgroup col row cell".split()}
_TAGS |= {t: CODE for t in "pre listing xmp eg syntaxhighlight".split()}
_TAGS |= {t: FORMULA for t in "math formula".split()}
_BLOCKS = frozenset("p div ul ol dl list table section article header footer nav main body html lg blockquote quote ab figure".split())
_SILENT_TO_END = frozenset("script style".split())  # their text goes if they are closed at all
_READINGS, _CORRECTIONS = frozenset("sic orig abbr".split()), frozenset("corr reg expan".split())
_BARE_ATTRIBUTES = "reversed|border|compact|nowrap|checked|disabled|hidden|selected|noshade|ismap|open|required|multiple|async|defer|itemscope"
_LISTS = frozenset("itemize enumerate description list".split())
_TABLES = frozenset("tabular tabular* tabularx tabulary longtable table table* array".split())
_SECTIONS = "part|chapter|section|subsection|subsubsection|paragraph|subparagraph"
_SILENT = frozenset("label cite citep citet ref pageref eqref index bibliography includegraphics usepackage documentclass vspace hspace input include".split())

# Set aside: S number E; both are Unicode noncharacters, which no text interchanges.
S, E = "\ufdd0", "\ufdd1"
_ASIDE = re.compile(f"{S}(\\d+){E}")

_TAG = re.compile(
    r"</?[A-Za-z][\w:-]*(?:\s+[\w:.-]+\s*=\s*(?:\"[^\"<>]*\"|'[^'<>]*'|[^\s\"'<>=`]+)|\s+(?:" + _BARE_ATTRIBUTES + r")(?=[\s/>]))*\s*/?>"
)
_LOCUS = re.compile(r"<(?:%|\$|-|~|f(?:\d+[rvRV]?\d*|[Rr]os)(?:\.[\w.]+)?(?:[,;][^<>\s]*)?|![^-<>][^<>]*|!>|@[A-Z]=[^<>]*)>|@\d{1,3};", re.A)
_COMMENT = re.compile(r"<!--.*?-->", re.S)
_OPEN_COMMENT = re.compile(r"<!--((?:(?!\n[ \t]*\n).)*)", re.S)  # never closed: a mark before text
_DECLARATION = re.compile(r"<!DOCTYPE\b[^<>]*>|<\?[A-Za-z][^<>]*\?>|<!\[CDATA\[.*?\]\]>", re.S | re.I)
_PRE = re.compile(r"<(pre|listing|xmp|eg|syntaxhighlight|source(?=\s+lang))\b([^<>]*)>(.*?)(?:</\1\s*>|\Z)", re.S | re.I)
_CODE = re.compile(r"<(code|tt|kbd|samp|nowiki)\b[^<>]*>(.*?)</\1\s*>", re.S | re.I)
_MATH = re.compile(r"<(math|formula)\b[^<>]*>(.*?)(?:</\1\s*>|\Z)", re.S | re.I)
_AUTOLINK = re.compile(r"<((?:https?|ftp)://[^<>\s]+|mailto:[^<>\s]+|[\w.+-]+@[\w-]+(?:\.[\w-]+)+)>")
_FENCE = re.compile(r"(`{3,}|~{3,})([^\n`]*)\n(.*?)(?:^[ ]{0,3}\1[`~]*[ \t]*$|\Z)", re.S | re.M)
_SPAN = re.compile(r"(`+)(?!`)((?:(?!\n[ \t]*\n).)+?)(?<!`)\1(?!`)", re.S)
_VERBATIM = re.compile(r"\\begin\{(verbatim\*?|Verbatim|lstlisting|minted|alltt)\}(?:\[[^\]\n]*\])?(?:\{[^}\n]*\})?(.*?)(?:\\end\{\1\}|\Z)", re.S)
_VERB = re.compile(r"\\(?:verb\*?|lstinline)([^\sA-Za-z*{])([^\n]*?)\1")
_MATH_ENV = re.compile(r"\\begin\{((?:equation|align|gather|multline|eqnarray|displaymath|math|flalign|alignat|split|aligned)\*?)\}(.*?)\\end\{\1\}", re.S)
_DISPLAY = re.compile(r"\$\$(?!\$)((?:(?!\n[ \t]*\n|<[%$~!-]).)+?)\$\$", re.S)
_DOLLAR = re.compile(r"\$(?![\s$])((?:[^$\n<]|<(?![%$~!-])|\n(?![ \t]*\n))*?)(?<![\s\\])\$(?![\d$])")
_AMOUNT = re.compile(r"\d[\d.,]*(?:\s[^\\^_=+]*)?", re.S)  # a price and what follows it, up to the next dollar sign
_BRACKET = re.compile(r"\\\[(.+?)\\\]", re.S)
_PAREN = re.compile(r"\\\((.+?)\\\)", re.S)
_REFERENCE = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|([A-Za-z][A-Za-z0-9]{1,31}));")
_OPENERS = re.compile(r"[<`~$\\@]")
_ANY = re.compile(r"[<>&*_`#\[{$\\|~@]|''|^[;:=]|^[ \t]*(?:[-+]|\d+[.)])[ \t]|^[ \t]*[-=]{3,}[ \t]*$|[" + S + E + "]", re.M)

_WIKI_TABLE = re.compile(r"^[ \t]*\{\|[^\n]*\n(.*?)(?:^[ \t]*\|\}|\Z)", re.S | re.M)
_WIKI_HEAD = re.compile(r"^(={1,6})[ \t]*([^=\s](?:[^\n]*?[^=\s])?)[ \t]*\1[ \t]*$", re.M)
_WIKI_LIST = re.compile(r"^[;:]+[*#;:]*[ \t]*(?=\S)", re.M)
_WIKI_LINK = re.compile(r"\[\[(?![\d,\s\[\]]*\]\])([^\[\]\n]+)\]\]")
_TEMPLATE = re.compile(r"\{\{([^{}]+)\}\}")
_WIKI_OUTER = re.compile(r"\[(?:https?|ftp)://[^\s\]]+(?:[ \t]+([^\]\n]+))?\](?!\()")
_MAGIC = re.compile(r"__(?:TOC|NOTOC|FORCETOC|NOEDITSECTION)__|(?<![~\w])~{3,5}(?!~)")

_ENV = re.compile(r"\\(begin|end)\{([A-Za-z]+\*?)\}((?:\[[^\]\n]*\])?)((?:\{[^{}\n]*\})*)")
_TABULAR = re.compile(r"\\begin\{(tabular\*?|tabularx|tabulary|longtable|array)\}(?:\[[^\]\n]*\])?(?:\{[^{}\n]*\})*(.*?)(?:\\end\{\1\}|\Z)", re.S)
_TEX_ITEM = re.compile(r"\\item\b[ \t]*(?:\[([^\]\n]*)\])?[ \t]*")
_TEX_HEAD = re.compile(r"\\(" + _SECTIONS + r")\*?(?:\[[^\]\n]*\])?\{([^{}]*)\}")
_TEX_GROUP = re.compile(r"\{\\(?:it|bf|tt|em|sc|sl|rm|sf|itshape|bfseries|scshape|slshape|ttfamily|small|large|footnotesize)(?![A-Za-z])[ \t]*([^{}]*)\}")
_TEX_ARG = re.compile(r"\\([A-Za-z]+)\*?(?:\[[^\]\n]*\])*\{([^{}]*)\}")
_TEX_BARE = re.compile(r"(?<![\w\\/:.])\\[A-Za-z]+\*?(?![\w\\/.:{])|\\(?:ldots|dots|quad|qquad|newline|noindent|TeX|LaTeX)(?![A-Za-z])")
_TEX_SIGN = re.compile(r"\\([&%$#_{}])|\\\\(?:\[[^\]\n]*\])?(?=\s|$)|\\['\"`^~=.]\{?([A-Za-z])\}?")
_TEX_RULES = re.compile(r"\\(?:hline|toprule|midrule|bottomrule|cline\{[^}]*\})")

_ATX = re.compile(r"^[ ]{0,3}(#{1,6})[ \t]+(\S[^\n]*?)[ \t]*#*[ \t]*$", re.M)
_UNDERLINE = re.compile(r"\n[ ]{0,3}(={2,}|-{3,})[ \t]*(?=\n|\Z)")
_DELIMITERS = re.compile(r"\n[ \t]*(?:\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)+\|?|\|[ \t]*:?-+:?[ \t]*\|)[ \t]*(?=\n|\Z)")
_RULE = re.compile(r"^[ ]{0,3}(?:-[ \t]*){3,}$|^[ ]{0,3}(?:\*[ \t]*){3,}$|^[ ]{0,3}(?:_[ \t]*){3,}$", re.M)
_LIST = re.compile(r"^([ \t]*)(?:[*+-]+|(\d{1,9})[.)])[ \t]+(?:\[[ xX]\][ \t]+)?(?=\S)", re.M)
_QUOTE = re.compile(r"^[ ]{0,3}>[ \t]?(?=\S)", re.M)
_LINK = re.compile(r"(!?)\[([^\[\]\n]*)\]\([^()\s]*(?:[ \t]+\"[^\"\n]*\")?\)|\[\^[\w-]+\]:?")
_REF_LINK = re.compile(r"\[([^\[\]\n]+)\]\[([\w -]+)\](?!\w)")
_BLANK_LINE = re.compile(r"\n[ \t]*\n")
_ANCHOR = re.compile(r"<a\b[^<>]*>(.*?)</a\s*>", re.I)


#: What an emphasis is written with: the lengths of its marks, and what may not stand before the opening mark and after
#: the closing one.
_EMPHASIS = {
    "*": ((1, 2, 3), re.compile(r"[\w*]"), re.compile(r"[\w*]")),
    "_": ((1, 2, 3), re.compile(r"\w"), re.compile(r"\w")),
    "'": ((2, 3, 5), re.compile(r"[\d']"), re.compile(r"'")),
    "~": ((2,), re.compile(r"~"), re.compile(r"~")),
}


def emphasised(text: str, mark: str, put) -> tuple[str, int]:
    """The text with `put()` in place of each pair of marks that enclose words of one line, and the number of pairs.

    Marks are runs of the sign, of a length that the sign allows; a pair has equal lengths, no blank inside its marks, and
    begins at the first mark that opens. What stands between is left for the next call. A line costs in proportion to
    its marks: the closing ones are looked up by length, so marks that nothing closes cost no more than others.
    """
    sizes, before, after = _EMPHASIS[mark]
    lines, pairs = text.split("\n"), 0
    for k, line in enumerate(lines):
        if mark * sizes[0] not in line:
            continue
        runs = [m.span() for m in re.finditer(re.escape(mark) + "+", line) if m.end() - m.start() in sizes]
        closing: dict[int, list[int]] = {n: [] for n in sizes}
        for r, (a, b) in enumerate(runs):
            if a > 0 and not line[a - 1].isspace() and not (b < len(line) and after.match(line[b])):
                closing[b - a].append(r)
        out, pos, r = [], 0, 0
        while r < len(runs):
            a, b = runs[r]
            if b < len(line) and not line[b].isspace() and not (a > 0 and before.match(line[a - 1])):
                ends = closing[b - a]
                e = bisect_right(ends, r)
                if e < len(ends):
                    c, d = runs[ends[e]]
                    out += (line[pos:a], put(), line[b:c])
                    pos, r, pairs = d, ends[e], pairs + 1
            r += 1
        if out:
            lines[k] = "".join(out) + line[pos:]
    return "\n".join(lines), pairs


def content_lines(text_len: np.ndarray, tags: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Which lines belong to content regions: characters of text for each tag of the line, smoothed with a Gaussian,
    in the upper cluster, that is not below the standard deviation of the smoothed ratios."""
    ratio = text_len / np.maximum(1, tags)
    x = np.arange(-2, 3)
    kernel = np.exp(-(x**2) / (2 * sigma**2))
    smooth = np.convolve(np.pad(ratio, 2, mode="edge"), kernel / kernel.sum(), mode="valid")
    return smooth >= smooth.std()


def furniture(lines: list[str]) -> list[int]:
    """Lines of page furniture: outside the content regions, and themselves of nothing but link texts and signs.

    The text of a line, for its ratio, is what stands outside links: a line of links has none, whatever its length. In a
    text without tags, or whose lines are all alike, all is content; no word outside a link is ever in such a line.
    """
    tags = np.array([len(_TAG.findall(x)) if "<" in x else 0 for x in lines])
    linked = {k for k in np.flatnonzero(tags >= 2).tolist() if _ANCHOR.search(lines[k])}
    if not linked:
        return []
    signs = lambda x: _ASIDE.sub("", _REFERENCE.sub("", _TAG.sub("", x)))
    own = [signs(_ANCHOR.sub("", x) if k in linked else x) for k, x in enumerate(lines)]
    content = content_lines(np.array([sum(map(str.isalnum, x)) for x in own]), tags)
    return [k for k in sorted(linked) if not content[k] and not any(map(str.isalnum, own[k]))]


class _Events(HTMLParser):
    """Takes the parser's events and leaves the text, with structure set aside."""

    CDATA_CONTENT_ELEMENTS = RCDATA_CONTENT_ELEMENTS = ()

    def __init__(self, doc: _Document) -> None:
        super().__init__(convert_charrefs=False)
        self.doc, self.out = doc, []
        self.open: list[tuple[str, int]] = []  # elements whose text may go: name, place in out
        self.choices: list[tuple[list[tuple[int, int]], list[bool]]] = []  # readings of each open choice; whether it has a correction

    def element(self, tag: str) -> str:
        kind = _TAGS.get(tag.rpartition(":")[2], INLINE)
        self.doc.kinds.add((HTML, kind))
        return kind

    def block(self) -> None:
        """The border of a block: an element to be dropped that is still open here was never closed and keeps its text."""
        self.open = [x for x in self.open if x[0] in _SILENT_TO_END]
        while self.choices:
            self.choose()

    def choose(self) -> None:
        """End of a choice: its readings go if there is a correction; without one they are all there is."""
        readings, corrected = self.choices.pop()
        if corrected:
            for a, b in reversed(readings):
                del self.out[a:b]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        kind = self.element(tag)
        put = self.doc.aside
        if tag in _BLOCKS or kind == HEAD:
            self.block()
        if tag in _SILENT_TO_END or tag == "del" or (self.choices and tag in _READINGS):
            self.open.append((tag, len(self.out)))
        elif self.choices and tag in _CORRECTIONS:
            self.choices[-1][1].append(True)
        elif tag == "choice":
            self.choices.append(([], []))
        elif kind == HEAD:
            self.out.append(put("\n\n" + "#" * (int(tag[1]) if tag[1:].isdigit() else 2) + " "))
        elif tag in ("li", "item", "dt", "dd"):
            self.out.append(put("\n- "))
        elif tag in ("tr", "row"):
            self.out.append(put("\n|"))
        elif tag in ("td", "th", "cell"):
            self.out.append(put(" "))
        elif tag in ("br", "lb", "l"):
            self.out.append(put("\n"))
        elif tag in _BLOCKS:
            self.out.append(put("\n\n"))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.element(tag)
        if tag in ("br", "lb", "hr", "p"):
            self.out.append(self.doc.aside("\n"))

    def handle_endtag(self, tag: str) -> None:
        kind = self.element(tag)
        put = self.doc.aside
        if tag in _BLOCKS or kind == HEAD:
            self.block()
        if (at := next((k for k in reversed(range(len(self.open))) if self.open[k][0] == tag), None)) is not None:
            start = self.open[at][1]
            del self.open[at:]
            if tag in _READINGS and self.choices:
                self.choices[-1][0].append((start, len(self.out)))
            else:
                del self.out[start:]
        elif tag == "choice" and self.choices:
            self.choose()
        elif kind == HEAD or tag in _BLOCKS:
            self.out.append(put("\n\n"))
        elif tag in ("td", "th", "cell"):
            self.out.append(put(" |"))

    def handle_data(self, data: str) -> None:
        if self.open and "\n" in data and _BLANK_LINE.search(data):
            self.block()
        self.out.append(data)

    def handle_charref(self, name: str) -> None:
        self.reference(f"&#{name};")

    def handle_entityref(self, name: str) -> None:
        self.reference(f"&{name};")

    def reference(self, source: str) -> None:
        self.doc.kinds.add((HTML, INLINE))
        self.out.append(self.doc.aside(html.unescape(source).replace("\xa0", " ")))


class _Document:
    """One text on its way through the passes."""

    def __init__(self) -> None:
        self.kinds: set[tuple[str, str]] = set()
        self.kept: list[str] = []
        self.dropped: set[str] = set()
        self.lost: list[str] = []
        self.absent: set[str] = set()

    def aside(self, s: str) -> str:
        self.kept.append(s)
        return f"{S}{len(self.kept) - 1}{E}"

    def found(self, family: str, element: str, s: str) -> str:
        """Note a kind of markup and set its plain form aside."""
        self.kinds.add((family, element))
        return self.aside(s)

    def code(self, family: str, body: str) -> str:
        return self.found(family, CODE, "\n```\n" + body.strip("\n") + "\n```\n")

    def closes(self, text: str, mark: str, i: int) -> bool:
        """Whether `mark` comes after i; where it doesn't, it is not sought again, so that openers cost no more than once."""
        if mark in self.absent:
            return False
        if text.find(mark, i) < 0:
            self.absent.add(mark)
            return False
        return True

    def opaque(self, text: str) -> str:
        """Sets aside what no later pass may look into."""
        out, pos = [], 0
        while m := _OPENERS.search(text, pos):
            i = m.start()
            got = self.region(text, i, m.group())
            if got is None:
                out.append(text[pos : i + 1])
                pos = i + 1
            else:
                put, end = got
                out += (text[pos:i], put)
                pos = end
        out.append(text[pos:])
        return "".join(out)

    def region(self, text: str, i: int, c: str) -> tuple[str, int] | None:
        if c == "<":
            if text.startswith("<!--", i):
                if self.closes(text, "-->", i) and (m := _COMMENT.match(text, i)):
                    return self.found(HTML, INLINE, ""), m.end()
                m = _OPEN_COMMENT.match(text, i)
                return self.found(HTML, INLINE, m[1].strip()), m.end()
            if m := _DECLARATION.match(text, i):
                return self.found(HTML, INLINE, ""), m.end()
            if m := _LOCUS.match(text, i):
                return self.aside(m.group()), m.end()
            if m := _PRE.match(text, i):
                body = html.unescape(re.sub(r"</?code\b[^<>]*>", "", m[3], flags=re.I))
                return self.code(HTML, body), m.end()
            if m := _MATH.match(text, i):
                inner = html.unescape(" ".join(_TAG.sub(" ", m[2]).split())).strip("$ ")
                return self.found(HTML, FORMULA, f"${inner}$"), m.end()
            if self.closes(text, "</", i) and (m := _CODE.match(text, i)):
                body = html.unescape(m[2])
                return (self.code(HTML, body) if "\n" in body.strip() else self.found(HTML, INLINE, body)), m.end()
            if m := _AUTOLINK.match(text, i):
                return self.found(MD, INLINE, m[1]), m.end()
            return None if _TAG.match(text, i) else (self.aside("<"), i + 1)
        if c == "@":
            return (self.aside(m.group()), m.end()) if (m := _LOCUS.match(text, i)) else None
        if c in "`~":
            start = text.rfind("\n", 0, i) + 1
            if i - start <= 3 and not text[start:i].strip() and (m := _FENCE.match(text, i)):
                return self.code(MD, m[3]), m.end()
            if c == "`" and (m := _SPAN.match(text, i)):
                return self.found(MD, INLINE, m[2].strip()), m.end()
            run = len(text) - i - len(text[i:].lstrip(c)) if text.startswith(c * 2, i) else 1
            return (text[i : i + run], i + run) if run > 1 else None
        if c == "$":
            if m := _DISPLAY.match(text, i):
                return self.found(TEX, FORMULA, f"$${m[1].strip()}$$"), m.end()
            if (m := _DOLLAR.match(text, i)) and not (_AMOUNT.fullmatch(m[1]) and " " in m[1]):
                return self.found(TEX, FORMULA, m.group()), m.end()
            return None
        if c == "\\":
            if m := _VERBATIM.match(text, i):
                return self.code(TEX, m[2]), m.end()
            if self.closes(text, "\\end{", i) and (m := _MATH_ENV.match(text, i)):
                return self.found(TEX, FORMULA, f"$${m[2].strip()}$$"), m.end()
            if (self.closes(text, "\\]", i) and (m := _BRACKET.match(text, i))) or (self.closes(text, "\\)", i) and (m := _PAREN.match(text, i))):
                return self.found(TEX, FORMULA, f"${m[1].strip()}$"), m.end()
            if m := _VERB.match(text, i):
                return self.found(TEX, INLINE, m[2]), m.end()
            return (text[i : i + 2], i + 2) if i + 1 < len(text) and text[i + 1] in "\\$" else None
        return None

    def tags(self, text: str) -> str:
        """The parser's events. Lines outside the content regions are marked here and go when all passes have seen them."""
        lines = text.split("\n")
        for k in furniture(lines):
            mark = self.aside("")
            self.dropped.add(mark)
            self.lost.append(self.restored(_TAG.sub("", lines[k])))
            lines[k] += mark
        text = "\n".join(lines)
        # what isn't a reference is no event
        text = re.sub(r"(?<!\\)&", lambda m: "&" if (r := _REFERENCE.match(text, m.start())) and (not r[1] or r[1] + ";" in html5) else self.aside("&"), text)
        events = _Events(self)
        events.feed(text)
        events.close()
        events.block()
        return "".join(events.out)

    def latex(self, text: str) -> str:
        def tabular(m: re.Match) -> str:
            self.kinds.add((TEX, TABLE))
            rows = [r.strip() for r in re.split(r"\\\\(?:\[[^\]\n]*\])?", _TEX_RULES.sub("", m[2])) if r.strip()]
            amp = re.compile(r"(?<!\\)&|" + S + r"(\d+)" + E)
            cell = lambda x: amp.sub(lambda a: "|" if not a[1] or self.kept[int(a[1])] == "&" else a[0], x)
            return "\n" + "".join(f"{self.aside('| ')}{cell(r)}{self.aside(' |')}\n" for r in rows)

        def environment(m: re.Match) -> str:
            name = m[2]
            self.kinds.add((TEX, ITEM if name.rstrip("*") in _LISTS else TABLE if name in _TABLES else INLINE))
            return "\n"

        text = _TABULAR.sub(tabular, text)
        text = _ENV.sub(environment, text)
        text = _TEX_ITEM.sub(lambda m: self.found(TEX, ITEM, "\n- " + (m[1] + " " if m[1] else "")), text)
        text = _TEX_HEAD.sub(lambda m: self.found(TEX, HEAD, "\n\n## ") + m[2] + self.aside("\n\n"), text)
        text = _TEX_GROUP.sub(lambda m: self.found(TEX, INLINE, "") + m[1], text)
        n = 1
        while n:  # arguments within arguments, the inner first
            text, n = _TEX_ARG.subn(lambda m: self.found(TEX, INLINE, "") + ("" if m[1] in _SILENT else m[2]), text)
        text = _TEX_BARE.sub(lambda m: self.found(TEX, INLINE, ""), text)
        return _TEX_SIGN.sub(lambda m: self.found(TEX, INLINE, m[1] or m[2] or "\n"), text)

    def wiki(self, text: str) -> str:
        def table(m: re.Match) -> str:
            self.kinds.add((WIKI, TABLE))
            out, cells = [], []
            for line in [*m[1].split("\n"), "|-"]:
                line = line.strip()
                if line.startswith("|-"):
                    if cells:
                        out.append(self.aside("| ") + self.aside(" | ").join(cells) + self.aside(" |"))
                    cells = []
                elif line[:1] in ("|", "!"):
                    for x in re.split(r"\|\||!!" if line[0] == "!" else r"\|\|", line[2 if line[1:2] == "+" else 1 :]):
                        cells.append(re.sub(r"^[^|\[\]{}]*=[^|\[\]{}]*\|(?!\|)", "", x).strip())
                elif line and cells:
                    cells[-1] += " " + line
            return "\n".join(out) + "\n"

        def link(m: re.Match) -> str:
            target, _, label = m[1].partition("|")
            hidden = not label and re.match(r"(?:category|file|image)\s*:", target, re.I)
            return self.found(WIKI, INLINE, "") + ("" if hidden else label.rpartition("|")[2] or target)

        def template(m: re.Match) -> str:
            parts = m[1].split("|")
            words = [p for p in parts[1:] if "=" not in p]
            return self.found(WIKI, INLINE, "") + (words[-1] if parts[0].strip().lower() == "lang" and words else "")

        if "{|" in text:
            text = _WIKI_TABLE.sub(table, text)
        if "=" in text:
            text = _WIKI_HEAD.sub(lambda m: self.found(WIKI, HEAD, "\n" + "#" * len(m[1]) + " ") + m[2] + self.aside("\n"), text)
        text = _WIKI_LIST.sub(lambda m: self.found(WIKI, ITEM, "- "), text)
        if "''" in text:
            text = self.emphasis(text, WIKI, "'")
        if "[" in text:
            text = _WIKI_LINK.sub(link, text)
            text = _WIKI_OUTER.sub(lambda m: self.found(WIKI, INLINE, "") + (m[1] or ""), text)
        if "{{" in text:
            n = 1
            while n:
                text, n = _TEMPLATE.subn(template, text)
        if "__" in text or "~~~" in text:
            text = _MAGIC.sub(lambda m: self.found(WIKI, INLINE, ""), text)
        return text

    def markdown(self, text: str) -> str:
        if "|" in text:
            text = self.pipe_tables(text)
        if "#" in text:
            text = _ATX.sub(lambda m: self.found(MD, HEAD, m[1] + " ") + m[2], text)
        if "==" in text or "---" in text:
            text = self.underlined(text)
        text = _RULE.sub(lambda m: self.found(MD, INLINE, ""), text)
        text = _LIST.sub(lambda m: self.found(MD, ITEM, m[1] + (m[2] + ". " if m[2] else "- ")), text)
        if ">" in text:
            text = _QUOTE.sub(lambda m: self.found(MD, INLINE, ""), text)
        if "[" in text:
            n = 1
            while n:  # an image in a link comes first
                text, n = _LINK.subn(lambda m: self.found(MD, INLINE, "") + (m[2] or ""), text)
            text = _REF_LINK.sub(lambda m: self.found(MD, INLINE, "") + m[1], text)
        for mark in "*_~":
            if mark in text:
                text = self.emphasis(text, MD, mark)
        return text

    def emphasis(self, text: str, family: str, mark: str) -> str:
        n = 1
        while n:  # emphasis within emphasis, the outer first
            text, n = emphasised(text, mark, lambda: self.found(family, INLINE, ""))
        return text

    def pipe_tables(self, text: str) -> str:
        """Tables by their row of dashes: the line before it heads the table, lines with a bar after it follow."""
        out, pos = [], 0
        while m := _DELIMITERS.search(text, pos):
            start = max(pos, text.rfind("\n", 0, m.start()) + 1)
            head = text[start : m.start()]
            if "|" not in head:
                out.append(text[pos : m.end()])
                pos = m.end()
                continue
            self.kinds.add((MD, TABLE))
            rows, end = [head], m.end()
            while end < len(text):
                stop = text.find("\n", end + 1)
                stop = len(text) if stop < 0 else stop
                if "|" not in text[end + 1 : stop]:
                    break
                rows.append(text[end + 1 : stop])
                end = stop
            out.append(text[pos:start])
            out.append("\n".join(self.aside("| ") + r.strip().strip("|").strip() + self.aside(" |") for r in rows))
            pos = end
        out.append(text[pos:])
        return "".join(out)

    def underlined(self, text: str) -> str:
        """Headings by their underlines."""
        out, pos = [], 0
        while m := _UNDERLINE.search(text, pos):
            start = max(pos, text.rfind("\n", 0, m.start()) + 1)
            head = text[start : m.start()]
            if head.strip() and "|" not in head and not _LIST.match(head):
                out += (text[pos:start], self.found(MD, HEAD, "# " if m[1][0] == "=" else "## "), head)
            else:
                out.append(text[pos : m.end()])
            pos = m.end()
        out.append(text[pos:])
        return "".join(out)

    def restored(self, text: str) -> str:
        if self.dropped:
            text = "\n".join("" if any(m.group() in self.dropped for m in _ASIDE.finditer(x)) else x for x in text.split("\n"))
        n = 1
        while n:  # things set aside may hold others, set aside before them
            text, n = _ASIDE.subn(lambda m: self.kept[int(m[1])], text)
        return text


def convert(text: str | None) -> tuple[str | None, list[tuple[str, str]]]:
    """The clean text and the kinds of markup found, sorted pairs (family, element)."""
    if not text or not _ANY.search(text):
        return text, []
    own = [c for c in (S, E) if c in text]
    if own:  # the marks' own characters stand aside for others that the text lacks
        spare = [c for c in map(chr, range(0xFDD2, 0xFDF0)) if c not in text]
        swap = list(zip(own, spare)) + [(c, "\ufffd") for c in own[len(spare) :]]
        for c, x in swap:
            text = text.replace(c, x)
        clean, kinds = convert(text)
        for c, x in swap:
            clean = clean.replace(x, c) if x != "\ufffd" else clean
        return clean, kinds
    doc = _Document()
    body = doc.opaque(text)
    if "<" in body or "&" in body:
        body = doc.tags(body)
    if "\\" in body:
        body = doc.latex(body)
    body = doc.markdown(doc.wiki(body))
    if not doc.kinds:
        return text, []
    clean = re.sub(r"[ \t]+\n", "\n", doc.restored(body))
    clean = re.sub(r"\n{3,}", "\n\n", clean).strip()
    if not clean and (m := _TEX_ARG.fullmatch(text.strip())):
        clean = m[2]  # a field that is nothing but \\label{...}
    return clean, sorted(doc.kinds)


def clean_markup(df: DataFrame, id_col: str, text_cols: list[str]) -> DataFrame:
    """Rows (id, field_name, clean, kinds), one for each row of `df` and text column.

    `clean` is the text without markup: headings as `#` lines, list items as `- ` or `1. `, tables as `|` rows, code
    between fences, formulas between dollar signs, everything else as plain words. Marks of transcriptions, comparisons,
    prices, paths and the like stay as they are. `kinds` lists the pairs (family, element) found. A null text stays
    null; an empty or blank one and one without markup come out as they are. Texts are parsed whole, row by row: no
    shuffle. Columns are read by name, so further columns don't matter; a row given twice comes out twice.
    """
    ship(df.sparkSession)
    source = df.select(F.col(id_col).alias("__id"), *[F.col(c).alias(f"__t{k}") for k, c in enumerate(text_cols)])
    id_type = source.schema["__id"].dataType.simpleString()
    kind_type = pa.list_(pa.struct([("family", pa.string()), ("element", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                b = batch.slice(at, 1024)
                for k, name in enumerate(text_cols):
                    done = [convert(t) for t in b.column(k + 1).to_pylist()]
                    yield pa.RecordBatch.from_arrays(
                        [
                            b.column(0),
                            pa.array([name] * b.num_rows, pa.string()),
                            pa.array([c for c, _ in done], pa.string()),
                            pa.array([[{"family": f, "element": e} for f, e in kinds] for _, kinds in done], kind_type),
                        ],
                        [id_col, "field_name", "clean", "kinds"],
                    )

    return source.mapInArrow(run, f"`{id_col}` {id_type}, field_name string, clean string, kinds array<struct<family:string,element:string>>")


def dropped_lines(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, place, line): the lines that clean_markup() leaves out of a text as page furniture, without their tags, in
    order. A null text has none."""
    ship(df.sparkSession)
    source = df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).where(F.col("__text").contains("<"))
    id_type = source.schema["__id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k, text in enumerate(b.column(1).to_pylist()):
                doc = _Document()
                doc.tags(doc.opaque(text))
                rows += [(k, place, line) for place, line in enumerate(doc.lost)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([r[0] for r in rows], pa.int64())), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string())], [id_col, "place", "line"])

    return source.mapInArrow(run, f"`{id_col}` {id_type}, place int, line string")


def markup_kinds(df: DataFrame, id_col: str, text_cols: list[str]) -> DataFrame:
    """Rows (id, field_name, family, element), each once: the kinds of markup in each text."""
    return (
        clean_markup(df, id_col, text_cols)
        .where(F.size("kinds") > 0)
        .select(id_col, "field_name", F.inline("kinds"))
        .dropDuplicates([id_col, "field_name", "family", "element"])
    )
