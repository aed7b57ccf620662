"""Markup residue: find HTML, Markdown, wiki and TeX constructs in a text, and make clean text of it.

A scan proposes constructs. They and the runs of text around them are the nodes of a graph. A log-linear classifier
(PRIOR, EVIDENCE) gives each node the cost of calling it markup and of calling it content, from the signs of the node
alone; edges tie it to what stands around it: the runs on its line, the text it is glued to or continues, the lines of
its list or table, the other tag of its element and the elements around that. A minimum cut labels all nodes at once,
so that signs in prose (paths, products, identifiers, placeholders) are told from markup by their surroundings. What is
taken out, kept or turned into a piece follows from the labels.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from html.entities import html5
from typing import NamedTuple

from .mincut import label

FAMILIES = ("html", "markdown", "wiki", "latex")

# Element names of HTML.
ELEMENTS = frozenset(
    "a abbr address area article aside audio b base bdi bdo big blockquote body br button canvas caption center cite code "
    "col colgroup data datalist dd del details dfn dialog div dl dt em embed fieldset figcaption figure font footer form "
    "frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html i iframe img input ins kbd label legend li link main map "
    "mark menu meta meter nav noscript object ol optgroup option output p param picture pre progress q ref rp rt ruby s "
    "samp script section select small source span strike strong style sub summary sup svg table tbody td template "
    "textarea tfoot th thead time title tr track tt u ul var video wbr nowiki references gallery math".split()
)
BREAKING = frozenset("br p li tr div h1 h2 h3 h4 h5 h6 hr table ul ol".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# TeX commands that stand without an argument in braces.
BARE_COMMANDS = frozenset(
    "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi pi rho sigma tau upsilon phi chi psi omega "
    "Gamma Delta Theta Lambda Xi Pi Sigma Phi Psi Omega to infty sum prod int le leq ge geq ne neq approx equiv cdot "
    "times div pm mp in notin subset cup cap forall exists partial nabla ldots cdots dots quad qquad item hline noindent "
    "newline par centering maketitle tableofcontents newpage clearpage bigskip medskip smallskip LaTeX TeX left right "
    "small large Large huge tiny normalsize footnotesize rightarrow leftarrow Rightarrow mapsto sqrt frac log sin cos tan "
    "lim max min displaystyle label toprule midrule bottomrule appendix itshape bfseries ttfamily em bf it tt".split()
)
# Environments whose content is a formula, and those whose content is code.
FORMULAS = frozenset("equation equation* align align* gather gather* multline multline* displaymath math eqnarray eqnarray* array matrix pmatrix bmatrix cases".split())
LISTINGS = frozenset("verbatim verbatim* lstlisting minted alltt".split())

HOLE = "\ue000"  # stands for a sign that belongs to a construct found before

FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})([^\n]*)$")
TICKS = re.compile(r"`+")
HTML = re.compile(
    r"<!--.*?-->|<!DOCTYPE[^>]*>|<!\[CDATA\[.*?\]\]>|<(/?)([A-Za-z][A-Za-z0-9-]*)((?:\s+[^\s<>=\"'/]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'<>=`]+))?)*)\s*(/?)>"
    r"|&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});|\{/\*\s*stay:.*?\*/\}",
    re.S,
)
RAW = re.compile(r"(<(script|style)\b[^>]*>)(.*?)(</\2\s*>)", re.S | re.I)
PRE = re.compile(r"<(pre|code|nowiki)\b[^<>]*>(.*?)</\1\s*>", re.S | re.I)
ENVIRONMENT = re.compile(r"\\(begin|end)\{([A-Za-z]+\*?)\}(?:\[[^\]\n]*\])?(?:\{[^{}\n]*\})?")
DISPLAY = re.compile(r"\$\$(?!\$)([^$]+?)\$\$|\\\[((?:(?!\n[ \t]*\n).)+?)\\\]|\\\(((?:(?!\n[ \t]*\n).)+?)\\\)", re.S)
INLINE_MATH = re.compile(r"(?<![\\$\w])\$(?![\s$])([^$\n]*(?:\n[^$\n]+)?)(?<![\s\\])\$(?![\d$])")
COMMAND = re.compile(r"\\([A-Za-z]+)(\*?)((?:\[[^\]\n]*\])?(?=\{)|)")
TEX_ESCAPE = re.compile(r"\\[%&_#$~^{}]")
WIKI_TABLE = re.compile(r"^[ \t:]*\{\|[^\n]*\n(.*?)^[ \t]*\|\}", re.S | re.M)
WIKI_HEADING = re.compile(r"^(={1,6})(?!=)[ \t]*([^=\n](?:[^\n]*?[^=\n])?)[ \t]*\1[ \t]*$", re.M)
WIKI_EMPHASIS = re.compile(r"('{2,5})(?!')([^'\n]+(?:'[^'\n]+)*?)\1(?!')")
WIKI_LINK = re.compile(r"\[\[([^\[\]\n]+(?:\[[^\[\]\n]*\][^\[\]\n]*)*)\]\]")
WIKI_URL = re.compile(r"(?<![\]!\w])\[((?:https?|ftp|mailto):[^\s\]]+)(?:[ \t]+([^\]\n]+))?\](?![(\[:])")
TEMPLATE = re.compile(r"\{\{([^{}]+)\}\}")
WIKI_PIECE = re.compile(r"^\{\|.*$|^\|\}|^\|-+[ \t]*$|^(?:![ \t]*[^!\n]+!!.*)$", re.M)
ATX = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
UNDERLINE = re.compile(r"^ {0,3}(=+|-+)[ \t]*$")
BULLET = re.compile(r"^([ \t]*)([-+*])([ \t]+)(\S.*)$")
NUMBER = re.compile(r"^([ \t]*)(\d{1,9})([.)])([ \t]+)(\S.*)$")
QUOTE = re.compile(r"^ {0,3}>[ \t]?(.*)$")
DELIMITER = re.compile(r"^[ \t]*\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
PIPES = re.compile(r"^[ \t]*\|(?:[^|\n]*\|)+[ \t]*$")
DEFINITION = re.compile(r"^ {0,3}\[(\^?[^\]\n]+)\]:[ \t]+\S.*$")
LINK = re.compile(r"(!?)\[((?:[^\[\]\n]|\n(?!\s*\n))*)\](?:\(([^()\s]*(?:\([^()\s]*\)[^()\s]*)?(?:\s+\"[^\"]*\"|\s+'[^']*')?)\)|\[([^\[\]\n]*)\])")
NOTE_LABEL = re.compile(r" {0,3}\[\^[^\]\n]+\]:[ \t]+")
FOOTNOTE = re.compile(r"\[\^[^\]\s]+\]")
AUTOLINK = re.compile(r"<((?:https?|ftp|mailto):[^<>\s]+|[\w.+-]+@[\w-]+(?:\.[\w-]+)+)>")
STARS = re.compile(r"(?<![\\\w*])(\*{1,3})(?![\s*])([^*\n]+(?:\n[^*\n]+)*?)(?<![\s\\])\1(?![\w*])")
LOW_LINES = re.compile(r"(?<![\\\w])(_{1,3})(?![\s_])([^\n]*?[^\s_\\](?:\n[^_\n]+[^\s_\\])?)\1(?!\w)")
STRIKE = re.compile(r"(?<!~)(~~)(?![\s~])([^~\n]+?)(?<!\s)~~(?!~)")
ESCAPE = re.compile(r"\\[!\"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]")
RULE = re.compile(r"^ {0,3}(?:(?:\*[ \t]*){3,}|(?:_[ \t]*){3,}|(?:-[ \t]*){3,})$")
#: Signs without one of which a text cannot hold a construct; for the filter before the Python stage.
SIGNS = r"[<>&\\$*_~`#|=+\[\]{}]|''|(?m)^[ \t]*(-|\d{1,9}[.)])[ \t]|^[ \t]*-+[ \t]*$"


# Costs of a kind of construct: of calling it markup, and of calling it content.
PRIOR = {
    "code": (0.1, 5.0), "raw": (0.5, 1.0), "known entity": (0.2, 3.0), "entity": (3.0, 0.2), "comment": (0.1, 5.0), "tag": (1.2, 1.5), "closing tag": (1.2, 3.0), "autolink": (0.1, 4.0),
    "environment": (0.1, 5.0), "formula": (0.2, 3.0), "display": (2.0, 0.5), "inline formula": (1.0, 1.0), "command": (1.2, 1.5), "tex escape": (0.3, 2.0), "wiki table": (0.1, 5.0), "wiki piece": (0.8, 1.0),
    "wiki heading": (0.2, 3.0), "wiki link": (0.2, 3.0), "wiki address": (0.3, 2.0), "template": (0.5, 1.5), "wiki emphasis": (0.3, 2.0), "heading": (0.2, 3.0), "underline": (0.2, 2.0), "rule": (0.3, 2.0),
    "bullet": (0.3, 2.0), "number": (0.3, 2.0), "quote": (0.3, 2.0), "delimiter": (0.1, 4.0), "row": (0.6, 1.0), "open row": (0.4, 1.5), "definition": (0.2, 3.0), "link": (0.2, 3.0), "loose link": (0.2, 1.0),
    "footnote": (0.3, 1.5), "escape": (0.4, 1.5), "emphasis": (0.3, 1.5),
}
# What signs of the construct itself add to the cost of calling it markup.
EVIDENCE = {
    "known name": -1.0, "value or slash": -1.0, "bare attribute": 0.2, "word": 1.2, "TeX sign": -1.8, "one symbol": -0.8, "amount": 2.0, "braces": -1.0, "stands bare": -0.4, "table edge": -0.5,
    "one equals": 3.6, "no title": 1.0, "one sign": 1.3, "one cell": 0.6, "prose inside": 5.3, "no text": 4.8, "digits only": 3.4, "code like": 3.0, "two backslashes": 1.6,
}
# Weights of edges: between a construct and the run beside it; the run it is glued to, as a product, an index or a path;
# the paragraph it would break into; between parts of one thing.
BESIDE, AROUND, PAIR, CHAIN, ROWS, PIECES = 0.3, 0.05, 2.0, 3.0, 0.8, 1.0
GLUED_TAG, GLUED_NAME, GLUED_INDEX, GLUED_NOTE, DRIVE, PATH = 0.5, 2.0, 4.8, 1.7, 1.6, 3.0
BREAKS_WITH_WORD, BREAKS, BREAKS_WITH_NUMBER = 0.9, 2.3, 2.7


def _cost(kind: str, *facts: str | None) -> tuple[float, float]:
    markup, content = PRIOR[kind]
    return max(markup + sum(EVIDENCE[f] for f in facts if f), 0.1), content


class Graph:
    """Nodes with the costs of their labels, and edges. Constructs are numbered from 0 on, runs of text from -1 down."""

    def __init__(self, text: str):
        self.text = text
        self.spans: list[Span] = []
        self.edges: list[tuple[int, int, float]] = []
        self.runs: dict[tuple[int, int], int] = {}

    def add(self, start: int, end: int, family: str, kind: str, keep: str | None, cost: tuple[float, float], own: tuple | None = None) -> int:
        self.spans.append(Span(start, end, family, kind, keep, *cost, own))
        return len(self.spans) - 1

    def run(self, start: int, end: int) -> int:
        return self.runs.setdefault((start, end), -1 - len(self.runs))

    def before(self, masked: str, at: int) -> int:
        """The run that ends at ``at``: back to the line's start or the next construct."""
        start = max(masked.rfind("\n", 0, at), masked.rfind(HOLE, 0, at)) + 1
        return self.run(start, at)

    def beside(self) -> None:
        """Edges between neighbours of one line: constructs and the runs between them.

        Marks of whole lines have edges to the lines around them instead.
        """
        order = sorted((k for k, s in enumerate(self.spans) if s.kind not in OF_LINES or s.family != "markdown"), key=lambda k: (self.spans[k].start, -self.spans[k].end))
        end, last = 0, -1
        for k in order:
            s = self.spans[k]
            if s.start >= end:
                gap = self.text[end : s.start]
                if last >= 0 and "\n" not in gap and not gap.strip():
                    self.edges.append((last, k, BESIDE))
                else:
                    head, tail = gap.find("\n"), gap.rfind("\n")
                    if last >= 0 and (gap[:head] if head >= 0 else gap).strip():
                        self.edges.append((last, self.run(end, end + head if head >= 0 else s.start), BESIDE))
                    if gap[tail + 1 :].strip():
                        self.edges.append((self.run(end + tail + 1, s.start), k, BESIDE))
            if s.end > end:
                end, last = s.end, k
        if last >= 0:
            tail = self.text[end : (x if (x := self.text.find("\n", end)) >= 0 else len(self.text))]
            if tail.strip():
                self.edges.append((last, self.run(end, end + len(tail)), BESIDE))

    def costs(self) -> list[tuple[float, float]]:
        found = [(s.markup, s.content) for s in self.spans]
        for a, b in self.runs:
            run = self.text[a:b]
            plain = sum(map(len, _PLAIN_SIGNS.findall(run)))
            found.append((2.0 + 3.0 * plain / max(len(run), 1), 0.1))
        return found

    def labels(self) -> list[bool]:
        """Whether each construct is markup."""
        n = len(self.spans)
        return label(self.costs(), [(a if a >= 0 else n - 1 - a, b if b >= 0 else n - 1 - b, w) for a, b, w in self.edges])[:n]


OF_LINES = frozenset("heading underline rule bullet number quote table definition".split())
_PLAIN_SIGNS = re.compile(r"[\w\s.,;:!?'()-]+")


class Span(NamedTuple):
    start: int
    end: int
    family: str
    kind: str
    keep: str | None  # what stays of it in clean text; None: the text inside, see edits
    markup: float  # cost of calling it markup
    content: float  # cost of calling it content
    own: tuple | None = None  # of code: ("code", start, end) of what is inside; of a formula: ("formula", inside, whether on its own, the stretch)


class Parsed(NamedTuple):
    text: str
    spans: list[Span]  # those labelled markup, in the order they were found


def _holes(text: str, spans: list[tuple[int, int]]) -> str:
    """The text with the given stretches blanked, in one pass."""
    if not spans:
        return text
    out, at = [], 0
    for a, b in sorted(spans):
        if a < at:
            a = at
        if b <= a:
            continue
        piece = text[a:b]
        out += [text[at:a], "\n".join(HOLE * len(x) for x in piece.split("\n")) if "\n" in piece else HOLE * (b - a)]
        at = b
    out.append(text[at:])
    return "".join(out)


def _code(text: str) -> list[tuple[int, int, int, int, str]]:
    """Fenced and inline code, in one pass over lines and one over runs of backticks."""
    found: list[tuple[int, int, int, int, str]] = []
    if "```" in text or "~~~" in text:
        at, opened = 0, None
        for line in text.split("\n"):
            if (m := FENCE.match(line)) and opened is None:
                if not (m[1][0] == "`" and "`" in m[2]):
                    opened = (m[1], at, at + len(line) + 1)
            elif m and opened and m[1][0] == opened[0][0] and len(m[1]) >= len(opened[0]) and not m[2].strip():
                found.append((opened[1], at + len(line), min(opened[2], at), max(at - 1, opened[2]), "fence"))
                opened = None
            at += len(line) + 1
        if opened:
            found.append((opened[1], len(text), min(opened[2], len(text)), len(text), "fence"))
    if "`" in text:
        masked = _holes(text, [(a, b) for a, b, *_ in found])
        runs = [(m.start(), m.end()) for m in TICKS.finditer(masked)]
        later: dict[int, list[int]] = {}
        for k in range(len(runs) - 1, -1, -1):
            later.setdefault(runs[k][1] - runs[k][0], []).append(k)
        k = 0
        while k < len(runs):
            a, b = runs[k]
            same = later[b - a]
            while same and same[-1] <= k:
                same.pop()
            if a and masked[a - 1] == "\\" and b - a == 1 or not same:
                k += 1
                continue
            c, d = runs[same[-1]]
            if re.search(r"\n[ \t]*\n", masked[b:c]):
                k += 1
                continue
            found.append((a, d, b, c, "inline"))
            k = same[-1] + 1
    return sorted(found)


def propose(text: str) -> Graph:
    """The graph of a text: constructs in the order they are found, runs, costs and edges."""
    g = Graph(text)
    code = _code(text)
    for a, b, c, d, kind in code:
        g.add(a, b, "markdown", kind, None, _cost("code"), ("code", c, d))
    t = _holes(text, [(a, b) for a, b, *_ in code])

    # HTML
    if "<" in t or "&" in t or "{/*" in t:
        gone: list[tuple[int, int]] = []
        if "<s" in t or "<S" in t:
            for m in RAW.finditer(t):
                k = g.add(*m.span(1), "html", "tag", "", _cost("comment"))
                g.add(m.end(1), m.start(4), "html", "raw", "", _cost("raw"))
                g.add(*m.span(4), "html", "tag", "", _cost("comment"))
                g.edges += [(k, k + 1, PAIR), (k + 1, k + 2, PAIR)]
                gone.append(m.span())
            t = _holes(t, gone)
        gone = []
        pre = {m.start(): m.span(2) for m in PRE.finditer(t)} if "<" in t else {}
        open_: dict[str, list[int]] = {}
        elements: list[tuple[str, int]] = []  # open ones, outermost first
        around: list[tuple[int, int]] = []
        closed: set[int] = set()
        for m in HTML.finditer(t):
            s = m[0]
            if s[0] == "&":
                g.add(*m.span(), "html", "entity", html.unescape(s), _cost("known entity" if s[1] == "#" or s[1:] in html5 else "entity"))
            elif m[2] is None:
                g.add(*m.span(), "html", "comment", "", _cost("comment"))
            else:
                name, attributes = m[2].lower(), m[3].strip()
                real, valued = name in ELEMENTS, bool(attributes and "=" in attributes or m[4])
                mate = open_[name].pop() if m[1] and open_.get(name) else None
                keep = "\n" if name in BREAKING else " " if name in ("td", "th") else ""
                inside = ("code", *pre[m.start()]) if m.start() in pre else None
                k = g.add(*m.span(), "html", "tag", keep, _cost("tag" if mate is None else "closing tag", "known name" if real else None, "value or slash" if valued else None, "bare attribute" if attributes and not valued and not real else None), inside)
                if m.start() > 0 and not m[1] and (t[m.start() - 1].isalnum() or t[m.start() - 1] in "_.") and not (real and name in VOID) and not open_.get(name):
                    g.edges.append((g.before(t, m.start()), k, GLUED_TAG if real else GLUED_NAME))
                if mate is not None:
                    g.edges.append((mate, k, PAIR))
                    closed.add(mate)
                    while elements and elements.pop()[1] != mate:
                        pass
                    around += [(outer, mate) for _, outer in elements[-2:]]
                elif not m[1] and name not in VOID:
                    open_.setdefault(name, []).append(k)
                    elements.append((name, k))
            gone.append(m.span())
        g.edges += [(a, b, AROUND) for a, b in around if a in closed]
        for m in AUTOLINK.finditer(t):
            g.add(*m.span(), "markdown", "autolink", m[1], _cost("autolink"))
            gone.append(m.span())
        t = _holes(t, gone + list(pre.values()))

    # TeX
    tex_lines: list[int] = []
    if "\\" in t or "$" in t:
        gone = []
        if "\\begin" in t or "\\end" in t:
            opened: list[tuple[str, int, int, int]] = []
            for m in ENVIRONMENT.finditer(t):
                k = g.add(*m.span(), "latex", "environment", "", _cost("environment"))
                tex_lines.append(m.start())
                gone.append(m.span())
                if m[1] == "begin":
                    opened.append((m[2], k, m.start(), m.end()))
                elif opened and opened[-1][0] == m[2]:
                    name, j, a, b = opened.pop()
                    g.edges.append((j, k, PAIR))
                    if name in FORMULAS or name in LISTINGS:  # the first of the two carries what is inside
                        own = ("formula", text[b : m.start()].strip(), True, (a, m.end())) if name in FORMULAS else ("code", b, m.start(), (a, m.end()))
                        g.spans[j] = g.spans[j]._replace(own=own)
                        gone.append((a, m.end()))
            t = _holes(t, gone)
            gone = []
        for m in DISPLAY.finditer(t):
            inside = m[1] or m[2] or m[3]
            sure = m[1] is not None or bool(re.search(r"[\\^_=+<>{}]|\d", inside)) or len(inside.split()) <= 3
            g.add(*m.span(), "latex", "formula", None, _cost("formula" if sure else "display"), ("formula", inside.strip(), m[3] is None, m.span()))
            if sure:  # else what stands inside is looked at as well
                tex_lines.append(m.start())
                gone.append(m.span())
        t = _holes(t, gone)
        gone = []
        for m in INLINE_MATH.finditer(t):
            inside = m[1]
            found = re.findall(r"[A-Za-z]{3,}", re.sub(r"\\[A-Za-z]+", "", inside))
            facts = ["word"] * len(found)
            if re.search(r"\\[A-Za-z]+|[\^_={}+<>]", inside):
                facts.append("TeX sign")
            if len(inside) <= 3 and not inside[0].isdigit():
                facts.append("one symbol")
            if re.match(r"\d[\d.,]*(\s|$)", inside) and found:
                facts.append("amount")
            k = g.add(*m.span(), "latex", "formula", None, _cost("inline formula", *facts), ("formula", inside.strip(), False, m.span()))
            if g.spans[k].markup < g.spans[k].content:
                tex_lines.append(m.start())
                gone.append(m.span())
        t = _holes(t, gone)
        gone = []
        sure_end = -1
        for m in COMMAND.finditer(t):
            a, b = m.span()
            braces = b < len(t) and t[b] == "{"
            before = t[a - 1] if a else " "
            bare = m[1] in BARE_COMMANDS
            glued = before in (":", "\\") or before.isalnum() and not braces
            last = g.spans[-1] if g.spans else None
            chained = last is not None and last.kind == "command" and last.end == a and not braces
            end = _closing(t, b) if braces else b
            name = m[1]
            keep = "" if name in ("label", "ref", "cite", "vspace", "hspace", "usepackage", "documentclass") else ("…" if name in ("ldots", "dots", "cdots") else None)
            kind = "heading" if re.fullmatch(r"(sub)*section|chapter|part", name) else "item" if name == "item" else "command"
            k = g.add(a, end if keep == "" else b, "latex", kind, keep, _cost("command", "braces" if braces else "stands bare" if bare else None))
            if glued:
                g.edges.append((g.before(t, a), k, PATH))
            if chained:
                g.edges.append((k - 1, k, CHAIN))
            if (braces or bare) and not glued and not (chained and last.end != sure_end):
                tex_lines.append(a)
                gone.append((a, b))
                sure_end = b
        for m in TEX_ESCAPE.finditer(t):
            lo, hi = t.rfind("\n", 0, m.start()) + 1, t.find("\n", m.end())
            if any(lo <= x < (hi if hi >= 0 else len(t)) for x in tex_lines):
                g.add(*m.span(), "latex", "escape", m[0][1], _cost("tex escape"))
                gone.append(m.span())
        t = _holes(t, gone)

    # wiki
    if "[[" in t or "{{" in t or "{|" in t or "''" in t or "[http" in t or "[ftp" in t or "[mailto" in t or "=" in t or "|-" in t:
        gone = []
        if "{|" in t or "|-" in t or "|}" in t:
            for m in WIKI_TABLE.finditer(t):
                g.add(*m.span(), "wiki", "table", None, _cost("wiki table"))
                gone.append(m.span())
            t = _holes(t, gone)
            gone = [(m.start(), m.end()) for m in WIKI_PIECE.finditer(t)]
            first = len(g.spans)
            for a, b in gone:
                g.add(a, b, "wiki", "table", "", _cost("wiki piece", "table edge" if t[a : a + 2] in ("{|", "|}") else None))
            g.edges += [(i, i + 1, PIECES) for i in range(first, len(g.spans) - 1)]
        if "=" in t:
            for m in WIKI_HEADING.finditer(t):
                g.add(*m.span(), "wiki", "heading", None, _cost("wiki heading", "one equals" if len(m[1]) < 2 else None))
                gone.append(m.span())
        t = _holes(t, gone)
        gone = []
        for m in WIKI_LINK.finditer(t):
            inside = m[1]
            odd = inside[0].isspace() or inside[-1:].isspace() or bool(re.match(r"[-!]\w?\s", inside)) or m.start() > 0 and t[m.start() - 1].isalnum() and inside.isdigit()
            keep = "" if re.match(r"(?i)(category|kategorie|catégorie|categoría|категория):", inside) else inside.rpartition("|")[2]
            g.add(*m.span(), "wiki", "link", keep, _cost("wiki link", "prose inside" if odd else None))
            gone.append(m.span())
        for m in WIKI_URL.finditer(t):
            g.add(*m.span(), "wiki", "link", m[2] or m[1], _cost("wiki address"))
            gone.append(m.span())
        for m in TEMPLATE.finditer(t):
            inside = m[1]
            odd = inside != inside.strip() and "|" not in inside or bool(re.match(r"[\s$%.#/>&]|.*[.()\[\]]", inside)) and "|" not in inside
            g.add(*m.span(), "wiki", "template", "", _cost("template", "code like" if odd else None))
            gone.append(m.span())
        t = _holes(t, gone)
        if "''" in t:
            gone = []
            for m in WIKI_EMPHASIS.finditer(t):
                g.add(*m.span(), "wiki", "emphasis", m[2], _cost("wiki emphasis"))
                gone.append(m.span())
            t = _holes(t, gone)

    _markdown(t, g)
    g.beside()
    return g


def parse(text: str) -> Parsed:
    """The constructs that are markup. One inside a formula or code that is markup is part of that."""
    g = propose(text)
    spans = [s for s, yes in zip(g.spans, g.labels()) if yes]
    whole = [s.own[3] for s in spans if s.own and s.own[0] == "formula" and s.kind == "formula"]
    if whole:
        spans = [s for s in spans if not any(a <= s.start and s.end <= b and (a, b) != (s.start, s.end) for a, b in whole)]
    return Parsed(text, spans)


def _closing(t: str, at: int) -> int:
    """The end of the braces that open at ``at``; ``at`` itself if they never close."""
    depth = 0
    for i in range(at, len(t)):
        depth += (t[i] == "{") - (t[i] == "}")
        if depth == 0:
            return i + 1
    return at


def _markdown(t: str, g: Graph) -> None:
    lines = t.split("\n")
    at, last, above = 0, {}, (0, 0)
    kinds: list[str] = []
    for n, line in enumerate(lines):
        kind, cost, breaks = "", (0.0, 0.0), 0.0
        prev, plain = (lines[n - 1] if n else ""), not (kinds[-1] if kinds else "")
        open_line = bool(prev.strip()) and plain  # a paragraph that this line would break into
        if not line or line[0] == HOLE or not line.strip():
            kinds.append("")
            above = (at, at + len(line))
            at += len(line) + 1
            continue
        c = line.lstrip()[0]
        if c == "#" and (m := ATX.match(line)):
            kind, cost = "heading", _cost("heading", None if m[2] else "no title")
        elif c in "=-" and UNDERLINE.match(line) and prev.strip() and plain and not prev.lstrip().startswith(("|", ">")):
            kind, cost = "underline", _cost("underline", None if len(line.strip()) >= 2 else "one sign")
        elif c in "-*_" and RULE.match(line):
            kind, cost = "rule", _cost("rule")
        elif c in "-+*" and (m := BULLET.match(line)):
            kind, cost, breaks = "bullet", _cost("bullet"), BREAKS_WITH_WORD if re.match(r"[a-zA-Z(`*_\[]", m[4]) and c != "+" else BREAKS
        elif c.isdigit() and (m := NUMBER.match(line)):
            kind, cost, breaks = "number", _cost("number"), 0.0 if m[2] == "1" else BREAKS_WITH_NUMBER
        elif c == ">" and (m := QUOTE.match(line)):
            kind, cost, breaks = "quote", _cost("quote"), 0.0 if m[1][:1].isalpha() else BREAKS_WITH_NUMBER
        elif "|" in line and c in "|:-" and DELIMITER.match(line) and "-" in line and ("|" in prev or line.count("|") > 1):
            kind, cost = "table", _cost("delimiter")
        elif c == "|" and PIPES.match(line) and line.count("|") >= 2:
            kind, cost = "table", _cost("row", None if line.count("|") >= 3 else "one cell")
        elif "|" in line and n + 1 < len(lines) and "|" in lines[n + 1] and DELIMITER.match(lines[n + 1]) and "-" in lines[n + 1]:
            kind, cost = "table", _cost("open row")
        elif c == "[" and DEFINITION.match(line):
            kind, cost = "definition", _cost("definition")
        kinds.append(kind)
        if kind:
            k = g.add(at, at + len(line), "markdown", kind, None, cost)
            if breaks and open_line:
                g.edges.append((g.run(*above), k, breaks))
            if kind in last and last[kind][0] >= n - 2 and kind in ("bullet", "number", "table", "quote"):
                g.edges.append((last[kind][1], k, ROWS))
            last[kind] = (n, k)
        above = (at, at + len(line))
        at += len(line) + 1
    gone: list[tuple[int, int]] = []
    if "](" in t or "][" in t:
        for m in LINK.finditer(t):
            target = m[3] if m[3] is not None else m[4]
            k = g.add(*m.span(), "markdown", "image" if m[1] else "link", m[2], _cost("link" if target is not None else "loose link", "no text" if m[3] is not None and not m[3] and not m[2] else None))
            if m.start() > 0 and t[m.start() - 1].isalnum() and not m[1]:
                g.edges.append((g.before(t, m.start()), k, GLUED_INDEX))
            gone.append(m.span())
        t = _holes(t, [(m[0], m[1]) for m in gone])
    if "[^" in t:
        for m in FOOTNOTE.finditer(t):
            k = g.add(*m.span(), "markdown", "footnote", "", _cost("footnote"))
            if m.start() > 0 and t[m.start() - 1] == "[":
                g.edges.append((g.before(t, m.start()), k, GLUED_NOTE))
    gone = []
    if "\\" in t:
        for m in ESCAPE.finditer(t):
            k = g.add(*m.span(), "markdown", "escape", m[0][1], _cost("escape", "two backslashes" if m[0] == "\\\\" else None))
            if m.start() > 1 and t[m.start() - 1] == ":" and t[m.start() - 2].isalpha():
                g.edges.append((g.before(t, m.start()), k, DRIVE))
            gone.append(m.span())
        t = _holes(t, gone)
    for sign, pattern in (("*", STARS), ("_", LOW_LINES), ("~~", STRIKE)):
        if sign in t:
            for m in pattern.finditer(t):
                g.add(*m.span(), "markdown", "emphasis", m[2], _cost("emphasis", "digits only" if re.fullmatch(r"[\d\s.,x*+-]*\d[\d\s.,x*+-]*", m[2]) else None))


def families(text: str | None) -> list[str]:
    """Families of markup in a text; none for a null or empty one."""
    if not text:
        return []
    have = {s.family for s in parse(_one_line_end(text)).spans}
    return [f for f in FAMILIES if f in have]


def _one_line_end(text: str) -> str:
    return text.replace("\r\n", "\n").replace("\r", "\n") if "\r" in text else text


class Piece(NamedTuple):
    kind: str  # heading, list_item, code, formula, table_row, quote, paragraph
    level: int  # of a heading; 0 elsewhere
    text: str


def clean(text: str | None) -> list[Piece]:
    """Clean text in pieces that keep what is a heading, a list entry, code, a formula, a table row or a quote.

    Only what is labelled markup is touched. A null or empty text has no pieces; any code point may occur in a text.
    """
    if not text:
        return []
    p = parse(_one_line_end(text))
    t, spans = p.text, p.spans
    edits: list[tuple[int, int, list]] = []  # a stretch and what stands for it: texts, openings of pieces, whole pieces
    taken: list[tuple[int, int]] = []

    def put(a: int, b: int, *items) -> None:
        edits.append((a, b, list(items)))

    for s in spans:  # code and formulas as they are
        if not s.own:
            continue
        if s.own[0] == "code":
            a, b = (s.own[1], s.own[2]) if s.family == "html" else s.own[3] if len(s.own) > 3 else (s.start, s.end)
            inside = t[s.own[1] : s.own[2]]
            if s.family == "html":
                inside = html.unescape(re.sub(r"</?code[^>]*>", "", inside))
            if s.kind == "inline":
                put(a, b, inside.strip())
            elif s.family == "html" and "\n" not in inside and s.keep is not None and not t.startswith(("<pre", "<PRE"), s.start):
                put(a, b, inside.strip())
            else:
                put(a, b, Piece("code", 0, inside.strip("\n")))
        else:
            _, inside, apart, (a, b) = s.own
            put(a, b, Piece("formula", 0, inside) if apart else f"${inside}$")
        taken.append((a, b))
    taken.sort()

    def free(s: Span) -> bool:
        i = bisect_right(taken, (s.start, len(t) + 1)) - 1
        return not (i >= 0 and taken[i][0] <= s.start < taken[i][1])

    # of a footnote's definition only the label goes; the reference that is seen in it goes with it
    notes = {s.start: m.end() for s in spans if s.kind == "definition" and (m := NOTE_LABEL.match(t, s.start, s.end))}
    in_label = {t.index("[", a) for a in notes}
    for s in spans:
        if s.kind in ("fence", "inline", "formula") or not free(s) or s.kind == "footnote" and s.start in in_label:
            continue
        piece = t[s.start : s.end]
        if s.family == "html" and s.kind == "tag" and (m := re.match(r"<(h([1-6])|li|tr)\b", piece, re.I)):
            put(s.start, s.end, Opening("heading", int(m[2])) if m[2] else Opening("list_item" if m[1].lower() == "li" else "table_row"))
        elif s.family == "wiki" and s.kind == "heading":
            m = WIKI_HEADING.match(piece)
            put(s.start, s.start + m.start(2), Opening("heading", len(m[1])))
            put(s.start + m.end(2), s.end, "\n")
        elif s.family == "wiki" and s.kind == "table":
            rows = [re.sub(r"\s*(\|\||!!)\s*", " ", re.sub(r"^[|!]\s*", "", x)) for x in piece.split("\n") if not re.match(r"\s*(\{\||\|\}|\|-|$)", x)]
            put(s.start, s.end, *(x for r in rows for x in (Opening("table_row"), r)), "\n")
        elif s.family == "latex" and s.kind in ("heading", "item"):
            head = s.kind == "heading"
            _braces(put, t, s, Opening("heading", 1 + piece.count("sub")) if head else Opening("list_item"), "\n" if head else "")
        elif s.family == "latex" and s.keep is None:
            _braces(put, t, s, "", "")
        elif s.family == "markdown" and s.kind == "heading":
            m = ATX.match(piece)
            put(s.start, s.start + (m.start(2) if m[2] is not None else len(piece)), Opening("heading", len(m[1])))
            put(s.start + (m.end(2) if m[2] is not None else len(piece)), s.end, "\n")
        elif s.kind == "underline":
            start = t.rfind("\n", 0, max(s.start - 1, 0)) + 1
            put(start, start, Opening("heading", 1 if "=" in piece else 2))
            put(s.start, s.end)
        elif s.kind in ("bullet", "number"):
            m = BULLET.match(piece) if s.kind == "bullet" else NUMBER.match(piece)
            put(s.start, s.start + m.start(m.lastindex), Opening("list_item"))
        elif s.kind == "quote":
            put(s.start, s.start + QUOTE.match(piece).start(1), Opening("quote"))
        elif s.kind == "table" and s.family == "markdown":
            if DELIMITER.match(piece):
                put(s.start, s.end)
            else:
                put(s.start, s.start, Opening("table_row"))
                for i, x in enumerate(piece):
                    if x == "|":
                        put(s.start + i, s.start + i + 1, " ")
        elif s.kind == "definition" and s.start in notes:
            put(s.start, notes[s.start], "\n")
        elif s.kind in ("rule", "definition"):
            put(s.start, s.end)
        elif s.kind == "emphasis":
            size = (len(piece) - len(s.keep)) // 2
            put(s.start, s.start + size)
            put(s.end - size, s.end)
        elif s.family == "markdown" and s.kind in ("link", "image"):
            i = s.start + (2 if s.kind == "image" else 1)
            put(s.start, i)
            put(i + len(s.keep), s.end)
        elif s.keep is not None:
            put(s.start, s.end, s.keep)
    out, at = Assembly(), 0
    for a, b, items in sorted(edits, key=lambda e: (e[0], e[1])):
        if a >= at:
            out.add(t[at:a])
            for x in items:
                out.add(x)
            at = b
    out.add(t[at:])
    out.flush()
    return out.pieces


def _braces(put, t: str, s: Span, before, after: str) -> None:
    """Edits that take off a command and the braces of its last argument."""
    if s.end < len(t) and t[s.end] == "{" and (end := _closing(t, s.end)) > s.end:
        put(s.start, s.end + 1, before)
        put(end - 1, end, after)
    else:
        put(s.start, s.end, before)


class Opening(NamedTuple):
    """Where a piece of a kind begins: always on a line of its own."""

    kind: str
    level: int = 0


class Assembly:
    """Pieces out of texts, openings and whole pieces that come one after another."""

    def __init__(self) -> None:
        self.pieces: list[Piece] = []
        self.line: list[str] = []
        self.kind, self.level, self.lines = "paragraph", 0, []

    def flush(self) -> None:
        """End the piece that is being read."""
        self.lines.append("".join(self.line).strip())
        self.line = []
        text = re.sub(r"[ \t]+", " ", " ".join(x for x in self.lines if x)).strip()
        if text:
            self.pieces.append(Piece(self.kind, self.level, text))
        self.kind, self.level, self.lines = "paragraph", 0, []

    def add(self, item: str | Opening | Piece) -> None:
        if isinstance(item, str):
            first, *more = item.split("\n")
            self.line.append(first)
            for x in more:
                self._end_line()
                self.line.append(x)
        elif isinstance(item, Opening):
            self.flush()
            self.kind, self.level = item
        else:
            self.flush()
            self.pieces.append(item)

    def _end_line(self) -> None:
        text = "".join(self.line).strip()
        self.line = []
        if text:
            self.lines.append(text)
        if not text or self.kind == "heading":
            self.flush()
