"""Top-level blocks and list items of CommonMark text by lines, for Arrow stages."""

from __future__ import annotations

import re

from .headings import HTML_BLOCKS

_FENCE = re.compile(r"( {0,3})(`{3,}|~{3,})(.*)$")
_ATX = re.compile(r" {0,3}#{1,6}(?:[ \t]|$)")
_RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_UNDER = re.compile(r" {0,3}(?:=+|-+)[ \t]*$")
_ITEM = re.compile(r"( {0,3})([*+-]|\d{1,9}[.)])([ \t]+|$)")
_QUOTE = re.compile(r" {0,3}>")
_LINKDEF = re.compile(r" {0,3}\[[^\]\[]+\]:[ \t]*\S+(?:[ \t]+(?:\"[^\"]*\"|'[^']*'|\([^()]*\)))?[ \t]*$")
_TAG = re.compile(r" {0,3}(?:<[A-Za-z][A-Za-z0-9-]*(?:\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:[^\s\"'=<>`]+|'[^']*'|\"[^\"]*\"))?)*\s*/?>|</[A-Za-z][A-Za-z0-9-]*\s*>)[ \t]*$")


def blank(line: str) -> bool:
    return not line.strip(" \t\f\v")


def width(line: str) -> int:
    """Columns of the indent, with tab stops of four."""
    n = 0
    for c in line:
        if c == " ":
            n += 1
        elif c == "\t":
            n += 4 - n % 4
        else:
            break
    return n


def _html(line: str):
    return next(((True, ends) for opens, ends in HTML_BLOCKS if opens.match(line)), (False, None))


def interrupts(line: str) -> bool:
    """Whether a line ends the paragraph before it."""
    if _FENCE.match(line) and not (_FENCE.match(line)[2][0] == "`" and "`" in _FENCE.match(line)[3]):
        return True
    item = _ITEM.match(line)
    number_ok = item and (not item[2][0].isdigit() or item[2][:-1] == "1") and not blank(line[item.end() :])
    return bool(_ATX.match(line) or _RULE.match(line) or _QUOTE.match(line) or number_ok or _html(line)[0])


def _fence_end(lines: list[str], i: int, limit: int) -> int:
    m = _FENCE.match(lines[i])
    for j in range(i + 1, limit):
        c = _FENCE.match(lines[j])
        if c and c[2][0] == m[2][0] and len(c[2]) >= len(m[2]) and not c[3].strip():
            return j + 1
    return limit


def _list_end(lines: list[str], i: int, limit: int) -> tuple[int, list[tuple[int, int]]]:
    """End of the list that begins at line i, and the spans of its own items."""
    kind = _ITEM.match(lines[i])[2][-1]
    items: list[tuple[int, int]] = []
    j = i
    while j < limit:
        m = _ITEM.match(lines[j])
        if not m or m[2][-1] != kind or _RULE.match(lines[j]):
            break
        rest = lines[j][m.end() :]
        gap = len(m[3].expandtabs(4)) if m[3] else 1
        need = len(m[1]) + len(m[2]) + (gap if 1 <= gap <= 4 and rest else 1)
        start, last, j = j, j + 1, j + 1
        open_text = bool(rest.strip()) and not (_FENCE.match(rest) or _ATX.match(rest))
        fence = _FENCE.match(rest)
        while j < limit:
            line = lines[j]
            if blank(line):
                if not rest.strip() and j == start + 1:
                    break
                open_text = False
                j += 1
                continue
            if width(line) >= need:
                body = line[need:] if line[:need].isspace() else line.lstrip()
                f = _FENCE.match(body)
                if fence:
                    if f and f[2][0] == fence[2][0] and len(f[2]) >= len(fence[2]) and not f[3].strip():
                        fence = None
                else:
                    fence = f
                open_text = not fence and not _ATX.match(body)
            elif fence or not open_text or interrupts(line) or _ITEM.match(line):
                break
            last = j = j + 1
        items.append((start, last))
        if j < limit and j > last and not (_ITEM.match(lines[j]) and _ITEM.match(lines[j])[2][-1] == kind):
            break
    return (items[-1][1] if items else i + 1), items


def top_level(lines: list[str]) -> list[tuple[int, int, str]]:
    """Top-level blocks as (first line, line after the last, kind), from 0. Link reference definitions are no blocks."""
    found: list[tuple[int, int, str]] = []
    i, n = 0, len(lines)
    while i < n:
        line = lines[i]
        if blank(line):
            i += 1
            continue
        j, kind = i + 1, "paragraph"
        fence = _FENCE.match(line)
        is_html, ends = _html(line)
        if width(line) >= 4:
            kind = "code"
            last = j
            while j < n and (blank(lines[j]) or width(lines[j]) >= 4):
                j += 1
                last = j if not blank(lines[j - 1]) else last
            j = last
        elif fence and not (fence[2][0] == "`" and "`" in fence[3]):
            kind, j = "fence", _fence_end(lines, i, n)
        elif _ATX.match(line):
            kind = "heading"
        elif _RULE.match(line):
            kind = "rule"
        elif _QUOTE.match(line):
            kind = "quote"
            text = not blank(_QUOTE.sub("", line, count=1))
            while j < n and not blank(lines[j]):
                if _QUOTE.match(lines[j]):
                    text = not blank(_QUOTE.sub("", lines[j], count=1))
                elif not text or interrupts(lines[j]):
                    break
                j += 1
        elif _ITEM.match(line):
            kind, j = "list", _list_end(lines, i, n)[0]
        elif is_html or _TAG.match(line):
            kind = "html"
            if is_html and ends is not None:
                k = i
                while k < n and not ends.search(lines[k]):
                    k += 1
                j = min(k + 1, n)
            else:
                while j < n and not blank(lines[j]):
                    j += 1
        else:
            while i < n and _LINKDEF.match(lines[i]):
                i += 1
            if i >= n or blank(lines[i]):
                continue
            j = i + 1
            while j < n and not blank(lines[j]):
                if _UNDER.match(lines[j]):
                    j, kind = j + 1, "heading"
                    break
                if interrupts(lines[j]):
                    break
                j += 1
        found.append((i, j, kind))
        i = j
    return found


def runs(lines: list[str]) -> list[tuple[int, int]]:
    """Runs of lines that are not blank, from 0, end excluded."""
    found, start = [], None
    for i, line in enumerate([*lines, ""]):
        if blank(line):
            if start is not None:
                found.append((start, i))
            start = None
        elif start is None:
            start = i
    return found
