"""Splitting oversized texts at natural boundaries, by pointer doubling over tables of farthest successors."""

from __future__ import annotations

import re

import numpy as np

BLANKS = " \t\n\r\f\v"
LEVELS = ("paragraph", "line", "sentence", "word", "char")

_LINE = re.compile(r"\r\n|\r|\n")
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})(.*)$", re.S)
_CUTS = {"line": _LINE, "sentence": re.compile(r"\r\n|\r|\n|(?<=[.!?])(?=[ \t])|(?<=。)"), "word": re.compile(r"\r\n|\r|\n|[ \t]+")}


def _paragraph_cuts(text: str) -> list[tuple[int, int]]:
    """Empty or blank lines that are not inside fenced code."""
    cuts, at, fence = [], 0, None
    ends = [(m.start(), m.end()) for m in _LINE.finditer(text)] + [(len(text), len(text))]
    for a, b in ends:
        line = text[at:a]
        if m := _FENCE.match(line):
            if fence is None:
                if not (m[1][0] == "`" and "`" in m[2]):
                    fence = m[1]
            elif m[1][0] == fence[0] and len(m[1]) >= len(fence) and not m[2].strip():
                fence = None
        elif fence is None and not line.strip(BLANKS):
            cuts.append((at, b))
        at = b
    return cuts


def stretches(text: str, level: str) -> list[tuple[int, int]]:
    """What lies between the boundaries of a level, trimmed; empty stretches are left out."""
    cuts = _paragraph_cuts(text) if level == "paragraph" else [m.span() for m in _CUTS[level].finditer(text)]
    found, at = [], 0
    for a, b in [*cuts, (len(text), len(text))]:
        s, e = at, a
        while s < e and text[s] in BLANKS:
            s += 1
        while e > s and text[e - 1] in BLANKS:
            e -= 1
        if e > s:
            found.append((s, e))
        at = b
    return found


def choose(text: str, max_size: int, overlap: int) -> tuple[str, list[tuple[int, int]]]:
    """The coarsest level at which every stretch leaves room for the overlap, and the stretches to pack.

    Where even a word is too long, only such words are cut between characters.
    """
    room = max_size - overlap
    for level in LEVELS[:-1]:
        found = stretches(text, level)
        if all(e - s <= room for s, e in found):
            return level, found
    cut = []
    for s, e in found:
        cut += [(s, e)] if e - s <= room else [(x, min(x + 1, e)) for x in range(s, e)]
    return "char", cut


def greedy_cuts(starts: np.ndarray, ends: np.ndarray, max_size: int, overlap: int) -> np.ndarray:
    """Indices of the first stretch of every piece.

    The successor of stretch i is the first stretch that no longer fits a piece beginning at i with its overlap before
    it. Squaring that table doubles the steps it jumps, so that all cuts are known after log2(pieces) rounds.
    """
    n = len(starts)
    begin = np.where(np.arange(n) == 0, starts, np.maximum(starts - overlap, 0))
    jump = np.append(np.searchsorted(ends, begin + max_size, side="right"), n)
    cuts = np.zeros(1, dtype=np.int64)
    while True:
        more = jump[cuts]
        cuts = np.concatenate([cuts, more[more < n]])
        if more[-1] >= n:
            return cuts
        jump = jump[jump]


def split(text: str, max_size: int, overlap: int) -> tuple[str, list[tuple[int, int]]]:
    """Level of the boundaries and the pieces as (start, end) in code points.

    No piece is longer than ``max_size``. Each but the first begins ``overlap`` code points before the text that is new
    in it. Blanks at the edges of pieces are left out; nothing else is. A text of blanks only has no piece.
    """
    if not 0 <= overlap < max_size:
        raise ValueError("the overlap must be less than the size")
    level, found = choose(text, max_size, overlap)
    if not found:
        return level, []
    starts, ends = (np.array(x, dtype=np.int64) for x in zip(*found))
    cuts = greedy_cuts(starts, ends, max_size, overlap)
    last = np.append(cuts[1:], len(starts)) - 1
    return level, [(int(max(starts[i] - (overlap if i else 0), 0)), int(ends[j])) for i, j in zip(cuts, last)]
