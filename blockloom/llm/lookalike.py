"""One form for texts that look the same.

Compatibility forms of width, ligature and presentation are folded, ignorable characters deleted, spaces unified and
accents composed. Each token then becomes a lattice of the look-alike letters of Latin, Cyrillic and Greek; a Viterbi
search takes the path with the best character bigram score that changes script least. The lattice depends on nothing
but the looks of a token, so that tokens that look the same get the same form.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from functools import lru_cache

# Letters of Cyrillic and Greek and the Latin letters that look like them.
CYRILLIC = ("АВЕЅІЈКМНОРСТУХҮԌԚԜѴаеѕіјорсухүһԁԛԝӏѵ", "ABESIJKMHOPCTYXYGQWVaesijopcyxyhdqwlv")
GREEK = ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϳαοριυνγϲ", "ABEZHIKMNOPTYXCjaopiuvyc")

SCRIPTS = ("latin", "cyrillic", "greek")
_TO_LATIN = dict(zip(CYRILLIC[0], CYRILLIC[1])) | dict(zip(GREEK[0], GREEK[1]))
_FORMS: dict[str, list[tuple[int, str]]] = {}
for _s, (_own, _latin) in ((1, CYRILLIC), (2, GREEK)):
    for _c, _l in zip(_own, _latin):
        _FORMS.setdefault(_l, [(0, _l)]).append((_s, _c))
_SINGLES = str.maketrans({"\u2010": "-", "\u2011": "-"})
_FOLD = {"<wide>", "<narrow>", "<initial>", "<medial>", "<final>", "<isolated>", "<noBreak>", "<vertical>"}

ASCII_BLANK = re.compile(r"[ \t\n\r\f\v]+")
SPACE = re.compile(r"[\s\x1c-\x1f\x85᠎⠀ㅤﾠᅟᅠ]+")
TOKEN = re.compile(r"[^\W\d_]+(?:[̀-ͯ]+[^\W\d_]*)*")
SWITCH = 12.0  # cost of a change of script inside a token, in nats


def _ignorable(c: str) -> bool:
    o = ord(c)
    return (
        unicodedata.category(c) == "Cf"
        or o in (0x034F, 0x17B4, 0x17B5)
        or 0x180B <= o <= 0x180F
        or 0xFE00 <= o <= 0xFE0F
        or 0xE0000 <= o <= 0xE0FFF
        or (unicodedata.category(c) == "Cc" and c not in "\t\n\r\f\v\x1c\x1d\x1e\x1f\x85")
    )


@lru_cache(maxsize=65536)
def _one(c: str) -> str:
    """A character without what does not show: width, presentation form, ligature; nothing of an ignorable one."""
    if _ignorable(c):
        return ""
    d = unicodedata.decomposition(c)
    if d.startswith("<"):
        tag, _, rest = d.partition(" ")
        to = "".join(chr(int(x, 16)) for x in rest.split())
        if tag in _FOLD or tag == "<compat>" and not any(x.isspace() for x in to) and not any(unicodedata.combining(x) for x in to):
            return "".join(_one(x) for x in to) if to != c else to
    return c


_ODD = re.compile(r"[^\x20-\x7e\n\t\r]")


def fold(text: str) -> str:
    """Width, ignorable characters, spaces and accents folded; letters keep their script. Runs of space become one."""
    if _ODD.search(text):
        text = _ODD.sub(lambda m: _one(m[0]), text).translate(_SINGLES)
        text = unicodedata.normalize("NFC", text)
    return SPACE.sub(" ", text).strip(" ")


def script(c: str) -> int:
    """0 Latin, 1 Cyrillic, 2 Greek, 3 any other."""
    o = ord(c)
    if o < 0x250 or 0x1E00 <= o < 0x1F00 or 0x2C60 <= o < 0x2C80 or 0xA720 <= o < 0xA800:
        return 0
    if 0x400 <= o < 0x530 or 0x1C80 <= o < 0x1C90 or 0x2DE0 <= o < 0x2E00 or 0xA640 <= o < 0xA6A0:
        return 1
    if 0x370 <= o < 0x400 or 0x1F00 <= o < 0x2000:
        return 2
    return 3


def bigrams(texts, counts: Counter) -> None:
    """Add the bigrams of all words of one script in the texts, with ``^`` before the first letter.

    Words of scripts without look-alikes are not counted, so that there are no more bigrams than pairs of letters of
    three alphabets.
    """
    words: Counter = Counter()
    for t in texts:
        if t:
            words.update(TOKEN.findall(fold(t)))
    for w, n in words.items():
        scripts = {script(c) for c in w}
        if len(scripts) == 1 and 3 not in scripts:
            before = "^"
            for c in w:
                counts[before + c] += n
                before = c


class Canon:
    """Canonical forms under a bigram model ``{two characters: count}``."""

    def __init__(self, counts: dict[str, int]):
        self.counts = counts
        self.first: Counter = Counter()
        for pair, n in counts.items():
            self.first[pair[0]] += n
        self.cache: dict[str, str] = {}

    def score(self, a: str, b: str) -> float:
        return math.log((self.counts.get(a + b, 0) + 0.05) / (self.first.get(a, 0) + 50.0))

    def token(self, word: str) -> str:
        found = self.cache.get(word)
        if found is None:
            if len(self.cache) > 200_000:  # a cache only: what is dropped is found again
                self.cache.clear()
            found = self.cache[word] = self._search(word)
        return found

    def _search(self, word: str) -> str:
        base = unicodedata.normalize("NFD", word)
        lattice = []
        for c in base:
            key = _TO_LATIN.get(c, c)
            lattice.append(_FORMS.get(key) or [(script(c) if unicodedata.category(c) != "Mn" else -1, c)])
        best: dict[tuple[int, str], tuple[float, str]] = {(-1, "^"): (0.0, "")}
        for options in lattice:
            new: dict[tuple[int, str], tuple[float, str]] = {}
            for s, c in options:
                top = None
                for (ps, pc), (v, path) in best.items():
                    at = ps if s == -1 else s
                    w = v + self.score(pc, c) - (SWITCH if s >= 0 and ps >= 0 and ps != s else 0.0)
                    if top is None or w > top[0] + 1e-9:
                        top = (w, path + c, at)
                if (top[2], c) not in new or top[0] > new[top[2], c][0] + 1e-9:
                    new[top[2], c] = (top[0], top[1])
            best = new
        order = {-1: -1, 0: 0, 1: 1, 2: 2, 3: 3}
        (_, _), (_, path) = min(best.items(), key=lambda x: (-round(x[1][0], 6), order[x[0][0]]))
        return unicodedata.normalize("NFC", path)

    def text(self, text: str) -> str:
        """The form of a whole text: spaces single, all else as it looks."""
        return TOKEN.sub(lambda m: self.token(m[0]), fold(text))

    def key(self, text: str) -> str:
        """What two texts share if and only if they look the same, blanks aside."""
        return self.text(text).replace(" ", "")


def stored(text: str) -> str:
    """A text as stored, without ASCII blanks and line ends."""
    return ASCII_BLANK.sub("", text)
