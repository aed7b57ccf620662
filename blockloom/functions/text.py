"""Text and hash scalar functions as native column expressions.

All of them return null for a null text and accept empty and very long texts. Blank classes are spelled out in ASCII
because regular-expression classes differ between engines.
"""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = r"[ \t\f\x0B]"
EDGE = r"[ \t\n\r\f\x0B]"
WINDOW = 48  # code points of context kept on either side of a block

HTML_MARKER = r"(?s)<!--\s*(stay:.*?)\s*-->"
MDX_MARKER = r"(?s)\{/\*\s*(stay:.*?)\s*\*/\}"


def fold_lines(t: Column) -> Column:
    """CRLF and CR become LF."""
    return F.regexp_replace(t, r"\r\n?", "\n")


def normalize_body(t: Column) -> Column:
    """Line ends folded, blanks at line ends and empty edge lines dropped; inner empty lines and indents stay."""
    t = F.regexp_replace(fold_lines(t), rf"(?<!{BLANK}){BLANK}++(?=\n|\z)", "")
    return F.regexp_replace(t, r"\A\n+|(?<!\n)\n+\z", "")


def body_hash(t: Column, length: int = 0) -> Column:
    """Hex sha256 of the normalized body, cut to ``length`` digits unless that is 0."""
    h = F.sha2(normalize_body(t).cast("binary"), 256)
    return F.left(h, F.lit(length)) if length else h


def clean_hash(h: Column) -> Column:
    """A stored hash in its one form: lower case, no ``sha256:`` prefix, no outer blanks; empty becomes null."""
    return F.nullif(F.regexp_replace(F.lower(F.trim(h)), r"^sha256:", ""), F.lit(""))


def strip_markers(t: Column) -> Column:
    """Delete HTML markers, then MDX markers; the lines they stood on stay."""
    return F.regexp_replace(F.regexp_replace(t, HTML_MARKER, ""), MDX_MARKER, "")


def strip_edges(t: Column) -> Column:
    """Without ASCII white space at either end."""
    return F.regexp_replace(t, rf"\A{EDGE}+|(?<!{EDGE}){EDGE}+\z", "")


def match_normalize(t: Column) -> Column:
    """Stripped, runs of white space as one blank, A-Z (and nothing else) lowered."""
    one = F.regexp_replace(strip_edges(t), rf"{EDGE}+", " ")
    return F.translate(one, string.ascii_uppercase, string.ascii_lowercase)


def window_prefix(t: Column) -> Column:
    return F.right(t, F.lit(WINDOW))


def window_suffix(t: Column) -> Column:
    return F.left(t, F.lit(WINDOW))


def band_label(sim: Column) -> Column:
    """Half-open similarity bands."""
    return (
        F.when(sim < 0.3, "0.0-0.3")
        .when(sim < 0.5, "0.3-0.5")
        .when(sim < 0.7, "0.5-0.7")
        .when(sim < 0.9, "0.7-0.9")
        .when(sim < 1.01, "0.9-1.0")
        .otherwise("1.0-1.0")
    )


def lines(t: Column) -> Column:
    return F.split(t, "\n", -1)


ROW = r"^\s*\|.*\|\s*$"
DIVIDER = r"^\s*\|[\s:|\-]+\|\s*$"
BULLET = r"^\s*[-*+]\s+\S"


def collection_items(t: Column) -> Column:
    """Rows of tables and bullets, as an array of (kind, text).

    A row is a line in pipes that is not a divider, does not stand right above one and has a non-empty cell.
    """
    ls = lines(t)
    pairs = F.arrays_zip(ls.alias("line"), F.slice(F.concat(ls, F.array(F.lit(""))), F.lit(2), F.size(ls)).alias("below"))

    def row(p: Column) -> Column:
        return (
            p["line"].rlike(ROW)
            & ~p["line"].rlike(DIVIDER)
            & ~p["below"].rlike(DIVIDER)
            & (F.length(F.regexp_replace(p["line"], r"[|\s]", "")) > 0)
        )

    kept = F.filter(pairs, lambda p: row(p) | p["line"].rlike(BULLET))
    return F.transform(
        kept,
        lambda p: F.struct(
            F.when(p["line"].rlike(BULLET), "bullet").otherwise("row").alias("kind"), strip_edges(p["line"]).alias("text")
        ),
    )


def item_count(t: Column) -> Column:
    return F.coalesce(F.size(collection_items(t)), F.lit(0))


def kind(t: Column) -> Column:
    """What sort of block a text is, by its first signs."""
    s = F.ltrim(t)
    return (
        F.when(s.startswith("#"), "heading")
        .when(s.startswith("```"), "code")
        .when(s.startswith("|"), "table")
        .when(s.rlike(r"^(- |\* |\d+[.)])"), "list")
        .otherwise("para")
    )


def heading_level(t: Column) -> Column:
    """1-6 of an ATX heading, 1 or 2 of a two-line setext heading, else 0."""
    atx = F.regexp_extract(t, r"\A(#{1,6})(?:[ \t]|\z)", 1)
    under = F.regexp_extract(t, r"\A[^\n]*\S[^\n]*\n(=+|-+)[ \t]*\z", 1)
    return (
        F.when(F.length(atx) > 0, F.length(atx)).when(under.startswith("="), 1).when(under.startswith("-"), 2).otherwise(0)
    )


def block_id(pos: Column, t: Column) -> Column:
    return F.concat(F.lit("b"), pos.cast("string"), F.lit("-"), body_hash(t, 4))


def survival_id(pos: Column, t: Column) -> Column:
    """Id of the survival study: of the raw text, without normalization."""
    return F.concat(F.lit("blk"), pos.cast("string"), F.left(F.sha2(t.cast("binary"), 256), F.lit(4)))


def strip_outer_fence(t: Column) -> Column:
    """The inside of a text that is one fenced block as a whole, else the text."""
    inner = F.regexp_extract(t, r"(?s)\A\s*```[A-Za-z]*[ \t]*\n(.*?)\n```\s*\z", 1)
    return F.when(t.rlike(r"(?s)\A\s*```[A-Za-z]*[ \t]*\n.*?\n```\s*\z"), inner).otherwise(t)


def strip_headings(t: Column) -> Column:
    """Without ATX heading lines; three or more line ends become two."""
    kept = F.array_join(F.filter(lines(t), lambda x: ~x.rlike(r"^#{1,6}[ \t]")), "\n")
    return F.regexp_replace(kept, r"\n{3,}", "\n\n")


def visible_tags_removed(t: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(t, r"(?s)<!--.*?-->", ""), r"<[^>]+>", "")


def first_line(t: Column, width: int | None = None) -> Column:
    """First line of the stripped text, cut to ``width`` with an ellipsis."""
    x = strip_edges(F.element_at(lines(strip_edges(t)), 1))
    return x if width is None else F.when(F.length(x) > width, F.concat(F.left(x, F.lit(width - 1)), F.lit("…"))).otherwise(x)


def format_marker(id_: Column, hash_: Column | None = None, syntax: str = "html") -> Column:
    body = F.concat(F.lit("stay:"), id_)
    if hash_ is not None:
        body = F.concat(body, F.when(hash_.isNull(), "").otherwise(F.concat(F.lit(" hash=sha256:"), hash_)))
    head, tail = ("<!-- ", " -->") if syntax == "html" else ("{/* ", " */}")
    return F.concat(F.lit(head), body, F.lit(tail))


def percent(x: Column) -> Column:
    """Whole per cent, halves to even."""
    return F.bround(x * 100).cast("bigint")
