"""Documents to blocks and markers, one narrow projection per document: no shuffle, no Python.

A document is a row with a key and ``text``. Null texts have no blocks. Line numbers start at 1 and hold for the text
as delivered, front matter included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import body_hash, fold_lines, strip_edges, strip_markers

# The marker grammar and the front matter rules.
MARKER = r"(?s)<!--\s*(?:stay:.*?)\s*-->|\{/\*\s*(?:stay:.*?)\s*\*/\}"
BODY = r"(?s)^(?:<!--|\{/\*)\s*(stay:.*?)\s*(?:-->|\*/\})$"
ID = r"^stay:\s*([A-Za-z0-9_-]+)(?:\s|$)"
HASH = r"\bhash\s*=\s*sha256:([0-9a-fA-F]+)"
SUBHASH = r"\bsubhash\s*=\s*sha256:([0-9a-fA-F]+)"
OPENS = r"(?d)^---[ \t]*$"
CLOSES = r"(?d)^(---|\.\.\.)[ \t]*$"
YAMLISH = r"(?d)^[ \t]*(-[ \t]+[^\x00-\x20\x7f]|[^\x00-\x20\x7f:#][^:]*:([ \t]|$))"
NONBLANK = r"[^ \t\f\x0B]"
SPACED = r"\S"  # of the survival splitter

MARKER_TYPE = "array<struct<seq:int,id:string,hash:string,subhash:string,raw:string,syntax:string,line:int,malformed:boolean>>"


def _q(pattern: str) -> str:
    return "r'" + pattern + "'" if "'" not in pattern else "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def document_lines(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``lines``: the lines of the folded text, those of leading front matter emptied one for one.

    Front matter opens with ``---`` on line 1 and closes with the next ``---`` or ``...``; its inside has no blank line
    and at least one line that reads as YAML. Anything else is left alone, without a second try.
    """
    df = df.withColumn("__ls", F.split(fold_lines(F.col(text)), "\n", -1))
    closer = f"filter(transform(__ls, (x, i) -> IF(i > 0 AND x RLIKE {_q(CLOSES)}, i, -1)), i -> i > 0)[0]"
    df = df.withColumn("__c", F.expr(f"IF(__ls[0] RLIKE {_q(OPENS)}, {closer}, NULL)"))
    inside = "slice(__ls, 2, __c - 1)"
    ok = f"__c > 1 AND forall({inside}, x -> x RLIKE {_q(NONBLANK)}) AND exists({inside}, x -> x RLIKE {_q(YAMLISH)})"
    emptied = "concat(array_repeat('', __c + 1), slice(__ls, __c + 2, size(__ls)))"
    return df.withColumn("lines", F.expr(f"CASE WHEN {ok} THEN {emptied} ELSE __ls END")).drop("__ls", "__c")


def spans(df: DataFrame, nonblank: str = NONBLANK) -> DataFrame:
    """Adds ``chunks``: maximal runs of lines that are not blank, as (line, chunk)."""
    df = df.withColumn("__nb", F.expr(f"transform(lines, x -> x RLIKE {_q(nonblank)})"))
    first = "filter(transform(__nb, (b, i) -> IF(b AND (i = 0 OR NOT __nb[i - 1]), i, -1)), i -> i >= 0)"
    last = "filter(transform(__nb, (b, i) -> IF(b AND (i = size(__nb) - 1 OR NOT __nb[i + 1]), i, -1)), i -> i >= 0)"
    df = df.withColumn("__at", F.expr(f"arrays_zip({first}, {last})").cast("array<struct<a:int,b:int>>"))
    cut = "transform(__at, s -> struct(s.a + 1 AS line, array_join(slice(lines, s.a + 1, s.b - s.a + 1), '\n') AS chunk))"
    return df.withColumn("chunks", F.expr(cut)).drop("__nb", "__at")


def markers_of(chunk: str, line: str) -> str:
    """Expression for the markers of a chunk that starts at a line, in the order of position."""
    raws, pieces = f"regexp_extract_all({chunk}, {_q(MARKER)}, 0)", f"split({chunk}, {_q(MARKER)}, -1)"
    before = f"concat(array_join(slice({pieces}, 1, k + 1), ''), array_join(slice({raws}, 1, k), ''))"
    feeds = f"length({before}) - length(replace({before}, '\n', ''))"
    body = f"regexp_extract(r, {_q(BODY)}, 1)"
    return (
        f"IF({chunk} RLIKE {_q(MARKER)}, transform({raws}, (r, k) -> struct(k AS seq, "
        f"nullif(regexp_extract({body}, {_q(ID)}, 1), '') AS id, lower(nullif(regexp_extract({body}, {_q(HASH)}, 1), '')) AS hash, "
        f"lower(nullif(regexp_extract({body}, {_q(SUBHASH)}, 1), '')) AS subhash, r AS raw, "
        f"IF(r LIKE '<%', 'html', 'mdx') AS syntax, CAST({line} + {feeds} AS INT) AS line, "
        f"NOT {body} RLIKE {_q(ID)} AS malformed)), CAST(array() AS {MARKER_TYPE}))"
    )


def parse(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``blocks``: array of (pos, idx, line, content, markers).

    The content of a chunk is its text without markers and outer white space. A chunk without content gives its markers
    to the content block before it; where there is none it is a row of its own with idx -1.
    """
    df = spans(document_lines(df, text))
    df = df.withColumn("__cs", F.transform("chunks", lambda c: strip_edges(strip_markers(c["chunk"]))))
    df = df.withColumn("__ms", F.expr(f"transform(chunks, c -> {markers_of('c.chunk', 'c.line')})"))
    df = df.withColumn("__p", F.expr("filter(transform(__cs, (c, i) -> IF(c != '', i, -1)), i -> i >= 0)"))
    n_before = "IF(size(__p) > 0, __p[0], size(__cs))"
    orphans = f"transform(slice(chunks, 1, {n_before}), (c, i) -> struct(i AS pos, -1 AS idx, c.line AS line, '' AS content, __ms[i] AS markers))"
    own = "flatten(slice(__ms, p + 1, coalesce(try_element_at(__p, k + 2), size(__cs)) - p))"
    rows = f"transform(__p, (p, k) -> struct(CAST({n_before} + k AS INT) AS pos, CAST(k AS INT) AS idx, chunks[p].line AS line, __cs[p] AS content, {own} AS markers))"
    return df.withColumn("blocks", F.expr(f"concat({orphans}, {rows})")).drop("lines", "chunks", "__cs", "__ms", "__p")


def blocks(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """One row per block: keys, pos, idx, line, content, body_hash, markers.

    The outer form of the generator keeps the optimizer from inferring a filter on the array and copying the whole
    expression below every step of the parse.
    """
    rows = parse(df.select(*keys, text), text).select(*keys, F.inline_outer("blocks")).where("pos is not null")
    return rows.withColumn("body_hash", body_hash(F.col("content")))


def markers(block_rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per marker, with the pos and idx of its block and its place in the visit order of the document."""
    rows = block_rows.select(*keys, "pos", "idx", F.col("content").alias("__content"), F.posexplode("markers").alias("seq", "m"))
    return rows.select(*keys, "pos", "idx", "seq", "m.id", "m.hash", "m.subhash", "m.raw", "m.syntax", F.col("m.line").alias("line"), "m.malformed", "__content").withColumnRenamed("__content", "content")


def survival_spans(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Blocks of the survival study: runs of lines with any visible character, (line, chunk)."""
    rows = df.select(*keys, F.split(fold_lines(F.col(text)), "\n", -1).alias("lines"))
    return spans(rows, r"[^\s\x1c-\x1f\x85\xa0 -     　 ]").select(*keys, F.posexplode_outer("chunks").alias("pos", "c")).where("pos is not null").select(*keys, "pos", "c.line", "c.chunk")
