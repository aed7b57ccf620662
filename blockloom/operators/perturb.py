"""Deterministic edits of documents with known truth.

A document is a row with ``pb``, its blocks as array of (text, ids). An edit gives the edited array as ``pb`` and
``truth``, an array of (id, accept, preferred) for ids whose home is not simply the block they sit on afterwards; a null
``accept`` means that the id must be detached. All edits are projections of one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import EPS, Texts, matched
from ..functions.text import block_id, body_hash, heading_level, kind

PB = "array<struct<text:string,ids:array<string>>>"
TRUTH = "array<struct<id:string,accept:array<int>,preferred:int>>"
# Words of the reworded copy.
SYNONYMS = {
    "messages": "records", "message": "record", "order": "request", "orders": "requests", "pipeline": "workflow", "validate": "check",
    "validation": "checking", "partner": "vendor", "product": "catalogue", "pricing": "price", "error": "fault", "errors": "faults",
    "stage": "step", "stages": "steps", "queue": "buffer", "backup": "archive", "data": "information", "configuration": "config",
    "files": "documents", "drive": "disk", "remote": "offsite", "repository": "repo", "repositories": "repos", "checklist": "list",
    "restore": "recovery", "coverage": "breadth", "confidence": "assurance", "persist": "store", "persistence": "storage",
    "downstream": "later", "consumers": "clients",
}
# The sentences that edits add.
ADDED = " This sentence was added by an editor."
NOTE = " A small clarifying note."
DISTRACTORS = (
    "This is an entirely new paragraph inserted by a later editor, describing unrelated background that did not exist before.",
    "Another new paragraph was added here to pad the document with additional context that no original marker should ever match.",
)


def rstrip(t: Column) -> Column:
    return F.regexp_replace(t, r"(?<!\s)\s+\z", "")


def paraphrase(t: Column) -> Column:
    """Synonyms for whole runs of letters, the first comma as ``and``, a note at the end. No synonym is itself replaced."""
    for word, other in SYNONYMS.items():
        t = F.regexp_replace(t, rf"(?<![A-Za-z])(?i:{word})(?![A-Za-z])", other)
    return F.concat(rstrip(F.regexp_replace(t, r"(?s)\A(.*?), ", "$1 and ")), F.lit(" (revised)"))


def drift(t: Column) -> Column:
    return F.concat(rstrip(F.regexp_replace(t, r"(?s)\A(.*?)the ", "$1each ")), F.lit(ADDED))


def annotate(block_rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per document with an id for every content block."""
    c = F.struct("idx", F.col("content").alias("text"), F.array(block_id(F.col("idx"), F.col("content"))).alias("ids"))
    rows = block_rows.where("idx >= 0").groupBy(*keys).agg(F.sort_array(F.collect_list(c)).alias("x"))
    return rows.select(*keys, F.transform("x", lambda b: F.struct(b["text"].alias("text"), b["ids"].alias("ids"))).alias("pb"))


def serialize(pb: Column, strip: bool) -> Column:
    """The document as text; without ``strip`` every id has a marker with a new hash under its block."""

    def part(b: Column) -> Column:
        marks = F.array_join(F.transform(b["ids"], lambda i: F.concat(F.lit("<!-- stay:"), i, F.lit(" hash=sha256:"), body_hash(b["text"], 4), F.lit(" -->"))), "\n")
        return F.when(F.size(b["ids"]) > 0, F.concat(b["text"], F.lit("\n"), marks)).otherwise(b["text"])

    return F.concat(F.array_join(F.transform(pb, (lambda b: b["text"]) if strip else part), "\n\n"), F.lit("\n"))


def block(text: Column, ids: Column | None = None) -> Column:
    return F.struct(text.alias("text"), (F.array().cast("array<string>") if ids is None else ids).alias("ids"))


def _para(b: Column) -> Column:
    return kind(b["text"]) == "para"


def _kept_para(b: Column) -> Column:
    return _para(b) & (F.size(b["ids"]) > 0)


def _positions(pb: Column, test) -> Column:
    """0-based positions of the blocks that pass."""
    return F.filter(F.transform(pb, lambda b, i: F.when(test(b, i), i).otherwise(-1)), lambda i: i >= 0)


def _part(pb: Column, start, length) -> Column:
    return F.slice(pb, start if isinstance(start, Column) else F.lit(start), F.greatest(length if isinstance(length, Column) else F.lit(length), F.lit(0)))


def _replace(pb: Column, at: Column, *new: Column, skip: int = 1) -> Column:
    """The array with ``skip`` blocks from 0-based ``at`` on replaced; unchanged where ``at`` is null."""
    put = F.concat(_part(pb, 1, at), F.array(*new) if new else F.array().cast(PB), _part(pb, at + 1 + skip, F.size(pb)))
    return F.when(at.isNull(), pb).otherwise(put)


def _first(pos: Column, n: int = 0) -> Column:
    return F.get(pos, n)


def _no_truth() -> Column:
    return F.array().cast(TRUTH)


def _detach(b: Column) -> Column:
    return F.coalesce(F.transform(b["ids"], lambda i: F.struct(i.alias("id"), F.lit(None).cast("array<int>").alias("accept"), F.lit(None).cast("int").alias("preferred"))), _no_truth())


def reorder(pb: Column) -> tuple[Column, Column]:
    return F.reverse(pb), _no_truth()


def edit_in_place(pb: Column) -> tuple[Column, Column]:
    return F.transform(pb, lambda b, i: F.when(_para(b) & (i % 2 == 1), block(drift(b["text"]), b["ids"])).otherwise(b)), _no_truth()


def heavy_paraphrase(pb: Column) -> tuple[Column, Column]:
    return F.transform(pb, lambda b: F.when(_kept_para(b), block(paraphrase(b["text"]), b["ids"])).otherwise(b)), _no_truth()


def split(pb: Column) -> tuple[Column, Column]:
    at = _first(_positions(pb, lambda b, i: _kept_para(b) & b["text"].contains(". ")))
    b = F.get(pb, at)
    cut = F.instr(b["text"], ". ")
    head, tail = F.concat(F.left(b["text"], cut - 1), F.lit(".")), F.substr(b["text"], cut + 2)
    truth = F.transform(b["ids"], lambda i: F.struct(i.alias("id"), F.array(at, at + 1).alias("accept"), at.alias("preferred")))
    return _replace(pb, at, block(head, b["ids"]), block(tail)), F.coalesce(truth, _no_truth())


def merge(pb: Column) -> tuple[Column, Column]:
    at = _first(_positions(pb, lambda b, i: _kept_para(b) & F.coalesce(_kept_para(F.get(pb, i + 1)), F.lit(False))))
    a, b = F.get(pb, at), F.get(pb, at + 1)
    both = block(F.concat(rstrip(a["text"]), F.lit(" "), F.regexp_replace(b["text"], r"\A\s+", "")), F.concat(a["ids"], b["ids"]))
    return _replace(pb, at, both, skip=2), _no_truth()


def delete(pb: Column) -> tuple[Column, Column]:
    at = _first(_positions(pb, lambda b, i: _kept_para(b)), 1)
    return _replace(pb, at), _detach(F.get(pb, at))


def insert(pb: Column) -> tuple[Column, Column]:
    a, b = (F.array(block(F.lit(t))) for t in DISTRACTORS)
    mid = F.floor(F.size(pb) / 2).cast("int")
    return F.concat(_part(pb, 1, 1), a, _part(pb, 2, mid - 1), b, _part(pb, mid + 1, F.size(pb))), _no_truth()


def decoy(pb: Column) -> tuple[Column, Column]:
    at = _first(_positions(pb, lambda b, i: _kept_para(b)))
    b = F.get(pb, at)
    return _replace(pb, at, block(F.concat(rstrip(b["text"]), F.lit(NOTE)), b["ids"]), block(paraphrase(b["text"]))), _no_truth()


def clone(pb: Column) -> tuple[Column, Column]:
    at = _first(_positions(pb, lambda b, i: _kept_para(b)))
    b = F.get(pb, at)
    return _replace(pb, at, b, block(b["text"])), _no_truth()


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once. A lambda evaluates what it closes over for each element, unless that is
    itself the variable of a lambda."""
    return F.get(F.transform(F.array(value), body), 0)


def _levels(pb: Column) -> Column:
    return F.transform(pb, lambda b: heading_level(b["text"]))


def _headings(levels: Column) -> Column:
    """0-based positions of the headings."""
    return F.filter(F.transform(levels, lambda v, i: F.when(v > 0, i).otherwise(-1)), lambda i: i >= 0)


def _moved(pb: Column, src: Column, b: Column) -> Column:
    """The array without the block at ``src``, and ``b`` before the last of the rest."""
    rest = _replace(pb, src)
    n = F.size(rest)
    return F.when(src.isNull(), pb).otherwise(F.concat(_part(rest, 1, n - 1), F.array(b), _part(rest, F.greatest(n, F.lit(1)), 1)))


def _later_blocks(pb: Column, levels: Column) -> Column:
    """0-based positions of blocks with ids, other than headings, that stand after the second heading."""
    first = _first(_headings(levels), 1)
    return _let(first, lambda second: _positions(pb, lambda b, i: (i > second) & (F.get(levels, i) == 0) & (F.size(b["ids"]) > 0)))


def cross_section_move(pb: Column) -> tuple[Column, Column]:
    at = _let(_levels(pb), lambda levels: _first(_later_blocks(pb, levels)))
    return _let(at, lambda src: _moved(pb, src, F.get(pb, src))), _no_truth()


def section_move(pb: Column) -> tuple[Column, Column]:
    def cut(levels: Column, heads: Column) -> Column:
        """Start and end of the section of the second of three or more headings."""
        start = F.when(F.size(heads) >= 3, F.get(heads, 1))
        after = F.filter(heads, lambda h: (h > start) & (F.get(levels, h) <= F.get(levels, start)))
        return F.struct(start.alias("start"), F.coalesce(F.get(after, 0), F.size(pb)).alias("end"))

    def moved(at: Column) -> Column:
        start, end = at["start"], at["end"]
        return F.when(start.isNull(), pb).otherwise(F.concat(_part(pb, 1, start), _part(pb, end + 1, F.size(pb)), _part(pb, start + 1, end - start)))

    return _let(_let(_levels(pb), lambda levels: _let(_headings(levels), lambda heads: cut(levels, heads))), moved), _no_truth()


def heading_rename(pb: Column) -> tuple[Column, Column]:
    def renamed(t: Column) -> Column:
        atx = F.regexp_extract(t, r"(?d)\A {0,3}(#{1,6})\s", 1)
        title = F.regexp_replace(F.trim(F.regexp_replace(F.regexp_extract(t, r"(?d)\A {0,3}#{1,6}\s+([^\n]*)", 1), r"#+\s*\z", "")), r"\s+\z", "")
        first, second = F.regexp_extract(t, r"\A([^\n]*)", 1), F.regexp_extract(t, r"\A[^\n]*\n([^\n]*)", 1)
        return F.when(atx != "", F.concat(atx, F.lit(" "), paraphrase(title))).otherwise(F.concat(paraphrase(first), F.lit("\n"), second))

    def every_second(heads: Column) -> Column:
        odd = F.filter(F.transform(heads, lambda h, k: F.when(k % 2 == 1, h).otherwise(-1)), lambda h: h >= 0)
        return _let(odd, lambda at: F.transform(pb, lambda b, i: F.when(F.array_contains(at, i), block(renamed(b["text"]), b["ids"])).otherwise(b)))

    return _let(_headings(_levels(pb)), every_second), _no_truth()


def heading_delete(pb: Column) -> tuple[Column, Column]:
    def second() -> Column:
        return _first(_headings(_levels(pb)), 1)

    return _let(second(), lambda at: _replace(pb, at)), _let(second(), lambda at: _detach(F.get(pb, at)))


def _least_rivalled(texts: list[str], candidates: list[int]) -> int | None:
    """The candidate whose greatest similarity to any other block is least; the first of equals, null without any."""
    near = Texts([" ".join(t.strip().lower().split()) for t in texts])
    forms, least, found = near.forms, 2.0, None
    for i in candidates:
        f = forms[i]
        if found is not None and any(matched(f, forms[j], enough=least * (len(f) + len(forms[j])) / 2 + EPS)[0] * 2.0 / (len(f) + len(forms[j])) >= least for j in near.relatives(i)):
            continue
        limits = sorted(((limit, j) for j, limit in enumerate(near.by_letters(f) if len(forms) <= near.FEW else near.by_order(f)) if j != i and forms[j]), reverse=True) if f else []
        most = 0.0
        for limit, j in limits:  # ends when no other can be nearer, or when this one cannot be the least
            if limit <= most or most >= least:
                break
            n = len(f) + len(forms[j])
            most = max(most, 2.0 * matched(f, forms[j], most * n / 2 - EPS, least * n / 2 + EPS)[0] / n)
        if most < least:
            least, found = most, i
    return found


def with_chosen_block(annotated: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``__src``, the block that ``cross_section_move_edit`` takes, in an Arrow stage over whole documents."""
    candidates = F.coalesce(_let(_levels(F.col("pb")), lambda levels: _later_blocks(F.col("pb"), levels)), F.array().cast("array<int>"))
    rows = annotated.withColumns({"__texts": F.transform("pb", lambda b: b["text"]), "__candidates": candidates})
    kept = annotated.schema.fields
    # scores cost far more than moving texts, so the tasks are as many as the session shuffles to, whatever the size
    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = len(kept)
            src = [_least_rivalled(t or [], c) for t, c in zip(b.column(n).to_pylist(), b.column(n + 1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(src, pa.int32())], names=[*(f.name for f in kept), "__src"])

    return rows.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", __src int")


def cross_section_move_edit(pb: Column) -> tuple[Column, Column]:
    """The block under a later heading that is least like any other, moved to the end and drifted."""
    src = F.col("__src")
    b = F.get(pb, src)
    return _moved(pb, src, block(drift(b["text"]), b["ids"])), _no_truth()


OPERATORS = {f.__name__: f for f in (reorder, edit_in_place, heavy_paraphrase, split, merge, delete, insert, decoy, clone)}
SECTION_OPERATORS = {f.__name__: f for f in (cross_section_move, cross_section_move_edit, section_move, heading_rename, heading_delete)}


def apply(annotated: DataFrame, keys: list[str], op: str) -> DataFrame:
    """(keys, op, pb, truth) after the edit. Documents that the edit does not apply to stay as they are."""
    pb, truth = (OPERATORS | SECTION_OPERATORS)[op](F.col("pb"))
    if op == "cross_section_move_edit":
        annotated = with_chosen_block(annotated, keys)
    # another name first: inside a lambda, ``pb`` would be the alias of the same projection and not the column below it
    return annotated.select(*keys, F.lit(op).alias("op"), pb.alias("__edited"), truth.alias("truth")).withColumnRenamed("__edited", "pb")


def truth_rows(applied: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, op, id, accept, preferred): the block an id sits on, unless the edit says otherwise."""
    own = applied.select(*keys, "op", "truth", F.posexplode_outer("pb").alias("pos", "b")).where("pos is not null")
    own = own.select(*keys, "op", "truth", "pos", F.explode("b.ids").alias("id"))
    plain = own.where(~F.exists("truth", lambda t: t["id"] == F.col("id"))).select(*keys, "op", "id", F.array("pos").alias("accept"), F.col("pos").alias("preferred"))
    special = applied.select(*keys, "op", F.inline_outer("truth")).where("id is not null")
    return plain.unionByName(special)
