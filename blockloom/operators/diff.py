"""Two versions of documents compared by block id, in one full outer join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import body_hash, item_count


def id_index(block_rows: DataFrame, keys: list[str]) -> DataFrame:
    """Well-formed ids on content blocks: one row per document and id, with how many markers carry it, the place of the
    first and the content of its block."""
    rows = block_rows.where("idx >= 0").select(*keys, "idx", "content", F.posexplode("markers").alias("seq", "m")).where("m.id is not null and not m.malformed")
    return rows.groupBy(*keys, F.col("m.id").alias("id")).agg(F.count("*").alias("n"), F.min(F.struct("idx", "seq", "content")).alias("first")).select(*keys, "id", "n", F.struct("first.idx", "first.seq").alias("place"), "first.content")


def compare(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Findings between two id indexes (:func:`id_index`).

    The baseline holds only ids that stood exactly once before; an id that stood more often there is new afterwards.
    Dropped: in the baseline and gone. Duplicated: more than once afterwards. New: not in the baseline. Of ids that
    stand once in both with another body: relocated where that body belonged to another id of the baseline (its first
    one), else drifted. ``shrank`` tells how many table rows and bullets a kept block lost; see :func:`shrunk`.
    """
    b = before.where("n = 1").select(*keys, "id", F.col("place").alias("b_place"), F.col("content").alias("b_content"), body_hash(F.col("content")).alias("b_hash"))
    a = after.select(*keys, "id", F.col("n").alias("a_n"), F.col("place").alias("a_place"), F.col("content").alias("a_content"), body_hash(F.col("content")).alias("a_hash"))
    owner = b.groupBy(*keys, F.col("b_hash").alias("a_hash")).agg(F.min_by("id", F.struct("b_place", "id")).alias("owner"))
    both = b.join(a, [*keys, "id"], "full")
    return both.join(owner, [*keys, "a_hash"], "left")


def findings(compared: DataFrame, keys: list[str], check_collections: bool = False) -> DataFrame:
    """(keys, level, code, message, id) of a comparison; ``step`` and ``place`` give their order."""
    id_, s = F.col("id"), F.lit
    in_b, in_a = F.col("b_hash").isNotNull(), F.col("a_hash").isNotNull()
    one = in_a & in_b & (F.col("a_n") == 1)
    moved = one & (F.col("a_hash") != F.col("b_hash")) & (F.col("owner") != id_)
    n0, n1 = item_count(F.col("b_content")), item_count(F.col("a_content"))

    def finding(level: str, code: str, when: Column, *message: Column) -> Column:
        return F.when(F.coalesce(when, s(False)), F.struct(s(level).alias("level"), s(code).alias("code"), F.concat(*message).alias("message")))

    rows = [
        finding("error", "DROPPED_ID", in_b & ~in_a, s("id "), id_, s(" was in the baseline but is gone after the edit (silent loss)")),
        finding("error", "DUPLICATED_ID", F.col("a_n") > 1, s("id "), id_, s(" appears "), F.col("a_n").cast("string"), s(" times after the edit (copy without re-mint, or a regeneration collision)")),
        finding("info", "NEW_ID", in_a & ~in_b, s("id "), id_, s(" is new (not in the baseline)")),
        finding("error", "RELOCATED_ID", moved, s("id "), id_, s(" now sits on content that previously carried id "), F.col("owner"), s(" (markers look swapped or relocated)")),
        finding("warn", "HASH_DRIFT", one & (F.col("a_hash") != F.col("b_hash")) & ~F.coalesce(moved, s(False)), s("id "), id_, s(": content changed between versions (edited in place)")),
    ]
    if check_collections:
        rows.append(finding("error", "COLLECTION_SHRANK", one & (n0 > 0) & (n1 < n0), s("id "), id_, s(": collection shrank from "), n0.cast("string"), s(" to "), n1.cast("string"), s(" items (a table row or list bullet was dropped from inside the block)")))
    found = compared.select(*keys, "id", F.coalesce("a_place", "b_place").alias("place"), F.posexplode(F.array(*rows)).alias("step", "f")).where("f is not null")
    return found.select(*keys, "f.level", "f.code", "f.message", "id", F.lit(None).cast("int").alias("line"), F.struct("step", "place").alias("visit"))


def ground_truth(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Where each id must be found after an edit that kept its markers: (keys, id, gold_idx), without the ids that were
    dropped, duplicated or relocated."""
    kept = compare(before, after, keys).where("b_hash is not null and a_n = 1 and (a_hash = b_hash or owner is null or owner = id)")
    return kept.select(*keys, "id", F.col("a_place.idx").alias("gold_idx"))
