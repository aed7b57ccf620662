"""A commit as a whole: which document is compared with which, and which losses are moves.

``entries`` has commit_id, seq, status (A, M, D, R, C), src, dst, before and after.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from . import diff, lint, segment

SUFFIX = r"\.(md|markdown)$"
OWN = ".blockloom/"  # files of this tool are no documents
KEY = ["commit_id", "path"]


def is_markdown(path: Column) -> Column:
    return path.rlike(SUFFIX) & ~path.startswith(OWN)


def changed(entries: DataFrame) -> DataFrame:
    return entries.where((F.col("status") != "D") & is_markdown(F.col("dst")))


def deleted(entries: DataFrame) -> DataFrame:
    gone = (F.col("status") == "D") & is_markdown(F.col("src"))
    left = (F.col("status") == "R") & is_markdown(F.col("src")) & ~is_markdown(F.col("dst"))
    return entries.where(gone | left)


def ids_of(entries: DataFrame, path: str, text: str) -> DataFrame:
    """(commit_id, path, id) of the well-formed markers on content blocks."""
    docs = entries.select("commit_id", F.col(path).alias("path"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return stored(diff.id_index(segment.blocks(docs, KEY), KEY).select(*KEY, "id"), "ids")


def pairings(entries: DataFrame) -> DataFrame:
    """(commit_id, seq, dst, origin): the path whose earlier text is the baseline; null for a new document.

    A rename within Markdown has its old path, any other change but a copy its own. What is left takes, in the order of
    the entries, the deleted document that shares most ids with it and that no earlier entry took; the first of equals.
    Only pairs that share an id are looked at, and only the counts of a commit come together in one task.
    """
    c = changed(entries)
    own = F.when((F.col("status") == "R") & is_markdown(F.col("src")) & F.col("before").isNotNull(), F.col("src")).when(~F.col("status").isin("C", "R") & F.col("before").isNotNull(), F.col("dst"))
    direct = c.select("commit_id", "seq", "dst", own.alias("origin"))
    open_ = direct.where("origin is null")
    mine = ids_of(c, "dst", "after").withColumnRenamed("path", "dst").join(open_.select("commit_id", "seq", "dst"), ["commit_id", "dst"])
    gone = deleted(entries)
    theirs = ids_of(gone, "src", "before").withColumnRenamed("path", "src").join(gone.groupBy("commit_id", "src").agg(F.min("seq").alias("d_seq")), ["commit_id", "src"])
    overlap = mine.join(theirs, ["commit_id", "id"]).groupBy("commit_id", "seq", "dst", "src", "d_seq").agg(F.count("*").alias("n"))

    def greedy(f: pd.DataFrame) -> pd.DataFrame:
        taken: set[str] = set()
        out = []
        for (seq, dst), g in f.sort_values(["seq", "d_seq"]).groupby(["seq", "dst"], sort=False):
            best = None
            for r in g.itertuples():
                if r.src not in taken and (best is None or r.n > best.n):
                    best = r
            if best is not None:
                taken.add(best.src)
                out.append((f["commit_id"].iloc[0], seq, dst, best.src))
        return pd.DataFrame(out, columns=["commit_id", "seq", "dst", "claimed"])

    kind = entries.schema["commit_id"].dataType.simpleString()
    claimed = overlap.groupBy("commit_id").applyInPandas(greedy, f"commit_id {kind}, seq int, dst string, claimed string")
    return direct.join(claimed, ["commit_id", "seq", "dst"], "left").select("commit_id", "seq", "dst", F.coalesce("origin", "claimed").alias("origin"))


def findings(entries: DataFrame, check_collections: bool = False) -> DataFrame:
    """(commit_id, path, origin, level, code, message, id, line, moved_to) of all changed documents.

    ``moved_to`` names the other paths of the commit that carry a dropped id: then it moved and is no loss.
    """
    c = changed(entries)
    after = c.select("commit_id", F.col("dst").alias("path"), F.coalesce("after", F.lit("")).alias("text"))
    blocks = stored(segment.blocks(after, KEY), "blocks")
    own = lint.marker_findings(segment.markers(blocks, KEY), KEY).select(*KEY, "level", "code", "message", "id", "line")
    pairs = stored(pairings(entries).where("origin is not null").select("commit_id", F.col("dst").alias("path"), "origin"), "pairs")
    texts = entries.select("commit_id", F.col("src").alias("origin"), "before").where("before is not null").dropDuplicates(["commit_id", "origin"])
    before = pairs.join(texts, ["commit_id", "origin"]).select(*KEY, F.col("before").alias("text"))
    index = stored(diff.id_index(blocks, KEY), "index")
    compared = diff.compare(diff.id_index(segment.blocks(before, KEY), KEY), index.join(pairs.select(*KEY), KEY, "left_semi"), KEY)
    both = stored(own.unionByName(diff.findings(compared, KEY, check_collections).select(*KEY, "level", "code", "message", "id", "line")), "both")
    carried = index.select("commit_id", "id", F.col("path").alias("other"))
    drops = both.where("code = 'DROPPED_ID'").select(*KEY, "id").distinct()
    moved = drops.join(carried, ["commit_id", "id"]).where("other != path").groupBy(*KEY, "id").agg(F.array_join(F.sort_array(F.collect_set("other")), ", ").alias("moved_to"))
    rows = both.join(moved.withColumn("code", F.lit("DROPPED_ID")), [*KEY, "id", "code"], "left").join(pairs, KEY, "left")
    return rows.select(*KEY, "origin", "level", "code", "message", "id", "line", "moved_to")


def reports(found: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """Findings that stand, by label; the scope is applied after all documents have been looked at."""
    kept = found.where("moved_to is null")
    if scope is not None:
        kept = kept.join(scope.select("path").distinct(), "path", "left_semi")
    label = F.when(F.col("origin").isNull() | (F.col("origin") == F.col("path")), F.col("path")).otherwise(F.concat("path", F.lit(" (baseline "), F.col("origin"), F.lit(")")))
    return kept.select("commit_id", label.alias("label"), "level", "code", "message", "id", "line")


def move_notes(found: DataFrame) -> DataFrame:
    note = F.concat("id", F.lit(": moved out of "), F.coalesce("origin", "path"), F.lit(" into "), F.col("moved_to"), F.lit(" (still in this commit, not blocking)"))
    return found.where("moved_to is not null").select("commit_id", note.alias("note"))


def deletion_notes(entries: DataFrame) -> DataFrame:
    """Ids of deleted documents that no changed document carries; documents that served as a baseline are left out."""
    gone = deleted(entries)
    committed = ids_of(changed(entries), "dst", "after").select("commit_id", "id").distinct()
    served = pairings(entries).where("origin is not null").select("commit_id", F.col("origin").alias("path"))
    lost = ids_of(gone, "src", "before").join(served, KEY, "left_anti").join(committed, ["commit_id", "id"], "left_anti")
    per = lost.groupBy(*KEY).agg(F.sort_array(F.collect_set("id")).alias("ids"))
    kinds = gone.select("commit_id", F.col("src").alias("path"), "status", "dst").dropDuplicates(KEY)
    shown = F.concat(F.array_join(F.slice("ids", 1, 6), ", "), F.when(F.size("ids") > 6, ", ...").otherwise(""))
    n = F.size("ids").cast("string")
    renamed = F.concat("path", F.lit(": renamed to "), F.col("dst"), F.lit(", leaving Markdown tracking with "), n, F.lit(" stay(s) not carried by another Markdown file ("), shown, F.lit(")"))
    plain = F.concat("path", F.lit(": deleted with "), n, F.lit(" stay(s) that no staged file carries ("), shown, F.lit(")"))
    return per.join(kinds, KEY).select("commit_id", F.when(F.col("status") == "R", renamed).otherwise(plain).alias("note"))


def gate(found: DataFrame) -> DataFrame:
    """Per commit whether any finding that stands is an error."""
    return found.groupBy("commit_id").agg(F.bool_or((F.col("level") == "error") & F.col("moved_to").isNull()).alias("has_errors"))
