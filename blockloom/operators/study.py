"""The resolver under edits: cells by document and edit, arms of heading preference, margins."""

from __future__ import annotations

import copy
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.headings import canonical_path
from ..functions.similarity import Texts, match_form, reaches
from ..functions.text import body_hash
from ..session import stored
from . import perturb, resolve, score, segment

# Arms of heading preference as (name, clamp, mode, weight, gate).
ARMS = [
    ("A", True, "off", 0.0, None), ("A'", False, "off", 0.0, None), ("B06", False, "bonus", 0.06, None), ("B06c", True, "bonus", 0.06, None), ("B12", False, "bonus", 0.12, None),
    ("B12c", True, "bonus", 0.12, None), ("B12u", False, "bonus", 0.12, 0.0), ("B12cu", True, "bonus", 0.12, 0.0), ("D06c", True, "penalty", 0.06, None), ("D12c", True, "penalty", 0.12, None),
    ("D12", False, "penalty", 0.12, None), ("C", False, "filter", 0.0, None), ("Cc", True, "filter", 0.0, None),
]
CONTROL = "A"
# Fixed value: edits that were thought of after results had been seen.
POST_HOC = ("cross_section_move_edit",)


class Study:
    """Documents annotated and edited once; every setting of the resolver reads the same stored versions."""

    def __init__(self, documents: DataFrame, keys: list[str], ops: list[str], strip: bool = True, paths: bool = False):
        self.keys, self.all, self.paths = keys, ["op", *keys], paths
        base = stored(perturb.annotate(segment.blocks(documents, keys), keys), "annotated")
        before = base.select(*keys, perturb.serialize(F.col("pb"), False).alias("text"))
        applied = None
        for op in ops:
            one = perturb.apply(base, keys, op)
            applied = one if applied is None else applied.unionByName(one)
        self.applied = stored(applied, "applied")
        anchors = resolve.anchors(segment.blocks(before, keys), keys)
        if paths:
            anchors = anchors.join(resolve.heading_paths(before, keys), [*keys, "line"])
        self.anchors = stored(anchors, "anchors").withColumn("op", F.explode(F.array(*map(F.lit, ops))))
        self.blocks = self._after(strip)
        self.truth = stored(perturb.truth_rows(self.applied, keys), "truth")

    def _after(self, strip: bool) -> DataFrame:
        """Blocks of the edited versions, without or with their markers."""
        after = self.applied.select(*self.all, perturb.serialize(F.col("pb"), strip).alias("text"))
        blocks = segment.blocks(after, self.all)
        if self.paths:
            blocks = blocks.join(resolve.heading_paths(after, self.all), [*self.all, "line"])
        # hashes take more room than the texts once these are compressed, and are quickly made again
        return stored(blocks.drop("body_hash"), "after").withColumn("body_hash", body_hash(F.col("content")))

    def with_markers(self, strip: bool) -> Study:
        """The same edits with markers stripped or kept; what does not depend on that is not made again."""
        other = copy.copy(self)
        other.blocks = self._after(strip)
        return other

    def scored(self, **setting) -> DataFrame:
        return score.scored(self.truth, resolve.resolve(self.anchors, self.blocks, self.all, **setting), self.all)

    def scored_under(self, settings: dict, name: str, control=None) -> DataFrame:
        """``scored`` under each of ``settings`` in one pass over the texts; column ``name`` holds their names.

        With ``control``, the name of a setting, ``was`` holds the category under it.
        """
        names = list(settings)
        rows = self.truth.join(resolve.resolve_under(self.anchors, self.blocks, self.all, list(settings.values())), [*self.all, "id"], "left")
        found = F.coalesce("found", F.array_repeat(F.lit(None).cast("struct<method:string,target:int,score:double>"), len(names)))
        was = score.category(F.col("accept"), F.get(found, names.index(control))["target"]) if control in names else F.lit(None).cast("string")
        each = rows.select(*self.all, "id", "accept", was.alias("was"), F.posexplode(found).alias("n", "r")).select("*", F.col("r.target").alias("target"))
        cat = score.category(F.col("accept"), F.col("target"))
        return each.select(*self.all, "id", cat.alias("cat"), F.coalesce("r.method", F.lit("detached")).alias("method"), "r.score", "target", F.get(F.array(*map(F.lit, names)), F.col("n")).alias(name), "was")


def arms(study: Study, names: list[str] | None = None) -> DataFrame:
    """(arm, keys, op, id, cat, was, ...) under every arm; ``was`` is the category under the control."""
    chosen = {name: dict(heading_mode=mode, weight=weight, clamp=clamp, gate=gate) for name, clamp, mode, weight, gate in ARMS if names is None or name in names}
    return study.scored_under(chosen, "arm", CONTROL)


def arm_report(scored: DataFrame, keys: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """Counts and rates by arm, with the recoveries of the control that an arm loses and the harm it adds, id by id."""
    bad = F.col("cat").isin("wrong", "false_attach") & ~F.col("was").isin("wrong", "false_attach")
    extra = [F.count_if((F.col("was") == "correct") & (F.col("cat") != "correct")).alias("lost"), F.count_if(bad).alias("unsafe")]
    return score.rates(score.tally(scored, [*by, "arm"], more=extra))


def margins(study: Study, values: tuple[float, ...] = (0.0, resolve.MARGIN)) -> DataFrame:
    """(margin, keys, op, id, cat, ...) under every margin."""
    return study.scored_under({m: dict(margin=m) for m in values}, "margin")


def margin_ablation(study: Study, values: tuple[float, ...] = (0.0, resolve.MARGIN)) -> DataFrame:
    """Counts and rates by margin."""
    return score.rates(score.tally(margins(study, values), ["margin"]))


def planned(scored: DataFrame) -> DataFrame:
    """Adds ``planned``: whether an edit was named before results were seen. Report such rows apart from all rows."""
    return scored.withColumn("planned", ~F.col("op").isin(*POST_HOC))


def vetoes(report: DataFrame, by: tuple[str, ...] = ("op",)) -> DataFrame:
    """Cells of an arm report that recover less or attach falsely more than the control."""
    return score.against_control(report, "arm", CONTROL, list(by)).where("veto")


def shape(documents: DataFrame, keys: list[str], n_ops: int, threshold: float = resolve.THRESHOLD) -> DataFrame:
    """What documents hold for the study: blocks, distinct heading paths, blocks with a rival under another path, blocks
    with rivals in their own section only, and uncontested ones. A rival is another block that scores at least the threshold.

    A document is one row of an Arrow stage; bounds by letters and length keep most pairs from an exact score.
    """
    blocks = segment.blocks(documents, keys).where("idx >= 0").select(*keys, "idx", "line", "content")
    rows = blocks.join(resolve.heading_paths(documents, keys), [*keys, "line"]).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("idx", "content", "path"))).alias("bs"))
    kept = rows.schema.fields[:-1]
    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)

    def one(bs: list[dict]) -> tuple[int, int, int, int]:
        near, paths = Texts([match_form(b["content"]) for b in bs]), [canonical_path(b["path"]) for b in bs]
        forms, cross, same = near.forms, 0, 0
        for i, f in enumerate(forms):

            def rival(others: list[int], f: str = f) -> bool:
                return any(reaches(f, forms[j], threshold) for j in others)

            def close(limits: list[float], others: list[int], f: str = f) -> list[int]:
                return sorted((j for j in others if limits[j] >= threshold or f in forms[j] or forms[j] in f), key=lambda j: -limits[j])

            likely = [j for j in near.relatives(i) if paths[j] != paths[i]]
            if f and rival(likely):
                cross += 1
                continue
            others = close(near.by_letters(f), [j for j in range(len(forms)) if f and forms[j] and j != i and j not in likely])
            if len(others) > near.FEW:
                others = close(near.by_order(f), others)
            if rival([j for j in others if paths[j] != paths[i]]):
                cross += 1
            elif rival([j for j in others if paths[j] == paths[i]]):
                same += 1
        return len(bs), len(set(paths)), cross, same

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = list(zip(*map(one, b.column(b.num_columns - 1).to_pylist()))) or [()] * 4
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(c, pa.int64()) for c in cols)], names=[*(f.name for f in kept), "blocks", "distinct_paths", "cross_section", "same_section"])

    made = rows.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", blocks long, distinct_paths long, cross_section long, same_section long")
    return made.select("*", (F.col("blocks") - F.col("cross_section") - F.col("same_section")).alias("uncontested"), (F.col("cross_section") * n_ops).alias("cross_section_cases"), (F.col("same_section") * n_ops).alias("same_section_cases"))
