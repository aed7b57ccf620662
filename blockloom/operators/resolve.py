"""Where the ids of an earlier version are now: by marker, by unique hash, by quote, or nowhere.

Tiers one and two are joins. What they leave goes to an Arrow stage that scores it against the blocks of its document.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.headings import canonical_path, paths_by_line
from ..functions.similarity import Candidates
from ..functions.text import window_prefix, window_suffix
from ..session import stored
from .segment import document_lines

THRESHOLD, MARGIN, BONUS = 0.5, 0.05, 0.12
MODES = ("off", "bonus", "penalty", "filter")
SHARE = 64  # anchors of a document that are scored in one row


def anchors(block_rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per well-formed marker on a content block: full hash, quote, 48 characters of either neighbour."""
    order = Window.partitionBy(*keys).orderBy("idx")
    rows = block_rows.where("idx >= 0").withColumn("prefix", window_prefix(F.lag("content", 1, "").over(order))).withColumn("suffix", window_suffix(F.lead("content", 1, "").over(order)))
    each = rows.select(*keys, "idx", "line", "body_hash", "content", "prefix", "suffix", F.posexplode("markers").alias("seq", "m")).where("m.id is not null and not m.malformed")
    return each.select(*keys, F.col("m.id").alias("id"), F.col("body_hash").alias("hash"), F.col("content").alias("quote"), "prefix", "suffix", "idx", "seq", "line")


def heading_paths(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, line, path) of every line, from an Arrow stage over whole documents."""
    rows = document_lines(df.select(*keys, text).where(F.col(text).isNotNull()), text).select(*keys, "lines")
    kept = rows.schema.fields[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths = pa.array([paths_by_line(x) for x in b.column(b.num_columns - 1).to_pylist()], pa.list_(pa.list_(pa.string())))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], paths], names=[*(f.name for f in kept), "paths"])

    made = rows.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", paths array<array<string>>")
    return made.select(*keys, F.posexplode("paths").alias("at", "path")).select(*keys, (F.col("at") + 1).alias("line"), "path")


def by_marker_and_hash(anchor_rows: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Anchors with ``method``, ``target`` and ``score`` where a marker survived or exactly one block has the hash.

    ``after`` holds the blocks of the later version. Several ids may come to one block. Of anchors with the same id in a
    document the last one stands.
    """
    last = Window.partitionBy(*keys, "id").orderBy(F.desc("idx"), F.desc("seq"))
    a = anchor_rows.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n")
    content = after.where("idx >= 0")
    marks = content.select(*keys, F.col("idx").alias("at"), F.explode("markers").alias("m")).where("m.id is not null and not m.malformed")
    marker = marks.groupBy(*keys, F.col("m.id").alias("id")).agg(F.min("at").alias("by_marker"))
    one = content.groupBy(*keys, F.col("body_hash").alias("hash")).agg(F.count("*").alias("n"), F.min("idx").alias("by_hash")).where("n = 1").drop("n")
    rows = a.join(marker, [*keys, "id"], "left").join(one, [*keys, "hash"], "left")
    method = F.when(F.col("by_marker").isNotNull(), "marker").when(F.col("by_hash").isNotNull(), "hash")
    return rows.withColumn("method", method).withColumn("target", F.coalesce("by_marker", "by_hash")).withColumn("score", F.when(method.isNotNull(), 1.0)).drop("by_marker", "by_hash")


def resolve(anchor_rows: DataFrame, after: DataFrame, keys: list[str], threshold: float = THRESHOLD, margin: float = MARGIN, heading_mode: str = "off", weight: float = BONUS, clamp: bool = True, gate: float | None = None) -> DataFrame:
    """(keys, id, method, target, score) of every id; detached ids have no target and the best score there was.

    ``heading_mode`` needs a ``path`` column (array of titles) on both sides; its weight acts on candidates whose body
    score reaches ``gate`` (the threshold if not given). Anchors that no marker and no hash settles
    are scored in rows of at most SHARE of a document, so that a large document is spread over tasks.
    """
    rows = resolve_under(anchor_rows, after, keys, [dict(threshold=threshold, margin=margin, heading_mode=heading_mode, weight=weight, clamp=clamp, gate=gate)])
    return rows.select(*keys, "id", F.col("found")[0]["method"].alias("method"), F.col("found")[0]["target"].alias("target"), F.col("found")[0]["score"].alias("score"))


def resolve_under(anchor_rows: DataFrame, after: DataFrame, keys: list[str], settings: list[dict]) -> DataFrame:
    """(keys, id, found): an array of (method, target, score), what ``resolve`` gives under each of ``settings``.

    The tiers and the scores of bodies do not depend on the setting, so they are made once for all of them.
    """
    defaults = dict(threshold=THRESHOLD, margin=MARGIN, heading_mode="off", weight=BONUS, clamp=True, gate=None)
    settings = [defaults | s for s in settings]
    if any(s["heading_mode"] not in MODES or s.keys() != defaults.keys() for s in settings):
        raise ValueError(f"settings are of {list(defaults)}; heading_mode must be one of {MODES}")
    has_path = any(s["heading_mode"] != "off" for s in settings)
    texts = ["quote", "prefix", "suffix", *["path"] * has_path]  # needed where no tier has settled an anchor
    tiers = by_marker_and_hash(anchor_rows, after, keys)
    tiers = stored(tiers.select(*keys, "id", "method", "target", "score", *[F.when(F.col("method").isNull(), F.col(c)).alias(c) for c in texts]), "tiers")  # read twice
    one = F.struct("method", F.col("target").cast("int").alias("target"), "score")
    done = tiers.where("method is not null").select(*keys, "id", F.array_repeat(one, len(settings)).alias("found"))
    path = F.coalesce("path", F.array().cast("array<string>")) if has_path else F.array().cast("array<string>")
    left = tiers.where("method is null").select(*keys, F.struct("id", "quote", "prefix", "suffix", path.alias("path")).alias("a"), F.row_number().over(Window.partitionBy(*keys).orderBy("id")).alias("n"))
    shares = left.groupBy(*keys, F.floor((F.col("n") - 1) / SHARE).alias("share")).agg(F.collect_list("a").alias("anchors"))
    blocks = after.where("idx >= 0").select(*keys, F.struct("idx", "content", path.alias("path")).alias("b")).groupBy(*keys).agg(F.sort_array(F.collect_list("b")).alias("blocks"))
    rows = shares.join(blocks, keys, "left").select(*keys, "anchors", F.coalesce("blocks", F.array().cast("array<struct<idx:int,content:string,path:array<string>>>")).alias("blocks"))
    kept = rows.schema.fields[:-2]
    # scores cost far more than moving texts, so the tasks are as many as the session shuffles to, whatever the size
    rows = rows.withColumn("__deal", F.xxhash64(*keys, F.get("anchors", 0)["id"])).repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "__deal").drop("__deal")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {f.name: [] for f in kept} | {"id": [], "found": []}
            for r in b.to_pylist():
                near = Candidates([x["content"] for x in r["blocks"]], [canonical_path(x["path"]) for x in r["blocks"]])
                for a in r["anchors"]:
                    own, each = canonical_path(a["path"]), []
                    for s in settings:
                        gate = s["threshold"] if s["gate"] is None else s["gate"]
                        i, score, runner = near.best(a["quote"] or "", a["prefix"] or "", a["suffix"] or "", own, s["heading_mode"], s["weight"], gate, s["clamp"], s["threshold"], s["margin"])
                        sure = i >= 0 and score >= s["threshold"] and score - runner >= s["margin"]
                        each.append({"method": "quote" if sure else "detached", "target": r["blocks"][i]["idx"] if sure else None, "score": score})
                    for f in kept:
                        out[f.name].append(r[f.name])
                    out["id"].append(a["id"])
                    out["found"].append(each)
            types = [b.schema.field(f.name).type for f in kept] + [pa.string(), pa.list_(pa.struct({"method": pa.string(), "target": pa.int32(), "score": pa.float64()}))]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types)], names=list(out))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", id string, found array<struct<method:string,target:int,score:double>>"
    return done.unionByName(rows.mapInArrow(run, schema))
