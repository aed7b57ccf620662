"""Streams of document versions: changes against the stored version, and findings that are reported once.

The last version of a document is the one with the highest version number, whatever order they arrive in, in one batch
or in several. Of one version the first batch that has it stands.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import cache, diff, segment
from ..operators.incremental import Target, latest
from ..functions.text import body_hash

KEYS = ["source"]
VERSIONS = T.StructType([T.StructField("source", T.StringType()), T.StructField("version", T.LongType())])


def chunk_index(versions: DataFrame) -> DataFrame:
    """(source, id, body_hash) of the newest version of each source in a batch."""
    newest = versions.groupBy("source").agg(F.max(F.struct("version", "text")).alias("x")).select("source", F.col("x.text").alias("text"))
    index = diff.id_index(segment.blocks(newest, KEYS), KEYS).where("n = 1")
    return index.select("source", "id", body_hash(F.col("content")).alias("body_hash"))


def unseen(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of a batch whose version is above the stored one of their source. A null version is lower than any other."""
    known = stored.groupBy("source").agg(F.max("version").alias("__stored")).withColumn("__known", F.lit(True))
    newer = F.col("__known").isNull() | (F.col("version") > F.col("__stored")) | (F.col("__stored").isNull() & F.col("version").isNotNull())
    return batch.join(known, "source", "left").where(newer).drop("__stored", "__known")


def upsert(target: Target):
    """A ``foreachBatch`` function: publishes what changed in a batch as one part of the target, once per batch id.

    The target's schema is source, id, version (long, the batch id), body (string, null for an evicted chunk) and action.
    The log entry also names a part with the version of every document of the batch, with ids or without, so that
    both become visible at once; a later batch drops rows that are not above it.
    """
    seen = Target(target.spark, target.path, VERSIONS)

    def stored() -> DataFrame:
        parts = [f"{target.path}/data/{e['versions']}" for e in target.entries() if "versions" in e]
        return target.spark.read.schema(VERSIONS).parquet(*parts) if parts else target.spark.createDataFrame([], VERSIONS)

    def run(batch: DataFrame, batch_id: int) -> None:
        if any(e["batch"] == batch_id for e in target.entries()):
            return
        old = latest(target.read(), ["source", "id"]).where("t_body is not null").select("source", "id", F.col("t_body").alias("body_hash"))
        batch = unseen(batch, stored())
        touched = batch.select("source").distinct()
        decided = cache.decide(old.join(touched, "source", "left_semi"), new := chunk_index(batch), KEYS).where("action != 'reuse'")
        rows = decided.join(new, ["source", "id"], "left").select("source", "id", F.lit(batch_id).cast("long").alias("version"), F.col("body_hash").alias("body"), "action")
        versions = seen.write_part(batch.groupBy("source").agg(F.max("version").alias("version")))
        target.publish(target.write_part(rows), len(target.entries()), batch=batch_id, versions=versions)

    return run


def report_once(findings: DataFrame) -> DataFrame:
    """(source, findings) whenever the set of findings of a source differs from the last one reported.

    ``findings`` is a stream of (source, finding); the state of a source is one digest.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        lines = sorted({x for f in frames for x in f["finding"].dropna()})
        now = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        if not state.exists or state.get[0] != now:
            state.update((now,))
            yield pd.DataFrame({"source": [key[0]], "findings": ["\n".join(lines)]})

    return findings.groupBy("source").applyInPandasWithState(step, "source string, findings string", "digest string", "append", GroupStateTimeout.NoTimeout)
