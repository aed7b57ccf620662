"""Chunks keyed by block id, and what to embed again when their source changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(block_rows: DataFrame, findings: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, reason) of documents that cannot be chunked: a fatal finding, a block without an id or with several."""
    fatal = findings.where("level = 'error' or code = 'HASH_DRIFT'").select(*keys, F.lit("finding").alias("reason"))
    n = F.size(F.filter("markers", lambda m: m["id"].isNotNull() & ~m["malformed"]))
    odd = block_rows.where("idx >= 0").withColumn("n", n).where("n != 1").select(*keys, F.when(F.col("n") == 0, "unstamped").otherwise("several ids").alias("reason"))
    return fatal.unionByName(odd).distinct()


def chunks(block_rows: DataFrame, findings: DataFrame, keys: list[str], strict: bool = False) -> DataFrame:
    """(keys, id, text, body_hash), one per block of documents without violations; ``strict`` raises where there are any."""
    bad = violations(block_rows, findings, keys)
    if strict and (first := bad.limit(1).collect()):
        raise ValueError(f"cannot chunk: {first[0].asDict()}")
    rows = block_rows.where("idx >= 0").join(bad.select(*keys).distinct(), keys, "left_anti")
    first_id = F.get(F.filter("markers", lambda m: m["id"].isNotNull() & ~m["malformed"]), 0)["id"]
    return rows.select(*keys, first_id.alias("id"), F.col("content").alias("text"), "body_hash")


def decide(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, id, action): reuse with the same hash, reembed if new or changed, evict if gone. Equal rows count once."""
    o = old.select(*keys, "id", F.col("body_hash").alias("o")).distinct()
    n = new.select(*keys, "id", F.col("body_hash").alias("n")).distinct()
    action = F.when(F.col("n").isNull(), "evict").when(F.col("o") == F.col("n"), "reuse").otherwise("reembed")
    return o.join(n, [*keys, "id"], "full").select(*keys, "id", action.alias("action"))


def decision_counts(decisions: DataFrame, keys: list[str]) -> DataFrame:
    n = [F.count_if(F.col("action") == a).alias(f"n_{a}") for a in ("reuse", "reembed", "evict")]
    return decisions.groupBy(*keys).agg(*n)


def composite_key(source: Column, id_: Column, hash_: Column) -> Column:
    return F.concat_ws(":", source.cast("string"), id_, hash_)


def sync(stored: DataFrame, incoming: DataFrame, source: str = "source") -> DataFrame:
    """(source, key, action) of an incremental load keyed by source, id and hash: skip, add, delete within the sources
    that come in."""
    key = composite_key(F.col(source), F.col("id"), F.col("body_hash")).alias("key")
    s = stored.join(incoming.select(source).distinct(), source, "left_semi").select(source, key, F.lit(1).alias("s")).distinct()
    i = incoming.select(source, key, F.lit(1).alias("i")).distinct()
    action = F.when(F.col("s").isNull(), "add").when(F.col("i").isNull(), "delete").otherwise("skip")
    return s.join(i, [source, "key"], "full").select(source, "key", action.alias("action"))


def reembed_parity(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Per document how many embeddings a key by content and a key by id cost after an edit."""
    by_hash = new.select(*keys, "body_hash").distinct().join(old.select(*keys, "body_hash").distinct(), [*keys, "body_hash"], "left_anti").groupBy(*keys).agg(F.count("*").alias("by_hash"))
    by_id = decide(old, new, keys).where("action = 'reembed'").groupBy(*keys).agg(F.count("*").alias("by_id"))
    return by_hash.join(by_id, keys, "full").select(*keys, F.coalesce("by_hash", F.lit(0)).alias("by_hash"), F.coalesce("by_id", F.lit(0)).alias("by_id"))


def duplicate_records(chunk_rows: DataFrame, keys: list[str]) -> DataFrame:
    """Records under either key: copies collapse by content and stay apart by id."""
    return chunk_rows.groupBy(*keys).agg(F.countDistinct("body_hash").alias("by_hash"), F.countDistinct("id").alias("by_id"))


def fake_embedding(hash_: Column) -> Column:
    """Eight numbers from the first bytes of a hash, for tests of the plumbing."""
    return F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.conv(F.substr(hash_, i * 2 + 1, F.lit(2)), 16, 10).cast("double") / 255)


def sections(chunk_rows: DataFrame, keys: list[str], section: Column, order: Column) -> DataFrame:
    """Chunks of a section as one, keyed by the ids and hashes of its members in order."""
    rows = chunk_rows.select(*keys, section.alias("section"), F.struct(order.alias("o"), "id", "body_hash", "text").alias("m"))
    per = rows.groupBy(*keys, "section").agg(F.sort_array(F.collect_list("m")).alias("ms"))
    members = F.array_join(F.transform("ms", lambda m: F.concat_ws(":", m["id"], m["body_hash"])), ",")
    return per.select(*keys, "section", F.sha2(members.cast("binary"), 256).alias("key"), F.size("ms").alias("n_members"), F.array_join(F.transform("ms", lambda m: m["text"]), "\n\n").alias("text"))
