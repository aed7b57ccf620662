"""Mixing sources to target weights: rates of repetition from sizes by source, whole copies and one drawn by hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored

#: A plan with at most so many rows is broadcast; it has one row per mix and source of a control table.
PLAN_ROWS = 10_000
SALTS = 32


def source_name(c: Column) -> Column:
    """A source in lower case without outer blanks; blank ones are no source."""
    return F.nullif(F.lower(F.regexp_replace(c, r"^\s+|\s+$", "")), F.lit(""))


def plan(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per mix and source: own size, target size, rate of repetition and whether the target is out of reach.

    ``sized`` has ``source`` and ``tokens``; ``targets`` has ``mix_id``, ``source``, ``target_weight``, ``max_repeats``
    and ``size_ratio``. The size of a mix is its ratio times the size of all rows with a source. Sources are compared in
    lower case without outer blanks. A source that stands twice in a mix counts with the sum of its weights and the
    larger cap. A source without rows has size 0 and any target of it is out of reach. Null or negative weights count
    as 0; a mix without weight has targets of 0.
    """
    per_source = sized.where("source is not null").groupBy("source").agg(F.sum("tokens").alias("own_size"))
    total = per_source.agg(F.sum("own_size").alias("total_size"))
    weight = F.greatest(F.coalesce("target_weight", F.lit(0.0)), F.lit(0.0))
    wanted = (
        targets.withColumn("source", source_name(F.col("source")))
        .where("source is not null and mix_id is not null")
        .groupBy("mix_id", "source")
        .agg(F.sum(weight).alias("weight"), F.max(F.coalesce("max_repeats", F.lit(0))).alias("max_repeats"), F.max("size_ratio").alias("size_ratio"))
    )
    sums = wanted.groupBy("mix_id").agg(F.sum("weight").alias("weights"))
    own = F.coalesce(F.col("own_size"), F.lit(0))
    joined = wanted.join(sums, "mix_id").join(per_source, "source", "left").join(F.broadcast(total))  # one row
    target = F.coalesce(F.col("weight") / F.nullif(F.col("weights"), F.lit(0.0)) * F.col("size_ratio") * F.col("total_size"), F.lit(0.0))
    rate = F.when(own > 0, F.least(target / own, F.col("max_repeats").cast("double"))).otherwise(0.0)
    return joined.select(
        "mix_id", "source", (F.col("weight") / F.nullif(F.col("weights"), F.lit(0.0))).alias("target_share"), target.alias("target_size"), own.alias("own_size"), "max_repeats", rate.alias("rate"), (target > own * F.col("max_repeats")).alias("short")
    )


def draw(sized: DataFrame, planned: DataFrame, seed: int = 0) -> DataFrame:
    """Rows (mix_id, id, source, tokens, copies): every document floor(rate) times, and once more with the probability
    of the rest, drawn by the hash of seed, mix and id. The same input gives the same draw on any cluster.

    ``sized`` has ``id``, ``source`` and ``tokens``. No source is gathered in one task: a small plan is broadcast, a
    large one is joined over salts.
    """
    rates = planned.select("mix_id", "source", "rate").where("rate > 0")
    docs = sized.where("source is not null").select("id", "source", "tokens")
    if rates.count() <= PLAN_ROWS:
        rows = docs.join(F.broadcast(rates), "source")
    else:
        salt = F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")
        rows = docs.withColumn("salt", salt).join(rates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["source", "salt"]).drop("salt")
    whole = F.floor("rate")
    unit = F.pmod(F.xxhash64(F.lit(seed), "mix_id", "id"), F.lit(1 << 40)) / float(1 << 40)
    copies = whole + F.when(unit < F.col("rate") - whole, 1).otherwise(0)
    return rows.select("mix_id", "id", "source", "tokens", copies.cast("int").alias("copies")).where("copies > 0")


def shares(planned: DataFrame, drawn: DataFrame) -> DataFrame:
    """Wanted and reached size and share of every source of every mix."""
    got = drawn.groupBy("mix_id", "source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("reached_size"), F.sum("copies").alias("n_records"))
    sums = got.groupBy("mix_id").agg(F.sum("reached_size").alias("mix_size"))
    rows = planned.join(got, ["mix_id", "source"], "left").join(sums, "mix_id", "left")
    reached = F.coalesce("reached_size", F.lit(0))
    return rows.select(
        "mix_id", "source", "target_share", "target_size", "own_size", "rate", "short", reached.alias("reached_size"),
        F.coalesce(reached / F.nullif(F.col("mix_size"), F.lit(0)), F.lit(0.0)).alias("reached_share"), F.coalesce("n_records", F.lit(0)).alias("n_records"),
    )


def sized_sources(documents: DataFrame, tokens: DataFrame) -> DataFrame:
    """Stored (id, source, tokens) of the documents; tokenizing is done once for plan and draw."""
    return stored(tokens.select(F.col("doc_id").alias("id"), source_name(F.col("source")).alias("source"), "tokens"), "sized")
