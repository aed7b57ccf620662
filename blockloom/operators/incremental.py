"""Processing only new or changed records: the target is the state.

Every output row carries the key and version of the source row it came from. A run anti-joins the unseen source rows
against the published target, writes what is left as one more part of the target, and publishes that part by a single
rename of a log entry which fails if the entry exists. A run that dies before the rename leaves nothing that a reader
sees; the next run finds the same rows again. A run that is repeated after the rename finds its entry and does nothing.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import body_hash, clean_hash


class Target:
    """A table of published parts under ``path``: ``data/<part>`` holds rows, ``log/<n>.json`` makes a part visible."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._hpath("").getFileSystem(self._conf)

    def _hpath(self, sub: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{sub}" if sub else self.path)

    def entries(self) -> list[dict]:
        """Published log entries in order; one per run, so few."""
        log = self._hpath("log")
        if not self._fs.exists(log):
            return []
        names = sorted(n for s in self._fs.listStatus(log) if (n := s.getPath().getName()).endswith(".json") and not n.startswith("_"))
        found = []
        for n in names:
            stream = self._fs.open(self._hpath(f"log/{n}"))
            try:
                found.append(json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()))
            finally:
                stream.close()
        return found

    def read(self) -> DataFrame:
        parts = [f"{self.path}/data/{e['part']}" for e in self.entries()]
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*parts)

    def newest(self, keys: list[str]) -> tuple[DataFrame, int]:
        """The newest version of each key, and how many parts were read for it.

        The last compaction and the parts after it hold every newest version, so that what is read grows with the
        number of keys and not with the number of runs.
        """
        entries = self.entries()
        at = max((i for i, e in enumerate(entries) if e.get("state")), default=-1)
        parts = ([entries[at]["state"]] if at >= 0 else []) + [e["part"] for e in entries[at + 1 :]]
        if not parts:
            return latest(self.spark.createDataFrame([], self.schema), keys), 0
        return latest(self.spark.read.schema(self.schema).parquet(*(f"{self.path}/data/{p}" for p in parts)), keys), len(parts)

    def write_part(self, df: DataFrame) -> str:
        part = uuid.uuid4().hex
        df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema]).write.parquet(f"{self.path}/data/{part}")
        return part

    def publish(self, part: str, seen: int, **facts) -> None:
        """Make ``part`` visible as entry ``seen``; raises if another writer published that entry first."""
        self._fs.mkdirs(self._hpath("log"))
        tmp, final = self._hpath(f"log/_{part}.tmp"), self._hpath(f"log/{seen:010d}.json")
        out = self._fs.create(tmp, True)
        try:
            out.write(bytearray(json.dumps({"part": part} | facts).encode()))
        finally:
            out.close()
        gateway = self.spark.sparkContext._gateway
        rename = self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
        options = gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = rename.getEnumConstants()[0]  # NONE: never over an existing entry
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self._conf).rename(tmp, final, options)


#: Parts that are read for the newest versions before a run writes them as one.
COMPACT = 16


def latest(target: DataFrame, keys: list[str]) -> DataFrame:
    """The newest version of each key in the target."""
    return target.groupBy(*keys).agg(F.max(F.struct("version", "body")).alias("t")).select(*keys, F.col("t.version").alias("t_version"), F.col("t.body").alias("t_body"))


def fresh_rows(source: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose newest version in ``source`` is not among those of ``known`` (from :func:`latest`), with ``changed``
    where the body differs too.

    ``source`` has the keys, ``version`` and ``body``. Repeated rows collapse before the shuffle, so that a hot key
    costs one row per task. Of rows with the same key and version the greater body stands, whatever their order; a null
    version is lower than any other; a null body is a body of its own. The anti-join on (key, version) is written as an
    outer join with a filter, which keeps the superseded body at hand in the same shuffle.
    """
    new = source.groupBy(*keys).agg(F.max(F.struct("version", "body")).alias("s")).select(*keys, F.col("s.version").alias("version"), F.col("s.body").alias("body"))
    old = known.withColumn("known", F.lit(True)).withColumnsRenamed({k: f"t_{k}" for k in keys})
    on = [new[k].eqNullSafe(old[f"t_{k}"]) for k in keys]
    newer = F.col("known").isNull() | (F.struct("version", "body") > F.struct("t_version", "t_body"))
    changed = F.col("known").isNull() | ~F.col("body").eqNullSafe(F.col("t_body"))
    return new.join(old, on, "left").where(newer).select(*keys, "version", "body", changed.alias("changed"))


class IncrementalRun:
    """Runs over an append-only delivery log. ``arrived`` is the column that tells when a row could be seen first."""

    def __init__(self, spark: SparkSession, path: str, key_types: dict[str, T.DataType], version: T.DataType, body: T.DataType):
        self.keys = list(key_types)
        fields = [T.StructField(k, t) for k, t in key_types.items()]
        fields += [T.StructField("version", version), T.StructField("body", body), T.StructField("changed", T.BooleanType()), T.StructField("run_id", T.LongType())]
        self.target = Target(spark, path, T.StructType(fields))

    def run(self, source: DataFrame, run_id: int, upto: int, arrived: str, prepare=None, before_publish=None, lag: int | None = None) -> bool:
        """Process what arrived up to ``upto`` (microseconds since 1970) and is not in the target; False if this run was published before.

        The anti-join against the target decides what is new, so that a row that becomes visible late is found whatever
        its arrival time. ``lag`` (microseconds) is for a source that is partitioned by arrival and whose rows are
        visible at most so long after it: then rows that arrived longer than that before the last published run are
        not read again. Rows without an arrival time were never seen. ``prepare`` turns source rows into keys, version and
        body; ``before_publish`` is a hook for fault tests.
        """
        entries = self.target.entries()
        if any(e["run_id"] == run_id for e in entries):
            return False
        seen = source.where(F.col(arrived) <= F.timestamp_micros(F.lit(upto)))
        if entries and lag is not None:
            seen = seen.where(F.col(arrived) > F.timestamp_micros(F.lit(entries[-1]["upto"] - lag)))
        known, n_parts = self.target.newest(self.keys)
        rows = fresh_rows(prepare(seen) if prepare else seen, known, self.keys)
        part = self.target.write_part(rows.withColumn("run_id", F.lit(run_id)))
        facts = {}
        if n_parts >= COMPACT:
            new = self.target.spark.read.schema(self.target.schema).parquet(f"{self.target.path}/data/{part}")
            before = known.select(*self.keys, F.col("t_version").alias("version"), F.col("t_body").alias("body"))
            both = latest(before.unionByName(new.select(*self.keys, "version", "body")), self.keys).withColumnsRenamed({"t_version": "version", "t_body": "body"})
            facts["state"] = self.target.write_part(both.withColumns({"changed": F.lit(False), "run_id": F.lit(run_id)}))
        if before_publish:
            before_publish()
        self.target.publish(part, len(entries), run_id=run_id, upto=upto, **facts)
        return True

    def changes(self) -> DataFrame:
        """New or changed records by run."""
        return self.target.read().where("changed").select("run_id", *self.keys, "version", "body")


def chunk_records(chunks: DataFrame) -> DataFrame:
    """Deliveries of chunks as keys, version and body. Rows with a null or empty id are left out.

    The body is the stored hash in its one form, or that of the text where it is missing; kept as 32 bytes.
    """
    digest = F.coalesce(clean_hash(F.col("body_hash")), body_hash(F.col("text")))
    return chunks.where("id is not null and id != ''").select(
        F.regexp_replace("source", r"^(\./)+", "").alias("source"), "id", F.col("rev").alias("version"), F.unhex(digest).alias("body")
    )


def replay_runs(chunks: DataFrame, runs: DataFrame, path: str) -> IncrementalRun:
    """Every successful run of the log in the order of its start, against one target under ``path``.

    In this log a row is visible from ``loaded_at`` on, so that the lag is none.

    The run log is control data of a few rows, read by the driver as a scheduler would. Runs without a start are no runs.
    """
    state = IncrementalRun(chunks.sparkSession, path, {"source": T.StringType(), "id": T.StringType()}, T.IntegerType(), T.BinaryType())
    log = runs.where("status = 'ok' and started_at is not null").select("run_id", F.unix_micros("started_at").alias("at")).distinct().orderBy("at", "run_id")
    for r in log.toLocalIterator():
        state.run(chunks, r["run_id"], r["at"], "loaded_at", chunk_records, lag=0)
    return state

