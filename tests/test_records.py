"""Incremental runs and snapshot comparison."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blockloom.operators.incremental import IncrementalRun, Target, chunk_records, replay_runs
from blockloom.operators.snapshots import block_changes
from blockloom.session import scratch

DAY = dt.datetime(2031, 3, 1, tzinfo=dt.timezone.utc)
CHUNKS = "row_id long, id string, text string, body_hash string, source string, rev int, updated_at timestamp, loaded_at timestamp, version int, body string"
RUNS = "run_id int, started_at timestamp, finished_at timestamp, status string"


def chunk(n, id_, text, rev, day, source="a.md", digest=None):
    return (n, id_, text, digest, source, rev, None, DAY + dt.timedelta(days=day) if day is not None else None, 7, "clash")


def runs(spark, *rows):
    return spark.createDataFrame([(i, DAY + dt.timedelta(days=d), None, s) for i, d, s in rows], RUNS)


def found(state):
    return sorted((r.run_id, r.source, r.id) for r in state.changes().collect())


def test_late_repeated_and_failed(spark):
    rows = [
        chunk(1, "x", "one", 1, 0), chunk(1, "x", "one", 1, 0), chunk(2, "y", "one", 1, 0),
        chunk(3, "x", "two", 2, 2.5), chunk(4, "x", "one", 3, 3.5),  # went and came back between ok runs
        chunk(5, "y", "two", 3, 2.5), chunk(6, "y", "old", 2, 4.5),  # late row of an older revision
        chunk(7, "z", "new", 1, 4.5, "./a.md"), chunk(8, None, "x", 1, 0), chunk(9, "", "x", 1, 0), chunk(10, "w", None, 1, 0), chunk(11, "v", "never", 1, None),
    ]
    state = replay_runs(spark.createDataFrame(rows, CHUNKS), runs(spark, (1, 1, "ok"), (2, 3, "failed"), (3, 4, "ok"), (4, 5, "ok"), (5, 6, None)), scratch(spark, "t"))
    assert found(state) == [(1, "a.md", "w"), (1, "a.md", "x"), (1, "a.md", "y"), (3, "a.md", "y"), (4, "a.md", "z")]


def test_equal_body_advances_the_version(spark):
    rows = [chunk(1, "x", "one", 1, 0), chunk(2, "x", "one \r\n", 3, 2), chunk(3, "x", "between", 2, 4)]
    state = replay_runs(spark.createDataFrame(rows, CHUNKS), runs(spark, (1, 1, "ok"), (2, 3, "ok"), (3, 5, "ok")), scratch(spark, "t"))
    assert found(state) == [(1, "a.md", "x")]


def test_crash_before_publish_and_repeat(spark):
    path = scratch(spark, "t")
    df = spark.createDataFrame([chunk(1, "x", "one", 1, 0)], CHUNKS)
    upto = int((DAY + dt.timedelta(days=1)).timestamp() * 1e6)

    def new():
        return IncrementalRun(spark, path, {"source": T.StringType(), "id": T.StringType()}, T.IntegerType(), T.BinaryType())

    def crash():
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        new().run(df, 1, upto, "loaded_at", chunk_records, crash)
    assert new().changes().count() == 0
    assert new().run(df, 1, upto, "loaded_at", chunk_records)
    assert not new().run(df, 1, upto, "loaded_at", chunk_records)
    assert found(new()) == [(1, "a.md", "x")]


def _state(spark, path):
    return IncrementalRun(spark, path, {"source": T.StringType(), "id": T.StringType()}, T.IntegerType(), T.BinaryType())


def test_a_row_that_becomes_visible_late_is_found(spark):
    at = [int((DAY + dt.timedelta(days=d)).timestamp() * 1e6) for d in range(9)]
    rows = [chunk(1, "x", "one", 1, 0)]
    late = rows + [chunk(2, "y", "slow writer", 1, 0.5)]  # arrived before the first run, visible after it
    for lag, want in ((None, [(1, "a.md", "x"), (2, "a.md", "y")]), (0, [(1, "a.md", "x")]), (at[1] - at[0], [(1, "a.md", "x"), (2, "a.md", "y")])):
        state = _state(spark, scratch(spark, "t"))
        state.run(spark.createDataFrame(rows, CHUNKS), 1, at[1], "loaded_at", chunk_records, lag=lag)
        state.run(spark.createDataFrame(late, CHUNKS), 2, at[2], "loaded_at", chunk_records, lag=lag)
        assert found(state) == want


def test_compaction_changes_nothing(spark, monkeypatch):
    from blockloom.operators import incremental

    monkeypatch.setattr(incremental, "COMPACT", 2)
    state = _state(spark, scratch(spark, "t"))
    for day in range(1, 7):
        rows = [chunk(n, f"k{n % 3}", f"text {n}", n, n) for n in range(1, day)]
        state.run(spark.createDataFrame(rows, CHUNKS), day, int((DAY + dt.timedelta(days=day)).timestamp() * 1e6), "loaded_at", chunk_records)
    assert found(state) == [(n + 1, "a.md", f"k{n % 3}") for n in range(1, 6)]
    assert sum("state" in e for e in state.target.entries()) >= 2 and state.target.newest(state.keys)[1] <= 3


def test_two_writers_cannot_publish_one_entry(spark):
    t = Target(spark, scratch(spark, "t"), T.StructType([T.StructField("a", T.IntegerType())]))
    part = t.write_part(spark.createDataFrame([(1,)], "a int"))
    t.publish(part, 0)
    with pytest.raises(Exception):
        t.publish(part, 0)
    assert t.read().count() == 1


def test_empty_log_and_table(spark):
    assert found(replay_runs(spark.createDataFrame([], CHUNKS), runs(spark, (1, 1, "ok")), scratch(spark, "t"))) == []
    assert found(replay_runs(spark.createDataFrame([chunk(1, "x", "a", 1, 0)], CHUNKS), runs(spark), scratch(spark, "t"))) == []


SNAP = "snap_no int, delivery int, taken_at timestamp, loaded_at timestamp, source string, chunk_id string, body_hash string, marker_id string, content string, line_no int, old string"


def test_snapshots(spark):
    def row(snap, delivery, hour, chunk_id, content, digest=None, marker=None):
        return (snap, delivery, None, DAY + dt.timedelta(hours=hour), "s", chunk_id, digest, marker, content, 1, "clash")

    import hashlib

    sha = hashlib.sha256(b"kept").hexdigest()
    rows = [
        row(1, 1, 0, "a", "kept"), row(1, 1, 0, "b", "old"), row(1, 1, 0, "c", "gone"), row(1, 1, 0, "c", "gone"),
        row(3, 1, 0, "z", "incomplete"), row(3, 2, 0, None, None, "SHA256:" + sha[:12].upper(), "a"), row(3, 2, 0, "b", "first"), row(3, 2, 1, "b", "new"), row(3, 2, 0, "d", "added"),
    ]
    got = sorted((r.snap_no, r.id, r.change) for r in block_changes(spark.createDataFrame(rows, SNAP)).collect())
    assert got == [(3, "b", "changed"), (3, "c", "removed"), (3, "d", "added")]
    assert block_changes(spark.createDataFrame([], SNAP)).count() == 0


def test_hot_key(spark):
    hot = spark.range(3000).select(F.lit(1).alias("row_id"), F.lit("h").alias("id"), F.lit("t").alias("text"), F.lit(None).cast("string").alias("body_hash"), F.lit("s").alias("source"), F.lit(1).alias("rev"), F.lit(DAY).alias("loaded_at"))
    assert found(replay_runs(hot, runs(spark, (1, 1, "ok")), scratch(spark, "t"))) == [(1, "s", "h")]
