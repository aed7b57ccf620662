"""Streams give what batches give."""

from pyspark.sql import types as T

from blockloom.operators.incremental import Target
from blockloom.session import scratch
from blockloom.streaming.live import report_once, upsert


def test_upsert_once_per_batch(spark):
    schema = T.StructType([T.StructField("source", T.StringType()), T.StructField("id", T.StringType()), T.StructField("version", T.LongType()), T.StructField("body", T.StringType()), T.StructField("action", T.StringType())])
    target = Target(spark, scratch(spark, "live"), schema)
    run = upsert(target)
    one = spark.createDataFrame([("a", 1, "A\n<!-- stay:x -->\n\nB\n<!-- stay:y -->\n")], "source string, version long, text string")
    two = spark.createDataFrame([("a", 2, "A2\n<!-- stay:x -->\n"), ("a", 1, "old\n")], "source string, version long, text string")
    run(one, 0)
    run(one, 0)
    run(two, 1)
    assert sorted((r.id, r.version, r.action) for r in target.read().collect()) == [("x", 0, "reembed"), ("x", 1, "reembed"), ("y", 0, "reembed"), ("y", 1, "evict")]


def test_repeated_findings_are_reported_once(spark, tmp_path):
    for i, rows in enumerate([[("a", "f1")], [("a", "f1")], [("a", "f2")]]):
        d = tmp_path / "in" / str(i)
        spark.createDataFrame(rows, "source string, finding string").coalesce(1).write.parquet(str(d))
    stream = spark.readStream.schema("source string, finding string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = report_once(stream).writeStream.format("memory").queryName("reports").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.findings for r in spark.table("reports").collect()) == ["f1", "f2"]


def test_late_older_version_changes_nothing(spark):
    target = Target(spark, scratch(spark, "live"), T.StructType.fromDDL("source string, id string, version long, body string, action string"))
    run, cols = upsert(target), "source string, version long, text string"
    run(spark.createDataFrame([("a", 2, "A2\n<!-- stay:x -->\n\nB\n<!-- stay:y -->\n"), ("b", 5, "no ids\n")], cols), 0)
    run(spark.createDataFrame([("a", 1, "old\n<!-- stay:x -->\n"), ("b", 4, "late\n<!-- stay:z -->\n")], cols), 1)
    assert sorted((r.id, r.version, r.action) for r in target.read().collect()) == [("x", 0, "reembed"), ("y", 0, "reembed")]
    run(spark.createDataFrame([("a", 3, "A3\n<!-- stay:x -->\n")], cols), 2)
    assert sorted((r.id, r.action) for r in target.read().where("version = 2").collect()) == [("x", "reembed"), ("y", "evict")]
