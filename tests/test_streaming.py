from __future__ import annotations

from pyspark.sql import functions as F

from tessera.session import shared_dir, table
from tessera.streaming.scoring import score_stream, windowed_counts


def test_batches_score_once_and_resume(spark):
    base = shared_dir(spark, "stream")
    cells = spark.createDataFrame([("d0", 0, 0.1), ("d0", 1, 0.2), ("d1", 1, 0.5)], "d string, level int, frac double")
    schema = "unit int, i long, d0 int, d1 int"
    for k in range(2):
        spark.createDataFrame([(1, 10 * k, 0, 1), (1, 10 * k + 1, 1, 0)], schema).write.mode("append").parquet(f"{base}/in")
        score_stream(spark, f"{base}/in", schema, cells, ["d0", "d1"], f"{base}/out", f"{base}/check").awaitTermination()
    got = {r["i"]: round(r["score"], 9) for r in spark.read.parquet(f"{base}/out").collect()}
    assert got == {0: 0.6, 1: 0.2, 10: 0.6, 11: 0.2}


def test_windows_with_a_watermark(spark, sf):
    base = shared_dir(spark, "events")
    table(spark, sf, "events").select("ts", "event_type").write.parquet(base)
    stream = windowed_counts(spark.readStream.schema("ts timestamp, event_type string").parquet(base), "ts", "event_type", "1 day", "2 days")
    q = stream.writeStream.format("memory").queryName("w").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select sum(n) from w").first()[0] == table(spark, sf, "events").count()
    assert spark.table("w").filter(F.col("n") <= 0).count() == 0


def merged(spark, buckets):
    from pyspark.sql.types import StructType

    from tessera.streaming.merging import MergedTable

    schema = StructType.fromDDL("unit int, method string, score double, seq long")
    return MergedTable(spark, shared_dir(spark, "merged"), schema, buckets)


def rows(table):
    return sorted(((r.unit, r.method, r.score) for r in table.read().collect()), key=str)


def test_rescored_keys_are_replaced(spark):
    schema = "unit int, method string, score double, seq long"
    for buckets in (1, 7):
        t = merged(spark, buckets)
        assert rows(t) == []
        first = spark.createDataFrame([(u, m, float(u), 1) for u in range(20) for m in "ab"] + [(None, None, 0.5, 1)], schema)
        t.merge(first, 0, "seq")
        want = {(u, m): float(u) for u in range(20) for m in "ab"} | {(None, None): 0.5}
        assert rows(t) == sorted(((*k, v) for k, v in want.items()), key=str)
        again = spark.createDataFrame([(3, "a", 9.0, 2), (3, "a", 8.0, 3), (3, "a", 7.0, None), (50, "b", 1.0, 1), (None, None, 0.6, 1)], schema)
        want |= {(3, "a"): 8.0, (50, "b"): 1.0, (None, None): 0.6}
        for _ in range(2):  # a repeated batch changes nothing
            t.merge(again, 1, "seq")
            assert rows(t) == sorted(((*k, v) for k, v in want.items()), key=str)
        t.merge(first.filter("false"), 2, "seq")
        assert rows(t) == sorted(((*k, v) for k, v in want.items()), key=str)


def test_a_lost_batch_leaves_the_table_as_it_was(spark, monkeypatch):
    t = merged(spark, 3)
    one = spark.createDataFrame([(1, "a", 1.0, 1), (2, "a", 2.0, 1)], "unit int, method string, score double, seq long")
    t.merge(one, 0, "seq")
    two = one.withColumn("score", F.col("score") * 10)
    # the rows of the batch are written, its list is not
    two.withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(f"{t.path}/rows/batch=1")
    assert rows(t) == [(1, "a", 1.0), (2, "a", 2.0)]
    t.merge(two, 1, "seq")
    assert rows(t) == [(1, "a", 10.0), (2, "a", 20.0)]


def test_merging_stream_resumes(spark):
    from tessera.streaming.merging import merge_stream

    t, base = merged(spark, 4), shared_dir(spark, "merging")
    schema = "unit int, method string, score double, seq long"
    for k in range(3):
        spark.createDataFrame([(k, "a", float(k), k), (0, "b", float(k), k)], schema).write.mode("append").parquet(f"{base}/in")
        merge_stream(t, f"{base}/in", "seq", f"{base}/check").awaitTermination()
    assert rows(t) == [(0, "a", 0.0), (0, "b", 2.0), (1, "a", 1.0), (2, "a", 2.0)]
