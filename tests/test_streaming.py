from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from granthika.streaming.requests import ingest_changes, request_windows


def test_windows_of_a_stream(spark, tmp_path):
    rows = [(datetime(2024, 1, 1, h, 5), k, float(v)) for h, k, v in ((0, "a", 1), (0, "a", 3), (0, "b", 5), (2, "a", 7))]
    df = spark.createDataFrame(rows, "ts timestamp, event_type string, value double")
    df.write.parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    w = request_windows(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    w.writeStream.outputMode("complete").foreachBatch(lambda b, _: b.write.mode("overwrite").parquet(out)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    got = {(r.start.hour, r.event_type): (r.n, r.mean_value) for r in spark.read.parquet(out).collect()}
    assert got == {(0, "a"): (2, 2.0), (0, "b"): (1, 5.0), (2, "a"): (1, 7.0)}


def test_ingest_is_repeatable(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "doc_id string, v int")
    df.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        ingest_changes(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).groupBy("doc_id").agg(F.count("*").alias("n")).filter("n <> 1").count() == 0
