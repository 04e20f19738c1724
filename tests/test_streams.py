"""Streams that are stopped and started again, and batches that are repeated."""

import random

from trivane.operators.drift import DetectorConfig, detect_by_key
from trivane.streaming import live


def source(spark, folder, rows, part):
    spark.createDataFrame(rows, "k string, t timestamp, v double").coalesce(1).write.mode("append").parquet(f"{folder}/part={part}")


def test_detectors_go_on_after_a_restart(spark, tmp_path):
    rng = random.Random(0)
    config = DetectorConfig(window=40, stat=12, significance=0.01)
    import datetime

    base = datetime.datetime(2024, 1, 1)
    rows = [(k, base + datetime.timedelta(minutes=i), rng.gauss(i // 60, 0.5)) for i in range(240) for k in ("a", "b")]
    found = []
    for part in range(3):  # the query ends after each part and begins anew from its checkpoint
        source(spark, tmp_path / "in", rows[part * 160 : (part + 1) * 160], part)
        stream = spark.readStream.schema("k string, t timestamp, v double").option("pathGlobFilter", "*.parquet").parquet(str(tmp_path / "in"))
        q = live.write_batches(live.detect_stream(stream, "k", "t", "v", config), str(tmp_path / "out"), str(tmp_path / "check"))
        q.awaitTermination()
        found.append(q.lastProgress is not None)
    got = sorted((r.k, r["index"], round(r.value, 9)) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    batch = detect_by_key(spark.createDataFrame(rows, "k string, t timestamp, v double"), "k", ["t"], "v", config)
    assert got == sorted((r.k, r["index"], round(r.value, 9)) for r in batch.collect()) and len(got) >= 4


def test_a_repeated_batch_replaces_itself(spark, tmp_path):
    stream = lambda: spark.readStream.schema("x long").parquet(str(tmp_path / "in"))
    spark.range(5).selectExpr("id AS x").coalesce(1).write.parquet(str(tmp_path / "in"))
    for check in ("one", "two"):  # as after a failure before the commit: the same epoch once more
        live.write_batches(stream(), str(tmp_path / "out"), str(tmp_path / check)).awaitTermination()
    assert sorted(r.x for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(5))
