"""The engine, its command line and the streaming extension, end to end."""

import json

import numpy as np
from pyspark.sql import functions as F

from lodestone.__main__ import main
from lodestone.engine import Engine
from lodestone.streaming.incremental import label_counts


def manifest(spark, root):
    (root / "clips").mkdir()
    rows = []
    for i in range(24):
        np.savez(root / "clips" / f"s{i % 3}_{i}.npz", keypoints=np.random.default_rng(i).random((4, 17, 3)), boxes=np.tile([0.0, 0.0, 2.0, 3.0], (4, 1)), fps=25.0, width=10, height=20)
        rows.append((i, f"clips/s{i % 3}_{i}.npz", "fall" if i % 2 else "walk", i % 6, "train" if i < 16 else "test", float(i)))
    (root / "clips" / "note.txt").write_text("A short note. With two sentences.")
    rows.append((24, "clips/note.txt", "walk", 1, "test", 500.0))
    return spark.createDataFrame(rows, "sample_id int, path string, label string, subject_id int, split string, value double")


def test_engine(spark, tmp_path):
    engine, df = Engine(spark), manifest(spark, tmp_path).cache()
    tree = engine.profile(df, "m", "sample_id")
    assert tree["candidates"]["grouping"][0] == "subject_id" and tree["summary"]["row_count"] == 25
    summary = engine.eda(df, tree, "sample_id", str(tmp_path))
    assert summary["assets"]["status"] == "ok"
    names = {r["column_name"]: r for r in summary["asset_summary"]}
    assert names["trace_length"]["count"] == 24 and names["word_count"]["median"] == 6 and abs(names["mean_bbox_area_ratio"]["mean"] - 0.03) < 1e-9
    report = engine.leakage(df, tree, "sample_id")
    assert [c["risk_type"] for c in report["checks"]][:2] == ["duplicates", "split_entity_overlap"] and report["checks"][1]["severity_score"] > 0.8
    text = engine.markdown(summary, report)
    assert "## Labels" in text and "Overall risk" in text
    joined, info = engine.from_sql(df, where="label = 'fall'", columns=["sample_id"])
    assert joined.count() == 12 and info["where_clause"]


def test_command_line(spark, tmp_path):
    path = str(tmp_path / "m.parquet")
    manifest(spark, tmp_path).write.parquet(path)
    for command, name in (("profile", "manifest_profile"), ("eda", "eda_summary"), ("leakage", "leakage_report")):
        main([command, path, "--output", str(tmp_path / "out"), "--row-id", "sample_id"])
        assert json.loads((tmp_path / "out" / f"{name}.json").read_text())


def test_stream_counts(spark, tmp_path):
    spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "label string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("label string").parquet(str(tmp_path / "in"))
    query = label_counts(stream, "label").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert {r.label: r["count"] for r in spark.table("counts").collect()} == {"a": 2, "b": 1, "<MISSING>": 1}
    timed = spark.range(3).select(F.current_timestamp().alias("t"), F.lit("x").alias("label"))
    assert label_counts(timed, "label", "t").agg(F.sum("count")).head()[0] == 3
