"""Small literal frames for the semantic traps, with expected values worked out by pandas or by hand."""

import io
import math
import wave

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.config import Thresholds
from lodestone.functions import exprs as X
from lodestone.functions.text import text_metrics
from lodestone.operators import eda, leakage, media, profile, stats
from lodestone.plans import registry
from lodestone.sources import readers


def one(spark, column, *values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.select("i", column(F.col("v")).alias("x")).orderBy("i").collect()]


def test_paths(spark):
    assert one(spark, X.extension, "a/b.TXT", "a/.hidden", "x.tar.gz", "noext", "d.x/y") == [".txt", None, ".gz", None, None]
    assert one(spark, X.stem, "a/b_1.npz", ".bashrc", "x.tar.gz") == ["b_1", ".bashrc", "x.tar"]
    assert one(spark, X.segment_prefix, "id_3.npz", "id.npz", "a_b_12.x") == ["id", None, "a_b"]
    assert one(spark, X.path_tokens, "Data/cam-01/a.mp4") == [["data", "cam", "mp4"]]
    assert one(spark, X.looks_like_path, "~/x", "C:\\a", "plain", "clip.MP4", "a/b") == [True, True, False, True, True]


def test_numbers(spark):
    assert one(spark, X.to_number, " 12 ", "1d", "1e3", "nan", "x", None) == [12.0, None, 1000.0, None, None, None]
    assert one(spark, X.length_bucket, 50, 51, 200, 1000, 1001, kind="int") == ["very_short", "short", "short", "medium", "long"]
    assert one(spark, X.split_rank, "Train", "valid", "eval", "x") == [0, 1, 2, 99]


def test_text_edges(spark):
    assert one(spark, X.syllables, "there", "the", "b", "123", "queue") == [1, 1, 1, 0, 1]
    assert one(spark, X.sentences, "A b. C d! E", "", "no end") == [["A b.", "C d!", "E"], [], ["no end"]]
    df = spark.createDataFrame([(0, ""), (1, None), (2, "one"), (3, "a b a b a b!!\nx\nx\n")], "i int, t string")
    got = {r.i: r for r in text_metrics(df, "t", keep=("i",)).collect()}
    assert got[0].word_count == 0 and got[0].char_entropy == 0 and got[0].flesch_reading_ease == 0
    assert got[1].text_missing and got[1].word_count is None
    assert got[2].duplicate_line_ratio == 0 and got[2].max_ngram_frequency == 0
    assert got[3].line_count == 3 and got[3].max_ngram_frequency == 2 and got[3].repeated_punctuation_count == 1
    assert got[3].duplicate_line_ratio == pytest.approx(2 / 3)


def test_missing_values(spark):
    df = readers.normalise(spark.createDataFrame([(1.0, "NA", 1), (float("nan"), "x", 2), (2.0, "", 3)], "a double, b string, c int"))
    got = {r.column_name: r for r in stats.column_stats(df).collect()}
    assert (got["a"].missing_count, got["b"].missing_count, got["c"].missing_count) == (1, 2, 0)


def test_duplicates_with_nulls(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "x")], "a int, b string")
    assert profile.duplicate_summary(df).head().duplicate_rows == 1


def test_outlier_gates(spark):
    df = spark.createDataFrame([(i, 5.0, float(i % 7)) for i in range(40)] + [(99, 5.0, 1000.0)], "i int, flat double, x double")
    got = {r.column_name: r for r in eda.outliers(df, ["flat", "x"]).collect()}
    assert set(got) == {"x"} and got["x"].iqr_mild_count == 1 and got["x"].iqr_extreme_count == 1
    few = spark.createDataFrame([(1.0,), (2.0,), (50.0,)], "x double")
    assert eda.outliers(few, ["x"]).count() == 0


def test_skewness_is_bias_corrected(spark):
    x = [1.0, 2.0, 2.5, 3.0, 20.0, 4.0]
    got = eda.feature_scaling(spark.createDataFrame([(v,) for v in x], "x double"), ["x"]).head()
    assert got.skewness == pytest.approx(pd.Series(x).skew())


def test_planted_leaks_and_clean_twins(spark):
    rows = [(i, f"data/{'fall' if i % 2 else 'walk'}/clip_{i}.mp4", "fall" if i % 2 else "walk", "train" if i < 30 else "test", i // 2) for i in range(60)]
    df = spark.createDataFrame(rows, "i int, path string, label string, split string, subject int")
    assert {r.token for r in leakage.path_label_shortcuts(df, "path", "label").collect()} >= {"fall", "walk"}
    assert leakage.split_overlap(df, "subject", "split").head().overlapping_entities == 0
    mixed = df.withColumn("subject", F.col("i") % 5)
    assert leakage.split_overlap(mixed, "subject", "split").head().overlap_rate == 1.0
    assert leakage.split_interleaving(df, "i", "split", "i").head().run_count == 2
    shuffled = df.withColumn("split", F.when(F.col("i") % 2 == 0, "train").otherwise("test"))
    assert leakage.split_interleaving(shuffled, "i", "split", "i").head().run_count == 60
    clean = df.withColumn("path", F.concat(F.lit("data/clip_"), F.col("i").cast("string"), F.lit(".mp4")))
    assert not {r.token for r in leakage.path_label_shortcuts(clean, "path", "label").collect()}
    report = leakage.build_report(df, "path", "label", "split", ["subject"], row_id="i")
    assert report["summary"]["overall_risk_level"] == "high" and len(report["checks"]) == 9


def test_report_takes_severity_over_all_findings(spark):
    # 150 tokens of purity 0.9 and one of purity 1, an n that gives the label away, splits that interleave, shared clips.
    paths = [(10 * k + j, f"tok{k:03d}x/a.mp4", "p" if j else "r") for k in range(150) for j in range(10)] + [(1500 + j, "zz/sure.mp4", "p") for j in range(10)]
    rows = [(i, p, x, float(i) + (10000.0 if x == "p" else 0.0), "train" if i % 2 else "test", i // 2) for i, p, x in paths]
    df = spark.createDataFrame(rows, "i int, path string, label string, n double, split string, clip int").repartition(7, "n")
    report = leakage.build_report(df, "path", "label", "split", time="n", row_id="i", sequences=["clip"])
    checks = {c["risk_type"]: c for c in report["checks"]}
    shortcuts = checks["path_label_shortcuts"]
    assert shortcuts["severity_score"] == 1.0 and shortcuts["details"][0]["token"] in {"sure", "zz"} and len(shortcuts["details"]) == 100
    assert "n" in {d["column_name"] for d in checks["proxy_features"]["details"]} and checks["proxy_features"]["severity_score"] >= 0.95
    assert checks["ts_window_boundary_leakage"]["severity_score"] >= 0.8
    assert any(d.get("overlapping_entities") for d in checks["temporal_overlap"]["details"])
    again = leakage.build_report(df, "path", "label", "split", time="n", sequences=["clip"])
    assert {c["risk_type"]: c["severity_score"] for c in again["checks"]}["ts_window_boundary_leakage"] >= 0.8


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(n=st.integers(11, 60))
def test_deciles_are_even(spark, n):
    df = spark.createDataFrame([(i, float(i)) for i in range(n)], "i int, x double")
    sizes = [r["count"] for r in leakage.deciles(df, ["x"], "i").groupBy("bucket").count().collect()]
    assert len(sizes) == 10 and max(sizes) - min(sizes) <= 1


def test_seasonal_shift_bounds(spark):
    df = spark.sql("SELECT 'train' AS s, DATE'2024-01-05' AS d UNION ALL SELECT 'train', DATE'2024-02-05' UNION ALL SELECT 'test', DATE'2024-07-01' UNION ALL SELECT 'test', NULL")
    assert leakage.seasonal_shift(df, "d", "s").head().js_divergence == pytest.approx(1.0)


def test_hierarchy_needs_pairs(spark):
    df = spark.createDataFrame([(i // 4, i // 2) for i in range(40)], "site int, subject int")
    got = profile.hierarchy(df, ["site", "subject"]).head()
    assert (got.parent, got.child, got.nesting_purity) == ("site", "subject", 1.0)
    assert profile.nesting_purity(df.limit(5), "subject", "site").head().nesting_purity == 0.0


def test_sources(spark, tmp_path):
    (tmp_path / "m.csv").write_text('id,note\n1,"a, ""b""\nc"\n2,NA\n')
    df = readers.read_csv(spark, str(tmp_path / "m.csv"))
    assert [(r.id, r.note) for r in df.orderBy("id").collect()] == [(1, 'a, "b"\nc'), (2, None)]
    assert readers.redact("postgresql://u:secret@h/db") == "postgresql://u:***@h/db"
    assert readers.json_safe({"a": float("inf"), "b": [np.int64(3)]}) == {"a": None, "b": [3]}
    with pytest.raises(ValueError):
        readers.build_query(spark, df, [{"table": df, "on": "true", "type": "sideways"}])
    (tmp_path / "assets").mkdir()
    np.savez(tmp_path / "assets" / "a.npz", keypoints=np.ones((3, 17, 3)), boxes=np.ones((3, 4)), fps=25.0, width=10, height=20)
    (tmp_path / "assets" / "bad.npz").write_bytes(b"no")
    got = {r.path.rsplit("/", 1)[1]: r for r in readers.read_skeletons(spark, str(tmp_path / "assets")).collect()}
    assert len(got["a.npz"].keypoints) == 3 and got["bad.npz"].skeleton_error
    paths = spark.createDataFrame([("assets/a.npz",), ("a.npz",), ("missing.npz",)], "p string")
    assert [r.path_exists for r in readers.existing_paths(paths, "p", str(tmp_path)).orderBy("p").collect()] == [True, True, False]
    assert [r.text for r in readers.json_text(spark.createDataFrame([('{"a": ["x", {"b": "y"}], "text": "z"}',)], "j string"), "j", ["text"]).collect()] == ["z"]


def test_jdbc_round_trip(spark):
    url, driver = "jdbc:derby:memory:audit;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    spark.range(5).write.format("jdbc").option("url", url).option("driver", driver).option("dbtable", "t").mode("overwrite").save()
    assert readers.read_jdbc(spark, url, "SELECT * FROM t", driver).count() == 5


def test_audio(spark):
    t = np.arange(22050) / 22050
    for x, clip in ((np.sin(2 * math.pi * 440 * t), False), (np.zeros(22050), False)):
        raw = io.BytesIO()
        with wave.open(raw, "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(2)
            w.setframerate(22050)
            w.writeframes((x * 30000).astype("<i2").tobytes())
        df = spark.createDataFrame([("a.wav", bytearray(raw.getvalue())), ("b.wav", bytearray(b"x"))], "path string, content binary")
        got = {r.path: r for r in media.audio_files(df).collect()}
        assert got["a.wav"].duration_seconds == 1.0 and got["b.wav"].audio_error
        if x.any():
            assert abs(got["a.wav"].spectral_centroid_mean - 440) < 60
        else:
            assert got["a.wav"].silence_ratio == 1.0
    assert media.video_info(spark.createDataFrame([("v.mp4", bytearray(b""))], "path string, content binary")).head().status


def test_profile_report(spark):
    df = spark.createDataFrame([(i, f"clips/s{i % 3}_{i}.npz", "fall" if i % 4 else "walk", float(i)) for i in range(30)], "sample_id int, path string, label string, fps double")
    tree = profile.build_profile(df, "x", "sample_id")
    assert tree["candidates"]["path"] == ["path"] and tree["candidates"]["label"] == ["label"]
    assert tree["modality"]["modality"] == "skeleton/motion"
    assert eda.rare_classes(df, "label", Thresholds(rare_count=10)).count() == 1


def test_text_metrics_of_odd_texts_against_plain_loops():
    import math
    import random
    import re
    import unicodedata
    from collections import Counter

    from lodestone.functions import text as X

    rng = random.Random(5)
    pieces = ["a", "the", "Queue", "rhythm", "é", "漢字", "_x1", "٣", " ", "  ", "\t", "\n", "\n\n", "\r\n", "\x0b", " ", "\xa0", ".", "!!", "? ", ",,,", "...", "http://a.b/c ", "WWW.x.y", "me@ex.org ", "-", "𝔘", "İ"]
    texts = ["", " ", "\n", "one", ". . .", "a\n\na\n \nb"] + ["".join(rng.choice(pieces) for _ in range(rng.randrange(80))) for _ in range(400)]
    got = X.measure(texts)
    for t, row in zip(texts, got, strict=True):
        m = dict(zip(X.METRICS, row, strict=True))
        w = re.findall(r"\w+", t.lower())
        flat = re.sub("[\\s\x1c-\x1f\x85\xa0]+", " ", t).strip(" ")
        s = [x for x in re.split(r"(?<=[.!?]) +", flat) if x]
        c, g = Counter(w), Counter(zip(w, w[1:], w[2:], strict=False))
        lines = [x for x in (" ".join(y.split()) for y in t.splitlines()) if x]
        letters = [re.sub("[^a-z]", "", x) for x in w]
        groups = [len(re.findall("[aeiouy]+", x)) for x in letters]
        spoken = [0 if not x else max(n - (x[-1] == "e" and n > 1), 1) for x, n in zip(letters, groups, strict=True)]
        size, n = max(len(t), 1), max(len(w), 1)
        want = {
            "char_count": len(t), "char_count_no_space": len(re.sub("[ \t\n\x0b\x0c\r]", "", t)), "word_count": len(w), "sentence_count": len(s), "line_count": len(t.splitlines()), "avg_word_length": sum(map(len, w)) / n,
            "unique_word_count": len(c), "hapax_ratio": sum(v == 1 for v in c.values()) / n, "stopword_ratio": sum(x in X.STOP_WORDS for x in w) / n,
            "duplicate_line_ratio": sum(v for v in Counter(lines).values() if v > 1) / max(len(lines), 1) if len(w) >= 3 else 0, "max_ngram_frequency": max(g.values(), default=0),
            "repeated_ngram_ratio": sum(v for v in g.values() if v > 1) / (len(w) - 2) if len(w) > 2 else 0, "uppercase_ratio": sum(unicodedata.category(x) == "Lu" for x in t) / size, "non_ascii_ratio": sum(ord(x) > 127 for x in t) / size,
            "repeated_punctuation_count": len(re.findall(r"!{2,}|\?{2,}|\.{2,}|,{2,}|;{2,}|:{2,}", t)), "char_entropy": -sum(v / len(t) * math.log2(v / len(t)) for v in Counter(t).values()),
            "complex_word_ratio": sum(x >= 3 for x in spoken) / n, "flesch_kincaid_grade": 0.39 * len(w) / max(len(s), 1) + 11.8 * sum(spoken) / len(w) - 15.59 if w else 0,
        }
        assert {k: m[k] for k in want} == pytest.approx(want), repr(t)


class Caught:
    """A frame that hands out what would run on its batches."""

    columns = ["doc_id", "_t", "_label"]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("_t", T.StringType()), T.StructField("_label", T.StringType())])

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        return run

    mapInPandas = mapInArrow


def test_files_are_decoded_in_small_steps(spark):
    raw = io.BytesIO()
    with wave.open(raw, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(8000)
        w.writeframes(bytes(16000))
    n = 1500
    batch = pa.RecordBatch.from_pydict({"path": [str(k) for k in range(n)], "content": [raw.getvalue() if k % 2 else b"" for k in range(n)]})
    for query in (media.audio_files, media.video_info):
        out = list(query(Caught())(iter([batch])))
        assert sum(x.num_rows for x in out) == n and len(out) >= 3
    waves = registry._waves.__globals__
    held, waves["T"] = waves["T"], lambda s, d, name: Caught()
    try:
        out = list(registry._waves(None, "")(iter([pd.DataFrame({"vec_id": range(n), "embedding": [[0.5] * 8] * n})])))
    finally:
        waves["T"] = held
    assert sum(map(len, out)) == n and max(map(len, out)) <= 256


def test_quartiles_of_many_values_are_exact_and_not_gathered(spark):
    rng = np.random.default_rng(3)
    n = 60_001
    columns = {"even": np.arange(n) / 7, "tailed": np.exp(3 * rng.standard_normal(n)), "tied": rng.integers(0, 3, n) * 1.0, "signed": np.round(rng.standard_normal(n), 2) + 0.0, "few": np.where(np.arange(n) < 10, np.arange(n) * 1.5, np.nan)}
    df = spark.createDataFrame(pd.DataFrame(columns)).repartition(7)
    out = stats.summaries(df, list(columns), 0.0)
    assert "percentile(" not in out._jdf.queryExecution().optimizedPlan().toString()
    found = {r.column_name: (r["count"], r.p25, r.median, r.p75) for r in out.collect()}
    for name, x in columns.items():
        x = x[~np.isnan(x)]
        assert found[name][0] == len(x)
        assert found[name][1:] == pytest.approx(np.quantile(x, [0.25, 0.5, 0.75]).tolist(), rel=1e-12)


def test_texts_are_measured_in_small_steps(spark, monkeypatch):
    from lodestone.functions import text as TX

    monkeypatch.setattr(TX, "_spread", lambda df: df)
    texts = [None if k == 5 else "" if k == 6 else f"{k} some wörds again again.\n" * 40 for k in range(1000)] + ["x " * TX.STEP, "end"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts), pa.nulls(len(texts), pa.string())], names=Caught.columns)
    out = pa.Table.from_batches(list(TX.text_metrics(Caught(), "text", keep=("doc_id",))(iter([batch]))))
    assert len(out.column(0).chunks) >= 5 and out.column("doc_id").to_pylist() == list(range(len(texts)))
    assert out.column("text_missing").to_pylist() == [t is None for t in texts]
    values = TX.measure([t or "" for t in texts])
    for k, name in enumerate(TX.METRICS):
        expected = [None if t is None else v for t, v in zip(texts, values[:, k].tolist(), strict=True)]
        assert out.column(name).to_pylist() == pytest.approx(expected)
