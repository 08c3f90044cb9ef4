"""Metrics of skeleton sequences: keypoints array<array<struct<x,y,c>>>, boxes array<struct<x1,y1,x2,y2>>, fps, width, height.

All in higher-order functions over a row's arrays, so a clip is one row and nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.config import DEFAULTS, LIMBS, Thresholds
from lodestone.functions.exprs import bind


def _moments(values: Column) -> Column:
    """count, mean, population variance and maximum of an array."""

    def body(v: Column) -> Column:
        n = F.size(v)
        mean = F.try_divide(F.aggregate(v, F.lit(0.0), lambda s, x: s + x), n)
        return bind(mean, lambda m: F.struct(n.alias("n"), m.alias("mean"), F.try_divide(F.aggregate(v, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)), n).alias("var"), F.array_max(v).alias("max")))

    return bind(values, body)


def _frames(k: Column, least: float) -> Column:
    return F.transform(k, lambda f: F.size(F.filter(f, lambda j: j["c"] >= least)))


def trace_length(visible: Column, joints: int) -> Column:
    """Longest run of frames with enough visible joints."""
    start = F.struct(F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(s: Column, v: Column) -> Column:
        run = F.when(v >= joints, s["run"] + 1).otherwise(0)
        return F.struct(run.alias("run"), F.greatest(s["best"], run).alias("best"))

    return F.aggregate(visible, start, step)["best"].cast("long")


def velocities(k: Column, least: float) -> Column:
    """Moves of joints that are visible in two frames in a row."""

    def between(i: Column) -> Column:
        a, b = F.get(k, i - 1), F.get(k, i)
        pairs = F.filter(F.zip_with(a, b, lambda p, q: F.struct(p.alias("p"), q.alias("q"))), lambda z: (z["p"]["c"] >= least) & (z["q"]["c"] >= least))
        return F.transform(pairs, lambda z: F.sqrt(F.pow(z["q"]["x"] - z["p"]["x"], F.lit(2.0)) + F.pow(z["q"]["y"] - z["p"]["y"], F.lit(2.0))))

    frames = F.when(F.size(k) > 1, F.sequence(F.lit(1), F.size(k) - 1)).otherwise(F.array().cast("array<int>"))
    return F.flatten(F.transform(frames, between))


def limb_lengths(k: Column, a: int, b: int, least: float) -> Column:
    seen = F.filter(k, lambda f: (F.get(f, F.lit(a))["c"] >= least) & (F.get(f, F.lit(b))["c"] >= least))
    return F.transform(seen, lambda f: F.sqrt(F.pow(F.get(f, F.lit(a))["x"] - F.get(f, F.lit(b))["x"], F.lit(2.0)) + F.pow(F.get(f, F.lit(a))["y"] - F.get(f, F.lit(b))["y"], F.lit(2.0))))


def skeleton_metrics(df: DataFrame, keep: tuple[str, ...] = (), t: Thresholds = DEFAULTS) -> DataFrame:
    k, area = F.col("keypoints"), F.col("width") * F.col("height")
    visible = _frames(k, t.joint_confidence)
    confidences = F.flatten(F.transform(k, lambda f: F.transform(f, lambda j: j["c"])))
    boxes = F.transform("boxes", lambda b: F.greatest(b["x2"] - b["x1"], F.lit(0.0)) * F.greatest(b["y2"] - b["y1"], F.lit(0.0)) / area)
    base = df.select("*", _moments(F.transform(visible, lambda v: v.cast("double"))).alias("_v"), _moments(confidences).alias("_c"), _moments(bind(k, lambda a: velocities(a, t.joint_confidence))).alias("_m"), *[_moments(limb_lengths(k, a, b, t.joint_confidence)).alias(f"_l{n}") for n, (_, a, b) in enumerate(LIMBS)])
    limbs = [F.when(F.col(f"_l{n}.n") >= 2, F.col(f"_l{n}.var")).alias(name) for n, (name, _, _) in enumerate(LIMBS)]
    return base.select(
        *keep, F.size(k).cast("long").alias("n_frames"), F.try_divide(F.size(k).cast("double"), F.col("fps")).alias("duration_seconds"), F.col("_v.mean").alias("mean_visible_joints"), trace_length(visible, t.min_joints).alias("trace_length"),
        F.col("_c.mean").alias("avg_keypoint_confidence"), F.col("_c.var").alias("confidence_variance"), F.when(area > 0, F.try_divide(F.aggregate(boxes, F.lit(0.0), lambda s, x: s + x), F.size(boxes))).alias("mean_bbox_area_ratio"),
        F.col("_m.mean").alias("velocity_mean"), F.col("_m.max").alias("velocity_max"), F.col("_m.var").alias("velocity_variance"), *limbs,
    )
