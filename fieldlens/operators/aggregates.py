"""Aggregations over tracks, labels, calibrations and feature vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kernels import dist
from .windows import upper_median


def majority(df: DataFrame, keys: list[str], label: str, order: str) -> DataFrame:
    """The most frequent label of each key, of equals the one seen first."""
    counts = df.groupBy(*keys, label).agg(F.count("*").alias("n"), F.min(order).alias("_first"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "_first"))
    return counts.withColumn("_rank", rank).where("_rank = 1").drop("_rank", "_first")


def argmax_above(df: DataFrame, keys: list[str], score: str, floor: float, *values: str, tie: str | None = None) -> DataFrame:
    """The row of the highest score above ``floor`` of each key; of equals, that of the smallest ``tie``."""
    order = F.col(score) if tie is None else F.struct(score, -F.col(tie))
    return df.where(F.col(score) > floor).groupBy(*keys).agg(F.max_by(F.struct(*values), order).alias("_v"), F.max(score).alias(score)).select(*keys, "_v.*", score)


def histogram_2d(df: DataFrame, keys: list[str], x: Column, y: Column, nx: int, ny: int) -> DataFrame:
    """Share of each key's rows in the cells of a grid over [0, 1) x [0, 1)."""
    cell = lambda v, n: F.least(F.greatest(F.floor(v * n), F.lit(0)), F.lit(n - 1)).cast("int")
    counts = df.select(*keys, cell(x, nx).alias("ix"), cell(y, ny).alias("iy")).groupBy(*keys, "ix", "iy").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys))).drop("n")


def track_stats(df: DataFrame, keys: list[str], track: str, order: str) -> DataFrame:
    """Per key: tracks, rows, mean life in rows, and tracks that begin after the key's first row."""
    per = df.groupBy(*keys, track).agg(F.min(order).alias("a"), F.max(order).alias("z"), F.count("*").alias("n"))
    first = F.min("a").over(Window.partitionBy(*keys)) if keys else F.min("a").over(Window.partitionBy(F.lit(1)))
    per = per.withColumn("late", (F.col("a") > first).cast("long"))
    return per.groupBy(*keys).agg(F.count("*").alias("tracks"), F.sum("n").alias("seen"), F.sum("late").alias("new_tracks"), F.sum(F.col("z") - F.col("a")).alias("life"))


def segment_churn(df: DataFrame, segment: list[str], track: str, order: str) -> DataFrame:
    """Tracks first seen in a segment after its first row."""
    return track_stats(df, segment, track, order).select(*segment, "tracks", "new_tracks")


def percentile_of(value: str, *shares: float) -> list[Column]:
    """Exact percentiles, interpolated linearly."""
    return [F.percentile(value, F.lit(s)).alias(f"p{round(s * 100)}") for s in shares]


def calibration_report(calib: DataFrame) -> DataFrame:
    """Per match: frames, share with a homography, rows by source, error percentiles of fitted rows, jumps of the centre."""
    w = Window.partitionBy("match_id").orderBy("frame_idx")
    moved = dist(F.col("cx"), F.col("cy"), F.lag("cx").over(w), F.lag("cy").over(w))
    rows = calib.withColumn("moved", moved)
    fitted = F.when(F.col("src") == "fit", F.col("rmse"))
    return rows.groupBy("match_id").agg(
        F.count("*").alias("n"), F.count("cx").alias("valid"), *(F.count_if(F.col("src") == s).alias(f"n_{s}") for s in ("fit", "ema", "held")),
        F.percentile(fitted, F.lit(0.5)).alias("rmse_p50"), F.percentile(fitted, F.lit(0.9)).alias("rmse_p90"), F.max(fitted).alias("rmse_max"),
        F.percentile("moved", F.lit(0.5)).alias("moved_p50"), F.max("moved").alias("moved_max"),
    )


def stride_of(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The usual step of an index: median of its positive differences, at least 1."""
    d = F.col(order) - F.lag(order).over(Window.partitionBy(*keys).orderBy(order))
    steps = df.select(*keys, d.alias("d")).where("d > 0").groupBy(*keys).agg(F.median("d").cast("int").alias("m"))
    return steps.select(*keys, F.greatest("m", F.lit(1)).alias("stride"))


def upper_median_step(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    d = F.col(order) - F.lag(order).over(Window.partitionBy(*keys).orderBy(order))
    return df.select(*keys, d.alias("d")).where("d > 0").groupBy(*keys).agg(upper_median(F.col("d")).alias("step"))


def nearest_centroid(df: DataFrame, vector: str, centroids: list[list[float]]) -> DataFrame:
    """``df`` with the number of the nearest of a few fixed centroids, and the squared distance to it."""
    def gap(c: list[float]) -> Column:
        return F.aggregate(F.zip_with(vector, F.array(*map(F.lit, c)), lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, x: s + x)

    best = F.array_min(F.array(*(F.struct(gap(c).alias("d2"), F.lit(i).alias("cluster")) for i, c in enumerate(centroids))))
    return df.withColumn("_best", best).withColumn("cluster", F.col("_best.cluster")).withColumn("d2", F.col("_best.d2")).drop("_best")


def two_means(df: DataFrame, vector: str, seed: int = 0, rounds: int = 20) -> DataFrame:
    """``df`` with its cluster of two, by parallel k-means++ and Lloyd steps."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    name = "_features"
    rows = df.withColumn(name, array_to_vector(F.transform(vector, lambda x: x.cast("double"))))
    return KMeans(k=2, seed=seed, maxIter=rounds, featuresCol=name, predictionCol="cluster").fit(rows).transform(rows).drop(name)


def rates(df: DataFrame, keys: list[str], kind: str, minutes: Column) -> DataFrame:
    """Rows of each kind, and per minute."""
    return df.groupBy(*keys, kind).agg(F.count("*").alias("n"), (F.count("*") / F.first(minutes)).alias("per_min"))


def linspace_rows(df: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """At most ``n`` rows of each key, evenly spaced from the first to the last."""
    w = Window.partitionBy(*keys)
    rows = df.withColumn("_i", F.row_number().over(w.orderBy(order)) - 1).withColumn("_n", F.count("*").over(w))
    step = F.when(F.col("_n") > n, (F.col("_n") - 1) / F.lit(float(max(n - 1, 1)))).otherwise(F.lit(1.0))
    picks = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.floor(k * step).cast("int"))
    return rows.where(F.array_contains(picks, F.col("_i"))).drop("_i", "_n")
