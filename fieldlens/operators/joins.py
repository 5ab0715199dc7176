"""Joins of frames, intervals, samples and perception records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kernels import in_bounds, interpolate, project


def asof_backward(left: DataFrame, right: DataFrame, keys: list[str], t: str, value: str, default: str | None = None) -> DataFrame:
    """``left`` with the value of the latest ``right`` row at or before its time, else the column ``default``.

    One sort of both sides' union instead of a range join.
    """
    both = left.withColumn("_v", F.lit(None).cast(right.schema[value].dataType)).withColumn("_s", F.lit(1)).unionByName(
        right.select(*keys, t, F.col(value).alias("_v")).withColumn("_s", F.lit(0)), allowMissingColumns=True
    )
    latest = F.last("_v", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(t, "_s").rowsBetween(Window.unboundedPreceding, 0))
    found = F.coalesce("_l", default) if default else F.col("_l")
    return both.withColumn("_l", latest).where("_s = 1").withColumn(value, found).drop("_v", "_s", "_l")


def asof_nearest(left: DataFrame, right: DataFrame, keys: list[str], t: str, *values: str) -> DataFrame:
    """``left`` with the values of the ``right`` row nearest in time, the earlier of two.

    The candidates are the last row at or before and the first one after, found by one sort.
    """
    mark = F.struct(F.col(t).alias("at"), *values)
    kind = right.select(mark.alias("_v")).schema["_v"].dataType
    both = left.withColumn("_v", F.lit(None).cast(kind)).withColumn("_s", F.lit(1)).unionByName(
        right.select(*keys, t, mark.alias("_v")).withColumn("_s", F.lit(0)), allowMissingColumns=True
    )
    w = Window.partitionBy(*keys).orderBy(t, "_s")
    both = both.withColumn("_b", F.last("_v", True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    both = both.withColumn("_a", F.first("_v", True).over(w.rowsBetween(0, Window.unboundedFollowing))).where("_s = 1")
    nearer = F.when(F.col("_b").isNull(), F.col("_a")).when(F.col("_a").isNull() | (F.col(t) - F.col("_b.at") <= F.col("_a.at") - F.col(t)), F.col("_b")).otherwise(F.col("_a"))
    out = both.withColumn("_n", nearer)
    return out.select(*left.columns, *(F.col(f"_n.{v}").alias(v) for v in values))


def interpolated(left: DataFrame, right: DataFrame, keys: list[str], t: str, *values: str) -> DataFrame:
    """``left`` with the values at its times, linear between the neighbouring ``right`` rows, held at the ends, null without any.

    The neighbours, at or before and at or after, come from two sorts of the
    union, each read from its beginning, so a row costs the same in a long track.
    """
    mark = F.struct(F.col(t).alias("t"), *values)
    kind = right.select(mark.alias("_v")).schema["_v"].dataType
    both = left.withColumn("_v", F.lit(None).cast(kind)).withColumn("_s", F.lit(1)).unionByName(
        right.where(F.col(t).isNotNull()).select(*keys, t, mark.alias("_v")).withColumn("_s", F.lit(0)), allowMissingColumns=True
    )
    w = Window.partitionBy(*keys)
    latest = lambda *order: F.last("_v", True).over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    both = both.withColumn("_b", latest(t, "_s", "_v")).withColumn("_a", latest(F.desc(t), "_s", F.desc("_v"))).where("_s = 1")
    found = both.withColumn("_n", interpolate(F.array_compact(F.array("_b", "_a")), F.col(t), values))
    return found.select(*(c for c in left.columns if c not in values), *(F.col(f"_n.{v}").alias(v) for v in values))


def overlapping_strongest(left: DataFrame, right: DataFrame, keys: list[str], score: str, *values: str) -> DataFrame:
    """``left`` (t0, t1) with the values of the strongest ``right`` interval (t_start, t_end) that overlaps it."""
    both = left.join(right, keys, "left").where("t_start is null or (t_start <= t1 and t_end >= t0)")
    best = both.groupBy(*left.columns).agg(F.max_by(F.struct(score, *values), F.struct(score, -F.col("t_start"))).alias("_v"))
    return left.join(best.select(*left.columns, "_v.*"), left.columns, "left")


def merge_perception(detections: DataFrame, ball: DataFrame, shots: DataFrame, teams: DataFrame | None = None, frame_teams: DataFrame | None = None) -> DataFrame:
    """One row a frame of any input: frame_idx, shot ('main' where none is given), boxes, ball.

    ``detections`` has (frame_idx, boxes); with ``teams`` (tid, team) and
    ``frame_teams`` (frame_idx, tid, team), boxes get a team: the frame's label
    before the track's.
    """
    if teams is not None:
        box = detections.select("frame_idx", F.posexplode_outer("boxes").alias("place", "box")).withColumn("tid", F.col("box.tid").cast("string"))
        box = box.join(teams.select(F.col("tid").cast("string").alias("tid"), F.col("team").alias("by_track")), "tid", "left")
        label = F.col("by_track")
        if frame_teams is not None:
            box = box.join(frame_teams.select("frame_idx", F.col("tid").cast("string").alias("tid"), F.col("team").alias("by_frame")), ["frame_idx", "tid"], "left")
            label = F.coalesce("by_frame", "by_track")
        player = F.struct("place", F.col("box.tid").alias("tid"), label.alias("team"), F.col("box.cls").alias("cls"), F.col("box.conf").alias("conf"), F.col("box.xyxy").alias("box"))
        detections = box.groupBy("frame_idx").agg(F.array_sort(F.collect_list(F.when(F.col("box").isNotNull(), player))).alias("boxes"))
    out = detections.join(ball, "frame_idx", "full_outer").join(shots, "frame_idx", "full_outer")
    return out.withColumn("shot", F.coalesce("shot", F.lit("main")))


def frame_ids(*inputs: DataFrame) -> DataFrame:
    """The different frame numbers of all inputs."""
    out = inputs[0].select("frame_idx")
    for other in inputs[1:]:
        out = out.union(other.select("frame_idx"))
    return out.distinct()


def projected(rows: DataFrame, h: str = "h", x: str = "px", y: str = "py") -> DataFrame:
    """Rows (pixel places, homography) on the pitch, as x and y; those without a place, or far off the pitch, go."""
    p = project(F.col(h), F.col(x), F.col(y))
    return rows.withColumn("_p", p).withColumn("x", F.col("_p.x")).withColumn("y", F.col("_p.y")).drop("_p").where(in_bounds(F.col("x"), F.col("y")))


def closest_pairs(pairs: DataFrame, keys: list[str], a: str, b: str, d: str) -> DataFrame:
    """Of all pairs of a key, each a's closest b and each b's closest a, each pair once."""
    rank = lambda side, other: F.row_number().over(Window.partitionBy(*keys, side).orderBy(d, other))
    return pairs.withColumn("_ra", rank(a, b)).withColumn("_rb", rank(b, a)).where("_ra = 1 or _rb = 1").drop("_ra", "_rb")


def without_match(df: DataFrame, other: DataFrame, on: list[str], residual: Column | None = None) -> DataFrame:
    """Rows that have no partner."""
    cond = [df[c] == other[c] for c in on] + ([residual] if residual is not None else [])
    return df.join(other, cond, "left_anti")
