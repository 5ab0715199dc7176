"""Window operators over frames, tracks and label runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import FRAME, SEGMENT, Tables

UP_TO_NOW = (Window.unboundedPreceding, Window.currentRow)


def by_segment(*more: str):
    return Window.partitionBy(*SEGMENT, *more)


def track_velocity(t: Tables, window_ms: int = 400) -> DataFrame:
    """Trailing velocity of every position.

    Displacement since the earliest frame of the last ``window_ms``, over the time
    between; null if the player isn't in that frame, or it is the same frame.
    """
    first = F.min("frame_idx").over(by_segment().orderBy("t_ms").rangeBetween(-window_ms, 0))
    frames = t.frames.select(*FRAME, first.alias("j"))
    before = t.positions.select(*SEGMENT, F.col("frame_idx").alias("j"), "track_id", F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("t").alias("t0"))
    out = t.positions.join(frames, FRAME).join(before, [*SEGMENT, "j", "track_id"], "left")
    dt = F.when(F.col("t") > F.col("t0"), F.col("t") - F.col("t0"))
    return out.withColumn("vx", (F.col("x") - F.col("x0")) / dt).withColumn("vy", (F.col("y") - F.col("y0")) / dt).drop("j", "x0", "y0", "t0")


def signs(frames: DataFrame) -> DataFrame:
    """A row a frame and team with its attacking direction, +1 where it is missing."""
    both = F.explode(F.array(F.struct(F.lit("home").alias("team"), F.col("att_home").alias("sign")), F.struct(F.lit("away").alias("team"), F.col("att_away").alias("sign"))))
    return frames.select(*FRAME, both.alias("s")).select(*FRAME, "s.team", F.coalesce("s.sign", F.lit(1)).alias("sign"))


def with_sign(t: Tables) -> DataFrame:
    """Positions with their team's attacking direction, without a join of the teams."""
    att = t.frames.select(*FRAME, "att_home", "att_away")
    sign = F.when(F.col("team") == "home", F.col("att_home")).otherwise(F.col("att_away"))
    return t.positions.join(att, FRAME).withColumn("sign", F.coalesce(sign, F.lit(1))).drop("att_home", "att_away")


def rearmost_rank(t: Tables) -> DataFrame:
    """Positions with their rank from the own goal within frame and team (``back``: 1 is the rearmost)."""
    order = Window.partitionBy(*FRAME, "team").orderBy(F.col("sign") * F.col("x"), "ord")
    return with_sign(t).withColumn("back", F.row_number().over(order))


def second_rearmost(t: Tables) -> DataFrame:
    return rearmost_rank(t).where("back = 2").select(*FRAME, "t", "t_ms", "team", "track_id", "x")


def outfield(t: Tables) -> DataFrame:
    return rearmost_rank(t).where("back > 1").drop("back")


def upper_median(values: Column) -> Column:
    """The element in the middle of the sorted values, the upper one of two."""
    a = F.array_sort(F.collect_list(values))
    return F.try_element_at(a, (F.floor(F.size(a) / 2) + 1).cast("int"))


def frame_step(frames: DataFrame) -> DataFrame:
    """The usual time between a segment's frames: upper median of the positive differences, 0.04 if there are none."""
    lag = F.col("t_ms") - F.lag("t_ms").over(by_segment().orderBy("frame_idx"))
    steps = frames.select(*SEGMENT, lag.alias("d")).where("d > 0").groupBy(*SEGMENT).agg(upper_median(F.col("d")).alias("dt_ms"))
    return frames.select(*SEGMENT).distinct().join(steps, SEGMENT, "left").select(*SEGMENT, F.coalesce("dt_ms", F.lit(40)).alias("dt_ms"))


def offside_smooth(t: Tables, window_s: float = 0.5) -> DataFrame:
    """Second-rearmost x of either team on every frame, averaged over the last ``window_s``, frames without it skipped."""
    grid = signs(t.frames.select(*FRAME, "att_home", "att_away")).join(t.frames.select(*FRAME, "t", "t_ms"), FRAME)
    raw = grid.join(second_rearmost(t).select(*FRAME, "team", "x"), [*FRAME, "team"], "left").join(frame_step(t.frames), SEGMENT)
    # the number of frames depends on the segment's rate, so the average is a difference of running sums
    w = by_segment("team").orderBy("frame_idx")
    run = raw.withColumn("n", F.greatest(F.round(F.lit(window_s * 1000) / F.col("dt_ms")).cast("int"), F.lit(1)))
    run = run.withColumn("last", F.collect_list(F.struct("x")).over(w.rowsBetween(-63, 0)))
    recent = F.filter(F.slice("last", F.greatest(F.size("last") - F.col("n") + 1, F.lit(1)), F.col("n")), lambda p: p.x.isNotNull())
    mean = F.try_divide(F.aggregate(recent, F.lit(0.0), lambda s, p: s + p.x), F.size(recent))
    return run.select(*FRAME, "t", "t_ms", "team", F.col("x").alias("raw_x"), mean.alias("x"))


def line_split(df: DataFrame, keys: list[str], depth: str = "depth", min_gap: float = 5.0, max_lines: int = 4) -> DataFrame:
    """``df`` with ``line``, 1 at the back: cut at the widest gaps of at least ``min_gap``, ``max_lines`` lines at most.

    Without such a gap, the widest gap cuts.
    """
    order = Window.partitionBy(*keys).orderBy(depth, "track_id")
    gap = F.col(depth) - F.lag(depth).over(order)
    ranked = df.withColumn("gap", gap)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc_nulls_last("gap"), depth))
    cut = F.col("gap").isNotNull() & ((F.col("rank") == 1) | ((F.col("rank") <= max_lines - 1) & (F.col("gap") >= min_gap)))
    return ranked.withColumn("rank", rank).withColumn("line", F.sum(cut.cast("int")).over(order.rowsBetween(*UP_TO_NOW)) + 1).drop("gap", "rank")


def islands(df: DataFrame, keys: list[str], order: str = "frame_idx") -> DataFrame:
    """``df`` with ``island``: consecutive values of ``order`` within ``keys`` share it."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("island", F.col(order) - F.row_number().over(w))


def merge_intervals(df: DataFrame, keys: list[str], start: str, end: str, gap: float = 0) -> DataFrame:
    """``df`` with ``island``: intervals that begin at most ``gap`` after the latest end before them share it."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    latest = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = latest.isNull() | (F.col(start) > latest + gap)
    return df.withColumn("_new", new.cast("int")).withColumn("island", F.sum("_new").over(w.rowsBetween(*UP_TO_NOW))).drop("_new")


def session_split(df: DataFrame, keys: list[str], t: str, gap: float, broken: Column | None = None, t_order: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``session``: a new one after more than ``gap``, or after a row that is ``broken`` (those get none)."""
    w = Window.partitionBy(*keys).orderBy(t, *t_order)
    broken = F.lit(False) if broken is None else broken
    breaks = F.sum(broken.cast("int")).over(w.rowsBetween(*UP_TO_NOW))
    rows = df.withColumn("_breaks", breaks).withColumn("_broken", broken)
    good = rows.where(~F.col("_broken"))
    new = F.lag(t).over(w).isNull() | (F.col(t) - F.lag(t).over(w) > gap) | (F.col("_breaks") != F.lag("_breaks").over(w))
    return good.withColumn("_new", new.cast("int")).withColumn("session", F.sum("_new").over(w.rowsBetween(*UP_TO_NOW))).drop("_new", "_breaks", "_broken")


def held_age(df: DataFrame, keys: list[str], t: str, good: Column) -> DataFrame:
    """``df`` with ``age``: time since the last good row, 0 on one, null before the first."""
    last = F.last(F.when(good, F.col(t)), ignorenulls=True).over(Window.partitionBy(*keys).orderBy(t).rowsBetween(*UP_TO_NOW))
    return df.withColumn("age", F.col(t) - last)


def ball_trust(ball: DataFrame, keys: list[str], t: str = "t", coast: float = 0.5) -> DataFrame:
    """``ball`` (src: det or kf) with ``trusted``: a detection, or a prediction at most ``coast`` after one."""
    aged = held_age(ball, keys, t, F.col("src") == "det")
    return aged.withColumn("trusted", F.col("ball_x").isNotNull() & F.coalesce(F.col("age") <= coast, F.lit(False))).drop("age")


def hysteresis(df: DataFrame, keys: list[str], order: list[str], label: str, n: int = 3) -> DataFrame:
    """``df`` with ``smooth``: the label changes when ``n`` rows in a row agree; the first label holds until then."""
    w = Window.partitionBy(*keys).orderBy(*order)
    new = F.lag(label).over(w).isNull() | (F.lag(label).over(w) != F.col(label))
    runs = df.withColumn("_run", F.sum(new.cast("int")).over(w.rowsBetween(*UP_TO_NOW)))
    place = F.row_number().over(Window.partitionBy(*keys, "_run").orderBy(*order))
    settled = F.last(F.when(F.col("_place") >= n, F.col(label)), ignorenulls=True).over(w.rowsBetween(*UP_TO_NOW))
    out = runs.withColumn("_place", place).withColumn("smooth", F.coalesce(settled, F.first(label).over(w.rowsBetween(*UP_TO_NOW))))
    return out.drop("_run", "_place")


def displacement(df: DataFrame, keys: list[str], order: str, x: str, y: str) -> DataFrame:
    """``df`` with ``moved``: distance to the row before, null if either has no place."""
    w = Window.partitionBy(*keys).orderBy(order)
    dx, dy = F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w)
    return df.withColumn("moved", F.sqrt(dx * dx + dy * dy))


def latest_label_shift(df: DataFrame, keys: list[str], order: str, label: str) -> DataFrame:
    """``df`` with ``shift_from``: the label before, where it differs."""
    before = F.lag(label).over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn("shift_from", F.when(before != F.col(label), before))
