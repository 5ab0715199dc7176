"""Who holds the ball, frame by frame and in spells."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kernels import dist
from ..schema import FRAME, SEGMENT, Tables
from .folds import possession_spells


def holders(t: Tables, radius: float = 2.0) -> DataFrame:
    """A row a frame with the nearest player within ``radius`` of the ball (the later one of a tie), or nulls."""
    ball = t.frames.where("ball_x is not null and ball_y is not null").select(*FRAME, "ball_x", "ball_y")
    d = dist(F.col("x"), F.col("y"), F.col("ball_x"), F.col("ball_y"))
    near = t.positions.join(ball, FRAME).withColumn("d", d).where(F.col("d") <= radius)
    best = near.groupBy(*FRAME).agg(F.max_by(F.struct("track_id", "team", "x", "y", "d"), F.struct(-F.col("d"), "ord")).alias("h"))
    return t.frames.select(*FRAME, "t", "t_ms").join(best, FRAME, "left").select(*FRAME, "t", "t_ms", "h.*")


def spells(t: Tables) -> DataFrame:
    """Possession spells with their place in order, and the frames and times that bound them."""
    found = possession_spells(holders(t))
    return found.withColumn("spell", F.row_number().over(Window.partitionBy(*SEGMENT).orderBy("i_start")))


def alive(intervals: DataFrame, *columns) -> DataFrame:
    """A row a frame of each interval [i_start, i_end], so that containment becomes an equi-join."""
    return intervals.select(*SEGMENT, *columns, F.explode(F.sequence("i_start", "i_end")).alias("frame_idx"))


def carriers(t: Tables, found: DataFrame, ball_max: float) -> DataFrame:
    """Frames of a spell whose holder is seen at most ``ball_max`` from a visible ball.

    Columns carrier, team, cx, cy, spell.  A spell keeps its first id; where that
    id is gone or far from the ball, the frame has no carrier.
    """
    own = alive(found, F.col("track_id").alias("carrier"), "team", "spell")
    at = t.positions.select(*FRAME, F.col("track_id").alias("carrier"), F.col("x").alias("cx"), F.col("y").alias("cy"))
    ball = t.frames.select(*FRAME, "t", "ball_x", "ball_y")
    near = dist(F.col("cx"), F.col("cy"), F.col("ball_x"), F.col("ball_y")) <= ball_max
    return own.join(at, [*FRAME, "carrier"]).join(ball, FRAME).where(near).drop("ball_x", "ball_y")
