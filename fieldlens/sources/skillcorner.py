"""Broadcast tracking as JSON lines with a match file: centre origin, only players in view are detected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import LENGTH, WIDTH, Tables

MATCH = (
    "home_team struct<id:long>, away_team struct<id:long>, players array<struct<id:long,team_id:long>>, pitch_length double, pitch_width double, "
    "match_periods array<struct<period:int,duration_minutes:double>>, home_team_side array<string>"
)
ROWS = (
    "frame long, timestamp string, period int, ball_data struct<x:double,y:double,is_detected:boolean>, "
    "player_data array<struct<x:double,y:double,player_id:long,is_detected:boolean>>"
)


def seconds(timestamp: Column) -> Column:
    """HH:MM:SS.ff in seconds."""
    part = lambda i: F.element_at(F.split(timestamp, ":"), i).cast("double")
    return part(1) * 3600 + part(2) * 60 + part(3)


def period_offsets(match: DataFrame) -> DataFrame:
    """(period, offset): seconds of the periods before."""
    periods = match.select(F.posexplode("match_periods").alias("i", "p")).select("i", "p.*")
    before = F.sum(F.col("duration_minutes") * 60).over(Window.orderBy("i").rowsBetween(Window.unboundedPreceding, -1))
    return periods.select("period", F.coalesce(before, F.lit(0.0)).alias("offset"))


def _sides(match: DataFrame, players: DataFrame) -> DataFrame:
    """(period, home): the home team's direction, as the match file says, else by the team's deepest player at first sight."""
    told = match.select(F.posexplode("home_team_side").alias("i", "side")).select((F.col("i") + 1).cast("int").alias("period"), F.when(F.col("side") == "left_to_right", 1).otherwise(-1).alias("told"))
    first = players.groupBy("period").agg(F.min("frame").alias("frame"))
    deepest = players.join(first, ["period", "frame"]).where("team = 'home'").groupBy("period").agg(F.max_by("x", F.abs("x")).alias("x"))
    guess = first.select("period").join(deepest, "period", "left").select("period", F.when(F.coalesce("x", F.lit(-1.0)) < 0, 1).otherwise(-1).alias("guess"))
    any_told = match.select((F.size(F.coalesce("home_team_side", F.array().cast("array<string>"))) > 0).alias("any_told"))
    both = guess.join(told, "period", "full_outer").crossJoin(F.broadcast(any_told))  # one row
    return both.select("period", F.when(F.col("any_told"), F.coalesce("told", F.lit(1))).otherwise(F.col("guess")).alias("home"))


def load(spark: SparkSession, match_dir: str, match_id: str = "m") -> Tables:
    """A match as one segment: rows with a period, players of either team that are detected, no rescaling."""
    match = spark.read.schema(MATCH).option("multiLine", True).json(f"{match_dir}/match_data.json")
    rows = spark.read.schema(ROWS).json(f"{match_dir}/structured_data.jsonl").where("period is not null")
    team = F.when(F.col("p.team_id") == F.col("home_team.id"), "home").when(F.col("p.team_id") == F.col("away_team.id"), "away")
    roster = match.select("home_team", "away_team", F.explode("players").alias("p")).select(F.col("p.id").alias("player_id"), team.alias("team")).where("team is not null")
    half = match.select((F.coalesce("pitch_length", F.lit(LENGTH)) / 2).alias("half_l"), (F.coalesce("pitch_width", F.lit(WIDTH)) / 2).alias("half_w"))
    numbered = rows.withColumn("frame_idx", (F.row_number().over(Window.orderBy("frame")) - 1).cast("int"))
    numbered = numbered.join(F.broadcast(period_offsets(match)), "period", "left").crossJoin(F.broadcast(half))  # a few rows, and one
    numbered = numbered.withColumn("t", F.coalesce("offset", F.lit(0.0)) + seconds(F.col("timestamp")))
    place = F.posexplode("player_data").alias("ord", "p")
    players = numbered.select("frame", "frame_idx", "period", "t", "half_l", "half_w", place).select("*", "p.*").join(F.broadcast(roster), "player_id")  # a match's roster
    sides = _sides(match, players)
    ids = [F.lit(match_id).alias("match_id"), F.lit(0).alias("segment_id")]
    ms = F.round(F.col("t") * 1000).cast("long").alias("t_ms")
    seen = F.coalesce(F.col("ball_data.is_detected"), F.lit(False))
    home = F.coalesce("home", F.lit(1))
    frames = numbered.join(F.broadcast(sides), "period", "left").select(
        *ids, "frame_idx", "t", ms, "period", F.when(seen, F.col("ball_data.x") + F.col("half_l")).alias("ball_x"), F.when(seen, F.col("ball_data.y") + F.col("half_w")).alias("ball_y"),
        home.alias("att_home"), (-home).alias("att_away"),
    )
    at = players.where("is_detected").select(*ids, "frame_idx", "t", ms, F.col("ord").cast("int").alias("ord"), F.col("player_id").cast("string").alias("track_id"), "team", (F.col("x") + F.col("half_l")).alias("x"), (F.col("y") + F.col("half_w")).alias("y"))
    return Tables(frames, at)
