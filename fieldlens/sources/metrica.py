"""Wide tracking CSV: one file a team, a pair of columns a player, the ball in the last pair.

Row 1 names the teams, row 2 has a jersey number over the x column of each
player, row 3 the column names.  Coordinates are shares of the pitch with the
origin at the top left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import AWAY, HOME, LENGTH, WIDTH, Tables

HEADER_ROWS = 3
GUESS_ROWS = 100


def jerseys(spark: SparkSession, path: str) -> tuple[list[tuple[int, int]], int]:
    """((column, jersey number) of each player, number of columns) from the header, read as text."""
    lines = spark.read.text(path).limit(2).collect()
    cells = [c.strip() for c in lines[1].value.split(",")]
    n = max(len(cells), len(lines[0].value.split(",")))
    return [(c, int(float(cells[c]))) for c in range(3, n - 2, 2) if c < len(cells) and cells[c]], n


def read_team(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(players, frames) of a team's file, in metres with y upwards.

    players: row, period, t, number, place (of the player in the header), x, y; frames: row, period, t, ball_x, ball_y.
    Rows are numbered by the file's frame column.
    """
    found, n = jerseys(spark, path)
    fields = [T.StructField(f"c{i}", T.StringType()) for i in range(n)]
    data = spark.read.csv(path, schema=T.StructType(fields), header=False).where(F.col("c1").try_cast("int").isNotNull() & F.col("c0").try_cast("int").isNotNull())
    number = lambda c: F.nanvl(F.col(f"c{c}").try_cast("double"), F.lit(None).cast("double"))
    at = lambda c: (number(c) * LENGTH, (1.0 - number(c + 1)) * WIDTH)
    base = [F.col("c1").cast("long").alias("file_frame"), F.col("c0").cast("int").alias("period"), F.col("c2").cast("double").alias("t")]
    players = F.array(*(F.struct(F.lit(j).alias("number"), F.lit(k).alias("place"), at(c)[0].alias("x"), at(c)[1].alias("y")) for k, (c, j) in enumerate(found)))
    bx, by = at(n - 2)
    whole = bx.isNotNull() & by.isNotNull()
    rows = data.select(*base, players.alias("p"), F.when(whole, bx).alias("ball_x"), F.when(whole, by).alias("ball_y"))
    rows = rows.withColumn("row", F.row_number().over(Window.orderBy("file_frame")) - 1)
    return rows.select("row", "period", "t", F.explode("p").alias("p")).select("row", "period", "t", "p.*"), rows.select("row", "period", "t", "ball_x", "ball_y")


def attacking(players: DataFrame) -> DataFrame:
    """(period, sign): +1 if the player who is farthest from the middle over the period's first rows is in the left half."""
    start = players.groupBy("period").agg(F.min("row").alias("start"))
    first = players.where("x is not null").join(start, "period").where(F.col("row") < F.col("start") + GUESS_ROWS)
    means = first.groupBy("period", "number").agg(F.avg("x").alias("x"))
    keeper = means.groupBy("period").agg(F.max_by("x", F.abs(F.col("x") - LENGTH / 2)).alias("x"))
    return keeper.select("period", F.when(F.col("x") < LENGTH / 2, 1).otherwise(-1).alias("sign"))


def load(spark: SparkSession, home_csv: str, away_csv: str, downsample: int = 1, match_id: str = "m") -> Tables:
    """Both teams' files as one segment; rows that only one file has are left out."""
    (hp, hf), (ap, af) = read_team(spark, home_csv), read_team(spark, away_csv)
    frames = hf.join(af.select("row"), "row").where(F.col("row") % downsample == 0).withColumn("frame_idx", F.floor(F.col("row") / downsample).cast("int"))
    signs = [attacking(p.join(af.select("row"), "row", "left_semi")).withColumnRenamed("sign", f"att_{t}") for p, t in ((hp, HOME), (ap, AWAY))]
    for s in signs:
        frames = frames.join(F.broadcast(s), "period", "left")  # a row a period
    ids = [F.lit(match_id).alias("match_id"), F.lit(0).alias("segment_id")]
    ms = F.round(F.col("t") * 1000).cast("long").alias("t_ms")
    out = frames.select(
        *ids, "frame_idx", "t", ms, "period", "ball_x", "ball_y", F.coalesce("att_home", F.lit(1)).alias("att_home"), F.coalesce("att_away", F.lit(-1)).alias("att_away")
    )
    both = [
        p.where("x is not null and y is not null").select("row", F.concat(F.lit(letter), F.col("number")).alias("track_id"), F.lit(team).alias("team"), (F.col("place") + base).alias("ord"), "x", "y")
        for p, letter, team, base in ((hp, "H", HOME, 0), (ap, "A", AWAY, 1000))
    ]
    players = both[0].union(both[1]).join(frames.select("row", "frame_idx", "t"), "row")
    return Tables(out, players.select(*ids, "frame_idx", "t", ms, F.col("ord").cast("int").alias("ord"), "track_id", "team", "x", "y"))
