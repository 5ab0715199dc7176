"""Interchange files: JSON lines, a record a processed video frame; scans, and sinks for results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "shots": "frame_idx long, t double, shot string",
    "detections": "frame_idx long, t double, boxes array<struct<tid:long,cls:string,conf:double,xyxy:array<double>>>",
    "teams_frames": "frame_idx long, teams map<string,string>",
    "ball": "frame_idx long, t double, ball array<double>, src string",
    "perception": "frame_idx long, t double, shot string, players array<struct<tid:long,team:string,cls:string,conf:double,box:array<double>,foot:array<double>>>, ball array<double>",
    "calib": "frame_idx long, t double, H string, n_kp int, rmse_m double, src string, stripe_dx double, stripe_strength double",
}


def flat_h(text: Column) -> Column:
    """Nine numbers from a flat or a nested 3 x 3 JSON array; null for anything else."""
    numbers = F.transform(F.split(F.regexp_replace(text, r"[\[\]\s]+", ""), ","), lambda x: x.try_cast("double"))
    return F.when(F.size(numbers) == 9, numbers)


def read(spark: SparkSession, path: str, kind: str, missing_ok: bool = False) -> DataFrame:
    """A file of ``kind``; blank lines are skipped, and with ``missing_ok`` a file that isn't there is empty."""
    if missing_ok:
        from pyspark.errors import AnalysisException

        try:
            rows = spark.read.schema(SCHEMAS[kind]).json(path)
            rows.schema  # noqa: B018
        except AnalysisException:
            return spark.createDataFrame([], SCHEMAS[kind])
    else:
        rows = spark.read.schema(SCHEMAS[kind]).json(path)
    rows = rows.where("frame_idx is not null")
    return rows.withColumn("H", flat_h(F.col("H"))) if kind == "calib" else rows


def read_teams(spark: SparkSession, path: str) -> DataFrame:
    """(tid, team) of a JSON object from track ids to teams."""
    text = spark.read.option("wholetext", True).text(path)
    return text.select(F.explode(F.from_json("value", "map<string,string>")).alias("tid", "team"))


def frame_teams(rows: DataFrame) -> DataFrame:
    """(frame_idx, tid, team) of a teams_frames file."""
    return rows.select("frame_idx", F.explode("teams").alias("tid", "team"))


def write_detections(detections: DataFrame, path: str) -> None:
    """Detections as JSON lines, sorted by time within a segment; ``segment`` is the segment's number."""
    rows = detections.withColumnRenamed("segment_id", "segment")
    rows.repartitionByRange("match_id", "segment").sortWithinPartitions("match_id", "segment", "t_start").write.mode("overwrite").json(path)


def write_records(rows: DataFrame, path: str, partitions: int | None = None) -> None:
    """Records of any kind above, in frame order, nulls left out."""
    (rows.repartitionByRange(partitions, "frame_idx") if partitions else rows.repartitionByRange("frame_idx")).sortWithinPartitions("frame_idx").write.mode("overwrite").json(path)


def count_by_type(detections: DataFrame) -> DataFrame:
    return detections.groupBy("type").agg(F.count("*").alias("n"))
