"""Live detection over a stream of frames.

Each micro-batch extends a rolling buffer of the last seconds of each match and
runs the batch plans over it: the cheap detectors every time, all of them every
few batches.  The buffer is a table per batch in the checkpoint folder, written
before results are handed on, so a restarted query goes on from the last one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.present import active_at
from ..plans.pipeline import CHEAP, Detector, run_all
from ..schema import Tables
from ..storage import shared_dir

BUFFER_S, RELATIONAL_EVERY, GRACE_S, GAP_S = 15.0, 5, 0.75, 2.0
#: A frame of the stream: players and all in one row, with a sequence number of its source.
FRAME_ROW = (
    "match_id string, seq long, shot string, t double, t_ms long, period int, ball_x double, ball_y double, att_home int, att_away int, "
    "players array<struct<track_id:string,team:string,x:double,y:double>>"
)


def newest(batch: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Only the row of the highest sequence number of each key: late and stale rows give way."""
    return batch.groupBy(*keys).agg(F.max_by(F.struct(*(c for c in batch.columns if c not in keys)), seq).alias("_r")).select(*keys, "_r.*")


def as_tables(rows: DataFrame) -> Tables:
    """Buffered frame rows as tables: frames numbered from 0 within a segment."""
    number = F.row_number().over(Window.partitionBy("match_id", "segment_id").orderBy("seq")) - 1
    rows = rows.withColumn("frame_idx", number.cast("int"))
    frames = rows.select("match_id", "segment_id", "frame_idx", "t", "t_ms", "period", "ball_x", "ball_y", "att_home", "att_away")
    players = rows.select("match_id", "segment_id", "frame_idx", "t", "t_ms", F.posexplode("players").alias("ord", "p")).select("match_id", "segment_id", "frame_idx", "t", "t_ms", "ord", "p.*")
    return Tables(frames, players)


class LiveDetection:
    """``foreachBatch`` function for a stream of FRAME_ROW.

    Rows not above a match's last sequence number are dropped and counted.  Rows
    of another shot than 'main' end the segment, as does a gap of 2 s; a new
    segment starts an empty buffer.  ``sink(detections, epoch)`` gets what is
    active at each match's latest frame.
    """

    def __init__(self, spark: SparkSession, sink: Callable[[DataFrame, int], None], buffer_s: float = BUFFER_S, every: int = RELATIONAL_EVERY, detectors: list[Detector] | None = None, path: str | None = None):
        self.spark, self.sink, self.buffer_s, self.every, self.detectors = spark, sink, buffer_s, every, detectors
        self.path = path or f"{shared_dir(spark)}/fieldlens/live"
        self.dropped = 0

    def _state(self, epoch: int) -> DataFrame | None:
        """The buffer after the batch before; batches are numbered without gaps, so a missing one is an error."""
        return self.spark.read.parquet(f"{self.path}/{epoch - 1}") if epoch else None

    def fresh(self, batch: DataFrame, state: DataFrame | None) -> DataFrame:
        """The rows of ``batch`` above their match's last sequence number, each number once."""
        if state is not None:
            last = state.groupBy("match_id").agg(F.max("seq").alias("last"))
            batch = batch.join(last, "match_id", "left").where("last is null or seq > last").drop("last")
        return batch.dropDuplicates(["match_id", "seq"])

    def buffer(self, batch: DataFrame, state: DataFrame | None) -> DataFrame:
        """The rows to keep after ``batch``, with segment_id; only the latest segment of a match stays."""
        old = self.spark.createDataFrame([], batch.schema).withColumn("segment_id", F.lit(0)) if state is None else state
        rows = old.unionByName(self.fresh(batch, state).withColumn("segment_id", F.lit(None).cast("int")))
        w = Window.partitionBy("match_id").orderBy("seq")
        main = F.col("shot") == "main"
        cut = F.lag("t").over(w).isNull() | (F.col("t") - F.lag("t").over(w) > GAP_S) | (F.lag("shot").over(w) != "main")
        rows = rows.withColumn("_cut", (cut & main).cast("int"))
        base = F.coalesce(F.min("segment_id").over(Window.partitionBy("match_id")), F.lit(0))
        first = F.first("_cut").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        rows = rows.withColumn("segment_id", (base + F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, 0)) - first).cast("int")).drop("_cut")
        m = Window.partitionBy("match_id")
        return rows.withColumn("_s", F.max("segment_id").over(m)).withColumn("_t", F.max("t").over(m)).where(
            (F.col("segment_id") == F.col("_s")) & (F.col("_t") - F.col("t") <= self.buffer_s)
        ).drop("_s", "_t")

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        state = self._state(epoch)
        self.dropped += batch.count() - self.fresh(batch, state).count()
        self.buffer(batch, state).write.mode("overwrite").parquet(f"{self.path}/{epoch}")
        kept = self.spark.read.parquet(f"{self.path}/{epoch}")
        main = kept.where("shot = 'main'")
        if main.isEmpty():
            return
        chosen = self.detectors or (None if epoch % self.every == 0 else CHEAP)
        found = run_all(as_tables(main), chosen)
        now = main.groupBy("match_id", "segment_id").agg(F.max("t").alias("t"))
        self.sink(active_at(found, now, GRACE_S), epoch)


def start(stream: DataFrame, live: LiveDetection, checkpoint: str, **trigger):
    """The running query."""
    return stream.writeStream.foreachBatch(live).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def gated_ball(stream: DataFrame, max_speed: float = 40.0, reacquire: float = 0.5) -> DataFrame:
    """Ball rows (match_id, seq, t, x, y) of a stream without jumps, by state of a match: the last kept place."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    def run(key, batches, state):
        import pandas as pd

        last = state.get if state.exists else None
        # a trigger's rows of a match may come in several batches, in any order
        pdf = pd.concat(list(batches)).sort_values("seq")
        kept = []
        for r in pdf.itertuples():
            gone = None if last is None else r.t - last[0]
            ok = last is None or gone >= reacquire or ((r.x - last[1]) ** 2 + (r.y - last[2]) ** 2) ** 0.5 <= gone * max_speed
            kept.append(ok)
            if ok:
                last = (r.t, r.x, r.y)
        yield pdf[kept][["match_id", "seq", "t", "x", "y"]]
        if last is not None:
            state.update(tuple(float(v) for v in last))

    rows = stream.select("match_id", "seq", "t", "x", "y")
    return rows.groupBy("match_id").applyInPandasWithState(run, "match_id string, seq long, t double, x double, y double", "t double, x double, y double", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(detections: DataFrame, at: str, window: str = "1 minute", slide: str | None = None, late: str = "30 seconds") -> DataFrame:
    """Detections of each type in event-time windows, with a watermark for late rows."""
    return detections.withWatermark(at, late).groupBy(F.window(at, window, slide or window), "type").agg(F.count("*").alias("n"))


def sessions(rows: DataFrame, at: str, keys: list[str], gap: str = "2 seconds", late: str = "30 seconds") -> DataFrame:
    """Sessions of event time by a native session window: the streaming twin of a split at gaps."""
    return rows.withWatermark(at, late).groupBy(F.session_window(at, gap), *keys).agg(F.count("*").alias("n"))
