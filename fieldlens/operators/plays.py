"""Plays over spells, edges and velocities: give-and-go, overlap run, third-man run, pressing trap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kernels import dist
from ..schema import FRAME, SEGMENT, Tables
from .detectors import POINT, at_frame, ball_at, mate_paths, path_windows, spell_pairs, whole_windows
from .folds import cooldown
from .windows import frame_step, track_velocity

MAX_SPEED, COOL_S, PATH_HZ = 12.0, 8.0, 5.0


def stride(dt_ms: Column, hz: float = PATH_HZ) -> Column:
    """Frames between the points of a path of about ``hz`` points a second."""
    return F.greatest(F.lit(1), F.round(F.lit(1.0) / (hz * dt_ms / 1000.0)).cast("int"))


def sampled(df: DataFrame, t: Tables, keys: list[str], track: str, first: str, last: str, name: str) -> DataFrame:
    """``df`` with the path ``name`` of a track from frame ``first`` to ``last``: every stride-th frame and the last one."""
    step = stride(F.col("dt_ms"))
    steps = df.join(frame_step(t.frames), SEGMENT).select(
        *keys, track, F.explode(F.array_union(F.sequence(first, last, step), F.array(last))).alias("frame_idx")
    )
    at = t.positions.select(*FRAME, F.col("track_id").alias(track), "t", "x", "y")
    path = steps.join(at, [*FRAME, track]).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("t", "x", "y"))).alias(name))
    return df.join(path, keys, "left")


def separations(df: DataFrame, edges: DataFrame, **times: Column) -> DataFrame:
    """``df`` (edge, may be null) with the distance of its edge's ends at the sample nearest to each of ``times``, the earlier of two; equal rows become one.

    The neighbours come from two sorts of times and samples together, so that a
    long edge's samples aren't copied into, and searched for, every row.
    """
    asked = F.array(*(F.struct(F.lit(name).alias("name"), at.alias("t")) for name, at in times.items()))
    asked = df.select(*SEGMENT, "edge", F.struct(*df.columns).alias("_row"), F.explode(asked).alias("_q")).select(*SEGMENT, "edge", "_row", "_q.name", "_q.t", F.lit(1).alias("_s"))
    samples = edges.select(*SEGMENT, "edge", F.explode("samples").alias("s"))
    mark = F.struct("s.t", dist(F.col("s.xa"), F.col("s.ya"), F.col("s.xb"), F.col("s.yb")).alias("d"))
    both = asked.unionByName(samples.select(*SEGMENT, "edge", "s.t", F.lit(0).alias("_s"), mark.alias("_v")), allowMissingColumns=True)
    w = Window.partitionBy(*SEGMENT, "edge")
    latest = lambda *order: F.last("_v", True).over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    both = both.withColumn("_b", latest("t", "_s")).withColumn("_a", latest(F.desc("t"), "_s")).where("_s = 1")
    gap = lambda v: F.when(v.isNotNull(), F.struct(F.abs(v.t - F.col("t")).alias("gap"), v.t.alias("t"), v.d.alias("d")))
    near = F.least(gap(F.col("_b")), gap(F.col("_a"))).d
    return both.groupBy("_row").agg(*(F.max(F.when(F.col("name") == name, near)).alias(name) for name in times)).select("_row.*", *times)


def _sign(df: DataFrame, team: str, prefix: str) -> Column:
    return F.coalesce(F.when(F.col(team) == "home", F.col(f"{prefix}_att_home")).otherwise(F.col(f"{prefix}_att_away")), F.lit(1))


def give_and_go(t: Tables, spells: DataFrame, paths: bool = True) -> DataFrame:
    """A, B, A again, the same team, A well forward between."""
    s = spell_pairs(spells, 3).where("team1 = team2 and team2 = team3 and track_id1 <> track_id2 and track_id1 = track_id3")
    s = s.where("t_start2 - t_end1 <= 2.5 and t_start3 - t_start2 <= 4.0")
    s = at_frame(at_frame(s, t, "i_end1", "track_id1", "a"), t, "i_start3", "track_id1", "b")
    s = ball_at(s, t, "i_end1", "f", "att_home", "att_away").withColumn("forward", _sign(s, "team1", "f") * (F.col("b_x") - F.col("a_x")))
    span = F.col("t_start3") - F.col("t_end1")
    s = s.where(F.col("forward") >= 6.0).where((span > 0) & (dist(F.col("a_x"), F.col("a_y"), F.col("b_x"), F.col("b_y")) <= span * MAX_SPEED))
    s = at_frame(s, t, "i_start2", "track_id2", "w")
    if paths:
        s = sampled(s, t, [*SEGMENT, "spell"], "track_id1", "i_end1", "i_start3", "a_path")
    return s.select(
        *SEGMENT, F.lit("give_and_go").alias("type"), F.array("track_id1", "track_id2").alias("players"), *(["a_path"] if paths else []), POINT("w_x", "w_y").alias("wall"),
        F.least(F.lit(0.9), 0.55 + F.col("forward") / 40.0).alias("confidence"), F.col("t_end1").alias("t_start"), F.col("t_start3").alias("t_end"),
    )


def _speeds(t: Tables) -> DataFrame:
    return track_velocity(t).select(*FRAME, "track_id", F.sqrt(F.col("vx") ** 2 + F.col("vy") ** 2).alias("v"))


def _find_overlaps(path, sign, dt, first):
    """Windows of 1.5 s, each sixth of one apart, in which the mate sprints from behind the carrier to ahead, outside."""
    n = max(2, round(1.5 / dt))
    every, pick = max(1, n // 6), max(1, round(0.25 / dt))
    x, y, cx, cy, v = (path[k] for k in ("x", "y", "cx", "cy", "v"))
    for k in whole_windows(path, n):
        z = k + n
        if (path["i"][k] - first) % every or not sign * x[k] <= sign * cx[k] + 0.5 or not sign * x[z] >= sign * cx[z] + 0.5:
            continue
        wide, narrow = y[z] - 34.0, cy[z] - 34.0
        speeds = v[k + pick : z + 1 : pick]
        if wide * narrow >= 0 and abs(wide) >= abs(narrow) + 0.5 and len(speeds) >= 3 and ((speeds >= 4.0) & (speeds <= MAX_SPEED)).all():
            yield int(path["i"][k]), int(path["i"][z]), "overlap_run", float(speeds.mean())


def overlap_runs(t: Tables, spells: DataFrame, edges: DataFrame, paths: bool = True) -> DataFrame:
    """A teammate sprints past the carrier on the outside and leaves the marker behind; the first such window of a spell and runner."""
    w = path_windows(mate_paths(t, spells, _speeds(t)), _find_overlaps).withColumn("at", F.struct(F.col("at_x").alias("x"), F.col("at_y").alias("y")))
    marks = edges.where("kind = 'marking'").select(*SEGMENT, F.col("b").alias("track_id"), F.col("t_start").alias("from"), F.col("t_end").alias("to"), "strength", "edge")
    same = [w[c] == marks[c] for c in (*SEGMENT, "track_id")]
    over = w.join(marks.alias("m"), [*same, marks["from"] <= w.t1, marks["to"] >= w.t0], "left").select(w["*"], "from", "strength", "edge")
    keys = [*SEGMENT, "spell", "carrier", "track_id", "i", "j", "t0", "t1", "at"]
    best = over.groupBy(*keys).agg(F.max_by("edge", F.struct("strength", -F.col("from"))).alias("edge"))
    best = separations(best, edges, d1=F.col("t1"), d0=F.col("t0")).withColumn("growth", F.col("d1") - F.col("d0")).where("growth is null or growth > 2.0")
    first = best.withColumn("r", F.row_number().over(Window.partitionBy(*SEGMENT, "spell", "track_id").orderBy("i"))).where("r = 1")
    if paths:
        first = _with_path(first, t)
    conf = F.when(F.col("growth").isNull(), 0.5).otherwise(F.least(F.lit(0.85), 0.55 + F.col("growth") / 10.0))
    return first.select(
        *SEGMENT, F.lit("overlap_run").alias("type"), F.array("track_id", "carrier").alias("players"), *(["run_path"] if paths else []), F.col("at").alias("carrier"), conf.alias("confidence"),
        F.col("t0").alias("t_start"), F.col("t1").alias("t_end"),
    )


def _with_path(df: DataFrame, t: Tables) -> DataFrame:
    """``df`` with ``run_path`` of track_id from frame i to j."""
    named = df.withColumn("runner", F.col("track_id"))
    return sampled(named, t, [*SEGMENT, "spell", "track_id"], "runner", "i", "j", "run_path")


def third_man_runs(t: Tables, spells: DataFrame, edges: DataFrame) -> DataFrame:
    """While A passes to B, C sprints forward and gets rid of the marker."""
    s = spell_pairs(spells).where("team1 = team2 and track_id1 <> track_id2 and t_start2 - t_end1 <= 2.5").join(frame_step(t.frames), SEGMENT)
    dt = F.col("dt_ms") / 1000.0
    pick, pad = F.greatest(F.lit(1), F.round(F.lit(0.25) / dt).cast("int")), F.round(F.lit(0.5) / dt).cast("int")
    last = t.frames.groupBy(*SEGMENT).agg(F.max("frame_idx").alias("last"))
    s = s.join(last, SEGMENT).withColumn("i0", F.col("i_end1")).withColumn("i1", F.least(F.col("last"), F.greatest(F.col("i_start2") + pad, F.col("i_end1") + 1)))
    s = ball_at(ball_at(s, t, "i0", "f", "att_home", "att_away", "t"), t, "i1", "g", "t").withColumn("sign", _sign(s, "team1", "f"))
    keys = [*SEGMENT, "spell"]
    frames = s.select(*keys, "team1", "track_id1", "track_id2", "sign", F.explode(F.sequence("i0", "i1", pick)).alias("frame_idx"))
    v = track_velocity(t).select(*FRAME, F.col("team").alias("team1"), "track_id", "vx", F.sqrt(F.col("vx") ** 2 + F.col("vy") ** 2).alias("v")).where("vx is not null")
    per = frames.join(v, [*FRAME, "team1"]).where("track_id <> track_id1 and track_id <> track_id2").groupBy(*keys, "track_id")
    fast = per.agg(F.count("*").alias("n"), F.max("v").alias("top"), F.count_if(F.col("sign") * F.col("vx") > 4.0).alias("fast"))
    fast = fast.where((F.col("n") >= 2) & (F.col("top") <= MAX_SPEED) & (F.col("fast") >= F.greatest(F.lit(2), F.floor(F.col("n") / 2))))
    c = fast.select(*keys, "track_id").join(s.select(*keys, "track_id1", "track_id2", "i0", "i1", F.col("f_t").alias("t0"), F.col("g_t").alias("t1")), keys)
    marks = edges.where("kind = 'marking'").select(*SEGMENT, F.col("b").alias("track_id"), F.col("t_start").alias("from"), F.col("t_end").alias("to"), "edge")
    over = c.join(marks, [*SEGMENT, "track_id"]).where("from <= t1 and to >= t0 - 1.0")
    over = separations(over, edges, d1=F.least("t1", "to"), d0=F.col("t0"))
    group = [*keys, "track_id", "track_id1", "track_id2", "i0", "i1", "t0", "t1"]
    best = over.groupBy(*group).agg(F.max(F.col("d1") - F.col("d0")).alias("growth"), F.max(F.col("to") <= F.col("t1")).alias("ended"))
    best = best.where("(ended and growth > 1.5) or growth > 3.0")
    best = _with_path(best.withColumn("i", F.col("i0")).withColumn("j", F.col("i1")), t).where(F.size("run_path") >= 2)
    place = t.positions.select(*SEGMENT, "frame_idx", F.col("track_id").alias("who"), POINT("x", "y").alias("at"))
    for name, frame, who in (("pass_from", "i0", "track_id1"), ("pass_to", "i1", "track_id2")):
        best = best.join(place.select(*SEGMENT, F.col("frame_idx").alias(frame), F.col("who").alias(who), F.col("at").alias(name)), [*SEGMENT, frame, who], "left")
    return best.select(
        *SEGMENT, F.lit("third_man_run").alias("type"), F.array("track_id1", "track_id2", "track_id").alias("players"), "run_path", "pass_from", "pass_to",
        F.least(F.lit(0.6), 0.4 + F.col("growth") / 15.0).alias("confidence"), F.col("t0").alias("t_start"), F.col("t1").alias("t_end"),
    )


def pressing_traps(t: Tables, spells: DataFrame, edges: DataFrame, paths: bool = True) -> DataFrame:
    """Three or more press edges born together on a carrier whose near teammates are all marked; the first of a spell."""
    press = edges.where("kind = 'press'").select(*SEGMENT, F.col("b").alias("carrier"), "a", F.col("t_start").alias("born"))
    born = press.select(*SEGMENT, "carrier", F.col("born").alias("t_trap")).distinct()
    groups = born.join(press, [*SEGMENT, "carrier"]).where("born - t_trap between 0 and 1.5").groupBy(*SEGMENT, "carrier", "t_trap")
    groups = groups.agg(F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("born", "a"))), lambda p: p.a).alias("pressers")).where("n >= 3")
    s = spells.select(*SEGMENT, F.col("track_id").alias("carrier"), "spell", "team", "i_start", "i_end", "t_start", "t_end")
    own = groups.join(s, [*SEGMENT, "carrier"]).where("t_start - 0.5 <= t_trap and t_trap <= t_end")
    own = own.withColumn("r", F.row_number().over(Window.partitionBy(*SEGMENT, "carrier", "t_trap").orderBy("i_start"))).where("r = 1 and t_end - t_trap >= 0.4")
    times = t.frames.select(*SEGMENT, F.col("frame_idx").alias("i_trap"), F.col("t").alias("t_now"))
    frames = own.withColumn("i_trap", F.explode(F.sequence("i_start", "i_end")))
    near = frames.join(times, [*SEGMENT, "i_trap"]).where("abs(t_now - greatest(t_trap, t_start)) < 2.0")
    keys = [*SEGMENT, "carrier", "t_trap", "n", "pressers", "spell", "team", "i_start", "i_end", "t_end"]
    at = near.groupBy(*keys).agg(F.min_by(F.struct("i_trap", "t_now"), F.struct(F.abs(F.col("t_now") - F.greatest("t_trap", "t_start")), "t_now")).alias("w")).select(*keys, "w.*")
    at = at_frame(at, t, "i_trap", "carrier", "c")
    mates = t.positions.select(*SEGMENT, F.col("frame_idx").alias("i_trap"), "team", F.col("track_id").alias("mate"), "x", "y")
    close = at.select(*SEGMENT, "carrier", "t_trap", "team", "i_trap", "t_now", "c_x", "c_y").join(mates, [*SEGMENT, "i_trap", "team"])
    close = close.where("mate <> carrier").where(dist(F.col("x"), F.col("y"), F.col("c_x"), F.col("c_y")) <= 12.0)
    marks = edges.where("kind = 'marking'").select(*SEGMENT, F.col("b").alias("mate"), F.col("t_start").alias("from"), F.col("t_end").alias("to"))
    held = [close[c] == marks[c] for c in (*SEGMENT, "mate")]
    free = close.join(marks, [*held, marks["from"] <= close.t_now, marks["to"] >= close.t_now], "left_anti")
    trapped = at.join(free.select(*SEGMENT, "carrier", "t_trap").distinct(), [*SEGMENT, "carrier", "t_trap"], "left_anti")
    first = trapped.withColumn("r", F.row_number().over(Window.partitionBy(*SEGMENT, "spell").orderBy("t_trap"))).where("r = 1")
    if paths:
        first = sampled(first.withColumn("who", F.col("carrier")), t, [*SEGMENT, "spell"], "who", "i_trap", "i_end", "carrier_path")
    return first.select(
        *SEGMENT, F.lit("pressing_trap").alias("type"), F.concat(F.array("carrier"), "pressers").alias("players"), *(["carrier_path"] if paths else []), "pressers",
        F.least(F.lit(0.8), 0.5 + 0.1 * (F.col("n") - 3)).alias("confidence"), F.col("t_trap").alias("t_start"), "t_end",
    )


def rate_limited(detections: DataFrame, gap_s: float = COOL_S) -> DataFrame:
    """Detections, of a type and set of players those ``gap_s`` after the last kept one."""
    keyed = detections.withColumn("who", F.array_sort("players"))
    fields = [c for c in detections.columns if c not in (*SEGMENT, "type")]
    return cooldown(keyed, [*SEGMENT, "type", "who"], ["t_start", "t_end"], "t_start", gap_s, fields).select(*detections.columns)
