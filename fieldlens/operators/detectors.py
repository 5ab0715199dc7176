"""Pattern detectors over one segment's frames, as DataFrame plans.

Each gives the typed columns of its pattern plus type, players, confidence,
t_start and t_end; ``plans.pipeline`` turns those into detections.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kernels import attack_depth, block_level, clip, dist, hull, point_segment, press_level
from ..schema import FRAME, SEGMENT, Tables
from .edges import tracks_of
from .folds import cooldown, reanchored
from .possession import alive
from .windows import by_segment, frame_step, islands, latest_label_shift, line_split, merge_intervals, offside_smooth

POINT = lambda x, y: F.struct(F.col(x).alias("x") if isinstance(x, str) else x.alias("x"), F.col(y).alias("y") if isinstance(y, str) else y.alias("y"))


# ------------------------------------------------------------------ team shape
def team_windows(t: Tables, window_ms: int, presence: float = 0.5, most: int = 11) -> DataFrame:
    """Mean place of each player in windows re-anchored on the frames there are.

    Players seen in less than ``presence`` of a window's frames are left out, as
    are all but the ``most`` seen.  Columns anchor, team, track_id, x, y, depth,
    back (1: rearmost), n (players left), t_start, t_end.
    """
    anchors = reanchored(t.frames, SEGMENT, "t_ms", window_ms)
    frames = t.frames.join(anchors, [*SEGMENT, "t_ms"])
    per = frames.groupBy(*SEGMENT, "anchor").agg(
        F.count("*").alias("frames"), F.min("t").alias("t_start"), F.max("t").alias("t_end"),
        F.min_by("att_home", "t_ms").alias("att_home"), F.min_by("att_away", "t_ms").alias("att_away"),
    )
    seen = t.positions.join(frames.select(*FRAME, "anchor"), FRAME).groupBy(*SEGMENT, "anchor", "team", "track_id")
    means = seen.agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count("*").alias("times")).join(per, [*SEGMENT, "anchor"])
    means = means.where(F.col("times") / F.col("frames") >= presence)
    keys = [*SEGMENT, "anchor", "team"]
    means = means.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("times"), "track_id"))).where(F.col("place") <= most)
    sign = F.coalesce(F.when(F.col("team") == "home", F.col("att_home")).otherwise(F.col("att_away")), F.lit(1))
    means = means.withColumn("depth", attack_depth(F.col("x"), sign))
    w = Window.partitionBy(*keys)
    return means.withColumn("back", F.row_number().over(w.orderBy("depth", "track_id"))).withColumn("n", F.count("*").over(w)).drop("times", "frames", "place", "att_home", "att_away")


def _shape(t: Tables, window_ms: int, min_gap: float, min_outfield: int) -> DataFrame:
    outfield = team_windows(t, window_ms).where((F.col("n") > min_outfield) & (F.col("back") > 1))
    return line_split(outfield, [*SEGMENT, "anchor", "team"], "depth", min_gap)


def formations(t: Tables, window_ms: int = 5000, min_gap: float = 5.0, min_outfield: int = 6) -> DataFrame:
    keys = [*SEGMENT, "anchor", "team"]
    lines = _shape(t, window_ms, min_gap, min_outfield)
    per_line = lines.groupBy(*keys, "line", "n", "t_start", "t_end").agg(
        F.count("*").alias("size"), F.array_sort(F.collect_list(F.struct("y", "x"))).alias("points"),
        F.array_sort(F.collect_list(F.struct("depth", "track_id"))).alias("ids"),
    )
    whole = per_line.groupBy(*keys, "n", "t_start", "t_end").agg(F.array_sort(F.collect_list(F.struct("line", "size", "points", "ids"))).alias("lines"))
    points = F.flatten(F.transform("lines", lambda ln: F.transform(ln.points, lambda p: F.struct(p.x.alias("x"), p.y.alias("y")))))
    out = whole.select(
        *keys, F.lit("formation").alias("type"), F.flatten(F.transform("lines", lambda ln: F.transform(ln.ids, lambda p: p.track_id))).alias("players"),
        F.array_join(F.transform("lines", lambda ln: ln.size.cast("string")), "-").alias("label"),
        F.transform("lines", lambda ln: F.transform(ln.points, lambda p: F.array(p.x, p.y))).alias("lines"), hull(points).alias("hull"),
        F.least(F.lit(1.0), (F.col("n") - 1) / 10.0).alias("confidence"), "t_start", "t_end",
    )
    return latest_label_shift(out, [*SEGMENT, "team"], "anchor", "label")


def blocks(t: Tables, window_ms: int = 2000, min_gap: float = 5.0, min_outfield: int = 6) -> DataFrame:
    keys = [*SEGMENT, "anchor", "team"]
    lines = _shape(t, window_ms, min_gap, min_outfield)
    first = F.col("line") == 1
    out = lines.groupBy(*keys, "n", "t_start", "t_end").agg(
        F.array_sort(F.collect_list(F.struct("depth", "track_id"))).alias("ids"), (F.max("y") - F.min("y")).alias("width"),
        (F.max("depth") - F.min("depth")).alias("depth"), F.avg(F.when(first, F.col("depth"))).alias("line_height"), F.avg(F.when(first, F.col("x"))).alias("line_x"),
    )
    return out.select(
        *keys, F.lit("block").alias("type"), F.transform("ids", lambda p: p.track_id).alias("players"), "width", "depth", "line_height", "line_x",
        block_level(F.col("line_height")).alias("block"), F.least(F.lit(1.0), (F.col("n") - 1) / 10.0).alias("confidence"), "t_start", "t_end",
    )


def offside_lines(t: Tables, segment_ms: int = 2000, smooth_s: float = 0.5) -> DataFrame:
    smooth = offside_smooth(t, smooth_s).where("x is not null")
    keys = [*SEGMENT, "team", "island"]
    runs = islands(smooth, [*SEGMENT, "team"])
    cut = runs.join(reanchored(runs, keys, "t_ms", segment_ms, closing=True), [*keys, "t_ms"])
    out = cut.groupBy(*keys, "anchor").agg(
        F.max_by("x", "t_ms").alias("x"), F.array_sort(F.collect_list(F.struct("t", "x"))).alias("samples"), F.min("t").alias("t_start"), F.max("t").alias("t_end")
    )
    return out.select(
        *SEGMENT, F.lit("offside_line").alias("type"), F.array().cast("array<string>").alias("players"), F.col("team").alias("team_defending"), "x", "samples",
        F.lit(0.5).alias("confidence"), "t_start", "t_end",
    )


# --------------------------------------------------------------------- passing
def trios(t: Tables, carriers: DataFrame, low: float = 5.0, high: float = 22.0) -> DataFrame:
    """Carrier and two teammates with all three sides from ``low`` to ``high``."""
    mates = t.positions.select(*FRAME, "team", "ord", "track_id", "x", "y").join(carriers.select(*FRAME, "team", "carrier", "cx", "cy"), [*FRAME, "team"])
    d = dist(F.col("x"), F.col("y"), F.col("cx"), F.col("cy"))
    near = mates.where("track_id <> carrier").withColumn("d", d).where(F.col("d").between(low, high))
    one, two = (near.select(*FRAME, "team", "carrier", "cx", "cy", *(F.col(c).alias(f"{c}{i}") for c in ("ord", "track_id", "x", "y", "d"))) for i in (1, 2))
    both = one.join(two.drop("carrier", "cx", "cy"), [*FRAME, "team"]).where("ord1 < ord2")
    d12 = dist(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    return both.withColumn("d12", d12).where(F.col("d12").between(low, high)).withColumn("max_side", F.greatest("d12", "d1", "d2"))


def open_trios(t: Tables, found: DataFrame, clear: float = 2.0) -> DataFrame:
    """Trios without an opponent nearer than ``clear`` to a side."""
    foes = t.positions.select(*FRAME, F.col("team").alias("foe"), F.col("x").alias("fx"), F.col("y").alias("fy"))
    corners = [("cx", "cy"), ("x1", "y1"), ("x2", "y2")]
    near = [point_segment(F.col("fx"), F.col("fy"), *map(F.col, (*corners[i], *corners[j]))) < clear for i, j in ((0, 1), (0, 2), (1, 2))]
    keys = [found[k] == foes[k] for k in FRAME]
    return found.join(foes, [*keys, F.col("foe") != F.col("team"), near[0] | near[1] | near[2]], "left_anti")


def triangles(t: Tables, carriers: DataFrame, high: float = 22.0, least_s: float = 1.0) -> DataFrame:
    found = open_trios(t, trios(t, carriers, high=high)).join(t.frames.select(*FRAME, "t"), FRAME)
    key = F.array_sort(F.array("carrier", "track_id1", "track_id2"))
    vertices = F.array(POINT("cx", "cy"), POINT("x1", "y1"), POINT("x2", "y2"))
    rows = islands(found.select(*FRAME, "t", key.alias("trio"), F.array("carrier", "track_id1", "track_id2").alias("players"), vertices.alias("vertices"), "max_side"), [*SEGMENT, "trio"])
    out = rows.groupBy(*SEGMENT, "trio", "island").agg(
        F.min_by("players", "frame_idx").alias("players"), F.max_by("vertices", "frame_idx").alias("vertices"), F.max("max_side").alias("max_side"),
        F.min("t").alias("t_start"), F.max("t").alias("t_end"),
    )
    conf = clip(1.5 * (1.0 - F.col("max_side") / high), 0.2, 1.0)
    return out.where(F.col("t_end") - F.col("t_start") >= least_s).select(*SEGMENT, F.lit("triangle").alias("type"), "players", "vertices", "max_side", conf.alias("confidence"), "t_start", "t_end")


def spell_pairs(spells: DataFrame, n: int = 2) -> DataFrame:
    """Each spell with the next ``n - 1``: columns end in 1, 2, ..."""
    w = by_segment().orderBy("i_start")
    columns = ("track_id", "team", "i_start", "i_end", "t_start", "t_end")
    out = spells.select(*SEGMENT, "spell", *(F.col(c).alias(f"{c}1") for c in columns), *(F.lead(c, k - 1).over(w).alias(f"{c}{k}") for k in range(2, n + 1) for c in columns))
    return out.where(F.col(f"track_id{n}").isNotNull())


def at_frame(df: DataFrame, t: Tables, frame: str, track: str, name: str) -> DataFrame:
    """``df`` with the place of ``track`` on ``frame`` as ``name``_x and ``name``_y; rows without it go."""
    at = t.positions.select(*SEGMENT, F.col("frame_idx").alias(frame), F.col("track_id").alias(track), F.col("x").alias(f"{name}_x"), F.col("y").alias(f"{name}_y"))
    return df.join(at, [*SEGMENT, frame, track])


def ball_at(df: DataFrame, t: Tables, frame: str, name: str, *more: str) -> DataFrame:
    at = t.frames.select(*SEGMENT, F.col("frame_idx").alias(frame), F.col("ball_x").alias(f"{name}_bx"), F.col("ball_y").alias(f"{name}_by"), *(F.col(c).alias(f"{name}_{c}") for c in more))
    return df.join(at, [*SEGMENT, frame])


def back_pass_candidates(t: Tables, spells: DataFrame, ratio: float = 0.6, max_speed: float = 28.0, ball_max: float = 5.0) -> DataFrame:
    pairs = spell_pairs(spells).where("team1 = team2 and track_id1 <> track_id2")
    pairs = pairs.withColumn("gap", F.col("t_start2") - F.col("t_end1")).where("gap >= 0 and gap < 3.0")
    pairs = at_frame(at_frame(pairs, t, "i_end1", "track_id1", "a"), t, "i_start2", "track_id2", "b")
    pairs = ball_at(ball_at(pairs, t, "i_end1", "a", "att_home", "att_away"), t, "i_start2", "b").join(frame_step(t.frames), SEGMENT)
    on_ball = lambda s: F.coalesce(dist(F.col(f"{s}_x"), F.col(f"{s}_y"), F.col(f"{s}_bx"), F.col(f"{s}_by")) <= ball_max, F.lit(True))
    disp = dist(F.col("a_x"), F.col("a_y"), F.col("b_x"), F.col("b_y"))
    travel = F.coalesce(dist(F.col("a_bx"), F.col("a_by"), F.col("b_bx"), F.col("b_by")), disp)
    sign = F.coalesce(F.when(F.col("team1") == "home", F.col("a_att_home")).otherwise(F.col("a_att_away")), F.lit(1))
    rows = pairs.where(on_ball("a") & on_ball("b")).withColumn("disp", disp).withColumn("travel", travel).where("travel >= 3.0 and disp >= 1e-6")
    rows = rows.withColumn("ratio", (F.col("a_x") - F.col("b_x")) * sign / F.col("disp")).where(F.col("ratio") >= ratio)
    speed = F.greatest("travel", "disp") / F.greatest("gap", F.col("dt_ms") / 1000.0)
    rows = rows.withColumn("speed", speed).where(F.col("speed") <= max_speed)
    conf = clip(0.6 * F.col("ratio") + 0.4 * (1.0 - F.col("speed") / max_speed), 0.2, 1.0)
    return rows.select(
        *SEGMENT, F.array_sort(F.array("track_id1", "track_id2")).alias("pair"), F.lit("back_pass").alias("type"), F.array("track_id1", "track_id2").alias("players"),
        POINT("a_x", "a_y").alias("from"), POINT("b_x", "b_y").alias("to"), conf.alias("confidence"), F.col("t_end1").alias("t_start"), F.col("t_start2").alias("t_end"), "spell",
    )


def back_passes(t: Tables, spells: DataFrame, gap_s: float = 8.0) -> DataFrame:
    """Passes towards the own goal; of an unordered pair's, those ``gap_s`` after the last kept one."""
    found = back_pass_candidates(t, spells)
    return cooldown(found, [*SEGMENT, "pair"], ["spell"], "t_start", gap_s, ["type", "players", "from", "to", "confidence", "t_start", "t_end"]).drop("pair")


# ------------------------------------------------------------------- isolation
def isolation_frames(t: Tables, carriers: DataFrame, radius: float = 10.0, engage: float = 5.0, ghost: float = 0.3) -> DataFrame:
    """Frames on which one opponent engages the carrier and nobody else is near: carrier, defender, places, confidence."""
    others = t.positions.select(*FRAME, F.col("team").alias("of"), "ord", "track_id", "x", "y").join(carriers.select(*FRAME, "t", "carrier", "team", "cx", "cy"), FRAME)
    others = others.where("track_id <> carrier").withColumn("d", dist(F.col("x"), F.col("y"), F.col("cx"), F.col("cy")))
    foe = F.when(F.col("of") != F.col("team"), F.struct("d", "ord", "track_id", "x", "y"))
    per = others.groupBy(*FRAME, "t", "carrier", "cx", "cy").agg(F.min(foe).alias("foe"), F.array_sort(F.collect_list(F.struct("d", "track_id"))).alias("all"))
    space = F.least(F.coalesce(F.try_element_at(F.filter("all", lambda p: p.track_id != F.col("foe.track_id")), F.lit(1)).d, F.lit(float("inf"))), F.lit(radius * 3))
    per = per.withColumn("space", space).where((F.col("foe.d") > ghost) & (F.col("foe.d") < engage) & (F.col("space") >= radius))
    return per.select(*FRAME, "t", "carrier", F.col("foe.track_id").alias("defender"), "cx", "cy", F.col("foe.x").alias("dx"), F.col("foe.y").alias("dy"), clip((F.col("space") - radius) / radius, 0.0, 1.0).alias("conf"))


def isolations(t: Tables, carriers: DataFrame, least_s: float = 0.3, cool_s: float = 8.0, merge_s: float = 1.0) -> DataFrame:
    """Duels: runs of isolation frames of a pair, merged and cooled down per unordered pair.

    A sighting within ``merge_s`` of the pair's last reported one extends it;
    within ``cool_s`` of any sighting it is dropped, and ends the report's run.
    """
    rows = islands(isolation_frames(t, carriers), [*SEGMENT, "carrier", "defender"])
    seen = rows.groupBy(*SEGMENT, "carrier", "defender", "island").agg(
        F.min("t").alias("t_start"), F.max("t").alias("t_end"), F.avg("conf").alias("conf"),
        F.max_by(F.struct("cx", "cy", "dx", "dy"), "t").alias("place"), F.array_sort(F.collect_list(F.struct("t", "cx", "cy", "dx", "dy"))).alias("track"),
    )
    item = F.struct("t_start", "t_end", "conf", "carrier", "defender", "place", "track")
    pairs = seen.withColumn("pair", F.array_sort(F.array("carrier", "defender"))).groupBy(*SEGMENT, "pair").agg(F.array_sort(F.collect_list(item)).alias("s"))
    kind = pairs.schema["s"].dataType

    def step(a: Column, x: Column) -> Column:
        gap, n = x.t_start - a.last, F.size(a.out)
        old = F.try_element_at(a.out, F.lit(-1))
        extends = F.coalesce(a.open & (gap < merge_s), F.lit(False))
        dropped = ~extends & F.coalesce(gap < cool_s, F.lit(False))
        new = ~extends & ~dropped & (x.t_end - x.t_start >= least_s)
        span = lambda p: F.greatest(p.t_end - p.t_start, F.lit(1e-9))
        merged = F.struct(
            old.t_start.alias("t_start"), x.t_end.alias("t_end"), ((old.conf * span(old) + x.conf * span(x)) / (span(old) + span(x))).alias("conf"),
            old.carrier.alias("carrier"), old.defender.alias("defender"), x.place.alias("place"), F.concat(old.track, x.track).alias("track"),
        )
        out = F.when(extends, F.concat(F.slice(a.out, F.lit(1), F.greatest(n - 1, F.lit(0))), F.array(merged))).when(new, F.concat(a.out, F.array(x))).otherwise(a.out)
        return F.struct(x.t_end.alias("last"), (extends | new).alias("open"), out.alias("out"))

    start = F.struct(F.lit(None).cast("double").alias("last"), F.lit(False).alias("open"), F.array().cast(kind).alias("out"))
    kept = pairs.select(*SEGMENT, F.explode(F.aggregate("s", start, step, lambda a: a.out)).alias("d"))
    return kept.select(*SEGMENT, F.lit("isolation").alias("type"), F.array("d.carrier", "d.defender").alias("players"), "d.place", "d.track", F.col("d.conf").alias("confidence"), "d.t_start", "d.t_end")


# ------------------------------------------------------------------------ runs
def mate_paths(t: Tables, spells: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """A row a spell and teammate of its holder: ``path``, the mate's and the holder's places on the spell's frames, in order.

    A spell bounds the array; windows are slices of it.
    """
    own = alive(spells, "spell", F.col("track_id").alias("carrier"), "team", "i_start", "i_end")
    mates = t.positions.select(*FRAME, "t", "team", "track_id", "x", "y")
    if extra is not None:
        mates = mates.join(extra, [*FRAME, "track_id"], "left")
    else:
        mates = mates.withColumn("v", F.lit(None).cast("double"))
    place = t.positions.select(*FRAME, F.col("track_id").alias("carrier"), F.col("x").alias("cx"), F.col("y").alias("cy"))
    rows = own.join(mates, [*FRAME, "team"]).where("track_id <> carrier").join(place, [*FRAME, "carrier"], "left")
    point = F.struct(F.col("frame_idx").alias("i"), "t", "x", "y", "cx", "cy", "v")
    signs = t.frames.select(*FRAME, "att_home", "att_away").withColumnRenamed("frame_idx", "i_start")
    out = rows.groupBy(*SEGMENT, "spell", "carrier", "team", "track_id", "i_start", "i_end").agg(F.array_sort(F.collect_list(point)).alias("path"))
    out = out.join(signs, [*SEGMENT, "i_start"]).join(frame_step(t.frames), SEGMENT)
    sign = F.coalesce(F.when(F.col("team") == "home", F.col("att_home")).otherwise(F.col("att_away")), F.lit(1))
    return out.withColumn("sign", sign).drop("att_home", "att_away")


WINDOWS = "match_id string, segment_id int, spell int, carrier string, track_id string, i int, j int, t0 double, t1 double, kind string, speed double, at_x double, at_y double"


def path_windows(paths: DataFrame, find) -> DataFrame:
    """Windows that ``find`` picks from each path, (i, j, kind, speed): path rows are narrow, so nothing is shuffled.

    ``find(path, sign, dt)`` gets arrays i, t, x, y, cx, cy, v of a path.
    """

    def run(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                path = {k: np.array([np.nan if p[k] is None else p[k] for p in r.path], float) for k in ("i", "t", "x", "y", "cx", "cy", "v")}
                at = {int(i): k for k, i in enumerate(path["i"])}
                for i, j, kind, speed in find(path, r.sign, r.dt_ms / 1000, int(r.i_start)):
                    a, z = at[i], at[j]
                    rows.append((r.match_id, r.segment_id, r.spell, r.carrier, r.track_id, i, j, path["t"][a], path["t"][z], kind, speed, path["cx"][z], path["cy"][z]))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in WINDOWS.split(", ")], dtype=object)

    return paths.mapInPandas(run, WINDOWS)


def whole_windows(path: dict, n: int):
    """Places k at which a path has n + 1 consecutive frames from k on."""
    import numpy as np

    i = path["i"]
    return np.flatnonzero(i[n:] - i[:-n] == n) if len(i) > n else np.zeros(0, int)


def _find_runs(speed_min: float, window_s: float, max_speed: float, level: float):
    def side(y, cy):
        out_r, out_c = min(y, 68.0 - y), min(cy, 68.0 - cy)
        if (y - 34.0) * (cy - 34.0) > 0 and out_r < out_c:
            return "overlap"
        return "underlap" if min(34.0, cy) <= y <= max(34.0, cy) and abs(y - cy) > 1e-9 else None

    def find(path, sign, dt, first):
        import numpy as np

        n, sm = max(2, round(window_s / dt)), max(1, round(0.4 / dt))
        t, x, y, cx, cy = (path[k] for k in ("t", "x", "y", "cx", "cy"))
        if len(t) <= n:
            return
        gone = np.diff(t)
        with np.errstate(divide="ignore", invalid="ignore"):
            jump = np.where(gone > 0, np.hypot(np.diff(x), np.diff(y)) / gone, 0.0) > max_speed
        jumps = np.r_[0, np.cumsum(jump)]
        for k in whole_windows(path, n):
            z = k + n
            if jumps[z] > jumps[k] or np.isnan(cx[k]) or np.isnan(cx[z]) or sign * x[k] > sign * cx[k] + level:
                continue
            # means of the last sm places, of fewer at the window's start
            total = np.cumsum(np.c_[x[k : z + 1], y[k : z + 1]], axis=0)
            smooth = total.copy()
            smooth[sm:] = total[sm:] - total[:-sm]
            smooth /= np.minimum(np.arange(1, n + 2), sm)[:, None]
            moved, took = np.hypot(*np.diff(smooth, axis=0).T), np.diff(t[k : z + 1])
            speeds = moved[took > 0] / took[took > 0]
            if not len(speeds) or speeds.mean() < speed_min or sign * smooth[-1, 0] <= sign * cx[z]:
                continue
            kind = side(smooth[-1, 1], cy[z])
            if kind:
                yield int(path["i"][k]), int(path["i"][z]), kind, float(speeds.mean())

    return find


def runs(t: Tables, spells: DataFrame, speed_min: float = 4.0, window_s: float = 2.0, max_speed: float = 12.0, level: float = 0.5, paths: bool = True) -> DataFrame:
    """Overlapping and underlapping runs of a teammate past the carrier.

    The smoothing starts anew in every window, so windows are searched path by
    path; merging them is an interval merge.
    """
    of_mates = mate_paths(t, spells)
    found = path_windows(of_mates, _find_runs(speed_min, window_s, max_speed, level))
    keys = [*SEGMENT, "spell", "carrier", "track_id"]
    merged = merge_intervals(found, keys, "i", "j").groupBy(*keys, "island").agg(
        F.max_by("kind", F.struct("speed", -F.col("i"))).alias("type"), F.max("speed").alias("speed"), F.min("i").alias("i"), F.max("j").alias("j"),
        F.min("t0").alias("t_start"), F.max("t1").alias("t_end"), F.max_by(F.struct(F.col("at_x").alias("x"), F.col("at_y").alias("y")), "j").alias("at"),
    )
    stride = F.greatest(F.lit(1).cast("long"), F.floor((F.col("j") - F.col("i")) / 10))
    points = F.transform(
        F.filter("path", lambda p: p.i.between(F.col("i"), F.col("j")) & ((p.i - F.col("i")) % stride == 0)), lambda p: F.struct(p.x.alias("x"), p.y.alias("y"))
    )
    conf = F.least(F.lit(1.0), F.col("speed") / (speed_min * 2))
    if paths:
        merged = merged.join(of_mates.select(*keys, "path"), keys)
    path = [points.alias("path")] if paths else []
    return merged.select(
        *SEGMENT, "type", F.array("track_id", "carrier").alias("players"), *path, F.col("at").alias("carrier"), "speed", conf.alias("confidence"), "t_start", "t_end"
    )


# --------------------------------------------------------------------- pressing
def presses(
    t: Tables, edges: DataFrame, radius: float = 7.0, window_ms: int = 1000, engage: float = 6.0, min_closing: float = 1.0, merge_s: float = 0.5, least_s: float = 0.3, ball_max: float = 3.0,
    tracks: bool = True,
) -> DataFrame:
    """Pressing of the carrier by two or more defenders at once."""
    press = edges.where("kind = 'press'")
    rank = F.row_number().over(by_segment().orderBy("t_start", "kind", "a"))
    own = alive(press.withColumn("place", rank), "a", "b", "strength", "edge", "place")
    carrier = F.first("b").over(Window.partitionBy(*FRAME).orderBy("place"))
    own = own.withColumn("carrier", carrier).where("b = carrier")
    place = t.positions.select(*FRAME, "track_id", "x", "y")
    at = lambda df, track, name: df.join(place.select(*FRAME, F.col("track_id").alias(track), F.col("x").alias(f"{name}x"), F.col("y").alias(f"{name}y")), [*FRAME, track])
    before = F.min("frame_idx").over(by_segment().orderBy("t_ms").rangeBetween(-window_ms, 0))
    frames = t.frames.select(*FRAME, "t", "ball_x", "ball_y", before.alias("j"))
    rows = at(at(own, "carrier", "c"), "a", "p").join(frames, FRAME)
    rows = rows.where(dist(F.col("cx"), F.col("cy"), F.col("ball_x"), F.col("ball_y")) <= ball_max)
    rows = rows.withColumn("d", dist(F.col("px"), F.col("py"), F.col("cx"), F.col("cy"))).where(F.col("d") <= radius)
    old = place.withColumnRenamed("frame_idx", "j")
    for track, name in (("carrier", "c0"), ("a", "p0")):
        rows = rows.join(old.select(*SEGMENT, "j", F.col("track_id").alias(track), F.col("x").alias(f"{name}x"), F.col("y").alias(f"{name}y")), [*SEGMENT, "j", track], "left")
    rows = rows.join(t.frames.select(*SEGMENT, F.col("frame_idx").alias("j"), F.col("t").alias("t0")), [*SEGMENT, "j"])
    closing = F.when(F.col("t") > F.col("t0"), (dist(F.col("p0x"), F.col("p0y"), F.col("c0x"), F.col("c0y")) - F.col("d")) / (F.col("t") - F.col("t0")))
    per = rows.withColumn("closing", closing).groupBy(*FRAME, "t", "carrier", "cx", "cy").agg(
        F.count("*").alias("n"), F.min("d").alias("near"), F.coalesce(F.avg("closing"), F.lit(0.0)).alias("closing"), F.avg("strength").alias("strength"),
        F.array_sort(F.collect_list(F.struct("place", "a", "px", "py"))).alias("who"), F.collect_list("edge").alias("edge_ids"),
    )
    per = per.where((F.col("n") >= 2) & (F.col("near") <= engage) & (F.col("closing") >= min_closing))
    per = per.withColumn("intensity", F.col("n") + clip(F.col("closing"), 0.0, 8.0) + F.col("strength"))
    w = by_segment().orderBy("frame_idx")
    new = F.lag("t").over(w).isNull() | (F.col("t") - F.lag("t").over(w) > merge_s) | (F.lag("carrier").over(w) != F.col("carrier"))
    per = per.withColumn("new", new.cast("int")).withColumn("episode", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = per.groupBy(*SEGMENT, "episode", "carrier").agg(
        F.max("intensity").alias("intensity"), F.min("near").alias("near"), F.max_by("who", "t").alias("who"), F.max_by(POINT("cx", "cy"), "t").alias("at"),
        F.array_distinct(F.flatten(F.collect_list("edge_ids"))).alias("edge_ids"), F.min("t").alias("t_start"), F.max("t").alias("t_end"),
    )
    conf = clip(F.col("intensity") / 7.0, 0.0, 1.0) * clip(1.0 - (F.col("near") - 1.0) / radius, 0.25, 1.0)
    out = out.where(F.col("t_end") - F.col("t_start") >= least_s)
    out = tracks_of(out, edges, [*SEGMENT, "episode"]) if tracks else out.drop("edge_ids")
    return out.select(
        *SEGMENT, F.lit("press").alias("type"), F.concat(F.array("carrier"), F.transform("who", lambda p: p.a)).alias("players"), F.col("at").alias("carrier"),
        F.transform("who", lambda p: F.struct(p.px.alias("x"), p.py.alias("y"))).alias("pressers"), "intensity", press_level(F.col("intensity"), F.col("near")).alias("level"), *(["track"] if tracks else []),
        conf.alias("confidence"), "t_start", "t_end",
    )
