"""From perception and calibration records to segments of frames in metres.

Splitting, ball trust, projection and the attacking direction are DataFrame
plans.  Giving players ids that last is a matching of each frame with the tracks
so far: one grouped call per segment.
"""

from __future__ import annotations

from math import hypot

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kernels import in_bounds, project
from ..schema import LENGTH, SEGMENT, Tables
from .aggregates import majority
from .assign import assign
from .folds import _middle, ball_gate, smooth_track
from .windows import ball_trust, session_split

GATE, GATE_SPEED, DROP_S, TAG_COST, ID_BONUS = 1.2, 9.0, 1.2, 3.0, 0.5
MAX_GAP_S, MIN_SEGMENT_S = 2.0, 5.0
BIG = 1e6

TRACKED = "match_id string, segment_id int, video_frame_idx long, t double, ord int, track_id string, tag string, x double, y double"


def segments(perception: DataFrame, calib: DataFrame) -> DataFrame:
    """Main-camera rows with a homography, with ``segment_id``: a new one after a gap of 2 s or any other shot; short ones go."""
    rows = perception.join(calib.select("match_id", "frame_idx", "H"), ["match_id", "frame_idx"], "left")
    other = F.coalesce(F.col("shot"), F.lit("")) != "main"
    rows = rows.where(other | F.col("H").isNotNull())
    cut = session_split(rows, ["match_id"], "t", MAX_GAP_S, other, ("frame_idx",))
    w = Window.partitionBy("match_id", "session")
    long = cut.withColumn("_len", F.max("t").over(w) - F.min("t").over(w)).where(F.col("_len") >= MIN_SEGMENT_S)
    return long.withColumn("segment_id", (F.dense_rank().over(Window.partitionBy("match_id").orderBy("session")) - 1).cast("int")).drop("_len", "session")


def detections(rows: DataFrame) -> DataFrame:
    """Players of segment rows on the pitch: tid, tag (home, away or gk), x, y, in the record's order."""
    p = rows.select(*SEGMENT, "frame_idx", "t", "H", F.posexplode("players").alias("ord", "p"))
    p = p.where("p.team in ('home', 'away', 'gk') and coalesce(p.cls, '') <> 'referee' and size(p.foot) = 2")
    at = project(F.col("H"), F.element_at("p.foot", 1), F.element_at("p.foot", 2))
    p = p.select(*SEGMENT, "frame_idx", "t", "ord", F.col("p.tid").alias("tid"), F.col("p.team").alias("tag"), at.alias("at"))
    return p.where(in_bounds(F.col("at.x"), F.col("at.y"))).select(*SEGMENT, "frame_idx", "t", "ord", "tid", "tag", "at.x", "at.y")


def balls(rows: DataFrame, ball: DataFrame | None) -> DataFrame:
    """The ball of segment rows on the pitch; with a ball file, the file fills gaps and only trusted places count."""
    px = F.when(F.size("ball") == 2, F.col("ball"))
    if ball is not None:
        # a row without a place is neither a detection nor a prediction
        known = ball.withColumn("ball_x", F.element_at("ball", 1)).withColumn("src", F.when(F.col("ball").isNotNull(), F.col("src")).otherwise("none"))
        trusted = ball_trust(known, ["match_id"]).select("match_id", "frame_idx", F.col("ball").alias("ball_file"), "trusted")
        rows = rows.join(trusted, ["match_id", "frame_idx"], "left")
        px = F.when(F.coalesce("trusted", F.lit(False)), F.coalesce(px, "ball_file"))
    at = project(F.col("H"), F.element_at(px, 1), F.element_at(px, 2))
    return rows.select(*SEGMENT, "frame_idx", "t", at.alias("at")).where(in_bounds(F.col("at.x"), F.col("at.y"))).select(*SEGMENT, "frame_idx", "t", "at.x", "at.y")


def retrack(frames):
    """Ids for the detections of one segment: ``frames`` are (t, [(tid, tag, x, y)]); yields [(id, tag)] for each.

    A track takes the detection that costs least by distance, within a gate that
    widens while it is unseen; another tag costs more, its old id less.  The tag
    given is the track's most frequent one so far.
    """
    tracks: dict[int, dict] = {}
    for t, found in frames:
        live = [(i, s) for i, s in tracks.items() if t - s["t"] <= DROP_S]
        cost = [[_cost(s, d, t) for d in found] for _, s in live]
        taken = {c: live[r][0] for r, c in assign(cost) if cost[r][c] < BIG} if live and found else {}
        out = []
        for c, (tid, tag, x, y) in enumerate(found):
            number = taken.get(c, len(tracks) + 1)
            state = tracks.setdefault(number, {"tags": {}})
            state.update(x=x, y=y, t=t, tid=tid)
            state["tags"][tag] = state["tags"].get(tag, 0) + 1
            out.append((number, _tag(state)))
        yield out


def _tag(state: dict) -> str:
    return max(state["tags"], key=state["tags"].get)


def _cost(state: dict, detection: tuple, t: float) -> float:
    tid, tag, x, y = detection
    d = hypot(x - state["x"], y - state["y"])
    if d > GATE + GATE_SPEED * (t - state["t"]):
        return BIG
    return d + TAG_COST * (tag != _tag(state)) - ID_BONUS * (tid == state["tid"])


def _retrack_segment(key, pdf):
    pdf = pdf.sort_values(["frame_idx", "ord"]).reset_index(drop=True)
    groups = [(t, g) for (_, t), g in pdf.groupby(["frame_idx", "t"], sort=True)]
    found = retrack((t, list(zip(g["tid"], g["tag"], g["x"], g["y"], strict=True))) for t, g in groups)
    ids = [x for part in found for x in part]
    pdf["track_id"], pdf["tag"] = [f"T{i}" for i, _ in ids], [tag for _, tag in ids]
    return pdf.rename(columns={"frame_idx": "video_frame_idx"})[[c.split()[0] for c in TRACKED.split(", ")]]


def fold_keepers(players: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(keepers, directions): the team of each track tagged gk, and either team's direction, in each segment.

    A keeper belongs to the team whose outfield stands on the keeper's half.  A
    team defends the end that its keeper, or else its rearmost player on
    average, is nearer to than the other team's.
    """
    outfield = players.where("tag <> 'gk'")
    mean = lambda team: F.coalesce(F.avg(F.when(F.col("tag") == team, F.col("x"))), F.lit(LENGTH / 2)).alias(f"c_{team}")
    all_segments = players.select(*SEGMENT).distinct()
    centre = all_segments.join(outfield.groupBy(*SEGMENT).agg(mean("home"), mean("away")), SEGMENT, "left")
    left = F.when(F.coalesce("c_home", F.lit(LENGTH / 2)) <= F.coalesce("c_away", F.lit(LENGTH / 2)), "home").otherwise("away")
    gk = players.where("tag = 'gk'").groupBy(*SEGMENT, "track_id").agg(F.avg("x").alias("gx")).join(centre.select(*SEGMENT, left.alias("left")), SEGMENT)
    right = F.when(F.col("left") == "home", "away").otherwise("home")
    gk = gk.select(*SEGMENT, "track_id", "gx", F.when(F.col("gx") < LENGTH / 2, F.col("left")).otherwise(right).alias("team"))
    of_gk = gk.groupBy(*SEGMENT).pivot("team", ["home", "away"]).agg(F.avg("gx"))
    rear = outfield.groupBy(*SEGMENT, "video_frame_idx", "tag").agg(F.min("x").alias("x")).groupBy(*SEGMENT).pivot("tag", ["home", "away"]).agg(F.avg("x"))
    both = all_segments.join(of_gk, SEGMENT, "left").join(rear.withColumnsRenamed({"home": "r_home", "away": "r_away"}), SEGMENT, "left")
    ref = lambda t: F.coalesce(t, f"r_{t}", F.lit(LENGTH / 2))
    plus = ref("home") <= ref("away")
    return gk, both.select(*SEGMENT, F.when(plus, 1).otherwise(-1).alias("att_home"), F.when(plus, -1).otherwise(1).alias("att_away"))


def build(perception: DataFrame, calib: DataFrame, ball: DataFrame | None = None) -> Tables:
    """Segments of at least 5 s with lasting ids, smoothed places, both teams' directions and frames numbered from 0.

    Inputs carry ``match_id`` beside the columns of their files.
    """
    rows = segments(perception, calib)
    tracked = detections(rows).groupBy(*SEGMENT).applyInPandas(_retrack_segment, TRACKED)
    gk, directions = fold_keepers(smoothed(tracked))
    number = F.row_number().over(Window.partitionBy(*SEGMENT).orderBy("frame_idx")) - 1
    frames = rows.select(*SEGMENT, F.col("frame_idx").alias("video_frame_idx"), "t", number.cast("int").alias("frame_idx"))
    places = smooth_ball(ball_gate(balls(rows, ball), SEGMENT))
    places = places.select(*SEGMENT, F.col("frame_idx").alias("video_frame_idx"), F.col("x").alias("ball_x"), F.col("y").alias("ball_y"))
    ms = F.round(F.col("t") * 1000).cast("long").alias("t_ms")
    out = frames.join(places, [*SEGMENT, "video_frame_idx"], "left").join(directions, SEGMENT, "left")
    out = out.select(*SEGMENT, "frame_idx", "t", ms, F.lit(1).alias("period"), "ball_x", "ball_y", F.coalesce("att_home", F.lit(1)).alias("att_home"), F.coalesce("att_away", F.lit(-1)).alias("att_away"))
    players = smoothed(tracked).join(gk.select(*SEGMENT, "track_id", F.col("team").alias("keeps")), [*SEGMENT, "track_id"], "left")
    team = F.when(F.col("tag") == "gk", F.col("keeps")).otherwise(F.col("tag"))
    players = players.withColumn("team", team).where("team is not null").join(frames.select(*SEGMENT, "video_frame_idx", "frame_idx"), [*SEGMENT, "video_frame_idx"])
    return Tables(out, players.select(*SEGMENT, "frame_idx", "t", ms, "ord", "track_id", "team", "x", "y"))


def smoothed(tracked: DataFrame) -> DataFrame:
    keys = [*SEGMENT, "track_id"]
    places = smooth_track(tracked.withColumnRenamed("video_frame_idx", "frame_idx"), keys).withColumnRenamed("frame_idx", "video_frame_idx")
    return tracked.drop("x", "y", "t").join(places, [*keys, "video_frame_idx"])


def smooth_ball(kept: DataFrame, max_speed: float = 40.0) -> DataFrame:
    """Median of the last three kept places; a place far from the last one starts anew."""

    def run(pdf):
        pdf = pdf.sort_values("frame_idx")
        recent, out = [], []
        for t, x, y in zip(pdf["t"], pdf["x"], pdf["y"], strict=True):
            if recent and t > recent[-1][0] and hypot(x - recent[-1][1], y - recent[-1][2]) > (t - recent[-1][0]) * max_speed:
                recent = []
            recent = [*recent[-2:], (t, x, y)]
            out.append([_middle([p[k] for p in recent]) for k in (1, 2)])
        pdf["x"], pdf["y"] = [p[0] for p in out], [p[1] for p in out]
        return pdf

    return kept.groupBy(*SEGMENT).applyInPandas(run, kept.schema)


def segment_stats(t: Tables) -> DataFrame:
    """Per segment: frames, length, players a frame, share of frames with a ball."""
    players = t.positions.groupBy(*SEGMENT).agg(F.count("*").alias("seen"))
    per = t.frames.groupBy(*SEGMENT).agg(F.count("*").alias("frames"), (F.max("t") - F.min("t")).alias("seconds"), (F.count("ball_x") / F.count("*")).alias("ball_share"))
    return per.join(players, SEGMENT, "left").withColumn("players", F.coalesce("seen", F.lit(0)) / F.col("frames")).drop("seen")


def team_votes(samples: DataFrame) -> DataFrame:
    """A track's team from its samples' clusters: the most frequent, of equals the first seen."""
    return majority(samples, ["match_id", "tid"], "team", "frame_idx")


def shifted_ids(df: DataFrame, keys: list[str], session: str, tid: str) -> DataFrame:
    """Track ids that stay unique over tracker resets: each session's ids begin after all before."""
    top = df.groupBy(*keys, session).agg(F.max(tid).alias("_top"))
    before = F.coalesce(F.sum("_top").over(Window.partitionBy(*keys).orderBy(session).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.join(top.withColumn("_before", before).drop("_top"), [*keys, session]).withColumn(tid, F.col(tid) + F.col("_before")).drop("_before")


#: Pixels: variances of the process in place and speed, of a detection, of a new track's place and speed, and of the gate.
KALMAN_PLACE, KALMAN_SPEED, KALMAN_SEEN, KALMAN_NEW_SPEED, KALMAN_GATE, COAST_FRAMES = 1.0, 25.0, 25.0, 400.0, 150.0, 12
BALL = "match_id string, frame_idx long, t double, ball array<double>, src string"


def _coasted(pdf):
    """Both axes share one covariance (place a, mixed b, speed d), as they have the same noise and start."""
    pdf = pdf.sort_values("frame_idx")
    state, a, b, d, missed, out, src = None, 0.0, 0.0, 0.0, 0, [], []
    for x, y in zip(pdf["x"], pdf["y"], strict=True):
        seen = x == x and y == y and x is not None
        if state is not None:
            state = [(p + v, v) for p, v in state]
            a, b, d = a + 2 * b + d + KALMAN_PLACE, b + d, d + KALMAN_SPEED
            gate = KALMAN_GATE + 3 * (2 * max(a, 0.0)) ** 0.5
            seen = seen and hypot(x - state[0][0], y - state[1][0]) <= gate
        if seen and state is None:
            state, a, b, d = [(x, 0.0), (y, 0.0)], KALMAN_SEEN, 0.0, KALMAN_NEW_SPEED
        elif seen:
            place, speed = a / (a + KALMAN_SEEN), b / (a + KALMAN_SEEN)
            state = [(p + place * (z - p), v + speed * (z - p)) for (p, v), z in zip(state, (x, y), strict=True)]
            a, b, d = (1 - place) * a, (1 - place) * b, d - speed * b
        missed = 0 if seen else missed + 1
        coasts = state is not None and missed <= COAST_FRAMES
        out.append([float(x), float(y)] if seen else [state[0][0], state[1][0]] if coasts else None)
        src.append("det" if seen else "kf")
    pdf["ball"], pdf["src"] = out, src
    return pdf[["match_id", "frame_idx", "t", "ball", "src"]]


def track_ball(candidates: DataFrame) -> DataFrame:
    """Ball records from the best detection of each frame (x, y, null where there is none), in pixels.

    A constant-velocity Kalman filter gates detections and carries the ball on
    over up to 12 frames without one.
    """
    rows = candidates.select("match_id", F.col("frame_idx").cast("long").alias("frame_idx"), "t", "x", "y")
    return rows.groupBy("match_id").applyInPandas(_coasted, BALL)
