"""What a presentation shows: event schedule, strongest edges, sane formations, drawable runs, nearest offside line, primitives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.kernels import circle, fade_alpha, interpolate, to_pixel
from .folds import _gather
from .windows import held_age, islands

MIN_CONF, MIN_S, SHOW_S, SLOT_S, EDGES, EVENTS = 0.35, 0.4, 1.5, 8.0, 4, 2
#: Fixed lists of types.
SHORT_TYPES = ["back_pass", "overlap", "underlap", "give_and_go", "overlap_run", "third_man_run"]
EDGE_TYPES = ["marking", "press_engage"]
SHAPE_TYPES = ["formation", "block", "offside_line"]
OFFSIDE_BALL_M, OFFSIDE_HOLD_S, MAX_RMSE, MAX_HELD_S, MIN_PLAYERS = 30.0, 2.0, 3.0, 2.0, 5


def is_event(kind: Column) -> Column:
    return ~kind.isin(EDGE_TYPES + SHAPE_TYPES)


def schedule_events(detections: DataFrame) -> DataFrame:
    """Events to show, with ``show_start`` and ``show_end``: one per type and slot, the likelier of two that want it."""
    ok = is_event(F.col("type")) & (F.col("confidence") >= MIN_CONF) & (F.col("type").isin(SHORT_TYPES) | (F.col("t_end") - F.col("t_start") >= MIN_S))
    keys = [c for c in ("match_id", "segment_id") if c in detections.columns] + ["type"]
    fields = [c for c in detections.columns if c not in keys]
    rows = _gather(detections.where(ok), keys, ["t_start", "t_end"], fields)
    kind = rows.schema["_rows"].dataType
    until = lambda x: F.greatest(x.t_end, x.t_start + SHOW_S)

    def step(out: Column, x: Column) -> Column:
        last = F.try_element_at(out, F.lit(-1))
        clash = F.coalesce(x.t_start < until(last) + SLOT_S, F.lit(False))
        swap = F.concat(F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0))), F.array(x))
        return F.when(clash & (x.confidence > last.confidence), swap).when(clash, out).otherwise(F.concat(out, F.array(x)))

    kept = rows.select(*keys, F.explode(F.aggregate("_rows", F.array().cast(kind), step)).alias("d"))
    return kept.select(*keys, *(F.col(f"d.{c}").alias(c) for c in fields), F.col("d.t_start").alias("show_start"), F.greatest(F.col("d.t_end"), F.col("d.t_start") + SHOW_S).alias("show_end"))


def active_at(detections: DataFrame, times: DataFrame, grace: float = 0.75) -> DataFrame:
    """Detections alive at each time (keys, t) of the same segment, up to ``grace`` after their end.

    Times are dealt into whole seconds, and a detection into those it spans, so
    this is an equi-join.
    """
    keys = [c for c in ("match_id", "segment_id") if c in times.columns]
    cells = F.sequence(F.floor("t_start").cast("long"), F.floor(F.col("t_end") + grace).cast("long"))
    spans = detections.withColumn("_s", F.explode(cells))
    return times.withColumn("_s", F.floor("t").cast("long")).join(spans, [*keys, "_s"]).where((F.col("t") >= F.col("t_start")) & (F.col("t") <= F.col("t_end") + grace)).drop("_s")


def top_edges(active: DataFrame, keys: list[str]) -> DataFrame:
    """The likeliest few edges of each time."""
    w = Window.partitionBy(*keys, "t").orderBy(F.desc("confidence"), "t_start", "players")
    return active.where(F.col("type").isin(EDGE_TYPES) & (F.col("confidence") >= MIN_CONF)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= EDGES)


def sane_formation(players: Column, label: Column) -> Column:
    """At most eleven players, and a label whose numbers add up to them."""
    parts = F.transform(F.split(label, "-"), lambda x: x.try_cast("int"))
    total = F.aggregate(parts, F.lit(0), lambda s, x: s + x)
    return F.coalesce((F.size(players) <= 11) & (total == F.size(players)), F.lit(False))


def drawable_runs(perception: DataFrame, calib: DataFrame) -> DataFrame:
    """Perception rows with ``drawable``, and start and end of the run of drawable rows they are in."""
    held = held_age(calib.withColumn("_good", (F.col("src") != "held") & F.col("H").isNotNull()), ["match_id"], "t", F.col("_good"))
    age = F.when(F.col("src") == "held", F.coalesce("age", F.lit(float("inf")))).otherwise(0.0)
    ok = F.col("H").isNotNull() & (F.coalesce("rmse_m", F.lit(0.0)) <= MAX_RMSE) & (age <= MAX_HELD_S)
    rows = perception.join(held.select("match_id", "frame_idx", ok.alias("_ok")), ["match_id", "frame_idx"], "left")
    good = F.coalesce("_ok", F.lit(False)) & (F.coalesce("shot", F.lit("main")) == "main") & (F.size(F.coalesce("players", F.array())) >= MIN_PLAYERS)
    w = Window.partitionBy("match_id").orderBy("frame_idx")
    rows = rows.withColumn("drawable", good).withColumn("_n", F.row_number().over(w)).drop("_ok")
    run = islands(rows, ["match_id", "drawable"], "_n")
    span = Window.partitionBy("match_id", "drawable", "island")
    edge = lambda f, name: F.when(F.col("drawable"), f("t").over(span)).alias(name)
    return run.select(*perception.columns, "drawable", edge(F.min, "run_start"), edge(F.max, "run_end"))


def offside_at(detections: DataFrame, times: DataFrame) -> DataFrame:
    """The offside line to show at each time (t, ball_x): the nearest to the ball within 30 m, the team held for 2 s.

    ``detections`` are rows with team_defending, x, samples.
    """
    keys = [c for c in ("match_id", "segment_id") if c in times.columns]
    lines = active_at(detections.where("type = 'offside_line'"), times.where("ball_x is not null"), 0.0)
    x = F.coalesce(F.try_element_at(F.filter("samples", lambda s: s.t <= F.col("t")), F.lit(-1)).x, F.col("x"))
    near = lines.withColumn("line_x", x).withColumn("gap", F.abs(F.col("line_x") - F.col("ball_x"))).where(F.col("gap") <= OFFSIDE_BALL_M)
    per = near.groupBy(*keys, "t").agg(F.array_sort(F.collect_list(F.struct("gap", "team_defending", "line_x"))).alias("lines"))
    rows = per.select(*keys, "t", F.transform("lines", lambda p: p.team_defending).alias("teams"), F.transform("lines", lambda p: p.line_x).alias("xs"))
    schema = T.StructType([*(rows.schema[c] for c in keys), T.StructField("t", T.DoubleType()), T.StructField("team", T.StringType()), T.StructField("x", T.DoubleType())])
    return rows.groupBy(*keys).applyInPandas(_held, schema)


def _held(pdf):
    """Of each time's lines, nearest first, the one to show.  Every row gives what the next one needs, so a segment is one group of Arrow batches."""
    pdf = pdf.sort_values("t")
    out, team, since = [], None, None
    for t, teams, xs in zip(pdf["t"].tolist(), pdf["teams"], pdf["xs"], strict=True):
        teams = list(teams)
        held = team is not None and teams[0] is not None and teams[0] != team and t - since <= OFFSIDE_HOLD_S and team in teams
        k = teams.index(team) if held else 0
        if team is None or teams[k] != team:
            team, since = teams[k], t
        out.append((team, xs[k]))
    pdf["team"], pdf["x"] = [o[0] for o in out], [o[1] for o in out]
    return pdf.drop(columns=["teams", "xs"])


def newest_generation(active: DataFrame, keys: list[str]) -> DataFrame:
    """Of each time's formations the two of the latest end, of its offside lines the latest of each team, and all else."""
    w = Window.partitionBy(*keys, "t", "type")
    latest = F.max("t_end").over(w)
    rows = active.withColumn("_latest", latest).withColumn("_r", F.row_number().over(w.orderBy(F.desc("t_end"), "det_ord", "players")))
    team = F.get_json_object("geometry", "$.team_defending")
    rows = rows.withColumn("_o", F.row_number().over(Window.partitionBy(*keys, "t", "type", team).orderBy(F.desc("t_end"), "det_ord")))
    formation = (F.col("t_end") >= F.col("_latest") - 1e-9) & (F.col("_r") <= 2)
    kept = F.when(F.col("type") == "formation", formation).when(F.col("type") == "offside_line", F.col("_o") == 1).otherwise(F.lit(True))
    return rows.where(kept).drop("_latest", "_r", "_o")


def base_gid(kind: Column, t_start: Column) -> Column:
    return F.format_string("%s:%.2f", kind, t_start)


PRIM = "struct<gid:string,kind:string,pts:array<array<double>>,color:array<int>,alpha:double,width:int,text:string,fill:boolean,dash:boolean>"
#: Fixed colours (red, green, blue).
COLORS = {"home": (230, 60, 60), "away": (60, 120, 230), "ink": (255, 255, 255), "event": (250, 210, 60), "edge": (180, 220, 180)}


def primitives(active: DataFrame, h: Column, width: float, height: float) -> DataFrame:
    """Drawing primitives of detections at time t: polygons, polylines, circles, arrows and labels in pixels.

    ``h`` is the homography of the row's frame, from pixels to metres.  Points
    that fall far off the image are left out, and a primitive without two points
    (a label: one) is too.
    """
    g = F.col("geometry")
    points = lambda path: F.from_json(F.get_json_object(g, path), "array<array<double>>")
    point = lambda path: F.from_json(F.get_json_object(g, path), "array<double>")
    px = lambda x, y: to_pixel(h, x, y, width, height)
    as_pixels = lambda ps: F.transform(F.filter(F.transform(ps, lambda p: px(F.element_at(p, 1), F.element_at(p, 2))), lambda q: q.isNotNull()), lambda q: F.array(q.x, q.y))
    gid = F.concat_ws(":", base_gid(F.col("type"), F.col("t_start")), F.array_join("players", ","))
    alpha = fade_alpha(F.col("t"), F.col("t_start"), F.col("t_end"), grace=0.75)

    def prim(suffix: str, kind: str, pts: Column, color: str, text: Column | None = None, width_px: int = 2, fill: bool = False, dash: bool = False) -> Column:
        return F.struct(
            F.concat(gid, F.lit(suffix)).alias("gid"), F.lit(kind).alias("kind"), pts.alias("pts"), F.array(*map(F.lit, COLORS[color])).alias("color"), alpha.alias("alpha"),
            F.lit(width_px).alias("width"), (F.lit(None).cast("string") if text is None else text).alias("text"), F.lit(fill).alias("fill"), F.lit(dash).alias("dash"),
        )

    track = F.transform(points("$.track"), lambda p: F.struct(*(F.element_at(p, i + 1).alias(n) for i, n in enumerate(("t", "xa", "ya", "xb", "yb")))))
    now = interpolate(track, F.col("t"), ("xa", "ya", "xb", "yb"))
    ends = as_pixels(F.array(F.array(now.xa, now.ya), F.array(now.xb, now.yb)))
    name = F.upper(F.regexp_replace("type", "_", " "))
    ring = lambda p, r: as_pixels(F.transform(circle(F.element_at(p, 1), F.element_at(p, 2), r), lambda q: F.array(q.x, q.y)))
    first = lambda ps: F.slice(ps, 1, 1)
    box = point("$.region")
    corners = F.transform(F.array(F.array(F.lit(1), F.lit(2)), F.array(F.lit(3), F.lit(2)), F.array(F.lit(3), F.lit(4)), F.array(F.lit(1), F.lit(4))), lambda c: F.array(F.element_at(box, F.element_at(c, 1)), F.element_at(box, F.element_at(c, 2))))
    walk = lambda path: F.transform(F.filter(points(path), lambda p: F.element_at(p, 1) <= F.col("t")), lambda p: F.slice(p, 2, 2))
    offside_x = F.get_json_object(g, "$.x").cast("double")
    by_type = {
        "formation": [prim(":hull", "polygon", as_pixels(points("$.hull")), "home", fill=True), prim(":label", "label", first(as_pixels(points("$.hull"))), "ink", F.get_json_object(g, "$.label"))],
        "offside_line": [prim(":line", "polyline", as_pixels(F.transform(F.sequence(F.lit(0), F.lit(68), F.lit(4)), lambda y: F.array(offside_x, y.cast("double")))), "ink", dash=True)],
        "back_pass": [prim(":arrow", "arrow", as_pixels(F.array(point("$.from"), point("$.to"))), "event")],
        "triangle": [prim(":area", "polygon", as_pixels(points("$.vertices")), "event", fill=True)],
        "matchup": [prim(":box", "polygon", as_pixels(corners), "event", dash=True), prim(":label", "label", first(as_pixels(corners)), "ink", F.col("type"))],
        "isolation": [prim(":link", "polyline", ends, "event"), prim(":label", "label", first(ends), "ink", F.lit("1V1 ISO"))],
        "press": [prim(":ring", "circle", ring(point("$.carrier"), 2.0), "event"), prim(":label", "chip", first(as_pixels(F.array(point("$.carrier")))), "ink", F.concat(F.lit("PRESS "), F.upper(F.get_json_object(g, "$.level"))))],
        "run": [prim(":path", "arrow", as_pixels(points("$.path")), "event"), prim(":label", "label", first(as_pixels(points("$.path"))), "ink", name)],
        "edge": [prim(":edge", "polyline", ends, "edge")],
        "play": [prim(":path", "arrow", as_pixels(F.coalesce(*(walk(f"$.{p}") for p in ("a_path", "run_path", "carrier_path")))), "event"), prim(":label", "label", first(as_pixels(F.coalesce(*(walk(f"$.{p}") for p in ("a_path", "run_path", "carrier_path"))))), "ink", name)],
    }
    kind = (
        F.when(F.col("type").rlike(r"^\d+v\d+$"), "matchup").when(F.col("type").isin("overlap", "underlap"), "run").when(F.col("type").isin(EDGE_TYPES), "edge")
        .when(F.col("type").isin("give_and_go", "overlap_run", "third_man_run", "pressing_trap", "rotation"), "play").otherwise(F.col("type"))
    )
    chosen = F.lit(None).cast(f"array<{PRIM}>")
    for name_, prims in by_type.items():
        chosen = F.when(kind == name_, F.array(*prims).cast(f"array<{PRIM}>")).otherwise(chosen)
    enough = F.filter(chosen, lambda p: F.size(p.pts) >= F.when(p.kind.isin("label", "chip"), 1).otherwise(2))
    keys = [c for c in ("match_id", "segment_id") if c in active.columns]
    return active.select(*keys, "t", F.explode(enough).alias("p")).select(*keys, "t", "p.*")
