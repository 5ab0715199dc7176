"""Queries over the driver's tables, one for each operator that SQL can state, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernels as k
from ..operators import aggregates as agg
from ..operators import detectors, edges, folds, joins, matchups, plays, possession, present, roles
from ..operators import windows as win
from ..schema import FRAME, SEGMENT
from ..sources.adapter import tables
from . import oracle as o
from . import pipeline
from .pipeline import Scene

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
C = F.col


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def _r(c, name: str):
    return F.round(c, 6).alias(name)


def _read(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


# -------------------------------------------------------------------- kernels
@query(f"with {o.P} select frame_idx, track_id, round(sqrt((x - 52.5) * (x - 52.5) + (y - 34) * (y - 34)), 6) as d from positions")
def k_dist(spark, sf):
    """Distance of every player to the centre spot."""
    return tables(spark, sf).positions.select("frame_idx", "track_id", _r(k.dist(C("x"), C("y"), F.lit(52.5), F.lit(34.0)), "d"))


@query(f"""with {o.P},
s as (select p.frame_idx, p.track_id, p.x, p.y, a.x as ax, a.y as ay, b.x - a.x as dx, b.y - a.y as dy from positions p
  join positions a on a.frame_idx = p.frame_idx and a.ord = 0 join positions b on b.frame_idx = p.frame_idx and b.ord = 11),
u as (select *, greatest(0.0, least(1.0, ((x - ax) * dx + (y - ay) * dy) / (dx * dx + dy * dy))) as u from s)
select frame_idx, track_id, round(sqrt((x - (ax + u * dx)) * (x - (ax + u * dx)) + (y - (ay + u * dy)) * (y - (ay + u * dy))), 6) as d from u""")
def k_point_seg(spark, sf):
    """Distance of every player to the line between the keepers."""
    p = tables(spark, sf).positions
    one = lambda n, s: p.where(C("ord") == n).select(*FRAME, C("x").alias(f"{s}x"), C("y").alias(f"{s}y"))
    rows = p.join(one(0, "a"), FRAME).join(one(11, "b"), FRAME)
    return rows.select("frame_idx", "track_id", _r(k.point_segment(*map(C, ("x", "y", "ax", "ay", "bx", "by"))), "d"))


@query(f"with {o.P} select frame_idx, track_id, round(case when team = 'home' then x else 105.0 - x end, 6) as depth, round(least(y, 68.0 - y), 6) as touch from positions")
def k_depth(spark, sf):
    return win.with_sign(tables(spark, sf)).select("frame_idx", "track_id", _r(k.attack_depth(C("x"), C("sign")), "depth"), _r(k.touchline(C("y")), "touch"))


@query(f"""with {o.P} select p.frame_idx, p.track_id,
  case when (p.y - 34) * (c.y - 34) > 0 and least(p.y, 68 - p.y) < least(c.y, 68 - c.y) then 'overlap'
    when least(c.y, 34.0) < p.y and p.y < greatest(c.y, 34.0) then 'underlap' end as kind
  from positions p join positions c on c.frame_idx = p.frame_idx and c.team = p.team and c.ord % 11 = 6 where p.ord % 11 <> 6""")
def k_lateral(spark, sf):
    p = tables(spark, sf).positions
    c = p.where("ord % 11 = 6").select(*FRAME, "team", C("y").alias("cy"))
    return p.where("ord % 11 <> 6").join(c, [*FRAME, "team"]).select("frame_idx", "track_id", k.lateral(C("y"), C("cy")).alias("kind"))


@query(f"""with {o.P} select a.frame_idx, a.track_id as a, b.track_id as b,
  abs(a.x - case when a.team = 'home' then 0 else 105 end) < abs(b.x - case when a.team = 'home' then 0 else 105 end) as goal_side
  from positions a join positions b on a.frame_idx = b.frame_idx and a.team <> b.team""")
def k_goal_side(spark, sf):
    p = win.with_sign(tables(spark, sf))
    a, b = (p.select(*FRAME, "sign", *(C(c).alias(f"{c}_{s}") for c in ("track_id", "team", "x", "ord"))) for s in "ab")
    rows = a.join(b.drop("sign"), FRAME).where("team_a <> team_b")
    return rows.select("frame_idx", C("track_id_a").alias("a"), C("track_id_b").alias("b"), k.goal_side(C("x_a"), C("x_b"), C("sign")).alias("goal_side"))


H = [0.09, 0.01, 4.0, -0.005, 0.12, 2.0, 0.0001, 0.0008, 1.0]


@query(f"""with {o.P}, p as (select frame_idx, track_id, x * 10 as px, y * 10 as py from positions),
w as (select *, {H[6]} * px + {H[7]} * py + {H[8]} as w from p),
q as (select frame_idx, track_id, ({H[0]} * px + {H[1]} * py + {H[2]}) / w as x, ({H[3]} * px + {H[4]} * py + {H[5]}) / w as y from w where abs(w) >= 1e-9)
select frame_idx, track_id, round(x, 6) as x, round(y, 6) as y from q where x between -3 and 108 and y between -3 and 71""")
def k_project(spark, sf):
    """Image places on the pitch by a homography, those off it left out."""
    rows = tables(spark, sf).positions.select("frame_idx", "track_id", (C("x") * 10).alias("px"), (C("y") * 10).alias("py"), F.array(*map(F.lit, H)).alias("h"))
    return joins.projected(rows).select("frame_idx", "track_id", _r(C("x"), "x"), _r(C("y"), "y"))


@query(f"""with {o.P}, b as (select a.frame_idx, a.x as x1, a.y as y1, a.x + 12 as x2, a.y + 16 as y2, c.x as u1, c.y as v1, c.x + 10 as u2, c.y + 14 as v2
  from positions a join positions c on a.frame_idx = c.frame_idx and a.ord = 5 and c.ord = 6),
i as (select *, greatest(0.0, least(x2, u2) - greatest(x1, u1)) * greatest(0.0, least(y2, v2) - greatest(y1, v1)) as i from b)
select frame_idx, round(i / ((x2 - x1) * (y2 - y1) + (u2 - u1) * (v2 - v1) - i), 6) as iou, round((x1 + x2) / 2, 6) as foot_x, round(y2, 6) as foot_y from i""")
def k_iou(spark, sf):
    p = tables(spark, sf).positions
    a, c = (p.where(C("ord") == n).select(*FRAME, C("x").alias(f"{s}x"), C("y").alias(f"{s}y")) for n, s in ((5, "a"), (6, "c")))
    b = a.join(c, FRAME)
    box = (C("ax"), C("ay"), C("ax") + 12, C("ay") + 16)
    foot = k.foot_point(F.array(*box))
    return b.select("frame_idx", _r(k.iou(box, (C("cx"), C("cy"), C("cx") + 10, C("cy") + 14)), "iou"), _r(foot.x, "foot_x"), _r(foot.y, "foot_y"))


@query(f"""with {o.P}, l as (select frame_idx, ord, x, y, lead(x) over w as nx, lead(y) over w as ny from positions window w as (partition by frame_idx order by ord)),
n as (select *, greatest(cast(floor(sqrt((x - nx) * (x - nx) + (y - ny) * (y - ny)) / 1.5) as int), 1) as n from l where nx is not null),
p as (select frame_idx, x + (nx - x) * j / n as x, y + (ny - y) * j / n as y from n, generate_series(0, 200) g(j) where j < n
  union all select frame_idx, x, y from l where nx is null)
select frame_idx, count(*) as points, round(sum(x), 6) as sx, round(sum(y), 6) as sy from p group by frame_idx having count(distinct frame_idx) = 1""")
def k_densify(spark, sf):
    # a frame's few rows become hundreds of points, so frames are dealt into all partitions, which aren't merged for their small size
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    line = tables(spark, sf).positions.repartition(parts, *FRAME).groupBy(*FRAME).agg(F.array_sort(F.collect_list(F.struct("ord", "x", "y"))).alias("p"))
    dense = line.select("frame_idx", F.explode(k.densify(F.transform("p", lambda q: F.struct(q.x.alias("x"), q.y.alias("y"))))).alias("q"))
    return dense.groupBy("frame_idx").agg(F.count("*").alias("points"), _r(F.sum("q.x"), "sx"), _r(F.sum("q.y"), "sy"))


@query(f"""with {o.P}, c as (select frame_idx, track_id, j, x + 5 * cos(j * 2 * pi() / 28) as x, y + 5 * sin(j * 2 * pi() / 28) as y from positions, generate_series(0, 28) g(j))
select frame_idx, track_id, cast(j as int) as j, round(x, 6) as x, round(y, 6) as y from c""")
def k_circle(spark, sf):
    p = tables(spark, sf).positions
    return p.select("frame_idx", "track_id", F.posexplode(k.circle(C("x"), C("y"), 5.0)).alias("j", "q")).select("frame_idx", "track_id", "j", _r(C("q.x"), "x"), _r(C("q.y"), "y"))


@query(f"""with {o.P}, s as (select * from positions where frame_idx % 5 = 0),
q as (select frame_idx + 0.37 as tq, frame_idx, ord, track_id from positions),
b as (select q.frame_idx, q.track_id, q.tq / 10 as tq, (select arg_max((t, x, y), t) from s where s.ord = q.ord and s.t <= q.tq / 10) as b,
  (select arg_min((t, x, y), t) from s where s.ord = q.ord and s.t >= q.tq / 10) as a from q)
select frame_idx, track_id, round(case when b is null then a[2] when a is null or a[1] = b[1] then b[2] else b[2] + (tq - b[1]) / (a[1] - b[1]) * (a[2] - b[2]) end, 6) as x,
  round(case when b is null then a[3] when a is null or a[1] = b[1] then b[3] else b[3] + (tq - b[1]) / (a[1] - b[1]) * (a[3] - b[3]) end, 6) as y from b""")
def k_interp(spark, sf):
    """Places between samples at every fifth frame, of each player on each frame."""
    p = tables(spark, sf).positions
    key = [*SEGMENT, "track_id"]
    samples = p.where("frame_idx % 5 = 0").select(*key, "t", "x", "y")
    times = p.select(*FRAME, "track_id", ((C("frame_idx") + 0.37) / 10).alias("t"))
    return joins.interpolated(times, samples, key, "t", "x", "y").select("frame_idx", "track_id", _r(C("x"), "x"), _r(C("y"), "y"))


@query("""with v as (select vec_id, embedding as e, first_value(embedding) over (order by vec_id) as f from embeddings)
select vec_id, round(list_dot_product(cast(e as double[]), cast(f as double[])) / (sqrt(list_dot_product(cast(e as double[]), cast(e as double[]))) * sqrt(list_dot_product(cast(f as double[]), cast(f as double[])))), 6) as sim from v""")
def k_cosine(spark, sf):
    v = _read(spark, sf, "embeddings")
    first = v.agg(F.min_by("embedding", "vec_id").alias("f"))
    return v.join(F.broadcast(first)).select("vec_id", _r(k.cosine(C("embedding"), C("f")), "sim"))


@query("""select event_id, case when v >= 5 and n <= 3 then 'high' when v >= 3 then 'medium' else 'low' end as press,
  case when line < 35.0 then 'low' when line < 70.0 then 'mid' else 'high' end as block,
  round(greatest(0.2, least(1.0, least(s - 1 + 0.04, 4 - s + 0.04) / 0.3)), 6) as alpha,
  regexp_matches(kind, '^[0-9]+v[0-9]+$') as matchup, kind || ':' || event_id as gid
from (select event_id, value / 50 as v, event_id % 7 as n, event_id % 105 as line, (event_id % 50) / 10 as s, (event_id % 4) || case when event_id % 3 = 0 then 'v' else 'x' end || (event_id % 5) as kind from events)""")
def k_labels(spark, sf):
    """Level, fade and label rules over a grid of inputs."""
    e = _read(spark, sf, "events")
    n, i = C("event_id") % 7, C("event_id")
    kind = F.concat((i % 4).cast("string"), F.when(i % 3 == 0, "v").otherwise("x"), (i % 5).cast("string"))
    return e.select(
        "event_id", k.press_level(C("value") / 50, n).alias("press"), k.block_level((i % 105).cast("double")).alias("block"),
        _r(k.fade_alpha((i % 50) / 10, F.lit(1.0), F.lit(4.0)), "alpha"), k.is_matchup(kind).alias("matchup"), F.concat_ws(":", kind, i).alias("gid"),
    )


@query("select cast(i as int) as i, round(x / 12000.0 * 105, 6) as x, round(68 - y / 7000.0 * 68, 6) as y from (values " + ", ".join(str((i, *p)) for i, p in enumerate(k.LANDMARKS_CM)) + ") v(i, x, y)")
def k_landmarks(spark, sf):
    marks = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in k.LANDMARKS_CM))
    rows = spark.range(1).select(F.posexplode(marks).alias("i", "p")).select("i", k.landmark_m(C("p.x"), C("p.y")).alias("m"))
    return rows.select("i", _r(C("m.x"), "x"), _r(C("m.y"), "y"))


# -------------------------------------------------------------------- windows
@query(f"""with {o.P}, j as (select frame_idx, min(frame_idx) over (order by t_ms range between 400 preceding and current row) as j from frames)
select p.frame_idx, p.track_id, round((p.x - q.x) / nullif(p.t - q.t, 0), 6) as vx, round((p.y - q.y) / nullif(p.t - q.t, 0), 6) as vy
from positions p join j using (frame_idx) left join positions q on q.frame_idx = j.j and q.track_id = p.track_id""")
def w_track_velocity(spark, sf):
    return win.track_velocity(tables(spark, sf)).select("frame_idx", "track_id", _r(C("vx"), "vx"), _r(C("vy"), "vy"))


@query(f"with {o.P}, {o.RANKED} select frame_idx, team, track_id, round(x, 6) as x from ranked where back = 2")
def w_second_rearmost(spark, sf):
    return win.second_rearmost(tables(spark, sf)).select("frame_idx", "team", "track_id", _r(C("x"), "x"))


@query(f"with {o.P}, {o.RANKED} select frame_idx, team, count(*) as n, round(avg(x), 6) as x from ranked where back > 1 group by all")
def w_outfield(spark, sf):
    return win.outfield(tables(spark, sf)).groupBy("frame_idx", "team").agg(F.count("*").alias("n"), _r(F.avg("x"), "x"))


SMOOTH = """,
r2 as (select frame_idx, t, t_ms, team, x from ranked where back = 2),
grid as (select f.frame_idx, f.t, f.t_ms, g.team, r2.x from frames f cross join (values ('home'), ('away')) g(team) left join r2 on r2.frame_idx = f.frame_idx and r2.team = g.team),
sm as (select *, avg(x) over (partition by team order by frame_idx rows between 4 preceding and current row) as sx from grid)"""


@query(f"with {o.P}, {o.RANKED}{SMOOTH} select frame_idx, team, round(sx, 6) as x from sm")
def w_offside_smooth(spark, sf):
    return win.offside_smooth(tables(spark, sf)).select("frame_idx", "team", _r(C("x"), "x"))


@query(f"with recursive {o.P}, {o.shapes(2000)} select anchor, team, track_id, cast(line as int) as line from lines")
def w_line_split(spark, sf):
    s = detectors._shape(tables(spark, sf), 2000, 5.0, 6)
    return s.select("anchor", "team", "track_id", C("line").cast("int").alias("line"))


@query("""with m as (select user_id, event_id, ts, (epoch_us(ts) // 1000) as s, (epoch_us(ts) // 1000) + cast(value * 100000 as bigint) as e from events),
n as (select *, case when max(e) over (partition by user_id order by s, e rows between unbounded preceding and 1 preceding) >= s then 0 else 1 end as new from m)
select user_id, event_id, cast(sum(new) over (partition by user_id order by s, e rows unbounded preceding) as bigint) as island from n""")
def w_interval_merge(spark, sf):
    e = _read(spark, sf, "events").select("user_id", "event_id", F.unix_millis(C("ts").cast("timestamp")).alias("s"), (C("value") * 100000).cast("decimal(20,0)").cast("long").alias("len"))
    return win.merge_intervals(e.withColumn("e", C("s") + C("len")), ["user_id"], "s", "e").select("user_id", "event_id", C("island").cast("long").alias("island"))


@query("""with m as (select user_id, event_id, ts, event_type = 'error' as bad, sum(case when event_type = 'error' then 1 else 0 end) over (partition by user_id order by ts rows unbounded preceding) as b from events),
g as (select *, lag(ts) over w as pt, lag(b) over w as pb from m where not bad window w as (partition by user_id order by ts))
select user_id, event_id, cast(sum(case when pt is null or (epoch_us(ts) // 1000) - epoch_ms(pt) > 20000000 or b <> pb then 1 else 0 end) over (partition by user_id order by ts rows unbounded preceding) as bigint) as session from g""")
def w_session_split(spark, sf):
    e = _read(spark, sf, "events").withColumn("s", F.unix_millis(C("ts").cast("timestamp")))
    return win.session_split(e, ["user_id"], "s", 20_000_000, C("event_type") == "error").select("user_id", "event_id", C("session").cast("long").alias("session"))


@query("""select user_id, event_id, cast((epoch_us(ts) // 1000) - max(case when value >= 100 then (epoch_us(ts) // 1000) end) over (partition by user_id order by ts rows unbounded preceding) as bigint) as age from events""")
def w_held_age(spark, sf):
    e = _read(spark, sf, "events").withColumn("s", F.unix_millis(C("ts").cast("timestamp")))
    return win.held_age(e, ["user_id"], "s", C("value") >= 100).select("user_id", "event_id", "age")


@query(f"""with {o.P}, b as (select frame_idx, t, ball_x, case when frame_idx % 32 < 20 then 'det' else 'kf' end as src from frames),
a as (select *, t - max(case when src = 'det' then t end) over (order by t rows unbounded preceding) as age from b)
select frame_idx, ball_x is not null and coalesce(age <= 0.5, false) as trusted from a""")
def w_ball_trust(spark, sf):
    f = tables(spark, sf).frames.withColumn("src", F.when(C("frame_idx") % 32 < 20, "det").otherwise("kf"))
    return win.ball_trust(f, SEGMENT).select("frame_idx", "trusted")


@query("""with l as (select user_id, event_id, ts, event_type as v, lag(event_type) over (partition by user_id order by ts) as p from events),
r as (select *, sum(case when p is null or p <> v then 1 else 0 end) over (partition by user_id order by ts rows unbounded preceding) as run from l),
n as (select *, row_number() over (partition by user_id, run order by ts) as n from r)
select user_id, event_id, coalesce(last_value(case when n >= 3 then v end ignore nulls) over w, first_value(v) over w) as smooth from n window w as (partition by user_id order by ts rows unbounded preceding)""")
def w_hysteresis(spark, sf):
    return win.hysteresis(_read(spark, sf, "events"), ["user_id"], ["ts"], "event_type").select("user_id", "event_id", "smooth")


@query(f"""with {o.P}, b as (select frame_idx, ball_x as x, ball_y as y, lag(ball_x) over (order by frame_idx) as px, lag(ball_y) over (order by frame_idx) as py from frames)
select frame_idx, round(sqrt((x - px) * (x - px) + (y - py) * (y - py)), 6) as moved from b""")
def w_displacement(spark, sf):
    return win.displacement(tables(spark, sf).frames, SEGMENT, "frame_idx", "ball_x", "ball_y").select("frame_idx", _r(C("moved"), "moved"))


@query(f"with recursive {o.P}, {o.anchors('anc', 'frames', '', 5000)} select cast(t_ms as bigint) as t_ms, cast(anchor as bigint) as anchor from anc")
def w_reanchored_tumble(spark, sf):
    return folds.reanchored(tables(spark, sf).frames, SEGMENT, "t_ms", 5000).select("t_ms", "anchor")


@query(f"with recursive {o.P}, {o.anchors('anc', 'frames', '', 2000, True)} select cast(t_ms as bigint) as t_ms, cast(anchor as bigint) as anchor from anc")
def w_offside_segments(spark, sf):
    return folds.reanchored(tables(spark, sf).frames, SEGMENT, "t_ms", 2000, closing=True).select("t_ms", "anchor")


@query("""with recursive o as (select user_id, event_id, (epoch_us(ts) // 1000) as s, row_number() over (partition by user_id order by ts) as n from events),
w as (select user_id, event_id, s, n, true as kept, s as last from o where n = 1
  union all select o.user_id, o.event_id, o.s, o.n, o.s - w.last >= 86400000, case when o.s - w.last >= 86400000 then o.s else w.last end from w join o on o.user_id = w.user_id and o.n = w.n + 1)
select user_id, event_id, cast(s as bigint) as s from w where kept""")
def w_cooldown(spark, sf):
    """Of each user's events, those a day after the last kept one."""
    e = _read(spark, sf, "events").withColumn("s", F.unix_millis(C("ts").cast("timestamp")))
    return folds.cooldown(e, ["user_id"], ["s"], "s", 86_400_000, ["event_id", "s"])


@query(f"""with recursive {o.P}, b as (select frame_idx, t, ball_x + case when frame_idx % 11 = 0 then 30 else 0 end as x, ball_y as y, row_number() over (order by frame_idx) as n from frames where ball_x is not null),
w as (select n, frame_idx, t, x, y, true as ok, t as lt, x as lx, y as ly from b where n = 1
  union all select n, frame_idx, t, x, y, ok, case when ok then t else lt end, case when ok then x else lx end, case when ok then y else ly end
  from (select b.*, w.lt, w.lx, w.ly, b.t - w.lt >= 0.5 or sqrt((b.x - lx) * (b.x - lx) + (b.y - ly) * (b.y - ly)) <= (b.t - w.lt) * 40.0 as ok from w join b on b.n = w.n + 1))
select frame_idx, round(x, 6) as x, round(y, 6) as y from w where ok""")
def w_ball_gate(spark, sf):
    """The ball's places without the jumps put in at every eleventh frame."""
    f = tables(spark, sf).frames.select(*FRAME, "t", (C("ball_x") + F.when(C("frame_idx") % 11 == 0, 30).otherwise(0)).alias("x"), C("ball_y").alias("y"))
    return folds.ball_gate(f, SEGMENT).select("frame_idx", _r(C("x"), "x"), _r(C("y"), "y"))


@query(f"""with recursive {o.P}, b as (select ord, frame_idx, t, x, y, row_number() over (partition by ord order by frame_idx) as n from positions),
z as (select *, coalesce(sqrt((x - lag(x) over w) * (x - lag(x) over w) + (y - lag(y) over w) * (y - lag(y) over w)) > (t - lag(t) over w) * 12.0, true) as anew from b window w as (partition by ord order by n)),
g as (select *, sum(case when anew then 1 else 0 end) over (partition by ord order by n rows unbounded preceding) as run from z),
m as (select *, median(x) over w as mx, median(y) over w as my from g window w as (partition by ord, run order by n rows between 2 preceding and current row)),
s as (select ord, n, frame_idx, mx as sx, my as sy from m where n = 1
  union all select m.ord, m.n, m.frame_idx, case when m.anew then mx else 0.5 * mx + 0.5 * sx end, case when m.anew then my else 0.5 * my + 0.5 * sy end from s join m on m.ord = s.ord and m.n = s.n + 1)
select ord, frame_idx, round(sx + 1e-8, 6) as x, round(sy + 1e-8, 6) as y from s""")
def w_smooth_track(spark, sf):
    p = tables(spark, sf).positions
    return folds.smooth_track(p, [*SEGMENT, "ord"]).select("ord", "frame_idx", _r(C("x") + 1e-8, "x"), _r(C("y") + 1e-8, "y"))


# ---------------------------------------------------------------------- joins
@query(f"""with {o.P} select a.frame_idx, a.track_id as a, b.track_id as b, round({o.d('a.', 'b.')}, 6) as d from positions a join positions b on a.frame_idx = b.frame_idx and a.team <> b.team
where {o.d('a.', 'b.')} between 0.3 and 6.0""")
def j_cross_team_pairs(spark, sf):
    return edges.cross_pairs(tables(spark, sf), 0.3, 6.0).select("frame_idx", C("track_id_a").alias("a"), C("track_id_b").alias("b"), _r(C("d"), "d"))


TRIOS = f"""with recursive {o.P}, {o.CARRIERS},
near as materialized (select p.*, c.carrier, c.cx, c.cy, sqrt((p.x - cx) * (p.x - cx) + (p.y - cy) * (p.y - cy)) as dc from positions p join carriers c on c.frame_idx = p.frame_idx and c.team = p.team and p.track_id <> c.carrier),
trios as (select a.frame_idx, a.t, a.team, a.carrier, a.cx, a.cy, a.track_id as track_id1, b.track_id as track_id2, a.x as x1, a.y as y1, b.x as x2, b.y as y2,
  greatest(a.dc, b.dc, {o.d('a.', 'b.')}) as max_side from near a join near b on a.frame_idx = b.frame_idx and a.ord < b.ord
  where a.dc between 5 and 22 and b.dc between 5 and 22 and {o.d('a.', 'b.')} between 5 and 22)""".replace("near as (select p.*, sqrt", "near0 as (select p.*, sqrt").replace("from near where d <= 2.0", "from near0 where d <= 2.0")


def _seg(a: str, b: str) -> str:
    ax, ay, bx, by = (*a.split(), *b.split())
    u = f"greatest(0.0, least(1.0, ((q.x - {ax}) * ({bx} - {ax}) + (q.y - {ay}) * ({by} - {ay})) / (({bx} - {ax}) * ({bx} - {ax}) + ({by} - {ay}) * ({by} - {ay}))))"
    return f"sqrt((q.x - ({ax} + {u} * ({bx} - {ax}))) ** 2 + (q.y - ({ay} + {u} * ({by} - {ay}))) ** 2) < 2.0"


OPEN = TRIOS + f""",
opened as (select * from trios t where not exists (select 1 from positions q where q.frame_idx = t.frame_idx and q.team <> t.team
  and ({_seg('cx cy', 'x1 y1')} or {_seg('cx cy', 'x2 y2')} or {_seg('x1 y1', 'x2 y2')})))"""


@query(TRIOS + " select frame_idx, carrier, track_id1, track_id2, round(max_side, 6) as max_side from trios")
def j_trios(spark, sf):
    s = Scene(tables(spark, sf))
    return detectors.trios(s.tables, s.carriers).select("frame_idx", "carrier", "track_id1", "track_id2", _r(C("max_side"), "max_side"))


@query(OPEN + " select frame_idx, carrier, track_id1, track_id2 from opened")
def j_lane_anti(spark, sf):
    s = Scene(tables(spark, sf))
    return detectors.open_trios(s.tables, detectors.trios(s.tables, s.carriers)).select("frame_idx", "carrier", "track_id1", "track_id2")


@query(f"with recursive {o.P}, {o.SPELLS} select f.frame_idx, s.track_id, s.team from frames f join spells s on f.frame_idx between s.i_start and s.i_end")
def j_interval(spark, sf):
    return possession.alive(Scene(tables(spark, sf)).spells, "track_id", "team").select("frame_idx", "track_id", "team")


@query("""with l as (select event_id, user_id, (epoch_us(ts) // 1000) - 3600000 as s from events), r as (select user_id, (epoch_us(ts) // 1000) as s, value from events)
select event_id, round(value, 6) as value from l asof left join r on l.user_id = r.user_id and l.s >= r.s""")
def j_asof_backward(spark, sf):
    """The value that held for a user an hour before each event."""
    e = _read(spark, sf, "events").withColumn("s", F.unix_millis(C("ts").cast("timestamp")))
    left, right = e.select("event_id", "user_id", (C("s") - 3_600_000).alias("s")), e.select("user_id", "s", "value")
    return joins.asof_backward(left, right, ["user_id"], "s", "value").select("event_id", _r(C("value"), "value"))


@query("""with l as (select event_id, user_id, (epoch_us(ts) // 1000) + 5400000 as s from events), r as (select user_id, (epoch_us(ts) // 1000) as s, value from events),
b as (select l.*, r.s as bs, r.value as bv from l asof left join r on l.user_id = r.user_id and l.s >= r.s),
a as (select b.*, r.s as a_s, r.value as av from b asof left join r on b.user_id = r.user_id and b.s <= r.s)
select event_id, round(case when bs is null then av when a_s is null or s - bs <= a_s - s then bv else av end, 6) as value from a""")
def j_asof_nearest(spark, sf):
    """The value of a user's event that is nearest to an hour and a half after each event."""
    e = _read(spark, sf, "events").withColumn("s", F.unix_millis(C("ts").cast("timestamp")))
    left, right = e.select("event_id", "user_id", (C("s") + 5_400_000).alias("s")), e.select("user_id", "s", "value")
    return joins.asof_nearest(left, right, ["user_id"], "s", "value").select("event_id", _r(C("value"), "value"))


@query("""with e as (select event_id, user_id, (epoch_us(ts) // 1000) as s, value, cast(value * 1000000 as bigint) as len from events)
select l.event_id, arg_max(r.event_id, (r.value, -r.s)) as strongest, round(max(r.value), 6) as value
from e l join e r on l.user_id = r.user_id and r.s <= l.s + 3600000 and r.s + r.len >= l.s group by l.event_id""")
def j_overlap_strongest(spark, sf):
    """Of a user's intervals that overlap the hour after each event, that of the highest value."""
    e = _read(spark, sf, "events").withColumn("s", F.unix_millis(C("ts").cast("timestamp")))
    left = e.select("event_id", "user_id", C("s").alias("t0"), (C("s") + 3_600_000).alias("t1"))
    end = C("s") + (C("value") * 1_000_000).cast("decimal(20,0)").cast("long")
    right = e.select("user_id", C("s").alias("t_start"), end.alias("t_end"), "value", C("event_id").alias("strongest"))
    return joins.overlapping_strongest(left, right, ["user_id"], "value", "strongest").select("event_id", "strongest", _r(C("value"), "value"))


@query(f"""with recursive {o.P}, {o.SPELLS}, n as (select spell, track_id as a, team as ta, lead(track_id) over w as b, lead(team) over w as tb, lead(t_start) over w - t_end as gap from spells window w as (order by i_start))
select spell, a, b, ta = tb as same_team, round(gap, 6) as gap from n where b is not null""")
def j_spell_pairs(spark, sf):
    s = detectors.spell_pairs(Scene(tables(spark, sf)).spells)
    return s.select(C("spell").cast("long").alias("spell"), C("track_id1").alias("a"), C("track_id2").alias("b"), (C("team1") == C("team2")).alias("same_team"), _r(C("t_start2") - C("t_end1"), "gap"))


@query(f"""with {o.P}, a as (select frame_idx, count(*) as boxes from positions where frame_idx % 2 = 0 group by 1), b as (select frame_idx, ball_x from frames where frame_idx % 3 = 0),
c as (select frame_idx, case when frame_idx % 10 < 8 then 'main' else 'other' end as shot from frames where frame_idx % 5 = 0)
select coalesce(a.frame_idx, b.frame_idx, c.frame_idx) as frame_idx, boxes, round(ball_x, 6) as ball_x, coalesce(shot, 'main') as shot
from a full join b on a.frame_idx = b.frame_idx full join c on c.frame_idx = coalesce(a.frame_idx, b.frame_idx)""")
def j_full_outer_merge(spark, sf):
    t = tables(spark, sf)
    a = t.positions.where("frame_idx % 2 = 0").groupBy("frame_idx").agg(F.count("*").alias("boxes"))
    b = t.frames.where("frame_idx % 3 = 0").select("frame_idx", _r(C("ball_x"), "ball_x"))
    c = t.frames.where("frame_idx % 5 = 0").select("frame_idx", F.when(C("frame_idx") % 10 < 8, "main").otherwise("other").alias("shot"))
    return joins.merge_perception(a, b, c)


@query(f"with {o.P} select frame_idx from frames where frame_idx % 2 = 0 union select frame_idx from frames where frame_idx % 3 = 0 union select frame_idx from frames where frame_idx % 5 = 0")
def u_frame_ids(spark, sf):
    f = tables(spark, sf).frames
    return joins.frame_ids(*(f.where(C("frame_idx") % n == 0) for n in (2, 3, 5)))


@query(f"""with {o.P}, d as (select a.frame_idx, a.track_id as a, b.track_id as b, {o.d('a.', 'b.')} as d from positions a join positions b on a.frame_idx = b.frame_idx and a.team = 'home' and b.team = 'away'),
r as (select *, row_number() over (partition by frame_idx, a order by d, b) as ra, row_number() over (partition by frame_idx, b order by d, a) as rb from d)
select frame_idx, a, b, round(d, 6) as d from r where ra = 1 or rb = 1""")
def j_closest_pairs(spark, sf):
    p = edges.cross_pairs(tables(spark, sf), 0.0, 1e9).where("team_a = 'home'").select(*FRAME, C("track_id_a").alias("a"), C("track_id_b").alias("b"), "d")
    return joins.closest_pairs(p, FRAME, "a", "b", "d").select("frame_idx", "a", "b", _r(C("d"), "d"))


# ----------------------------------------------------------------- aggregates
@query(f"with recursive {o.P}, {o.shapes(5000)} select anchor, team, track_id, round(x, 6) as x, round(y, 6) as y, round(depth, 6) as depth, cast(n as bigint) as n from deep join (select distinct anchor from lines) using (anchor)".replace("cast(n as bigint) as n", "cast(cnt as bigint) as n"))
def g_team_window(spark, sf):
    return detectors.team_windows(tables(spark, sf), 5000).select("anchor", "team", "track_id", _r(C("x"), "x"), _r(C("y"), "y"), _r(C("depth"), "depth"), "n")


@query("""with c as (select user_id, event_type, count(*) as n, min(event_id) as f from events group by all), r as (select *, row_number() over (partition by user_id order by n desc, f) as r from c)
select user_id, event_type, n from r where r = 1""")
def g_majority(spark, sf):
    return agg.majority(_read(spark, sf, "events"), ["user_id"], "event_type", "event_id")


@query("select user_id, event_id, value from (select *, row_number() over (partition by user_id order by value desc, event_id) as r from events where value > 50) where r = 1")
def g_argmax_conf(spark, sf):
    """The event of each user's highest value, the first one of equals."""
    return agg.argmax_above(_read(spark, sf, "events"), ["user_id"], "value", 50.0, "event_id", tie="event_id")


@query("""with l as (select user_id from events group by 1 having count(*) filter (event_type = 'error' and value > 99) > 0) select distinct user_id from events where user_id not in (select user_id from l)""")
def j_without(spark, sf):
    """Users without an error of a high value."""
    e = _read(spark, sf, "events")
    return joins.without_match(e.select("user_id").distinct(), e.where("event_type = 'error' and value > 99").select("user_id").distinct(), ["user_id"])


@query("select user_id, event_type, count(*) as n, round(count(*) / 60.0, 6) as per_min from events group by all")
def g_rates(spark, sf):
    return agg.rates(_read(spark, sf, "events"), ["user_id"], "event_type", F.lit(60.0)).select("user_id", "event_type", "n", _r(C("per_min"), "per_min"))


@query("""with e as (select event_id, event_id % 5 as a, event_id % 4 as b, event_id % 6 as c, event_id % 14 as n from events) select event_id, n <= 11 and a + b + c = n as sane from e""")
def v_sane_formation(spark, sf):
    """Labels of three numbers against players of some number."""
    i = C("event_id")
    players = F.slice(F.sequence(F.lit(1), F.lit(14)), F.lit(1), (i % 14).cast("int"))
    label = F.concat_ws("-", *((i % n).cast("string") for n in (5, 4, 6)))
    return _read(spark, sf, "events").select("event_id", present.sane_formation(players, label).alias("sane"))


@query(f"""with {o.P}, c as (select *, row_number() over (partition by frame_idx order by ord) - 1 as i, count(*) over (partition by frame_idx) as n, (frame_idx % 250) / 10.0 as tq from positions),
b as (select frame_idx, any_value(tq) as tq, any_value(n) as n, arg_max(x, i) filter (i <= tq) as bx, arg_max(y, i) filter (i <= tq) as by_, max(i) filter (i <= tq) as bi,
  arg_min(x, i) filter (i >= tq) as ax, arg_min(y, i) filter (i >= tq) as ay, min(i) filter (i >= tq) as ai from c group by frame_idx)
select frame_idx, cast(bi + 1 + case when ai is null or ai = bi then 0 else 1 end as int) as points,
  round(case when ai is null or ai = bi then bx else bx + (tq - bi) / (ai - bi) * (ax - bx) end, 6) as x, round(case when ai is null or ai = bi then by_ else by_ + (tq - bi) / (ai - bi) * (ay - by_) end, 6) as y from b""")
def k_path_prefix(spark, sf):
    """The path over a frame's players, one a second, up to a time of the frame's own."""
    line = tables(spark, sf).positions.groupBy(*FRAME).agg(F.array_sort(F.collect_list(F.struct(C("ord").cast("double").alias("t"), "x", "y"))).alias("p"))
    rows = line.select("frame_idx", k.path_prefix(C("p"), (C("frame_idx") % 250) / 10.0).alias("q"))
    tip = F.element_at("q", -1)
    return rows.select("frame_idx", F.size("q").alias("points"), _r(tip.x, "x"), _r(tip.y, "y"))


def _inverse(h: list[float]) -> list[float]:
    """The adjugate of a 3x3 matrix."""
    at = lambda r, c: h[3 * (r % 3) + c % 3]
    return [at(j + 1, i + 1) * at(j + 2, i + 2) - at(j + 1, i + 2) * at(j + 2, i + 1) for i in range(3) for j in range(3)]


G = _inverse(H)


@query(f"""with {o.P}, q as (select frame_idx, track_id, {G[6]!r} * x + {G[7]!r} * y + {G[8]!r} as w, {G[0]!r} * x + {G[1]!r} * y + {G[2]!r} as u, {G[3]!r} * x + {G[4]!r} * y + {G[5]!r} as v from positions)
select frame_idx, track_id, round(u / w, 4) as px, round(v / w, 4) as py from q where abs(w) >= 1e-9 and u / w between -300 and 600 and v / w between -200 and 400""")
def k_to_pixel(spark, sf):
    """Places on an image of 300 x 200 pixels, those far off it left out."""
    at = k.to_pixel(F.array(*map(F.lit, H)), C("x"), C("y"), 300.0, 200.0)
    rows = tables(spark, sf).positions.select("frame_idx", "track_id", at.alias("p")).where("p is not null")
    return rows.select("frame_idx", "track_id", F.round("p.x", 4).alias("px"), F.round("p.y", 4).alias("py"))


@query("""with d as (select user_id, (epoch_us(ts) // 1000) - lag((epoch_us(ts) // 1000)) over (partition by user_id order by ts) as d from events), s as (select user_id, list_sort(list(d)) as l from d where d > 0 group by 1)
select user_id, cast(l[len(l) // 2 + 1] as bigint) as step from s""")
def g_upper_median(spark, sf):
    e = _read(spark, sf, "events").withColumn("s", F.unix_millis(C("ts").cast("timestamp")))
    return agg.upper_median_step(e, ["user_id"], "s")


@query("select event_type, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.9), 6) as p90, round(quantile_cont(value, 0.99), 6) as p99, count(*) as n, round(stddev_pop(value), 6) as sd from events group by 1")
def g_pctile(spark, sf):
    p = _read(spark, sf, "events").groupBy("event_type").agg(*agg.percentile_of("value", 0.5, 0.9, 0.99), F.count("*").alias("n"), F.stddev_pop("value").alias("sd"))
    return p.select("event_type", *(_r(C(c), c) for c in ("p50", "p90", "p99")), "n", _r(C("sd"), "sd"))


STATS = """with p as (select {0}, min(event_id) as a, max(event_id) as z, count(*) as n from events group by all), f as (select *, min(a) over (partition by event_type) as f from p)
select event_type, count(*) as tracks, cast(sum(n) as bigint) as seen, sum(case when a > f then 1 else 0 end)::bigint as new_tracks, cast(sum(z - a) as bigint) as life from f group by 1"""


@query(STATS.format("event_type, user_id"))
def g_track_stats(spark, sf):
    return agg.track_stats(_read(spark, sf, "events"), ["event_type"], "user_id", "event_id")


@query("select event_type, tracks, new_tracks from (" + STATS.format("event_type, user_id") + ")")
def g_segment_churn(spark, sf):
    return agg.segment_churn(_read(spark, sf, "events"), ["event_type"], "user_id", "event_id")


@query("""with c as (select event_type, cast(floor((event_id % 97) / 97.0 * 16) as int) as ix, cast(floor((user_id % 31) / 31.0 * 8) as int) as iy, count(*) as n from events group by all)
select event_type, ix, iy, round(n / sum(n) over (partition by event_type), 6) as share from c""")
def g_hist2d(spark, sf):
    e = _read(spark, sf, "events")
    h = agg.histogram_2d(e, ["event_type"], (C("event_id") % 97) / 97.0, (C("user_id") % 31) / 31.0, 16, 8)
    return h.select("event_type", "ix", "iy", _r(C("share"), "share"))


@query("""with c as (select (select embedding from embeddings order by vec_id limit 1) as a, (select embedding from embeddings order by vec_id limit 1 offset 1) as b),
d as (select vec_id, list_sum(list_transform(list_zip(embedding, a), lambda x: (x[1]::double - x[2]::double) ** 2)) as da, list_sum(list_transform(list_zip(embedding, b), lambda x: (x[1]::double - x[2]::double) ** 2)) as db from embeddings, c)
select vec_id, case when da <= db then 0 else 1 end as cluster, round(least(da, db), 6) as d2 from d""")
def g_kmeans_assign(spark, sf):
    """Vectors by the nearer of two fixed centroids, the first two vectors."""
    v = _read(spark, sf, "embeddings")
    two = [[float(x) for x in r.embedding] for r in v.orderBy("vec_id").limit(2).collect()]
    return agg.nearest_centroid(v, "embedding", two).select("vec_id", "cluster", _r(C("d2"), "d2"))


@query(f"""with {o.P}, c as (select frame_idx, case when frame_idx % 4 = 0 then 'fit' when frame_idx % 4 = 3 then 'held' else 'ema' end as src, ball_x as cx, ball_y as cy, (frame_idx % 50) / 100 as rmse from frames),
m as (select *, sqrt((cx - lag(cx) over w) ** 2 + (cy - lag(cy) over w) ** 2) as moved from c window w as (order by frame_idx))
select count(*) as n, count(cx) as valid, count(*) filter (src = 'fit') as n_fit, count(*) filter (src = 'ema') as n_ema, count(*) filter (src = 'held') as n_held,
  round(quantile_cont(rmse, 0.5) filter (src = 'fit'), 6) as rmse_p50, round(quantile_cont(rmse, 0.9) filter (src = 'fit'), 6) as rmse_p90, round(max(rmse) filter (src = 'fit'), 6) as rmse_max,
  round(quantile_cont(moved, 0.5), 6) as moved_p50, round(max(moved), 6) as moved_max from m""")
def g_calib_report(spark, sf):
    f = tables(spark, sf).frames
    src = F.when(C("frame_idx") % 4 == 0, "fit").when(C("frame_idx") % 4 == 3, "held").otherwise("ema")
    r = agg.calibration_report(f.select("match_id", "frame_idx", src.alias("src"), C("ball_x").alias("cx"), C("ball_y").alias("cy"), ((C("frame_idx") % 50) / 100).alias("rmse")))
    return r.select("n", "valid", "n_fit", "n_ema", "n_held", *(_r(C(c), c) for c in ("rmse_p50", "rmse_p90", "rmse_max", "moved_p50", "moved_max")))


@query(f"with {o.P}, d as (select frame_idx - lag(frame_idx) over (order by frame_idx) as d from frames where ball_x is not null) select greatest(cast(floor(median(d)) as int), 1) as stride from d where d > 0")
def g_stride(spark, sf):
    return agg.stride_of(tables(spark, sf).frames.where("ball_x is not null"), SEGMENT, "frame_idx").select("stride")


# -------------------------------------------------------- possession, patterns
@query(f"with recursive {o.P}, {o.SPELLS} select track_id, team, i_start, i_end, round(t_start, 6) as t_start, round(t_end, 6) as t_end from spells")
def possession_spells(spark, sf):
    return possession.spells(tables(spark, sf)).select("track_id", "team", "i_start", "i_end", _r(C("t_start"), "t_start"), _r(C("t_end"), "t_end"))


@query(f"""with recursive {o.P}, {o.shapes(5000)}, l as (select anchor, team, line, count(*) as n, any_value(t_start) as t_start, any_value(t_end) as t_end, any_value(cnt) as cnt from lines group by 1, 2, 3),
f as (select anchor, team, string_agg(n, '-' order by line) as label, round(any_value(t_start), 6) as t_start, round(any_value(t_end), 6) as t_end, round(least(1.0, (any_value(cnt) - 1) / 10), 6) as confidence from l group by 1, 2),
s as (select *, lag(label) over (partition by team order by anchor) as p from f)
select team, label, case when p <> label then p end as shift_from, t_start, t_end, confidence from s""")
def formation(spark, sf):
    d = detectors.formations(tables(spark, sf))
    return d.select("team", "label", "shift_from", _r(C("t_start"), "t_start"), _r(C("t_end"), "t_end"), _r(C("confidence"), "confidence"))


@query(f"""with recursive {o.P}, {o.shapes(2000)}, b as (select anchor, team, max(y) - min(y) as width, max(depth) - min(depth) as depth, avg(depth) filter (line = 1) as line_height, avg(x) filter (line = 1) as line_x, any_value(t_start) as t_start from lines group by 1, 2)
select team, round(t_start, 6) as t_start, round(width, 6) as width, round(depth, 6) as depth, round(line_height, 6) as line_height, round(line_x, 6) as line_x,
  case when line_height < 35 then 'low' when line_height < 70 then 'mid' else 'high' end as block from b""")
def block(spark, sf):
    d = detectors.blocks(tables(spark, sf))
    return d.select("team", _r(C("t_start"), "t_start"), *(_r(C(c), c) for c in ("width", "depth", "line_height", "line_x")), "block")


@query(f"""with recursive {o.P}, {o.RANKED}{SMOOTH}, ok as (select *, frame_idx - row_number() over (partition by team order by frame_idx) as island from sm where sx is not null),
{o.anchors('anc', 'ok', 'team, island', 2000, True)}
select team as team_defending, round(arg_max(sx, k.t_ms), 6) as x, count(*) as n, round(min(t), 6) as t_start, round(max(t), 6) as t_end
from ok k join anc a on a.team = k.team and a.island = k.island and a.t_ms = k.t_ms group by k.team, k.island, anchor""".replace("select team as team_defending", "select k.team as team_defending"))
def offside_line(spark, sf):
    d = detectors.offside_lines(tables(spark, sf))
    return d.select("team_defending", _r(C("x"), "x"), F.size("samples").cast("long").alias("n"), _r(C("t_start"), "t_start"), _r(C("t_end"), "t_end"))


@query(OPEN + """, k as (select *, list_sort([carrier, track_id1, track_id2]) as trio from opened), i as (select *, frame_idx - row_number() over (partition by trio order by frame_idx) as island from k)
select array_to_string(arg_min([carrier, track_id1, track_id2], frame_idx), ',') as players, round(max(max_side), 6) as max_side, round(min(t), 6) as t_start, round(max(t), 6) as t_end,
  round(least(1.0, greatest(0.2, 1.5 * (1 - max(max_side) / 22))), 6) as confidence from i group by trio, island having max(t) - min(t) >= 1.0""")
def triangles(spark, sf):
    s = Scene(tables(spark, sf))
    d = detectors.triangles(s.tables, s.carriers)
    return d.select(F.array_join("players", ",").alias("players"), _r(C("max_side"), "max_side"), *(_r(C(c), c) for c in ("t_start", "t_end", "confidence")))


PAIRS = f"""with recursive {o.P}, {o.SPELLS},
p as (select spell, track_id as a, team, i_end, t_end, lead(track_id) over w as b, lead(team) over w as tb, lead(i_start) over w as ib, lead(t_start) over w as tsb,
  lead(track_id, 2) over w as a2, lead(team, 2) over w as ta2, lead(i_start, 2) over w as i2, lead(t_start, 2) over w as ts2 from spells window w as (order by i_start))"""


@query(PAIRS + """,
c as (select p.*, pa.x as ax, pa.y as ay, pb.x as bx, pb.y as by_, fa.ball_x as fax, fa.ball_y as fay, fb.ball_x as fbx, fb.ball_y as fby from p
  join positions pa on pa.frame_idx = i_end and pa.track_id = a join positions pb on pb.frame_idx = ib and pb.track_id = b join frames fa on fa.frame_idx = i_end join frames fb on fb.frame_idx = ib
  where p.team = tb and a <> b and tsb - t_end >= 0 and tsb - t_end < 3),
m as (select *, sqrt((ax - bx) ** 2 + (ay - by_) ** 2) as disp, (ax - bx) * case when team = 'home' then 1 else -1 end as back, tsb - t_end as gap from c
  where coalesce(sqrt((ax - fax) ** 2 + (ay - fay) ** 2) <= 5, true) and coalesce(sqrt((bx - fbx) ** 2 + (by_ - fby) ** 2) <= 5, true)),
v as (select *, coalesce(sqrt((fax - fbx) ** 2 + (fay - fby) ** 2), disp) as travel from m),
k as (select *, greatest(travel, disp) / greatest(gap, 0.1) as speed, list_sort([a, b]) as pair from v where travel >= 3 and disp >= 1e-6 and back / disp >= 0.6),
n as (select *, row_number() over (partition by pair order by spell) as n from k where speed <= 28),
w as (select pair, n, a, b, t_end, tsb, back / disp as ratio, speed, true as kept, t_end as last from n where n = 1
  union all select n.pair, n.n, n.a, n.b, n.t_end, n.tsb, n.back / n.disp, n.speed, n.t_end - w.last >= 8, case when n.t_end - w.last >= 8 then n.t_end else w.last end from w join n on n.pair = w.pair and n.n = w.n + 1)
select a || ',' || b as players, round(t_end, 6) as t_start, round(tsb, 6) as t_end, round(least(1.0, greatest(0.2, 0.6 * ratio + 0.4 * (1 - speed / 28))), 6) as confidence from w where kept""")
def back_passes(spark, sf):
    s = Scene(tables(spark, sf))
    return detectors.back_passes(s.tables, s.spells).select(F.array_join("players", ",").alias("players"), *(_r(C(c), c) for c in ("t_start", "t_end", "confidence")))


@query(PAIRS + """,
g as (select p.*, x.x as ax, x.y as ay, z.x as bx, z.y as by_, (z.x - x.x) * case when p.team = 'home' then 1 else -1 end as fwd from p
  join positions x on x.frame_idx = i_end and x.track_id = a join positions z on z.frame_idx = i2 and z.track_id = a join positions y on y.frame_idx = ib and y.track_id = b
  where p.team = tb and tb = ta2 and a <> b and a = a2 and tsb - t_end <= 2.5 and ts2 - tsb <= 4)
select a || ',' || b as players, round(t_end, 6) as t_start, round(ts2, 6) as t_end, round(least(0.9, 0.55 + fwd / 40), 6) as confidence from g
where fwd >= 6 and ts2 > t_end and sqrt((ax - bx) ** 2 + (ay - by_) ** 2) <= (ts2 - t_end) * 12""")
def give_and_go(spark, sf):
    s = Scene(tables(spark, sf))
    return plays.give_and_go(s.tables, s.spells).select(F.array_join("players", ",").alias("players"), *(_r(C(c), c) for c in ("t_start", "t_end", "confidence")))


ISO = f"""with recursive {o.P}, {o.CARRIERS},
oth as (select c.frame_idx, c.t, c.carrier, c.team, cx, cy, p.track_id, p.team as g, p.ord, sqrt((p.x - cx) * (p.x - cx) + (p.y - cy) * (p.y - cy)) as dd from carriers c join positions p on p.frame_idx = c.frame_idx and p.track_id <> c.carrier),
foe as (select *, row_number() over (partition by frame_idx order by dd, ord) as r from oth where g <> team),
iso as (select f.frame_idx, f.t, f.carrier, f.track_id as defender, least((select min(dd) from oth where oth.frame_idx = f.frame_idx and oth.track_id <> f.track_id), 30.0) as space from foe f where r = 1 and dd > 0.3 and dd < 5)"""


@query(ISO + " select frame_idx, carrier, defender, round(least(1.0, greatest(0.0, (space - 10) / 10)), 6) as conf from iso where space >= 10")
def isolation_frames(spark, sf):
    s = Scene(tables(spark, sf))
    return detectors.isolation_frames(s.tables, s.carriers).select("frame_idx", "carrier", "defender", _r(C("conf"), "conf"))


@query(ISO + """,
q as (select *, least(1.0, greatest(0.0, (space - 10) / 10)) as conf, frame_idx - row_number() over (partition by carrier, defender order by frame_idx) as island from iso where space >= 10),
s as (select carrier, defender, list_sort([carrier, defender]) as pair, min(t) as a, max(t) as z, avg(conf) as conf from q group by carrier, defender, island),
n as (select *, row_number() over (partition by pair order by a, z) as n from s),
w as (select pair, n, carrier, defender, a as s0, z as last, z, conf, z - a >= 0.3 as open, z - a >= 0.3 as emit, 1 as chain from n where n = 1
  union all select n.pair, n.n, case when ext then w.carrier else n.carrier end, case when ext then w.defender else n.defender end, case when ext then w.s0 else n.a end, n.z, n.z,
    case when ext then (w.conf * greatest(w.z - w.s0, 1e-9) + n.conf * greatest(n.z - n.a, 1e-9)) / (greatest(w.z - w.s0, 1e-9) + greatest(n.z - n.a, 1e-9)) else n.conf end,
    ext or (n.a - w.last >= 8 and n.z - n.a >= 0.3), ext or (n.a - w.last >= 8 and n.z - n.a >= 0.3), case when ext then w.chain else w.chain + 1 end
  from (select w.*, w.open and n2.a - w.last < 1 as ext from w join n n2 on n2.pair = w.pair and n2.n = w.n + 1) w join n on n.pair = w.pair and n.n = w.n + 1)
select carrier || ',' || defender as players, round(s0, 6) as t_start, round(max(z), 6) as t_end, round(arg_max(conf, z), 6) as confidence from w where emit group by pair, chain, carrier, defender, s0""")
def isolations(spark, sf):
    s = Scene(tables(spark, sf))
    return detectors.isolations(s.tables, s.carriers).select(F.array_join("players", ",").alias("players"), *(_r(C(c), c) for c in ("t_start", "t_end", "confidence")))


def _rows(df: DataFrame) -> DataFrame:
    return df.select("type", F.array_join("players", ",").alias("players"), *(_r(C(c), c) for c in ("t_start", "t_end", "confidence")))


RUNS = f"""with recursive {o.P}, {o.SPELLS},
pt as (select s.spell, s.track_id as carrier, p.track_id, p.frame_idx as i, p.t, p.x, p.y, c.x as cx, c.y as cy, case when s.team = 'home' then 1 else -1 end as sign
  from spells s join positions p on p.frame_idx between s.i_start and s.i_end and p.team = s.team and p.track_id <> s.track_id
  left join positions c on c.frame_idx = p.frame_idx and c.track_id = s.track_id),
steps as (select *, case when sqrt((x - lag(x) over w) ** 2 + (y - lag(y) over w) ** 2) > 12.0 * (t - lag(t) over w) then 1 else 0 end as jump from pt window w as (partition by spell, track_id order by i)),
jumps as (select *, sum(jump) over (partition by spell, track_id order by i rows unbounded preceding) as jumps from steps),
win as (select a.spell, a.carrier, a.track_id, a.sign, a.i as k, z.i as z, a.t as t0, z.t as t1, z.cx as zx, z.cy as zy from jumps a join jumps z on z.spell = a.spell and z.track_id = a.track_id and z.i = a.i + 20
  where a.cx is not null and z.cx is not null and a.jumps = z.jumps and a.sign * a.x <= a.sign * a.cx + 0.5),
smooth as (select w.*, p.i, p.t, avg(p.x) over v as sx, avg(p.y) over v as sy from win w join pt p on p.spell = w.spell and p.track_id = w.track_id and p.i between w.k and w.z
  window v as (partition by w.spell, w.track_id, w.k order by p.i rows between 3 preceding and current row)),
speeds as (select *, sqrt((sx - lag(sx) over v) ** 2 + (sy - lag(sy) over v) ** 2) / (t - lag(t) over v) as speed from smooth window v as (partition by spell, track_id, k order by i)),
ends as (select spell, carrier, track_id, sign, k, z, t0, t1, zx, zy, avg(speed) as speed, arg_max(sx, i) as ex, arg_max(sy, i) as ey from speeds group by all),
kinds as (select *, case when (ey - 34) * (zy - 34) > 0 and least(ey, 68 - ey) < least(zy, 68 - zy) then 'overlap'
  when ey between least(34.0, zy) and greatest(34.0, zy) and abs(ey - zy) > 1e-9 then 'underlap' end as kind from ends where speed >= 4.0 and sign * ex > sign * zx),
marked as (select *, case when k <= max(z) over (partition by spell, track_id order by k, z rows between unbounded preceding and 1 preceding) then 0 else 1 end as new from kinds where kind is not null),
merged as (select *, sum(new) over (partition by spell, track_id order by k, z rows unbounded preceding) as island from marked)
select arg_max(kind, (speed, -k)) as type, track_id || ',' || carrier as players, round(min(t0), 6) as t_start, round(max(t1), 6) as t_end, round(least(1.0, max(speed) / 8), 6) as confidence
from merged group by spell, carrier, track_id, island"""


@query(RUNS)
def runs(spark, sf):
    s = Scene(tables(spark, sf))
    return _rows(detectors.runs(s.tables, s.spells))


@query()
def edges_marking(spark, sf):
    return _rows(edges.edge_detections(Scene(tables(spark, sf)).edges.where("kind = 'marking'")))


@query()
def edges_press(spark, sf):
    return _rows(edges.edge_detections(Scene(tables(spark, sf)).edges.where("kind = 'press'")))


@query()
def matchup(spark, sf):
    s = Scene(tables(spark, sf))
    return _rows(matchups.matchups(s.tables, s.edges, s.spells))


@query(f"""with recursive {o.P}, near as (select a.frame_idx, a.track_id as u, b.track_id as w from positions a join positions b on a.frame_idx = b.frame_idx and a.team <> b.team and {o.d('a.', 'b.')} <= 8.0),
r as (select frame_idx, u, u as v from near union select r.frame_idx, r.u, near.w from r join near on near.frame_idx = r.frame_idx and near.u = r.v),
l as (select frame_idx, u, min(v) as label from r group by all) select frame_idx, label, count(*) as members from l group by all""")
def g_components(spark, sf):
    """Components of each frame's graph of opponents at most 8 m apart."""
    pairs = edges.cross_pairs(tables(spark, sf), 0.0, 8.0).where("team_a = 'home'").select(*FRAME, C("track_id_a").alias("a"), C("track_id_b").alias("b"))
    return matchups.components(pairs).groupBy("frame_idx", "label").agg(F.count("*").alias("members"))


@query()
def press(spark, sf):
    s = Scene(tables(spark, sf, converge=True))
    return _rows(detectors.presses(s.tables, s.edges))


@query()
def roles_slots(spark, sf):
    return roles.slots(Scene(tables(spark, sf)).roles).select("team", "role", _r(C("x"), "x"), _r(C("y"), "y"))


@query()
def all_plays(spark, sf):
    return _rows(pipeline.detect_plays(Scene(tables(spark, sf)), with_rotations=True))


@query()
def run_all_counts(spark, sf):
    return pipeline.run_all(tables(spark, sf), geometry=False).groupBy("type").agg(F.count("*").alias("n"))


#: Detectors that SQL states, with their query here.
STATED = {"formation": "formation", "block": "block", "offside_line": "offside_line", "triangle": "triangles", "back_pass": "back_passes", "isolation": "isolations", "run": "runs"}


@query(" union all ".join(f"select {'type' if name == 'runs' else repr(kind)} as type, count(*) as n from ({ORACLE_SQL[name]}) group by all" for kind, name in STATED.items()))
def u_all_detections(spark, sf):
    """The union of the detectors that SQL states, counted by type."""
    return pipeline.run_all(tables(spark, sf), list(STATED)).groupBy("type").agg(F.count("*").alias("n"))


@query("""select event_id from (select event_id, row_number() over (partition by user_id order by ts) - 1 as i, count(*) over (partition by user_id) as n, user_id from events) e
where exists (select 1 from generate_series(0, 9) g(j) where i = cast(floor(j * case when n > 10 then (n - 1) / 9.0 else 1.0 end) as int))""")
def s_linspace_sample(spark, sf):
    return agg.linspace_rows(_read(spark, sf, "events"), ["user_id"], "ts", 10).select("event_id")


# --------------------------------------------------------------- presentation
@query()
def schedule_events(spark, sf):
    """Events to show, of all detectors."""
    # the schedule's rows don't show geometry: a long edge's samples would be copied into each of its matchups, and gathered
    found = pipeline.run_all(tables(spark, sf)).drop("geometry")
    return present.schedule_events(found).select("type", F.array_join("players", ",").alias("players"), _r(C("show_start"), "show_start"), _r(C("show_end"), "show_end"))


@query()
def s_topk_edges(spark, sf):
    """The likeliest edges at every frame."""
    s = Scene(tables(spark, sf))
    times = s.tables.frames.select(*SEGMENT, "t")
    top = present.top_edges(present.active_at(edges.edge_detections(s.edges), times), SEGMENT)
    return top.select(_r(C("t"), "t"), "rank", "type", F.array_join("players", ",").alias("players"), _r(C("confidence"), "confidence"))


@query(f"""with f as ({ORACLE_SQL["formation"]}), l as ({ORACLE_SQL["offside_line"]}), x as (with {o.P} select t from frames),
a as (select x.t, f.t_end, f.confidence, max(f.t_end) over (partition by x.t) as latest from x join f on x.t >= f.t_start and x.t <= f.t_end + 0.75),
b as (select x.t, l.t_end, row_number() over (partition by x.t, team_defending order by l.t_end desc) as r from x join l on x.t >= l.t_start and x.t <= l.t_end + 0.75)
select round(t, 6) as t, 'formation' as type, t_end, confidence from a where t_end >= latest - 1e-9 union all select round(t, 6), 'offside_line', t_end, 0.5 from b where r = 1""")
def newest_generation(spark, sf):
    """Formations and offside lines to show at every frame."""
    t = tables(spark, sf)
    found = pipeline.run_all(t, ["formation", "offside_line"])
    active = present.active_at(found, t.frames.select(*SEGMENT, "t"))
    return present.newest_generation(active, SEGMENT).select(_r(C("t"), "t"), "type", _r(C("t_end"), "t_end"), _r(C("confidence"), "confidence"))


@query(f"""with recursive {o.P}, {o.RANKED}{SMOOTH},
l as (select f.frame_idx, f.t, f.ball_x, max(sx) filter (team = 'home') as hx, max(sx) filter (team = 'away') as ax from sm join frames f using (frame_idx) where sx is not null and abs(sx - ball_x) <= 30 group by all),
n as (select *, row_number() over (order by t) as n, case when hx is null then 'away' when ax is null then 'home' when abs(hx - ball_x) < abs(ax - ball_x) then 'home' else 'away' end as best from l),
w as (select n, t, best as team, t as since, case best when 'home' then hx else ax end as x from n where n = 1
  union all select n, t, chosen, case when chosen = old then since else t end, case chosen when 'home' then hx else ax end
  from (select n.*, w.team as old, w.since, case when best <> w.team and n.t - w.since <= 2.0 and (case w.team when 'home' then hx else ax end) is not null then w.team else best end as chosen from w join n on n.n = w.n + 1))
select round(t, 6) as t, team, round(x, 6) as x from w""")
def offside_shown(spark, sf):
    """The offside line nearest the ball at every frame, its team held for 2 s."""
    t = tables(spark, sf)
    times = t.frames.select(*SEGMENT, "t", "ball_x")
    return present.offside_at(detectors.offside_lines(t), times).select(_r(C("t"), "t"), "team", _r(C("x"), "x"))


@query(f"""with {o.P}, c as (select frame_idx, t, frame_idx % 20 >= 14 as held, frame_idx % 33 = 0 as lost, (frame_idx % 40) / 10.0 as rmse from frames where frame_idx % 7 <> 6),
g as (select *, max(case when not held and not lost then t end) over (order by t rows unbounded preceding) as last from c),
k as (select frame_idx, not lost and rmse <= 3 and case when held then coalesce(t - last <= 2, false) else true end as ok from g),
d as (select f.frame_idx, f.t, coalesce(k.ok, false) and f.frame_idx % 50 < 45 and f.frame_idx % 17 <> 0 as drawable from frames f left join k using (frame_idx)),
i as (select *, frame_idx - row_number() over (partition by drawable order by frame_idx) as island from d)
select frame_idx, drawable, case when drawable then min(t) over w end as run_start, case when drawable then max(t) over w end as run_end from i window w as (partition by drawable, island)""")
def drawable_runs(spark, sf):
    """Runs of frames that can be drawn on, by made-up calibrations, shots and players in sight."""
    f, i = tables(spark, sf).frames, C("frame_idx")
    seen = F.slice(F.sequence(F.lit(1), F.lit(6)), F.lit(1), F.when(i % 17 == 0, 4).otherwise(6))
    perception = f.select("match_id", "frame_idx", "t", F.when(i % 50 < 45, "main").otherwise("other").alias("shot"), seen.alias("players"))
    h = F.when(i % 33 != 0, F.array(*map(F.lit, H)))
    calib = f.where(i % 7 != 6).select("match_id", "frame_idx", "t", F.when(i % 20 >= 14, "held").otherwise("fit").alias("src"), h.alias("H"), ((i % 40) / 10.0).alias("rmse_m"))
    return present.drawable_runs(perception, calib).select("frame_idx", "drawable", "run_start", "run_end")
