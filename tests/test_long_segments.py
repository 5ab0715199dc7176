"""Long tracks and segments: a row's cost must not grow with them."""

import math
import time

import numpy as np

from pyspark.sql import functions as F

from fieldlens.functions import kernels as k
from fieldlens.operators import joins, present


def densified(points, step=1.5):
    out = []
    for (ax, ay), (bx, by) in zip(points, points[1:]):
        n = max(int(math.hypot(bx - ax, by - ay) / step), 1)
        out += [(ax + (bx - ax) * j / n, ay + (by - ay) * j / n) for j in range(n)]
    return out + points[-1:]


def test_densify_long_lines(spark):
    """The points come from an expression, which was worked out anew for each coordinate of each part."""
    rng = np.random.default_rng(5)
    lines = [[tuple(p) for p in rng.uniform(0, 100, (n, 2)).tolist()] for n in (0, 1, 2, 3, 1500)] + [[(1.0, 1.0)] * 4, None]
    df = spark.createDataFrame(list(enumerate(lines)), "i int, p array<struct<x:double,y:double>>")
    began = time.time()
    found = df.select("i", k.densify(F.transform("p", lambda q: F.struct(q.x.alias("x"), q.y.alias("y")))).alias("q")).collect()
    assert time.time() - began < 20
    for r in found:
        assert (r.q is None) == (lines[r.i] is None)
        assert r.q is None or np.allclose(np.array(r.q).reshape(-1, 2), np.array(densified(lines[r.i])).reshape(-1, 2))


def test_interpolated(spark):
    rng = np.random.default_rng(6)
    at = np.sort(rng.uniform(0, 1000, 20_000).round(3))
    samples = [("a", float(t), float(np.sin(t)), float(t % 7)) for t in at] + [("b", 5.0, 1.0, 2.0), ("b", None, 9.0, 9.0)]
    times = [("a", float(t), 0) for t in rng.uniform(-5, 1005, 20_000)] + [("a", float(at[7]), 1), ("b", 4.0, 2), ("b", 6.0, 3), ("c", 1.0, 4), ("a", None, 5)]
    left, right = spark.createDataFrame(times, "who string, t double, n int"), spark.createDataFrame(samples, "who string, t double, x double, y double")
    began = time.time()
    found = joins.interpolated(left, right, ["who"], "t", "x", "y").collect()
    assert time.time() - began < 20 and len(found) == len(times)
    at, first = np.unique(at, return_index=True)
    values = np.array([s[2:] for s in samples[:20_000]])[first]
    for r in found:
        if r.who == "a" and r.t is not None:
            assert np.allclose([r.x, r.y], [np.interp(r.t, at, v) for v in values.T], atol=1e-6)
    assert {r.n: (r.x, r.y) for r in found if r.n > 1} == {2: (1.0, 2.0), 3: (1.0, 2.0), 4: (None, None), 5: (None, None)}
    # one track looked at as a whole gives the same
    whole = right.groupBy("who").agg(F.collect_list(F.struct("t", "x", "y")).alias("track"))
    few = left.where("n > 0").join(whole, "who", "left").select("n", k.interpolate(F.col("track"), F.col("t"), ("x", "y")).alias("q")).collect()
    assert {r.n: (r.q.x, r.q.y) if r.q else (None, None) for r in few} == {r.n: (r.x, r.y) for r in found if r.n}


def test_offside_over_a_long_segment(spark):
    rng = np.random.default_rng(7)
    n = 60_000
    ball = 52 + 40 * np.sin(np.arange(n) / 9)
    spans = [(who, s, s + float(rng.uniform(1, 4)), float(rng.uniform(10, 95))) for who in ("home", "away") for s in range(0, n // 10, 4)]
    kind = "segment_id int, type string, team_defending string, x double, samples array<struct<t:double,x:double>>, t_start double, t_end double"
    lines = spark.createDataFrame([(1, "offside_line", who, x, [], float(a), b) for who, a, b, x in spans], kind)
    times = spark.createDataFrame([(1, i / 10, float(b)) for i, b in enumerate(ball)], "segment_id int, t double, ball_x double")
    shown = present.offside_at(lines, times)
    # a fold over an array of results would copy them all at every row
    assert "lambdafunction(struct(team" not in shown._jdf.queryExecution().analyzed().toString()
    found = sorted((r.t, r.team, r.x) for r in shown.collect())
    by_second: dict = {}
    for s in spans:
        for sec in range(int(s[1]), int(s[2]) + 1):
            by_second.setdefault(sec, []).append(s)
    want, team, since = [], None, None
    for i, b in enumerate(ball.tolist()):
        t = i / 10
        near = sorted((abs(x - b), who, x) for who, a, z, x in by_second.get(int(t), []) if a <= t <= z and abs(x - b) <= 30)
        if not near:
            continue
        old = [p for p in near if p[1] == team]
        chosen = old[0] if near[0][1] != team and old and t - since <= 2.0 else near[0]
        if chosen[1] != team:
            team, since = chosen[1], t
        want.append((t, team, chosen[2]))
    assert found == want and len({w[1] for w in want}) == 2


def test_schedule_leaves_out_tracks(spark):
    """Samples of edges, which grow with a segment for each of its matchups, are no part of what the schedule reads."""
    from fieldlens.plans.queries import QUERIES

    plan = QUERIES["schedule_events"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set(sample" not in plan and "to_json" not in plan


def test_separations_against_plain_search(spark):
    """The ends of a long edge, at the nearest sample of each time, without its samples in each row."""
    from fieldlens.operators.plays import separations

    samples = [(k * 0.25, float(k), 0.0, float(k % 7), 0.0) for k in range(2000)]
    edges = spark.createDataFrame([("m1", 0, 1, samples), ("m1", 0, 2, samples[:1])], "match_id string, segment_id int, edge int, samples array<struct<t:double,xa:double,ya:double,xb:double,yb:double>>")
    asked = [("m1", 0, e, i, i * 0.3125 - 5, i * 0.125) for i in range(1700) for e in ((1, 2, None) if i < 9 else (1,))]
    df = spark.createDataFrame(asked, "match_id string, segment_id int, edge int, i int, t0 double, t1 double")
    out = separations(df, edges, d0=F.col("t0"), d1=F.col("t1"))
    found = {(r.i, r.edge): (r.d0, r.d1) for r in out.collect()}

    def nearest(edge, t):
        own = {1: samples, 2: samples[:1], None: []}[edge]
        return min(((abs(s[0] - t), s[0], abs(s[1] - s[3])) for s in own), default=(None,))[-1]

    assert found == {(i, e): (nearest(e, t0), nearest(e, t1)) for _, _, e, i, t0, t1 in asked}


def test_detections_without_geometry(spark):
    """The same detections, and neither tracks of edges nor paths in what is read for them."""
    from fieldlens.plans.pipeline import COMMON, run_all
    from fieldlens.sources.adapter import tables

    t = tables(spark, "/root/testdata/sf0.01", True)
    names = ["matchup", "press", "run", "play", "edge", "back_pass"]
    bare = [c for c in COMMON if c != "geometry"] + ["det_ord"]
    plain = run_all(t, names, geometry=False)
    assert plain.columns == bare
    rows = lambda df: sorted(map(repr, df.select(bare).collect()))
    found = rows(plain)
    assert found == rows(run_all(t, names)) and len({r.type for r in plain.select("type").distinct().collect()}) > 4
    plan = run_all(t, ["matchup", "press"], geometry=False)._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(samples" not in plan and "edge_ids" in plan
