"""Readers, the bridge from perception records, presentation and streaming, on small files."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

from fieldlens.functions import kernels as k
from fieldlens.operators import bridge, detectors, joins, present
from fieldlens.plans.pipeline import as_detections, run_all
from fieldlens.schema import Tables
from fieldlens.sources import interchange, metrica, skillcorner
from fieldlens.sources.adapter import prelude, tables
from fieldlens.streaming import live


def wide_csv(path, team, numbers, rows):
    head = ",,," + "".join(f"{team},," for _ in numbers) + ",\n"
    head += ",,," + "".join(f"{n},," for n in numbers) + ",\n"
    head += "Period,Frame,Time [s]," + "".join(f"Player{n},," for n in numbers) + "Ball,\n"
    path.write_text(head + "".join(",".join(map(str, r)) + "\n" for r in rows))


def test_metrica(spark, tmp_path):
    rows = lambda x: [(1 + (i >= 120), i + 1, 0.04 * (i + 1), x if i < 120 else 1 - x, 0.5, 0.4, 0.25, "NaN" if i == 3 else 0.5, 0.5) for i in range(200)]
    wide_csv(tmp_path / "h.csv", "Home", [11, 7], rows(0.05))
    wide_csv(tmp_path / "a.csv", "Away", [25, 9], rows(0.95)[:190])
    t = metrica.load(spark, str(tmp_path / "h.csv"), str(tmp_path / "a.csv"), downsample=2)
    frames = {r.frame_idx: r for r in t.frames.collect()}
    assert len(frames) == 95 and frames[1].ball_x == 52.5 and frames[0].ball_y == 34.0
    assert (frames[0].att_home, frames[0].att_away, frames[80].att_home, frames[80].att_away) == (1, -1, -1, 1)
    first = {r.track_id: (r.team, r.x, r.y) for r in t.positions.where("frame_idx = 0").collect()}
    assert set(first) == {"H11", "H7", "A25", "A9"} and first["H11"] == ("home", 5.25, 34.0) and first["A9"][2] == 51.0
    whole = metrica.load(spark, str(tmp_path / "h.csv"), str(tmp_path / "a.csv"))
    assert whole.frames.where("frame_idx = 3").first().ball_x is None


def test_skillcorner(spark, tmp_path):
    """Four periods, of which two are extra time, on a smaller pitch; players of neither team, or not detected, are left out."""
    sides = ["right_to_left", "left_to_right", "left_to_right", "right_to_left"]
    roster = {701: 41, 702: 41, 811: 56, 812: 56, 990: None}
    match = {
        "match_periods": [{"duration_minutes": m, "period": k} for k, m in enumerate((46, 48, 15, 16), 1)], "home_team_side": sides, "away_team": {"id": 56}, "home_team": {"id": 41},
        "pitch_width": 64, "pitch_length": 100, "players": [{"team_id": team, "id": i} for i, team in roster.items()],
    }
    (tmp_path / "match_data.json").write_text(json.dumps(match))
    places = {701: (-22.5, 8.0), 812: (31.0, -12.0), 990: (0.5, 0.5)}

    def row(frame, period, clock, who, ball):
        data = [{"player_id": i, "x": places[i][0], "y": places[i][1], "is_detected": (i, frame) != (701, 95)} for i in who]
        return {"period": period, "frame": frame, "timestamp": clock, "player_data": data, "ball_data": {"is_detected": ball is not None, "x": ball and ball[0], "y": ball and ball[1]}}

    rows = [row(4, None, None, [], None), row(17, 1, "00:02:03.40", [701, 990], (4.0, -3.0)), row(95, 2, "00:00:00.70", [812, 701], None), row(200, 4, "00:01:00.00", [812], (-50.0, 32.0))]
    (tmp_path / "structured_data.jsonl").write_text("\n".join(map(json.dumps, rows)))
    t = skillcorner.load(spark, str(tmp_path))
    frames = sorted(t.frames.collect(), key=lambda r: r.frame_idx)
    assert [r.att_home for r in frames] == [-1, 1, -1] and [r.period for r in frames] == [1, 2, 4]
    assert frames[1].ball_x is None and frames[0].t == pytest.approx(123.4) and frames[0].t < frames[1].t < frames[2].t
    seen = sorted((r.frame_idx, r.track_id, r.team) for r in t.positions.collect())
    assert seen == [(0, "701", "home"), (1, "812", "away"), (2, "812", "away")]


H = [0.1, 0.0, 0.0, 0.0, 0.1, 0.0, 0.0, 0.0, 1.0]


@pytest.fixture(scope="module")
def video(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("video")
    perception, calib = [], []
    spots = [("home", 30, 20), ("home", 40, 40), ("away", 60, 20), ("away", 70, 40), ("gk", 5, 34), ("gk", 100, 34)]

    def shot(t0, t1, kind):
        for i in range(round((t1 - t0) * 10) + 1):
            t = round(t0 + i / 10, 3)
            idx = round(t * 25)
            players = [{"tid": 100 + k + (50 if t > 3 else 0), "team": team, "cls": "player", "conf": 0.9, "box": None, "foot": [10 * (x + 0.1 * i), 10 * y]} for k, (team, x, y) in enumerate(spots)]
            players += [{"tid": 99, "team": "ref", "cls": "referee", "conf": 0.9, "box": None, "foot": [500, 300]}, {"tid": 98, "team": "home", "cls": "player", "conf": 0.9, "box": None, "foot": [5000, 300]}]
            perception.append({"frame_idx": idx, "t": t, "shot": kind, "players": players, "ball": [500, 340]})
            if kind == "main":
                calib.append({"frame_idx": idx, "t": t, "H": H if i % 2 else [H[:3], H[3:6], H[6:]], "n_kp": 8, "src": "fit", "rmse_m": 0.4})

    shot(0, 7, "main"), shot(7.1, 8, "replay"), shot(8.1, 14.1, "main"), shot(17.2, 20, "main")
    for name, rows in (("perception", perception), ("calib", calib)):
        (folder / f"{name}.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n\n")
    read = lambda name: interchange.read(spark, str(folder / f"{name}.jsonl"), name).withColumn("match_id", F.lit("v"))
    return read("perception"), read("calib")


def test_bridge(video):
    t = bridge.build(*video)
    stats = sorted((r.segment_id, round(r.seconds, 3), round(r.players, 2), r.ball_share) for r in bridge.segment_stats(t).collect())
    assert stats == [(0, 7.0, 6.0, 1.0), (1, 6.0, 6.0, 1.0)]
    tracks = t.positions.select("segment_id", "track_id", "team").distinct().collect()
    assert {r.track_id for r in tracks} == {"T1", "T2", "T3", "T4", "T5", "T6"} and len(tracks) == 12
    teams = {r.track_id: r.team for r in tracks if r.segment_id == 0}
    assert (teams["T5"], teams["T6"]) == ("home", "away")
    assert {(r.att_home, r.att_away) for r in t.frames.collect()} == {(1, -1)}
    assert sorted(r.frame_idx for r in t.frames.where("segment_id = 0").collect()) == list(range(71))


def test_bridge_trusts_the_ball_file(spark, video):
    perception, calib = video
    ball = perception.select("match_id", "frame_idx", "t", F.array(F.lit(500.0), F.lit(340.0)).alias("ball"), F.when(F.col("t") < 2, "det").otherwise("kf").alias("src"))
    t = bridge.build(perception, calib, ball)
    seen = t.frames.where("ball_x is not null").agg(F.max("t")).first()[0]
    assert 2.0 < seen <= 2.4 + 1e-9


def test_drawable(video):
    perception, calib = video
    rows = present.drawable_runs(perception, calib).collect()
    assert {(r.run_start, r.run_end) for r in rows if r.drawable} == {(0.0, 7.0), (8.1, 20.0)}
    assert all(r.drawable == (r.shot == "main") for r in rows)


def test_interchange(spark, tmp_path):
    assert interchange.read(spark, str(tmp_path / "none.jsonl"), "ball", missing_ok=True).count() == 0
    (tmp_path / "teams.json").write_text('{"1": "home", "2": "away"}')
    teams = interchange.read_teams(spark, str(tmp_path / "teams.json"))
    boxes = spark.createDataFrame([(1, 0.0, [(1, "player", 0.9, [0.0, 0.0, 1.0, 2.0]), (2, "player", 0.8, None)])], interchange.SCHEMAS["detections"])
    ball, shots = spark.createDataFrame([(2, 0.1, [1.0, 2.0], "det")], interchange.SCHEMAS["ball"]), spark.createDataFrame([(3, 0.2, "other")], interchange.SCHEMAS["shots"])
    own = spark.createDataFrame([(1, {"2": "home"})], interchange.SCHEMAS["teams_frames"])
    merged = joins.merge_perception(boxes.select("frame_idx", "boxes"), ball.select("frame_idx", "ball"), shots.select("frame_idx", "shot"), teams, interchange.frame_teams(own))
    got = {r.frame_idx: r for r in merged.collect()}
    assert [b.team for b in got[1].boxes] == ["home", "home"] and got[1].shot == "main" and got[2].ball == [1.0, 2.0] and got[3].shot == "other"
    interchange.write_records(ball, str(tmp_path / "out"))
    assert interchange.read(spark, str(tmp_path / "out"), "ball").collect() == ball.collect()


def test_schedule(spark):
    rows = [("m", 0, "press", ["a"], "{}", 0.5, 0.0, 1.0), ("m", 0, "press", ["b"], "{}", 0.8, 5.0, 6.0), ("m", 0, "press", ["c"], "{}", 0.4, 12.0, 13.0), ("m", 0, "press", ["d"], "{}", 0.9, 20.0, 20.1),
            ("m", 0, "back_pass", ["e"], "{}", 0.9, 1.0, 1.1), ("m", 0, "marking", ["f", "g"], "{}", 0.9, 1.0, 9.0), ("m", 0, "press", ["h"], "{}", 0.2, 40.0, 45.0)]
    from fieldlens.schema import DETECTIONS

    d = spark.createDataFrame(rows, DETECTIONS)
    kept = {(r.players[0], r.show_start, r.show_end) for r in present.schedule_events(d).collect()}
    assert kept == {("b", 5.0, 6.5), ("e", 1.0, 2.5)}
    edges = spark.createDataFrame([("m", 0, "marking", [f"x{i}", "y"], "{}", 0.3 + 0.1 * i, 0.0, 5.0) for i in range(6)], DETECTIONS)
    times = spark.createDataFrame([("m", 0, 2.0)], "match_id string, segment_id int, t double")
    top = present.top_edges(present.active_at(edges, times), ["match_id", "segment_id"]).collect()
    assert sorted(r.players[0] for r in top) == ["x2", "x3", "x4", "x5"]
    assert present.active_at(edges, times.withColumn("t", F.lit(5.7))).count() == 6 and present.active_at(edges, times.withColumn("t", F.lit(5.8))).count() == 0
    sane = spark.createDataFrame([(["a"] * 10, "4-4-2"), (["a"] * 12, "4-4-4"), (["a"] * 10, "2-12"), (["a"], "x")], "p array<string>, l string")
    assert [r[0] for r in sane.select(present.sane_formation(F.col("p"), F.col("l"))).collect()] == [True, False, False, False]


def test_presentation_of_the_adapter(spark):
    t = tables(spark, "/root/testdata/sf0.01")
    lines = detectors.offside_lines(t)
    times = t.frames.select("match_id", "segment_id", "t", "ball_x").where("frame_idx % 10 = 0")
    shown = present.offside_at(lines, times)
    assert 0 < shown.count() <= times.where("ball_x is not null").count()
    found = run_all(t, ["formation", "offside_line", "triangle", "back_pass", "run"])
    active = present.active_at(found, times.drop("ball_x"))
    newest = present.newest_generation(active, ["match_id", "segment_id"])
    assert newest.where("type = 'formation'").groupBy("t").count().agg(F.max("count")).first()[0] <= 2
    h = F.array(*map(F.lit, H))
    prims = present.primitives(newest, h, 1280.0, 720.0)
    assert prims.count() > 0 and prims.where("size(pts) < 1").count() == 0 and {"polygon", "polyline"} <= {r.kind for r in prims.select("kind").distinct().collect()}


def test_kernels(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    pts = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (4, 0), (4, 4), (0, 4), (2, 2), (2, 0), (0, 0))))
    assert [(p.x, p.y) for p in one(k.hull(pts))] == [(0, 0), (4, 0), (4, 4), (0, 4)]
    h = F.array(*map(F.lit, H))
    assert tuple(one(k.to_pixel(h, F.lit(10.0), F.lit(20.0), 1280.0, 720.0))) == pytest.approx((100.0, 200.0))
    assert one(k.to_pixel(h, F.lit(1000.0), F.lit(20.0), 1280.0, 720.0)) is None
    path = F.array(*(F.struct(F.lit(float(t)).alias("t"), F.lit(float(t)).alias("x"), F.lit(0.0).alias("y")) for t in range(4)))
    assert [p.t for p in one(k.path_prefix(path, F.lit(1.5)))] == [0.0, 1.0, 1.5] and len(one(k.path_prefix(path, F.lit(9.0)))) == 4


def test_adapter_is_the_same_in_both_engines(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{sf}/events.parquet'")
    for converge in (False, True):
        t = tables(spark, sf, converge)
        for name in ("frames", "positions"):
            want = sorted(con.execute(f"with {prelude('duckdb', converge)} select * from {name}").fetchall(), key=str)
            assert sorted(map(tuple, getattr(t, name).collect()), key=str) == want


def test_live_equals_batch(spark, tmp_path):
    t = tables(spark, "/root/testdata/sf0.001")
    players = t.positions.groupBy("match_id", "frame_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "track_id", "team", "x", "y"))), lambda p: F.struct(p.track_id.alias("track_id"), p.team.alias("team"), p.x.alias("x"), p.y.alias("y"))).alias("players"))
    rows = t.frames.join(players, ["match_id", "frame_idx"]).select("match_id", F.col("frame_idx").cast("long").alias("seq"), F.lit("main").alias("shot"), "t", "t_ms", "period", "ball_x", "ball_y", "att_home", "att_away", "players")
    for part in range(3):
        # a late copy of an early frame comes with the last part
        some = rows.where((F.col("seq") >= part * 15) & (F.col("seq") < (part + 1) * 15) | ((F.col("seq") == 3) & F.lit(part == 2)))
        some.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {}
    engine = live.LiveDetection(spark, lambda d, e: got.__setitem__(e, d.collect()), detectors=["offside_line", "block"], path=str(tmp_path / "state"))
    live.start(stream, engine, str(tmp_path / "check")).awaitTermination()
    batch = run_all(Tables(t.frames.where("frame_idx < 45"), t.positions.where("frame_idx < 45")), ["offside_line", "block"])
    last = t.frames.where("frame_idx < 45").agg(F.max("t").alias("t"), F.lit("m1").alias("match_id"), F.lit(0).alias("segment_id"))
    want = present.active_at(batch, last)
    key = lambda rows: sorted((r.type, r.players, r.geometry, r.t_start, r.t_end) for r in rows)
    assert sorted(got) == [0, 1, 2] and key(got[2]) == key(want.collect()) and got[2]


def test_live_segments_and_state(spark):
    engine = live.LiveDetection(spark, lambda d, e: None)
    row = lambda seq, t, shot="main": ("m", seq, shot, t, round(t * 1000), 1, None, None, 1, -1, [("a", "home", 1.0, 2.0)])
    batch = spark.createDataFrame([row(0, 0.0), row(1, 0.1), row(2, 0.2, "other"), row(3, 0.3), row(4, 5.0), row(5, 5.1)], live.FRAME_ROW)
    kept = engine.buffer(batch, None)
    assert sorted((r.seq, r.segment_id) for r in kept.collect()) == [(4, 2), (5, 2)]
    more = spark.createDataFrame([row(5, 5.1), row(3, 0.3), row(6, 5.2), row(7, 21.0)], live.FRAME_ROW)
    again = engine.buffer(more, kept)
    assert sorted((r.seq, r.segment_id) for r in again.collect()) == [(7, 3)]
    assert live.newest(batch.select("match_id", "seq", "t"), ["match_id"], "seq").first().seq == 5


def test_gated_ball_stream(spark, tmp_path):
    rows = [("m", i, 0.1 * i, 30.0 + 0.5 * i + (40 if i == 7 else 0), 34.0) for i in range(20)]
    df = spark.createDataFrame(rows, "match_id string, seq long, t double, x double, y double")
    for part in range(2):
        df.where((F.col("seq") < 10) == (part == 0)).coalesce(1).write.mode("append").parquet(str(tmp_path / "ball"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "ball"))
    q = live.gated_ball(stream).writeStream.format("memory").queryName("gated").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    assert sorted(r.seq for r in spark.sql("select * from gated").collect()) == [i for i in range(20) if i != 7]


def test_common_form(spark):
    t = tables(spark, "/root/testdata/sf0.001")
    row = as_detections(detectors.blocks(t)).first()
    assert set(json.loads(row.geometry)) == {"width", "depth", "line_height", "line_x", "block"}


def test_tracked_ball(spark):
    """Against the filter in matrices: coasting, gating, and giving up."""
    import numpy as np

    rows = [("m", i, i / 25, *((None, None) if 20 <= i < 26 or i >= 40 else (100.0 + 8 * i + (2000 if i == 10 else 0), 300.0 - 3 * i))) for i in range(60)]
    df = spark.createDataFrame(rows, "match_id string, frame_idx long, t double, x double, y double")
    got = {r.frame_idx: r for r in bridge.track_ball(df).collect()}
    step = np.array([[1, 0, 1, 0], [0, 1, 0, 1], [0, 0, 1, 0], [0, 0, 0, 1]], float)
    look, x, p = np.eye(2, 4), None, None
    for _, i, _, zx, zy in rows:
        ok = zx is not None and i != 10
        if x is None:
            x, p = np.array([zx, zy, 0, 0]), np.diag([25.0, 25.0, 400.0, 400.0])
        else:
            x, p = step @ x, step @ p @ step.T + np.diag([1.0, 1.0, 25.0, 25.0])
            if not ok and i < 52:
                assert got[i].src == "kf" and np.allclose(got[i].ball, x[:2])
            if ok:
                gain = p @ look.T @ np.linalg.inv(look @ p @ look.T + 25 * np.eye(2))
                x, p = x + gain @ (np.array([zx, zy]) - look @ x), (np.eye(4) - gain @ look) @ p
        if ok:
            assert got[i].src == "det" and got[i].ball == [zx, zy]
    assert got[51].ball is not None and got[52].ball is None
