"""Scenarios with known outcomes: possession, shapes, passes, duels, edges, presses, runs, plays, roles."""

import itertools
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fieldlens.operators import detectors, edges, matchups, plays, possession, roles
from fieldlens.operators.assign import assign
from fieldlens.plans.pipeline import DETECTORS, Scene, as_detections, run_all
from tests.helpers import DT, Scenes, by_match

FAR = [("X1", "home", 5.0, 60.0), ("X2", "away", 100.0, 60.0)]


def shape(depths, team="home", keeper=2.0):
    rows = [(f"{team[0]}K", team, keeper, 34.0)]
    for k, d in enumerate(depths):
        rows.append((f"{team[0]}{k}", team, d, 8.0 + 5.0 * k))
    return rows


def build():
    s = Scenes()
    hold = lambda a, b: lambda i: [("A", "home", 30, 34), ("B", "home", 60, 34)]  # noqa: E731,ARG005
    # possession
    s.add("P1", 25, hold(0, 0), lambda i: (30, 34) if i < 10 else None if i < 15 else (60, 34))
    s.add("P2", 26, hold(0, 0), lambda i: None if 10 <= i < 16 else (30, 34))
    s.add("P3", 40, hold(0, 0), lambda i: None if 10 <= i < 30 else (30, 34))
    s.add("P4", 20, hold(0, 0))
    s.add("P5", 20, lambda i: [("A" if i < 10 else "A2", "home", 30, 34), *FAR], lambda i: (30, 34))
    s.add("P6", 30, lambda i: [("A", "home", 30, 34), ("B", "home", 36, 34)], lambda i: (30, 34) if i < 12 else (36, 34) if i > 17 else None)
    s.add("P7", 53, hold(0, 0), lambda i: (30, 34) if i in (0, 1, 52) else None)
    # team shape
    s.add("F1", 150, lambda i: shape([15] * 4 + [35] * 4 + [60] * 2))
    s.add("F2", 250, lambda i: shape([15] * 4 + ([35] * 4 + [60] * 2 if i < 125 else [35] * 3 + [60] * 3)))
    s.add("F3", 150, lambda i: shape([15] * 3 + [35] * 2 + [60] * 2))
    s.add("F4", 60, lambda i: shape([20] * 4 + [40] * 4 + [60] * 2))
    s.add("O1", 60, lambda i: [(f"A{k}", "away", 105 - x, 10.0 + 5 * k) for k, x in enumerate((103, 95, 90, 85, 80))], attack=(-1, 1))
    # passing
    tri = [("C", "home", 50, 34), ("P1", "home", 60, 30), ("P2", "home", 58, 42)]
    s.add("T1", 60, lambda i: [*tri, ("Z", "away", 90, 10)], lambda i: (50, 34))
    s.add("T2", 60, lambda i: [*tri, ("Z", "away", 55, 32)], lambda i: (50, 34))
    for name, to in (("B1", 20.0), ("B2", 40.0)):
        s.add(name, 60, lambda i, to=to: [("A", "home", 30, 34), ("B", "home", to, 34)], lambda i, to=to: (30, 34) if i < 20 else (to, 34) if i >= 32 else None)
    # duels
    crowd = [("K1", "home", 50, 38), ("K2", "away", 53, 36)]
    s.add("I1", 60, lambda i: [("H3", "home", 70, 34), ("A3", "away", 72, 34), ("K1", "home", 30, 10)], lambda i: (70, 34))
    s.add("I2", 60, lambda i: [("H3", "home", 50, 34), ("A3", "away", 52, 34), *crowd], lambda i: (50, 34))
    # runs: the carrier walks, the runner comes past outside, inside, or only jogs
    for name, y, v in (("R1", 62.0, 6.0), ("R2", 45.0, 6.0), ("R3", 62.0, 1.0)):
        s.add(name, 76, lambda i, y=y, v=v: [("C", "home", 40 + i * DT, 55), ("R", "home", 35 + v * i * DT, y), ("Z", "away", 90, 5)], lambda i: (40 + i * DT, 55))
    # pressing: three defenders come at a standing carrier
    s.add("X1", 60, lambda i: [("C", "home", 50, 34), *((f"D{k}", "away", 50 + max(1.5, 7 - 4 * i * DT + k) * math.cos(a), 34 + max(1.5, 7 - 4 * i * DT + k) * math.sin(a)) for k, a in ((0, 0.0), (0.5, 2.1), (1.0, 4.2)))], lambda i: (50, 34))
    # edges
    walk = lambda i: 40 + 3 * i * 0.1
    s.add("E1", 100, lambda i: [("A", "home", walk(i), 34), ("D", "away", walk(i) + (8 if 40 <= i < 50 else 3), 34)], lambda i: (walk(i), 34.5), dt=0.1)
    s.add("E2", 60, lambda i: [("A", "home", 50, 34), ("D", "away", 50 - 15 + 12 * i * 0.1, 36)], lambda i: (50, 34.5), dt=0.1)
    s.add("E3", 40, lambda i: [("C", "home", 50, 34), ("P1", "away", 55 - min(4, 0.15 * i), 34), ("P2", "away", 50, 39 - min(4, 0.15 * i))], lambda i: (50.5, 34), dt=0.1)
    s.add("E4", 100, lambda i: [("A", "home", walk(i), 34), ("D" if i < 50 else "D2", "away", walk(i) + 3, 34)], lambda i: (walk(i), 34.5), dt=0.1)
    s.add("M2", 60, lambda i: [("A", "home", 50, 34), ("D", "away", 52 if 20 <= i < 24 else 70, 34)], lambda i: (50, 34.5), dt=0.07)
    s.add("M1", 60, lambda i: [("H1", "home", 90, 10), ("H2", "home", 93, 13), ("A1", "away", 91.5, 10.5), ("A2", "away", 94, 14.5)], lambda i: (91, 10), dt=0.1)
    s.add("M3", 60, lambda i: [("H1", "home", 30, 60), ("H2", "home", 33, 63), ("A1", "away", 28.5, 60.5), ("A2", "away", 31.5, 64.5), ("C", "home", 90, 10)], lambda i: (90, 10), dt=0.1)
    # one-two: A passes to the wall and is given the ball ahead, or stays
    for name, v in (("L1", 6.0), ("L1s", 0.0)):
        ax = lambda i, v=v: 40 + (v * 0.1 * (i - 10) if i > 10 else 0)
        s.add(name, 45, lambda i, ax=ax: [("A", "home", ax(i), 30), ("B", "home", 50, 40)], lambda i, ax=ax: (ax(i), 30) if i <= 10 or i >= 26 else (50, 40) if 14 <= i <= 22 else None, dt=0.1)
    # a run past the carrier, with a marker who keeps pace or doesn't
    for name, v in (("L2", 3.0), ("L2k", 6.0)):
        mark = lambda i, v=v: 38 + 0.1 * (6 * min(i, 20) + v * max(i - 20, 0))
        s.add(name, 60, lambda i, mark=mark: [("C", "home", 50 + 0.1 * i, 50), ("R", "home", 40 + 0.6 * i, 62), ("D", "away", mark(i), 62.5)], lambda i: (50 + 0.1 * i, 50.5), dt=0.1)
    # pressing trap
    for name, marked in (("L4", True), ("L4u", False)):
        s.add(name, 60, lambda i, m=marked: [("C", "home", 50, 34), ("M", "home", 58, 34), *((f"D{k}", "away", 50 + max(1.0, 4.9 - 0.12 * i) * math.cos(a), 34 + max(1.0, 4.9 - 0.12 * i) * math.sin(a)) for k, a in enumerate((1.6, 3.1, 4.7))), ("W", "away", 59 if m else 80, 34.5)], lambda i: (50.5, 34), dt=0.1)
    # roles: two players swap halfway
    home = shape([15] * 4 + [35] * 4 + [60] * 2)
    swap = lambda i: 0.0 if i < 150 else min(1.0, (i - 150) / 10)

    def rotation(i):
        rows = dict((p, (team, x, y)) for p, team, x, y in home)
        (ta, ax, ay), (_, bx, by) = rows["h0"], rows["h4"]
        u = swap(i)
        rows["h0"], rows["h4"] = (ta, ax + u * (bx - ax), ay + u * (by - ay)), (ta, bx + u * (ax - bx), by + u * (ay - by))
        return [(p, *v) for p, v in rows.items()]

    s.add("Q1", 300, rotation, dt=0.1)
    s.add("Q2", 300, lambda i: [(p, t, x, y) for p, t, x, y in (rotation(290) if i == 120 else home)], dt=0.1)
    s.add("Q3", 80, lambda i: home[:7], dt=0.1)
    return s


@pytest.fixture(scope="module")
def scene(spark):
    return Scene(build().tables(spark))


@pytest.fixture(scope="module")
def found(scene):
    return {name: by_match(as_detections(d(scene))) for name, d in DETECTORS.items()}


def test_possession(scene):
    got = {m: [(r.track_id, r.i_start, r.i_end) for r in sorted(rows, key=lambda r: r.i_start)] for m, rows in by_match(scene.spells).items()}
    assert got["P1"] == [("A", 0, 9), ("B", 15, 24)]
    assert got["P2"] == [("A", 0, 25)]
    assert len(got["P3"]) == 2 and "P4" not in got
    assert got["P5"] == [("A", 0, 19)]
    assert [x[0] for x in got["P6"]] == ["A", "B"]
    assert got["P7"] == [("A", 0, 52)]


def test_shapes(scene, found):
    shapes = by_match(detectors.formations(scene.tables))
    assert {r.label for r in shapes["F1"]} == {"4-4-2"} and "hK" not in shapes["F1"][0].players
    assert [(r.label, r.shift_from, r.confidence) for r in sorted(shapes["F2"], key=lambda r: r.t_start)] == [("4-4-2", None, 1.0), ("4-3-3", "4-4-2", 1.0)]
    assert shapes["F3"][0].confidence == 0.7
    b = by_match(detectors.blocks(scene.tables))["F4"][0]
    assert (b.block, b.line_height, b.line_x, b.depth, b.width) == ("low", 20.0, 20.0, 40.0, 45.0)
    assert len(shapes["F1"][0].hull) >= 4


def test_offside(scene):
    rows = by_match(detectors.offside_lines(scene.tables))["O1"]
    assert {(r.team_defending, r.x) for r in rows} == {("away", 10.0)}


def test_passing(found):
    assert [set(r.players) for r in found["triangle"]["T1"]] == [{"C", "P1", "P2"}] and "T2" not in found["triangle"]
    assert [(r.players, r.geometry) for r in found["back_pass"]["B1"]] == [(["A", "B"], '{"from":[30.0,34.0],"to":[20.0,34.0]}')]
    assert "B2" not in found["back_pass"]


def test_duels(found):
    assert [set(r.players) for r in found["isolation"]["I1"]] == [{"H3", "A3"}] and "I2" not in found["isolation"]
    assert found["isolation"]["I1"][0].confidence > 0.5
    assert any({"H1", "H2", "A1", "A2"} <= set(r.players) or r.type in ("1v1", "2v2") for r in found["matchup"]["M1"])
    assert "M2" not in found["matchup"] and "M3" not in found["matchup"]


def test_runs(found):
    assert {(r.type, tuple(r.players)) for r in found["run"]["R1"]} == {("overlap", ("R", "C"))} and found["run"]["R1"][0].confidence > 0.5
    assert {r.type for r in found["run"]["R2"]} == {"underlap"} and "R3" not in found["run"]


def test_edges(scene):
    got = by_match(scene.edges)
    assert [(e.kind, e.a, e.b) for e in got["E1"] if e.kind == "marking"] == [("marking", "D", "A")] and got["E1"][0].t_end - got["E1"][0].t_start >= 9
    assert "E2" not in got and "M2" not in got
    assert {(e.a, e.b) for e in got["E3"] if e.kind == "press"} == {("P1", "C"), ("P2", "C")}
    swapped = [e for e in got["E4"] if e.kind == "marking"]
    assert [(e.a, e.b) for e in swapped] == [("D", "A")] and swapped[0].t_end - swapped[0].t_start >= 9
    times = [p.t for p in swapped[0].samples]
    assert max(b - a for a, b in zip(times, times[1:])) <= 0.4


def test_press(found):
    rows = found["press"]["X1"]
    assert rows[0].players[0] == "C" and len(rows[0].players) >= 3 and any('"high"' in r.geometry for r in rows)


def test_plays(scene, found):
    by_type = {m: {r.type: r for r in rows} for m, rows in found["play"].items()}
    assert by_type["L1"]["give_and_go"].players == ["A", "B"] and by_type["L1"]["give_and_go"].confidence <= 0.9
    assert "give_and_go" not in by_type.get("L1s", {})
    assert by_type["L2"]["overlap_run"].players == ["R", "C"] and "overlap_run" not in by_type.get("L2k", {})
    assert by_type["L4"]["pressing_trap"].players[0] == "C" and "pressing_trap" not in by_type.get("L4u", {})


def test_roles(scene, found):
    assert [set(r.players) for r in found["rotation"]["Q1"]] == [{"h0", "h4"}] and found["rotation"]["Q1"][0].confidence == 1.0
    assert "Q2" not in found["rotation"]
    q3 = [r for r in scene.roles.where("match_id = 'Q3' and frame_idx = 40").collect()]
    assert len({r.role for r in q3}) == 6
    q2 = scene.roles.where("match_id = 'Q2'").groupBy("track_id").agg({"role": "min"}).count()
    assert q2 == 10


def test_run_all_takes_functions(scene):
    chosen = run_all(scene.tables, ["block", lambda s: detectors.formations(s.tables)])
    assert {r[0] for r in chosen.select("type").distinct().collect()} == {"block", "formation"}


def best_cost(cost):
    n, m = cost.shape
    if n > m:
        return best_cost(cost.T)
    return min(sum(cost[r, c] for r, c in enumerate(p)) for p in itertools.permutations(range(m), n))


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 6), st.integers(1, 6), st.integers(0, 10**6))
def test_assignment_is_optimal(n, m, seed):
    cost = np.random.default_rng(seed).integers(-5, 20, (n, m)).astype(float)
    pairs = assign(cost)
    assert len(pairs) == min(n, m) and len({c for _, c in pairs}) == len(pairs) == len({r for r, _ in pairs})
    assert abs(sum(cost[r, c] for r, c in pairs) - best_cost(cost)) < 1e-9


def spells_by_hand(frames):
    """frames: [(id, team, x) or None]; the rules in their plainest form."""
    out, cur, cand = [], None, None
    near = lambda h, who: h[1] == who["team"] and (h[0] == who["id"] or abs(h[2] - who["x"]) <= 2.0)
    for i, h in enumerate(frames):
        if cur:
            if h and near(h, cur):
                cur |= {"last": i, "x": h[2]}
                continue
            if h is None and i - cur["last"] <= 12:
                continue
            out.append((cur["id"], cur["start"], cur["last"]))
            cur = cand = None
        if h:
            if cand and near(h, cand):
                cand |= {"n": cand["n"] + 1, "x": h[2]}
            else:
                cand = {"id": h[0], "team": h[1], "x": h[2], "start": i, "n": 1}
            if cand["n"] >= 3:
                cur = {"id": cand["id"], "team": cand["team"], "x": h[2], "start": cand["start"], "last": i}
    return out + ([(cur["id"], cur["start"], cur["last"])] if cur else [])


def test_possession_against_a_plain_model(spark):
    rng = random.Random(7)
    s, want = Scenes(), {}
    for k in range(40):
        frames, who = [], None
        while len(frames) < 90:
            who = rng.choice([None, ("a", "home", 30.0), ("b", "home", 31.5), ("c", "home", 50.0), ("d", "away", 30.5)])
            frames += [who] * rng.choice([1, 1, 2, 3, 5, 9, 14])
        want[f"r{k}"] = spells_by_hand(frames)
        s.add(f"r{k}", len(frames), lambda i, f=frames: [(f[i][0], f[i][1], f[i][2], 30.0)] if f[i] else [("z", "home", 90.0, 60.0)], lambda i, f=frames: (f[i][2], 30.0) if f[i] else None)
    got = by_match(possession.spells(s.tables(spark)))
    assert {m: [(r.track_id, r.i_start, r.i_end) for r in sorted(rows, key=lambda r: r.i_start)] for m, rows in got.items()} == {m: w for m, w in want.items() if w}


def test_components_match_the_groups(scene):
    links = matchups.alive_links(scene.tables, scene.edges)
    labels = by_match(matchups.components(links))
    for match, rows in by_match(links).items():
        frame = rows[0].frame_idx
        groups = {frozenset(g[0]) for g in matchups._groups([(r.a, r.b) for r in rows if r.frame_idx == frame])}
        found = {}
        for r in labels[match]:
            if r.frame_idx == frame:
                found.setdefault(r.label, set()).add(r.u)
        assert {frozenset(v) for v in found.values()} == groups


def test_long_components(spark):
    """A path of many nodes is one component, whatever its length."""
    rows = [("m", 0, 0, f"p{i:02}", f"p{i + 1:02}") for i in range(21)] + [("m", 0, 0, "q0", "q1"), ("m", 0, 1, "p05", "p09")]
    random.Random(1).shuffle(rows)
    found = matchups.components(spark.createDataFrame(rows, "match_id string, segment_id int, frame_idx int, a string, b string")).collect()
    assert sorted((r.frame_idx, r.label, r.u) for r in found) == sorted([(0, "p00", f"p{i:02}") for i in range(22)] + [(0, "q0", "q0"), (0, "q0", "q1"), (1, "p05", "p05"), (1, "p05", "p09")])


def test_role_lines():
    """Lines part at the widest gaps; within a line, roles go up by y."""
    slots = np.array([[50.0, 60], [20, 50], [21, 10], [80, 30], [22, 30], [49, 20]])
    assert roles.role_order(slots).tolist() == [2, 4, 1, 5, 0, 3]
    close = np.array([[10.0, 5], [11, 1], [14, 3]])
    assert roles.role_order(close).tolist() == [1, 0, 2]
    who, xy = np.array(["a", "b", "a", "b"]), np.array([[10.0, 10], [50, 30], [12, 10], [50, 32]])
    first = roles.first_template(who, xy, np.array([0, 0, 1, 1]))
    assert first.shape == (10, 2) and first[:2].tolist() == [[11, 10], [50, 31]] and len({tuple(x) for x in first}) == 10
