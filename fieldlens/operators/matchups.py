"""Local n-against-m matchups: components of the edges alive on a frame, and their runs."""

from __future__ import annotations

from math import hypot

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import FRAME, SEGMENT, Tables
from .edges import tracks_of
from .possession import alive

RADIUS, LARGEST, LEAST_S, BALL_SOFT, BALL_HARD, LEAST_CONF, LONGEST_S, COOL_S = 8.0, 3, 1.0, 20.0, 25.0, 0.1, 3.0, 4.0

MATCHUPS = (
    "match_id string, segment_id int, type string, players array<string>, pairs array<array<double>>, region array<double>, edge_ids array<int>, "
    "confidence double, t_start double, t_end double"
)


def alive_links(t: Tables, edges: DataFrame) -> DataFrame:
    """A row a frame and edge alive on it with both its first ids in sight."""
    own = alive(edges, "a", "b", "team", "edge")
    place = t.positions.select(*FRAME, "track_id", "x", "y", "ord")
    for k in "ab":
        own = own.join(place.select(*FRAME, F.col("track_id").alias(k), *(F.col(c).alias(f"{c}_{k}") for c in ("x", "y", "ord"))), [*FRAME, k])
    return own


def components(links: DataFrame) -> DataFrame:
    """Nodes (u) of each frame's graph of links (a, b), with the smallest id of their component (label).

    A fold over a frame's links, of which there are at most as many as pairs of
    opponents: a link joins the components that it touches.
    """
    per = links.groupBy(*FRAME).agg(F.collect_set(F.struct("a", "b")).alias("links"))

    def join(parts: Column, link: Column) -> Column:
        touches = lambda part: F.array_contains(part, link.a) | F.array_contains(part, link.b)
        merged = F.array_union(F.array(link.a, link.b), F.flatten(F.filter(parts, touches)))
        return F.concat(F.filter(parts, lambda part: ~touches(part)), F.array(merged))

    parts = F.aggregate("links", F.array().cast("array<array<string>>"), join)
    found = per.select(*FRAME, F.explode(parts).alias("part"))
    return found.select(*FRAME, F.explode("part").alias("u"), F.array_min("part").alias("label"))


def _groups(rows) -> list[tuple[set, list]]:
    """Components of one frame's links, tuples that begin with both ids: (nodes, links)."""
    parts: list[tuple[set, list]] = []
    for r in rows:
        touching = [p for p in parts if r[0] in p[0] or r[1] in p[0]]
        merged = ({r[0], r[1]}.union(*(p[0] for p in touching)), [r, *(x for p in touching for x in p[1])])
        parts = [p for p in parts if p not in touching] + [merged]
    return parts


def _closest(first: dict, second: dict) -> list[list[float]]:
    """Each player's nearest opponent, both ways, each pair once, first team's place first."""
    gap = lambda p, q: hypot(first[p][0] - second[q][0], first[p][1] - second[q][1])
    ways = [(p, min(second, key=lambda q: gap(p, q))) for p in first] + [(min(first, key=lambda p: gap(p, q)), q) for q in second]
    return [[*first[p], *second[q]] for p, q in dict.fromkeys(ways)]


class _Run:
    def __init__(self, kind: str, t: float):
        self.kind, self.begin, self.end, self.conf, self.ball, self.edges = kind, t, t, [], None, set()

    def add(self, t, confidence, ball, sides, numbers) -> None:
        self.end, self.sides = t, sides
        self.conf.append(confidence)
        self.ball = ball if self.ball is None else self.ball if ball is None else min(self.ball, ball)
        self.edges.update(numbers)

    def row(self, players):
        if self.end - self.begin < LEAST_S or max(self.conf) < LEAST_CONF or (self.ball is not None and self.ball > BALL_HARD):
            return None
        first, second = self.sides
        xs, ys = zip(*first.values(), *second.values())
        return self.kind, sorted(players), _closest(first, second), [min(xs), min(ys), max(xs), max(ys)], sorted(self.edges), sum(self.conf) / len(self.conf), self.begin, self.end


LINK = ["a", "b", "team", "edge", "x_a", "y_a", "x_b", "y_b"]


def _frames(pdf):
    """(t, attacker, ball or None, links) of each frame in order; a link has the columns LINK."""
    import numpy as np

    pdf = pdf.sort_values("frame_idx", kind="stable")
    numbers = pdf["frame_idx"].to_numpy()
    bounds = np.r_[np.flatnonzero(np.r_[True, numbers[1:] != numbers[:-1]]), len(numbers)].tolist()
    t, attacker, bx, by = (pdf[c].tolist() for c in ("t", "attacker", "ball_x", "ball_y"))
    links = list(zip(*(pdf[c].tolist() for c in LINK), strict=True))
    for i, j in zip(bounds, bounds[1:]):
        ball = (bx[i], by[i]) if bx[i] is not None and bx[i] == bx[i] else None
        yield t[i], attacker[i], ball, [r for r in links[i:j] if isinstance(r[0], str)]


def _segment(key, pdf):
    import pandas as pd

    out, runs, barred = [], {}, {}

    def close(players):
        row = runs.pop(players).row(players)
        if row is not None:
            out.append((*key, *row))

    for t, attacker, near, rows in _frames(pdf) if len(pdf) else ():
        live = set()
        for nodes, links in _groups(rows):
            places = {}
            for a, b, team, _, xa, ya, xb, yb in links:
                places[a] = team, (xa, ya)
                places[b] = "away" if team == "home" else "home", (xb, yb)
            home, away = ({k: places[k][1] for k in sorted(places) if places[k][0] == team} for team in ("home", "away"))
            if not home or not away or max(len(home), len(away)) > LARGEST or abs(len(home) - len(away)) > 1:
                continue
            players = frozenset(nodes)
            if t < barred.get(players, float("-inf")):
                continue
            first, second = (away, home) if attacker == "away" else (home, away)
            kind = f"{len(first)}v{len(second)}"
            gaps = [hypot(p[0] - q[0], p[1] - q[1]) for p in first.values() for q in second.values()]
            ball = None if near is None else min(hypot(x - near[0], y - near[1]) for side in (first, second) for x, y in side.values())
            factor = 0.3 if ball is None else max(0.05, min(1.0, 1 - ball / BALL_SOFT))
            confidence = max(0.0, min(1.0, 1 - sum(gaps) / len(gaps) / RADIUS)) * factor
            run = runs.get(players)
            if run is not None and run.kind == kind and t - run.begin > LONGEST_S:
                close(players)
                barred[players] = t + COOL_S
                continue
            if run is not None and run.kind != kind:
                close(players)
                run = None
            if run is None:
                run = runs[players] = _Run(kind, t)
            run.add(t, confidence, ball, (first, second), [int(r[3]) for r in links])
            live.add(players)
        for players in [p for p in runs if p not in live]:
            close(players)
    for players in list(runs):
        close(players)
    names = ["match_id", "segment_id", "type", "players", "pairs", "region", "edge_ids", "confidence", "t_start", "t_end"]
    return pd.DataFrame(out, columns=names, dtype=object)


def matchups(t: Tables, edges: DataFrame, spells: DataFrame, tracks: bool = True) -> DataFrame:
    """Matchups of up to three a side, at most one apart in number, that last, are tight and are near the ball."""
    frames = t.frames.select(*FRAME, "t", "ball_x", "ball_y").join(alive(spells, F.col("team").alias("attacker")), FRAME, "left")
    rows = frames.join(alive_links(t, edges), FRAME, "left").select(*FRAME, "t", "attacker", "ball_x", "ball_y", *LINK)
    found = rows.groupBy(*SEGMENT).applyInPandas(_segment, MATCHUPS)
    return tracks_of(found, edges, [*SEGMENT, "players", "t_start", "t_end"]) if tracks else found.drop("edge_ids")
