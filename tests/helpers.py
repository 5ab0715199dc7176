"""Synthetic scenarios: many segments in one pair of tables, so a detector runs once for all."""

from fieldlens.schema import FRAMES, POSITIONS, Tables

DT = 0.04


class Scenes:
    def __init__(self):
        self.frames, self.positions = [], []

    def add(self, name, n, players, ball=None, dt=DT, t0=0.0, attack=(1, -1)):
        """``players(i)``: [(id, team, x, y)]; ``ball(i)``: (x, y) or None."""
        for i in range(n):
            t = round(t0 + i * dt, 6)
            ms = round(t * 1000)
            b = ball(i) if ball else None
            self.frames.append((name, 0, i, t, ms, 1, *(map(float, b) if b else (None, None)), *attack))
            self.positions += [(name, 0, i, t, ms, k, p, team, float(x), float(y)) for k, (p, team, x, y) in enumerate(players(i))]

    def tables(self, spark):
        def table(rows, ddl):
            return spark.createDataFrame(rows, ddl).repartition(4, "match_id").cache()

        return Tables(table(self.frames, FRAMES), table(self.positions, POSITIONS))


def by_match(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.match_id, []).append(r)
    return out
