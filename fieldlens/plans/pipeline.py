"""All patterns of a match: shared intermediates once, then the union of the detectors' results."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import cached_property, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import detectors, edges, matchups, plays, possession, roles
from ..schema import FRAME, SEGMENT, Tables
from ..storage import stored

#: Distance from the ball at which a holder counts as carrier.
CARRIER_BALL = 3.0
COMMON = [*SEGMENT, "type", "players", "geometry", "confidence", "t_start", "t_end"]


class Scene:
    """Tables with what several detectors need, each computed once and kept as a table.

    Plans of later detectors then start from these tables instead of from the
    whole lineage, which would be planned again for each of their uses.
    """

    def __init__(self, t: Tables, geometry: bool = True):
        # positions are dealt into as many files as there are tasks to read them, which a table numbered in one task isn't
        spark = t.positions.sparkSession
        files = min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
        with ThreadPoolExecutor(2) as pool:
            parts = pool.submit(stored, t.frames, "frames"), pool.submit(stored, t.positions.repartition(files, *FRAME), "positions")
            self.tables = Tables(*(p.result() for p in parts))
        #: Whether detectors look for what geometry alone needs: tracks of edges and paths of players.
        self.geometry = geometry

    @cached_property
    def spells(self) -> DataFrame:
        return stored(possession.spells(self.tables), "spells")

    @cached_property
    def carriers(self) -> DataFrame:
        return stored(possession.carriers(self.tables, self.spells, CARRIER_BALL), "carriers")

    @cached_property
    def edges(self) -> DataFrame:
        return stored(edges.edges(self.tables, self.spells, self.carriers), "edges")

    @cached_property
    def roles(self) -> DataFrame:
        return stored(roles.roles(self.tables), "roles")

    @cached_property
    def rotations(self) -> DataFrame:
        return roles.rotations(self.tables, self.roles)


    def prepare(self, names: set[str]) -> None:
        """Computes some of the above side by side: roles need nothing of spells, and edges come after carriers."""
        chains = [["roles"], ["spells", "carriers", "edges"]]
        with ThreadPoolExecutor(len(chains)) as pool:
            for done in [pool.submit(lambda c: [getattr(self, n) for n in c if n in names], c) for c in chains]:
                done.result()


def as_detections(df: DataFrame, geometry: bool = True) -> DataFrame:
    """Typed rows of a detector in the common form; its further columns become the geometry, as JSON, or are left out."""
    if not geometry:
        return df.select(*(c for c in COMMON if c != "geometry"))
    if "geometry" in df.columns:
        return df.select(*COMMON)
    own = [c for c in df.columns if c not in COMMON and c not in ("anchor", "team", "n")]
    point = lambda c: F.array(F.col(f"{c}.x"), F.col(f"{c}.y")).alias(c)

    def plain(c: str):
        kind = df.schema[c].dataType.simpleString()
        if kind == "struct<x:double,y:double>":
            return point(c)
        if kind == "array<struct<x:double,y:double>>":
            return F.transform(c, lambda p: F.array(p.x, p.y)).alias(c)
        if kind.startswith("array<struct<"):
            names = df.schema[c].dataType.elementType.names
            return F.transform(c, lambda p: F.array(*(p[n] for n in names))).alias(c)
        return F.col(c)

    return df.withColumn("geometry", F.to_json(F.struct(*map(plain, own)))).select(*COMMON)


Detector = Callable[[Scene], DataFrame]

DETECTORS: dict[str, Detector] = {
    "formation": lambda s: detectors.formations(s.tables),
    "block": lambda s: detectors.blocks(s.tables),
    "offside_line": lambda s: detectors.offside_lines(s.tables),
    "triangle": lambda s: detectors.triangles(s.tables, s.carriers),
    "back_pass": lambda s: detectors.back_passes(s.tables, s.spells),
    "matchup": lambda s: matchups.matchups(s.tables, s.edges, s.spells, tracks=s.geometry),
    "isolation": lambda s: detectors.isolations(s.tables, s.carriers),
    "press": lambda s: detectors.presses(s.tables, s.edges, tracks=s.geometry),
    "run": lambda s: detectors.runs(s.tables, s.spells, paths=s.geometry),
    "play": lambda s: detect_plays(s),
    "rotation": lambda s: roles.rotation_detections(s.rotations),
    "edge": lambda s: edges.edge_detections(s.edges),
}
#: What of a scene the detectors use, beside its tables.
USES = {
    "triangle": {"carriers"}, "isolation": {"carriers"}, "back_pass": {"spells"}, "run": {"spells"}, "matchup": {"edges"}, "press": {"edges"}, "play": {"edges"},
    "edge": {"edges"}, "rotation": {"roles"},
}
#: Those that need no relations, for every tick of a live stream.
CHEAP = ["formation", "block", "offside_line", "back_pass", "isolation"]


def detect_plays(s: Scene, with_rotations: bool = False) -> DataFrame:
    """Plays, rate limited by type and players; rotations too, if asked for, under the same limit."""
    parts = [
        plays.give_and_go(s.tables, s.spells, paths=s.geometry), plays.overlap_runs(s.tables, s.spells, s.edges, paths=s.geometry),
        plays.third_man_runs(s.tables, s.spells, s.edges), plays.pressing_traps(s.tables, s.spells, s.edges, paths=s.geometry),
    ]
    parts = [as_detections(p, s.geometry) for p in parts + ([roles.rotation_detections(s.rotations)] if with_rotations else [])]
    return plays.rate_limited(reduce(DataFrame.union, parts))


def run_all(t: Tables, detectors: list[Detector] | list[str] | None = None, geometry: bool = True) -> DataFrame:
    """Detections of every segment, with ``det_ord``, the detector's place.

    ``detectors`` are names of the above, or functions of a Scene that give
    detections or typed rows.  Sort by t_start, then det_ord, for one timeline.
    Without ``geometry`` the same detections come without that column, and what
    it alone needs isn't joined: a long edge's samples in each of its matchups
    grow with the square of a segment.
    """
    scene = Scene(t, geometry)
    used = set().union(*(USES.get(d, set()) for d in (detectors or DETECTORS) if isinstance(d, str)))
    scene.prepare(used | ({"carriers"} if "edges" in used else set()) | ({"spells"} if used & {"carriers", "edges"} else set()))
    plan = lambda d, i: as_detections(d(scene), geometry).withColumn("det_ord", F.lit(i))
    with ThreadPoolExecutor(8) as pool:  # plans of many steps take seconds each; functions may want more of the scene, and take their turns
        named = {i: pool.submit(plan, DETECTORS[d], i) for i, d in enumerate(detectors or DETECTORS) if isinstance(d, str)}
        parts = [named[i].result() if i in named else plan(d, i) for i, d in enumerate(detectors or DETECTORS)]
    return reduce(DataFrame.union, parts)
