"""Sequential rules as JVM folds: ``aggregate`` over a sorted array of structs.

These rules look at what was last *kept*, so no window function expresses them.
A fold's rows are gathered by its keys; flags are appended to the result array
where rows are many, so a step costs the same early and late in a segment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kernels import dist
from ..schema import SEGMENT


def _gather(df: DataFrame, keys: list[str], order: list[str], fields: list[str]) -> DataFrame:
    item = F.struct(*(F.col(c).alias(f"_o{i}") for i, c in enumerate(order)), *(c for c in fields if c not in order), *(F.col(c).alias(c) for c in order if c in fields))
    return df.select(*keys, item.alias("_x")).groupBy(*keys).agg(F.array_sort(F.collect_list("_x")).alias("_rows"))


def reanchored(df: DataFrame, keys: list[str], t: str, length: int, closing: bool = False) -> DataFrame:
    """(keys, t, anchor): windows of ``length`` that begin at the first row after the window before has ended.

    ``closing``: the row that reaches the length still belongs to the window.
    The fold keeps the anchors alone; each row then takes the latest one.
    """
    rows = _gather(df, keys, [t], [t])

    def step(acc: Column, x: Column) -> Column:
        new = acc.anchor.isNull() | (acc.done if closing else x[t] - acc.anchor >= length)
        anchor = F.when(new, x[t]).otherwise(acc.anchor)
        done = (x[t] - anchor >= length) if closing else F.lit(False)
        return F.struct(anchor.alias("anchor"), done.alias("done"), F.when(new, F.concat(acc.out, F.array(anchor))).otherwise(acc.out).alias("out"))

    start = F.struct(F.lit(None).cast("long").alias("anchor"), F.lit(False).alias("done"), F.array().cast("array<bigint>").alias("out"))
    anchors = rows.select(*keys, F.explode(F.aggregate("_rows", start, step, lambda a: a.out)).alias("anchor"))
    marked = df.select(*keys, t, F.lit(None).cast("long").alias("anchor")).union(anchors.select(*keys, F.col("anchor").alias(t), "anchor"))
    latest = F.max("anchor").over(Window.partitionBy(*keys).orderBy(t).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return marked.withColumn("latest", latest).where("anchor is null").select(*keys, t, F.col("latest").alias("anchor"))


def cooldown(df: DataFrame, keys: list[str], order: list[str], t: str, gap, fields: list[str], refresh: Column | None = None) -> DataFrame:
    """Rows at least ``gap`` after the last kept one of their keys.

    With ``refresh`` false on a row, that row isn't kept but still restarts the gap.
    """
    every = list(dict.fromkeys([*fields, t]))
    source = df if refresh is None else df.withColumn("_counts", refresh)
    rows = _gather(source, keys, order, every + (["_counts"] if refresh is not None else []))
    kind = df.schema[t].dataType

    def step(acc: Column, x: Column) -> Column:
        free = acc.last.isNull() | (x[t] - acc.last >= gap)
        kept = free if refresh is None else free & x["_counts"]
        last = F.when(free if refresh is None else F.lit(True), x[t]).otherwise(acc.last)
        return F.struct(last.alias("last"), F.when(kept, F.concat(acc.out, F.array(x))).otherwise(acc.out).alias("out"))

    items = rows.schema["_rows"].dataType
    start = F.struct(F.lit(None).cast(kind).alias("last"), F.array().cast(items).alias("out"))
    kept = rows.select(*keys, F.explode(F.aggregate("_rows", start, step, lambda a: a.out)).alias("_x"))
    return kept.select(*keys, *(F.col(f"_x.{c}").alias(c) for c in every))


def ball_gate(df: DataFrame, keys: list[str], max_speed: float = 40.0, reacquire: float = 0.5) -> DataFrame:
    """Ball places (frame_idx, t, x, y) that aren't jumps: at most ``max_speed`` from the last kept place, or ``reacquire`` after it.

    The fold gathers the jumps, which are rare, and an anti join takes them out.
    """
    seen = df.where("x is not null")
    rows = _gather(seen, keys, ["frame_idx"], ["frame_idx", "t", "x", "y"])

    def step(acc: Column, p: Column) -> Column:
        gone = p.t - acc.last.t
        ok = acc.last.isNull() | (gone >= reacquire) | (dist(p.x, p.y, acc.last.x, acc.last.y) <= gone * max_speed)
        kept = F.struct(p.t.alias("t"), p.x.alias("x"), p.y.alias("y"))
        return F.struct(F.when(ok, kept).otherwise(acc.last).alias("last"), F.when(ok, acc.out).otherwise(F.concat(acc.out, F.array(p.frame_idx))).alias("out"))

    number = df.schema["frame_idx"].dataType.simpleString()
    start = F.struct(F.lit(None).cast("struct<t:double,x:double,y:double>").alias("last"), F.array().cast(f"array<{number}>").alias("out"))
    jumps = rows.select(*keys, F.explode(F.aggregate("_rows", start, step, lambda a: a.out)).alias("frame_idx"))
    return seen.select(*keys, "frame_idx", "t", "x", "y").join(jumps, [*keys, "frame_idx"], "left_anti")


def smooth_track(df: DataFrame, keys: list[str], alpha: float = 0.5, max_speed: float = 12.0) -> DataFrame:
    """Tracks smoothed by a median of three and an exponential mean; a jump above ``max_speed`` starts anew.

    Every row gives a value that the next one needs, so a track is one group of
    Arrow batches; an array fold would copy its results at every step.
    """

    def run(pdf):
        pdf = pdf.sort_values("frame_idx")
        out, recent, before, mean = [], [], None, None
        for t, x, y in zip(pdf["t"].tolist(), pdf["x"].tolist(), pdf["y"].tolist(), strict=True):
            if before is not None and ((x - before[1]) ** 2 + (y - before[2]) ** 2) ** 0.5 > (t - before[0]) * max_speed:
                recent, mean = [], None
            recent = [*recent[-2:], (x, y)]
            middle = [_middle([p[k] for p in recent]) for k in (0, 1)]
            mean = middle if mean is None else [alpha * m + (1 - alpha) * s for m, s in zip(middle, mean)]
            out.append(mean)
            before = t, x, y
        pdf["x"], pdf["y"] = [m[0] for m in out], [m[1] for m in out]
        return pdf

    rows = df.select(*keys, "frame_idx", "t", "x", "y")
    return rows.groupBy(*keys).applyInPandas(run, rows.schema)


def _middle(values: list[float]) -> float:
    values = sorted(values)
    n = len(values)
    return (values[(n - 1) // 2] + values[n // 2]) / 2


SPELL = "struct<track_id:string,team:string,i_start:int,i_end:int>"


def possession_spells(holders: DataFrame, handoff: float = 2.0, min_frames: int = 3, max_gap: int = 12) -> DataFrame:
    """Spells from one row a frame: (segment, frame_idx, t, track_id, team, x, y), null where nobody holds the ball.

    A spell begins when the same holder is seen ``min_frames`` times without
    another between; frames without a holder don't interrupt that.  It survives
    up to ``max_gap`` such frames in a row and ends at the first frame of another
    holder.  A teammate within ``handoff`` of the holder's last place is the same
    holder under a new id; the spell keeps the first id.
    """
    rows = _gather(holders, SEGMENT, ["frame_idx"], ["frame_idx", "track_id", "team", "x", "y"])

    def same(h, who, at_x, at_y):
        return (h.team == who.team) & ((h.track_id == who.track_id) | (dist(h.x, h.y, at_x, at_y) <= handoff))

    def step(a: Column, h: Column) -> Column:
        seen, i = h.track_id.isNotNull(), h.frame_idx
        owned = a.cur.isNotNull()
        goes_on = F.coalesce(owned & seen & same(h, a.cur, a.cur_x, a.cur_y), F.lit(False))
        bridged = owned & ~seen & (i - a.last <= max_gap)
        ends = owned & ~goes_on & ~bridged
        free = ~owned | ends
        again = F.coalesce(free & seen & ~ends & a.cand.isNotNull() & same(h, a.cand, a.cand_x, a.cand_y), F.lit(False))
        fresh = free & seen & ~again
        run = F.when(again, a.run + 1).when(fresh, 1).when(ends, 0).otherwise(a.run)
        me = F.struct(h.track_id.alias("track_id"), h.team.alias("team"))
        none = F.lit(None).cast("struct<track_id:string,team:string>")
        cand = F.when(fresh, me).when(ends, none).otherwise(a.cand)
        cand_start = F.when(fresh, i).otherwise(a.cand_start)
        placed = again | fresh
        starts = placed & (run >= min_frames)
        cur = F.when(starts, cand).when(ends, none).otherwise(a.cur)
        moves = goes_on | starts
        done = F.struct(a.cur.track_id.alias("track_id"), a.cur.team.alias("team"), a.start.alias("i_start"), a.last.alias("i_end"))
        return F.struct(
            cur.alias("cur"), F.when(moves, h.x).otherwise(a.cur_x).alias("cur_x"), F.when(moves, h.y).otherwise(a.cur_y).alias("cur_y"),
            F.when(starts, cand_start).otherwise(a.start).alias("start"), F.when(moves, i).otherwise(a.last).alias("last"),
            cand.alias("cand"), F.when(placed, h.x).otherwise(a.cand_x).alias("cand_x"), F.when(placed, h.y).otherwise(a.cand_y).alias("cand_y"),
            cand_start.alias("cand_start"), run.alias("run"), F.when(ends, F.concat(a.out, F.array(done))).otherwise(a.out).alias("out"),
        )

    def finish(a: Column) -> Column:
        done = F.struct(a.cur.track_id.alias("track_id"), a.cur.team.alias("team"), a.start.alias("i_start"), a.last.alias("i_end"))
        return F.when(a.cur.isNotNull(), F.concat(a.out, F.array(done))).otherwise(a.out)

    null = lambda kind, name: F.lit(None).cast(kind).alias(name)
    who = "struct<track_id:string,team:string>"
    start = F.struct(
        null(who, "cur"), null("double", "cur_x"), null("double", "cur_y"), null("int", "start"), null("int", "last"), null(who, "cand"), null("double", "cand_x"),
        null("double", "cand_y"), null("int", "cand_start"), F.lit(0).alias("run"), F.array().cast(f"array<{SPELL}>").alias("out"),
    )
    out = rows.select(*SEGMENT, F.explode(F.aggregate("_rows", start, step, finish)).alias("s"))
    times = holders.select(*SEGMENT, F.col("frame_idx").alias("i"), F.col("t").alias("at"))
    spells = out.select(*SEGMENT, "s.*")
    for side in ("start", "end"):
        spells = spells.join(times.select(*SEGMENT, F.col("i").alias(f"i_{side}"), F.col("at").alias(f"t_{side}")), [*SEGMENT, f"i_{side}"])
    return spells.select(*SEGMENT, "track_id", "team", "i_start", "i_end", "t_start", "t_end")
