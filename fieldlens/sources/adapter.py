"""Tracking frames from the ``events`` table: the same whole centimetres in Spark and in DuckDB.

23 consecutive events make a frame at 10 Hz: slots 0-10 home, 11-21 away, slot 22
drives the ball.  A position is a base place plus a triangle wave plus jitter
from the event.  Carriers take turns in blocks of 32 frames, 24 of them with the
ball.  Slot 4 runs past the carrier.  With ``converge``, three opponents close in
on the carrier in every other block, so that presses occur.

Rows are numbered by time; the numbering is the only global order, and it is for
test data of one match.  Recorded data come with frame numbers of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..schema import Tables

#: slot, base x, base y, phase, step and period of the wave in x, of that in y (fixed values, centimetres).
BASE = [
    (0, 500, 3400, 0, 4, 400, 9, 1200), (1, 2000, 1000, 137, 20, 2400, 9, 1200), (2, 2000, 2500, 274, 20, 2400, 9, 1200),
    (3, 2000, 4300, 411, 20, 2400, 9, 1200), (4, 4000, 6300, 2120, 60, 6000, 2, 300), (5, 4000, 1000, 685, 20, 2400, 9, 1200),
    (6, 4000, 2500, 822, 20, 2400, 9, 1200), (7, 4000, 4300, 959, 20, 2400, 9, 1200), (8, 4000, 5500, 1096, 20, 2400, 9, 1200),
    (9, 6000, 2700, 1233, 20, 2400, 9, 1200), (10, 6000, 4100, 1370, 20, 2400, 9, 1200), (11, 10000, 3400, 0, 4, 400, 9, 1200),
    (12, 6500, 5800, 137, 20, 2400, 9, 1200), (13, 6500, 4300, 274, 20, 2400, 9, 1200), (14, 6500, 2500, 411, 20, 2400, 9, 1200),
    (15, 6500, 1000, 548, 20, 2400, 9, 1200), (16, 4500, 5800, 685, 20, 2400, 9, 1200), (17, 4500, 4300, 822, 20, 2400, 9, 1200),
    (18, 4500, 2500, 959, 20, 2400, 9, 1200), (19, 4500, 1000, 1096, 20, 2400, 9, 1200), (20, 2500, 4100, 1233, 20, 2400, 9, 1200),
    (21, 2500, 2700, 1370, 20, 2400, 9, 1200),
]
CARRIERS = [6, 2, 6, 9, 8, 18, 13, 18, 20, 7]


def prelude(dialect: str = "duckdb", converge: bool = False) -> str:
    """The common table expressions ``positions`` and ``frames``, for a ``with`` of either engine."""
    div, key = ("//", "json_extract_string") if dialect == "duckdb" else ("div", "get_json_object")
    base = ", ".join(map(str, BASE))
    carriers = ", ".join(str(x) for x in enumerate(CARRIERS))
    moved = "select * from pl0"
    if converge:
        # in odd blocks, three opponents close in on the carrier from 6 m to 1.5 m, from ahead, behind and the side
        near = f"(600 - (450 * (p.f % 32)) {div} 24)"
        moved = f"""
  select p.f, p.t_ms, p.slot, p.team,
    case when k.n is null then p.x_cm when k.n = 2 then c.x_cm else c.x_cm + (1 - 2 * k.n) * {near} end as x_cm,
    case when k.n is null then p.y_cm when k.n = 2 then c.y_cm + {near} else c.y_cm + 20 * k.n end as y_cm
  from pl0 p join carr r on r.i = (p.f {div} 32) % {len(CARRIERS)} join pl0 c on c.f = p.f and c.slot = r.slot
  left join (select 0 as n union all select 1 as n union all select 2 as n) k
    on (p.f {div} 32) % 2 = 1 and p.f % 32 < 24 and p.slot = (case when r.slot < 11 then 12 + (r.slot + k.n * 3) % 10 else 1 + (r.slot + k.n * 3) % 10 end)"""
    return f"""
e as (select row_number() over (order by ts, event_id) - 1 as seq, cast(round(value * 100) as bigint) as v, cast({key}(props, '$.k') as bigint) as k from events),
fr as (select seq {div} 23 as f, seq % 23 as slot, v, k from e),
base(slot, px0, py0, ph, sx, mx, sy, my) as (select * from (values {base}) b(slot, px0, py0, ph, sx, mx, sy, my)),
carr(i, slot) as (select * from (values {carriers}) c(i, slot)),
pl0 as (select fr.f, fr.f * 100 as t_ms, fr.slot, case when fr.slot < 11 then 'home' else 'away' end as team,
  px0 + abs((fr.f * sx + ph) % mx - mx {div} 2) - mx {div} 4 + (v % 21) - 10 as x_cm,
  py0 + abs((fr.f * sy + (fr.slot % 11) * 211) % my - my {div} 2) - my {div} 4 + (k % 21) - 10 as y_cm
  from fr join base on fr.slot = base.slot),
pl as ({moved}),
ball as (select fr.f, pl.x_cm + (v % 101) - 50 as bx_cm, pl.y_cm + (k % 101) - 50 as by_cm
  from fr join carr on carr.i = (fr.f {div} 32) % {len(CARRIERS)} join pl on pl.f = fr.f and pl.slot = carr.slot where fr.slot = 22 and fr.f % 32 < 24),
positions as (select 'm1' as match_id, 0 as segment_id, cast(f as int) as frame_idx, cast(f as double) / 10 as t, cast(f * 100 as bigint) as t_ms, cast(slot as int) as ord,
  case when slot < 11 then 'H' else 'A' end || cast(slot as {"varchar" if dialect == "duckdb" else "string"}) as track_id, team,
  cast(x_cm as double) / 100 as x, cast(y_cm as double) / 100 as y from pl),
frames as (select 'm1' as match_id, 0 as segment_id, cast(p.f as int) as frame_idx, cast(p.f as double) / 10 as t, cast(p.f * 100 as bigint) as t_ms, 1 as period,
  cast(bx_cm as double) / 100 as ball_x, cast(by_cm as double) / 100 as ball_y, 1 as att_home, -1 as att_away
  from (select distinct f from pl) p left join ball on ball.f = p.f)"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def tables(spark: SparkSession, sf_dir: str, converge: bool = False) -> Tables:
    text = prelude("spark", converge)
    read = lambda name: spark.sql(f"with {text} select * from {name}".replace("from events)", "from {events})"), events=events(spark, sf_dir))
    return Tables(read("frames"), read("positions"))
