"""SQL fragments for DuckDB that several oracles share."""

from __future__ import annotations

from ..sources.adapter import prelude

P = prelude("duckdb")
PC = prelude("duckdb", converge=True)


def d(a: str, b: str) -> str:
    return f"sqrt(({a}x - {b}x) * ({a}x - {b}x) + ({a}y - {b}y) * ({a}y - {b}y))"


HOLD = """
near as (select p.*, sqrt((x - ball_x) * (x - ball_x) + (y - ball_y) * (y - ball_y)) as d from positions p join frames using (frame_idx) where ball_x is not null),
best as (select * from (select *, row_number() over (partition by frame_idx order by d, ord desc) as rn from near where d <= 2.0) where rn = 1),
hold as (select f.frame_idx as i, f.t, b.track_id as ht, b.team as hg, b.x as hx, b.y as hy from frames f left join best b using (frame_idx))"""

#: The possession machine, one frame a step.
SPELLS = HOLD + """,
walk as (
  select -1 as i, cast(null as varchar) as cur, cast(null as varchar) as cg, cast(null as double) as cx, cast(null as double) as cy, cast(null as int) as s, cast(null as int) as l,
    cast(null as varchar) as kand, cast(null as varchar) as kg, cast(null as double) as kx, cast(null as double) as ky, cast(null as int) as ks, 0 as run,
    cast(null as varchar) as et, cast(null as varchar) as eg, cast(null as int) as es, cast(null as int) as ee
  union all
  select i2, case when starts then k2 when ends then null else cur end, case when starts then kg2 when ends then null else cg end,
    case when goes or starts then hx else cx end, case when goes or starts then hy else cy end,
    case when starts then ks2 else s end, case when goes or starts then i2 else l end,
    k2, kg2, case when placed then hx else kx end, case when placed then hy else ky end, ks2, run2,
    case when ends then cur end, case when ends then cg end, case when ends then s end, case when ends then l end
  from (select *, placed and run2 >= 3 as starts from (
    select *, again or fresh as placed, case when again then run + 1 when fresh then 1 when ends then 0 else run end as run2,
      case when fresh then ht when ends then null else kand end as k2, case when fresh then hg when ends then null else kg end as kg2, case when fresh then i2 else ks end as ks2 from (
      select *, coalesce((cur is null or ends) and ht is not null and not again, false) as fresh from (
        select *, coalesce((cur is null or ends) and ht is not null and not ends and kand is not null and hg = kg
          and (ht = kand or sqrt((hx - kx) * (hx - kx) + (hy - ky) * (hy - ky)) <= 2.0), false) as again from (
          select *, cur is not null and not goes and not (ht is null and i2 - l <= 12) as ends from (
            select w.*, h.i as i2, h.ht, h.hg, h.hx, h.hy,
              coalesce(cur is not null and ht is not null and hg = cg and (ht = cur or sqrt((hx - cx) * (hx - cx) + (hy - cy) * (hy - cy)) <= 2.0), false) as goes
            from walk w join hold h on h.i = w.i + 1))))))),
raw as (
  select et as track_id, eg as team, es as i_start, ee as i_end from walk where et is not null
  union all select cur, cg, s, l from walk where i = (select max(i) from hold) and cur is not null),
spells as (
  select r.*, a.t as t_start, b.t as t_end, row_number() over (order by i_start) as spell from raw r join hold a on a.i = r.i_start join hold b on b.i = r.i_end)"""

CARRIERS = SPELLS + """,
carriers as (
  select f.frame_idx, f.t, s.spell, s.track_id as carrier, s.team, p.x as cx, p.y as cy
  from spells s join frames f on f.frame_idx between s.i_start and s.i_end join positions p on p.frame_idx = f.frame_idx and p.track_id = s.track_id
  where sqrt((p.x - ball_x) * (p.x - ball_x) + (p.y - ball_y) * (p.y - ball_y)) <= 3.0)"""

RANKED = """
ranked as (
  select p.*, case when team = 'home' then att_home else att_away end as sign,
    row_number() over (partition by p.frame_idx, team order by (case when team = 'home' then att_home else att_away end) * x, ord) as back
  from positions p join frames f using (frame_idx))"""


def anchors(name: str, source: str, keys: str, length: int, closing: bool = False) -> str:
    """CTEs ``name`` (keys, t_ms, anchor): windows begun anew at the first row after the last has ended."""
    k = f"{keys}, " if keys else ""
    same = "".join(f" and o.{c.strip()} = w.{c.strip()}" for c in keys.split(",") if c.strip())
    part = f"partition by {keys}" if keys else ""
    new = "w.done" if closing else f"o.t_ms - w.anchor >= {length}"
    done = f"o.t_ms - (case when {new} then o.t_ms else w.anchor end) >= {length}" if closing else "false"
    return f"""
{name}_o as (select {k}t_ms, row_number() over ({part} order by t_ms) as n from (select distinct {k}t_ms from {source})),
{name}_w as (
  select {k}t_ms, n, t_ms as anchor, {f"0 >= {length}" if closing else "false"} as done from {name}_o where n = 1
  union all
  select {"".join(f"o.{c.strip()}, " for c in keys.split(",") if c.strip())}o.t_ms, o.n, case when {new} then o.t_ms else w.anchor end, {done}
  from {name}_w w join {name}_o o on o.n = w.n + 1{same}),
{name} as (select {k}t_ms, anchor from {name}_w)"""


def shapes(window: int) -> str:
    """CTE ``lines``: outfield players of re-anchored windows with their line."""
    return anchors("anc", "frames", "", window) + """,
wf as (select f.*, a.anchor from frames f join anc a using (t_ms)),
wn as (select anchor, count(*) as frames_n, min(t) as t_start, max(t) as t_end from wf group by anchor),
seen as (select anchor, team, track_id, avg(x) as x, avg(y) as y, count(*) as n from positions p join wf using (frame_idx) group by all),
kept as (select s.*, t_start, t_end, row_number() over (partition by s.anchor, team order by n desc, track_id) as rk from seen s join wn using (anchor) where n / frames_n >= 0.5),
deep as (select *, case when team = 'home' then x else 105.0 - x end as depth, count(*) over (partition by anchor, team) as cnt from kept where rk <= 11),
outf as (select * from (select *, row_number() over (partition by anchor, team order by depth, track_id) as back from deep) where back > 1 and cnt > 6),
gaps as (select *, depth - lag(depth) over (partition by anchor, team order by depth, track_id) as gap from outf),
rk as (select *, row_number() over (partition by anchor, team order by gap desc nulls last, depth) as r from gaps),
lines as (select *, 1 + sum(case when gap is not null and (r = 1 or (r <= 3 and gap >= 5.0)) then 1 else 0 end)
  over (partition by anchor, team order by depth, track_id rows unbounded preceding) as line from rk)"""
