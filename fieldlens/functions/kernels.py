"""Scalar functions over coordinates in metres, as Columns.

Points of array arguments are structs with fields x and y; tracks are arrays of
structs with t and coordinates, sorted by t or not.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import AWAY, HOME, LENGTH, WIDTH

BOUNDS = (-3.0, 108.0, -3.0, 71.0)
#: The template pitch of 12000 x 7000 cm that landmarks are given on: 32 key points (fixed values).
LANDMARKS_CM = [
    (0, 0), (0, 1450), (0, 2584), (0, 4416), (0, 5550), (0, 7000), (550, 2584), (550, 4416), (1100, 3500), (2015, 1450), (2015, 2584),
    (2015, 4416), (2015, 5550), (6000, 0), (6000, 2585), (6000, 4415), (6000, 7000), (9985, 1450), (9985, 2584), (9985, 4416),
    (9985, 5550), (10900, 3500), (11450, 2584), (11450, 4416), (12000, 0), (12000, 1450), (12000, 2584), (12000, 4416), (12000, 5550),
    (12000, 7000), (5085, 3500), (6915, 3500),
]


def lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def dist(ax, ay, bx, by) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def other(team: Column) -> Column:
    return F.when(team == HOME, AWAY).otherwise(HOME)


def point_segment(px, py, ax, ay, bx, by) -> Column:
    """Distance from a point to a segment; to its first end if it is shorter than 3e-5 m."""
    dx, dy = bx - ax, by - ay
    length2 = dx * dx + dy * dy
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide((px - ax) * dx + (py - ay) * dy, length2)))
    return F.when(length2 < 1e-9, dist(px, py, ax, ay)).otherwise(dist(px, py, ax + t * dx, ay + t * dy))


def attack_depth(x: Column, sign: Column) -> Column:
    """Metres from the own goal line, towards the attacked goal."""
    return x * sign + F.when(sign > 0, 0.0).otherwise(LENGTH)


def touchline(y: Column) -> Column:
    return F.least(y, F.lit(WIDTH) - y)


def lateral(run_y: Column, carrier_y: Column) -> Column:
    """'overlap' on the carrier's side and nearer the touchline, 'underlap' between carrier and centre, else null."""
    run, carrier = run_y - WIDTH / 2, carrier_y - WIDTH / 2
    same_side = run * carrier > 0
    return F.when(same_side & (touchline(run_y) < touchline(carrier_y)), "overlap").when(
        (F.least(carrier_y, F.lit(WIDTH / 2)) < run_y) & (run_y < F.greatest(carrier_y, F.lit(WIDTH / 2))), "underlap"
    )


def own_goal(sign: Column) -> Column:
    return F.when(sign > 0, 0.0).otherwise(LENGTH)


def goal_side(ax: Column, bx: Column, a_sign: Column) -> Column:
    """Whether a is nearer a's own goal than b is."""
    return F.abs(ax - own_goal(a_sign)) < F.abs(bx - own_goal(a_sign))


def project(h: Column, x: Column, y: Column) -> Column:
    """Struct (x, y) of a point under a row-major 3x3 homography; null at infinity or without a homography."""
    e = lambda i: F.element_at(h, i)
    w = e(7) * x + e(8) * y + e(9)
    return F.when(F.abs(w) >= 1e-9, F.struct(((e(1) * x + e(2) * y + e(3)) / w).alias("x"), ((e(4) * x + e(5) * y + e(6)) / w).alias("y")))


def inverse(h: Column) -> Column:
    """The inverse homography, by cofactors, up to scale; null if it has none."""
    a, b, c, d, e, f, g, i, j = (F.element_at(h, k) for k in range(1, 10))
    det = a * (e * j - f * i) - b * (d * j - f * g) + c * (d * i - e * g)
    rows = [e * j - f * i, c * i - b * j, b * f - c * e, f * g - d * j, a * j - c * g, c * d - a * f, d * i - e * g, b * g - a * i, a * e - b * d]
    return F.when(F.abs(det) > 1e-18, F.array(*rows))


def to_pixel(h: Column, x: Column, y: Column, width: float, height: float) -> Column:
    """A point in metres on the image, null if it falls more than an image away."""
    p = project(inverse(h), x, y)
    return F.when(p.x.between(-width, 2 * width) & p.y.between(-height, 2 * height), p)


def in_bounds(x: Column, y: Column) -> Column:
    return x.between(BOUNDS[0], BOUNDS[1]) & y.between(BOUNDS[2], BOUNDS[3])


def foot_point(box: Column) -> Column:
    return F.struct(((F.element_at(box, 1) + F.element_at(box, 3)) / 2).alias("x"), F.element_at(box, 4).alias("y"))


def iou(a: tuple, b: tuple) -> Column:
    """Intersection over union of boxes (x1, y1, x2, y2); 0 for boxes without area."""
    w = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
    return F.when(union > 0, w * h / union).otherwise(0.0)


def _once(value: Column, use) -> Column:
    """``use(value)``, with ``value`` worked out once however often ``use`` refers to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def densify(points: Column, step: float = 1.5) -> Column:
    """A polyline with points every ``step`` metres or so: each leg in max(int(length / step), 1) equal parts."""

    def leg(a: Column, b: Column) -> Column:
        n = F.greatest(F.floor(dist(a.x, a.y, b.x, b.y) / step).cast("int"), F.lit(1))
        return F.struct(a.alias("a"), b.alias("b"), n.alias("n"))

    def parts(s: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), s.n - 1), lambda k: F.struct((s.a.x + (s.b.x - s.a.x) * k / s.n).alias("x"), (s.a.y + (s.b.y - s.a.y) * k / s.n).alias("y"))
        )

    def dense(ps: Column) -> Column:
        n = F.size(ps)
        less = F.greatest(n - 1, F.lit(0))
        legs = F.zip_with(F.slice(ps, F.lit(1), less), F.slice(ps, F.lit(2), less), leg)
        return F.when(n < 2, ps).otherwise(F.concat(F.flatten(F.transform(legs, parts)), F.slice(ps, F.greatest(n, F.lit(1)), F.lit(1))))

    return _once(points, dense)


def circle(x: Column, y: Column, radius, n: int = 29) -> Column:
    """``n`` points of a circle, the last on the first."""
    angle = lambda i: i * (2 * 3.141592653589793 / (n - 1))
    return F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)),
        lambda i: F.struct((x + lit(radius) * F.cos(angle(i))).alias("x"), (y + lit(radius) * F.sin(angle(i))).alias("y")),
    )


def interpolate(track: Column, t: Column, fields: tuple[str, ...]) -> Column:
    """A track's point at time t: held at the ends, linear between the neighbours; null for an empty track.

    It looks at the whole track; for many times of one track, see ``joins.interpolated``.
    """

    def near(ordered: Column) -> Column:
        before = F.try_element_at(F.filter(ordered, lambda p: p.t <= t), F.lit(-1))
        after = F.try_element_at(F.filter(ordered, lambda p: p.t >= t), F.lit(1))
        return F.struct(before.alias("before"), after.alias("after"))

    def point(two: Column) -> Column:
        before, after = two.before, two.after
        share = F.coalesce(F.try_divide(t - before.t, after.t - before.t), F.lit(0.0))
        pick = lambda f: F.when(before.isNull(), after[f]).when(after.isNull(), before[f]).otherwise(before[f] + share * (after[f] - before[f]))
        return F.struct(*(pick(f).alias(f) for f in fields))

    return F.when(F.size(track) > 0, _once(_once(F.array_sort(track), near), point))


def path_prefix(path: Column, t: Column) -> Column:
    """The points (t, x, y) of a path up to t, with the interpolated tip unless it is the last of them."""
    done = F.filter(F.array_sort(path), lambda p: p.t <= t)
    tip = interpolate(path, t, ("x", "y"))
    last = F.try_element_at(done, F.lit(-1))
    same = last.isNotNull() & (last.x == tip.x) & (last.y == tip.y)
    return F.when(same | tip.isNull(), done).otherwise(F.concat(done, F.array(F.struct(t.alias("t"), tip.x.alias("x"), tip.y.alias("y")))))


def press_level(intensity: Column, nearest: Column) -> Column:
    return F.when((intensity >= 5) & (nearest <= 3), "high").when(intensity >= 3, "medium").otherwise("low")


def block_level(line_height: Column) -> Column:
    return F.when(line_height < LENGTH / 3, "low").when(line_height < 2 * LENGTH / 3, "mid").otherwise("high")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector is shorter than 1e-9."""
    na, nb = F.sqrt(dot(a, a)), F.sqrt(dot(b, b))
    return F.when((na < 1e-9) | (nb < 1e-9), 0.0).otherwise(dot(a, b) / (na * nb))


def fade_alpha(t: Column, t0: Column, t1: Column, fade: float = 0.3, lead: float = 0.04, grace: float = 0.0) -> Column:
    """Opacity from 0.2 to 1, rising over the first and falling over the last ``fade`` seconds."""
    inner = F.least(t - t0 + lead, t1 + grace - t + lead)
    return F.greatest(F.lit(0.2), F.least(F.lit(1.0), inner / fade))


def is_matchup(kind: Column) -> Column:
    return kind.rlike(r"^\d+v\d+$")


def landmark_m(x_cm: Column, y_cm: Column) -> Column:
    """A landmark of the template pitch in metres of ours, y upwards."""
    return F.struct((x_cm / 12000.0 * LENGTH).alias("x"), (F.lit(WIDTH) - y_cm / 7000.0 * WIDTH).alias("y"))


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def hull(points: Column) -> Column:
    """Convex hull, counter-clockwise, without collinear points; up to two different points as they are, sorted.

    Monotone chain as a fold: a point pops those of the chain that don't turn left.
    """
    ordered = F.array_sort(F.array_distinct(points))

    def cross(o, a, b):
        return (a.x - o.x) * (b.y - o.y) - (a.y - o.y) * (b.x - o.x)

    def chain(seq: Column) -> Column:
        def add(done: Column, p: Column) -> Column:
            # the chain is kept up to its last left turn towards p; a point turns if it does so with the one before it
            n = F.size(done)
            keep = F.filter(
                F.sequence(F.lit(1), n), lambda k: (k < 2) | (cross(F.element_at(done, F.greatest(k - 1, F.lit(1))), F.element_at(done, k), p) > 0)
            )
            return F.concat(F.slice(done, F.lit(1), F.array_max(keep)), F.array(p))

        return F.aggregate(F.slice(seq, F.lit(2), F.size(seq)), F.slice(seq, F.lit(1), F.lit(1)), add)

    n = F.size(ordered)
    lower, upper = chain(ordered), chain(F.reverse(ordered))
    return F.when(n <= 2, ordered).otherwise(F.concat(F.slice(lower, F.lit(1), F.size(lower) - 1), F.slice(upper, F.lit(1), F.size(upper) - 1)))
