"""Scalar column helpers: rounding, safe ratios, banding, curves."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def col(c):
    return c if isinstance(c, Column) else F.col(c)


def half_even(c, digits=0):
    """Banker's rounding, kept as DOUBLE."""
    return F.bround(col(c).cast("double"), digits).cast("double")


def ratio(num, den, default=None):
    """num/den in doubles; `default` (null unless given) when den is 0 or null."""
    d = col(den).cast("double")
    out = F.try_divide(col(num).cast("double"), F.when(d != 0, d))
    return out if default is None else F.coalesce(out, F.lit(float(default)))


def pct(num, den, digits=0, default=0.0):
    return half_even(100 * ratio(num, den, default), digits)


def band_by_upper(value, bands):
    """First label whose upper bound is >= value; the last label catches the rest."""
    v = col(value)
    out = None
    for hi, label in bands[:-1]:
        out = F.when(v <= hi, label) if out is None else out.when(v <= hi, label)
    last = F.lit(bands[-1][1])
    return last if out is None else out.otherwise(last)


def level_high_is_worse(value, medium, high):
    v = col(value)
    return F.when(v >= high, 2).when(v >= medium, 1).otherwise(0)


def level_low_is_worse(value, medium, high):
    v = col(value)
    return F.when(v <= high, 2).when(v <= medium, 1).otherwise(0)


def step_down(value, steps, default):
    """Step function: value of the first (lower bound, result) reached."""
    v = col(value)
    out = None
    for lo, r in steps:
        out = F.when(v >= lo, F.lit(r)) if out is None else out.when(v >= lo, F.lit(r))
    return out.otherwise(F.lit(default))


def check_curve(points):
    """A payout curve must be increasing in percentile, within 0..100, payouts >= 0."""
    pts = [(float(x), float(y)) for x, y in points]
    if len(pts) < 2:
        raise ValueError("a curve needs at least two points")
    for (x0, _), (x1, _) in zip(pts, pts[1:]):
        if not x1 > x0:
            raise ValueError("curve points must be strictly increasing")
    for x, y in pts:
        if not (math.isfinite(x) and math.isfinite(y)) or not 0 <= x <= 100 or y < 0:
            raise ValueError("curve point outside range")
    return pts


def payout(percentile, points):
    """Piecewise linear payout: 0 below the first point, flat after the last."""
    pts = check_curve(points)
    p = col(percentile).cast("double")
    out = F.when(p < pts[0][0], 0.0)
    for (x0, y0), (x1, y1) in zip(pts, pts[1:]):
        out = out.when(p <= x1, y0 + (p - x0) * (y1 - y0) / (x1 - x0))
    return out.otherwise(pts[-1][1])


def anchor_percentile(value, anchors):
    """Position of a value on (value, percentile) anchors, linear in between, flat outside."""
    v = col(value).cast("double")
    out = F.when(v <= anchors[0][0], float(anchors[0][1]))
    for (x0, p0), (x1, p1) in zip(anchors, anchors[1:]):
        out = out.when(v <= x1, p0 + (v - x0) * (p1 - p0) / (x1 - x0))
    return out.otherwise(float(anchors[-1][1]))


def clamp(c, lo, hi):
    return F.greatest(F.lit(lo), F.least(F.lit(hi), c))


def sigmoid(z, bound=60.0):
    z = clamp(col(z), -bound, bound)
    return 1.0 / (1.0 + F.exp(-z))


def log_closeness(a, b, halving=2.0):
    """1 at equal size, 0 once the two differ by the given factor."""
    r = F.try_divide(col(a).cast("double"), col(b).cast("double"))
    ok = (col(a) > 0) & (col(b) > 0)
    return F.when(ok, F.greatest(F.lit(0.0), 1 - F.abs(F.ln(r)) / math.log(halving))).otherwise(0.0)


def finite(c):
    """Text or number to a finite DOUBLE, else null."""
    v = col(c).try_cast("double")
    return F.when(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")), v)


def whole(c):
    """Text or number to BIGINT only if it is a whole number, else null."""
    v = finite(c)
    return F.when(v == F.floor(v), F.floor(v).cast("bigint"))
