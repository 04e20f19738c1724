"""Scalar expressions: time of day, periods, seasons, kernels, similarities, three-way probabilities."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def time_to_minutes(hhmm) -> Column:
    """Minutes of day from a number like 1345; hour held to 0..23, minute to 0..59; null or text that is no number is 0."""
    whole = _col(hhmm).try_cast("double")
    iv = F.when(whole < 0, F.ceil(whole)).otherwise(F.floor(whole)).cast("long")
    hour = F.least(F.greatest(F.floor(iv / 100), F.lit(0)), F.lit(23))
    minute = F.pmod(iv, F.lit(100))
    return F.when(iv.isNull(), 0).otherwise(hour * 60 + F.least(minute, F.lit(59))).cast("int")


def departure_block(hour) -> Column:
    """Part of the day: 0-4, 5-9, 10-15, 16-19, the rest; null is -1."""
    h = _col(hour)
    return F.when(h.isNull(), -1).when(h.between(0, 4), 0).when(h.between(5, 9), 1).when(h.between(10, 15), 2).when(h.between(16, 19), 3).otherwise(4).cast("int")


def augment_times(df: DataFrame, dep: str = "CRSDepTime", arr: str = "CRSArrTime") -> DataFrame:
    """dep_hour, arr_hour, dep_block, and block_time_min: minutes from departure to arrival, over midnight if need be."""
    d, a = time_to_minutes(dep), time_to_minutes(arr)
    return df.withColumns(
        {
            "dep_hour": F.floor(d / 60).cast("int"),
            "arr_hour": F.floor(a / 60).cast("int"),
            "block_time_min": F.pmod(a - d, F.lit(1440)).cast("int"),
            "dep_block": departure_block(F.floor(d / 60)),
        }
    )


def time_slot(minutes, ranges: list[tuple[int, int]]) -> Column:
    """Index of the last half-open range [a, b) that holds the value, -1 if none does."""
    m = _col(minutes)
    slot = None
    for i, (a, b) in reversed(list(enumerate(ranges))):
        hit = (m >= a) & (m < b)
        slot = F.when(hit, i) if slot is None else slot.when(hit, i)
    return F.lit(-1) if slot is None else slot.otherwise(-1).cast("int")


def month_label(year, month) -> Column:
    return F.format_string("%d-%02d", _col(year).cast("int"), _col(month).cast("int"))


def period_index(year, month) -> Column:
    """Months since year 0, so that differences of periods are plain numbers."""
    return (_col(year) * 12 + _col(month) - 1).cast("int")


def window_label(year, month, base: int) -> Column:
    """Years since ``base`` with the month as hundredths, which count downwards before ``base``. Null for a month outside 1..12."""
    years = _col(year) - base
    value = F.when(years < 0, years - _col(month) / 100.0).otherwise(years + _col(month) / 100.0)
    return F.when(_col(month).between(1, 12), F.round(value, 2))


def parse_month_label(text) -> Column:
    """``y-m``, ``y_m`` or ``y/m`` as y +- m/100; plain numbers pass; anything else is null."""
    t = F.trim(_col(text).cast("string"))
    year = F.regexp_extract(t, r"^(-?\d+)[-_/](\d{1,2})$", 1)
    month = F.regexp_extract(t, r"^(-?\d+)[-_/](\d{1,2})$", 2)
    y, m = year.try_cast("int"), month.try_cast("int")
    return F.when(year == "", t.try_cast("double")).when(m.between(1, 12), F.when(y < 0, y - m / 100.0).otherwise(y + m / 100.0))


def cyclic(value, period: float) -> tuple[Column, Column]:
    """(sine, cosine) of the place in the period."""
    angle = 2 * math.pi * F.pmod(_col(value).cast("double"), F.lit(float(period))) / period
    return F.sin(angle), F.cos(angle)


def clock_minutes(hhmm) -> Column:
    """Minutes of day of a clock number, hours modulo 24 and minutes modulo 60."""
    v = _col(hhmm).cast("long")
    return F.pmod(F.floor(v / 100), F.lit(24)) * 60 + F.pmod(F.pmod(v, F.lit(100)), F.lit(60))


def event_date(year, month, day) -> Column:
    """Date of the parts, the day held to 1..31; null if there is no such day."""
    d = F.when(_col(day).isNotNull(), F.least(F.greatest(_col(day).cast("int"), F.lit(1)), F.lit(31)))
    return F.try_to_date(F.format_string("%04d-%02d-%02d", _col(year).cast("int"), _col(month).cast("int"), d), "yyyy-MM-dd")


def season_key(date, kind: str = "month") -> Column:
    """Mnn, ISO week Wnn, day of year Dnnn or quarter Qnn of a date; null is 'global'."""
    d = _col(date)
    part = {"month": ("M%02d", F.month), "week": ("W%02d", F.weekofyear), "day": ("D%03d", F.dayofyear), "quarter": ("Q%02d", F.quarter)}[kind]
    return F.when(d.isNull(), "global").otherwise(F.format_string(part[0], part[1](d)))


def month_gap(a, b, months: int = 12) -> Column:
    """Distance of two calendar months around the year."""
    d = F.abs(_col(a) - _col(b))
    return F.least(d, months - d)


def kernel(name: str, u) -> Column:
    """Weight of a scaled distance."""
    x = _col(u)
    if name == "gaussian":
        return F.exp(-x * x / 2)
    if name == "exponential":
        return F.exp(-F.greatest(x, F.lit(0.0)))
    inside = F.abs(x) <= 1
    body = {"uniform": F.lit(0.5), "epanechnikov": 0.75 * (1 - x * x), "triangular": 1 - F.abs(x)}[name]
    return F.when(inside, body).otherwise(0.0)


def rbf(left: list[Column], right: list[Column], sigma: float) -> Column:
    """exp(-|x - y|^2 / 2 sigma^2); 1 without columns; sigma is at least 1e-6."""
    s = max(sigma, 1e-6)
    if not left:
        return F.lit(1.0)
    total = sum(((a - b) * (a - b) for a, b in zip(left, right, strict=True)), F.lit(0.0))
    return F.exp(-total / (2 * s * s))


def category_match(left: list[Column], right: list[Column], weights: list[float]) -> Column:
    """Share of the positive weights whose values are equal, missing values being equal to each other; 1 without weights."""
    use = [(a, b, w) for a, b, w in zip(left, right, weights, strict=True) if w > 0]
    if not use:
        return F.lit(1.0)
    hit = sum((F.when(a.eqNullSafe(b), w).otherwise(0.0) for a, b, w in use), F.lit(0.0))
    return hit / sum(w for *_, w in use)


def mixed_similarity(numeric: Column, category: Column, mode: str = "product", mix: float = 0.5) -> Column:
    """Product, or numeric and category weighted by ``mix`` (held to 0..1) for mode weighted_sum."""
    if mode == "weighted_sum":
        m = min(max(mix, 0.0), 1.0)
        return m * numeric + (1 - m) * category
    return numeric * category


def three_way(e_pos, e_neg, eps: float = 1e-8) -> tuple[Column, Column, Column]:
    """(p_pos, p_neg, p_bnd) of the evidence for each side. Without evidence all is boundary."""
    a, b = _col(e_pos), _col(e_neg)
    total = F.greatest(a + b, F.lit(eps))
    p, n = a / total, b / total
    return p, n, F.least(F.greatest(1 - p - n, F.lit(0.0)), F.lit(1.0))


def region(p, alpha, beta) -> Column:
    """1 accept (p >= alpha), -1 reject (p <= beta), 0 defer."""
    x = _col(p)
    return F.when(x >= alpha, 1).when(x <= beta, -1).otherwise(0).cast("int")
