"""Scalar column expressions: recodes, keys, dates and link functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

#: Fixed value: the 0.975 quantile of the standard normal distribution.
Z975 = 1.959963984540054


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def visit_label(sample: str | Column) -> Column:
    """Sample 1, 2 or other to ``visit1``, ``visit2``, ``visit3``; missing stays missing."""
    s = _col(sample)
    return F.when(s == 1, "visit1").when(s == 2, "visit2").when(s.isNotNull(), "visit3")


def presence(count: str | Column) -> Column:
    """Three-valued: a missing count gives a missing presence."""
    return _col(count) > 0


def detected(count: str | Column) -> Column:
    """1 for a count other than 0, 0 for 0, missing for missing."""
    c = _col(count)
    return F.when(c != 0, 1).when(c.isNotNull(), 0).cast("int")


def site_year_key(*parts: str | Column, sep: str = "-") -> Column:
    """Parts joined by ``sep``; a missing part shows as ``NA`` instead of being skipped."""
    return F.concat_ws(sep, *[F.coalesce(_col(p).cast("string"), F.lit("NA")) for p in parts])


def route_number(stop: str | Column) -> Column:
    """Characters 6 and 7 of the stop identifier as a number."""
    return F.substring(_col(stop), 6, 2).try_cast("int")


def stop_number(event: str | Column) -> Column:
    """Third part of the event identifier; null when there are fewer parts."""
    return F.get(F.split(_col(event), "-"), F.lit(2))


def ratio(num: str | Column, den: str | Column) -> Column:
    """Quotient as a double; null instead of an error where the divisor is 0."""
    return F.try_divide(_col(num).cast("double"), _col(den).cast("double"))


def proportion(num: str | Column, den: str | Column) -> Column:
    return ratio(num, den)


def repeat_visits(col: str | Column, n: int = 4) -> Column:
    return F.array_repeat(_col(col), n)


def interval_bins(prefix: str = "ObservationCount") -> list[Column]:
    """``Obs1..Obs4`` from the eight intervals 2..9, two each.

    If one half of a bin is missing the bin is 0, as in the source data's convention.
    """
    return [
        F.coalesce(F.col(f"{prefix}{2 * k}") + F.col(f"{prefix}{2 * k + 1}"), F.lit(0)).alias(f"Obs{k}")
        for k in range(1, 5)
    ]


def survey_date(year: str | Column, month: str | Column, day: str | Column) -> Column:
    """Date from its parts; null for a day that does not exist."""
    parts = [_col(p).cast("string") for p in (year, month, day)]
    complete = parts[0].isNotNull() & parts[1].isNotNull() & parts[2].isNotNull()
    return F.when(complete, F.try_to_date(F.concat_ws("-", *parts), "y-M-d"))


def day_of_year(year: str | Column, month: str | Column, day: str | Column) -> Column:
    return F.dayofyear(survey_date(year, month, day))


def survey_ts(
    year: str | Column, month: str | Column, day: str | Column, hour: str | Column, minute: str | Column
) -> Column:
    """Timestamp from five integers; null when they name no instant."""
    parts = [_col(c) for c in (year, month, day, hour, minute)]
    return F.try_make_timestamp_ntz(*parts, F.lit(0))


def clock(ts: str | Column) -> Column:
    """Time of day as ``HH:MM``."""
    return F.date_format(_col(ts), "HH:mm")


def decimal_hours(ts: str | Column) -> Column:
    ts = _col(ts)
    return F.hour(ts) + F.minute(ts) / F.lit(60.0)


def offset(effort: str | Column) -> Column:
    """Log of effort, to be added to a linear predictor; null for effort 0."""
    return F.log(_col(effort).cast("double"))


def plogis(lp: str | Column) -> Column:
    """Inverse logit."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_col(lp)))


def logit(p: str | Column) -> Column:
    p = _col(p)
    return F.log(ratio(p, F.lit(1.0) - p))


def linear(coefs: Sequence[Column], terms: Sequence[Column]) -> Column:
    """Sum of products of two equally long lists of columns."""
    out = F.lit(0.0)
    for b, x in zip(coefs, terms, strict=True):
        out = out + b * x
    return out


_SHIFT = 8


def _shifted(x: Column) -> tuple[list[Column], Column]:
    return [x + F.lit(float(k)) for k in range(_SHIFT)], x + F.lit(float(_SHIFT))


def lgamma(x: Column) -> Column:
    """Log gamma for positive x: recurrence up by 8, then Stirling's series."""
    low, z = _shifted(x)
    product = low[0]
    for term in low[1:]:
        product = product * term
    z2 = z * z
    series = (F.lit(1 / 12) - (F.lit(1 / 360) - (F.lit(1 / 1260) - F.lit(1 / 1680) / z2) / z2) / z2) / z
    return (z - 0.5) * F.log(z) - z + F.lit(0.9189385332046727) + series - F.log(product)


def digamma(x: Column) -> Column:
    """Derivative of :func:`lgamma`."""
    low, z = _shifted(x)
    z2 = z * z
    out = F.log(z) - F.lit(0.5) / z
    out = out - (F.lit(1 / 12) - (F.lit(1 / 120) - (F.lit(1 / 252) - F.lit(1 / 240) / z2) / z2) / z2) / z2
    for term in low:
        out = out - F.lit(1.0) / term
    return out


def trigamma(x: Column) -> Column:
    """Derivative of :func:`digamma`."""
    low, z = _shifted(x)
    z2 = z * z
    out = F.lit(1.0) / z + F.lit(0.5) / z2
    out = out + (F.lit(1 / 6) - (F.lit(1 / 30) - (F.lit(1 / 42) - F.lit(1 / 30) / z2) / z2) / z2) / (z2 * z)
    for term in low:
        out = out + F.lit(1.0) / (term * term)
    return out


def hashed(*keys: str, seed: int = 1) -> Column:
    """A number below 2^60 from the MD5 of the keys as text and the seed; any engine computes the same."""
    digest = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")
