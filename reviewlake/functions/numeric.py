"""Rounding, ratios, bins and correlation."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def rnd(c: Column, digits: int) -> Column:
    """Scale, round half away from zero, unscale: the rounding columnar engines use, bit for bit."""
    if digits == 0:
        return F.round(c.cast("double"))
    scale = float(10 ** digits)
    return F.round(c.cast("double") * scale) / scale


def pct(part: Column, whole: Column, digits: int) -> Column:
    """100 * part / whole; null when the whole is zero."""
    return rnd(F.try_divide(part, whole) * 100, digits)


def mean(c: Column, digits: int) -> Column:
    return rnd(F.avg(c), digits)


def money_mean(c: Column, digits: int = 2, cents: int = 2) -> Column:
    """Mean of amounts with ``cents`` decimals. Sums are settled first, so the order of addition cannot tip a tie."""
    return rnd(F.try_divide(rnd(F.sum(c), cents), F.count(c)), digits)


def count_if(cond: Column) -> Column:
    return F.count_if(cond)


def clip(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def bin_label(c: Column, edges: list[int]) -> Column:
    """Right-closed bin label for ``edges``, with one open bin at each end; null stays null."""
    label = F.when(c <= edges[0], F.lit(f"<={edges[0]}"))
    for low, high in zip(edges, edges[1:]):
        label = label.when(c <= high, F.lit(f"{low}-{high}"))
    return label.when(c > edges[-1], F.lit(f">{edges[-1]}"))


def bin_ordinal(c: Column, edges: list[int]) -> Column:
    """Position of the bin of ``bin_label``, for sorting."""
    rank = F.when(c <= edges[0], F.lit(0))
    for i, high in enumerate(edges[1:], start=1):
        rank = rank.when(c <= high, F.lit(i))
    return rank.when(c > edges[-1], F.lit(len(edges)))


def pearson_or_null(x: Column, y: Column) -> Column:
    """Pearson r over complete pairs; null when one side is constant.

    ``corr`` divides by zero on a constant side, so r is put together from covariance and deviations.
    """
    x, y = x.cast("double"), y.cast("double")
    complete = x.isNotNull() & y.isNotNull()
    dev = F.stddev_pop(F.when(complete, x)) * F.stddev_pop(F.when(complete, y))
    return F.try_divide(F.covar_pop(x, y), dev)


def pearson(x: Column, y: Column, digits: int = 4) -> Column:
    """``pearson_or_null`` rounded, with 0 for a constant side."""
    return F.coalesce(rnd(pearson_or_null(x, y), digits), F.lit(0.0))
