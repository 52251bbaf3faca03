"""Numeric functions on columns: years, sizes, intervals, scores, intervals of confidence."""

from __future__ import annotations

import statistics

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import CONFERENCE, FOLLOW_UP, PREPRINT, PRIMARY, PROTOCOL, SECONDARY, SUBGROUP

COMPLEMENTARY = ((PROTOCOL, PRIMARY), (PROTOCOL, FOLLOW_UP), (CONFERENCE, PRIMARY), (PREPRINT, PRIMARY), (PRIMARY, SECONDARY), (PRIMARY, SUBGROUP), (PRIMARY, FOLLOW_UP))


def steps(value: Column, levels: list[tuple[float, float]], otherwise: float, at_least: bool = False) -> Column:
    """The score of the first level that ``value`` keeps to; null for null."""
    out = F.when(value.isNull(), F.lit(None).cast("double"))
    for bound, score in levels:
        out = out.when(value >= bound if at_least else value <= bound, score)
    return out.otherwise(otherwise)


def year_similarity(a: Column, b: Column) -> Column:
    return steps(F.abs(a - b), [(0, 1.0), (1, 0.75), (2, 0.25)], 0.0)


def year_compatibility(a: Column, b: Column) -> Column:
    return steps(F.abs(a - b), [(1, 1.0), (3, 0.8), (7, 0.55), (15, 0.25)], 0.0)


def sample_size_similarity(a: Column, b: Column) -> Column:
    ratio = F.when((a > 0) & (b > 0), F.least(a, b) / F.greatest(a, b))
    return steps(ratio, [(0.95, 1.0), (0.80, 0.8), (0.60, 0.5), (0.35, 0.2)], 0.0, at_least=True)


def interval(start: Column, end: Column) -> Column:
    """struct(a, b) in order, a missing end taken from the other; null if both are."""
    lo, hi = F.coalesce(start, end), F.coalesce(end, start)
    return F.when(lo.isNotNull(), F.struct(F.least(lo, hi).alias("a"), F.greatest(lo, hi).alias("b")))


def interval_similarity(x: Column, y: Column) -> Column:
    gap = F.greatest(y["a"] - x["b"], x["a"] - y["b"])
    return F.when(x.isNull() | y.isNull(), F.lit(None).cast("double")).when(F.greatest(x["a"], y["a"]) <= F.least(x["b"], y["b"]), 1.0).when(gap <= 1, 0.6).when(gap <= 3, 0.2).otherwise(0.0)


def role_complementarity(a: Column, b: Column) -> Column:
    pair = F.concat_ws("|", F.array_sort(F.array(a, b)))
    return F.when(a == b, 0.0).when(pair.isin(*["|".join(sorted(p)) for p in COMPLEMENTARY]), 1.0).otherwise(0.25)


def year_in(x: Column, centuries: str = "19|20|21") -> Column:
    """The first four-digit year in a text."""
    return F.regexp_extract(x.cast("string"), rf"\b((?:{centuries})\d\d)\b", 1).try_cast("int")


def leading_year(x: Column) -> Column:
    """The first four characters as a year between 1000 and 3000."""
    year = F.substring(x.cast("string"), 1, 4).try_cast("int")
    return F.when(year.between(1000, 3000), year)


def first_number(x: Column) -> Column:
    """The first whole number of at most eight digits, thousands separators taken out."""
    return F.regexp_extract(F.replace(x.cast("string"), F.lit(","), F.lit("")), r"\b(\d{1,8})\b", 1).try_cast("int")


def sigmoid(x: Column) -> Column:
    """The logistic function without overflow; both branches as they round."""
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(q / (1 - q))


def safe_divide(a: Column, b: Column, empty: float) -> Column:
    """a / b, or ``empty`` where b is 0; what an empty denominator means differs by metric."""
    return F.when(b != 0, a / b).otherwise(F.lit(float(empty)))


def wilson(successes: Column, n: Column, confidence: float = 0.95) -> tuple[Column, Column]:
    """Bounds of the Wilson score interval; NaN where n is 0."""
    z = statistics.NormalDist().inv_cdf(0.5 + confidence / 2)
    p, zz = successes / n, F.lit(z * z)
    middle = (p + zz / (2 * n)) / (1 + zz / n)
    half = F.lit(z) * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n)
    nan = F.lit(float("nan"))
    return F.when(n > 0, F.greatest(middle - half, F.lit(0.0))).otherwise(nan), F.when(n > 0, F.least(middle + half, F.lit(1.0))).otherwise(nan)
