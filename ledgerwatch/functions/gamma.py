"""The incomplete gamma function as a column expression."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Terms of the series and of the continued fraction at most; both end earlier where they have settled.
TERMS = 2000
_TINY = 1e-300


def log_gamma(a: Column) -> Column:
    """Logarithm of the gamma function for positive values: Stirling's series, eight units up."""
    z = a + F.lit(8.0)
    shift = sum((F.ln(a + F.lit(float(k))) for k in range(1, 8)), F.ln(a))
    inverse = F.lit(1.0) / (z * z)
    # Coefficients B(2k) / (2k (2k - 1)) of the series.
    tail = F.lit(0.0)
    for c in reversed((1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360)):
        tail = tail * inverse + F.lit(c)
    return (z - 0.5) * F.ln(z) - z + F.lit(0.5 * math.log(2 * math.pi)) + tail / z - shift


def upper_gamma(a: Column, x: Column) -> Column:
    """The regularised upper incomplete gamma function Q(a, x), for positive a and x from 0 on.

    Below a + 1 by the series of the lower function, above by the continued fraction (Lentz).
    Right to about 1e-12 for a up to some hundred thousand.
    """
    a, x = a.cast("double"), x.cast("double")
    front = F.exp(a * F.ln(x) - x - log_gamma(a))
    steps = F.sequence(F.lit(1), F.lit(TERMS))

    def more(s: Column, k: Column) -> Column:
        term = s["term"] * x / (a + k)
        return F.when(s["term"] < s["sum"] * 1e-17, s).otherwise(F.struct(term.alias("term"), (s["sum"] + term).alias("sum")))

    first = F.struct((F.lit(1.0) / a).alias("term"), (F.lit(1.0) / a).alias("sum"))
    lower = front * F.aggregate(steps, first, more)["sum"]

    def safe(v: Column) -> Column:
        return F.when(F.abs(v) < _TINY, F.lit(_TINY)).otherwise(v)

    def deeper(s: Column, k: Column) -> Column:
        part = -k * (k - a)
        base = x + 1.0 - a + 2.0 * k
        d = F.lit(1.0) / safe(part * s["d"] + base)
        c = safe(base + part / s["c"])
        return F.when(s["done"], s).otherwise(F.struct(
            c.alias("c"), d.alias("d"), (s["h"] * c * d).alias("h"), (F.abs(c * d - 1.0) < 1e-16).alias("done")))

    d = F.lit(1.0) / safe(x + 1.0 - a)
    begin = F.struct(F.lit(1.0 / _TINY).alias("c"), d.alias("d"), d.alias("h"), F.lit(False).alias("done"))
    upper = front * F.aggregate(steps, begin, deeper)["h"]
    return F.when(x <= 0, F.lit(1.0)).when(x < a + 1.0, F.lit(1.0) - lower).otherwise(upper)


def chi_square_pvalue(statistic: Column, degrees: Column) -> Column:
    """Probability of a chi-square value at least this large; null without degrees of freedom."""
    p = upper_gamma(degrees / 2.0, F.greatest(statistic, F.lit(0.0)) / 2.0)
    return F.when(degrees > 0, F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)))
