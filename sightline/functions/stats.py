"""Statistical kernels as JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the two-sided 95 % point of the normal distribution.
Z95 = 1.959963984540054


def round_half_up(value: Column, digits: int = 0) -> Column:
    """Rounds halves towards plus infinity."""
    scale = 10.0**digits
    return F.floor(value * scale + 0.5) / scale


def log_factorial(n: Column) -> Column:
    """ln n! of a whole number: summed up to 32, beyond by Stirling's series to 1/n^7, exact to double precision."""
    small = F.aggregate(F.sequence(F.lit(1).cast("bigint"), F.greatest(F.least(n.cast("bigint"), F.lit(32)), F.lit(1))), F.lit(0.0), lambda a, k: a + F.ln(k.cast("double")))
    x = n.cast("double")
    series = x * F.ln(x) - x + 0.5 * F.ln(x * 6.283185307179586) + 1 / (12 * x) - 1 / (360 * F.pow(x, F.lit(3))) + 1 / (1260 * F.pow(x, F.lit(5))) - 1 / (1680 * F.pow(x, F.lit(7)))
    return F.when(n <= 32, small).otherwise(series)


def sign_test_p(gained: Column, lost: Column) -> Column:
    """Exact two-sided p of a sign (McNemar) test on discordant counts; 1 without any. Sums tail terms from the middle out."""
    n, k = (gained + lost).cast("bigint"), F.least(gained, lost).cast("bigint")
    # terms C(n, i) / 2^n for i = k down to 0, each from the one before: no term is larger than the first
    first = F.exp(log_factorial(n) - log_factorial(k) - log_factorial(n - k) - n * 0.6931471805599453)
    start = F.struct(first.alias("term"), first.alias("total"))
    step = F.aggregate(
        F.when(k > 0, F.sequence(k, F.lit(1).cast("bigint"), F.lit(-1).cast("bigint"))).otherwise(F.array().cast("array<bigint>")), start,
        lambda s, i: F.struct((s["term"] * i / (n - i + 1)).alias("term"), (s["total"] + s["term"] * i / (n - i + 1)).alias("total")),
    )
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * step["total"]))


def binomial_tail(successes: Column, trials: Column) -> Column:
    """Chance of `successes` or more heads in `trials` throws of a fair coin; 1 without trials or for counts out of range."""
    n, k = trials.cast("bigint"), successes.cast("bigint")
    # the far tail is summed from its largest term; a near one is what the other side leaves
    upper = 2 * k > n
    h = F.when(upper, k).otherwise(n - k + 1)
    first = F.exp(log_factorial(n) - log_factorial(h) - log_factorial(n - h) - n * 0.6931471805599453)
    start = F.struct(first.alias("term"), first.alias("total"))
    higher = F.when(h < n, F.sequence(h, n - 1)).otherwise(F.array().cast("array<bigint>"))
    step = F.aggregate(higher, start, lambda s, i: F.struct((s["term"] * (n - i) / (i + 1)).alias("term"), (s["total"] + s["term"] * (n - i) / (i + 1)).alias("total")))
    tail = F.when(h > n, 0.0).otherwise(step["total"])
    return F.when((n < 1) | (k < 0) | (k > n), 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(upper, tail).otherwise(1 - tail))))


def erf(x: Column) -> Column:
    """The error function by Abramowitz and Stegun 7.1.26 (to 1.5e-7)."""
    a = F.abs(x)
    t = 1 / (1 + 0.3275911 * a)
    poly = ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t
    return F.signum(x) * (1 - poly * F.exp(-a * a))


def normal_p(z: Column) -> Column:
    """Two-sided p of a standard normal value."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - erf(F.abs(z) / 1.4142135623730951)))


def mcnemar_p(gained: Column, lost: Column, exact_limit: int = 500) -> Column:
    """McNemar's p: exact up to `exact_limit` discordant pairs, beyond with the continuity-corrected normal."""
    n = gained + lost
    z = F.greatest(F.lit(0.0), F.abs(gained - lost) - 1.0) / F.sqrt(n.cast("double"))
    return F.when(n <= exact_limit, sign_test_p(gained, lost)).otherwise(normal_p(z))


def wilson(successes: Column, n: Column) -> Column:
    """Wilson's 95 % interval of a share as STRUCT<lower, upper>; null for n = 0."""
    p, z2 = successes / n, Z95 * Z95
    centre, spread = (p + z2 / (2 * n)) / (1 + z2 / n), Z95 * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    return F.when(n > 0, F.struct(F.greatest(F.lit(0.0), centre - spread).alias("lower"), F.least(F.lit(1.0), centre + spread).alias("upper")))


def wilson_size(share: float, half_width: float) -> int:
    """The least number of observations for which Wilson's 95 % interval of an expected share is at most twice `half_width` wide."""
    from math import sqrt

    def wide(n: int) -> float:
        z2 = Z95 * Z95
        return 2 * Z95 * sqrt(share * (1 - share) / n + z2 / (4 * n * n)) / (1 + z2 / n)

    if not 0 <= share <= 1 or not 0 < half_width < 0.5:
        raise ValueError("a share from 0 to 1 and a half width between 0 and 0.5 are needed")
    low, high = 0, 1
    while wide(high) > 2 * half_width:
        low, high = high, high * 2
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (low, middle) if wide(middle) <= 2 * half_width else (middle, high)
    return high


def newcombe(x1: Column, n1: Column, x2: Column, n2: Column) -> Column:
    """Newcombe's 95 % interval of the difference of two shares, the first less the second; null if either n is 0."""
    a, b, p1, p2 = wilson(x1, n1), wilson(x2, n2), x1 / n1, x2 / n2
    low = p1 - p2 - F.sqrt(F.pow(p1 - a["lower"], F.lit(2)) + F.pow(b["upper"] - p2, F.lit(2)))
    high = p1 - p2 + F.sqrt(F.pow(a["upper"] - p1, F.lit(2)) + F.pow(p2 - b["lower"], F.lit(2)))
    return F.when((n1 > 0) & (n2 > 0), F.struct(low.alias("lower"), high.alias("upper")))


def absent_share(total: Column, without: Column, sample: Column) -> Column:
    """Hypergeometric chance that `sample` of `total` units miss all units but `without`: C(without, sample) / C(total, sample)."""
    log_share = log_factorial(without) - log_factorial(without - sample) - log_factorial(total) + log_factorial(total - sample)
    return F.when(sample > without, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.exp(log_share))))
