"""Statistics as column expressions: intervals, tests, calibration terms, divergences."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the two normal quantiles in use for 95 % intervals
Z95 = 1.96
Z95_EXACT = 1.95996398454
BINS = 10
CLIP = 1e-15


def rate(condition: Column) -> Column:
    """Share of rows where the condition holds, null conditions left out; null over no rows."""
    return F.avg(condition.cast("double"))


def share(part: Column, whole: Column) -> Column:
    """part / whole, null where the whole is 0."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def wilson(correct: Column, total: Column, z: float = Z95) -> Column:
    """Wilson score interval as struct(low, high); null for no trials."""
    n, p = total.cast("double"), share(correct, total)
    spread = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / spread
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / spread
    return F.when(total > 0, F.struct((centre - half).alias("low"), (centre + half).alias("high")))


def _log_factorial_rest(n: Column) -> Column:
    """log n! - (n log n - n + log(2 pi n) / 2): the rest of Stirling's formula, by its series from 16 on and from a short table below."""
    table = [0.0] + [math.lgamma(k + 1) - (k * math.log(k) - k + 0.5 * math.log(2 * math.pi * k)) for k in range(1, 16)]
    series = (1 / 12 - (1 / 360 - (1 / 1260 - 1 / (1680 * n * n)) / (n * n)) / (n * n)) / n
    return F.when(n < 16, F.get(F.array(*map(F.lit, table)), n.cast("int"))).otherwise(series)


def _binomial_half(k: Column, n: Column) -> Column:
    """Probability of ``k`` of ``n`` fair coins, 0 < k < n, from logarithms that do not cancel."""
    rest = n - k
    away = (k - rest) / n
    deviance = k * F.log1p(away) + rest * F.log1p(-away)
    return F.exp(_log_factorial_rest(n) - _log_factorial_rest(k) - _log_factorial_rest(rest) - deviance) * F.sqrt(n / (2 * math.pi * k * rest))


def mcnemar(left_only: Column, right_only: Column) -> Column:
    """Exact two-sided McNemar p value from the discordant counts; 1 where there are none.

    The binomial tail is summed downwards from its largest term.  Terms fall at least like exp(-j^2 / n), so those beyond 10 sqrt(n) + 60 add nothing
    that a double could hold, and a row needs that many steps at most, whatever the counts.
    """
    n, low = (left_only + right_only).cast("double"), F.least(left_only, right_only).cast("double")
    steps = F.least(low, F.ceil(10 * F.sqrt(n)) + 60).cast("int")
    first = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def step(acc: Column, j: Column) -> Column:
        term = acc["term"] * (low - j + 1) / (n - low + j)
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    js = F.when(steps > 0, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>"))
    tail = F.when(low == 0, F.pow(F.lit(0.5), n)).otherwise(_binomial_half(low, n) * F.aggregate(js, first, step)["total"])
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * tail))


def calibration_bin(p: Column, bins: int = BINS) -> Column:
    """Bin i where i / bins <= p < (i + 1) / bins, the last one closed; compared with the bounds themselves, as floor(p * bins) rounds wrongly just below one."""
    out = F.lit(0)
    for i in range(1, bins):
        out = out + F.when(p >= F.lit(i / bins), 1).otherwise(0)
    return out


def _log2(x: Column) -> Column:
    return F.when(x > 0, F.log2(x)).otherwise(0.0)


def entropy(p: Column) -> Column:
    """Entropy in bits of an array of probabilities; 0 log 0 is 0."""
    return -F.aggregate(p, F.lit(0.0), lambda acc, x: acc + x * _log2(x))


def total_variation(p: Column, q: Column) -> Column:
    return 0.5 * F.aggregate(F.zip_with(p, q, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda acc, x: acc + x)


def jensen_shannon(p: Column, q: Column) -> Column:
    """Jensen-Shannon divergence in bits of two arrays in the same order, kept within [0, 1]."""

    def term(x: Column, y: Column) -> Column:
        m = (x + y) / 2
        part = lambda v: F.when(v > 0, v * F.log2(v / m)).otherwise(0.0)
        return (part(x) + part(y)) / 2

    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.aggregate(F.zip_with(p, q, term), F.lit(0.0), lambda acc, x: acc + x)))


def normalise(p: Column) -> Column:
    """An array of weights divided by its sum; null if the sum is not positive."""
    total = F.aggregate(p, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(total > 0, F.transform(p, lambda x: x / total))


def argmax(p: Column) -> Column:
    """0-based place of the largest element; the first of equal ones."""
    best = F.array_max(F.transform(p, lambda x, i: F.struct(x.alias("p"), (-i).alias("i"))))
    return -best["i"]


def softmax(scores: Column) -> Column:
    top = F.array_max(scores)
    return normalise(F.transform(scores, lambda x: F.exp(x - top)))


def expected_score(p: Column) -> Column:
    """Sum of level times probability."""
    return F.aggregate(F.transform(p, lambda x, i: x * i), F.lit(0.0), lambda acc, x: acc + x)


def negative_log_likelihood(p_reference: Column) -> Column:
    return -F.log(F.greatest(p_reference, F.lit(CLIP)))


def multiclass_brier(p: Column, reference: Column) -> Column:
    """Sum of squared differences from the one-hot reference, whose 0-based place is given."""
    return F.aggregate(F.transform(p, lambda x, i: F.pow(x - F.when(i == reference, 1.0).otherwise(0.0), 2)), F.lit(0.0), lambda acc, x: acc + x)


def half_up_level(mean: Column, levels: int = 5) -> Column:
    """A mean rating from 1 as a 0-based level, halves rounded up."""
    return F.greatest(F.lit(0), F.least(F.lit(levels - 1), F.floor(mean + 0.5).cast("int") - 1))


def acceptance(segments: Column, draft: int) -> Column:
    """Per-position acceptance of speculative segments: share of segments longer than i, for i = 1..draft; null if any segment exceeds draft + 1."""
    n = F.size(segments).cast("double")
    rates = F.transform(F.sequence(F.lit(1), F.lit(draft)), lambda i: F.size(F.filter(segments, lambda s: s - 1 >= i)) / n)
    return F.when((n > 0) & ~F.exists(segments, lambda s: s > draft + 1), rates)


def ranks_to_auroc(rank_sum: Column, positives: Column, negatives: Column) -> Column:
    """AUROC from the sum of the positives' mean ranks; null if one class is absent."""
    return F.when((positives > 0) & (negatives > 0), (rank_sum - positives * (positives + 1) / 2) / (positives * negatives))
