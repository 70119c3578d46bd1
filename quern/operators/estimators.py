"""Unbiased estimators over samples and their central-limit confidence intervals, as aggregate columns.

With X = x / p for each accepted draw and zeros for draws that a residual predicate or another group took, the estimate
is the mean of X over the n draws; half the width of its interval is z * sqrt(S / (n (n - 1))), S the sum of squared
deviations. Samples without draws (n = 1, Bernoulli) have estimates but no interval.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sampling import N, P

# Coefficients of the double-precision polynomials in M. Giles, "Approximating
# the erfinv function" (GPU Computing Gems, 2011), highest power first, for w < 6.25, w < 16 and above.
CENTRAL = (
    -3.6444120640178196996e-21, -1.685059138182016589e-19, 1.2858480715256400167e-18, 1.115787767802518096e-17, -1.333171662854620906e-16, 2.0972767875968561637e-17,
    6.6376381343583238325e-15, -4.0545662729752068639e-14, -8.1519341976054721522e-14, 2.6335093153082322977e-12, -1.2975133253453532498e-11, -5.4154120542946279317e-11,
    1.051212273321532285e-09, -4.1126339803469836976e-09, -2.9070369957882005086e-08, 4.2347877827932403518e-07, -1.3654692000834678645e-06, -1.3882523362786468719e-05,
    0.0001867342080340571352, -0.00074070253416626697512, -0.0060336708714301490533, 0.24015818242558961693, 1.6536545626831027356,
)
MIDDLE = (
    2.2137376921775787049e-09, 9.0756561938885390979e-08, -2.7517406297064545428e-07, 1.8239629214389227755e-08, 1.5027403968909827627e-06, -4.013867526981545969e-06,
    2.9234449089955446044e-06, 1.2475304481671778723e-05, -4.7318229009055733981e-05, 6.8284851459573175448e-05, 2.4031110387097893999e-05, -0.0003550375203628474796,
    0.00095328937973738049703, -0.0016882755560235047313, 0.0024914420961078508066, -0.0037512085075692412107, 0.005370914553590063617, 1.0052589676941592334, 3.0838856104922207635,
)
TAIL = (
    -2.7109920616438573243e-11, -2.5556418169965252055e-10, 1.5076572693500548083e-09, -3.7894654401267369937e-09, 7.6157012080783393804e-09, -1.4960026627149240478e-08,
    2.9147953450901080826e-08, -6.7711997758452339498e-08, 2.2900482228026654717e-07, -9.9298272942317002539e-07, 4.5260625972231537039e-06, -1.9681778105531670567e-05,
    7.5995277030017761139e-05, -0.00021503011930044477347, -0.00013871931833623122026, 1.0103004648645343977, 4.8499064014085844221,
)


def erf_inv(y: Column) -> Column:
    """The inverse error function; infinite at -1 and 1, null outside and for null."""
    w = -F.log((F.lit(1.0) - y) * (F.lit(1.0) + y))
    inner = F.when(w < 6.25, _horner(CENTRAL, w - 3.125)).when(w < 16, _horner(MIDDLE, F.sqrt(w) - 3.25)).otherwise(_horner(TAIL, F.sqrt(w) - 5.0))
    return F.when(F.abs(y) < 1, inner * y).when(F.abs(y) == 1, y * F.lit(float("inf")))


def _horner(coefficients: tuple[float, ...], x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def erf_inv_value(y: float) -> float:
    """The same on the driver, from the normal quantile."""
    if not -1 < y < 1:
        return math.copysign(math.inf, y) if abs(y) == 1 else math.nan
    return math.copysign(NormalDist().inv_cdf((1 - abs(y)) / 2) / math.sqrt(2), y)  # from the tail, where digits are


def sample_prob() -> Column:
    return F.col(P)


def inv_sample_prob() -> Column:
    return F.lit(1.0) / F.col(P)


def require_sample(df: DataFrame) -> DataFrame:
    """Estimators mean nothing on a table that isn't a sample."""
    if P not in df.columns or N not in df.columns:
        raise ValueError("approximate aggregates need a sampled table: TABLESAMPLE is missing")
    return df


def _value(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def approx_sum(x: Column | str) -> Column:
    """Estimate of the sum of x; null without accepted draws."""
    return F.sum(_value(x).cast("double") / F.col(P)) / F.max(N)


def approx_count(x: Column | str | None = None) -> Column:
    """Estimate of the number of rows, or of non-null x; 0 without accepted draws."""
    one = F.lit(1.0) if x is None else F.when(_value(x).isNotNull(), 1.0)
    return F.coalesce(F.sum(one / F.col(P)) / F.max(N), F.lit(0.0))


def approx_avg(x: Column | str) -> Column:
    """Ratio of the two estimates."""
    return approx_sum(x) / F.sum(F.when(_value(x).isNotNull(), F.lit(1.0) / F.col(P))) * F.max(N)


def accumulate(x: Column | str) -> Column:
    """[count, sum, sum of squared deviations] of x."""
    v = _value(x).cast("double")
    n = F.count(v)
    return F.array(n.cast("double"), F.coalesce(F.sum(v), F.lit(0.0)), F.coalesce(F.var_pop(v) * n, F.lit(0.0)))


def clt_half_ci(state: Column, confidence: float | Column, draws: Column) -> Column:
    """Half the interval's width from [count, sum, deviations] and the number of draws; null for one draw or none.

    Draws that were not accepted are zeros: they add count * (draws - count) / draws * mean squared to the deviations.
    """
    n, s, d = state[0], state[1], state[2]
    spread = F.when(n == 0, F.lit(0.0)).when(draws - n <= 0, d).otherwise(d + n * (draws - n) / draws * (s / n) * (s / n))
    z = F.lit(erf_inv_value(confidence)) if isinstance(confidence, (int, float)) else erf_inv(confidence)
    return F.when(draws > 1, z * F.sqrt(F.lit(2.0) * spread / (draws * (draws - F.lit(1.0)))))


def approx_sum_half_ci(x: Column | str, confidence: float) -> Column:
    return clt_half_ci(accumulate(_value(x).cast("double") / F.col(P)), confidence, F.max(N))


def approx_count_star_half_ci(confidence: float) -> Column:
    return clt_half_ci(accumulate(F.lit(1.0) / F.col(P)), confidence, F.max(N))


def approx_count_half_ci(x: Column | str, confidence: float) -> Column:
    return clt_half_ci(accumulate(F.when(_value(x).isNotNull(), F.lit(1.0) / F.col(P))), confidence, F.max(N))


def relative_error(exact: DataFrame, approximate: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """|approximate - exact| / exact * 100 of each column and group; groups are matched by key, and a group that only one
    side has counts as 0 on the other. An exact 0 gives null unless the estimate is 0 too."""
    e = exact.select(*keys, *[F.col(c).cast("double").alias(f"e_{c}") for c in columns])
    a = approximate.select(*keys, *[F.col(c).cast("double").alias(f"a_{c}") for c in columns])
    both = e.join(a, keys, "full") if keys else e.crossJoin(a)

    def error(c: str) -> Column:
        x, y = F.coalesce(f"e_{c}", F.lit(0.0)), F.coalesce(f"a_{c}", F.lit(0.0))
        return F.when((x == 0) & (y == 0), 0.0).when(x != 0, F.abs(y - x) / F.abs(x) * 100)

    return both.select(*keys, *[error(c).alias(f"err_{c}") for c in columns])
