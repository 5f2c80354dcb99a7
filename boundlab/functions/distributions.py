"""Distribution functions as column expressions: whole-stage code, no Python workers."""

from __future__ import annotations

import math
from collections.abc import Callable
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from boundlab.functions import arrays
from boundlab.functions.fixed import WEST_D, WEST_N

INF = float("inf")
Z90 = 1.6448536269514722


LOG_ROOT = math.log(2.506628274631)


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x computed once, however often f uses it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _horner(x: Column, terms) -> Column:
    out = F.lit(terms[0])
    for t in terms[1:]:
        out = out * x + t
    return out


def normal_cdf(x: Column) -> Column:
    def at(x):
        a = F.abs(x)
        near = F.exp(-a * a / 2) * _horner(a, WEST_N) / _horner(a, WEST_D)
        far = F.exp(-a * a / 2) / (a + 1 / (a + 2 / (a + 3 / (a + 4 / (a + 0.65))))) / 2.506628274631
        c = F.when(a > 37, 0.0).when(a < 7.07106781186547, near).otherwise(far)
        return F.when(x > 0, 1 - c).otherwise(c)

    return let(x, at)


def normal_log_cdf(x: Column) -> Column:
    """Log of the normal CDF; the far tail is taken in logs, so it is finite for every finite x."""

    def at(x):
        a = F.abs(x)
        near = F.log(F.exp(-a * a / 2) * _horner(a, WEST_N) / _horner(a, WEST_D))
        far = -a * a / 2 - F.log(a + 1 / (a + 2 / (a + 3 / (a + 4 / (a + 0.65))))) - LOG_ROOT
        tail = F.when(a == INF, -INF).when(a < 7.07106781186547, near).otherwise(far)
        return F.when(x > 0, F.log1p(-F.exp(tail))).otherwise(tail)

    return let(x, at)


def normal_logpdf(z: Column) -> Column:
    return -z * z / 2 - 0.5 * math.log(2 * math.pi)


def student_logpdf(z: Column, df: float = 4.0) -> Column:
    scale = math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - 0.5 * math.log(df * math.pi)
    return F.lit(scale) - (df + 1) / 2 * F.log1p(z * z / df)


def student4_log_cdf(z: Column) -> Column:
    """Log of Student's CDF with 4 degrees of freedom. With s = |z| / sqrt(4 + z^2) a tail is (1 - s)^2 (2 + s) / 4; 1 - s is formed without cancelling."""

    def at(z):
        a, r = F.abs(z), F.sqrt(4 + z * z)
        tail = 2 * F.log(4 / (r * (r + a))) + F.log(2 + a / r) - math.log(4)
        tail = F.when(a == INF, -INF).otherwise(tail)
        return F.when(z > 0, F.log1p(-F.exp(tail))).otherwise(tail)

    return let(z, at)


def student4_cdf(z: Column) -> Column:
    return F.exp(student4_log_cdf(z))


def _log_beta_ratio(a: float, b: float, x: Column) -> Column:
    """Log of the regularised incomplete beta function for x up to (a + 1) / (a + b + 2): its continued fraction, folded from the far end over constant coefficients."""
    depth = 48 + int(4 * math.sqrt(max(a, b)))
    terms = []
    for m in range(depth):
        terms.append(-(a + m) * (a + b + m) / ((a + 2 * m) * (a + 2 * m + 1)))
        terms.append((m + 1) * (b - m - 1) / ((a + 2 * m + 1) * (a + 2 * m + 2)))
    fraction = F.aggregate(F.lit(terms[::-1]), F.lit(1.0), lambda f, c: 1 + c * x / f)
    return a * F.log(x) + b * F.log1p(-x) - math.log(a) - (math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)) - F.log(fraction)


def student_log_cdf(z: Column, df: float = 4.0) -> Column:
    """Log of Student's CDF: closed form for 4 degrees of freedom, the incomplete beta function for others, in log space down the lower tail."""
    if df == 4.0:
        return student4_log_cdf(z)

    def at(z):
        t2 = F.least(z * z, F.lit(1e300))
        w = df / (df + t2)
        far = _log_beta_ratio(df / 2, 0.5, w)
        near = F.when(t2 == 0, 0.0).otherwise(F.log1p(-F.exp(_log_beta_ratio(0.5, df / 2, t2 / (df + t2)))))
        tail = F.when(F.abs(z) == INF, -INF).otherwise(F.when(w <= (df / 2 + 1) / (df / 2 + 2.5), far).otherwise(near) - math.log(2))
        return F.when(z > 0, F.log1p(-F.exp(tail))).otherwise(tail)

    return let(z, at)


class LatentDistribution:
    """The family of the predictions: 'gaussian' (or 'normal'), or 'student_t' with df degrees of freedom."""

    def __init__(self, dist: str = "gaussian", df: float = 4.0):
        if dist not in ("gaussian", "normal", "student_t"):
            raise ValueError(f"unknown distribution {dist}")
        self.normal, self.df = dist != "student_t", df

    def log_cdf(self, z: Column) -> Column:
        return normal_log_cdf(z) if self.normal else student_log_cdf(z, self.df)

    def cdf(self, z: Column) -> Column:
        return normal_cdf(z) if self.normal else F.exp(student_log_cdf(z, self.df))

    def logpdf(self, z: Column) -> Column:
        return normal_logpdf(z) if self.normal else student_logpdf(z, self.df)

    def array_cdf(self, z: np.ndarray) -> np.ndarray:
        return arrays.ndtr(z) if self.normal else np.exp(arrays.log_stdtr(z, self.df))

    def ppf(self, q: float) -> float:
        if self.normal:
            return NormalDist().inv_cdf(q)
        if q == 0.5:
            return 0.0
        high = 1.0
        while self.array_cdf(np.array([high]))[0] < max(q, 1 - q):
            high *= 2
        at = arrays.quantile(self.array_cdf, max(q, 1 - q), np.zeros(1), np.array([high]))[0]
        return float(at if q > 0.5 else -at)


GAUSSIAN = LatentDistribution()


def log1mexp(x: Column) -> Column:
    """log(1 - e^x) for x < 0, stable at both ends."""
    return let(F.least(x, F.lit(-1e-10)), lambda x: F.when(x < -math.log(2), F.log1p(-F.exp(x))).otherwise(F.log(-F.expm1(x))))


def interval_log_probability(mu: Column, sigma: Column, lower: Column, upper: Column, exact: Column, dist: LatentDistribution = GAUSSIAN) -> Column:
    """log P(lower <= Y <= upper), finite far out; of an exact row the log density at its value.

    Two-sided intervals take the difference on the side of the nearer tail;
    narrow ones (under a thousandth of sigma) the density at their middle.
    """
    z = F.struct(((lower - mu) / F.greatest(sigma, F.lit(1e-6))).alias("l"), ((upper - mu) / F.greatest(sigma, F.lit(1e-6))).alias("u"), F.greatest(sigma, F.lit(1e-6)).alias("s"))

    def at(z):
        low, high = z["l"], z["u"]
        # the larger and the smaller of the two tails on the chosen side
        more = F.when(upper == INF, -low).when(lower == -INF, high).when(low > 0, -low).otherwise(high)
        less = F.when((upper == INF) | (lower == -INF), -INF).when(low > 0, -high).otherwise(low)
        ends = F.transform(F.array(more, less), dist.log_cdf)
        both = let(ends, lambda e: F.when(F.get(e, F.lit(1)) == -INF, F.get(e, F.lit(0))).otherwise(F.get(e, F.lit(0)) + log1mexp(F.get(e, F.lit(1)) - F.get(e, F.lit(0)))))
        narrow = (upper < INF) & (lower > -INF) & (high - low < 1e-3)
        density = dist.logpdf((low + high) / 2) + F.log(F.greatest(high - low, F.lit(1e-300)))
        return F.when(exact, dist.logpdf(high) - F.log(z["s"])).when(narrow, density).otherwise(F.least(both, F.lit(0.0)))

    return let(z, at)


def interval_probability(mu: Column, sigma: Column, lower: Column, upper: Column, exact: Column, dist: LatentDistribution = GAUSSIAN) -> Column:
    """P(lower <= Y <= upper); 1 for exact rows."""
    return F.when(exact, 1.0).otherwise(F.exp(F.least(interval_log_probability(mu, sigma, lower, upper, F.lit(False), dist), F.lit(0.0))))


def exact_nll(y: Column, mu: Column, sigma: Column, logpdf=normal_logpdf) -> Column:
    s = F.greatest(sigma, F.lit(1e-6))
    return -logpdf((y - mu) / s) + F.log(s)


def tobit_nll(mu: Column, sigma: Column, lower: Column, upper: Column, exact: Column, dist: LatentDistribution = GAUSSIAN) -> Column:
    """Minus the log density of exact rows, minus the log probability of the others' intervals."""
    return -interval_log_probability(mu, sigma, lower, upper, exact, dist)


def deficit(q: Column, tau: float) -> Column:
    return F.pow(F.greatest(F.lit(tau) - q, F.lit(0.0)), 2)


def hinge(mu: Column, lower: Column, upper: Column) -> Column:
    """Distance from the interval; open sides can't be missed."""
    below = F.when(lower == -INF, 0.0).otherwise(F.greatest(lower - mu, F.lit(0.0)))
    above = F.when(upper == INF, 0.0).otherwise(F.greatest(mu - upper, F.lit(0.0)))
    return below + above


def exceedance(components: Column, threshold: Column | float) -> Column:
    """Mean over an array of struct<mu, sigma> of P(Y > threshold)."""
    tail = F.transform(components, lambda c: normal_cdf(-((F.lit(threshold) if isinstance(threshold, float) else threshold) - c["mu"]) / F.greatest(c["sigma"], F.lit(1e-6))))
    return F.aggregate(tail, F.lit(0.0), lambda a, x: a + x) / F.size(components)


def predictive_quantile(components: Column, q: float, dist: LatentDistribution = GAUSSIAN) -> Column:
    """The q quantile of an equal-weight mixture, an array of struct<mu, sigma>: closed form for one component, bisection in an Arrow UDF for more.

    The quantile lies between the least and the greatest of the components'
    own, which is where the search starts. The same search as nested `aggregate`
    calls is interpreted row by row and takes tens of times as long. An empty or
    null array gives null.
    """
    z = dist.ppf(q)

    @F.pandas_udf("double")
    def solve(mu: pd.Series, sigma: pd.Series) -> pd.Series:
        out = np.full(len(mu), np.nan)
        size = np.array([0 if m is None else len(m) for m in mu])
        for n in np.unique(size[size > 0]):
            rows = np.flatnonzero(size == n)
            m, s = (np.stack(x.to_numpy()[rows]).astype(float) for x in (mu, sigma))
            s = np.maximum(s, 1e-6)
            own = m + z * s
            out[rows] = arrays.quantile(lambda x: dist.array_cdf((x[:, None] - m) / s).mean(axis=1), q, own.min(axis=1), own.max(axis=1), steps=60)  # noqa: B023
        return pd.Series(out)

    one = F.get(components, F.lit(0))
    return F.when(F.size(components) == 1, one["mu"] + z * F.greatest(one["sigma"], F.lit(1e-6))).otherwise(F.nanvl(solve(F.transform(components, lambda c: c["mu"]), F.transform(components, lambda c: c["sigma"])), F.lit(None).cast("double")))


def mixture_moments(components: Column) -> tuple[Column, Column]:
    """Mean and total standard deviation of an equal-weight mixture."""
    mean = lambda f: F.aggregate(F.transform(components, f), F.lit(0.0), lambda a, x: a + x) / F.size(components)
    mu = mean(lambda c: c["mu"])
    square = mean(lambda c: c["mu"] * c["mu"] + c["sigma"] * c["sigma"])
    return mu, F.sqrt(F.greatest(square - mu * mu, F.lit(0.0)))


def p_to_conc(p: Column) -> Column:
    return F.pow(F.lit(10.0), 9 - p)


def conc_to_p(conc: Column) -> Column:
    return 9 - F.log10(F.greatest(conc, F.lit(1e-30)))


def conc_bounds(lower: Column, upper: Column, floor: float = 1e-6, ceil: float = 1e15) -> tuple[Column, Column]:
    """Bounds on the p scale flip when they become concentrations."""
    clip = lambda c: F.least(F.greatest(c, F.lit(floor)), F.lit(ceil))
    low = F.when(upper == INF, floor).otherwise(clip(p_to_conc(upper)))
    high = F.when(lower == -INF, INF).otherwise(clip(p_to_conc(lower)))
    return low, high


def _tail_sql(x: str, log: bool) -> str:
    def horner(terms):
        out = f"{terms[0]!r}::DOUBLE"
        for t in terms[1:]:
            out = f"({out} * abs({x}) + {t!r}::DOUBLE)"
        return out

    a = f"abs({x})"
    near = f"exp(-{a} * {a} / 2) * {horner(WEST_N)} / {horner(WEST_D)}"
    part = f"({a} + 1 / ({a} + 2 / ({a} + 3 / ({a} + 4 / ({a} + 0.65)))))"
    if log:
        return f"CASE WHEN isinf({x}) THEN '-inf'::DOUBLE WHEN {a} < 7.07106781186547 THEN ln({near}) ELSE -{a} * {a} / 2 - ln({part}) - {LOG_ROOT!r}::DOUBLE END"
    return f"CASE WHEN {a} > 37 THEN 0.0 WHEN {a} < 7.07106781186547 THEN {near} ELSE exp(-{a} * {a} / 2) / {part} / 2.506628274631 END"


def normal_cdf_sql(x: str) -> str:
    """The same rational form as DuckDB text."""
    c = _tail_sql(x, False)
    return f"(CASE WHEN {x} > 0 THEN 1 - ({c}) ELSE ({c}) END)"


def normal_log_cdf_sql(x: str) -> str:
    c = _tail_sql(x, True)
    return f"(CASE WHEN {x} > 0 THEN ln(1 - exp({c})) ELSE ({c}) END)"
