"""Statistics as column expressions: tails, closed-form tests, policies for missing values."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def na(x: Column, policy: str, mean: Column | None = None) -> Column:
    """A missing value (null or NaN) by policy: ``drop`` leaves null, ``mean`` and ``zero`` fill."""
    clean = F.nanvl(x, F.lit(None).cast("double"))
    return {"drop": clean, "mean": F.coalesce(clean, mean) if mean is not None else clean, "zero": F.coalesce(clean, F.lit(0.0))}[policy]


def risk_class(p: Column, low: float = 0.1, high: float = 0.5) -> Column:
    """clean below ``low``, contam above ``high``, mid between; null for missing."""
    clean = F.nanvl(p, F.lit(None).cast("double"))
    return F.when(clean < low, "clean").when(clean > high, "contam").when(clean.isNotNull(), "mid")


def two_sided(p: Column) -> Column:
    return F.least(2 * F.least(p, 1 - p), F.lit(1.0))


def phi(z: Column) -> Column:
    """The normal distribution function, by Abramowitz and Stegun 7.1.26 (absolute error 1.5e-7)."""
    x = F.abs(z) / F.lit(math.sqrt(2))
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    erf = 1 - poly * F.exp(-x * x)
    return F.when(z >= 0, 0.5 * (1 + erf)).otherwise(0.5 * (1 - erf))


#: The same in SQL, for a named column.
PHI_SQL = (
    "(CASE WHEN {z} >= 0 THEN 0.5 * (1 + {e}) ELSE 0.5 * (1 - {e}) END)".replace(
        "{e}",
        "(1 - (1/(1+0.3275911*abs({z})/sqrt(2.0::DOUBLE))) * (0.254829592 + (1/(1+0.3275911*abs({z})/sqrt(2.0::DOUBLE))) * (-0.284496736 + (1/(1+0.3275911*abs({z})/sqrt(2.0::DOUBLE)))"
        " * (1.421413741 + (1/(1+0.3275911*abs({z})/sqrt(2.0::DOUBLE))) * (-1.453152027 + (1/(1+0.3275911*abs({z})/sqrt(2.0::DOUBLE))) * 1.061405429)))) * exp(-({z})*({z})/2))",
    )
)


def student_t_tail(t: Column, df: Column, points: int = 32) -> Column:
    """Two-sided tail of Student's t for any real df: with t = sqrt(df) tan(a), a ratio of integrals of cos(a)**(df-1),
    each by Gauss-Legendre (error below 1e-9 from one degree of freedom on), on Arrow batches; null for null."""
    x, w = np.polynomial.legendre.leggauss(points)
    u = (x + 1) / 2
    # the points are squared, so close to the far end that the integrand is smooth there
    nodes = list(zip(u * u, u * w, strict=True))

    @F.pandas_udf("double")
    def tail(t: pd.Series, df: pd.Series) -> pd.Series:
        def integral(lo: np.ndarray, hi: np.ndarray, power: np.ndarray) -> np.ndarray:
            return (hi - lo) * sum(w * np.maximum(np.cos(hi - (hi - lo) * u), 0) ** power for u, w in nodes)

        with np.errstate(all="ignore"):
            v, at = np.unique(df.to_numpy(float), return_inverse=True)
            # cos(a)**(df-1) falls below exp(-40) this far from its peak, or from where it is looked at
            wide = np.minimum(np.pi / 2, 9 / np.sqrt(v))
            whole = integral(np.zeros(len(v)), wide, v - 1)
            top = np.arctan(np.abs(t.to_numpy(float)) / np.sqrt(v[at]))
            return pd.Series(integral(top, np.minimum(np.pi / 2, top + wide[at]), v[at] - 1 if len(v) > 1 else v - 1) / whole[at])

    return tail(t.cast("double"), df.cast("double"))


def log_choose(n: Column, k: Column) -> Column:
    """ln of n over k, as a sum of k logarithms."""
    return F.aggregate(F.when(k > 0, F.sequence(F.lit(1).cast("long"), k.cast("long"))).otherwise(F.array().cast("array<bigint>")), F.lit(0.0), lambda a, i: a + F.log((n - k + i) / i))


def binomial_tail(wins: Column, n: Column) -> Column:
    """P(X >= wins) of n fair coins."""
    terms = F.when(wins <= n, F.sequence(wins.cast("long"), n.cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(terms, F.lit(0.0), lambda a, k: a + F.exp(log_choose(n.cast("long"), k) - n * math.log(2)))


def hypergeom_cdf(k: Column, total: Column, good: Column, draws: Column) -> Column:
    """P(X <= k) when ``draws`` of ``total`` are drawn and ``good`` of them count.

    The sum starts at k (or k + 1) and runs away from the mean by the terms' ratio, so that it begins with its greatest
    term and none underflows before it matters: down if k lies below the mean, else up, for the other side. It ends 12
    deviations (of a binomial number, which has wider ones) beyond that; what lies further is less than 1e-30.
    """
    first, last = F.greatest(F.lit(0).cast("long"), draws + good - total), F.least(good, draws)
    mean = draws.cast("double") * good / total
    low = k < mean
    start = F.when(low, k).otherwise(k + 1).cast("long")
    wide = F.ceil(12 * F.sqrt(F.least(mean, draws - mean)) + 12).cast("long")
    steps = F.least(wide, F.when(low, start - first).otherwise(last - start))
    term = F.exp(log_choose(good, start) + log_choose(total - good, draws - start) - log_choose(total, draws))

    def step(acc: Column, i: Column) -> Column:
        down, up = start - i, start + i
        ratio = F.when(low, (down + 1) * (total - good - draws + down + 1) / ((good - down) * (draws - down)).cast("double"))
        ratio = ratio.otherwise((good - up + 1) * (draws - up + 1) / (up * (total - good - draws + up)).cast("double"))
        nxt = acc["p"] * ratio
        return F.struct(nxt.alias("p"), (acc["s"] + nxt).alias("s"))

    more = F.when(steps > 0, F.sequence(F.lit(1).cast("long"), steps)).otherwise(F.array().cast("array<bigint>"))
    side = F.least(F.aggregate(more, F.struct(term.alias("p"), term.alias("s")), step)["s"], F.lit(1.0))
    return F.when(k < first, 0.0).when(k >= last, 1.0).otherwise(F.when(low, side).otherwise(1 - side))


def binomial_draw(n: Column, k: Column, uniforms: Column) -> Column:
    """Binomial(n, k / n) numbers from an array of uniforms, by inversion: how many values of the distribution function
    lie below each. The function is tabled from 12 deviations below the mean to 12 above (beyond lies less than 1e-30)."""
    m, p = k.cast("double"), k / n
    wide = F.ceil(12 * F.sqrt(m * (1 - p)) + 12)
    lo, hi = F.greatest(F.lit(0.0), F.floor(m - wide)).cast("long"), F.least(n.cast("double"), F.ceil(m + wide)).cast("long")
    start = F.exp(log_choose(n, lo) + lo * F.log(p) + (n - lo) * F.log(1 - p))

    def step(acc: Column, x: Column) -> Column:
        nxt = acc["p"] * (n - x) / (x + 1) * p / (1 - p)
        return F.struct(nxt.alias("p"), F.concat(acc["out"], F.array(F.element_at(acc["out"], -1) + nxt)).alias("out"))

    table = F.aggregate(F.when(hi > lo, F.sequence(lo, hi - 1)).otherwise(F.array().cast("array<bigint>")), F.struct(start.alias("p"), F.array(start).alias("out")), step)["out"]

    def place(u: Column, cdf: Column) -> Column:
        """How many entries of the sorted ``cdf`` lie below u, by halving."""
        def halve(acc: Column, _: Column) -> Column:
            mid = F.shiftright(acc["lo"] + acc["hi"], 1)
            below = F.get(cdf, mid) < u
            going = acc["lo"] < acc["hi"]
            return F.struct(F.when(going & below, mid + 1).otherwise(acc["lo"]).alias("lo"), F.when(going & ~below, mid).otherwise(acc["hi"]).alias("hi"))

        return F.aggregate(F.sequence(F.lit(1), F.ceil(F.log2(F.size(cdf) + 1)).cast("int") + 1), F.struct(F.lit(0).alias("lo"), F.size(cdf).alias("hi")), halve)["lo"]

    drawn = F.transform(F.array(table), lambda cdf: F.transform(uniforms, lambda u: lo + place(u, cdf)))[0]
    return F.when((k > 0) & (k < n), drawn).otherwise(F.transform(uniforms, lambda u: k.cast("long")))


def mde(p: Column, n1: Column, n2: Column, z_alpha: float = 1.6448536, z_power: float = 0.8416212) -> Column:
    """The least gap that is found with the wanted power; null at rates of 0 and 1, where the formula has no meaning."""
    return F.when((p > 0) & (p < 1), (z_alpha + z_power) * F.sqrt(p * (1 - p) * (1 / n1 + 1 / n2)))
