"""Scalar column expressions: safe division, clipping, distribution functions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def num(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x) if isinstance(x, (int, float)) else F.col(x)


def sdiv(a, b) -> Column:
    """a / b with 0 denominators giving NULL."""
    return num(a).cast("double") / F.nullif(num(b).cast("double"), F.lit(0.0))


def packed_order(*parts: tuple) -> Column:
    """One decimal that sorts like the tuple of non-negative integers ``(column, digits), ...``.

    An ordering key of a fixed-width type lets arg-min and arg-max run in a hash aggregate; a
    struct key would sort the whole input. Too many digits raise an error, they never wrap.
    """
    width = 0
    acc = None
    for c, digits in parts:
        v = num(c).cast(f"decimal({digits},0)")
        width += digits
        acc = v if acc is None else (acc * F.lit(str(10 ** digits)).cast(f"decimal({digits + 1},0)") + v).cast(f"decimal({width},0)")
    if width > 38:
        raise ValueError("ordering key is limited to 38 digits")
    return acc


def clip(x, lo=None, hi=None) -> Column:
    """Bound x, keeping NULL as NULL."""
    out = num(x)
    bounded = out
    if lo is not None:
        bounded = F.greatest(bounded, num(lo))
    if hi is not None:
        bounded = F.least(bounded, num(hi))
    return F.when(out.isNotNull(), bounded)


def finite(x) -> Column:
    """NaN and infinities become NULL."""
    c = num(x).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def truth(cond: Column) -> Column:
    """Comparison with a missing value is false."""
    return F.coalesce(cond, F.lit(False))


def flag(cond: Column) -> Column:
    return truth(cond).cast("int")


def logistic(x) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-num(x)))


def logit(p, eps: float = 0.001) -> Column:
    q = clip(p, eps, 1 - eps)
    return F.log(q / (F.lit(1.0) - q))


def bind(x, body) -> Column:
    """Evaluate x once and use it many times in ``body``; keeps expression trees small."""
    return F.element_at(F.transform(F.array(num(x)), body), 1)


def erf(x) -> Column:
    """Error function by the published rational form 7.1.26 of Abramowitz and Stegun;
    absolute error below 1.5e-7."""
    def poly(t):
        return t * (F.lit(0.254829592) + t * (F.lit(-0.284496736) + t * (
            F.lit(1.421413741) + t * (F.lit(-1.453152027) + t * F.lit(1.061405429)))))

    return bind(x, lambda v: F.signum(v) * (F.lit(1.0) - F.exp(-v * v) * bind(
        F.lit(1.0) / (F.lit(1.0) + F.lit(0.3275911) * F.abs(v)), poly)))


def normal_cdf(x) -> Column:
    return F.lit(0.5) * (F.lit(1.0) + erf(num(x) / F.lit(math.sqrt(2.0))))


def prob_above(threshold, mean, sd) -> Column:
    """P(X > threshold) for a normal; a zero or missing spread gives a 0/1 answer on the mean."""
    m, s, th = num(mean), num(sd), num(threshold)
    return F.when(s.isNull() | (s <= 0), (m > th).cast("double")).otherwise(
        F.lit(1.0) - normal_cdf((th - m) / s))


# Published coefficients of the rational approximation of the normal quantile.
_INV_A = [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02,
          1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00]
_INV_B = [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02,
          6.680131188771972e01, -1.328068155288572e01]
_INV_C = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00,
          -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00]
_INV_D = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00,
          3.754408661907416e00]


def _horner(coefs: list[float], x: Column) -> Column:
    out = F.lit(coefs[0])
    for c in coefs[1:]:
        out = out * x + F.lit(c)
    return out


def normal_quantile(p) -> Column:
    """Inverse normal CDF (relative error about 1e-9), NULL outside (0, 1)."""
    p = num(p)
    q_low = F.sqrt(F.lit(-2.0) * F.log(F.when((p > 0) & (p < 1), p)))
    q_high = F.sqrt(F.lit(-2.0) * F.log(F.when((p > 0) & (p < 1), F.lit(1.0) - p)))
    q = p - F.lit(0.5)
    r = q * q
    low = _horner(_INV_C, q_low) / (_horner(_INV_D, q_low) * q_low + F.lit(1.0))
    high = -_horner(_INV_C, q_high) / (_horner(_INV_D, q_high) * q_high + F.lit(1.0))
    mid = _horner(_INV_A, r) * q / (_horner(_INV_B, r) * r + F.lit(1.0))
    return (F.when((p <= 0) | (p >= 1) | p.isNull(), F.lit(None).cast("double"))
            .when(p < 0.02425, low).when(p > 1 - 0.02425, high).otherwise(mid))


# Lanczos coefficients for g = 7.
_LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
            12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def log_gamma(x) -> Column:
    """Logarithm of the gamma function for x >= 1/2, to about 1e-14."""
    z = num(x) - F.lit(1.0)
    total = F.lit(_LANCZOS[0])
    for i, c in enumerate(_LANCZOS[1:], 1):
        total = total + F.lit(c) / (z + F.lit(float(i)))
    t = z + F.lit(7.5)
    return F.lit(0.5 * math.log(2 * math.pi)) + (z + F.lit(0.5)) * F.log(t) - t + F.log(total)


def _beta_fraction(a: Column, b: Column, x: Column, steps: int = 200) -> Column:
    """Continued fraction of the incomplete beta function by the modified Lentz method."""
    tiny = F.lit(1e-300)
    safe = lambda v: F.when(F.abs(v) < tiny, tiny).otherwise(v)
    d0 = F.lit(1.0) / safe(F.lit(1.0) - (a + b) * x / (a + F.lit(1.0)))

    def step(state: Column, i: Column) -> Column:
        m = i.cast("double")
        even = m * (b - m) * x / ((a + m * 2 - 1) * (a + m * 2))
        odd = -(a + m) * (a + b + m) * x / ((a + m * 2) * (a + m * 2 + 1))
        c, d, h = state["c"], state["d"], state["h"]
        return F.element_at(F.transform(F.array(F.struct(
            (F.lit(1.0) / safe(F.lit(1.0) + even * d)).alias("d"), safe(F.lit(1.0) + even / c).alias("c"))), lambda one: F.element_at(F.transform(
                F.array(F.struct((F.lit(1.0) / safe(F.lit(1.0) + odd * one["d"])).alias("d"), safe(F.lit(1.0) + odd / one["c"]).alias("c"))),
                lambda two: F.struct(two["c"].alias("c"), two["d"].alias("d"), (h * one["d"] * one["c"] * two["d"] * two["c"]).alias("h"))), 1)), 1)

    start = F.struct(F.lit(1.0).alias("c"), d0.alias("d"), d0.alias("h"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda s: s["h"])


def student_t_tail(t, df) -> Column:
    """P(T > |t|) = I(v / (v + t^2); v/2, 1/2) / 2, exact to rounding for df >= 1."""
    t, v = num(t).cast("double"), num(df).cast("double")

    def tail(r: Column) -> Column:
        a, x = r["a"], r["x"]
        b = F.lit(0.5)
        front = F.exp(log_gamma(a + b) - log_gamma(a) - F.lit(0.5 * math.log(math.pi)) + a * F.log(x) + b * F.log(F.lit(1.0) - x))
        near = front * _beta_fraction(a, b, x) / a
        far = F.lit(1.0) - front * _beta_fraction(b, a, F.lit(1.0) - x) / b
        return (F.when(x >= 1.0, F.lit(0.5)).when(x <= 0.0, F.lit(0.0))
                .when(x < (a + 1.0) / (a + 2.5), near / 2).otherwise(far / 2))

    return bind(F.struct((v / 2).alias("a"), (v / (v + t * t)).alias("x")), tail)


def moment_skew(n, s1, s2, s3) -> Column:
    """Bias-corrected skewness from power sums; NULL for n < 3 or no spread."""
    n, s1, s2, s3 = (num(c).cast("double") for c in (n, s1, s2, s3))
    m = s1 / n
    m2 = s2 / n - m * m
    m3 = s3 / n - F.lit(3.0) * m * s2 / n + F.lit(2.0) * m * m * m
    g1 = m3 / F.nullif(F.pow(F.greatest(m2, F.lit(0.0)), 1.5), F.lit(0.0))
    return F.when(n > 2, F.sqrt(n * (n - 1)) / (n - 2) * g1)
