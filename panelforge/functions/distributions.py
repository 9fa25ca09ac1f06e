"""Normal and Student-t tails, which neither Spark SQL nor the installed libraries have."""


import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def norm_sf(x: float) -> float:
    return 0.5 * math.erfc(x / math.sqrt(2))


def norm_ppf(p: float) -> float:
    """By bisection on the tail; a few dozen halvings reach double precision."""
    if not 0 < p < 1:
        raise ValueError("p is in (0, 1)")
    lo, hi = -40.0, 40.0
    for _ in range(200):
        mid = (lo + hi) / 2
        if norm_sf(mid) > 1 - p:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction (modified Lentz)."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    f = c = 1.0
    d = 0.0
    for i in range(500):
        m = i // 2
        if i == 0:
            term = 1.0
        elif i % 2 == 0:
            term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            term = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / ((1 + term * d) or tiny)
        c = (1 + term / c) or tiny
        f *= c * d
        if i and abs(1 - c * d) < 1e-15:
            break
    return front * (f - 1)


def t_sf(t: float, df: float) -> float:
    half = 0.5 * incomplete_beta(df / 2, 0.5, df / (df + t * t))
    return half if t >= 0 else 1 - half


def tail_p(upper: float, alternative: str) -> float:
    """From the upper tail to the p value of an alternative."""
    if alternative == "greater":
        return upper
    if alternative == "less":
        return 1 - upper
    if alternative == "two-sided":
        return min(1.0, 2 * min(upper, 1 - upper))
    raise ValueError(f"unknown alternative {alternative!r}")


#: Cody's rational Chebyshev approximations of erf below 0.46875, of erfc up to 4, and of erfc beyond.
ERF = ((3.16112374387056560e00, 1.13864154151050156e02, 3.77485237685302021e02, 3.20937758913846947e03, 1.85777706184603153e-1), (2.36012909523441209e01, 2.44024637934444173e02, 1.28261652607737228e03, 2.84423683343917062e03))
ERFC = (
    (5.64188496988670089e-1, 8.88314979438837594e0, 6.61191906371416295e01, 2.98635138197400131e02, 8.81952221241769090e02, 1.71204761263407058e03, 2.05107837782607147e03, 1.23033935479799725e03, 2.15311535474403846e-8),
    (1.57449261107098347e01, 1.17693950891312499e02, 5.37181101862009858e02, 1.62138957456669019e03, 3.29079923573345963e03, 4.36261909014324716e03, 3.43936767414372164e03, 1.23033935480374942e03),
)
TAIL = ((3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4, 1.63153871373020978e-2), (2.56852019228982242e00, 1.87295284992346725e00, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3))


def quotient(table: tuple[tuple[float, ...], tuple[float, ...]], x):
    """Two polynomials by Horner's scheme, over columns or numbers; the last value of the first table leads."""
    over, under = table
    num, den, n = x * over[-1], x, len(under)
    for a, b in zip(over[: n - 1], under[: n - 1], strict=True):
        num, den = (num + a) * x, (den + b) * x
    return (num + over[n - 1]) / (den + under[n - 1])


def erfc(x: Column) -> Column:
    """The complementary error function as an expression, so that tails stay in the JVM."""
    y, square = F.abs(x), x * x
    far = F.exp(-square) / y * (0.5641895835477563 - quotient(TAIL, 1 / square) / square)
    positive = F.when(y <= 4, F.exp(-square) * quotient(ERFC, y)).otherwise(far)
    return F.when(y <= 0.46875, 1 - x * quotient(ERF, square)).when(x < 0, 2 - positive).otherwise(positive)


def normal_p(stat: Column, alternative: str = "greater") -> Column:
    """p values of standard normal statistics; null and NaN have none."""
    upper = erfc(stat / math.sqrt(2)) / 2
    p = {"greater": upper, "less": 1 - upper, "two-sided": F.least(F.lit(1.0), 2 * F.least(upper, 1 - upper))}.get(alternative)
    if p is None:
        raise ValueError(f"unknown alternative {alternative!r}")
    return F.when(stat.isNotNull() & ~F.isnan(stat), p)


def student_p(stat: Column, df: Column, alternative: str = "two-sided") -> Column:
    @F.pandas_udf("double")
    def p(x: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(a) or pd.isna(b) or b <= 0 else tail_p(t_sf(a, b), alternative) for a, b in zip(x, n, strict=True)], dtype="float64")

    return p(stat, df)
