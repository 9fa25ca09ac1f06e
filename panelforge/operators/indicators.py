"""Indicators as Window expressions over (ticker, date).

Builders take a frame with pos and add columns. Missing values are null, never NaN. All
windows share the partitioning and order of W, so that chained ones share one exchange.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def W():
    """A ticker's bars by date. A function, as a window needs a running session."""
    return Window.partitionBy("ticker").orderBy("date")


def PAST():
    return W().rowsBetween(Window.unboundedPreceding, -1)


def SO_FAR():
    return W().rowsBetween(Window.unboundedPreceding, 0)


def back(n: int):
    """This row and those before it, n in all."""
    return W().rowsBetween(-(n - 1), 0)


def ahead(n: int):
    return W().rowsBetween(1, n)


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def true_range() -> Column:
    before = F.lag("close").over(W())
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def recurrence(df: DataFrame, value: str, name: str, alpha: float, seed_pos: int, seed: Column) -> DataFrame:
    """y[s] = seed, then y[i] = (1 - alpha) * y[i - 1] + alpha * x[i]; null before s.

    Unrolled into running sums in blocks of bars: powers of 1 - alpha stay within a block, and
    what a block gets from the one before it is that one's last value. A block is so long that
    values two blocks back have no weight in double precision, so any length of series is exact.
    """
    q = 1 - alpha
    size = max(2, math.ceil(41.5 / -math.log(q)))
    at, block = F.col("pos") - seed_pos, F.floor((F.col("pos") - seed_pos) / size)
    inner = F.col("pos") - seed_pos - block * size
    in_block = Window.partitionBy("ticker", f"_{name}_b").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    term = F.when(at == 0, seed).when(at > 0, alpha * col(value))
    df = df.withColumns({f"_{name}_b": F.when(at >= 0, block), f"_{name}_i": inner, f"_{name}_x": term})
    # x has weight q**(i - k): q**i times the sum of x * q**-k
    own = F.sum(F.col(f"_{name}_x") * F.pow(F.lit(q), -F.col(f"_{name}_i"))).over(in_block) * F.pow(F.lit(q), F.col(f"_{name}_i"))
    df = df.withColumn(f"_{name}_y", own)
    last = F.when(F.col(f"_{name}_i") == size - 1, F.col(f"_{name}_y"))
    df = df.withColumn(f"_{name}_e", held_before(last))
    older = F.coalesce(F.lag(f"_{name}_e", size).over(W()), F.lit(0.0))
    carried = F.coalesce(F.col(f"_{name}_e") + older * q**size, F.lit(0.0)) * F.pow(F.lit(q), F.col(f"_{name}_i") + 1)
    df = df.withColumn(name, F.when(at >= 0, F.col(f"_{name}_y") + carried))
    return df.drop(*[f"_{name}_{k}" for k in "bixye"])


def wilder(df: DataFrame, value: str, name: str, length: int) -> DataFrame:
    """Seeded with the mean of the first length values."""
    first = F.avg(col(value)).over(W().rowsBetween(-(length - 1), 0))
    return recurrence(df, value, name, 1 / length, length, first)


def atr(df: DataFrame, length: int, name: str = "atr") -> DataFrame:
    return wilder(df.withColumn(f"_{name}_tr", true_range()), f"_{name}_tr", name, length).drop(f"_{name}_tr")


def ema(df: DataFrame, value: str, span: int, name: str) -> DataFrame:
    return recurrence(df, value, name, 2 / (span + 1), 1, col(value))


def rsi(df: DataFrame, length: int = 14, name: str = "rsi") -> DataFrame:
    """From the second bar on; null while there is no loss."""
    step = F.col("close") - F.lag("close").over(W())
    df = df.withColumns({f"_{name}_up": F.greatest(step, F.lit(0.0)) + step * 0, f"_{name}_dn": F.greatest(-step, F.lit(0.0)) + step * 0})
    df = recurrence(df, f"_{name}_up", f"_{name}_g", 1 / length, 2, F.col(f"_{name}_up"))
    df = recurrence(df, f"_{name}_dn", f"_{name}_l", 1 / length, 2, F.col(f"_{name}_dn"))
    ratio = F.try_divide(F.col(f"_{name}_g"), F.col(f"_{name}_l"))
    return df.withColumn(name, 100 - 100 / (1 + ratio)).drop(*[f"_{name}_{k}" for k in ("up", "dn", "g", "l")])


def sma(value: str | Column, n: int, least: int | None = None) -> Column:
    """Mean of the last n values; null with fewer than least (all n by default)."""
    least = n if least is None else least
    return F.when(F.count(col(value)).over(back(n)) >= least, F.avg(col(value)).over(back(n)))


def rolling_std(value: str | Column, n: int) -> Column:
    return F.when(F.count(col(value)).over(back(n)) >= n, F.stddev_samp(col(value)).over(back(n)))


def expanding_mean(value: str | Column) -> Column:
    """Sum so far over the number of bars so far, null ones included."""
    return F.sum(col(value)).over(SO_FAR()) / F.col("pos")


def held(value: Column) -> Column:
    """The last value that isn't null, this bar included."""
    return F.last(value, ignorenulls=True).over(SO_FAR())


def held_before(value: Column) -> Column:
    return F.last(value, ignorenulls=True).over(PAST())


def pivots(df: DataFrame, left: int, right: int, name: str = "pivot") -> DataFrame:
    """{name}_high/_low: a bar strictly beyond those left of it and not within those right of it; *_confirmed right bars later."""
    n = F.count(F.lit(1)).over(Window.partitionBy("ticker"))
    whole = (F.col("pos") > left) & (F.col("pos") <= n - right)
    before, after = W().rowsBetween(-left, -1), ahead(right)
    high = whole & (F.col("high") > F.max("high").over(before)) & (F.col("high") >= F.max("high").over(after))
    low = whole & (F.col("low") < F.min("low").over(before)) & (F.col("low") <= F.min("low").over(after))
    df = df.withColumns({f"{name}_high": F.coalesce(high, F.lit(False)), f"{name}_low": F.coalesce(low, F.lit(False))})
    late = {f"{name}_{s}_confirmed": F.coalesce(F.lag(f"{name}_{s}", right).over(W()), F.lit(False)) for s in ("high", "low")}
    return df.withColumns(late)


def legs(df: DataFrame, size: int, name: str) -> DataFrame:
    """{name}_leg (0 after a high that size bars since have not reached, 1 after such a low), and confirmed {name}_high/_low."""
    top = (F.col("pos") > size) & (F.lag("high", size).over(W()) > F.max("high").over(back(size)))
    bottom = (F.col("pos") > size) & (F.lag("low", size).over(W()) < F.min("low").over(back(size)))
    df = df.withColumn(f"{name}_leg", F.coalesce(held(F.when(top, 0).when(bottom, 1)), F.lit(0)))
    before = F.lag(f"{name}_leg").over(W())
    turned = lambda to: (F.col(f"{name}_leg") == to) & (before == 1 - to)
    return df.withColumns({f"{name}_high": F.when(turned(0), F.lag("high", size).over(W())), f"{name}_low": F.when(turned(1), F.lag("low", size).over(W()))})


def week_opens() -> Column:
    """The weekday is no later than the bar's before; the first bar of a ticker opens a week."""
    return F.coalesce(F.weekday("date") - F.lag(F.weekday("date")).over(W()), F.lit(-1)) <= 0


def expanding_median(df: DataFrame, value: str, name: str, least: int) -> DataFrame:
    """Exact median of all values so far, which no Spark aggregate gives over a growing frame.

    A sorted list for each ticker, in a grouped map; a ticker's series is its history of bars.
    """
    import bisect

    import pandas as pd
    from pyspark.sql import types as T

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, seen, out = pdf.sort_values("date"), [], []
        for x in pdf[value]:
            if pd.notna(x):
                bisect.insort(seen, x)
            n = len(seen)
            out.append((seen[(n - 1) // 2] + seen[n // 2]) / 2 if n >= least else None)
        return pdf.assign(**{name: pd.Series(out, index=pdf.index, dtype="float64")})

    return df.groupBy("ticker").applyInPandas(run, T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())]))
