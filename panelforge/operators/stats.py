"""Aggregates and tests over trades, each for all groups at once.

keys name the group columns; holding_period is one of them wherever a horizon matters.
Every group is a key of one shuffle: no job runs for a single signal.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.distributions import normal_p, student_p
from panelforge.operators.indicators import W
from panelforge.params import HORIZONS

UP_TO = (Window.unboundedPreceding, 0)


def return_summary(trades: DataFrame, keys: Sequence[str], days: int = 252, value: str = "fwd_return") -> DataFrame:
    """Sixteen figures for each group; the drawdown follows the order (ticker, ordinal, date)."""
    r = F.col(value)
    order = Window.partitionBy(*keys).orderBy("ticker", "ordinal", "date").rowsBetween(*UP_TO)
    rows = trades.filter(r.isNotNull()).withColumn("_path", F.sum(F.log1p(F.greatest(r, F.lit(-0.999999)))).over(order))
    rows = rows.withColumn("_fall", F.expm1(F.col("_path") - F.max("_path").over(order)))
    gain, loss = F.when(r > 0, r), F.when(r < 0, r)
    g = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_trades"), F.count(gain).alias("_w"), F.count(loss).alias("_l"), F.avg(r).alias("avg_return"), F.median(r).alias("median_return"),
        F.stddev_samp(r).alias("std_return"), F.skewness(r).alias("_g1"), F.kurtosis(r).alias("_g2"), F.coalesce(F.sum(gain), F.lit(0.0)).alias("_gain"),
        F.coalesce(-F.sum(loss), F.lit(0.0)).alias("_loss"), F.stddev_samp(loss).alias("_down"), F.avg(gain).alias("_mw"), F.avg(loss).alias("_ml"),
        F.min("_fall").alias("max_drawdown"), F.coalesce(F.avg(F.when(F.col("_fall") < 0, F.col("_fall"))), F.lit(0.0)).alias("avg_drawdown"),
        F.max_by("_path", F.struct("ticker", "ordinal", "date")).alias("_end"),
    )
    n, year = F.col("n_trades").cast("double"), F.lit(float(days)) / F.col("holding_period")
    per = lambda a, s: F.when(F.col(s) > 0, F.try_divide(F.col(a), F.col(s)) * F.sqrt(year))
    cagr = F.expm1(F.col("_end") * year / n)
    return g.select(
        *keys, "n_trades", (F.col("_w") / n).alias("win_rate"), "avg_return", "median_return", "std_return",
        F.when(n > 2, F.col("_g1") * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0))).alias("skewness"),
        F.when(n > 3, (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0)) * ((n + 1) * F.col("_g2") + 6)).alias("kurtosis"),
        F.when(F.col("_loss") > 0, F.try_divide(F.col("_gain"), F.col("_loss"))).when(F.col("_gain") > 0, F.lit(float("inf"))).alias("profit_factor"),
        per("avg_return", "std_return").alias("sharpe"), per("avg_return", "_down").alias("sortino"),
        (F.coalesce(F.col("_w") / n * F.col("_mw"), F.lit(0.0)) + F.coalesce(F.col("_l") / n * F.col("_ml"), F.lit(0.0))).alias("expectancy"),
        "max_drawdown", "avg_drawdown", F.when(F.col("max_drawdown") < 0, cagr / F.abs("max_drawdown")).alias("calmar"), cagr.alias("cagr_annualized"),
        F.try_divide(F.col("_mw"), F.abs("_ml")).alias("reward_risk_ratio"),
    )


def excursion_summary(trades: DataFrame, keys: Sequence[str]) -> DataFrame:
    ratio = F.try_divide(F.avg("mfe"), F.avg(F.abs("mae")))
    return trades.groupBy(*keys).agg(
        F.avg("mfe").alias("avg_mfe"), F.avg("mae").alias("avg_mae"), F.median("mfe").alias("median_mfe"), F.median("mae").alias("median_mae"),
        F.percentile("mfe", F.lit(0.9)).alias("p90_mfe"), F.percentile("mae", F.lit(0.1)).alias("p10_mae"), ratio.alias("mfe_mae_ratio"),
    )


def forward_returns(bars: DataFrame, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """(ticker, date, holding_period, fwd) of every bar that the series has h bars after."""
    cols = {f"_f{h}": F.lead("close", h).over(W()) / F.col("close") - 1 for h in horizons}
    legs = F.array(*[F.struct(F.lit(h).alias("holding_period"), F.col(f"_f{h}").alias("fwd")) for h in horizons])
    return bars.withColumns(cols).select("ticker", "date", F.explode(legs).alias("_e")).select("ticker", "date", "_e.*").filter("fwd is not null")


def return_pools(bars: DataFrame, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """Number, mean and variance of all forward returns of each ticker and horizon; two at least."""
    g = forward_returns(bars, horizons).groupBy("ticker", "holding_period")
    return g.agg(F.count("fwd").alias("n_pool"), F.avg("fwd").alias("mu"), F.var_samp("fwd").alias("var")).filter("n_pool >= 2")


def business_calendar(days: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All weekdays from each group's first to its last date, and its dates that are none."""
    span = days.groupBy(*keys).agg(F.min("date").alias("_a"), F.max("date").alias("_b"))
    grid = span.select(*keys, F.explode(F.sequence("_a", "_b")).alias("date")).filter(F.weekday("date") < 5)
    return grid.unionByName(days.select(*keys, "date")).distinct()


def calendar_test(trades: DataFrame, keys: Sequence[str], value: str = "fwd_return", most_lag: int = max(HORIZONS)) -> DataFrame:
    """Mean, Newey-West error in calendar time (Bartlett, as many lags as the horizon) and their ratio.

    Trades collapse to their dates first; days without trades count as zeros. Fewer than five
    trades have no test.
    """
    rows = trades.filter(F.col(value).isNotNull())
    daily = rows.groupBy(*keys, "date").agg(F.sum(value).alias("_s"), F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*keys)
    dense = business_calendar(daily, keys).join(daily, [*keys, "date"], "left").fillna(0, ["_s", "_n"])
    dense = dense.withColumns({"_total": F.sum("_n").over(whole), "_mu": F.sum("_s").over(whole) / F.sum("_n").over(whole), "_t": F.count(F.lit(1)).over(whole)})
    dense = dense.withColumn("_x", (F.col("_s") - F.col("_n") * F.col("_mu")) / F.col("_total"))
    order = Window.partitionBy(*keys).orderBy("date")
    bandwidth = F.least(F.greatest(F.lit(1), F.col("holding_period")), F.col("_t") - 1)
    terms = F.col("_x") * F.col("_x")
    lagged = {f"_x{k}": F.lag("_x", k).over(order) for k in range(1, most_lag + 1)}
    dense = dense.withColumns(lagged).withColumn("_l", bandwidth)
    for k in range(1, most_lag + 1):
        weight = F.when(F.col("_l") >= k, 2 * (1 - k / (F.col("_l") + 1.0))).otherwise(0.0)
        terms = terms + weight * F.coalesce(F.col("_x") * F.col(f"_x{k}"), F.lit(0.0))
    dense = dense.withColumn("_terms", terms)
    out = dense.groupBy(*keys).agg(F.first("_mu").alias("_mu"), F.sum("_terms").alias("_v"), F.first("_total").alias("n"), F.count_if(F.col("_n") > 0).alias("n_dates"))
    enough = F.col("n") >= 5
    se = F.when(enough & (F.col("_v") > 0), F.sqrt(F.greatest("_v", F.lit(0.0))))
    return out.select(*keys, F.when(enough, F.col("_mu")).alias("mean"), se.alias("hac_se"), F.try_divide(F.when(enough, F.col("_mu")), se).alias("t_stat"), "n", F.when(enough, F.col("n_dates")).otherwise(0).alias("n_dates"))


def newey_west(trades: DataFrame, keys: Sequence[str], value: str = "fwd_return", most_lag: int = max(HORIZONS)) -> DataFrame:
    """Error of the mean of a pooled series in the order (ticker, ordinal, date), lag = horizon."""
    order, whole = Window.partitionBy(*keys).orderBy("ticker", "ordinal", "date"), Window.partitionBy(*keys)
    rows = trades.withColumns({"_e": F.col(value) - F.avg(value).over(whole), "_t": F.count(F.lit(1)).over(whole)})
    rows = rows.withColumns({f"_e{k}": F.lag("_e", k).over(order) for k in range(1, most_lag + 1)})
    lags = F.least(F.col("holding_period"), F.col("_t") - 1)
    terms = F.col("_e") * F.col("_e")
    for k in range(1, most_lag + 1):
        terms = terms + F.when(lags >= k, 2 * (1 - k / (lags + 1.0)) * F.coalesce(F.col("_e") * F.col(f"_e{k}"), F.lit(0.0))).otherwise(0.0)
    g = rows.withColumn("_terms", terms).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.sum("_terms").alias("_v"))
    se = F.when(F.col("_v") > 0, F.sqrt(F.greatest("_v", F.lit(0.0))) / F.col("n"))
    return g.select(*keys, "n", "mean", se.alias("nw_se"), F.try_divide("mean", se).alias("t_stat"))


def one_sample(trades: DataFrame, keys: Sequence[str], value: str = "fwd_return") -> DataFrame:
    """t against zero and Cohen's d."""
    g = trades.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    return g.select(*keys, "n", "mean", F.try_divide(F.col("mean") * F.sqrt(F.col("n").cast("double")), F.col("sd")).alias("t_iid"), F.try_divide("mean", "sd").alias("cohens_d"))


def welch(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str = "fwd_return", on: Sequence[str] | None = None) -> DataFrame:
    """Difference of means of a's groups and b's (grouped by on, keys by default): Welch's t, its degrees of freedom, d by averaged variances. Five each at least."""
    on = list(keys) if on is None else list(on)
    part = lambda df, by, s: df.groupBy(*by).agg(F.count(value).cast("double").alias(f"n_{s}"), F.avg(value).alias(f"m_{s}"), F.var_samp(value).alias(f"v_{s}")).filter(f"n_{s} >= 5")
    j = part(a, keys, "a").join(part(b, on, "b"), on)
    va, vb = F.col("v_a") / F.col("n_a"), F.col("v_b") / F.col("n_b")
    diff = F.col("m_a") - F.col("m_b")
    dof = F.try_divide((va + vb) * (va + vb), va * va / (F.col("n_a") - 1) + vb * vb / (F.col("n_b") - 1))
    return j.select(*keys, diff.alias("mean_diff"), F.try_divide(diff, F.sqrt(va + vb)).alias("t_stat"), dof.alias("dof"), F.try_divide(diff, F.sqrt((F.col("v_a") + F.col("v_b")) / 2)).alias("cohens_d"))


def matched_null(trades: DataFrame, pools: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean return against entries on random bars of the same tickers, as many of each.

    The null's variance is that of sampling without replacement. Groups hold one direction
    each, or are weighted by each trade's.
    """
    g = trades.groupBy(*keys, "ticker", *(() if "direction" in keys else ("direction",))).agg(F.count(F.lit(1)).alias("_n"), F.sum("fwd_return").alias("_r"))
    observed = g.groupBy(*keys).agg((F.sum("_r") / F.sum("_n")).alias("observed_mean"))
    m = g.join(pools, ["ticker", "holding_period"]).withColumn("_k", F.least("_n", "n_pool"))
    fpc = (F.col("n_pool") - F.col("_k")) / (F.col("n_pool") - 1)
    null = m.groupBy(*keys).agg(F.sum(F.col("_k") * F.col("direction") * F.col("mu")).alias("_m"), F.sum(F.col("_k") * F.col("var") * fpc).alias("_v"), F.sum("_k").alias("n_matched"), F.count_distinct("ticker").alias("n_tickers"))
    out = observed.join(null, list(keys))
    mean = F.col("_m") / F.col("n_matched")
    se = F.when(F.col("_v") > 0, F.sqrt(F.greatest("_v", F.lit(0.0))) / F.col("n_matched"))
    excess = F.col("observed_mean") - mean
    return out.select(*keys, "observed_mean", mean.alias("null_mean"), se.alias("null_se"), excess.alias("excess_return"), F.try_divide(excess, se).alias("z_stat"), "n_matched", "n_tickers")


def with_excess(trades: DataFrame, pools: DataFrame) -> DataFrame:
    """excess: a trade's return beyond its own ticker's mean; trades without a pool go."""
    return trades.join(pools.select("ticker", "holding_period", "mu"), ["ticker", "holding_period"]).withColumn("excess", F.col("fwd_return") - F.col("direction") * F.col("mu")).drop("mu")


def matched_excess(trades: DataFrame, pools: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The primary test: calendar-time test of the excess."""
    t = calendar_test(with_excess(trades, pools), keys, "excess")
    return t.withColumnsRenamed({"mean": "excess_return", "hac_se": "se", "t_stat": "z_stat"})


def benjamini_hochberg(df: DataFrame, p: str, name: str, alpha: float = 0.05, family: Sequence[str] = ()) -> DataFrame:
    """{name}_adjusted and {name}_reject over each family; a null p has no value and no rejection."""
    known = F.col(p).isNotNull()
    fam = Window.partitionBy(*family, known) if family else Window.partitionBy(known)
    m = F.count(p).over(fam)
    raw = F.col(p) * m / F.row_number().over(fam.orderBy(p))
    df = df.withColumn("_raw", raw)
    best = F.min("_raw").over(fam.orderBy(F.desc(p)).rangeBetween(*UP_TO))
    df = df.withColumn(f"{name}_adjusted", F.when(known, F.least(best, F.lit(1.0)))).drop("_raw")
    return df.withColumn(f"{name}_reject", F.coalesce(F.col(f"{name}_adjusted") <= alpha, F.lit(False)))


def two_sided(p: Column) -> Column:
    return F.when(p.isNotNull(), F.least(F.lit(1.0), 2 * F.least(p, 1 - p)))


def significance_label(p: Column, effect: Column, alpha: float = 0.05) -> Column:
    return (
        F.when(p.isNull(), "insufficient_data").when(p >= alpha, "not_significant").when(effect.isNull(), "significant_unknown_effect")
        .when(F.abs(effect) < 0.1, "significant_but_negligible_effect").when(F.abs(effect) < 0.3, "significant_small_effect").otherwise("significant_meaningful_effect")
    )


def statistics_master(trades: DataFrame, bars: DataFrame, baseline: DataFrame, horizons: Sequence[int] = HORIZONS, least: int = 30) -> DataFrame:
    """One row for each signal and horizon with every figure but the bootstrap's, three families of p values, and flags."""
    keys = ["signal", "holding_period"]
    pools = return_pools(bars, horizons)
    base = trades.groupBy(*keys).agg(F.first("direction").alias("direction"), F.count_distinct("ticker").alias("n_traded_tickers"))
    zero = calendar_test(trades, keys).select(*keys, "hac_se", F.col("t_stat").alias("t_vs_zero"), F.col("n_dates").alias("n_entry_dates"))
    srs = matched_null(trades, pools, keys).select(*keys, F.col("excess_return").alias("excess_return_vs_matched_random"), F.col("null_mean").alias("matched_null_mean"), F.col("null_se").alias("matched_null_se_srs"), F.col("z_stat").alias("z_srs"))
    cal = matched_excess(trades, pools, keys).select(*keys, F.col("se").alias("matched_null_se"), F.col("z_stat").alias("matched_z"))
    vs = welch(trades, baseline.filter(F.col("signal") == "baseline_random_bullish"), keys, on=["holding_period"]).select(*keys, "mean_diff", F.col("t_stat").alias("welch_t"), F.col("dof").alias("welch_dof"), F.col("cohens_d").alias("effect_size_vs_baseline"))
    out = return_summary(trades, keys).join(excursion_summary(trades, keys), keys)
    out = out.join(one_sample(trades, keys).select(*keys, "t_iid", "cohens_d"), keys).join(base, keys)
    for part in (zero, srs, cal, vs):
        out = out.join(part, keys, "left")
    out = out.withColumns({
        "p_value_vs_zero": normal_p(F.col("t_vs_zero"), "two-sided"), "p_value_vs_zero_iid": student_p(F.col("t_iid"), F.col("n_trades").cast("double") - 1),
        "p_value_vs_matched_random": normal_p(F.col("matched_z")), "p_value_vs_matched_random_srs": normal_p(F.col("z_srs")),
        "p_value_vs_baseline_welch": student_p(F.col("welch_t"), F.col("welch_dof"), "greater"),
        "hac_ci_lower": F.col("avg_return") - 1.959964 * F.col("hac_se"), "hac_ci_upper": F.col("avg_return") + 1.959964 * F.col("hac_se"),
    })
    for test in ("zero", "matched_random", "baseline_welch"):
        out = benjamini_hochberg(out, f"p_value_vs_{test}", f"vs_{test}")
    out = out.withColumn("p_two_sided", two_sided(F.col("p_value_vs_matched_random")))
    out = benjamini_hochberg(out, "p_two_sided", "two_sided")
    excess = F.col("excess_return_vs_matched_random")
    out = out.withColumn("low_sample_warning", F.col("n_trades") < least)
    return out.withColumns({
        "beats_matched_random": F.coalesce(F.col("vs_matched_random_reject") & (excess > 0) & ~F.col("low_sample_warning"), F.lit(False)),
        "loses_to_matched_random": F.coalesce(F.col("two_sided_reject") & (excess < 0) & ~F.col("low_sample_warning"), F.lit(False)),
        "significance_label": significance_label(F.col("vs_matched_random_adjusted"), F.col("cohens_d")),
    })
