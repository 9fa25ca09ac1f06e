"""Re-slices of trades: regimes, sectors, stocks, folds, membership, parameter sweeps, reports."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.distributions import normal_p, student_p
from panelforge.operators import detectors as D
from panelforge.operators.events import combinations, registry, to_events
from panelforge.operators.indicators import W, expanding_median, rolling_std, sma
from panelforge.operators.stats import benjamini_hochberg, forward_returns, matched_excess, matched_null, one_sample, return_pools, return_summary, welch
from panelforge.operators.trades import backtest
from panelforge.params import PriceActionParams, RegimeParams


def regimes(bars: DataFrame, p: RegimeParams = RegimeParams()) -> DataFrame:
    """trend_regime and vol_regime of every bar; bars without enough past are sideways and of normal volatility."""
    df = bars.withColumn("_sma", sma("close", p.trend, p.trend // 2))
    df = df.withColumn("_slope", F.col("_sma") - F.lag("_sma", p.slope).over(W())).withColumn("_ret", F.col("close") / F.lag("close").over(W()) - 1)
    df = expanding_median(df.withColumn("_vol", rolling_std("_ret", p.vol)), "_vol", "_mid", p.vol)
    c = F.col("close")
    trend = F.when((c > F.col("_sma")) & (F.col("_slope") > 0), "bull").when((c < F.col("_sma")) & (F.col("_slope") < 0), "bear").otherwise("sideways")
    vol = F.when(F.col("_vol") < p.low * F.col("_mid"), "low_vol").when(F.col("_vol") > p.high * F.col("_mid"), "high_vol").otherwise("normal_vol")
    return df.withColumns({"trend_regime": trend, "vol_regime": vol}).drop("_sma", "_slope", "_ret", "_vol", "_mid")


def tag_regimes(trades: DataFrame, labelled: DataFrame) -> DataFrame:
    """Trades with their entry bar's regime; tickers without bars go."""
    tags = labelled.select("ticker", "date", "trend_regime", "vol_regime")
    return trades.join(labelled.select("ticker").distinct(), "ticker", "left_semi").join(tags, ["ticker", "date"], "left")


def regime_null(labelled: DataFrame, h: int) -> DataFrame:
    """Mean return over h bars of all bars of each regime."""
    fwd = forward_returns(labelled, [h]).join(labelled.select("ticker", "date", "trend_regime", "vol_regime"), ["ticker", "date"])
    return fwd.groupBy("trend_regime", "vol_regime").agg(F.avg("fwd").alias("regime_null_long"), F.count(F.lit(1)).alias("n_bars"))


def regime_analysis(trades: DataFrame, labelled: DataFrame, h: int) -> DataFrame:
    keys = ["trend_regime", "vol_regime"]
    t = tag_regimes(trades.filter(F.col("holding_period") == h), labelled).join(F.broadcast(regime_null(labelled, h)), keys, "left")
    side = lambda d: F.when(F.col("direction") == d, F.col("fwd_return"))
    null = F.col("direction") * F.col("regime_null_long")
    return t.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_trades"), F.count_distinct("ticker").alias("n_tickers"), F.count(side(1)).alias("n_long_trades"), F.count(side(-1)).alias("n_short_trades"),
        F.avg("fwd_return").alias("avg_return"), F.avg(side(1)).alias("avg_return_long"), F.avg(side(-1)).alias("avg_return_short"), F.first("regime_null_long").alias("regime_null_long"),
        F.avg(null).alias("matched_null_mean"), F.avg(F.col("fwd_return") - null).alias("excess_return"),
    )


def regime_by_signal(trades: DataFrame, labelled: DataFrame, h: int) -> DataFrame:
    """Null of a signal in a trend: the plain mean over the volatility regimes it met, and one weighted by trades."""
    keys = ["signal", "trend_regime"]
    t = tag_regimes(trades.filter(F.col("holding_period") == h), labelled).join(F.broadcast(regime_null(labelled, h)), ["trend_regime", "vol_regime"], "left")
    cells = t.groupBy(*keys, "vol_regime").agg(F.count(F.lit(1)).alias("_n"), F.sum("fwd_return").alias("_s"), F.first("regime_null_long").alias("_null"), F.first("direction").alias("direction"))
    g = cells.groupBy(*keys).agg(F.first("direction").alias("direction"), F.sum("_n").alias("n_trades"), (F.sum("_s") / F.sum("_n")).alias("avg_return"), F.avg("_null").alias("_plain"), (F.sum(F.col("_n") * F.col("_null")) / F.sum("_n")).alias("_weighted"))
    return g.select(*keys, "direction", "n_trades", "avg_return", (F.col("direction") * F.col("_plain")).alias("matched_null_mean"), (F.col("avg_return") - F.col("direction") * F.col("_plain")).alias("excess_return"), (F.col("avg_return") - F.col("direction") * F.col("_weighted")).alias("excess_return_weighted"))


def with_sector(trades: DataFrame, sectors: DataFrame) -> DataFrame:
    return trades.join(sectors.select("ticker", "sector"), "ticker", "left").withColumn("sector", F.coalesce("sector", F.lit("Unknown")))


def sector_analysis(trades: DataFrame, sectors: DataFrame, bars: DataFrame, h: int) -> DataFrame:
    """Each direction against its own null, weighted by trades; the error counts both on their days together."""
    keys = ["sector", "holding_period"]
    t = with_sector(trades.filter(F.col("holding_period") == h), sectors)
    pools = return_pools(bars, [h])
    null = matched_null(t, pools, [*keys, "direction"])
    n = t.groupBy(*keys, "direction").agg(F.count(F.lit(1)).alias("_n"))
    weighted = null.join(n, [*keys, "direction"]).groupBy(*keys).agg((F.sum(F.col("null_mean") * F.col("_n")) / F.sum("_n")).alias("matched_null_mean"), (F.sum(F.col("excess_return") * F.col("_n")) / F.sum("_n")).alias("excess_return"))
    side = lambda d: F.when(F.col("direction") == d, F.col("fwd_return"))
    more = t.groupBy(*keys).agg(F.count_distinct("ticker").alias("n_tickers"), F.count(side(1)).alias("n_long_trades"), F.count(side(-1)).alias("n_short_trades"), F.avg(side(1)).alias("avg_return_long"), F.avg(side(-1)).alias("avg_return_short"))
    cal = matched_excess(t, pools, keys).select(*keys, F.col("se").alias("matched_null_se"), F.col("z_stat").alias("matched_z"))
    return return_summary(t, keys).join(more, keys).join(weighted, keys, "left").join(cal, keys, "left")


#: Normal quantiles at 0.975 and 0.8.
Z_ALPHA, Z_POWER = 1.959963984540054, 0.8416212335729143


def sector_power(sectors: DataFrame, wanted_bps: float = 10.0) -> DataFrame:
    """Smallest effect that a two-sided 5 % test finds in four of five cases."""
    mde = (Z_ALPHA + Z_POWER) * F.col("matched_null_se") * 1e4
    out = sectors.select("sector", "n_tickers", "n_trades", (F.col("excess_return") * 1e4).alias("observed_excess_bps"), mde.alias("mde_bps"))
    ok = F.coalesce(F.col("mde_bps") < wanted_bps, F.lit(False))
    return out.withColumn("adequately_powered", ok).withColumn("power_note", F.when(ok, "null result is informative").otherwise("underpowered"))


def coverage(tickers: DataFrame, sectors: DataFrame) -> DataFrame:
    t = with_sector(tickers.select("ticker").distinct(), sectors)
    total = F.sum(F.count(F.lit(1))).over(Window.partitionBy())
    return t.groupBy("sector").agg(F.count(F.lit(1)).alias("n_tickers"), (F.count(F.lit(1)) / total).alias("share"))


def rank_stocks(trades: DataFrame, baseline: DataFrame, h: int, least: int = 20, least_base: int = 15) -> DataFrame:
    """Tickers by excess over their own random entries: Welch's t, never a bonus for a loser."""
    keys = ["ticker", "holding_period"]
    t, b = trades.filter(F.col("holding_period") == h), baseline.filter((F.col("holding_period") == h) & (F.col("signal") == "baseline_random_bullish"))
    enough = b.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.avg("fwd_return").alias("baseline_avg_return")).filter(F.col("_n") >= least_base).drop("_n")
    vs = welch(t, b, keys).select(*keys, F.col("t_stat").alias("t_vs_baseline"), F.col("dof").alias("dof_vs_baseline"), F.col("cohens_d").alias("effect_size_vs_baseline"))
    out = return_summary(t, keys).join(enough.join(vs, keys), keys, "left")
    out = out.withColumns({"excess_return_vs_baseline": F.col("avg_return") - F.col("baseline_avg_return"), "eligible": F.col("n_trades") >= least})
    out = benjamini_hochberg(out.withColumn("p_value_vs_baseline", student_p(F.col("t_vs_baseline"), F.col("dof_vs_baseline"), "greater")), "p_value_vs_baseline", "vs_baseline")
    significant = F.col("vs_baseline_reject") & (F.col("excess_return_vs_baseline") > 0) & F.col("eligible")
    return out.withColumn("significant_vs_baseline", F.coalesce(significant, F.lit(False)))


def stability(trades: DataFrame) -> DataFrame:
    """How even a ticker's win rate is across horizons."""
    rate = trades.groupBy("ticker", "holding_period").agg(F.avg((F.col("fwd_return") > 0).cast("double")).alias("r"))
    g = rate.groupBy("ticker").agg(F.avg("r").alias("avg_win_rate"), F.stddev_samp("r").alias("win_rate_std_across_horizons"))
    return g.withColumn("stability_score", F.col("avg_win_rate") - F.col("win_rate_std_across_horizons"))


def folds(trades: DataFrame, train: int = 3, test: int = 1, step: int = 1) -> DataFrame:
    """(fold, train_start, train_end, test_end) that fit between the first and last entry."""
    span = trades.agg(F.min("date").alias("a"), F.max("date").alias("b"))
    years = lambda d, n: F.add_months(d, 12 * n)
    rows = span.select("b", F.explode(F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.year("b") - F.year("a"))), lambda k: F.struct(k.alias("k"), F.add_months("a", k * 12 * step).alias("s")))).alias("f"))
    rows = rows.select((F.col("f.k") + 1).cast("int").alias("fold"), F.col("f.s").alias("train_start"), years("f.s", train).alias("train_end"), years("f.s", train + test).alias("test_end"), "b")
    return rows.filter("test_end <= b").drop("b")


def business_days_before(date: Column, n: int) -> Column:
    """n weekdays back; from a weekend the first step goes to its Friday."""
    wd = F.weekday(date)
    from_friday = F.when(wd > 4, 4 - wd).otherwise(0)  # back to Friday counts as a step
    left = n - (wd > 4).cast("int")
    start, day = F.date_add(date, from_friday), F.least(wd, F.lit(4))
    weekends = F.floor((left + 4 - day) / 5)
    return F.date_add(start, (-(left + 2 * weekends)).cast("int"))


def walk_forward(trades: DataFrame, bars: DataFrame, h: int, top: int = 5, least: int = 30) -> tuple[DataFrame, DataFrame]:
    """Signals of each fold in and out of sample, and one row for each fold.

    All folds are one plan, keyed by fold. Training trades whose outcome would reach into the
    test window are purged; nulls are built from each window's own bars.
    """
    t = trades.filter(F.col("holding_period") == h)
    f = F.broadcast(folds(t))
    purge = business_days_before(F.col("train_end"), h)
    in_train = (F.col("date") >= F.col("train_start")) & (F.col("date") < purge)
    in_test = (F.col("date") >= F.col("train_end")) & (F.col("date") < F.col("test_end"))

    def window(on: Column, bar_on: Column, name: str) -> DataFrame:
        part = t.join(f, on)
        own = bars.join(f, bar_on).select("fold", F.concat_ws("|", F.col("fold").cast("string"), "ticker").alias("ticker"), "date", "close")
        pools = return_pools(own, [h])
        part = part.withColumn("ticker", F.concat_ws("|", F.col("fold").cast("string"), "ticker"))
        return matched_null(part, pools, ["fold", "signal", "holding_period"]).join(part.groupBy("fold", "signal").agg(F.count(F.lit(1)).alias(f"n_{name}")), ["fold", "signal"]).select("fold", "signal", f"n_{name}", F.col("observed_mean").alias(f"mean_{name}"), F.col("excess_return").alias(f"excess_{name}"))

    bars_train = (F.col("date") >= F.col("train_start")) & (F.col("date") < F.col("train_end"))
    train, test = window(in_train, bars_train, "train"), window(in_test, in_test, "test")
    best = Window.partitionBy("fold", F.col("n_train") >= least).orderBy(F.desc("excess_train"), "signal")
    train = train.withColumn("selected", (F.col("n_train") >= least) & (F.row_number().over(best) <= top))
    detail = train.join(test, ["fold", "signal"])
    picked = lambda c: F.when(F.col("selected"), c)
    ranked = spearman_ranks(detail, ["fold"], "excess_train", "excess_test")
    summary = ranked.groupBy("fold").agg(
        F.count(F.lit(1)).alias("n_signals"), F.count_if("selected").alias("n_selected"), F.avg(picked(F.col("excess_train"))).alias("train_excess_selected"),
        F.avg(picked(F.col("excess_test"))).alias("test_excess_selected"), F.avg("excess_test").alias("test_excess_all"),
        F.avg(picked((F.col("excess_test") > 0).cast("double"))).alias("hit_rate_selected"), F.when(F.count(F.lit(1)) > 2, F.corr("_rx", "_ry")).alias("rank_correlation"),
    )
    return detail, summary


def spearman_ranks(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """_rx and _ry: mean ranks, ties shared."""
    out = {}
    for name, c in (("_rx", x), ("_ry", y)):
        out[name] = F.rank().over(Window.partitionBy(*keys).orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, c)) - 1) / 2
    return df.withColumns(out)


def missing_members(members: DataFrame, start: Column, size: int = 500) -> DataFrame:
    """How many names an index of this size has lost without trace, at least."""
    g = members.agg(F.count(F.lit(1)).alias("current_constituents"), F.count("date_added").alias("with_known_entry_date"), F.count_if(F.col("date_added") <= start).alias("in_index_at_sample_start"), F.count_if(F.col("date_added") > start).alias("joined_during_sample"))
    g = g.withColumn("entry_date_unknown", F.col("current_constituents") - F.col("with_known_entry_date"))
    return g.withColumn("estimated_removed_names_missing", F.greatest(F.lit(size) - F.col("in_index_at_sample_start") - F.col("entry_date_unknown"), F.lit(0)))


def membership_coverage(tickers: DataFrame, members: DataFrame) -> DataFrame:
    """Tickers by what the membership table (ticker, date_added) knows of them."""
    j = tickers.select("ticker").distinct().join(members.select("ticker", "date_added", F.lit(True).alias("_in")), "ticker", "left")
    state = F.when(F.col("_in").isNull(), "absent").when(F.col("date_added").isNull(), "entry_date_unknown").otherwise("known")
    return j.groupBy(state.alias("membership")).agg(F.count(F.lit(1)).alias("n_tickers"), F.min("date_added").alias("first_added"), F.max("date_added").alias("last_added"))


def membership_compare(full: DataFrame, aware: DataFrame) -> DataFrame:
    """Two runs' signals side by side: (signal, n, excess) each."""
    j = full.select("signal", F.col("n").alias("n_full"), F.col("excess").alias("excess_full")).join(aware.select("signal", F.col("n").alias("n_aware"), F.col("excess").alias("excess_aware")), "signal", "full_outer")
    return j.withColumns({"excess_delta_bps": (F.col("excess_aware") - F.col("excess_full")) * 1e4, "sign_preserved": F.signum("excess_full") == F.signum("excess_aware")})


def sweep(base: object, grid: dict[str, Sequence], evaluate: Callable[[object], DataFrame]) -> DataFrame:
    """Every combination of parameter values, each a plan of its own tagged with them, in one union."""
    parts = []
    for i, values in enumerate(itertools.product(*grid.values())):
        df = evaluate(replace(base, **dict(zip(grid, values, strict=True)))).withColumn("config", F.lit(i))
        parts.append(df.withColumns({k: F.lit(v) for k, v in zip(grid, values, strict=True)}))
    out = parts[0]
    for df in parts[1:]:
        out = out.unionByName(df)
    return out


def random_grid(ranges: dict[str, tuple[float, float]], n: int, label: str) -> list[dict]:
    """n draws of parameters within their ranges; integer bounds give integers."""
    from panelforge.functions.seeds import rng

    gen = rng(label)
    return [{k: int(gen.integers(lo, hi + 1)) if isinstance(lo, int) else float(gen.uniform(lo, hi)) for k, (lo, hi) in ranges.items()} for _ in range(n)]


def sweep_stability(rows: DataFrame) -> DataFrame:
    """(signal, excess) over configurations: how far and how often the sign of an edge moves."""
    g = rows.groupBy("signal").agg(F.count("excess").alias("n_configs"), F.avg("excess").alias("mean_excess"), F.median("excess").alias("median_excess"), F.coalesce(F.stddev_samp("excess"), F.lit(0.0)).alias("std_excess"), F.min("excess").alias("min_excess"), F.max("excess").alias("max_excess"), F.avg((F.col("excess") > 0).cast("double")).alias("_pos"))
    return g.select("signal", "n_configs", "mean_excess", "median_excess", "std_excess", "min_excess", "max_excess", F.greatest("_pos", 1 - F.col("_pos")).alias("sign_consistency"), F.try_divide(F.col("std_excess"), F.abs("mean_excess")).alias("coefficient_of_variation"), (F.col("std_excess") > 0).alias("responds_to_sweep"), ((F.col("max_excess") - F.col("min_excess")) * 1e4).alias("swept_range_bps"))


def edge_counts(master: DataFrame) -> DataFrame:
    """How many signals of each horizon beat, lose to, or can't be told from random entry."""
    g = master.groupBy("holding_period").agg(F.count(F.lit(1)).alias("n_concepts"), F.count_if("beats_matched_random").alias("n_beats"), F.count_if("loses_to_matched_random").alias("n_loses"), F.count_if("low_sample_warning").alias("n_low_sample"))
    return g.withColumn("n_indistinguishable", F.col("n_concepts") - F.col("n_beats") - F.col("n_loses"))


def sign_consistency(rows: DataFrame) -> DataFrame:
    """Whether a signal's excess has one sign over all horizons."""
    s = F.signum("excess_return")
    return rows.groupBy("signal").agg(F.count(F.lit(1)).alias("n_horizons"), F.sum(s).alias("sign_sum"), (F.abs(F.sum(s)) == F.sum(F.abs(s))).alias("consistent"))


def histogram(rows: DataFrame, value: str, lo: float, hi: float, bins: int = 60) -> DataFrame:
    """Counts of equal bins of [lo, hi); 0 is below and bins + 1 above."""
    return rows.groupBy(F.width_bucket(value, F.lit(lo), F.lit(hi), F.lit(bins)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def rank_concepts(matched: DataFrame, h: int | None = None) -> DataFrame:
    """Signals of each horizon (or of one) by their excess over the matched null, the unknown last."""
    rows = matched if h is None else matched.filter(F.col("holding_period") == h)
    order = Window.partitionBy("holding_period").orderBy(F.desc_nulls_last("excess_return"), "signal")
    return rows.withColumn("rank", F.row_number().over(order))


def best_and_worst(matched: DataFrame, best: int = 2, worst: int = 1) -> DataFrame:
    """The first and last signals of each horizon's ranking by excess."""
    down = Window.partitionBy("holding_period").orderBy(F.desc("excess_return"), "signal")
    up = Window.partitionBy("holding_period").orderBy("excess_return", "signal")
    rows = matched.withColumns({"_b": F.row_number().over(down), "_w": F.row_number().over(up)})
    return rows.filter((F.col("_b") <= best) | (F.col("_w") <= worst)).withColumn("best", F.col("_b") <= best).drop("_b", "_w")


def rank_combinations(events: DataFrame, bars: DataFrame, baseline: DataFrame, h: int = 10, least: int = 100, top: int = 60) -> DataFrame:
    """Pairs of signals that fire together, against zero, random entries and their own matched null.

    p values against each are corrected over all pairs; a pair beats random entry if its excess
    over the matched null is positive and survives that on enough trades.
    """
    keys = ["signal", "holding_period"]
    trades, pools = backtest(combinations(events, least, top), bars, [h]), return_pools(bars, [h])
    null = matched_null(trades, pools, keys)
    null = null.select(*keys, F.col("null_mean").alias("matched_null_mean"), F.col("excess_return").alias("excess_return_vs_matched_random"), normal_p(F.col("z_stat")).alias("p_value_vs_matched_random_srs"))
    dated = matched_excess(trades, pools, keys).select(*keys, normal_p(F.col("z_stat")).alias("p_value_vs_matched_random"))
    one = one_sample(trades, keys).select(*keys, F.col("cohens_d").alias("effect_size_cohens_d"), student_p(F.col("t_iid"), F.col("n").cast("double") - 1).alias("p_value"))
    random = baseline.filter((F.col("signal") == "baseline_random_bullish") & (F.col("holding_period") == h))
    vs = welch(trades, random, keys, on=["holding_period"]).select(*keys, student_p(F.col("t_stat"), F.col("dof"), "greater").alias("p_value_vs_baseline"), F.col("cohens_d").alias("effect_size_vs_baseline"))
    out = return_summary(trades, keys)
    for part in (one, vs, null, dated):
        out = out.join(part, keys, "left")
    for p, name in (("p_value", "vs_zero"), ("p_value_vs_baseline", "vs_baseline"), ("p_value_vs_matched_random", "vs_matched_random")):
        out = benjamini_hochberg(out, p, name)
    out = out.withColumn("low_sample_warning", F.col("n_trades") < least)
    beats = F.col("vs_matched_random_reject") & (F.col("excess_return_vs_matched_random") > 0) & ~F.col("low_sample_warning")
    return out.withColumn("beats_matched_random", F.coalesce(beats, F.lit(False))).withColumnRenamed("signal", "combination")


def sector_disagreements(official: DataFrame, curated: DataFrame) -> DataFrame:
    """(ticker, curated, official, kind) where the curated sector is missing or another than the official one."""
    both = official.select("ticker", F.col("sector").alias("official")).join(curated.select("ticker", F.col("sector").alias("curated")), "ticker", "left")
    kind = F.when(F.col("curated").isNull(), "missing").when(F.col("curated") != F.col("official"), "mismatch")
    return both.withColumn("kind", kind).filter("kind is not null").select("ticker", F.coalesce("curated", F.lit("(absent -> Unknown)")).alias("curated"), "official", "kind")


def repeated_assignments(sectors: DataFrame) -> DataFrame:
    """Tickers that stand under more than one sector, with all of them in order."""
    found = sectors.groupBy("ticker").agg(F.array_sort(F.collect_set("sector")).alias("sectors"))
    return found.filter(F.size("sectors") > 1)


def evaluate_events(events: DataFrame, bars: DataFrame, pools: DataFrame, h: int) -> DataFrame:
    """signal, n_trades, mean_return, excess and p of the events of one configuration."""
    keys = ["signal", "holding_period"]
    trades = backtest(events, bars, [h])
    dated = matched_excess(trades, pools, keys).select(*keys, normal_p(F.col("z_stat")).alias("p"))
    found = matched_null(trades, pools, keys).join(dated, keys, "left")
    return found.select("signal", F.col("n_matched").alias("n_trades"), F.col("observed_mean").alias("mean_return"), F.col("excess_return").alias("excess"), "p")


def random_sweep(base: object, ranges: dict[str, tuple[float, float]], n: int, label: str, evaluate: Callable[[object], DataFrame]) -> DataFrame:
    """evaluate for n draws of parameters, each a plan of its own tagged with its draw and values, in one union."""
    out = None
    for i, drawn in enumerate(random_grid(ranges, n, label), 1):
        rows = evaluate(replace(base, **drawn)).withColumns({**{k: F.lit(v) for k, v in drawn.items()}, "draw": F.lit(i)})
        out = rows if out is None else out.unionByName(rows)
    return out


#: What the sweeps and gaps read, and the signals that read it.
TARGETED_GRID = {"sweep_penetration": (0.10, 0.25, 0.50, 1.00), "sweep_bars": (1, 3, 6), "gap_min_atr": (0.05, 0.10, 0.25)}
TARGETED_SIGNALS = ("ict_sweep_sellside_bullish", "ict_sweep_buyside_bearish", "ict_nwog_gap_up", "ict_nwog_gap_down")


def targeted_sweep(bars: DataFrame, base: PriceActionParams = PriceActionParams(), h: int = 10, grid: dict[str, Sequence] = TARGETED_GRID) -> DataFrame:
    """The reformulated signals over all values of their own parameters, a row for each signal and configuration.

    A signal is evaluated once for each setting of what it reads, and repeated over the rest.
    """
    pools, out = return_pools(bars, [h]), None
    for names, detect, signals in ((("sweep_penetration", "sweep_bars"), D.liquidity_sweep, TARGETED_SIGNALS[:2]), (("gap_min_atr",), D.opening_gaps, TARGETED_SIGNALS[2:])):
        rest = {k: v for k, v in grid.items() if k not in names}
        rows = sweep(base, {k: grid[k] for k in names}, lambda p, detect=detect, signals=signals: evaluate_events(to_events(detect(bars, p), registry(), signals), bars, pools, h)).drop("config")
        for k, v in rest.items():
            rows = rows.withColumn(k, F.explode(F.array(*[F.lit(x) for x in v])))
        out = rows if out is None else out.unionByName(rows)
    return out
