"""Resampling: bootstraps, simulated nulls, rotation of entry calendars, size calibration.

Draws come from numpy generators seeded by labels, so any group gives the same figures on
any executor. A group (one signal and horizon, or one ticker) is what a task holds.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelforge.functions.seeds import rng
from panelforge.functions.simulation import MOST_SAMPLE, REAL, SIMULATED, bootstrap_interval, draws, entries_of, forward_by_position, simulate_panel, size_tests
from panelforge.operators.stats import benjamini_hochberg, forward_returns, two_sided

def bootstrap(trades: DataFrame, runs: int = 10_000) -> DataFrame:
    """One row for each signal and horizon."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.sort_values(["ticker", "date"])["fwd_return"].dropna().to_numpy()
        return pd.DataFrame([{"signal": key[0], "holding_period": key[1], **bootstrap_interval(r, runs, f"boot:{key[0]}:{key[1]}")}])

    ddl = "signal string, holding_period int, mean double, ci_lower double, ci_upper double, cohens_d double, d_lower double, d_upper double, ci_method string"
    return trades.select("signal", "holding_period", "ticker", "date", "fwd_return").groupBy("signal", "holding_period").applyInPandas(run, ddl)


def trade_shuffle(trades: DataFrame, runs: int = 1000) -> DataFrame:
    """Bootstrap of a group's mean and how often it isn't above zero."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.sort_values(["ticker", "date"])["fwd_return"].dropna().to_numpy()
        gen, sims = rng(f"shuffle:{key[0]}:{key[1]}"), np.full(runs, np.nan)
        if len(r) >= 5:
            r = gen.choice(r, MOST_SAMPLE, replace=False) if len(r) > MOST_SAMPLE else r
            for at, idx in draws(len(r), runs, gen):
                sims[at] = r[idx].mean(axis=1)
        lo, hi = np.nanpercentile(sims, [2.5, 97.5]) if len(r) >= 5 else (np.nan, np.nan)
        return pd.DataFrame([{"signal": key[0], "holding_period": key[1], "mean": r.mean() if len(r) >= 5 else np.nan, "ci_lower": lo, "ci_upper": hi, "p_not_positive": ((sims <= 0).sum() + 1) / (runs + 1) if len(r) >= 5 else np.nan}])

    return trades.select("signal", "holding_period", "ticker", "date", "fwd_return").groupBy("signal", "holding_period").applyInPandas(run, "signal string, holding_period int, mean double, ci_lower double, ci_upper double, p_not_positive double")


def simulated_null(trades: DataFrame, bars: DataFrame, horizons: Sequence[int], runs: int = 1000, block: int | None = None) -> DataFrame:
    """Means of entries at random on the same tickers: without replacement, or in circular blocks of bars.

    Each ticker simulates its own sums for every signal and run; the runs are then summed over
    tickers, so that no task holds the panel.
    """
    fwd = forward_returns(bars, horizons).groupBy("ticker", "holding_period").agg(F.sort_array(F.collect_list(F.struct("date", "fwd"))).getField("fwd").alias("pool"))
    counts = trades.groupBy("signal", "holding_period", "ticker").agg(F.count(F.lit(1)).alias("n"), F.first("direction").alias("direction"), F.sum("fwd_return").alias("sum"))
    least = block or 1

    def run(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples():
                pool = np.asarray(row.pool, float)
                if len(pool) < 2 or len(pool) <= least:
                    continue
                gen = rng(f"{'block' if block else 'matched'}:{row.signal}:{row.holding_period}:{row.ticker}")
                n = int(row.n) if block else int(min(row.n, len(pool)))
                if block:
                    starts = gen.integers(0, len(pool), size=(runs, -(-n // block)))
                    at = (starts[:, :, None] + np.arange(block)).reshape(runs, -1)[:, :n] % len(pool)
                    sums = pool[at].sum(axis=1)
                else:
                    sums = np.array([pool[gen.choice(len(pool), n, replace=False)].sum() for _ in range(runs)])
                out.append((row.signal, row.holding_period, n, float(row.sum), int(row.n), (row.direction * sums).tolist()))
            yield pd.DataFrame(out, columns=["signal", "holding_period", "n", "sum", "n_trades", "sums"])

    parts = counts.join(fwd, ["ticker", "holding_period"]).mapInPandas(run, "signal string, holding_period int, n long, sum double, n_trades long, sums array<double>")
    totals = parts.groupBy("signal", "holding_period").agg(F.sum("n").alias("n_matched"), (F.sum("sum") / F.sum("n_trades")).alias("observed_mean"))
    sims = parts.select("signal", "holding_period", F.posexplode("sums").alias("run", "s")).groupBy("signal", "holding_period", "run").agg(F.sum("s").alias("s"))
    sims = sims.join(totals, ["signal", "holding_period"]).withColumn("m", F.col("s") / F.col("n_matched"))
    g = sims.groupBy("signal", "holding_period").agg(F.first("observed_mean").alias("observed_mean"), F.first("n_matched").alias("n_matched"), F.avg("m").alias("null_mean"), F.stddev_samp("m").alias("null_se"), F.count_if(F.col("m") >= F.col("observed_mean")).alias("_k"), F.count(F.lit(1)).alias("n_runs"))
    return g.select("signal", "holding_period", "observed_mean", "null_mean", "null_se", ((F.col("_k") + 1) / (F.col("n_runs") + 1)).alias("p_value"), "n_matched", "n_runs")


def trading_calendar(bars: DataFrame) -> DataFrame:
    """(date, at): all dates of the panel, numbered from 0. One row for each date of history."""
    return bars.select("date").distinct().withColumn("at", F.row_number().over(Window.orderBy("date")) - 1)


def rotation_curves(trades: DataFrame, bars: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """(signal, holding_period, o, sum, n): every trade read o dates later, round the calendar.

    Circular cross-correlations by FFT, a ticker at a time; their sums over tickers are the
    panel's. Trades and returns are placed on the union of all tickers' dates.
    """
    calendar = trading_calendar(bars)
    total = calendar.agg(F.count(F.lit(1)).alias("T"))
    fwd = forward_returns(bars, horizons).join(F.broadcast(calendar), "date")
    fwd = fwd.groupBy("ticker", "holding_period").agg(F.collect_list(F.struct("at", "fwd")).alias("path"))
    hits = trades.join(F.broadcast(calendar), "date").groupBy("ticker", "holding_period", "signal").agg(F.collect_list(F.struct(F.col("at"), F.col("direction").cast("double").alias("d"))).alias("hits"))
    rows = hits.join(fwd, ["ticker", "holding_period"]).join(F.broadcast(total), F.lit(True))

    def run(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples():
                T = int(row.T)
                g, v, w, c = (np.zeros(T) for _ in range(4))
                for x in row.path:
                    g[x["at"]], v[x["at"]] = x["fwd"], 1.0
                for x in row.hits:
                    w[x["at"]] += x["d"]
                    c[x["at"]] += 1
                f = np.fft.rfft
                num = np.fft.irfft(np.conj(f(w)) * f(g), n=T)
                den = np.rint(np.fft.irfft(np.conj(f(c)) * f(v), n=T))
                out.append((row.signal, int(row.holding_period), num.tolist(), den.tolist(), len(row.hits)))
            yield pd.DataFrame(out, columns=["signal", "holding_period", "num", "den", "n"])

    parts = rows.mapInPandas(run, "signal string, holding_period int, num array<double>, den array<double>, n long")
    flat = parts.select("signal", "holding_period", F.posexplode(F.arrays_zip("num", "den")).alias("o", "z"))
    return flat.groupBy("signal", "holding_period", "o").agg(F.sum("z.num").alias("sum"), F.sum("z.den").alias("n"))


def rotation_null(trades: DataFrame, bars: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """The observed mean against its value at every admissible offset (h + 1 to T - h - 2)."""
    curves = rotation_curves(trades, bars, horizons)
    mean = F.try_divide("sum", "n")
    whole = Window.partitionBy("signal", "holding_period")
    curves = curves.withColumns({"m": mean, "observed_mean": F.max(F.when(F.col("o") == 0, mean)).over(whole), "T": F.count(F.lit(1)).over(whole)})
    h = F.col("holding_period")
    sims = curves.filter((F.col("o") > h) & (F.col("o") < F.col("T") - h - 1) & F.col("m").isNotNull() & (F.col("T") > 2 * h + 4))
    tolerance = 1e-12 * F.greatest(F.lit(1.0), F.abs("observed_mean"))
    g = sims.groupBy("signal", "holding_period").agg(
        F.first("observed_mean").alias("observed_mean"), F.avg("m").alias("null_mean"), F.stddev_samp("m").alias("null_se"), F.count(F.lit(1)).alias("n_offsets"),
        F.count_if(F.col("m") >= F.col("observed_mean") - tolerance).alias("_ge"), F.count_if(F.col("m") <= F.col("observed_mean") + tolerance).alias("_le"),
    ).filter("n_offsets >= 2")
    return g.select("signal", "holding_period", "observed_mean", "null_mean", "null_se", (F.col("observed_mean") - F.col("null_mean")).alias("excess_vs_rotation"), ((F.col("_ge") + 1) / (F.col("n_offsets") + 1)).alias("p_value"), ((F.col("_le") + 1) / (F.col("n_offsets") + 1)).alias("p_value_less"), "n_offsets")


def rotation_family(trades: DataFrame, bars: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """rotation_null with its false-discovery control in both tails."""
    out = rotation_null(trades, bars, horizons).withColumn("p_two_sided", two_sided(F.col("p_value")))
    for p, name in (("p_value", "greater"), ("p_value_less", "less"), ("p_two_sided", "both")):
        out = benjamini_hochberg(out, p, name)
    return out


def rotation_sampled(trades: DataFrame, bars: DataFrame, horizons: Sequence[int], runs: int = 1000, seed: int = 42) -> DataFrame:
    """As rotation_null with so many offsets drawn for each group, by the smallest digests of offset numbers."""
    curves = rotation_curves(trades, bars, horizons)
    whole = Window.partitionBy("signal", "holding_period")
    curves = curves.withColumns({"m": F.try_divide("sum", "n"), "T": F.count(F.lit(1)).over(whole)})
    observed = curves.filter("o = 0").select("signal", "holding_period", F.col("m").alias("observed_mean"))
    h = F.col("holding_period")
    pool = curves.filter((F.col("o") > h) & (F.col("o") < F.col("T") - h - 1) & F.col("m").isNotNull())
    order = whole.orderBy(F.xxhash64("signal", "holding_period", "o", F.lit(seed)))
    g = pool.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= runs).join(observed, ["signal", "holding_period"])
    out = g.groupBy("signal", "holding_period").agg(F.first("observed_mean").alias("observed_mean"), F.avg("m").alias("null_mean"), F.stddev_samp("m").alias("null_se"), F.count_if(F.col("m") >= F.col("observed_mean")).alias("_ge"), F.count(F.lit(1)).alias("n_runs"))
    return out.withColumn("p_value", (F.col("_ge") + 1) / (F.col("n_runs") + 1)).drop("_ge")


def calibration(spark: SparkSession, panel: DataFrame | None = None, reps: int = 1000, n_tickers: int = 60, bars: int = 4000, h: int = 10, entries: int = 80, pool: int = 400, shared: int = 150) -> DataFrame:
    """How often tests of a zero edge reject at 5 % (one-sided), by design, and their errors beside the true ones.

    panel: bars whose paths are kept while entries are drawn anew; of these the first n_tickers
    by name that have nine tenths of the longest history. Without it only simulated designs
    run. A repetition is a row that a task simulates alone. size_ok: not anti-conservative.
    """
    fixed = days = None
    if panel is not None:
        n = panel.groupBy("ticker").agg(F.count("close").alias("n"))
        long = n.join(n.agg(F.max("n").alias("most")), F.col("n") >= 0.9 * F.col("most"), "left_semi").orderBy("ticker").limit(n_tickers)
        # one row for each of n_tickers tickers and date of history
        wide = panel.join(F.broadcast(long.select("ticker")), "ticker", "left_semi").select("ticker", "date", "close").toPandas().pivot(index="date", columns="ticker", values="close").sort_index()
        days = wide.index.to_numpy().astype("datetime64[D]")
        fixed = forward_by_position(wide.to_numpy(float).T, h)
    designs = (*REAL, *SIMULATED) if panel is not None else SIMULATED

    def run(batches):
        weekdays = np.busday_offset("2010-01-04", np.arange(bars))
        for pdf in batches:
            out = []
            for design, rep in zip(pdf["design"], pdf["rep"], strict=True):
                gen, fwd, vol, on = rng(f"calibration:{design}:{rep}"), fixed, None, days
                if design in SIMULATED:
                    close, vol = simulate_panel(gen, n_tickers, bars)
                    fwd, on = forward_by_position(close, h), weekdays
                at = entries_of(design, gen, fwd, vol, entries, pool, shared)
                out += [(design, test, int(rep), p, est, se) for test, p, est, se in size_tests(fwd, at, on, h)]
            yield pd.DataFrame(out, columns=["design", "test", "rep", "p", "est", "se"])

    jobs = spark.range(reps).withColumnRenamed("id", "rep").withColumn("design", F.explode(F.array(*[F.lit(d) for d in designs])))
    rows = jobs.repartition(max(2, reps // 50) * len(designs), "design", "rep").mapInPandas(run, "design string, test string, rep long, p double, est double, se double")
    known = F.when(~F.isnan("se"), F.col("se"))
    g = rows.groupBy("design", "test").agg(F.count(F.lit(1)).alias("reps"), F.avg((F.col("p") < 0.05).cast("double")).alias("rejection_rate"), F.avg("est").alias("mean_estimate"), F.avg(known).alias("mean_reported_se"), F.stddev_samp("est").alias("empirical_sd"))
    rate, error = F.col("rejection_rate"), F.sqrt(F.lit(0.05 * 0.95) / F.col("reps"))
    verdict = F.when(rate > 0.05 + 2.5 * F.col("mc_se"), "anti-conservative").when(rate < 0.05 - 2.5 * F.col("mc_se"), "conservative").otherwise("calibrated")
    g = g.withColumn("mc_se", error).withColumn("size_verdict", verdict)
    return g.withColumn("size_ok", F.col("size_verdict") != "anti-conservative").withColumn("se_ratio", F.try_divide("mean_reported_se", "empirical_sd"))
