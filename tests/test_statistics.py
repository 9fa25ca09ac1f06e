"""Trades, costs, metrics, tests and resampling against plain computations."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelforge.functions.distributions import norm_ppf, norm_sf, t_sf, tail_p
from panelforge.functions.seeds import derive_seed
from panelforge.operators import analysis as A
from panelforge.operators import resample as R
from panelforge.operators import stats as S
from panelforge.operators import trades as B
from panelforge.sources import panel as P


@pytest.fixture(scope="module")
def data(spark):
    rng, rows = np.random.default_rng(5), []
    days = pd.bdate_range("2015-01-01", periods=300)
    for t in range(4):
        close = 100 * np.cumprod(1 + rng.normal(0.0003 * t, 0.02, len(days)))
        rows += [(f"T{t}", d.date(), c, c * 1.01, c * 0.99, float(c), 1.0) for d, c in zip(days, map(float, close), strict=True)]
    bars = P.with_position(spark.createDataFrame(rows, P.BARS)).cache()
    picks = bars.filter(F.pmod(F.xxhash64("ticker", "date"), F.lit(9)) == 0)
    events = picks.select("ticker", "date", "pos", F.when(F.col("pos") % 2 == 0, "up").otherwise("down").alias("signal"), F.when(F.col("pos") % 2 == 0, 1).otherwise(-1).alias("direction"), F.lit(0).alias("ordinal"), "close")
    return bars, B.backtest(events, bars, [1, 5]).cache()


def test_trades_against_positions(data):
    bars, trades = data
    b = {t: g.sort_values("date").reset_index(drop=True) for t, g in bars.toPandas().groupby("ticker")}
    for r in trades.toPandas().sample(60, random_state=1).itertuples():
        g = b[r.ticker]
        i = g.index[g["date"] == r.date][0]
        out = r.direction * (g["close"][i + r.holding_period] / g["close"][i] - 1)
        top = g["high"][i + 1 : i + 1 + r.holding_period].max() / g["close"][i] - 1
        low = g["low"][i + 1 : i + 1 + r.holding_period].min() / g["close"][i] - 1
        assert math.isclose(out, r.fwd_return, abs_tol=1e-12)
        assert math.isclose(top if r.direction == 1 else -low, r.mfe, abs_tol=1e-12)


def test_zero_direction_raises(spark, data):
    bars, _ = data
    bad = bars.limit(3).select("ticker", "date", "pos", F.lit("x").alias("signal"), F.lit(0).alias("direction"), F.lit(0).alias("ordinal"), "close")
    with pytest.raises(Exception, match="direction"):
        B.backtest(bad, bars, [1]).collect()


def test_costs_depend_on_identity_alone(data):
    _, trades = data
    all_ = B.with_costs(trades).toPandas().set_index(["ticker", "date", "signal", "holding_period"])["cost_bps"]
    some = B.with_costs(trades.filter("ticker = 'T1'").orderBy(F.desc("date"))).toPandas().set_index(["ticker", "date", "signal", "holding_period"])["cost_bps"]
    assert (all_.loc[some.index] == some).all() and all_.between(11, 26).all()


def test_summary_and_calendar_test(data):
    _, trades = data
    keys = ["signal", "holding_period"]
    got = S.return_summary(trades, keys).toPandas().set_index(keys)
    cal = S.calendar_test(trades, keys, most_lag=5).toPandas().set_index(keys)
    for k, g in trades.toPandas().sort_values(["ticker", "date"]).groupby(keys):
        r = g["fwd_return"]
        row = got.loc[k]
        assert row["n_trades"] == len(r) and math.isclose(row["skewness"], r.skew(), rel_tol=1e-9) and math.isclose(row["kurtosis"], r.kurt(), rel_tol=1e-9)
        path = np.log1p(r).cumsum()
        assert math.isclose(row["max_drawdown"], np.expm1(path - path.cummax()).min(), abs_tol=1e-12)
        d = g.groupby("date")["fwd_return"].agg(["sum", "count"])
        idx = pd.bdate_range(d.index.min(), d.index.max()).date
        d = d.reindex(sorted(set(idx) | set(d.index)), fill_value=0)
        mu = d["sum"].sum() / d["count"].sum()
        x = ((d["sum"] - d["count"] * mu) / d["count"].sum()).to_numpy()
        v = x @ x + sum(2 * (1 - j / (k[1] + 1)) * (x[j:] @ x[:-j]) for j in range(1, k[1] + 1))
        assert math.isclose(cal.loc[k]["hac_se"], math.sqrt(v), rel_tol=1e-9)


def test_rotation_by_fft_equals_all_offsets(data):
    bars, trades = data
    got = R.rotation_null(trades, bars, [5]).toPandas().set_index("signal")
    b = bars.toPandas()
    days = sorted(b["date"].unique())
    at, T = {d: i for i, d in enumerate(days)}, len(days)
    paths = {t: g.sort_values("date")["close"].to_numpy() for t, g in b.groupby("ticker")}
    fwd = {t: np.append(c[5:] / c[:-5] - 1, [np.nan] * 5) for t, c in paths.items()}
    for signal, g in trades.filter("holding_period = 5").toPandas().groupby("signal"):
        mean = lambda o: np.nanmean([r.direction * fwd[r.ticker][(at[r.date] + o) % T] for r in g.itertuples()])  # noqa: E731, B023
        sims = np.array([mean(o) for o in range(6, T - 6)])
        row = got.loc[signal]
        assert row["n_offsets"] == len(sims) and math.isclose(row["null_mean"], sims.mean(), abs_tol=1e-12)
        assert math.isclose(row["p_value"], (1 + (sims >= mean(0) - 1e-12).sum()) / (len(sims) + 1), abs_tol=1e-12)


def test_simulated_null_agrees_with_closed_form(data):
    bars, trades = data
    sim = R.simulated_null(trades, bars, [5], 400).toPandas().set_index("signal")
    form = S.matched_null(trades.filter("holding_period = 5"), S.return_pools(bars, [5]), ["signal", "holding_period"]).toPandas().set_index("signal")
    for s in sim.index:
        assert abs(sim.loc[s, "null_mean"] - form.loc[s, "null_mean"]) < 4 * form.loc[s, "null_se"] / 20
        assert abs(sim.loc[s, "null_se"] / form.loc[s, "null_se"] - 1) < 0.15
    again = [R.simulated_null(t, bars, [5], 50).toPandas().sort_values("signal", ignore_index=True) for t in (trades, trades.repartition(3))]
    assert len(again[0]) and again[0].equals(again[1])


def test_false_discovery(spark):
    p = [0.001, 0.008, 0.039, 0.041, 0.042, 0.06, 0.074, 0.205, 0.212, None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(p)], "i int, p double")
    got = S.benjamini_hochberg(df, "p", "q").orderBy("i").toPandas()
    known = np.array(p[:-1])
    want = np.minimum.accumulate((known * 9 / np.arange(1, 10))[::-1])[::-1]
    assert np.allclose(got["q_adjusted"][:9], want) and pd.isna(got["q_adjusted"][9]) and not got["q_reject"][9]


def test_tails_and_seeds():
    assert derive_seed("AAPL", 42) == 3361008404
    assert math.isclose(norm_sf(1.959963984540054), 0.025, rel_tol=1e-12) and math.isclose(norm_ppf(0.8), 0.8416212335729143, rel_tol=1e-9)
    assert math.isclose(t_sf(2.570581835636314, 5), 0.025, rel_tol=1e-9) and math.isclose(t_sf(-1.0, 1), 0.75, rel_tol=1e-12)
    assert tail_p(0.03, "less") == 0.97 and tail_p(0.97, "two-sided") == pytest.approx(0.06)


def test_business_days(spark):
    days = pd.date_range("2024-01-01", periods=40)
    rows = [(a.date(), b.date()) for a in days[::3] for b in days[::4] if a <= b]
    got = spark.createDataFrame(rows, "a date, b date").select("a", "b", P.business_days(F.col("a"), F.col("b")).alias("n"), A.business_days_before(F.col("b"), 10).alias("p")).toPandas()
    for r in got.itertuples():
        assert r.n == np.busday_count(r.a, r.b)
        assert r.p == (pd.Timestamp(r.b) - pd.tseries.offsets.BDay(10)).date()


def test_bootstrap_is_reproducible_and_marks_subsamples(data):
    from panelforge.functions.simulation import bootstrap_interval

    x = np.random.default_rng(0).normal(0.1, 1, 25_000)
    a, b = bootstrap_interval(x, 200, "a"), bootstrap_interval(x, 200, "a")
    assert a == b and "subsample" in a["ci_method"] and a["ci_lower"] < a["mean"] < a["ci_upper"]
    assert bootstrap_interval(x[:4], 200, "a")["ci_method"] == "insufficient_data"


def test_membership_and_symbols(spark):
    df = spark.createDataFrame([("2020-06-01", "2020-06-01"), ("2020-05-31", "2020-06-01"), ("2020-05-31", None)], "d string, a string").select(F.to_date("d").alias("d"), F.to_date("a").alias("a"))
    assert [r[0] for r in df.select(P.is_member(F.col("d"), F.col("a"))).collect()] == [True, False, True]
    assert [r[0] for r in df.select(P.is_member(F.col("d"), F.col("a"), "drop")).collect()] == [True, False, False]
    assert spark.range(1).select(P.normal_symbol(F.lit(" BRK.B "), {"X": "Y"})).first()[0] == "BRK-B"


def test_sources_read_files(spark, tmp_path):
    spark.createDataFrame([("2020-01-02", 1.0, 0.5, 1.0, 1.5, 1.0), ("2020-01-02", 1.0, 3.0, 1.0, 1.5, 9.0)], "date string, open double, high double, low double, close double, volume double").coalesce(1).write.parquet(f"{tmp_path}/x")
    import glob
    import shutil

    (tmp_path / "panel").mkdir()
    shutil.copy(glob.glob(f"{tmp_path}/x/*.parquet")[0], tmp_path / "panel" / "AAA.parquet")
    rows = P.read_panel(spark, f"{tmp_path}/panel").collect()
    assert len(rows) == 1 and rows[0]["ticker"] == "AAA" and rows[0]["high"] == 1.5
    (tmp_path / "c.csv").write_text("#,Company,Symbol,Weight\n1,A Co,A.B,7.20%\n")
    assert P.read_constituents(spark, f"{tmp_path}/c.csv").first()["weight"] == 7.2
    assert P.first_readable(spark, [f"{tmp_path}/none", f"{tmp_path}/x"], "a int").count() == 2
