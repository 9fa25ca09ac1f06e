"""Tails as expressions, faulty prices, combinations, sweeps and the tables behind reports."""

import math

import pytest
from pyspark.sql import functions as F

from panelforge.functions.distributions import normal_p
from panelforge.operators import analysis as A
from panelforge.operators import reports as V
from panelforge.operators import trades as B
from panelforge.sources import sinks


def test_normal_tails(spark):
    z = [0.0, 1e-9, 0.3, 0.6628, 0.67, 1.0, -1.0, 1.959963984540054, -2.5, 4.0, 5.65, 5.7, 8.0, -8.0, 20.0, 37.0, float("inf"), float("-inf")]
    df = spark.createDataFrame([(x,) for x in [*z, None, float("nan")]], "z double")
    for alternative, want in (("greater", lambda u: u), ("less", lambda u: 1 - u), ("two-sided", lambda u: min(1.0, 2 * min(u, 1 - u)))):
        got = {r["z"]: r["p"] for r in df.select("z", normal_p(F.col("z"), alternative).alias("p")).collect() if r["z"] is not None and not math.isnan(r["z"])}
        assert len(got) == len(z) and all(math.isclose(p, want(0.5 * math.erfc(x / math.sqrt(2))), rel_tol=1e-12, abs_tol=1e-15) for x, p in got.items())
    assert [r["p"] for r in df.filter("z is null or isnan(z)").select(normal_p(F.col("z")).alias("p")).collect()] == [None, None]
    with pytest.raises(ValueError, match="unknown alternative"):
        normal_p(F.col("z"), "both")


def test_trades_need_finite_prices(spark):
    closes = [10.0, float("nan"), 12.0, float("inf"), 0.0, -3.0, 11.0, 12.0]
    bars = spark.createDataFrame([("A", i, f"2020-01-{i + 1:02d}", c, 13.0, 9.0) for i, c in enumerate(closes)], "ticker string, pos int, date string, close double, high double, low double").withColumn("date", F.to_date("date"))
    events = bars.select("ticker", "date", "pos", F.lit("s").alias("signal"), F.lit(1).alias("direction"), F.lit(0).alias("ordinal"), "close")
    got = {(r["date"].day, r["holding_period"]): round(r["fwd_return"], 6) for r in B.backtest(events, bars, [1, 2, 6]).collect()}
    # a return of a finite entry to a finite exit, whatever the exit's sign, as every such exit is a price of the panel
    assert got == {(1, 2): 0.2, (1, 6): 0.1, (3, 2): -1.0, (7, 1): round(12 / 11 - 1, 6)}


def test_sector_checks(spark):
    official = spark.createDataFrame([("A", "x"), ("B", "y"), ("C", "z")], "ticker string, sector string")
    curated = spark.createDataFrame([("A", "x"), ("B", "z"), ("Q", "x")], "ticker string, sector string")
    assert sorted(map(tuple, A.sector_disagreements(official, curated).collect())) == [("B", "z", "y", "mismatch"), ("C", "(absent -> Unknown)", "z", "missing")]
    twice = spark.createDataFrame([("A", "x"), ("A", "y"), ("A", "x"), ("B", "y"), ("B", "y")], "ticker string, sector string")
    assert [tuple(r) for r in A.repeated_assignments(twice).collect()] == [("A", ["x", "y"])]


def test_versions_and_markdown(spark):
    now = spark.createDataFrame([("a", 1.0), ("b", -2.0), ("d", 4.0)], "signal string, x double")
    before = spark.createDataFrame([("a", 0.5), ("b", 2.0), ("c", 1.0)], "signal string, x double")
    got = {r["signal"]: (r["change"], r["sign_preserved"], r["state"]) for r in V.compare_versions(now, before, ["signal"], "x").collect()}
    assert got == {"a": (0.5, True, "in_both"), "b": (-4.0, False, "in_both"), "c": (None, None, "removed"), "d": (None, None, "added")}
    text = V.to_markdown(now.orderBy("signal"))
    assert text.splitlines()[:3] == ["| signal | x |", "|-|-|", "| a | 1 |"]
    with pytest.raises(ValueError, match="no report"):
        V.to_markdown(spark.range(300))


def test_snapshot_and_invariants(spark, tmp_path):
    rows = spark.createDataFrame([("a", 5, 0.2, True), ("b", 3, 0.01, False)], "signal string, n_trades int, p double, beats boolean")
    sinks.save_snapshot(rows, f"{tmp_path}/snap")
    assert sinks.read_snapshot(spark, f"{tmp_path}/snap", rows.schema).orderBy("signal").collect() == rows.orderBy("signal").collect()
    faults = sinks.check_invariants(rows, {"p is a probability": "p between 0 and 1", "winners are significant": "not beats or p < 0.05", "enough trades": "n_trades >= 3 and signal is not null"})
    assert faults == ["winners are significant: 1 rows"]
    bars = spark.createDataFrame([(t, i) for t in "abcd" for i in range(5)], "ticker string, i int")
    assert {r["ticker"] for r in sinks.copy_sample(bars, f"{tmp_path}/sample", 2).collect()} == {"a", "b"}


def test_simulated_panel_as_bars(spark):
    from panelforge.sources.panel import simulated_bars

    bars = simulated_bars(spark, 12, 300)
    assert bars.count() == 3600 and bars.filter("high < greatest(open, close) or low > least(open, close) or volume <= 0").count() == 0
    assert bars.orderBy("ticker", "date").collect() == simulated_bars(spark, 12, 300).repartition(2).orderBy("ticker", "date").collect()
