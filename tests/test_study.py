"""The stages end to end over the smallest panel, and what they leave."""

import pytest
from pyspark.sql import functions as F

from panelforge.plans.study import Study
from panelforge.sources import panel as P
from panelforge.sources import sinks


def test_stages_and_artifacts(spark, tmp_path):
    bars = sinks.write_table(P.with_position(P.bars_from_lineitem(spark, "/root/testdata/sf0.001").drop("pos").filter("ticker in ('AF', 'NO')")), f"{tmp_path}/bars")
    s = Study(spark, bars, str(tmp_path), horizons=(5, 10), bootstrap_runs=100, sectors=spark.createDataFrame([("AF", "X")], "ticker string, sector string"))
    took = s.run(skip=["walkforward", "montecarlo"])
    assert list(took) == ["detect", "baseline", "backtest", "statistics", "analyze", "costs"]
    assert sinks.read_manifest(spark, f"{tmp_path}/manifest.json")["primary"] == 10
    wanted = {f"{tmp_path}/events": (100, ["signal", "direction"]), f"{tmp_path}/trades": (100, ["fwd_return", "mfe", "mae"]), f"{tmp_path}/statistics_master": (20, ["beats_matched_random", "vs_zero_adjusted"])}
    assert sinks.check_artifacts(spark, wanted) == []
    faults = sinks.check_artifacts(spark, {f"{tmp_path}/none": (1, []), f"{tmp_path}/events": (10**9, ["nope"])})
    assert len(faults) == 3
    trades = s.table("trades")
    assert trades.filter("mfe < mae").count() == 0 and trades.select("holding_period").distinct().count() == 2
    m = s.table("statistics_master")
    assert m.filter("beats_matched_random and excess_return_vs_matched_random <= 0").count() == 0
    assert m.filter((F.col("vs_zero_adjusted") < F.col("p_value_vs_zero") - 1e-12)).count() == 0
    with pytest.raises(ValueError):
        s.run(["nothing"])


def test_exports_and_samples(spark, tmp_path):
    df = spark.range(50).withColumn("x", F.col("id") / 3)
    assert sinks.export(df, f"{tmp_path}/out") == {"csv": 50, "json": 50}
    a, b = (sorted(r["id"] for r in sinks.sample_rows(d, 7).collect()) for d in (df, df.repartition(5)))
    assert a == b and len(a) == 7 and sinks.sample_rows(df, 99).count() == 50
