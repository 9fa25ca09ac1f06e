"""Weeks and months of a stream of bars equal those of the panel."""

import pandas as pd

from panelforge.sources.panel import simulated_bars
from panelforge.streaming.rollup import monthly, weekly


def test_weeks_and_months(spark, tmp_path):
    bars = simulated_bars(spark, 3, 130).drop("pos").cache()
    pdf = bars.toPandas()
    pdf["date"] = pd.to_datetime(pdf["date"])
    for name, fold, key in (("week", weekly, pdf["date"] - pd.to_timedelta(pdf["date"].dt.weekday, unit="D")), ("month", monthly, pdf["date"].dt.to_period("M").dt.to_timestamp())):
        ordered = pdf.assign(k=key).sort_values("date")
        want = {(t, k.date()): (g["open"].iloc[0], g["high"].max(), g["low"].min(), g["close"].iloc[-1], len(g)) for (t, k), g in ordered.groupby(["ticker", "k"])}
        assert {(r["ticker"], r[name]): (r["open"], r["high"], r["low"], r["close"], r["n_bars"]) for r in fold(bars).collect()} == want
        mode = "append" if name == "week" else "update"
        for i, (_, part) in enumerate(pdf.sort_values("date").groupby(pdf["date"].dt.to_period("M"))):
            spark.createDataFrame(part.assign(date=part["date"].dt.date), bars.schema).coalesce(1).write.parquet(f"{tmp_path}/{name}/{i:02d}")
        stream = spark.readStream.schema(bars.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/{name}")
        q = fold(stream).writeStream.format("memory").outputMode(mode).queryName(f"{name}s").option("checkpointLocation", f"{tmp_path}/cp-{name}").start()
        q.processAllAvailable()
        q.stop()
        seen = {}
        for r in spark.table(f"{name}s").collect():
            best = seen.get((r["ticker"], r[name]))
            seen[r["ticker"], r[name]] = max(filter(None, (best, (r["n_bars"], r["open"], r["high"], r["low"], r["close"]))))
        got = {k: (o, h, lo, c, n) for k, (n, o, h, lo, c) in seen.items()}
        assert got and all(want[k] == v for k, v in got.items())
        assert len(got) >= (len(want) if name == "month" else len(want) - 3 * 3)  # the watermark holds the last weeks open
