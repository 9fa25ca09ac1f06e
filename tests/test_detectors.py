"""Detectors on constructed bars, and the rule that no event reads a later bar."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelforge.functions.machines import BlockState, PoolState, ShiftState
from panelforge.operators import detectors as D
from panelforge.operators import events as E
from panelforge.operators import indicators as I
from panelforge.operators import states
from panelforge.params import REGISTRY, PriceActionParams, StructureParams
from panelforge.sources.panel import with_position


def panel(spark, rows, ticker="T"):
    days = pd.bdate_range("2020-01-01", periods=len(rows))
    data = [(ticker, d.date(), *map(float, r), 1e6) for d, r in zip(days, rows, strict=True)]
    return with_position(spark.createDataFrame(data, "ticker string, date date, open double, high double, low double, close double, volume double"))


def walk(n=500, seed=3):
    """A random walk with a large clean bar every so often, so that gaps and displacements occur."""
    rng, price, rows = np.random.default_rng(seed), 100.0, []
    for i in range(n):
        step = rng.normal(0, 0.01) + (rng.choice([-1, 1]) * rng.uniform(0.05, 0.09) if i % 14 == 7 else 0)
        o, c = price, price * (1 + step)
        wick = 0.0005 if i % 14 == 7 else 0.004
        rows.append((o * (1 + rng.normal(0, 0.001)), max(o, c) * (1 + wick), min(o, c) * (1 - wick), c))
        price = c
    return rows


def dates(df, column):
    return [r["date"] for r in df.filter(column).orderBy("date").collect()]


def test_gap_forms_on_the_bar_after_displacement_and_fills_later(spark):
    flat = [(100, 100.05, 99.95, 100)] * 60
    rows = flat + [(100, 112.02, 99.98, 112), (113, 115, 112.5, 114)] + [(114, 114.05, 113.95, 114)] * 20
    formed = D.fair_value_gap(panel(spark, rows))
    got = formed.filter("ict_fvg_bullish_formed").collect()
    assert len(got) == 1 and got[0]["pos"] == 62
    assert got[0]["ict_fvg_bullish_lower"] == 100.05 and got[0]["ict_fvg_bullish_upper"] == 112.5
    assert not got[0]["ict_fvg_bullish_filled_label"]
    dipped = rows[:70] + [(114, 114.05, 99, 114)] + rows[71:]
    assert D.fair_value_gap(panel(spark, dipped)).filter("ict_fvg_bullish_formed").first()["ict_fvg_bullish_filled_label"]


def test_truncation_leaves_events_alone_and_the_probe_sees_a_leak(spark):
    rows, cut = walk(420), 330
    whole, part = panel(spark, rows), panel(spark, rows[:cut])
    small = StructureParams(swing_len=15, equal_atr=20, ob_atr=20)
    e = lambda b: {tuple(r) for r in E.to_events(E.detect_all(b, PriceActionParams(daily_gaps=True), small)).filter(F.col("pos") <= cut).select("date", "signal").collect()}
    a, b = e(whole), e(part)
    assert a == b
    assert len({s for _, s in a}) >= 12
    # the label does read later bars: cut right after a gap that is filled, and it changes
    at = D.fair_value_gap(whole).filter("ict_fvg_bullish_filled_label").agg(F.min("pos")).first()[0]
    assert not D.fair_value_gap(panel(spark, rows[:at])).filter(F.col("pos") == at).first()["ict_fvg_bullish_filled_label"]


def test_unregistered_column_raises_and_labels_are_left_out(spark):
    bars = panel(spark, walk(20))
    with pytest.raises(E.UnregisteredSignal):
        E.to_events(bars.withColumn("surprise", F.lit(True)))
    assert E.event_columns(bars.withColumn("x_label", F.lit(True)), REGISTRY) == []
    assert all(d in (1, -1) for d in REGISTRY.values()) and len(REGISTRY) == 46


def naive_structure(rows, size, cap=100):
    """Breaks and blocks of one scale, bar by bar."""
    out, leg, last = [], 0, None
    level, crossed, pivot, bias = [None, None], [True, True], [0, 0], 0
    blocks = ([], [])
    for i, (_, h, l, c) in enumerate(rows):
        if i >= size:
            if rows[i - size][1] > max(r[1] for r in rows[i - size + 1 : i + 1]):
                leg = 0
            elif rows[i - size][2] < min(r[2] for r in rows[i - size + 1 : i + 1]):
                leg = 1
        if last is not None and leg != last:
            side = leg
            level[side], crossed[side], pivot[side] = rows[i - size][1 + side], False, i - size
        last = leg
        fired = [False] * 4
        if i and level[0] is not None and not crossed[0] and c > level[0] >= rows[i - 1][3]:
            fired[1 if bias == -1 else 0] = True
            bias, crossed[0] = 1, True
            blocks[0].append(min(r[2] for r in rows[pivot[0] : i]))
            del blocks[0][: max(0, len(blocks[0]) - cap)]
        if i and level[1] is not None and not crossed[1] and c < level[1] <= rows[i - 1][3]:
            fired[3 if bias == 1 else 2] = True
            bias, crossed[1] = -1, True
            blocks[1].append(max(r[1] for r in rows[pivot[1] : i]))
            del blocks[1][: max(0, len(blocks[1]) - cap)]
        hit = [any(l < x for x in blocks[0]), any(h > x for x in blocks[1])]
        blocks = ([x for x in blocks[0] if not l < x], [x for x in blocks[1] if not h > x])
        out.append((*fired, *hit))
    return out


@pytest.mark.parametrize("cap", [100, 2])
def test_structure_against_a_plain_machine(spark, cap):
    rows = walk(400, 11)
    p = StructureParams(swing_len=6, internal_len=3, ob_atr=1000, ob_cap=cap)  # no ATR yet: highs and lows as they are
    df = states.live_blocks(panel(spark, rows), p).orderBy("pos").toPandas()
    names = [f"smc_swing_{k}" for k in ("bos_bullish", "choch_bullish", "bos_bearish", "choch_bearish", "ob_bullish_mitigated", "ob_bearish_mitigated")]
    assert [tuple(map(bool, r)) for r in df[names].itertuples(index=False)] == naive_structure(rows, 6, cap)


def test_recurrence_over_blocks_of_any_length(spark):
    rng = np.random.default_rng(1)
    x = rng.uniform(1, 2, 3000)
    rows = [(v, v + 0.1, v - 0.1, v) for v in x]
    got = I.ema(panel(spark, rows), "close", 3, "y").orderBy("pos").toPandas()["y"].to_numpy()
    want, y = [], x[0]
    for v in x:
        y += 0.5 * (v - y)
        want.append(y)
    assert np.allclose(got, want, rtol=1e-12, atol=0)


def test_machines():
    s = ShiftState()
    assert s.step(11, 10, 5) == (True, False, False, False)
    assert s.step(12, 10, 5) == (False,) * 4  # the level was used
    assert s.step(13, 12.5, 5) == (False, False, True, False)
    assert s.step(4, 12.5, 5) == (False, True, False, False)
    assert s.step(5, None, 5) == (False,) * 4
    pool = PoolState(PriceActionParams(pool_margin=10.0))
    for p in (100.0, 100.2):
        assert not any(pool.step(90, p, None, 1.0)) and not any(pool.step(90, None, 50.0, 0.0))
    assert pool.step(90, 100.1, None, 1.0)[0]
    assert pool.step(99.5, None, None, 1.0)[1] and not pool.step(99.5, None, None, 1.0)[1]
    b = BlockState(1)
    b.step(10, 9, 8.0, None)
    b.step(10, 9, 7.0, None)  # pushes the first out
    assert b.step(10, 7.5, None, None) == (False, False) and b.step(10, 6, None, None) == (True, False)


def test_extra_detector_and_direction_check(spark):
    @E.detector(my_signal=1)
    def mine(df):
        return df.withColumn("my_signal", F.col("pos") == 5)

    try:
        assert E.registry()["my_signal"] == 1
        assert E.to_events(mine(panel(spark, walk(10)))).select("signal").first()[0] == "my_signal"
    finally:
        E.EXTRA.clear()
    with pytest.raises(ValueError):
        E.detector(x=0)


def test_stream_equals_batch(spark, tmp_path):
    from panelforge.streaming.detect import displacement_stream

    bars = panel(spark, walk(200)).select("ticker", "date", "open", "high", "low", "close")
    for i, (lo, hi) in enumerate(((1, 80), (81, 200))):
        with_pos = with_position(bars).filter(F.col("pos").between(lo, hi)).drop("pos")
        with_pos.coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(bars.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    q = displacement_stream(stream).writeStream.format("memory").queryName("moves").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    got = {tuple(r) for r in spark.sql("select date, direction from moves").collect()}
    want = E.to_events(D.displacement(panel(spark, walk(200))), REGISTRY, ["ict_displacement_bullish", "ict_displacement_bearish"])
    assert got == {tuple(r) for r in want.select("date", "direction").collect()} and got


def test_empty_panel(spark):
    none = panel(spark, walk(5)).filter("pos > 9")
    wide = E.detect_all(none)
    assert E.to_events(wide).count() == 0 and wide.columns == E.detect_all(panel(spark, walk(5))).columns
