"""Trades: what a bar's entry returns over horizons of bars, and what it costs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.operators.indicators import W, ahead
from panelforge.params import HORIZONS, CostParams


def forward_columns(bars: DataFrame, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """_out_h, _top_h, _low_h: the close h bars on, and the extremes of the h bars until then.

    Made once for each bar, so trades are an equi-join whatever the horizon.
    """
    new: dict[str, Column] = {}
    for h in horizons:
        new |= {f"_out_{h}": F.lead("close", h).over(W()), f"_top_{h}": F.max("high").over(ahead(h)), f"_low_{h}": F.min("low").over(ahead(h))}
    return bars.withColumns(new)


def backtest(events: DataFrame, bars: DataFrame, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """A row for each event and horizon that ends within the series; directions are 1 or -1.

    An entry that is no positive finite number makes no trade, nor does an exit that is no
    finite number: such a trade has no return.
    """
    keep = [c for h in horizons for c in (f"_out_{h}", f"_top_{h}", f"_low_{h}")]
    fwd = forward_columns(bars, horizons).select("ticker", "date", F.col("close").alias("entry_price"), *keep)
    rows = events.drop("close").join(fwd, ["ticker", "date"])
    direction = F.when(F.abs("direction") == 1, F.col("direction")).otherwise(F.raise_error(F.lit("a direction is 1 or -1")).cast("int"))
    legs = F.array(*[F.struct(F.lit(h).alias("holding_period"), F.col(f"_out_{h}").alias("exit_price"), F.col(f"_top_{h}").alias("_top"), F.col(f"_low_{h}").alias("_low")) for h in horizons])
    finite = lambda c: ~F.isnan(c) & (F.abs(c) < float("inf"))
    rows = rows.filter((F.col("entry_price") > 0) & finite("entry_price")).withColumn("direction", direction)
    rows = rows.withColumn("_leg", F.explode(legs)).filter(finite("_leg.exit_price"))
    move = lambda c: F.col(c) / F.col("entry_price") - 1
    up = F.col("direction") == 1
    return rows.select(
        "ticker", "date", "signal", "direction", "ordinal", "_leg.holding_period", "entry_price", "_leg.exit_price",
        (F.col("direction") * move("_leg.exit_price")).alias("fwd_return"),
        F.when(up, move("_leg._top")).otherwise(-move("_leg._low")).alias("mfe"), F.when(up, move("_leg._low")).otherwise(-move("_leg._top")).alias("mae"),
    )


def bars_read(pos: Column, h: int, n: Column) -> Column:
    """Positions that a trade entered at pos reads; empty if it ends past the series."""
    return F.when(pos + h <= n, F.sequence(pos + 1, pos + h)).otherwise(F.array().cast("array<int>"))


def unit_draw(seed: int, *key: str) -> Column:
    """Uniform in [0, 1) by the row's identity alone: 52 bits of a digest."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / 2.0**52


def with_costs(trades: DataFrame, p: CostParams = CostParams(), seed: int = 42) -> DataFrame:
    """cost_bps and net_return; a trade's slippage depends on what it is, not on where it stands."""
    w = Window.partitionBy("ticker", "date", "signal", "holding_period").orderBy("entry_price", "exit_price")
    rows = trades.withColumn("nth", F.row_number().over(w) - 1)
    u = unit_draw(seed, "ticker", "date", "signal", "holding_period", "nth")
    cost = p.fixed + p.spread + p.slip_low + (p.slip_high - p.slip_low) * u
    return rows.withColumn("cost_bps", cost).withColumn("net_return", F.col("fwd_return") - F.col("cost_bps") / 1e4).drop("nth")


def cost_grid(trades: DataFrame, grid: Sequence[float] = (0, 5, 10, 20, 40, 60), column: str = "fwd_return") -> DataFrame:
    """Mean net return and win rate of each signal under flat costs."""
    rows = trades.withColumn("cost_bps", F.explode(F.array(*[F.lit(float(x)) for x in grid])))
    net = F.col(column) - F.col("cost_bps") / 1e4
    return rows.groupBy("signal", "cost_bps").agg(F.count(F.lit(1)).alias("n_trades"), F.avg(net).alias("mean_net_return"), F.avg((net > 0).cast("double")).alias("win_rate"))


def breakeven(trades: DataFrame, excess: DataFrame | None = None) -> DataFrame:
    """Costs in basis points that eat a signal's mean return, and its mean excess (signal, excess)."""
    out = trades.groupBy("signal").agg(F.count(F.lit(1)).alias("n_trades"), (F.avg("fwd_return") * 1e4).alias("breakeven_bps"))
    if excess is None:
        return out
    return out.join(excess.select("signal", (F.col("excess") * 1e4).alias("breakeven_excess_bps")), "signal", "left")


def net_of_cost(costed: DataFrame) -> DataFrame:
    return costed.groupBy("signal").agg(
        F.count(F.lit(1)).alias("n_trades"), F.avg("fwd_return").alias("gross_mean"), F.avg("net_return").alias("net_mean"),
        F.avg((F.col("net_return") > 0).cast("double")).alias("net_win_rate"), F.avg("cost_bps").alias("mean_cost_bps"),
    )
