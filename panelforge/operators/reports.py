"""Tables behind reports, figures and views, each a plan over the tables of the study."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.operators.analysis import rank_concepts


def headline(trades: DataFrame) -> DataFrame:
    """Signals, tickers, trades, span in years, and how many trades won."""
    years = (F.datediff(F.max("date"), F.min("date")) / 365.25).alias("years")
    return trades.agg(F.count_distinct("signal").alias("n_signals"), F.count_distinct("ticker").alias("n_tickers"), F.count(F.lit(1)).alias("n_trades"), years, F.count_if(F.col("fwd_return") > 0).alias("n_wins"))


def stock_view(trades: DataFrame, ticker: str) -> DataFrame:
    """What each signal did in one ticker over each horizon."""
    return trades.filter(F.col("ticker") == ticker).groupBy("signal", "holding_period").agg(F.count(F.lit(1)).alias("n"), F.avg("fwd_return").alias("avg_return"), F.avg("mfe").alias("avg_mfe"))


def concept_view(trades: DataFrame, signal: str) -> DataFrame:
    """One signal year by year."""
    return trades.filter(F.col("signal") == signal).groupBy(F.year("date").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.avg("fwd_return").alias("avg_return"), F.percentile("fwd_return", F.lit(0.9)).alias("p90"))


def combinations_view(ranked: DataFrame, top: int = 20) -> DataFrame:
    """The combinations with the highest Sharpe ratios."""
    place = F.row_number().over(Window.orderBy(F.desc_nulls_last("sharpe"), "combination"))  # at most as many rows as pairs were ranked
    return ranked.withColumn("place", place).filter(F.col("place") <= top).select("place", "combination", "n_trades", "sharpe", "beats_matched_random")


def rankings_view(matched: DataFrame, h: int, top: int = 10) -> DataFrame:
    """The first signals of one horizon's ranking."""
    return rank_concepts(matched, h).filter(F.col("rank") <= top)


def regime_heatmap(regimes: DataFrame, vols: Sequence[str] = ("low_vol", "normal_vol", "high_vol")) -> DataFrame:
    """Mean excess of each trend, a column for each state of volatility."""
    return regimes.groupBy("trend_regime").pivot("vol_regime", list(vols)).agg(F.avg("excess_return"))


def sector_bars(sectors: DataFrame) -> DataFrame:
    """Sectors by excess, and whether it is positive."""
    place = F.row_number().over(Window.orderBy(F.desc_nulls_last("excess_return"), "sector"))  # one row for each sector
    return sectors.select("sector", "excess_return", (F.col("excess_return") > 0).alias("positive"), place.alias("place"))


def validation_counts(quality: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Tickers of each status; of those wanted, the ones without any row have no data."""
    rows = quality.select("ticker", "status")
    if wanted is not None:
        rows = rows.unionByName(wanted.join(quality, "ticker", "left_anti").select("ticker", F.lit("NO_DATA").alias("status")))
    return rows.groupBy("status").agg(F.count(F.lit(1)).alias("n_tickers"))


def forest(dated: DataFrame, z: float = 1.959963984540054) -> DataFrame:
    """Excess of each signal with its interval, for a forest plot: bounds in basis points."""
    bps = lambda c: (c * 1e4)
    x, se = F.col("excess_return"), F.col("se")
    return dated.select("signal", "holding_period", bps(x).alias("excess_bps"), bps(x - z * se).alias("lower_bps"), bps(x + z * se).alias("upper_bps"), ((x - z * se > 0) | (x + z * se < 0)).alias("clear"))


def timeline(events: DataFrame) -> DataFrame:
    """Events of each signal and year."""
    return events.groupBy("signal", F.year("date").alias("year")).agg(F.count(F.lit(1)).alias("n_events"))


def compare_versions(now: DataFrame, before: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Two versions of a result: rows of either, by how much the value moved, and whether its sign stayed."""
    a, b = now.select(*keys, F.col(value).alias("now")), before.select(*keys, F.col(value).alias("before"))
    both = a.join(b, list(keys), "full_outer")
    state = F.when(F.col("before").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("in_both")
    return both.withColumns({"change": F.col("now") - F.col("before"), "sign_preserved": F.signum("now") == F.signum("before"), "state": state})


def section_facts(**tables: DataFrame) -> DataFrame:
    """(section, fact, value) of the study's tables that are given: costs, sectors, sweeps, folds, rotation, membership, calibration."""
    count = lambda c: F.count_if(c).cast("double")
    facts = {
        "costs": {"n_signals": F.count(F.lit(1)).cast("double"), "n_positive_gross": count(F.col("breakeven_bps") > 0), "n_positive_excess": count(F.col("breakeven_excess_bps") > 0), "median_breakeven_bps": F.median("breakeven_bps")},
        "sectors": {"n_sectors": F.count(F.lit(1)).cast("double"), "n_powered": count(F.col("adequately_powered")), "largest_excess_bps": F.max(F.abs("observed_excess_bps")), "smallest_mde_bps": F.min("mde_bps")},
        "sweeps": {"n_signals": F.count(F.lit(1)).cast("double"), "n_responding": count("responds_to_sweep"), "n_one_sign": count(F.col("sign_consistency") == 1), "widest_range_bps": F.max("swept_range_bps")},
        "folds": {"n_folds": F.count_distinct("fold").cast("double"), "mean_test_excess_bps": F.avg("test_excess") * 1e4, "share_positive": F.avg((F.col("test_excess") > 0).cast("double"))},
        "rotation": {"n_hypotheses": F.count("p_value").cast("double"), "n_below_5pct": count(F.col("p_value") < 0.05), "least_p": F.min("p_value")},
        "membership": {"n_signals": F.count("excess_delta_bps").cast("double"), "n_sign_kept": count(F.col("sign_preserved")), "median_shift_bps": F.median("excess_delta_bps")},
        "calibration": {"n_designs": F.count_distinct("design").cast("double"), "highest_rejection": F.max("rejection_rate"), "lowest_rejection": F.min("rejection_rate")},
    }
    out = None
    for section, table in tables.items():
        wanted = facts[section]
        row = table.agg(*[c.alias(k) for k, c in wanted.items()])
        part = row.select(F.lit(section).alias("section"), F.explode(F.array(*[F.struct(F.lit(k).alias("fact"), F.col(k).alias("value")) for k in wanted])).alias("_f")).select("section", "_f.fact", "_f.value")
        out = part if out is None else out.unionByName(part)
    return out


def to_markdown(rows: DataFrame, most: int = 200) -> str:
    """A report-sized table as text; longer ones are refused, not cut."""
    got = rows.limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"more than {most} rows are no report")
    shown = lambda v: "" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v).replace("|", "\\|")
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + "-|" * len(rows.columns)]
    return "\n".join(lines + ["| " + " | ".join(shown(v) for v in r) + " |" for r in got]) + "\n"
