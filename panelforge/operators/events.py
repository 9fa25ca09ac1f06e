"""From bars to events: all detectors on one panel, the fail-closed registry, the long table."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelforge.operators import detectors as D
from panelforge.operators.states import all_machines
from panelforge.params import BASELINES, MIN_BARS, REGISTRY, BaselineParams, PriceActionParams, StructureParams
from panelforge.sources.panel import long_enough

#: Detectors that others have added: name -> (function, {signal: direction}).
EXTRA: dict[str, tuple[Callable[[DataFrame], DataFrame], dict[str, int]]] = {}


class UnregisteredSignal(ValueError):
    """A boolean column that is neither a registered signal nor a label."""


def detector(**signals: int):
    """Registers a function that adds these boolean columns, each with its direction."""
    if any(d not in (1, -1) for d in signals.values()):
        raise ValueError("a direction is 1 or -1")

    def register(fn: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        EXTRA[fn.__name__] = (fn, signals)
        return fn

    return register


def registry() -> dict[str, int]:
    return REGISTRY | {k: v for _, s in EXTRA.values() for k, v in s.items()}


def event_columns(df: DataFrame, known: dict[str, int]) -> list[str]:
    """Boolean columns to trade, in wide order; labels are left out, unknown ones raise."""
    found = [f.name for f in df.schema.fields if isinstance(f.dataType, T.BooleanType) and not f.name.endswith("_label")]
    if unknown := [c for c in found if c not in known]:
        raise UnregisteredSignal(f"not registered: {', '.join(unknown)}")
    return found


def detect_all(bars: DataFrame, pa: PriceActionParams = D.PA, st: StructureParams = D.ST) -> DataFrame:
    """The wide frame: every detector's columns on every bar."""
    df = D.displacement(bars, pa)
    df = D.volume_imbalance(df)
    df = D.balanced_range(D.fair_value_gap(df, pa))
    df = D.order_blocks(df, pa)
    df = D.liquidity_sweep(df, pa)
    df = D.opening_gaps(df, pa)
    df = D.equal_levels(df, st)
    df = D.adaptive_gap(df, st)
    df = all_machines(df, pa, st)
    for fn, _ in EXTRA.values():
        df = fn(df)
    return df


def detect_baselines(bars: DataFrame, p: BaselineParams = D.BL, seed: int = 42) -> DataFrame:
    return D.random_entry(D.momentum_turn(D.breakout(D.rsi_reversion(D.ema_cross(bars, p), p), p), p), p, seed)


def to_events(wide: DataFrame, known: dict[str, int] | None = None, columns: Iterable[str] | None = None) -> DataFrame:
    """ticker, date, pos, signal, direction, ordinal, close of each signal that fired."""
    known = registry() if known is None else known
    names = event_columns(wide, known) if columns is None else list(columns)
    order = list(known)
    entries = [F.when(F.col(c), F.struct(F.lit(c).alias("signal"), F.lit(known[c]).alias("direction"), F.lit(order.index(c)).alias("ordinal"))) for c in names]
    rows = wide.select("ticker", "date", "pos", "close", F.explode(F.array_compact(F.array(*entries))).alias("_e"))
    return rows.select("ticker", "date", "pos", "_e.signal", "_e.direction", "_e.ordinal", "close")


def events_of(bars: DataFrame, least: int = MIN_BARS, pa: PriceActionParams = D.PA, st: StructureParams = D.ST) -> DataFrame:
    """Events of every ticker with enough bars; the registry is checked before anything runs."""
    return to_events(detect_all(long_enough(bars, least), pa, st))


def baseline_events(bars: DataFrame, least: int = MIN_BARS, p: BaselineParams = D.BL, seed: int = 42) -> DataFrame:
    return to_events(detect_baselines(long_enough(bars, least), p, seed), BASELINES, BASELINES)


def combinations(events: DataFrame, least: int = 100, top: int = 60) -> DataFrame:
    """Events of the commonest pairs of signals of one ticker, bar and direction, named a+b."""
    e = events.select("ticker", "date", "pos", "direction", "close", "signal").distinct()
    sets = e.groupBy("ticker", "date", "pos", "direction", "close").agg(F.array_sort(F.collect_set("signal")).alias("_s"))
    # a bar has few signals, so its pairs are few
    pairs = F.flatten(F.transform("_s", lambda a, i: F.transform(F.slice("_s", i + 2, F.size("_s")), lambda b: F.concat_ws("+", a, b))))
    rows = sets.filter(F.size("_s") > 1).withColumn("signal", F.explode(pairs)).drop("_s")
    best = rows.groupBy("signal").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least).orderBy(F.desc("_n"), "signal").limit(top)
    return rows.join(F.broadcast(best.select("signal")), "signal").select("ticker", "date", "pos", "signal", "direction", F.lit(0).alias("ordinal"), "close")


def occurrence(trades: DataFrame) -> DataFrame:
    """nth: how many rows of the same identity stand before."""
    w = Window.partitionBy("ticker", "date", "signal", "holding_period").orderBy("entry_price", "exit_price")
    return trades.withColumn("nth", F.row_number().over(w) - 1)
