"""Detectors whose state feeds back, in a grouped map over batch panels.

The machines of functions.machines run here and in a keyed streaming query, so that both give
the same events. Inputs are columns that Window expressions have prepared.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from panelforge.functions.machines import BlockState, PoolState, ShiftState, values
from panelforge.operators.detectors import PA, ST, STRUCTURE, both_scales, zigzag
from panelforge.operators.indicators import atr
from panelforge.params import PriceActionParams, StructureParams


def _mapped(df: DataFrame, run, outputs: tuple[str, ...]) -> DataFrame:
    schema = T.StructType([*df.schema.fields, *[T.StructField(o, T.BooleanType()) for o in outputs]])

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date").reset_index(drop=True)
        return pd.concat([pdf, pd.DataFrame(list(run(pdf)), columns=list(outputs), dtype=bool)], axis=1)

    return df.groupBy("ticker").applyInPandas(whole, schema)


def _shifts_and_pools(pdf: pd.DataFrame, p: PriceActionParams):
    shift, pool = ShiftState(), PoolState(p)
    for close, top, bottom, ph, pl, a in values(pdf, "close", "_sh", "_sl", "_ph", "_pl", "_atr"):
        yield (*shift.step(close, top, bottom), *pool.step(close, ph, pl, a))


def _blocks(pdf: pd.DataFrame, p: StructureParams):
    states = [BlockState(p.ob_cap), BlockState(p.ob_cap)]
    for high, low, *rest in values(pdf, "high", "low", *[f"_{s}_{c}" for s in ("smc_swing", "smc_internal") for c in ("up", "btm", "dn", "top")]):
        out: list[bool] = []
        for k, state in enumerate(states):
            up, floor, down, ceiling = rest[4 * k : 4 * k + 4]
            out += state.step(high, low, floor if up else None, ceiling if down else None)
        yield tuple(out)


MITIGATED = tuple(c for c in STRUCTURE if c.endswith("_mitigated"))


def shifts_and_pools(df: DataFrame, p: PriceActionParams = PA) -> DataFrame:
    """ict_mss_*, ict_bos_* and ict_liquidity_* in one pass over each ticker."""
    df = atr(zigzag(df, p), p.pool_atr, "_atr")
    return _mapped(df, lambda pdf: _shifts_and_pools(pdf, p), ShiftState.outputs + PoolState.outputs).drop("_sh", "_sl", "_ph", "_pl", "_atr")


def live_blocks(df: DataFrame, p: StructureParams = ST) -> DataFrame:
    """The structure detector with its cap on live blocks: breaks by Windows, blocks by state."""
    keep = df.columns
    return _mapped(both_scales(df, p), lambda pdf: _blocks(pdf, p), MITIGATED).select(*keep, *STRUCTURE)


def all_machines(df: DataFrame, pa: PriceActionParams = PA, st: StructureParams = ST) -> DataFrame:
    """Both of the above with all Windows before them and one pass over each ticker."""
    keep, own = df.columns, ShiftState.outputs + PoolState.outputs
    df = both_scales(atr(zigzag(df, pa), pa.pool_atr, "_atr"), st)
    inputs = ("_sh", "_sl", "_ph", "_pl", "_atr", *[f"_{s}_{c}" for s in ("smc_swing", "smc_internal") for c in ("up", "btm", "dn", "top")])
    df = df.select(*keep, *inputs, *[c for c in STRUCTURE if c not in MITIGATED])
    run = lambda pdf: (x + y for x, y in zip(_shifts_and_pools(pdf, pa), _blocks(pdf, st), strict=True))
    return _mapped(df, run, own + MITIGATED).select(*keep, *own, *STRUCTURE)
