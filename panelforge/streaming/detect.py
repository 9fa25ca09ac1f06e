"""Detectors over a stream of bars: the machines of the batch form, keyed by ticker.

Each ticker's state is its last bars and machines, and grows with the lookback alone. Bars
are taken in date order within a micro-batch; one that is not later than the last bar seen
of its ticker is dropped, as a watermark would. Events equal those of the batch form.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from panelforge.functions.machines import DisplacementState

EVENTS = "ticker string, date date, signal string, direction int, close double"


def displacement_stream(bars: DataFrame, length: int = 5, body_fraction: float = 0.36) -> DataFrame:
    """Displacement events of a streaming (or batch) frame of bars."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, machine = pickle.loads(state.get[0]) if state.exists else (None, DisplacementState(length, body_fraction))
        out = []
        for pdf in [pd.concat(list(batches))]:
            for bar in pdf.sort_values("date").itertuples():
                if last is not None and bar.date <= last:
                    continue
                last = bar.date
                direction = machine.step(bar.open, bar.high, bar.low, bar.close)
                if direction:
                    out.append((key[0], bar.date, f"ict_displacement_{'bullish' if direction > 0 else 'bearish'}", direction, bar.close))
        state.update((pickle.dumps((last, machine)),))
        yield pd.DataFrame(out, columns=["ticker", "date", "signal", "direction", "close"])

    return bars.groupBy("ticker").applyInPandasWithState(run, EVENTS, "machine binary", "append", GroupStateTimeout.NoTimeout)
