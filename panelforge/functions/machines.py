"""State machines of detectors: one object for each ticker, fed bar by bar.

Workers import this module, so nothing here needs a Spark session.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass, field

import pandas as pd

from panelforge.params import PriceActionParams

PA = PriceActionParams()


class DisplacementState:
    """The last bodies of a ticker, and whether a bar is a displacement: 1 up, -1 down, 0 none."""

    def __init__(self, length: int = PA.pivot_len, body_fraction: float = PA.body_fraction):
        self.bodies: deque[float] = deque(maxlen=length)
        self.part = body_fraction

    def step(self, open_: float, high: float, low: float, close: float) -> int:
        body = abs(close - open_)
        self.bodies.append(body)
        if len(self.bodies) < self.bodies.maxlen or body <= sum(self.bodies) / len(self.bodies):
            return 0
        clean = high - max(open_, close) < body * self.part and min(open_, close) - low < body * self.part
        return ((close > open_) - (close < open_)) * clean


@dataclass
class ShiftState:
    """Direction of the last break, and levels that a continuation has used up."""

    direction: int = 0
    used_up: list = field(default_factory=lambda: [None, None])  #: by a shift, by a continuation
    used_down: list = field(default_factory=lambda: [None, None])

    outputs = ("ict_mss_bullish", "ict_mss_bearish", "ict_bos_bullish", "ict_bos_bearish")

    def step(self, close: float, top: float | None, bottom: float | None) -> tuple[bool, bool, bool, bool]:
        if top is None or bottom is None:
            return False, False, False, False
        above, below = close > top, close < bottom
        if above and self.direction < 1:
            self.direction, self.used_up[0] = 1, top
            return True, False, False, False
        if below and self.direction > -1:
            self.direction, self.used_down[0] = -1, bottom
            return False, True, False, False
        if above and self.direction == 1 and top not in self.used_up:
            self.used_up[1] = top
            return False, False, True, False
        if below and self.direction == -1 and bottom not in self.used_down:
            self.used_down[1] = bottom
            return False, False, False, True
        return False, False, False, False


class PoolState:
    """Vertices of a zigzag, and the pool of either side that is waiting to be swept."""

    outputs = ("ict_liquidity_buyside_pool_formed", "ict_liquidity_buyside_swept", "ict_liquidity_sellside_pool_formed", "ict_liquidity_sellside_swept")

    def __init__(self, p: PriceActionParams = PA):
        self.p = p
        self.vertices: deque[tuple[int, float]] = deque(maxlen=p.pool_memory)
        self.waiting: dict[int, float | None] = {1: None, -1: None}

    def _pivot(self, side: int, price: float, atr_now: float | None) -> bool:
        """Takes in a pivot; whether a pool forms at it."""
        if self.vertices and self.vertices[-1][0] == side:
            if side * price > side * self.vertices[-1][1]:
                self.vertices[-1] = (side, price)
        else:
            self.vertices.append((side, price))
        band = (atr_now or 0.0) / (10.0 / self.p.pool_margin)
        near = [v for s, v in self.vertices if s == side and abs(v - price) < band and price - band < v < price + band]
        if len(near) <= self.p.pool_min_cluster:
            return False
        # entered from below through its lower edge, or from above through its upper one
        self.waiting[side] = (min(near) + max(near)) / 2 - side * band
        return True

    def step(self, close: float, high_pivot: float | None, low_pivot: float | None, atr_now: float | None) -> tuple[bool, bool, bool, bool]:
        out = []
        formed = {1: high_pivot is not None and self._pivot(1, high_pivot, atr_now)}
        formed[-1] = low_pivot is not None and self._pivot(-1, low_pivot, atr_now)
        for side in (1, -1):
            edge = self.waiting[side]
            swept = edge is not None and side * close > side * edge
            if swept:
                self.waiting[side] = None
            out += [formed[side], swept]
        return tuple(out)


class BlockState:
    """Live order blocks of one scale; a mitigated block goes, the oldest goes beyond the cap."""

    def __init__(self, cap: int):
        self.cap = cap
        self.floors: list[float] = []
        self.ceilings: list[float] = []

    def step(self, high: float, low: float, floor: float | None, ceiling: float | None) -> tuple[bool, bool]:
        """floor, ceiling: edges of blocks that form now. Whether a rising or falling block is mitigated."""
        for blocks, edge in ((self.floors, floor), (self.ceilings, ceiling)):
            if edge is not None:
                blocks.append(edge)
                del blocks[: len(blocks) - self.cap]
        hit = any(low < x for x in self.floors), any(high > x for x in self.ceilings)
        if hit[0]:
            self.floors = [x for x in self.floors if not low < x]
        if hit[1]:
            self.ceilings = [x for x in self.ceilings if not high > x]
        return hit


def values(pdf: pd.DataFrame, *names: str):
    """Rows of these columns, missing values as None."""
    return zip(*[[None if pd.isna(v) else v for v in pdf[n]] for n in names], strict=True)
