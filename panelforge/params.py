"""Parameters of detectors, backtests and statistics, passed explicitly everywhere."""

from __future__ import annotations

from dataclasses import dataclass

HORIZONS = (1, 2, 3, 5, 10, 20, 40, 60)
PRIMARY_HORIZON = 10
MIN_BARS = 300
SEED = 42


@dataclass(frozen=True)
class PriceActionParams:
    """Displacement, gaps, zigzag structure, order blocks, liquidity."""

    pivot_len: int = 5
    body_fraction: float = 0.36
    ob_swing: int = 10
    ob_use_body: bool = True
    ob_cap: int = 200
    pool_margin: float = 4.0
    pool_atr: int = 10
    pool_min_cluster: int = 2
    pool_memory: int = 50
    fvg_mode: str = "FVG"
    fill_window: int = 60
    weekly_gaps: bool = True
    daily_gaps: bool = False
    gap_min_atr: float = 0.10
    gap_atr: int = 14
    sweep_swing: int = 10
    sweep_penetration: float = 0.25
    sweep_reclaim: float = 0.0
    sweep_bars: int = 3
    sweep_atr: int = 14


@dataclass(frozen=True)
class StructureParams:
    """Swing and internal structure, equal levels, adaptive gaps, zones."""

    swing_len: int = 50
    internal_len: int = 5
    equal_len: int = 3
    equal_threshold: float = 0.1
    equal_atr: int = 200
    ob_filter: str = "atr"
    ob_atr: int = 200
    ob_cap: int = 100
    confluence: bool = False
    auto_threshold: bool = True
    band: float = 0.05


@dataclass(frozen=True)
class CostParams:
    """Round-trip costs in basis points; slippage is uniform in its range."""

    fixed: float = 1.0
    spread: float = 5.0
    slip_low: float = 5.0
    slip_high: float = 20.0


@dataclass(frozen=True)
class BaselineParams:
    ema_fast: int = 20
    ema_slow: int = 50
    rsi: int = 14
    oversold: float = 30.0
    overbought: float = 70.0
    breakout: int = 252
    momentum: int = 126
    random_entries: int = 500


@dataclass(frozen=True)
class RegimeParams:
    trend: int = 200
    slope: int = 20
    vol: int = 63
    high: float = 1.5
    low: float = 0.67


#: The direction of each tradeable signal, in the order of the wide columns.
REGISTRY: dict[str, int] = {
    "ict_displacement_bullish": 1, "ict_displacement_bearish": -1,
    "ict_volume_imbalance_bullish": 1, "ict_volume_imbalance_bearish": -1,
    "ict_fvg_bullish_formed": 1, "ict_fvg_bearish_formed": -1,
    "ict_bpr_bullish": 1, "ict_bpr_bearish": -1,
    "ict_mss_bullish": 1, "ict_mss_bearish": -1,
    "ict_bos_bullish": 1, "ict_bos_bearish": -1,
    "ict_ob_bullish_formed": 1, "ict_ob_bullish_mitigated": -1, "ict_ob_bearish_formed": -1, "ict_ob_bearish_mitigated": 1,
    "ict_liquidity_buyside_pool_formed": 1, "ict_liquidity_buyside_swept": 1,
    "ict_liquidity_sellside_pool_formed": -1, "ict_liquidity_sellside_swept": -1,
    "ict_sweep_buyside_bearish": -1, "ict_sweep_sellside_bullish": 1,
    "ict_nwog_gap_up": 1, "ict_nwog_gap_down": -1, "ict_ndog_gap_up": 1, "ict_ndog_gap_down": -1,
    "smc_swing_bos_bullish": 1, "smc_swing_bos_bearish": -1, "smc_swing_choch_bullish": 1, "smc_swing_choch_bearish": -1,
    "smc_swing_ob_bullish_formed": 1, "smc_swing_ob_bullish_mitigated": -1, "smc_swing_ob_bearish_formed": -1, "smc_swing_ob_bearish_mitigated": 1,
    "smc_internal_bos_bullish": 1, "smc_internal_bos_bearish": -1, "smc_internal_choch_bullish": 1, "smc_internal_choch_bearish": -1,
    "smc_internal_ob_bullish_formed": 1, "smc_internal_ob_bullish_mitigated": -1, "smc_internal_ob_bearish_formed": -1, "smc_internal_ob_bearish_mitigated": 1,
    "smc_equal_highs": -1, "smc_equal_lows": 1,
    "smc_fvg_bullish_formed": 1, "smc_fvg_bearish_formed": -1,
}

BASELINES: dict[str, int] = {
    "baseline_ema_cross_bullish": 1, "baseline_ema_cross_bearish": -1,
    "baseline_rsi_reversion_bullish": 1, "baseline_rsi_reversion_bearish": -1,
    "baseline_52w_breakout_bullish": 1, "baseline_52w_breakout_bearish": -1,
    "baseline_momentum_bullish": 1, "baseline_momentum_bearish": -1,
    "baseline_random_bullish": 1,
}
