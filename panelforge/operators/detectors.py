"""Event detectors over bar panels: each adds boolean columns to a frame with pos.

A detector at a bar reads that bar and earlier ones, but for *_label columns. Most are
Window expressions; those with states that feed back (structure shifts with remembered
levels, liquidity pools, order blocks under a cap of live ones) are in states.py.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.operators.indicators import PAST, SO_FAR, W, ahead, atr, back, ema, expanding_mean, held, held_before, legs, pivots, rsi, sma, true_range, week_opens
from panelforge.params import BaselineParams, PriceActionParams, StructureParams

PA, ST, BL = PriceActionParams(), StructureParams(), BaselineParams()


def yes(c: Column) -> Column:
    """A condition with unknown as false."""
    return F.coalesce(c, F.lit(False))


def lag(c: str, n: int = 1) -> Column:
    return F.lag(c, n).over(W())


def displacement(df: DataFrame, p: PriceActionParams = PA, name: str = "ict_displacement") -> DataFrame:
    """A body above its mean with short wicks."""
    body = F.abs(F.col("close") - F.col("open"))
    top, bottom = F.greatest("open", "close"), F.least("open", "close")
    clean = (F.col("high") - top < body * p.body_fraction) & (bottom - F.col("low") < body * p.body_fraction)
    large = (body > sma(body, p.pivot_len)) & clean
    return df.withColumns({f"{name}_bullish": yes(large & (F.col("close") > F.col("open"))), f"{name}_bearish": yes(large & (F.col("close") < F.col("open")))})


def volume_imbalance(df: DataFrame) -> DataFrame:
    """Bodies of two bars leave a gap that the wicks fill."""
    o, h, low, c = (F.col(x) for x in ("open", "high", "low", "close"))
    top, bottom = F.greatest("open", "close"), F.least("open", "close")
    up = (o > lag("close")) & (lag("high") > low) & (c > lag("close")) & (o > lag("open")) & (lag("high") < bottom)
    down = (o < lag("close")) & (lag("low") < h) & (c < lag("close")) & (o < lag("open")) & (lag("low") > top)
    return df.withColumns({"ict_volume_imbalance_bullish": yes(up), "ict_volume_imbalance_bearish": yes(down)})


def fair_value_gap(df: DataFrame, p: PriceActionParams = PA) -> DataFrame:
    """Three-bar gaps after a displacement, their edges, and whether price came back within fill_window bars (a label)."""
    df = displacement(df, p, "_disp")
    up, down = yes(lag("_disp_bullish")), yes(lag("_disp_bearish"))
    if p.fvg_mode == "FVG":
        up, down = up & (F.col("low") > lag("high", 2)), down & (F.col("high") < lag("low", 2))
    else:
        up, down = up & (F.col("low") < lag("high", 2)), down & (F.col("high") > lag("low", 2))
    df = df.withColumns({"ict_fvg_bullish_formed": yes(up), "ict_fvg_bearish_formed": yes(down)}).drop("_disp_bullish", "_disp_bearish")
    formed = lambda side, c: F.when(F.col(f"ict_fvg_{side}_formed"), c)
    df = df.withColumns({
        "ict_fvg_bullish_lower": formed("bullish", lag("high", 2)), "ict_fvg_bullish_upper": formed("bullish", F.col("low")),
        "ict_fvg_bearish_lower": formed("bearish", F.col("high")), "ict_fvg_bearish_upper": formed("bearish", lag("low", 2)),
    })
    lowest, highest = F.min("low").over(ahead(p.fill_window)), F.max("high").over(ahead(p.fill_window))
    return df.withColumns({"ict_fvg_bullish_filled_label": yes(lowest < F.col("ict_fvg_bullish_lower")), "ict_fvg_bearish_filled_label": yes(highest > F.col("ict_fvg_bearish_upper"))})


def balanced_range(df: DataFrame) -> DataFrame:
    """The last gaps of either side overlap, on the bar that completes the pair; needs fair_value_gap."""
    edge = {f"_{s}_{e}": held(F.col(f"ict_fvg_{s}_{e}")) for s in ("bullish", "bearish") for e in ("lower", "upper")}
    df = df.withColumns(edge)
    known = F.col("_bullish_lower").isNotNull() & F.col("_bearish_lower").isNotNull()
    overlap = known & (F.greatest("_bullish_lower", "_bearish_lower") < F.least("_bullish_upper", "_bearish_upper"))
    fired = {f"ict_bpr_{s}": yes(overlap & F.col(f"ict_fvg_{s}_formed")) for s in ("bullish", "bearish")}
    return df.withColumns(fired).drop(*edge)


def zigzag(df: DataFrame, p: PriceActionParams = PA) -> DataFrame:
    """_sh and _sl: the last high and low vertex once a bar is known; _ph and _pl: pivots confirmed on it.

    A run of pivots of one side is one vertex, its most extreme; a bar's high comes before its low.
    """
    df = pivots(df, p.pivot_len, 1, "_zz")
    df = df.withColumns({"_ph": F.when(F.col("_zz_high_confirmed"), lag("high")), "_pl": F.when(F.col("_zz_low_confirmed"), lag("low"))})
    df = df.withColumn("_side", held_before(F.when(F.col("_pl").isNotNull(), -1).when(F.col("_ph").isNotNull(), 1)))
    new_high = F.col("_ph").isNotNull() & ~yes(F.col("_side") == 1)
    new_low = F.col("_pl").isNotNull() & (F.col("_ph").isNotNull() | ~yes(F.col("_side") == -1))
    df = df.withColumns({"_hrun": F.sum(new_high.cast("int")).over(SO_FAR()), "_lrun": F.sum(new_low.cast("int")).over(SO_FAR())})
    run = lambda c: Window.partitionBy("ticker", c).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({"_sh": F.when(F.col("_hrun") > 0, F.max("_ph").over(run("_hrun"))), "_sl": F.when(F.col("_lrun") > 0, F.min("_pl").over(run("_lrun")))})
    return df.drop("_side", "_hrun", "_lrun", "_zz_high", "_zz_low", "_zz_high_confirmed", "_zz_low_confirmed")


def structure_shift(df: DataFrame, p: PriceActionParams = PA) -> DataFrame:
    """ict_mss_*: the close passes the last vertex against the direction of the last such break."""
    df = zigzag(df, p)
    both = F.col("_sh").isNotNull() & F.col("_sl").isNotNull()
    sign = F.when(both & (F.col("close") > F.col("_sh")), 1).when(both & (F.col("close") < F.col("_sl")), -1)
    df = df.withColumn("_sign", sign)
    df = df.withColumn("_dir", F.coalesce(held_before(F.col("_sign")), F.lit(0)))
    out = {"ict_mss_bullish": yes((F.col("_sign") == 1) & (F.col("_dir") < 1)), "ict_mss_bearish": yes((F.col("_sign") == -1) & (F.col("_dir") > -1))}
    return df.withColumns(out).drop("_sign", "_dir", "_ph", "_pl", "_sh", "_sl")


def segments(df: DataFrame, name: str) -> DataFrame:
    """{name}_{side}_seg and _level: number and price of the last confirmed swing of either side."""
    out = {}
    for side in ("high", "low"):
        out[f"{name}_{side}_seg"] = F.count(f"{name}_{side}").over(SO_FAR())
        out[f"{name}_{side}_level"] = held(F.col(f"{name}_{side}"))
    return df.withColumns(out)


def first_in_segment(df: DataFrame, condition: str, segment: str, name: str) -> DataFrame:
    """name: the first row of its segment (from 1 on) where condition holds."""
    within = Window.partitionBy("ticker", segment).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    nth = F.sum(F.col(condition).cast("int")).over(within)
    return df.withColumn(name, yes(F.col(condition) & (nth == 1) & (F.col(segment) > 0)))


def block_edge(df: DataFrame, source: str, size: int, swing: str, side: str, first: int, name: str) -> DataFrame:
    """Extreme of source from `first` bars after the pivot of the segment's swing to the bar before this one.

    The pivot is size bars before its confirmation, so the stretch is a fixed frame seen from
    the confirmation and a running one since.
    """
    best, pick = (F.min, F.least) if side == "high" else (F.max, F.greatest)
    old = F.when(F.col(f"{swing}_{side}").isNotNull(), best(source).over(W().rowsBetween(-size + first, -1)))
    df = df.withColumn("_old", old)
    within = Window.partitionBy("ticker", f"{swing}_{side}_seg").orderBy("date")
    since = best(source).over(within.rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn(name, pick(held(F.col("_old")), since)).drop("_old")


#: Bars of a stretch whose extremes are kept.
STRETCH = 64


def mitigations(df: DataFrame, blocks: dict[str, tuple[str, str, str, bool]], cap: int | None) -> DataFrame:
    """For each name of blocks: the bars on which some block is first passed, from the bar that forms it on.

    A name's value is (formed, edge, probe, rising): where blocks form, their edge, and the
    column that passes it, below for rising blocks and above for others. A block's search ends
    where the cap pushes it out, cap blocks of its kind later. Blocks meet the extremes of the
    later stretches of their ticker, all kinds in one join, and then the bars of two stretches.
    """
    kinds = F.array_compact(F.array(*[F.when(F.col(formed), F.struct(F.lit(name).alias("kind"), F.col(edge).alias("edge"))) for name, (formed, edge, _, _) in blocks.items()]))
    rows = df.select("ticker", F.col("pos").alias("_from"), F.explode(kinds).alias("_k")).select("ticker", "_from", "_k.*")
    order = Window.partitionBy("ticker", "kind").orderBy("_from")
    rows = rows.withColumn("_to", F.lead("_from", cap).over(order) if cap else F.lit(None).cast("int"))
    probes = sorted({probe for _, _, probe, _ in blocks.values()})

    def passed(value) -> Column:
        out = F.lit(False)
        for name, (_, _, probe, rising) in blocks.items():
            out = F.when(F.col("kind") == name, F.col(value(probe, rising)) < F.col("edge") if rising else F.col(value(probe, rising)) > F.col("edge")).otherwise(out)
        return out

    # stretches of bars and their extremes: a block looks for its first stretch, then for the bar there
    bars = df.select("ticker", "pos", *probes).withColumn("_at", F.floor(F.col("pos") / STRETCH).cast("int"))
    extremes = bars.groupBy("ticker", F.col("_at").alias("_later")).agg(*[f(c).alias(f"_{n}_{c}") for c in probes for n, f in (("least", F.min), ("most", F.max))])
    rows = rows.withColumn("_own", F.floor(F.col("_from") / STRETCH).cast("int"))
    later = rows.join(extremes, "ticker").filter((F.col("_later") > F.col("_own")) & passed(lambda c, rising: f"_least_{c}" if rising else f"_most_{c}"))
    later = later.groupBy(*rows.columns).agg(F.min("_later").alias("_at"))
    looked = later.unionByName(rows.withColumn("_at", F.col("_own")))
    hits = looked.join(bars, ["ticker", "_at"]).filter((F.col("pos") >= F.col("_from")) & passed(lambda c, _: c))
    hits = hits.groupBy("ticker", "kind", "_from").agg(F.min("pos").alias("pos"), F.first("_to").alias("_to"))
    hits = hits.filter(F.col("_to").isNull() | (F.col("pos") < F.col("_to")))
    hits = hits.groupBy("ticker", "pos").agg(*[F.bool_or(F.col("kind") == name).alias(name) for name in blocks])
    return df.join(hits, ["ticker", "pos"], "left").withColumns({name: yes(F.col(name)) for name in blocks})


def order_blocks(df: DataFrame, p: PriceActionParams = PA) -> DataFrame:
    """ict_ob_*: a close beyond the last swing forms a block of the bars between; a close back through it mitigates."""
    keep = df.columns
    df = segments(legs(df, p.ob_swing, "_ob"), "_ob")
    df = df.withColumns({"_min": F.least("open", "close") if p.ob_use_body else F.col("low"), "_max": F.greatest("open", "close") if p.ob_use_body else F.col("high")})
    df = df.withColumns({"_body_min": F.least("open", "close"), "_body_max": F.greatest("open", "close")})
    df = df.withColumns({"_up": yes(F.col("close") > F.col("_ob_high_level")), "_dn": yes(F.col("close") < F.col("_ob_low_level"))})
    df = first_in_segment(df, "_up", "_ob_high_seg", "ict_ob_bullish_formed")
    df = first_in_segment(df, "_dn", "_ob_low_seg", "ict_ob_bearish_formed")
    df = block_edge(df, "_min", p.ob_swing, "_ob", "high", 1, "_btm")
    df = block_edge(df, "_max", p.ob_swing, "_ob", "low", 1, "_top")
    df = mitigations(df, {
        "ict_ob_bullish_mitigated": ("ict_ob_bullish_formed", "_btm", "_body_min", True),
        "ict_ob_bearish_mitigated": ("ict_ob_bearish_formed", "_top", "_body_max", False),
    }, p.ob_cap)
    return df.select(*keep, *[f"ict_ob_{s}_{w}" for s in ("bullish", "bearish") for w in ("formed", "mitigated")])


def liquidity_sweep(df: DataFrame, p: PriceActionParams = PA) -> DataFrame:
    """A bar goes beyond the last swing by a part of the ATR and a close within a few bars comes back."""
    keep = df.columns
    df = atr(legs(df, p.sweep_swing, "_sw"), p.sweep_atr, "_atr")
    for side, name, up in (("high", "ict_sweep_buyside_bearish", True), ("low", "ict_sweep_sellside_bullish", False)):
        df = df.withColumn("_level", held_before(F.col(f"_sw_{side}")))
        pen = F.col("high") > F.col("_level") + p.sweep_penetration * F.col("_atr") if up else F.col("low") < F.col("_level") - p.sweep_penetration * F.col("_atr")
        df = df.withColumn("_pen", yes(pen))
        df = df.withColumns({"_seg": F.coalesce(F.sum(F.col("_pen").cast("int")).over(PAST()), F.lit(0)), "_at": held_before(F.when(F.col("_pen"), F.col("pos"))), "_was": held_before(F.when(F.col("_pen"), F.col("_level")))})
        reclaimed = F.col("close") < F.col("_was") - p.sweep_reclaim * F.col("_atr") if up else F.col("close") > F.col("_was") + p.sweep_reclaim * F.col("_atr")
        df = df.withColumn("_hit", yes((F.col("pos") - F.col("_at") <= p.sweep_bars) & reclaimed))
        df = first_in_segment(df, "_hit", "_seg", name)
    return df.select(*keep, "ict_sweep_buyside_bearish", "ict_sweep_sellside_bullish")


def opening_gaps(df: DataFrame, p: PriceActionParams = PA) -> DataFrame:
    """Openings away from the close before by a part of the ATR: on the first bar of a week, and on any bar."""
    keep = df.columns
    df = atr(df, p.gap_atr, "_atr")
    df = df.withColumns({"_gap": F.col("open") - lag("close"), "_before": lag("_atr"), "_week": week_opens()})
    material = yes(F.abs("_gap") >= p.gap_min_atr * F.col("_before"))
    out = {}
    for name, on, when in (("nwog", p.weekly_gaps, F.col("_week")), ("ndog", p.daily_gaps, F.lit(True))):
        fired = material & when & F.lit(on)
        out |= {f"ict_{name}_gap_up": fired & (F.col("_gap") > 0), f"ict_{name}_gap_down": fired & (F.col("_gap") < 0), f"ict_{name}_gap_size": F.when(fired, F.abs("_gap"))}
    return df.withColumns({k: yes(v) if "size" not in k else v for k, v in out.items()}).select(*keep, *out)


def parsed_extremes(df: DataFrame, p: StructureParams = ST) -> DataFrame:
    """_phigh and _plow: high and low, swapped on bars of at least twice the usual range."""
    if p.ob_filter == "atr":
        df = atr(df, p.ob_atr, "_vol")
    else:
        df = df.withColumn("_tr", true_range())
        df = df.withColumn("_vol", expanding_mean("_tr")).drop("_tr")
    wide = yes(F.col("high") - F.col("low") >= 2 * F.col("_vol"))
    return df.withColumns({"_phigh": F.when(wide, F.col("low")).otherwise(F.col("high")), "_plow": F.when(wide, F.col("high")).otherwise(F.col("low"))}).drop("_vol")


def structure_breaks(df: DataFrame, size: int, prefix: str, p: StructureParams = ST, other: str | None = None, confluence: bool = False) -> DataFrame:
    """{prefix}_bos_* and _choch_*: the first close across a swing's level, in or against the last break's direction.

    other: columns {other}_high_level and _low_level of a scale whose equal levels don't count.
    Leaves _{prefix}_up/_dn breaks, segments and levels for the order blocks.
    """
    s = f"_{prefix}"
    df = segments(legs(df, size, s), s)
    upper, lower = F.col("high") - F.greatest("open", "close"), F.least("open", "close") - F.col("low")
    for side, sign in (("high", 1), ("low", -1)):
        level = F.col(f"{s}_{side}_level")
        across = (F.col("close") > level) & (lag("close") <= level) if sign > 0 else (F.col("close") < level) & (lag("close") >= level)
        if other:
            across = across & ~level.eqNullSafe(F.col(f"{other}_{side}_level"))
        if confluence:
            across = across & ((upper > lower) if sign > 0 else ~(upper > lower))
        df = df.withColumn("_across", yes(across))
        df = first_in_segment(df, "_across", f"{s}_{side}_seg", f"{s}_{'up' if sign > 0 else 'dn'}").drop("_across")
    up, down = F.col(f"{s}_up"), F.col(f"{s}_dn")
    df = df.withColumn("_bias", F.coalesce(held_before(F.when(down, -1).when(up, 1)), F.lit(0)))
    below = F.when(up, 1).otherwise(F.col("_bias"))  # a bar's upward break comes first
    return df.withColumns({
        f"{prefix}_bos_bullish": up & (F.col("_bias") != -1), f"{prefix}_choch_bullish": up & (F.col("_bias") == -1),
        f"{prefix}_bos_bearish": down & (below != 1), f"{prefix}_choch_bearish": down & (below == 1),
    }).drop("_bias")


def block_edges(df: DataFrame, size: int, prefix: str) -> DataFrame:
    """{prefix}_ob_*_formed, and the edges of blocks, from the pivot to the bar before the break."""
    s = f"_{prefix}"
    df = df.withColumns({f"{prefix}_ob_bullish_formed": F.col(f"{s}_up"), f"{prefix}_ob_bearish_formed": F.col(f"{s}_dn")})
    df = block_edge(df, "_plow", size, s, "high", 0, f"{s}_btm")
    return block_edge(df, "_phigh", size, s, "low", 0, f"{s}_top")


STRUCTURE = [f"smc_{k}_{e}" for k in ("swing", "internal") for e in ("bos_bullish", "bos_bearish", "choch_bullish", "choch_bearish", "ob_bullish_formed", "ob_bullish_mitigated", "ob_bearish_formed", "ob_bearish_mitigated")]


def both_scales(df: DataFrame, p: StructureParams = ST) -> DataFrame:
    """Breaks and blocks of the swing and the internal scale; swing levels guard the internal one."""
    df = block_edges(structure_breaks(parsed_extremes(df, p), p.swing_len, "smc_swing", p), p.swing_len, "smc_swing")
    return block_edges(structure_breaks(df, p.internal_len, "smc_internal", p, other="_smc_swing", confluence=p.confluence), p.internal_len, "smc_internal")


def structure_signals(df: DataFrame, p: StructureParams = ST) -> DataFrame:
    """Breaks alone: one pass of Windows."""
    return both_scales(df, p).select(*df.columns, *[c for c in STRUCTURE if "_ob_" not in c])


def structure(df: DataFrame, p: StructureParams = ST) -> DataFrame:
    """Both scales with their order blocks; exact while fewer blocks are live than the cap, which states.live_blocks has."""
    kinds = {f"smc_{k}_ob_{s}_mitigated": (f"smc_{k}_ob_{s}_formed", f"_smc_{k}_{e}", q, s == "bullish") for k in ("swing", "internal") for s, e, q in (("bullish", "btm", "low"), ("bearish", "top", "high"))}
    return mitigations(both_scales(df, p), kinds, None).select(*df.columns, *STRUCTURE)


def equal_levels(df: DataFrame, p: StructureParams = ST) -> DataFrame:
    """Two confirmed swings in turn within a part of the ATR."""
    keep = df.columns
    df = atr(legs(df, p.equal_len, "_eq"), p.equal_atr, "_atr")
    near = lambda side: yes(F.abs(F.col(f"_eq_{side}") - held_before(F.col(f"_eq_{side}"))) < p.equal_threshold * F.col("_atr"))
    return df.withColumns({"smc_equal_highs": near("high"), "smc_equal_lows": near("low")}).select(*keep, "smc_equal_highs", "smc_equal_lows")


def adaptive_gap(df: DataFrame, p: StructureParams = ST) -> DataFrame:
    """Three-bar gaps whose middle bar moved more than twice the mean move so far."""
    move = (lag("close") - lag("open")) / (lag("open") * 100)
    df = df.withColumn("_move", move)
    limit = 2 * F.sum(F.abs("_move")).over(SO_FAR()) / F.col("pos") if p.auto_threshold else F.lit(0.0)
    up = (F.col("low") > lag("high", 2)) & (lag("close") > lag("high", 2)) & (F.col("_move") > limit)
    down = (F.col("high") < lag("low", 2)) & (lag("close") < lag("low", 2)) & (-F.col("_move") > limit)
    return df.withColumns({"smc_fvg_bullish_formed": yes(up), "smc_fvg_bearish_formed": yes(down)}).drop("_move")


def zones(df: DataFrame, window: int | None = None, p: StructureParams = ST) -> DataFrame:
    """Where the close is in the range so far, or in that of the last window bars; discount wins over premium."""
    frame = back(window) if window else SO_FAR()
    df = df.withColumns({"smc_trailing_top": F.max("high").over(frame), "smc_trailing_bottom": F.min("low").over(frame)})
    top, bottom = F.col("smc_trailing_top"), F.col("smc_trailing_bottom")
    zone = F.when(F.col("close") <= (1 - p.band) * bottom + p.band * top, "discount").when(F.col("close") >= (1 - p.band) * top + p.band * bottom, "premium").otherwise("equilibrium")
    return df.withColumn("smc_zone", zone)


def prior_levels(df: DataFrame, compat: bool = False) -> DataFrame:
    """High and low of the bar, week and month before.

    compat: as if periods were labelled by their last day, moved on by one and filled forward
    from there, so that within a period the levels are those of the one before the last.
    """
    out = df.withColumns({"smc_prior_day_high": lag("high"), "smc_prior_day_low": lag("low")})
    for unit in ("week", "month"):
        start = F.date_trunc(unit, "date").cast("date")
        calendar = df.groupBy("ticker", start.alias("_p")).agg(F.max("high").alias("_h"), F.min("low").alias("_l"))
        order = Window.partitionBy("ticker").orderBy("_p")
        # the k-th period before, and only if bars are there: a gap of the calendar has no level
        gone = 2 if compat else 1
        back_by = F.add_months("_p", gone) if unit == "month" else F.date_add("_p", 7 * gone)
        known = calendar.select("ticker", back_by.alias("_p"), F.col("_h").alias(f"smc_prior_{unit}_high"), F.col("_l").alias(f"smc_prior_{unit}_low"))
        if compat:  # on the period's own last day its label is reached
            last = F.last_day("date") == F.col("date") if unit == "month" else F.weekday("date") == 6
            start = F.when(last, F.add_months(start, 1) if unit == "month" else F.date_add(start, 7)).otherwise(start)
        out = out.withColumn("_p", start).join(known, ["ticker", "_p"], "left").drop("_p")
    return out


def ema_cross(df: DataFrame, p: BaselineParams = BL) -> DataFrame:
    df = ema(ema(df, "close", p.ema_fast, "_fast"), "close", p.ema_slow, "_slow")
    df = df.withColumn("_gap", F.col("_fast") - F.col("_slow"))
    out = {"baseline_ema_cross_bullish": yes((F.col("_gap") > 0) & (lag("_gap") <= 0)), "baseline_ema_cross_bearish": yes((F.col("_gap") < 0) & (lag("_gap") >= 0))}
    return df.withColumns(out).drop("_fast", "_slow", "_gap")


def rsi_reversion(df: DataFrame, p: BaselineParams = BL) -> DataFrame:
    df = rsi(df, p.rsi, "_rsi")
    out = {"baseline_rsi_reversion_bullish": yes((F.col("_rsi") < p.oversold) & (lag("_rsi") >= p.oversold)), "baseline_rsi_reversion_bearish": yes((F.col("_rsi") > p.overbought) & (lag("_rsi") <= p.overbought))}
    return df.withColumns(out).drop("_rsi")


def breakout(df: DataFrame, p: BaselineParams = BL) -> DataFrame:
    """The first close of a run at the high (low) of the last bars, this one included."""
    whole = F.col("pos") >= p.breakout
    df = df.withColumns({"_hi": yes(whole & (F.col("close") >= F.max("high").over(back(p.breakout)))), "_lo": yes(whole & (F.col("close") <= F.min("low").over(back(p.breakout))))})
    out = {"baseline_52w_breakout_bullish": F.col("_hi") & ~yes(lag("_hi")), "baseline_52w_breakout_bearish": F.col("_lo") & ~yes(lag("_lo"))}
    return df.withColumns(out).drop("_hi", "_lo")


def momentum_turn(df: DataFrame, p: BaselineParams = BL) -> DataFrame:
    df = df.withColumn("_mom", F.col("close") / lag("close", p.momentum) - 1)
    out = {"baseline_momentum_bullish": yes((F.col("_mom") > 0) & (lag("_mom") <= 0)), "baseline_momentum_bearish": yes((F.col("_mom") < 0) & (lag("_mom") >= 0))}
    return df.withColumns(out).drop("_mom")


def random_entry(df: DataFrame, p: BaselineParams = BL, seed: int = 42) -> DataFrame:
    """So many bars of each ticker, those whose hash is smallest: the same on any cluster."""
    order = Window.partitionBy("ticker").orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), "ticker", F.col("date").cast("string"))))
    return df.withColumn("baseline_random_bullish", F.row_number().over(order) <= p.random_entries)


def buy_and_hold(df: DataFrame) -> DataFrame:
    """Total return, yearly growth, Sharpe ratio and largest drawdown of holding each ticker."""
    df = df.withColumn("_ret", F.col("close") / lag("close") - 1)
    df = df.withColumn("_path", F.sum(F.log1p("_ret")).over(SO_FAR()))
    df = df.withColumn("_fall", F.expm1(F.col("_path") - F.max("_path").over(SO_FAR())))
    out = df.groupBy("ticker").agg(F.min_by("close", "date").alias("_c0"), F.max_by("close", "date").alias("_c1"), F.datediff(F.max("date"), F.min("date")).alias("_days"), F.avg("_ret").alias("_m"), F.stddev_samp("_ret").alias("_s"), F.min("_fall").alias("max_drawdown"))
    total = F.col("_c1") / F.col("_c0") - 1
    return out.select("ticker", total.alias("total_return"), (F.pow(1 + total, F.try_divide(F.lit(365.25), "_days")) - 1).alias("cagr"), (F.try_divide("_m", "_s") * F.sqrt(F.lit(252.0))).alias("sharpe"), "max_drawdown")

