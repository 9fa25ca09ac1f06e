"""Bar panels: one long table (ticker, date, open, high, low, close, volume), read and repaired."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BARS = "ticker string, date date, open double, high double, low double, close double, volume double"


def read_panel(spark: SparkSession, path: str, tickers: Sequence[str] | None = None, repair: bool = True) -> DataFrame:
    """A folder with one Parquet file for each ticker, named after it, or partitioned by ticker; the first of equal dates stays."""
    rows = spark.read.parquet(path)
    if "ticker" not in rows.columns:
        rows = rows.withColumn("ticker", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.parquet$", 1))
    if tickers is not None:
        rows = rows.filter(F.col("ticker").isin(list(tickers)))
    rows = first_of_date(rows.withColumn("date", F.to_date("date")))
    return repair_ohlc(rows) if repair else rows


def first_of_date(rows: DataFrame, order: str | None = None) -> DataFrame:
    """One row for each ticker and date: the first by order, or by all values where none is given."""
    by = [F.col(order)] if order else [F.col(c).asc_nulls_last() for c in ("open", "high", "low", "close", "volume")]
    w = Window.partitionBy("ticker", "date").orderBy(*by)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def bars_from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of six tickers from order lines: first, highest, lowest and last price of a day, with pos."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    key = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    px = 100 + F.col("l_extendedprice") / 1000
    bars = lines.groupBy(F.concat("l_returnflag", "l_linestatus").alias("ticker"), F.to_date("l_shipdate").alias("date")).agg(
        F.min_by(px, key).alias("open"), F.max(px).alias("high"), F.min(px).alias("low"), F.max_by(px, key).alias("close"), F.sum("l_quantity").alias("volume")
    )
    return with_position(bars)


def hourly_bars_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of each event type; date holds the hour."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").filter("value is not null")
    key, px = F.struct("ts", "event_id"), 100 + F.col("value")
    bars = rows.groupBy(F.col("event_type").alias("ticker"), F.date_trunc("hour", "ts").alias("date")).agg(
        F.min_by(px, key).alias("open"), F.max(px).alias("high"), F.min(px).alias("low"), F.max_by(px, key).alias("close"), F.count(F.lit(1)).cast("double").alias("volume")
    )
    return with_position(bars)


def with_position(bars: DataFrame) -> DataFrame:
    """pos: the number of the bar in its ticker, from 1."""
    return bars.withColumn("pos", F.row_number().over(Window.partitionBy("ticker").orderBy("date")))


def _invalid(tolerance: Column) -> Column:
    top, bottom = F.greatest("open", "close"), F.least("open", "close")
    return (F.col("high") < top - tolerance) | (F.col("low") > bottom + tolerance) | (F.col("high") < F.col("low") - tolerance)


def repair_ohlc(bars: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """high and low widened to hold open and close; ohlc_material marks rows changed by more than tolerance."""
    high, low = F.greatest("high", "open", "close"), F.least("low", "open", "close")
    moved = F.try_divide(F.abs(high - F.col("high")) + F.abs(low - F.col("low")), F.abs("close"))
    return bars.withColumn("ohlc_material", F.coalesce(moved > tolerance, F.lit(False))).withColumns({"high": high, "low": low})


def business_days(start: Column, end: Column) -> Column:
    """Mondays to Fridays in [start, end)."""
    monday = lambda d: F.date_trunc("week", d).cast("date")
    weeks = F.datediff(monday(end), monday(start)) / 7
    within = lambda d: F.least(F.weekday(d), F.lit(5))
    return (weeks * 5 + within(end) - within(start)).cast("long")


def quality_report(rows: DataFrame) -> DataFrame:
    """One row for each ticker: extent, gaps, duplicates, impossible bars, jumps, calendar coverage, status."""
    w = Window.partitionBy("ticker").orderBy("date", "open", "high", "low", "close")
    tolerance = 1e-6 * F.greatest(F.abs("close"), F.lit(1e-9))
    ret = F.try_divide(F.col("close"), F.lag("close").over(w)) - 1
    seen = F.row_number().over(Window.partitionBy("ticker", "date").orderBy("open", "high", "low", "close"))
    rows = rows.withColumn("_ret", ret).withColumn("_nth", seen)
    missing = sum(F.col(c).isNull().cast("long") for c in ("open", "high", "low", "close", "volume"))
    nonpositive = (F.col("open") <= 0) | (F.col("high") <= 0) | (F.col("low") <= 0) | (F.col("close") <= 0)
    out = rows.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("date").alias("_start"), F.max("date").alias("_end"), F.sum(missing).alias("missing_values"),
        F.count_if(F.col("_nth") > 1).alias("duplicate_dates"), F.count_if(_invalid(tolerance)).alias("invalid_ohlc"),
        F.count_if(nonpositive).alias("nonpositive_rows"), F.count_if(F.abs("_ret") > 0.5).alias("extreme_moves"),
    )
    days = business_days(F.col("_start"), F.date_add("_end", 1))
    bad = (F.col("missing_values") > 0) | (F.col("duplicate_dates") > 0) | (F.col("invalid_ohlc") > 0) | (F.col("nonpositive_rows") > 0)
    return out.select(
        "ticker", "n_rows", F.col("_start").cast("string").alias("start_date"), F.col("_end").cast("string").alias("end_date"), "missing_values",
        "duplicate_dates", "invalid_ohlc", "nonpositive_rows", "extreme_moves", F.round(F.try_divide(F.col("n_rows"), days), 3).alias("coverage"),
        F.when(bad, "ISSUES_FOUND").otherwise("OK").alias("status"),
    )


def long_enough(bars: DataFrame, least: int) -> DataFrame:
    """Bars of tickers that have so many at least."""
    return bars.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("ticker"))).filter(F.col("_n") >= least).drop("_n")


def stale(bars: DataFrame, start: Column, days: int = 400) -> DataFrame:
    """Tickers whose first bar is more than so many days after start."""
    first = bars.groupBy("ticker").agg(F.min("date").alias("first_date"))
    return first.filter(F.datediff("first_date", start) > days)


def missing_tickers(wanted: DataFrame, have: DataFrame) -> DataFrame:
    return wanted.select("ticker").distinct().join(have.select("ticker").distinct(), "ticker", "left_anti")


def normal_symbol(symbol: Column, overrides: dict[str, str]) -> Column:
    """The override of a symbol, else the symbol trimmed with dots as dashes."""
    known = F.create_map(*[F.lit(x) for kv in overrides.items() for x in kv]) if overrides else None
    plain = F.replace(F.trim(symbol), F.lit("."), F.lit("-"))
    return F.coalesce(F.try_element_at(known, F.trim(symbol)), plain) if overrides else plain


def percent(text: Column) -> Column:
    return F.try_to_number(F.regexp_replace(F.trim(text), "%$", ""), F.lit("999990.999999")).cast("double")


def read_constituents(spark: SparkSession, path: str) -> DataFrame:
    """CSV of rank, company, symbol, weight such as 7.20%."""
    rows = spark.read.csv(path, header=True, schema="rank int, company string, symbol string, weight string")
    return rows.withColumn("weight", F.regexp_replace("weight", "%$", "").cast("double"))


def read_membership(spark: SparkSession, path: str) -> DataFrame:
    """CSV snapshot of members; an unreadable entry date is null. A missing file raises."""
    ddl = "symbol string, company string, gics_sector string, gics_sub_industry string, date_added string, yf_symbol string, retrieved_utc string"
    rows = spark.read.csv(path, header=True, schema=ddl)
    return rows.withColumn("date_added", F.try_to_date("date_added", F.lit("yyyy-MM-dd"))).withColumn("yf_symbol", F.coalesce("yf_symbol", normal_symbol(F.col("symbol"), {})))


def first_readable(spark: SparkSession, paths: Sequence[str], schema: str) -> DataFrame:
    """The first of these Parquet tables that exists, else an empty one."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(conf).exists(p):
            return spark.read.parquet(path)
    return spark.createDataFrame([], schema)


def is_member(date: Column, added: Column, unknown: str = "keep") -> Column:
    """Whether a ticker with this entry date is in the index on a date; unknown entry dates by policy."""
    if unknown not in ("keep", "drop"):
        raise ValueError(f"unknown policy {unknown!r}")
    return F.coalesce(date >= added, F.lit(unknown == "keep"))


def simulated_bars(spark: SparkSession, n_tickers: int = 500, n_bars: int = 4000, start: str = "2005-01-03", label: str = "panel") -> DataFrame:
    """Bars of tickers under a common GARCH factor; each ticker's own draws come from its name, so any split gives the same rows."""
    from panelforge.functions.seeds import rng
    from panelforge.functions.simulation import garch_path, own_path

    dates = np.busday_offset(start, np.arange(n_bars), roll="forward").astype("datetime64[D]")
    market = garch_path(rng(f"{label}:market"), n_bars, 0.011, 0.08, 0.90)

    def make(batches):
        for pdf in batches:
            for ticker in pdf["ticker"]:
                gen = rng(f"{label}:{ticker}")
                r = np.clip(gen.uniform(0.6, 1.4) * market + own_path(gen, n_bars), -0.5, 0.5)
                close = 100 * np.cumprod(1 + r)
                open_ = np.concatenate([[100.0], close[:-1]]) * (1 + gen.normal(0, 0.002, n_bars))
                spread = np.abs(gen.normal(0, 0.006, (2, n_bars)))
                yield pd.DataFrame({"ticker": ticker, "date": dates.astype(object), "open": open_, "high": np.maximum(open_, close) * (1 + spread[0]), "low": np.minimum(open_, close) * (1 - spread[1]), "close": close, "volume": np.floor(gen.lognormal(13, 0.5, n_bars))})

    names = spark.range(n_tickers).select(F.format_string("T%05d", "id").alias("ticker")).repartition(max(1, min(n_tickers, n_bars * n_tickers // 50_000)))
    return with_position(names.mapInPandas(make, "ticker string, date date, open double, high double, low double, close double, volume double"))
