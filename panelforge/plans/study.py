"""The whole study as stages over a folder of tables, each reading what earlier ones wrote."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.operators import analysis as A
from panelforge.operators import events as E
from panelforge.operators import resample as R
from panelforge.operators import stats as S
from panelforge.operators import trades as B
from panelforge.params import HORIZONS, PRIMARY_HORIZON
from panelforge.sources.sinks import write_manifest, write_table


@dataclass
class Study:
    """bars: ticker, date, open, high, low, close, volume, pos. sectors and members are optional side tables."""

    spark: SparkSession
    bars: DataFrame
    out: str
    horizons: Sequence[int] = HORIZONS
    primary: int = PRIMARY_HORIZON
    sectors: DataFrame | None = None
    least_bars: int = 300
    bootstrap_runs: int = 10_000

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.out}/{name}")

    def save(self, name: str, df: DataFrame) -> None:
        write_table(df, f"{self.out}/{name}")

    def detect(self) -> None:
        self.save("events", E.events_of(self.bars, self.least_bars))

    def baseline(self) -> None:
        self.save("baseline_events", E.baseline_events(self.bars, self.least_bars))
        self.save("baseline_trades", B.backtest(self.table("baseline_events"), self.bars, self.horizons))

    def backtest(self) -> None:
        self.save("trades", B.backtest(self.table("events"), self.bars, self.horizons))

    def statistics(self) -> None:
        self.save("statistics_master", S.statistics_master(self.table("trades"), self.bars, self.table("baseline_trades"), self.horizons))
        self.save("bootstrap", R.bootstrap(self.table("trades"), self.bootstrap_runs))

    def analyze(self) -> None:
        trades, labelled = self.table("trades"), A.regimes(self.bars)
        self.save("stock_ranking", A.rank_stocks(trades, self.table("baseline_trades"), self.primary))
        self.save("stability", A.stability(trades))
        self.save("regime_analysis", A.regime_analysis(trades, labelled, self.primary))
        self.save("regime_by_signal", A.regime_by_signal(trades, labelled, self.primary))
        combos = B.backtest(E.combinations(self.table("events")), self.bars, [self.primary])
        self.save("combinations", S.return_summary(combos, ["signal", "holding_period"]))
        if self.sectors is not None:
            self.save("sector_analysis", A.sector_analysis(trades, self.sectors, self.bars, self.primary))
            self.save("sector_power", A.sector_power(self.table("sector_analysis")))

    def walkforward(self) -> None:
        detail, summary = A.walk_forward(self.table("trades"), self.bars, self.primary)
        self.save("walkforward_detail", detail)
        self.save("walkforward_summary", summary)

    def costs(self) -> None:
        trades = self.table("trades").filter(F.col("holding_period") == self.primary)
        excess = self.table("statistics_master").filter(F.col("holding_period") == self.primary).select("signal", F.col("excess_return_vs_matched_random").alias("excess"))
        self.save("cost_grid", B.cost_grid(trades))
        self.save("breakeven", B.breakeven(trades, excess))
        self.save("net_of_cost", B.net_of_cost(B.with_costs(trades)))

    def montecarlo(self) -> None:
        self.save("rotation", R.rotation_family(self.table("trades"), self.bars, self.horizons))
        primary = self.table("trades").filter(F.col("holding_period") == self.primary)
        self.save("matched_mc", R.simulated_null(primary, self.bars, [self.primary]))
        self.save("block_mc", R.simulated_null(primary, self.bars, [self.primary], block=21))

    STAGES = ("detect", "baseline", "backtest", "statistics", "analyze", "walkforward", "costs", "montecarlo")

    def run(self, stages: Sequence[str] = STAGES, skip: Sequence[str] = ()) -> dict[str, float]:
        """Seconds of each stage; also in a manifest beside the tables."""
        took: dict[str, float] = {}
        for name in stages:
            if name not in self.STAGES:
                raise ValueError(f"unknown stage {name!r}")
            if name in skip:
                continue
            began = time.time()
            stage: Callable[[], None] = getattr(self, name)
            stage()
            took[name] = round(time.time() - began, 2)
        write_manifest(self.spark, f"{self.out}/manifest.json", {"seconds": took, "horizons": list(self.horizons), "primary": self.primary})
        return took
