"""Where results go: tables, exports that are read back, manifests, and a check of what was written."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, by: Iterable[str] = ()) -> DataFrame:
    """Parquet, and the table read again: later steps don't depend on how it was made."""
    df.write.mode("overwrite").partitionBy(*by).parquet(path)
    return df.sparkSession.read.parquet(path)


def export(df: DataFrame, path: str, formats: Iterable[str] = ("csv", "json")) -> dict[str, int]:
    """Rows written in each format; raises if a read back counts other rows. For report-sized tables: one file each."""
    spark, counts = df.sparkSession, {}
    df = df.cache()
    try:
        n = df.count()
        for f in formats:
            out = df.coalesce(1).write.mode("overwrite")
            target = f"{path}.{f}"
            if f == "csv":
                out.csv(target, header=True)
                back = spark.read.csv(target, header=True)
            elif f == "json":
                out.json(target)
                back = spark.read.json(target) if n else spark.createDataFrame([], df.schema)
            else:
                raise ValueError(f"unknown format {f!r}")
            counts[f] = back.count()
            if counts[f] != n:
                raise RuntimeError(f"{target}: {counts[f]} rows, not {n}")
    finally:
        df.unpersist()
    return counts


def sample_rows(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """Exactly n rows (all, if fewer), the same on every run: those whose hash over all columns is smallest."""
    return df.withColumn("_k", F.xxhash64(*df.columns, F.lit(seed))).orderBy("_k", *df.columns).limit(n).drop("_k")


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def write_manifest(spark: SparkSession, path: str, values: Mapping) -> None:
    """A JSON document through Hadoop's file system, so that any store that tables are in will do."""
    p, fs = _path(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(json.dumps(values, indent=1, sort_keys=True, default=str).encode()))
    finally:
        out.close()


def read_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))


def check_artifacts(spark: SparkSession, expected: Mapping[str, tuple[int, Iterable[str]]]) -> list[str]:
    """Faults of tables at these paths: absent, fewer rows than wanted, columns missing."""
    faults = []
    for path, (least, columns) in expected.items():
        p, fs = _path(spark, path)
        if not fs.exists(p):
            faults.append(f"{path}: absent")
            continue
        df = spark.read.parquet(path)
        if missing := [c for c in columns if c not in df.columns]:
            faults.append(f"{path}: no {', '.join(missing)}")
        if (n := df.count()) < least:
            faults.append(f"{path}: {n} rows, not {least}")
    return faults


def save_snapshot(df: DataFrame, path: str) -> None:
    """A report-sized table as one CSV with a header, for eyes and for later comparison."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def read_snapshot(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


def check_invariants(df: DataFrame, rules: Mapping[str, str]) -> list[str]:
    """Rules (conditions that every row meets) that some rows break, with their number; one pass over the table."""
    row = df.agg(*[F.count_if(~F.coalesce(F.expr(rule), F.lit(False))).alias(f"n{i}") for i, rule in enumerate(rules.values())]).first()
    return [f"{name}: {n} rows" for name, n in zip(rules, row, strict=True) if n]


def copy_sample(bars: DataFrame, path: str, limit: int) -> DataFrame:
    """The first tickers by name, with all of their bars, as a panel of its own."""
    names = bars.select("ticker").distinct().orderBy("ticker").limit(limit)  # limit names
    return write_table(bars.join(F.broadcast(names), "ticker", "left_semi"), path, ["ticker"])
