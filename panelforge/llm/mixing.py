"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source is cut into blocks of whole documents by a hash. A source's target is some full
passes over its blocks and a part of one more: blocks in permuted order until the quota of
words is full, the last one document by document in the order of another hash, and its last
document cut at a word. The tree deals the drawn blocks exactly, source by source, to output
shards of equal numbers of blocks; a shard takes its next blocks of each source's permutation
and shuffles them itself.

Texts are read twice: once for a table of (source, hash, size), from which all is planned, and
once to take what the plan says. The driver holds one row for each source (the catalogue) and
the quotas of sources and shards; a source has most_blocks blocks at most, so a window over the
blocks of a source is bounded; the one over documents is over a single block of each source.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.llm.common import Scratch

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)


@dataclass(frozen=True)
class MixParams:
    weights: tuple[int, ...] = WEIGHTS
    share: float = 1.5  #: of all words
    most_epochs: int = 2
    block_words: int = 32_768  #: aimed at, until a source has most_blocks
    most_blocks: int = 4096
    broadcast_blocks: int = 100_000  #: of all sources; beyond, documents meet their blocks in a shuffle
    shards: int | None = None  #: of the output; by size if None
    shard_words: int = 1 << 21  #: aimed at; beyond most_shards of them a shard has several partitions
    most_shards: int = 4096
    seed: int = 17


def fill_targets(sizes: list[int], weights: list[float], total: float, most: float) -> list[float]:
    """Shares of total by weight; what is over most times a size goes to the others by weight, again and again."""
    out, open_ = [0.0] * len(sizes), [i for i in range(len(sizes))]
    while open_:
        unit = total / sum(weights[i] for i in open_)
        over = [i for i in open_ if unit * weights[i] > most * sizes[i]]
        if not over:
            for i in open_:
                out[i] = unit * weights[i]
            break
        for i in over:
            out[i] = float(most * sizes[i])
            total -= out[i]
        open_ = [i for i in open_ if i not in set(over)]
    return out


def split_quotas(quotas: list[int], shards: int, seed: int) -> np.ndarray:
    """Blocks of each source for each shard: halves of the shards draw from their node without replacement."""
    out = np.zeros((shards, len(quotas)), np.int64)

    def node(first: int, n: int, have: np.ndarray) -> None:
        if n == 1:
            out[first] = have
            return
        left = n // 2
        rng = np.random.default_rng([seed, first, n])
        part = rng.multivariate_hypergeometric(have, int(have.sum()) * left // n, method="marginals") if have.sum() else have * 0
        node(first, left, part)
        node(first + left, n - left, have - part)

    node(0, shards, np.array(quotas, np.int64))
    return out


def catalogue(sizes: DataFrame, p: MixParams) -> pd.DataFrame:
    """One row for each source, by code point and null last: size, target, blocks, full passes and the words beyond."""
    rows = sorted(((r["source"], int(r["n"] or 0)) for r in sizes.groupBy("source").agg(F.sum("size").alias("n")).collect()), key=lambda r: (r[0] is None, r[0] or ""))
    sizes = [n for _, n in rows]
    targets = fill_targets(sizes, [p.weights[i % len(p.weights)] for i in range(len(rows))], p.share * sum(sizes), p.most_epochs)
    out = []
    for i, ((source, size), target) in enumerate(zip(rows, targets, strict=True)):
        full = min(p.most_epochs, int(target // size)) if size else 0
        rest = min(max(0, round(target) - full * size), size)
        blocks = 1 << max(0, math.ceil(math.log2(max(1, size / p.block_words))))  # a power of two divides the fine blocks
        out.append((i, source, size, target, min(p.most_blocks, blocks), full, rest))
    return pd.DataFrame(out, columns=["rank", "name", "source_size", "target", "n_blocks", "full", "rest"])


def plan_mix(docs: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """For each row of docs a struct row of its columns and a struct mix: size, source_size, target, taken, draws.

    draws has a struct (shard, copy, words) for each time that the mix takes the document: none,
    some or all of its words. Null texts have no words; null sources are the last source; a
    repeated row is drawn with its twins, and where the quota ends in these each takes an equal
    whole number of words of what is left; columns of any name stay; an empty table stays empty.
    """
    spark, p = docs.sparkSession, params
    scratch = Scratch(spark, "mixing")
    at = lambda *c: F.xxhash64(*c, F.lit(p.seed))
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    # rows without an id are told apart by their texts
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.col("source").alias("source"), at("doc_id", "text").alias("hash"), size.alias("size"))
    keys = scratch.save(keyed.select("source", "hash", "size"), "keys")
    fine = F.pmod(F.col("hash"), F.lit(p.most_blocks)).cast("int")
    sizes = scratch.save(keys.groupBy("source", fine.alias("fine")).agg(F.sum("size").alias("size")), "sizes")
    cat = catalogue(sizes, p)
    ddl = "rank int, name string, source_size long, target double, n_blocks int, full int, rest long"
    some = lambda df: F.broadcast(df) if len(cat) <= 50_000 else df  # noqa: E731  (some 100 bytes a source)
    known = spark.createDataFrame([tuple(None if x is None else x for x in r) for r in cat.astype(object).itertuples(index=False)], ddl)
    of_source = lambda df, known: df.join(some(known), F.col("source").eqNullSafe(F.col("name"))).drop("source", "name")

    by_source = Window.partitionBy("rank")  # most_blocks rows at most
    blocks = of_source(sizes, known).withColumn("block", F.col("fine") % F.col("n_blocks")).groupBy("rank", "block", "full", "rest").agg(F.sum("size").alias("block_size"))
    blocks = blocks.withColumn("before", F.sum("block_size").over(by_source.orderBy(at("rank", "block"), "block")) - F.col("block_size"))
    blocks = blocks.withColumn("part", F.greatest(F.lit(0), F.least(F.col("block_size"), F.col("rest") - F.col("before"))))
    blocks = blocks.withColumn("copies", F.col("full") + (F.col("part") > 0).cast("int"))
    draws = blocks.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    draws = draws.withColumn("nth", F.row_number().over(by_source.orderBy(at("block", "copy"), "block", "copy")) - 1)
    draws = scratch.save(draws.select("rank", "block", "copy", "nth", "block_size", "part", "full"), "draws")
    quotas = dict.fromkeys(cat["rank"].tolist(), 0) | {r["rank"]: r["n"] for r in draws.groupBy("rank").agg(F.count(F.lit(1)).alias("n")).collect()}
    shards = n_shards(float(cat["target"].sum()), p)
    ends = np.cumsum(split_quotas(list(quotas.values()), shards, p.seed), axis=0) if quotas else np.zeros((shards, 0), np.int64)
    bounds = spark.createDataFrame([(r, ends[:, i].tolist()) for i, r in enumerate(quotas)], "rank int, ends array<long>")
    draws = draws.join(some(bounds), "rank").withColumn("shard", F.size(F.filter("ends", lambda e: e <= F.col("nth"))))
    drawn = F.sort_array(F.collect_list(F.struct("copy", "shard", (F.col("copy") < F.col("full")).alias("whole"))))
    per_block = scratch.save(draws.groupBy("rank", "block").agg(drawn.alias("drawn"), F.first("part").alias("part"), F.first("block_size").alias("block_size")), "blocks")
    scratch.drop("draws")

    # in the one block of a source that the quota ends in: the document that it ends in, by hashes and sizes alone
    split = per_block.filter("part > 0 AND part < block_size").select("rank", F.col("block").alias("edge_block"), F.col("part").alias("quota"))
    known = scratch.save(known.join(some(split), "rank", "left"), "known")
    place = at("hash", F.lit(1))
    edge = of_source(keys.filter("size > 0"), known.filter("edge_block IS NOT NULL")).filter(F.pmod(F.col("hash"), F.col("n_blocks")) == F.col("edge_block"))
    edge = edge.groupBy("rank", "quota", place.alias("edge_place")).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("twins"))
    edge = edge.withColumn("before", F.sum("words").over(by_source.orderBy("edge_place")) - F.col("words")).filter("before < quota AND before + words >= quota")
    known = scratch.save(known.join(some(edge.select("rank", "edge_place", F.floor((F.col("quota") - F.col("before")) / F.col("twins")).alias("edge_words"))), "rank", "left"), "planned")

    rows = of_source(keyed, known).withColumn("block", F.pmod(F.col("hash"), F.col("n_blocks")).cast("int")).withColumn("place", place)
    few = int(cat["n_blocks"].sum()) <= p.broadcast_blocks  # some 200 bytes a block
    rows = rows.join(F.broadcast(per_block) if few else per_block, ["rank", "block"], "left")
    extra = (
        F.when(F.coalesce("part", F.lit(0)) == 0, 0).when((F.col("part") == F.col("block_size")) | (F.col("place") < F.col("edge_place")), F.col("size"))
        .when(F.col("place") == F.col("edge_place"), F.least("size", "edge_words")).otherwise(0)
    )
    rows = rows.withColumn("extra", extra.cast("long"))
    words = lambda d: F.when(d["whole"], F.col("size")).otherwise(F.col("extra"))
    taken = F.transform(F.coalesce("drawn", F.array().cast("array<struct<copy:int,shard:int,whole:boolean>>")), lambda d: F.struct(d["shard"].alias("shard"), d["copy"].alias("copy"), words(d).alias("words")))
    rows = rows.withColumn("draws", F.filter(taken, lambda d: d["words"] > 0))
    rows = rows.withColumn("taken", F.aggregate("draws", F.lit(0).cast("long"), lambda s, d: s + d["words"]))
    return rows.select("row", F.struct("size", "source_size", "target", "taken", "draws").alias("mix"))


def n_shards(words: float, p: MixParams) -> int:
    return p.shards or min(p.most_shards, max(1, math.ceil(words / p.shard_words)))


def first_words(text: Column, n: Column) -> Column:
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0)), 1, n.cast("int")), "")


def mixed_documents(docs: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """The mix itself: a row of docs for each draw, shards in order, each shuffled and, if large, in several partitions.

    Nulls, repeated rows and clashing names as in plan_mix; n_chars, if there, is that of a cut text.
    """
    p = params
    plan = plan_mix(docs, p)
    # one row for each source
    total = plan.select("mix.source_size", "mix.target", "row.source").groupBy("source").agg(F.first("target").alias("target")).agg(F.sum("target").alias("n")).first()["n"] or 0.0
    shards = n_shards(total, p)
    slices = max(1, math.ceil(total / (shards * p.shard_words))) if p.shards is None else 1
    rows = plan.select("row", F.col("mix.size").alias("size"), F.explode("mix.draws").alias("draw"))
    cut, text = F.col("draw.words") < F.col("size"), F.col("row.text")
    rows = rows.withColumn("text", F.when(cut, first_words(text, F.col("draw.words"))).otherwise(text))
    rows = rows.withColumn("order", F.xxhash64("row.doc_id", "text", "draw.copy", F.lit(p.seed + 1)))
    # the order's highest bits name the slice
    rows = rows.withColumn("slice", F.floor((F.shiftright("order", 32).cast("double") / 2**32 + 0.5) * slices).cast("int"))
    rows = rows.repartitionById(shards * slices, (F.col("draw.shard") * slices + F.col("slice")).cast("int")).sortWithinPartitions("draw.shard", "order")

    def named(c: str) -> Column:
        field = F.col("row").getField(c)
        if c == "text":
            return F.col("text").alias(c)
        return F.when(cut, F.length("text").cast(docs.schema[c].dataType)).otherwise(field).alias(c) if c == "n_chars" else field.alias(c)

    return rows.select(*[named(c) for c in docs.columns])
