"""Exact top-k by inner product: a ball tree on each shard of the vectors, branch and bound.

A node's bound for a query is the product with its centre plus its radius times the query's
length, or, if lower, the longest row of the node times the query's length. Nodes are visited
by that bound; the query's current kth score prunes nodes, and in a leaf it prunes rows by
their own distance from the leaf's centre. Trees are built once and kept in the shared folder.

The search goes in waves: a query meets one shard, then one, two, four and so on of the others;
after each wave the kth score over all shards met so far goes with the query to the next.

Components are integers. Products are made in floating point while they are exact there, in
64-bit integers while they fit, and in integers of any size beyond, so scores and comparisons
are exact; a score among the results that no long can hold is an error.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.llm.common import Scratch, pack, unpack

LONG = 1 << 63


@dataclass(frozen=True)
class TopKParams:
    k: int = 5
    scale: int = 256
    shard_rows: int = 16_384  #: aimed at
    leaf_rows: int = 128
    group_rows: int = 32_768  #: queries that meet a shard at once, aimed at
    block_rows: int = 4096  #: of these go down the tree together
    every: int = 50  #: rows whose id this divides are the queries


def quantised(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component; null for vectors that take no part. Beyond a long: an error."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    fit = vector.isNotNull() & F.forall(vector, finite)
    scaled = lambda x: x.cast("double") * scale
    held = lambda x: F.when(F.abs(scaled(x)) < float(LONG), F.floor(scaled(x))).otherwise(F.raise_error(F.lit("a component times the scale fits no long")).cast("long"))
    return F.when(fit, F.transform(vector, held))


class BallTree:
    """Nodes as arrays; the rows of a node are a stretch of the reordered matrix."""

    def __init__(self, keys: np.ndarray, ids: np.ndarray, rows: np.ndarray, span: np.ndarray, kids: np.ndarray):
        self.keys, self.ids, self.rows, self.span, self.kids = keys, ids, rows, span, kids
        self.real = rows.astype(np.float64)
        self.most = int(max(abs(int(rows.max(initial=0))), abs(int(rows.min(initial=0)))))
        self.length = np.sqrt((self.real**2).sum(axis=1))
        self.centre = np.empty((len(span), rows.shape[1]))
        self.radius, self.longest = np.empty(len(span)), np.empty(len(span))
        self.away = np.empty(len(rows))  #: of each row from its leaf's centre
        for n, (lo, hi) in enumerate(span):
            part = self.real[lo:hi]
            self.centre[n] = part.mean(axis=0)
            away = np.sqrt(((part - self.centre[n]) ** 2).sum(axis=1))
            self.radius[n], self.longest[n] = away.max(), self.length[lo:hi].max()
            if kids[n, 0] < 0:
                self.away[lo:hi] = away

    @classmethod
    def build(cls, keys: np.ndarray, ids: np.ndarray, rows: np.ndarray, leaf: int) -> BallTree:
        real, order = rows.astype(np.float64), np.arange(len(rows))
        span: list[tuple[int, int]] = [(0, len(rows))]
        kids: list[tuple[int, int]] = [(-1, -1)]
        todo = [0]
        while todo:
            me = todo.pop()
            lo, hi = span[me]
            part = real[order[lo:hi]]
            away = ((part - part.mean(axis=0)) ** 2).sum(axis=1)
            if hi - lo <= leaf or away.max() == 0:
                continue
            one = part[away.argmax()]
            other = part[((part - one) ** 2).sum(axis=1).argmax()]
            order[lo:hi] = order[lo:hi][np.argsort(part @ (other - one), kind="stable")]
            mid = (lo + hi) // 2
            kids[me] = (len(span), len(span) + 1)
            todo += kids[me]
            span += [(lo, mid), (mid, hi)]
            kids += [(-1, -1)] * 2
        return cls(keys[order], ids[order], rows[order], np.array(span), np.array(kids))

    def to_bytes(self) -> list[bytes]:
        return [pack(x.astype("<i8")) for x in (self.keys, self.ids, self.rows, self.span, self.kids)]

    @classmethod
    def from_bytes(cls, blobs: list[bytes]) -> BallTree:
        keys, ids, rows, span, kids = (unpack(b, "<i8") for b in blobs)
        return cls(keys, ids, rows.reshape(len(ids), -1), span.reshape(-1, 2), kids.reshape(-1, 2))

    def products(self, q: np.ndarray, queries: np.ndarray, rows: slice | np.ndarray, wide: int) -> np.ndarray:
        if wide < 1 << 52:
            return (q @ self.real[rows].T).astype(np.int64)
        if wide < LONG:
            return queries.astype(np.int64) @ self.rows[rows].T
        return queries.astype(object) @ self.rows[rows].astype(object).T

    def search(self, query_keys: np.ndarray, queries: np.ndarray, kth: np.ndarray, k: int, together: int = 128) -> tuple[list[np.ndarray], list[np.ndarray], int]:
        """Ids and scores, best first, of the k best rows for each query, without rows below kth, and products made.

        All queries go down together: at a node only those whose bound reaches their kth score go on.
        """
        q = queries.astype(np.float64)
        length = np.sqrt((q**2).sum(axis=1))
        most = int(max(abs(int(queries.max(initial=0))), abs(int(queries.min(initial=0)))))
        wide = most * self.most * max(1, q.shape[1])
        kind, lowest = (np.int64, -LONG) if wide < LONG else (object, -(1 << 200))
        best: list[np.ndarray] = [np.empty(0, kind)] * len(q)
        who: list[np.ndarray] = [np.empty(0, np.int64)] * len(q)
        kth, made = kth.astype(np.float64), 0
        # floats are rounded: a bound is widened by far more than that can be
        slack = 1e-9 * (length * (np.abs(self.centre).max(initial=0) * np.sqrt(q.shape[1]) + self.longest.max(initial=0) + self.radius.max(initial=0))) + 1e-6
        stack = [(0, np.arange(len(q)), np.full(len(q), np.inf))]
        while stack:
            node, at, bound = stack.pop()
            going = bound >= kth[at]
            at = at[going]
            if not len(at):
                continue
            if self.kids[node, 0] >= 0:
                left, right = self.kids[node]
                up = [np.minimum(q[at] @ self.centre[n] + length[at] * self.radius[n], length[at] * self.longest[n]) + slack[at] for n in (left, right)]
                first = up[0] >= up[1]
                if len(at) < together:  # few queries stay together: the child that more of them put first
                    first[:] = 2 * first.sum() >= len(at)
                # the child with the higher bound first for each query; kth is better known for the other
                stack += [(right, at[first], up[1][first]), (left, at[~first], up[0][~first]), (right, at[~first], up[1][~first]), (left, at[first], up[0][first])]
                continue
            lo, hi = self.span[node]
            upper = np.minimum((q[at] @ self.centre[node])[:, None] + length[at][:, None] * self.away[lo:hi], length[at][:, None] * self.length[lo:hi]) + slack[at][:, None]
            open_ = upper >= kth[at][:, None]
            open_ &= self.keys[lo:hi] != query_keys[at][:, None]
            some, rows = open_.any(axis=1), open_.any(axis=0)
            if not some.any():
                continue
            at, open_, rows = at[some], open_[some][:, rows], lo + np.flatnonzero(rows)
            score = self.products(q[at], queries[at], rows, wide)
            made += score.size
            score = np.where(open_, score, lowest)
            least = kth[at]
            if score.shape[1] > k:
                least = np.maximum(least, np.partition(score, -k, axis=1)[:, -k].astype(np.float64))
            worth = open_ & (score.astype(np.float64) >= least[:, None])  # rounded alike, so equals stay
            for i in np.flatnonzero(worth.any(axis=1)):
                me, new = at[i], np.flatnonzero(worth[i])
                s, w = np.concatenate([best[me], score[i, new]]), np.concatenate([who[me], self.ids[rows[new]]])
                order = sorted(range(len(s)), key=lambda j: (-s[j], w[j])) if kind is object else np.lexsort((w, -s))
                best[me], who[me] = s[order[:k]], w[order[:k]]
                if len(best[me]) == k:
                    kth[me] = max(kth[me], float(best[me][-1]))
        return who, best, made


def top_k(vectors: DataFrame, params: TopKParams = TopKParams()) -> DataFrame:
    """query_id, rank, vec_id, score of the k best vectors for each query row.

    Takes vec_id and embedding; rows with a null id or an unfit vector take no part, vectors
    meet others of their own dimension only. Every row with a query's id is a query of its own
    and every other row a candidate, rows with the same id or vector too. Ties go to the smaller
    vec_id. No queries or no others: no rows.
    """
    p, spark = params, vectors.sparkSession
    scratch = Scratch(spark, "topk")
    rows = vectors.select("vec_id", quantised(F.col("embedding"), p.scale).alias("v")).filter("vec_id is not null and v is not null")
    # a number for each row, which no later step changes: rows of one id are told apart and dealt evenly
    rows = scratch.save(rows.select(F.monotonically_increasing_id().alias("key"), "vec_id", "v", F.size("v").alias("dim")), "rows")
    sizes = {r["dim"]: (r["n"], r["q"]) for r in rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("vec_id") % p.every == 0, 1)).alias("q")).collect()}  # one row for each dimension
    number = lambda counts: F.create_map(*[F.lit(x) for d, n in (counts or {0: 1}).items() for x in (d, n)])[F.col("dim")]
    shards = number({d: max(1, -(-n // p.shard_rows)) for d, (n, _) in sizes.items()})
    groups = number({d: max(1, -(-q // p.group_rows)) for d, (_, q) in sizes.items()})
    rows = rows.withColumn("shards", shards).withColumn("groups", groups).withColumn("shard", F.pmod(F.xxhash64("key", F.lit(1)), F.col("shards")).cast("int"))

    def plant(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key")
        v = np.stack(pdf["v"].to_list()) if pdf["dim"].iloc[0] else np.zeros((len(pdf), 1), np.int64)  # without components every product is 0
        tree = BallTree.build(pdf["key"].to_numpy(), pdf["vec_id"].to_numpy(), v.astype(np.int64), p.leaf_rows)
        return pd.DataFrame({"dim": [pdf["dim"].iloc[0]], "shard": [pdf["shard"].iloc[0]], "groups": [pdf["groups"].iloc[0]], "tree": [tree.to_bytes()]})

    trees = scratch.save(rows.groupBy("dim", "shard").applyInPandas(plant, "dim int, shard int, groups int, tree array<binary>"), "trees")
    asked = rows.filter(F.col("vec_id") % p.every == 0).withColumn("group", F.pmod(F.xxhash64("key", F.lit(2)), F.col("groups")).cast("int"))
    asked = scratch.save(asked.select("dim", "group", "key", F.col("vec_id").alias("query_id"), "v", "shard", "shards"), "asked")
    spread = trees.withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))

    def meet(key: tuple, tree: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(tree) and len(asked):
            ball = BallTree.from_bytes(list(tree["tree"].iloc[0]))
            for i in range(0, len(asked), p.block_rows):
                some = asked.iloc[i : i + p.block_rows]
                v = np.stack(some["v"].to_list()).astype(np.int64) if key[0] else np.zeros((len(some), 1), np.int64)
                who, best, _ = ball.search(some["key"].to_numpy(), v, some["kth"].to_numpy(np.float64), p.k)
                if any(not -LONG <= s < LONG for scores in best if scores.dtype == object for s in scores.tolist()):
                    raise OverflowError("a score fits no long")
                n = [len(w) for w in who]
                out.append(pd.DataFrame({"key": np.repeat(some["key"].to_numpy(), n), "query_id": np.repeat(some["query_id"].to_numpy(), n), "vec_id": np.concatenate(who), "score": np.concatenate(best).astype(np.int64)}))
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in ("key", "query_id", "vec_id", "score")}, dtype="int64")

    ranked = lambda found: found.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "vec_id"))).filter(F.col("rank") <= p.k)
    ddl = "key long, query_id long, vec_id long, score long"
    found = spark.createDataFrame([], ddl + ", rank int")
    first, wave, most = 0, 0, max([-(-n // p.shard_rows) for n, _ in sizes.values()], default=0)
    while first < most:
        width = max(1, first)
        known = found.groupBy("key").agg(F.max(F.when(F.col("rank") == p.k, F.col("score"))).cast("double").alias("kth"))
        now = asked.join(known, "key", "left").withColumn("kth", F.coalesce("kth", F.lit(float("-inf"))))
        step = F.sequence(F.lit(first), F.least(F.lit(first + width), F.col("shards")) - 1)
        now = now.filter(F.col("shards") > first).withColumn("to", F.explode(step)).withColumn("shard", F.pmod(F.col("shard") + F.col("to"), "shards").cast("int"))
        met = spread.groupBy("dim", "shard", "group").cogroup(now.groupBy("dim", "shard", "group")).applyInPandas(meet, ddl)
        found = scratch.save(ranked(met.unionByName(found.drop("rank"))), f"wave{wave}")
        if wave:
            scratch.drop(f"wave{wave - 1}")
        first, wave = first + width, wave + 1
    return found.select("query_id", "rank", "vec_id", "score")
