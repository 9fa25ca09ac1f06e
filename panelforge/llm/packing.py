"""Packing of token pieces into sequences: exact complements first, best fit for the rest.

Only lengths decide where pieces go, so the plan is made on counts of lengths (at most as
many as a sequence has tokens), and each piece finds its place by its rank among the pieces
of its length. Nothing that grows with the corpus is on the driver.
"""

from __future__ import annotations

import bisect
from collections import Counter, defaultdict

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.llm.common import Scratch, arrow_map, bounded_batches, crc_u32
from panelforge.llm.tokenize import encoder


class Complements:
    """Index of the lengths in stock and of the sums of two of them, as bits of integers.

    Bit s of pair_sums is set if two lengths in stock have the sum s, be they one length with
    a single piece; whoever reads it counts the pieces. It is made again when a length runs out.
    """

    def __init__(self, stock: np.ndarray):
        self.stock, self.known = stock, -1
        self.refresh()

    def refresh(self) -> None:
        lengths = np.flatnonzero(self.stock)
        if len(lengths) == self.known:  # stock only falls
            return
        self.known, size = len(lengths), len(self.stock)
        singles = sum(1 << int(x) for x in lengths)
        sums = 0
        for x in lengths.tolist():
            sums |= singles << x
        unpacked = np.frombuffer((sums & ((1 << size) - 1)).to_bytes(-(-size // 8), "little"), np.uint8)
        self.pair_sums = np.unpackbits(unpacked, bitorder="little")[:size].astype(bool)

    @staticmethod
    def pair(total: int, left: np.ndarray) -> list[int] | None:
        """Two lengths with this sum of which left has enough, the longer first and as long as it can be."""
        a = np.arange(1, total // 2 + 1)
        fits = (left[a] > 0) & (left[total - a] > 0)
        if total % 2 == 0 and total:
            fits[-1] = left[total // 2] > 1
        at = np.flatnonzero(fits)
        return [total - int(a[at[0]]), int(a[at[0]])] if len(at) else None

    def filling(self, first: int, gap: int) -> list[int] | None:
        """One to three further lengths that fill the gap beside first, the longest first; None only if there are none."""
        self.refresh()
        left = self.stock.copy()
        left[first] -= 1
        if left[gap] > 0:
            return [gap]
        if self.pair_sums[gap] and (two := self.pair(gap, left)):
            return two
        rest = np.arange(gap, -1, -1)  # what a third length of 0, 1, 2, ... leaves
        third = np.flatnonzero((left[: gap + 1] > 0) & self.pair_sums[rest])
        for a in third[::-1].tolist():
            left[a] -= 1
            if two := self.pair(gap - a, left):
                return sorted([a, *two], reverse=True)
            left[a] += 1
        return None


def plan(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns (copies of each length in a sequence) with the number of sequences of each."""
    stock = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        stock[length] = n
    made: list[tuple[dict[int, int], int]] = []
    if stock[capacity]:
        made.append(({capacity: 1}, int(stock[capacity])))
        stock[capacity] = 0
    index = Complements(stock)
    for length in range(capacity - 1, 0, -1):
        while stock[length]:
            more = index.filling(length, capacity - length)
            if more is None:
                break
            uses = Counter([length, *more])
            times = min(int(stock[x]) // n for x, n in uses.items())
            made.append((dict(uses), times))
            for x, n in uses.items():
                stock[x] -= n * times
    # what has no exact complement: best fit, the longest first, equal sequences at once
    gaps: list[int] = []
    bins: dict[int, list[list]] = defaultdict(list)

    def keep(uses: dict[int, int], gap: int, times: int) -> None:
        if gap == 0:
            made.append((uses, times))
            return
        if not bins[gap]:
            bisect.insort(gaps, gap)
        bins[gap].append([uses, times])

    for length in range(capacity - 1, 0, -1):
        left = int(stock[length])
        while left:
            at = bisect.bisect_left(gaps, length)
            if at == len(gaps):
                each = capacity // length
                if left >= each:
                    keep({length: each}, capacity - each * length, left // each)
                if left % each:
                    keep({length: left % each}, capacity - left % each * length, 1)
                left = 0
                continue
            gap = gaps[at]
            uses, times = bins[gap].pop()
            if not bins[gap]:
                gaps.pop(at)
            each = min(gap // length, left)
            take = min(times, left // each)
            if take < times:
                keep(uses, gap, times - take)
            keep({**uses, length: uses.get(length, 0) + each}, gap - each * length, take)
            left -= take * each
    return made + [(uses, times) for gap in gaps for uses, times in bins[gap]]


def slots(patterns: list[tuple[dict[int, int], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: pieces placed before, first sequence, first offset and copies of each of its slots."""
    by: dict[int, list] = defaultdict(list)
    placed: Counter = Counter()
    sequence = 0
    for uses, times in patterns:
        offset = 0
        for length in sorted(uses, reverse=True):
            by[length].append((placed[length], sequence, offset, uses[length]))
            placed[length] += uses[length] * times
            offset += uses[length] * length
        sequence += times
    return {k: tuple(np.array(c, np.int64) for c in zip(*v, strict=True)) for k, v in by.items()}


def place(length: np.ndarray, rank: np.ndarray, table: dict[int, tuple[np.ndarray, ...]]) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of the pieces with these lengths and ranks."""
    sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
    for x in np.unique(length):
        mine = length == x
        before, first, at, copies = table[int(x)]
        k = np.searchsorted(before, rank[mine], side="right") - 1
        nth = rank[mine] - before[k]
        sequence[mine] = first[k] + nth // copies[k]
        offset[mine] = at[k] + nth % copies[k] * x
    return sequence, offset


def cut_pieces(docs: DataFrame, tokenizer: str, space_prefix: bool, end_id: int, capacity: int, words_kept: int) -> DataFrame:
    """Pieces with the partition that made them and their rank among its pieces of that length."""
    bounded_batches(docs.sparkSession, 2000)

    def pieces(batches):
        words, chunk, seen = encoder(tokenizer, space_prefix, words_kept), TaskContext.get().partitionId(), Counter()
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "chunk", "nth")}
            for doc, ids in zip(batch["doc_id"].to_pylist(), words.encode(batch["text"]), strict=True):
                ids = np.append(ids, ids.dtype.type(end_id))
                first = (len(ids) - 1) % capacity + 1
                start, piece = 0, 0
                while start < len(ids):
                    stop = first + piece * capacity
                    for k, v in (("doc_id", doc), ("piece", piece), ("start", start), ("length", stop - start), ("ids_crc32", crc_u32(ids[start:stop])), ("chunk", chunk), ("nth", seen[stop - start])):
                        out[k].append(v)
                    seen[stop - start] += 1
                    start, piece = stop, piece + 1
            yield out

    return arrow_map(docs.select("doc_id", "text"), pieces, "doc_id long, piece int, start long, length long, ids_crc32 long, chunk int, nth long", arrays=True)


def pack_documents(docs: DataFrame, tokenizer: str, space_prefix: bool = True, end_id: int = 0, capacity: int = 2048, words_kept: int = 400_000) -> DataFrame:
    """Every piece of every document with its sequence and its place there.

    A null or empty text is its end id alone; repeated rows are packed each. A document longer
    than capacity is cut so that all pieces but the first are full. An empty table gives no rows.
    words_kept bounds the words that a worker remembers, never the result.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    pieces = scratch.save(cut_pieces(docs, tokenizer, space_prefix, end_id, capacity, words_kept), "pieces")
    counts = pieces.groupBy("chunk", "length").agg(F.count(F.lit(1)).alias("n"))
    # at most one row for each length and chunk
    counts = scratch.save(counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("chunk")) - F.col("n")).select("chunk", "length", "n", "before"), "counts")
    stock = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    table = slots(plan(stock, capacity))

    def placed(batches):
        for b in batches:
            length = np.array(b["length"], np.int64)
            sequence, offset = place(length, np.array(b["nth"], np.int64) + np.array(b["before"], np.int64), table)
            yield {**b, "sequence_id": sequence, "offset": offset}

    ranked = pieces.join(counts.drop("n"), ["chunk", "length"])
    out = arrow_map(ranked, placed, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return out
