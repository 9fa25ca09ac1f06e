"""Language-model scores from a log-frequency Bloom filter of quantised bigram counts.

A bigram with quantised count q is stored as q entries, (bigram, 1) to (bigram, q), so its
count is read by probing until an entry is missing. A token's probability interpolates that
count with the base model's unigram: (c(u,w) + k * p(w)) / (c(u) + k).

A false positive raises a count by one level; all else that is stored never exceeds the counts.

Texts become chunks of coded tokens once. What is counted travels as packed arrays of hashed
keys, one for each chunk and hash bucket, is merged by bucket, and answers return by chunk.
The filter is cut into segments by bucket. If all of it is sure to stay below a limit, it is
broadcast and workers probe it; beyond that each segment is probed where it was built, by
the chunks' keys that were sent there anyway. Both ways give the same scores.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import Scratch, arrow_map, bounded_batches, held_out_by, mix64, pack, unpack
from panelforge.llm.words import coded_words, segment_sums


@dataclass(frozen=True)
class LmParams:
    chunk_tokens: int = 1 << 19
    bucket_tokens: int = 1 << 19  #: of all texts for each hash bucket, at most
    smoothing: float = 0.1  #: added to unigram counts
    weight: float = 50.0  #: of the unigram beside a bigram's count
    key_bits: int = 40  #: of a bigram's key beside its bucket
    bits: int = 10  #: of the filter for each entry
    probes: int = 5
    broadcast_mb: int = 32


#: Keys of the end of a text and of what stands before its first token.
END, START = np.uint64(0xE0D), np.uint64(0x57A)


def quantise(count: np.ndarray) -> np.ndarray:
    """1 + floor(log2(count)) for counts from 1."""
    return np.frexp(count.astype(np.float64))[1]


def restored(q: np.ndarray) -> np.ndarray:
    """The least count of a level, so that a context's followers never sum to more than the context; 0 for level 0."""
    return np.where(q > 0, 2.0 ** (q - 1.0), 0.0)


class Segment:
    """The filter's part for one bucket."""

    def __init__(self, bits: np.ndarray, size: int, probes: int):
        self.bits, self.size, self.probes = bits, size, probes

    @staticmethod
    def _places(keys: np.ndarray, level: int, size: int, probes: int, first: int = 0):
        a = mix64(keys + np.uint64(level * 0x9E3779B97F4A7C15 % 2**64))
        b = (a >> np.uint64(32)) | np.uint64(1)
        for i in range(first, first + probes):
            yield ((a + np.uint64(i) * b) & np.uint64(0xFFFFFFFF)) * np.uint64(size) >> np.uint64(32)

    @classmethod
    def build(cls, keys: np.ndarray, q: np.ndarray, p: LmParams) -> Segment:
        size = max(64, int(q.sum()) * p.bits)
        flags = np.zeros(size, bool)
        for level in range(1, int(q.max(initial=0)) + 1):
            for place in cls._places(keys[q >= level], level, size, p.probes):
                flags[place] = True
        return cls(np.packbits(flags), size, p.probes)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        out, at, level = np.zeros(len(keys), np.uint8), np.arange(len(keys)), 1
        while len(at):
            for i in range(self.probes):  # a key that misses a bit is not probed further
                place = next(self._places(keys[at], level, self.size, 1, i))
                at = at[(self.bits[place >> np.uint64(3)] >> (np.uint64(7) - (place & np.uint64(7))).astype(np.uint8)) & 1 > 0]
            out[at] = level
            level += 1
        return out


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, byte plane by byte plane."""
    gaps = np.diff(keys, prepend=np.uint64(0))
    return pack(gaps.view(np.uint8).reshape(-1, 8).T)


def unpack_keys(blob: bytes) -> np.ndarray:
    planes = unpack(blob, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def buckets(keys: np.ndarray, bucket_bits: int, key_bits: int) -> np.ndarray:
    """Where each bucket's stretch of sorted keys starts, and the end."""
    edges = np.arange(1, 1 << bucket_bits, dtype=np.uint64) << np.uint64(key_bits)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


class Chunk:
    """Tokens of some documents: a code for each token, a 64-bit key for each code."""

    def __init__(self, keys: np.ndarray, codes: np.ndarray, starts: np.ndarray, train: np.ndarray):
        self.keys, self.codes, self.starts, self.train = keys, codes, starts, train  #: train: of each document

    def counts(self) -> np.ndarray:
        """Training count of each code."""
        return np.bincount(self.codes[np.repeat(self.train, np.diff(self.starts))], minlength=len(self.keys))

    def before(self) -> np.ndarray:
        """Code of the token before each token, -1 at the start of a text."""
        out = np.concatenate([[-1], self.codes[:-1].astype(np.int64)])
        out[self.starts[:-1]] = -1
        return out

    def bigrams(self, bucket_bits: int, key_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct keys in order, the training count of each, and which one each token has."""
        u = self.before()
        left = np.where(u < 0, START, self.keys[u])
        key = mix64(left * np.uint64(0x9E3779B97F4A7C15) + self.keys[self.codes]) >> np.uint64(64 - bucket_bits - key_bits)
        keys, which = np.unique(key, return_inverse=True)
        train = np.repeat(self.train, np.diff(self.starts))
        return keys, np.bincount(which[train], minlength=len(keys)), which


def chunked(docs: DataFrame, p: LmParams) -> DataFrame:
    bounded_batches(docs.sparkSession)

    def chunks(batches):
        import xxhash

        part, number = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        size = 0

        def flush():
            nonlocal held, size, number
            names: dict[int, int] = {}
            codes, starts, ids, out = [], [0], [], []
            for keys, own, own_starts, own_ids, own_out in held:
                names_of = np.array([names.setdefault(k, len(names)) for k in keys], np.uint32)
                codes.append(names_of[own])
                starts += (starts[-1] + own_starts[1:]).tolist()
                ids += own_ids
                out += own_out
            keys = np.array(list(names), np.uint64)
            order = np.argsort(keys, kind="stable")
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order))
            row = {"chunk": [(part << 32) + number], "n_tokens": [starts[-1]], "doc_id": [ids], "held_out": [out], "lengths": [pack(np.diff(starts).astype(np.uint32))], "codes": [pack(rank[np.concatenate(codes)])], "word_keys": [pack(keys[order])]}
            held, size, number = [], 0, number + 1
            return row

        for batch in batches:
            words, codes, starts = coded_words(pc.ascii_lower(batch["text"].fill_null("")))
            full = np.array([bool(w) for w in words], bool)[codes] if len(codes) else np.zeros(0, bool)
            starts = np.concatenate([[0], np.cumsum(full)])[starts]
            keys = [xxhash.xxh64_intdigest(w) for w in words] + [int(END)]
            # an end after each text
            ends = np.insert(codes[full].astype(np.int64), starts[1:], len(words))
            starts = starts + np.arange(len(starts))
            used, own = np.unique(ends, return_inverse=True)
            held.append(([keys[i] for i in used], own, starts, batch["doc_id"].to_pylist(), batch["held_out"].to_pylist()))
            size += len(ends)
            if size >= p.chunk_tokens:
                yield flush()
        if held:
            yield flush()

    rows = docs.select("doc_id", "text", held_out_by(10, 0).alias("held_out"))
    return arrow_map(rows, chunks, "chunk long, n_tokens long, doc_id array<long>, held_out array<boolean>, lengths binary, codes binary, word_keys binary", arrays=True)


def opened(word_keys: bytes, codes: bytes, lengths: bytes, held_out: list[bool]) -> Chunk:
    starts = np.concatenate([[0], np.cumsum(unpack(lengths, np.uint32), dtype=np.int64)])
    return Chunk(unpack(word_keys, np.uint64), unpack(codes, np.uint32), starts, ~np.array(held_out, bool))


def score_documents(docs: DataFrame, params: LmParams = LmParams()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    A null or empty text has the end token alone; a null doc_id is trained on. Repeated rows
    count each time and score alike. Without training texts the base is uniform over nothing
    seen; an empty table gives no rows. Words and bigrams are told apart by hashed keys. The same
    rows score alike in any order, partitioning and session.
    """
    p, spark = params, docs.sparkSession
    scratch = Scratch(spark, "lm")
    chunks = scratch.save(chunked(docs, p), "chunks")
    # keys, buckets and with them the filter depend on the texts alone, not on the session or the partitions
    tokens = chunks.agg(F.sum("n_tokens").alias("n")).first()["n"] or 0
    bucket_bits = max(1, math.ceil(math.log2(max(1, tokens / p.bucket_tokens))))
    payload = ("word_keys", "codes", "lengths", "held_out")

    def sent(keys: np.ndarray, count: np.ndarray, chunk: int, shift: int):
        """Stretches of sorted keys and their counts by bucket."""
        at = buckets(keys, bucket_bits, shift)
        some = np.flatnonzero(np.diff(at))
        return {"bucket": some, "chunk": [chunk] * len(some), "keys": [pack_keys(keys[at[b] : at[b + 1]]) for b in some], "counts": [pack(count[at[b] : at[b + 1]].astype(np.uint32)) for b in some]}

    def word_counts(batches):
        for batch in batches:
            for chunk, *parts in zip(batch["chunk"], *(batch[k] for k in payload), strict=True):
                c = opened(*parts)
                yield sent(c.keys, c.counts(), chunk, 64 - bucket_bits)

    def bigram_counts(batches):
        for batch in batches:
            for chunk, *parts in zip(batch["chunk"], *(batch[k] for k in payload), strict=True):
                keys, count, _ = opened(*parts).bigrams(bucket_bits, p.key_bits)
                yield sent(keys, count, chunk, p.key_bits)

    def merged(pdf: pd.DataFrame) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        """Keys of each chunk, all distinct keys, their counts, and which one each key is."""
        keys = [unpack_keys(k) for k in pdf["keys"]]
        all_keys, which = np.unique(np.concatenate(keys), return_inverse=True)
        return keys, all_keys, np.bincount(which, np.concatenate([unpack(c, np.uint32) for c in pdf["counts"]]), len(all_keys)).astype(np.int64), which

    def look_up(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, _, total, which = merged(pdf)
        ends = np.cumsum([len(k) for k in keys])
        n, v = [0] * len(pdf), [0] * len(pdf)
        n[0], v[0] = int(total.sum()), int((total > 0).sum())
        return pd.DataFrame({"bucket": pdf["bucket"], "chunk": pdf["chunk"], "answer": [pack(x) for x in np.split(total[which].astype(np.uint64), ends[:-1])], "n": n, "v": v})

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        _, keys, total, _ = merged(pdf)
        s = Segment.build(keys[total > 0], quantise(total[total > 0]), p)
        return pd.DataFrame({"bucket": [pdf["bucket"].iloc[0]], "size": [s.size], "filter": [s.bits.tobytes()]})

    def build_and_probe(pdf: pd.DataFrame) -> pd.DataFrame:
        own, keys, total, which = merged(pdf)
        s = Segment.build(keys[total > 0], quantise(total[total > 0]), p)
        ends = np.cumsum([len(k) for k in own])
        return pd.DataFrame({"bucket": pdf["bucket"], "chunk": pdf["chunk"], "answer": [pack(x) for x in np.split(s.levels(keys)[which], ends[:-1])]})

    one = "bucket int, chunk long, keys binary, counts binary"
    words = arrow_map(chunks.select("chunk", *payload), word_counts, one)
    found = scratch.save(words.groupBy("bucket").applyInPandas(look_up, "bucket int, chunk long, answer binary, n long, v long"), "found")
    row = found.agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    n, v = int(row["n"] or 0), int(row["v"] or 0)
    by_chunk = lambda t, name: t.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("bucket", "answer"))).alias(name))
    known = chunks.join(by_chunk(found, "words"), "chunk")

    grams = arrow_map(chunks.select("chunk", *payload), bigram_counts, one)
    # a training token adds at most as many entries as its count has doublings, so n bounds the entries
    if n * p.bits / 8e6 <= p.broadcast_mb:
        rows = grams.groupBy("bucket").applyInPandas(build, "bucket int, size long, filter binary").collect()
        shared = spark.sparkContext.broadcast({r["bucket"]: (r["size"], bytes(r["filter"])) for r in rows})
        known = known.withColumn("levels", F.lit(None).cast("array<struct<bucket:int,answer:binary>>"))
    else:
        shared = None
        levels = scratch.save(grams.groupBy("bucket").applyInPandas(build_and_probe, "bucket int, chunk long, answer binary"), "levels")
        known = known.join(by_chunk(levels, "levels"), "chunk")

    def scores(batches):
        for batch in batches:
            for ids, held, word_answers, level_answers, *parts in zip(batch["doc_id"], batch["held_out"], batch["words"], batch["levels"], *(batch[k] for k in payload), strict=True):
                c = opened(*parts)
                count = np.concatenate([unpack(a["answer"], np.uint64) for a in word_answers]).astype(np.float64)
                base = np.log10((count + p.smoothing) / (n + p.smoothing * (v + 1)))
                keys, _, which = c.bigrams(bucket_bits, p.key_bits)
                if shared is not None:
                    at, level = buckets(keys, bucket_bits, p.key_bits), np.zeros(len(keys), np.uint8)
                    for b, (size, bits) in shared.value.items():
                        level[at[b] : at[b + 1]] = Segment(np.frombuffer(bits, np.uint8), size, p.probes).levels(keys[at[b] : at[b + 1]])
                else:
                    level = np.concatenate([unpack(a["answer"], np.uint8) for a in level_answers])
                pair = restored(level.astype(np.float64))[which]
                u = c.before()
                texts = count[np.searchsorted(c.keys, END)]  # every text has one end and one start
                context = np.maximum(np.where(u < 0, texts, count[u]), pair)
                token = c.codes
                chance = (pair + p.weight * 10 ** base[token]) / (context + p.weight)
                lengths = np.diff(c.starts)
                yield {
                    "doc_id": ids, "held_out": held, "n_tokens": lengths, "n_known": segment_sums(count[token] > 0, c.starts).astype(np.int64),
                    "train_tokens": [n] * len(ids), "base_score": segment_sums(base[token], c.starts), "score": segment_sums(np.log10(chance), c.starts),
                }

    out = arrow_map(known, scores, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out
