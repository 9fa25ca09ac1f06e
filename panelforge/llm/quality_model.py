"""Quality by supervised subword embeddings: the mean vector of a text's words and softmax.

Each word adds the vector of its own hash and those of its character n-grams, each pair of
equal neighbours a vector that all such pairs share. The output is linear in the mean, so
once fitted a word's part is two numbers, kept for words already met.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from panelforge.llm.common import WordMemo, arrow_map, bounded_batches, give_back, held_out_by
from panelforge.llm.words import coded_words, labelled_sample, segment_sums


@dataclass(frozen=True)
class QualityParams:
    sample: int = 4000  #: labelled documents that are used for fitting, at most
    bits: int = 17  #: of the table of vectors; the vector after the last is that of equal neighbours
    width: int = 8
    grams: tuple[int, int] = (3, 5)
    epochs: int = 4  #: at least; more until so many texts are seen
    steps: int = 25_000
    rate: float = 8.0
    threshold: float = 0.7
    seed: int = 5


def word_slots(word: str, p: QualityParams) -> list[int]:
    mask = (1 << p.bits) - 1
    if not word:
        return []
    shown = f"<{word}>"
    grams = {shown[i : i + n] for n in range(p.grams[0], p.grams[1] + 1) for i in range(len(shown) - n + 1)}
    return [zlib.crc32(word.encode()) & mask, *[zlib.crc32(g.encode(), 1) & mask for g in sorted(grams)]]


class SubwordModel:
    def __init__(self, p: QualityParams):
        rng = np.random.default_rng(p.seed)
        self.p = p
        self.vectors = rng.uniform(-1 / p.width, 1 / p.width, ((1 << p.bits) + 1, p.width)).astype(np.float32)
        self.out = np.zeros((p.width, 2), np.float32)
        self.bias = np.zeros(2, np.float32)

    def fit(self, texts: Iterable[tuple[np.ndarray, np.ndarray, int]]) -> None:
        """texts: distinct slots, their counts, label. Plain stochastic gradient descent, the rate falling to 0."""
        texts = list(texts)
        epochs = max(self.p.epochs, -(-self.p.steps // max(1, len(texts))))
        rng, done, total = np.random.default_rng(self.p.seed), 0, max(1, epochs * len(texts))
        for _ in range(epochs):
            for i in rng.permutation(len(texts)):
                slots, count, label = texts[i]
                rate = np.float32(self.p.rate * (1 - done / total))
                done += 1
                share = (count / count.sum()).astype(np.float32)
                mean = share @ self.vectors[slots]
                z = mean @ self.out + self.bias
                e = np.exp(z - z.max())
                gap = e / e.sum()
                gap[label] -= 1
                back = self.out @ gap
                self.out -= 0.1 * rate * np.outer(mean, gap)
                self.bias -= 0.1 * rate * gap
                self.vectors[slots] -= rate * np.outer(share, back)

    def flat(self) -> tuple[np.ndarray, float]:
        """What each vector adds to the difference of the outputs, and the rest of it."""
        return self.vectors @ (self.out[:, 1] - self.out[:, 0]), float(self.bias[1] - self.bias[0])


def text_parts(texts: pa.Array, memo: WordMemo) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Words, codes and starts without empty words, and the equal neighbours of each text."""
    words, codes, starts = coded_words(texts)
    full = np.array([bool(w) for w in words], bool)[codes] if len(codes) else np.zeros(0, bool)
    starts = np.concatenate([[0], np.cumsum(full)])[starts]
    codes = codes[full]
    same = np.zeros(len(codes))
    same[1:] = codes[1:] == codes[:-1]
    same[starts[:-1][starts[:-1] < len(codes)]] = 0
    return words, codes, starts, segment_sums(same, starts)


def fit(sample: list[tuple[str, int]], p: QualityParams = QualityParams()) -> SubwordModel:
    model = SubwordModel(p)
    memo = WordMemo(lambda words: [np.array(word_slots(w, p), np.int64) for w in words])
    data = []
    for i in range(0, len(sample), 500):
        part = sample[i : i + 500]
        words, codes, starts, same = text_parts(pa.array([t for t, _ in part], pa.string()), memo)
        table = memo.table(set(words))
        for k, (_, label) in enumerate(part):
            ids, n = np.unique(codes[starts[k] : starts[k + 1]], return_counts=True)
            slots = [table[words[c]] for c in ids]
            weight = np.repeat(n, [len(s) for s in slots])
            flat = np.concatenate([*slots, [1 << p.bits]]).astype(np.int64)
            weight = np.append(weight, same[k])
            slots, at = np.unique(flat, return_inverse=True)
            count = np.bincount(at, weight)
            if count.sum():
                data.append((slots[count > 0].astype(np.int32), count[count > 0].astype(np.float32), int(label)))
    model.fit(data)
    del data, memo
    give_back()
    return model


def score_quality(docs: DataFrame, model: SubwordModel) -> DataFrame:
    """doc_id, score and predicted of every row. A null or empty text gets the score of the bias alone."""
    bounded_batches(docs.sparkSession)
    p, (adds, rest) = model.p, model.flat()
    shared = docs.sparkSession.sparkContext.broadcast(adds)  # 2**bits floats

    def scores(batches):
        table = shared.value

        def parts(words: list[str]) -> list[tuple[float, int]]:
            out = []
            for w in words:
                slots = word_slots(w, p)
                out.append((float(table[slots].sum()) if slots else 0.0, len(slots)))
            return out

        memo = WordMemo(parts, 300_000)
        for batch in batches:
            words, codes, starts, same = text_parts(batch["text"], memo)
            known = memo.table(set(words))
            each = np.array([known[w] for w in words], np.float64).reshape(-1, 2)
            total = segment_sums(each[codes, 0], starts) + same * float(table[-1])
            count = segment_sums(each[codes, 1], starts) + same
            score = 1 / (1 + np.exp(-np.clip(total / np.maximum(count, 1) + rest, -60, 60)))
            yield {"doc_id": batch["doc_id"], "score": score, "predicted": (score >= p.threshold).astype(np.int32)}

    return arrow_map(docs.select("doc_id", "text"), scores, "doc_id long, score double, predicted int", arrays=True)


def quality(docs: DataFrame, labels: DataFrame, params: QualityParams = QualityParams()) -> DataFrame:
    """Fitted on labels of three quarters of the ids; every row of docs scored, with held_out."""
    sample = labelled_sample(docs, labels, "quality", ~held_out_by(4, 2), params.sample)
    return score_quality(docs, fit(sample, params)).withColumn("held_out", held_out_by(4, 2))
