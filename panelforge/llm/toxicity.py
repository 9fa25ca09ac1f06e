"""Toxic spans by a linear-chain conditional random field over words.

Documents are labelled, not words, so training words get labels first: a word of a toxic
document is toxic if one of its features (the word, its first four or five letters) is found
in toxic documents so much more often than by chance that no feature of a vocabulary of that
size would be. The field is fitted to these labels with the same hashed features; for a text
its forward-backward marginals give the offending offsets and, summed, the document's score.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructField, StructType

from panelforge.llm.common import WordMemo, arrow_map, bounded_batches, give_back, held_out_by
from panelforge.llm.near_dup import NearDupParams, band_keys, shingles, signature, word_codes
from panelforge.llm.words import coded_words, labelled_sample, segment_sums, split_words


@dataclass(frozen=True)
class ToxicParams:
    sample: int = 3000  #: labelled documents that are used for fitting, at most
    toxic_share: float = 0.4  #: of the sample, at most
    bits: int = 18  #: of the table of feature weights
    window: int = 64  #: words of a chain; a text is as many chains as it needs
    epochs: int = 6  #: at least; more until so many batches are seen
    batches: int = 500
    rate: float = 0.5
    decay: float = 1e-4
    purity: float = 0.9
    chance: float = 0.3  #: expected number of features that pass by chance
    seed: int = 3


EDGE = ".,;:!?\"'()[]{}<>*_-%&$#|~"


def features(word: str) -> list[str]:
    plain = word.strip(EDGE).lower()
    if not plain:
        return []
    return [f"w{plain}", *[f"{n}{plain[:n]}" for n in (4, 5) if len(plain) >= n]]


def without_copies(sample: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """Without texts that share a band of MinHash values with one before: copies are no further evidence."""
    p, memo, seen, out = NearDupParams(words=3, bands=16, rows=3), word_codes(), set(), []
    for text, label in sample:
        codes = shingles(text.encode(), memo, p.words)
        keys = set(band_keys(signature(codes, p), p).tolist()) if len(codes) else set()
        if keys and not keys & seen:
            out.append((text, label))
        seen |= keys
    return out


def suspicious(sample: list[tuple[str, int]], p: ToxicParams) -> set[str]:
    """Features that toxic documents have far more often than chance allows."""
    with_, without = Counter(), Counter()
    sample = without_copies(sample)
    for text, label in sample:
        (with_ if label else without).update({f for w in set(split_words(text)) for f in features(w)})
    n1 = sum(label for _, label in sample)
    share = n1 / max(1, len(sample))
    if not 0 < share < 1:
        return set()
    need = math.log(max(1, len(with_ | without)) / p.chance)
    out = set()
    for f, a in with_.items():
        n = a + without[f]
        q = a / n
        surprise = n * (q * math.log(q / share) + ((1 - q) * math.log((1 - q) / (1 - share)) if q < 1 else 0))
        if q >= p.purity and surprise >= need:
            out.add(f)
    return out


class Chain:
    """Two states; a word's score for the toxic one is the sum of its features' weights and the bias."""

    def __init__(self, bits: int):
        self.mask = (1 << bits) - 1
        self.weights = np.zeros(1 << bits, np.float32)
        self.bias = -4.0
        self.step = np.zeros((2, 2))  #: from, to

    def slots(self, word: str) -> list[int]:
        return [zlib.crc32(f.encode()) & self.mask for f in features(word)]

    def score(self, words: list[str]) -> list[float]:
        return [float(self.weights[s].sum()) + self.bias if (s := self.slots(w)) else self.bias for w in words]

    def marginals(self, scores: np.ndarray, live: np.ndarray, steps: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
        """P(toxic) of each word of each row of scores, and (if wanted) expected counts of the steps; live: not padding.

        Forward and backward messages are odds of the toxic state, so a step of all chains is
        a few products of one row of the transposed grid.
        """
        e = np.exp(np.clip(np.ascontiguousarray(scores.T), -200, 200))
        on = np.ascontiguousarray(live.T)
        (t00, t01), (t10, t11) = np.exp(self.step)
        ahead, back = np.empty_like(e), np.ones_like(e)
        ahead[0] = e[0]
        for i in range(1, len(e)):
            ahead[i] = e[i] * (t01 + ahead[i - 1] * t11) / (t00 + ahead[i - 1] * t10)
        for i in range(len(e) - 2, -1, -1):
            x = e[i + 1] * back[i + 1]
            back[i] = np.where(on[i + 1], (t10 + x * t11) / (t00 + x * t01), 1.0)
        odds = ahead * back
        prob = (odds / (1 + odds)).T
        if not steps:
            return prob, None
        x, y = ahead[:-1][on[1:]], (e * back)[1:][on[1:]]
        joint = np.stack([np.full_like(x, t00), t01 * y, t10 * x, t11 * x * y])
        return prob, (joint / joint.sum(axis=0)).sum(axis=1).reshape(2, 2)

    def fit(self, chains: list[tuple[list[str], np.ndarray]], p: ToxicParams) -> None:
        rng, slots = np.random.default_rng(p.seed), {}
        for words, _ in chains:
            for w in words:
                slots.setdefault(w, self.slots(w))
        g_w, g_b, g_t = np.full(len(self.weights), 1e-2, np.float32), 1e-2, np.full((2, 2), 1e-2)
        for _ in range(max(p.epochs, -(-64 * p.batches // len(chains)))):
            order = rng.permutation(len(chains))
            for i in range(0, len(order), 64):
                batch = [chains[k] for k in order[i : i + 64]]
                n = max(len(w) for w, _ in batch)
                live, gold = np.zeros((len(batch), n), bool), np.zeros((len(batch), n))
                at, place, total = [], [], np.full((len(batch), n), self.bias)
                for r, (words, y) in enumerate(batch):
                    live[r, : len(words)], gold[r, : len(words)] = True, y
                    for k, w in enumerate(words):
                        at += slots[w]
                        place += [r * n + k] * len(slots[w])
                at, place = np.array(at, np.int64), np.array(place, np.int64)
                total.ravel()[:] += np.bincount(place, self.weights[at], total.size)
                prob, steps = self.marginals(total, live)
                gap = np.where(live, prob - gold, 0.0)
                seen = np.zeros((2, 2))
                a, b = gold[:, :-1][live[:, 1:]].astype(int), gold[:, 1:][live[:, 1:]].astype(int)
                np.add.at(seen, (a, b), 1)
                d_w = np.bincount(at, gap.ravel()[place], len(self.weights)).astype(np.float32)
                touched = np.flatnonzero(d_w)
                d_w = d_w[touched] + p.decay * self.weights[touched]
                g_w[touched] += d_w**2
                self.weights[touched] -= p.rate * d_w / np.sqrt(g_w[touched])
                d_b, d_t = gap.sum(), (steps - seen) + p.decay * self.step
                g_b, g_t = g_b + d_b**2, g_t + d_t**2
                self.bias -= 0.2 * p.rate * d_b / math.sqrt(g_b)
                self.step -= 0.2 * p.rate * d_t / np.sqrt(g_t)

    def texts(self, texts: pa.Array, memo: WordMemo, window: int) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Words, codes, text starts, and P(toxic) of every word of whole texts."""
        words, codes, starts = coded_words(texts)
        table = memo.table(set(words))
        score = np.fromiter(map(table.__getitem__, words), np.float64, len(words))[codes]
        n = np.diff(starts)
        rows_of = -(-n // window)
        first_row = np.cumsum(rows_of) - rows_of
        text = np.repeat(np.arange(len(n)), n)
        nth = np.arange(len(codes)) - starts[:-1][text]
        row, col = first_row[text] + nth // window, nth % window
        grid, live = np.zeros((int(rows_of.sum()), window)), np.zeros((int(rows_of.sum()), window), bool)
        grid[row, col], live[row, col] = score, True
        for i in range(0, len(grid), 8192):  # every chain, some at a time
            grid[i : i + 8192] = self.marginals(grid[i : i + 8192], live[i : i + 8192], steps=False)[0]
        return words, codes, starts, grid[row, col]


def evidence(prob: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Toxic words of each text, each counted by the fourth power of its marginal: many doubtful words are not one sure one."""
    return segment_sums(prob**4, starts)


@dataclass
class ToxicModel:
    chain: Chain
    slope: float
    shift: float

    def document(self, expected: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * np.log(expected + 1e-2) + self.shift, -60, 60)))


def fit(sample: list[tuple[str, int]], p: ToxicParams = ToxicParams()) -> ToxicModel:
    """Without documents of both labels no word is toxic, and every score is that of a clean text."""
    chain, bad = Chain(p.bits), suspicious(sample, p)
    give_back()
    chains, rest = [], []
    for text, label in sample:
        words = split_words(text)
        hot = np.array([bool(label) and any(f in bad for f in features(w)) for w in words], float)
        for i in range(0, len(words), 16):
            (chains if hot[i : i + 16].any() else rest).append((words[i : i + 16], hot[i : i + 16]))
    if chains:
        rng = np.random.default_rng(p.seed)
        chains += [rest[i] for i in rng.permutation(len(rest))[: 2 * len(chains)]]
        chain.fit(chains, p)
    memo = WordMemo(chain.score)
    x, y = [], np.array([label for _, label in sample], float)
    for i in range(0, len(sample), 500):
        _, _, starts, prob = chain.texts(pa.array([t for t, _ in sample[i : i + 500]], pa.string()), memo, p.window)
        x.append(evidence(prob, starts))
    x = np.log(np.concatenate([*x, np.empty(0)]) + 1e-2)
    a, b = 1.0, -3.0  # nothing known: a text without toxic words scores near 0
    if chains:
        z, scale = (x - x.mean()) / (x.std() or 1), (x.std() or 1)
        for _ in range(400):  # logistic regression on the log of the expected number of toxic words
            gap = 1 / (1 + np.exp(-(a * z + b))) - y
            a, b = a - 0.5 * ((gap * z).mean() + 1e-3 * a), b - 0.5 * gap.mean()
        a, b = a / scale, b - a * x.mean() / scale
    give_back()
    return ToxicModel(chain, float(a), float(b))


def score_toxicity(docs: DataFrame, model: ToxicModel, p: ToxicParams = ToxicParams(), keep: list[str] | None = None, name: str = "_toxicity") -> DataFrame:
    """docs' doc_id (or the columns in keep) and one column of that name: score, predicted and spans (start, end, p) of toxic words.

    Null and empty texts have no toxic word. Each row is scored alone, so repeated rows agree;
    texts may be of any length, an empty table gives no rows, and columns not kept aren't read.
    """
    bounded_batches(docs.sparkSession)
    kept = keep or ["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the weight table: 2**bits floats

    def scores(batches):
        m = shared.value
        memo = WordMemo(m.chain.score)
        for batch in batches:
            words, codes, starts, prob = m.chain.texts(batch["text"], memo, p.window)
            score = m.document(evidence(prob, starts))
            spans = [[] for _ in score]
            text_of = np.searchsorted(starts, np.flatnonzero(prob >= 0.5), side="right") - 1
            for t in np.unique(text_of):
                at = 0
                for k in range(starts[t], starts[t + 1]):
                    w = words[codes[k]]
                    if prob[k] >= 0.5:
                        lead = len(w) - len(w.lstrip(EDGE))
                        spans[t].append({"start": at + lead, "end": at + max(lead, len(w.rstrip(EDGE))), "p": float(prob[k])})
                    at += len(w) + 1
            found = [{"score": x, "predicted": int(x >= 0.5), "spans": y} for x, y in zip(score.tolist(), spans, strict=True)]
            yield {**{c: batch[c] for c in kept}, name: found}

    found_type = StructType.fromDDL("score double, predicted int, spans array<struct<start:int,end:int,p:double>>")
    out = StructType([docs.schema[c] for c in kept] + [StructField(name, found_type)])
    return arrow_map(docs.select(*dict.fromkeys([*kept, "text"])), scores, out, arrays=True)


def toxicity(docs: DataFrame, labels: DataFrame, params: ToxicParams = ToxicParams()) -> DataFrame:
    """Fitted on labels of four fifths of the ids; every row of docs scored, with held_out.

    Null, empty and repeated rows as in score_toxicity; a null id is never held out. Labels that
    are null, of unknown ids or repeated do no harm; without both labels every score is low.
    """
    sample = labelled_sample(docs, labels, "toxic", ~held_out_by(5, 0), params.sample, params.toxic_share)
    return score_toxicity(docs, fit(sample, params), params).select("doc_id", "_toxicity.*").withColumn("held_out", held_out_by(5, 0))
