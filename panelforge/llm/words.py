"""Words of Arrow texts as codes, and bounded samples of labelled documents."""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


_SPACE = re.compile("[\t-\r ]")

#: Characters of a fitting sample, at most; texts beyond are left out whole.
SAMPLE_CHARS = 64_000_000


def split_words(text: str) -> list[str]:
    """The words of one text, cut as coded_words does."""
    return _SPACE.split(text)


def coded_words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words, the code of each word of each text, and where texts start among these.

    A word is what stands between single ASCII white-space characters, so it is empty where
    two of these are neighbours; offsets in a text follow from the words' lengths.
    """
    blank = pc.replace_substring_regex(texts.fill_null(""), "[\\t-\\r]", " ")
    split = pc.split_pattern(blank, " ")
    coded = split.flatten().dictionary_encode()
    offsets = split.offsets.to_numpy()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(), offsets - offsets[0]


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, train: Column, bound: int, positive_share: float | None = None, chars: int = SAMPLE_CHARS) -> list[tuple[str, int]]:
    """(text, label) of at most bound labelled training documents, chosen by a hash of their ids.

    The bound is a parameter of the classifiers that are fitted on it; labels never meet the
    documents that are scored. A repeated label counts as the higher one; null labels are left out.
    With positive_share, so many of the bound at most have label 1. Texts that would take the
    sample over chars characters, in the order of the hash, are left out.
    """
    known = labels.filter(F.col(column).isNotNull() & F.col("doc_id").isNotNull() & train).groupBy("doc_id").agg(F.max(column).cast("int").alias("_label"))
    order = F.xxhash64("doc_id", F.lit(11))

    def some(rows: DataFrame, n: int) -> DataFrame:
        return rows.orderBy(order, "doc_id").limit(n)

    if positive_share is None:
        chosen = some(known, bound)
    else:
        most = int(bound * positive_share)
        chosen = some(known.filter("_label = 1"), most).unionByName(some(known.filter("_label <> 1"), bound - most))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # bound ids
    rows = some(rows.filter("text is not null"), bound)
    upto = Window.orderBy(order, "doc_id", F.xxhash64("text")).rowsBetween(Window.unboundedPreceding, 0)  # bound rows
    rows = rows.withColumn("_upto", F.sum(F.length("text").cast("long")).over(upto)).filter(F.col("_upto") <= chars).select("text", "_label").collect()
    return [(r["text"], r["_label"]) for r in rows]


def segment_sums(values: np.ndarray, starts: Sequence[int]) -> np.ndarray:
    """Sums between consecutive starts; the last start is the end. A sum depends on its own values only."""
    values, starts = np.asarray(values, np.float64), np.asarray(starts, np.int64)
    out = np.zeros(len(starts) - 1)
    full = starts[1:] > starts[:-1]
    if full.any():
        out[full] = np.add.reduceat(values, starts[:-1][full])
    return out
