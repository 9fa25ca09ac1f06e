"""Token ids of a corpus in ascending document order, written as grammar-compressed shards.

Nulls: a null text is empty, a null doc_id sorts first. Rows of one doc_id keep one entry each, in
the order of their texts' hashes. Texts may be of any length; other columns don't matter. An
empty table gives no shards.
"""

from __future__ import annotations

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.llm.common import Scratch, arrow_map, bounded_batches, crc_u32, keep_blocks, shuffle_parts
from panelforge.llm.repair import Shard, build
from panelforge.llm.tokenize import encoder

SHARD_TOKENS = 1 << 20


def write_shards(docs: DataFrame, scratch: Scratch, name: str, tokenizer: str, space_prefix: bool, end_id: int, shard_tokens: int = SHARD_TOKENS, words_kept: int = 400_000) -> DataFrame:
    """Shards of at most shard_tokens ids, or of one longer document: part, part_start, n_tokens, payload.

    The range partitions are in document order, and part_start counts a partition's ids before
    the shard. A worker holds the documents of one shard at a time.
    """
    spark = docs.sparkSession
    bounded_batches(spark, 8000)  # the more texts at once, the fewer distinct words in all; bytes are bounded too
    rows = docs.select("doc_id", "text")
    rows = rows.repartitionByRange(shuffle_parts(spark), F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")

    def shards(batches):
        words, part, before = encoder(tokenizer, space_prefix, words_kept), TaskContext.get().partitionId(), 0
        ids, held, size = [], [], 0
        keep_blocks()

        def flush():
            nonlocal ids, held, size, before
            blob = build(ids, held, base=max(1 << 16, words.size, end_id + 1)).to_bytes()
            out = {"part": [part], "part_start": [before], "n_tokens": [size], "payload": [blob]}
            before += size
            ids, held, size = [], [], 0
            return out

        for batch in batches:
            for doc, got in zip(batch["doc_id"].to_pylist(), words.encode(batch["text"]), strict=True):
                got = np.append(got, got.dtype.type(end_id))  # end_id is in the vocabulary
                if held and size + len(got) > shard_tokens:
                    yield flush()
                ids.append(doc)
                held.append(got)
                size += len(got)
        if held:
            yield flush()

    return scratch.save(arrow_map(rows, shards, "part int, part_start long, n_tokens long, payload binary", arrays=True), name)


def read_shards(shards: DataFrame) -> DataFrame:
    """One row for each document of the shards: doc_id, start over all documents, n_tokens, ids_crc32."""
    # one row for each range partition of the writer, however large the corpus
    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    totals = totals.select("part", (F.sum("_n").over(Window.orderBy("part")) - F.col("_n")).alias("base"))
    placed = shards.join(F.broadcast(totals), "part").select((F.col("base") + F.col("part_start")).alias("base"), "payload")

    def digests(batches):
        for batch in batches:
            for base, blob in zip(batch["base"], batch["payload"], strict=True):
                shard = Shard.from_bytes(blob)
                starts = np.cumsum(shard.tokens.astype(np.int64)) - shard.tokens
                yield {"doc_id": shard.doc_ids, "start": base + starts, "n_tokens": shard.tokens.astype(np.int64), "ids_crc32": [crc_u32(shard.decode(d)) for d in range(len(starts))], "n_symbols": np.diff(shard.starts)}

    return arrow_map(placed, digests, "doc_id long, start long, n_tokens long, ids_crc32 long, n_symbols long")


def token_output(docs: DataFrame, tokenizer: str, space_prefix: bool = False, end_id: int = 1) -> DataFrame:
    """Writes the corpus and reads it back; n_symbols counts the grammar symbols that a document takes."""
    return read_shards(write_shards(docs, Scratch(docs.sparkSession, "tokens"), "shards", tokenizer, space_prefix, end_id))
