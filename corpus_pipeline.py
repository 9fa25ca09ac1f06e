"""The corpus pipeline: toxicity, near duplicates, personal data, mixing, packing.

Each stage is a function of (spark, docs, sf_dir); what it returns is written as Parquet and
read again as the next one's docs. All but the last return the columns of docs. No SQL can
express the stages (fitted models, MinHash, a tokenizer), so tests hold them against
brute-force versions.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm.common import Scratch, fresh, held_out_by
from panelforge.llm.mixing import mixed_documents
from panelforge.llm.near_dup import near_duplicates
from panelforge.llm.packing import pack_documents
from panelforge.llm.pii import redact_documents
from panelforge.llm.toxicity import ToxicParams, fit, score_toxicity
from panelforge.llm.words import labelled_sample


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below one half, in place: the verdict is a column beside the row.

    Null and empty texts stay, repeated rows meet one fate, columns of any name stay.
    """
    p, name = ToxicParams(), fresh(docs, "toxicity")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    sample = labelled_sample(docs, labels, "toxic", ~held_out_by(5, 0), p.sample, p.toxic_share)
    return score_toxicity(docs, fit(sample, p), p, keep=docs.columns, name=name).filter(F.col(name)["predicted"] == 0).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each component, without its further rows of equal text.

    Of rows with equal id and text the one with the least other columns stays, in every run.
    Rows of one id with different texts are one document and stay together. Rows without an
    id and rows without words stand alone and stay.
    """
    out = near_duplicates(docs).filter("not kept").select("doc_id").distinct()
    # by doc_id once, for the join and for equal rows
    rows = docs.join(out.hint("merge"), "doc_id", "left_anti")
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    rest, named = F.struct(F.lit(0), *others), fresh(docs, "rest")
    once = rows.filter("doc_id is not null").groupBy("doc_id", "text").agg(F.min_by(rest, F.to_json(rest)).alias(named))
    once = once.select("doc_id", "text", *[F.col(named).getField(c).alias(c) for c in others])
    return once.unionByName(rows.filter("doc_id is null")).select(*docs.columns)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, its personal data replaced by names of kinds; null texts stay null."""
    return redact_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the mix takes a document; documents without words are in no mix."""
    return mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each row of docs, with its sequence and place."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), words_kept=100_000)


STAGES = [("toxicity", drop_toxic), ("near duplicates", drop_near_duplicates), ("personal data", redact), ("mixing", mix_sources), ("packing", pack)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every other stage's are a table in the shared folder."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage{i}")
        if i:
            scratch.drop(f"stage{i - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
