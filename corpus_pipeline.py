"""From raw documents to packed training sequences, as stages over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a frame; the next one gets it
written as Parquet and read again. All stages but the last return the columns
of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tripmesh.llm import op01_decontaminate, op04_line_dedup, op05_toxicity, op07_near_dedup, op10_pack
from tripmesh.llm.common import read_table, saved


# Words of a shingle in the near-dedup stage; the query of the operator alone takes four.
SHINGLE = 5


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score one half or more go."""
    return op05_toxicity.keep_clean(docs, op05_toxicity.fit(docs, op05_toxicity.training_labels(spark, sf_dir)))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of passages that occur earlier go; every document stays, with what is left of its text."""
    return op04_line_dedup.rewritten(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, by shingles of five words, the document with the smallest id stays."""
    return op07_near_dedup.keep_first(docs, size=SHINGLE)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return op01_decontaminate.keep_clean(docs, read_table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the token ids of the documents, placed in sequences."""
    return op10_pack.pack_documents(docs.select("doc_id", "text"), carry=["doc_id"], keep_ids=False)


STAGES = [
    ("toxicity", toxicity),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", packing),
]

# A learned model, components of a graph and a tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = saved(docs, f"stage-{k}")
    return docs
