"""Training-data pipeline: toxic documents go, one document of each near-duplicate class stays, passages that an
earlier document has are cut, and what is left is packed into sequences.

Each stage takes the whole table its predecessor wrote. All stages but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewatch.llm import near_dedup, packing, queries, substring, toxicity
from casewatch.llm import words as W


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score below 0.5; labels are learned from outside the held-out fold."""
    model = queries.toxic_model(docs, queries.table(spark, sf_dir, "labels"))
    scored = toxicity.scored(docs, model)
    return scored.where(F.col(scored.columns[-1]) < 0.5).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each class; documents without an id stay."""
    classes = near_dedup.near_duplicates(docs)
    extra = classes.where("class_id < doc_id").select("doc_id").distinct()
    return docs.join(extra, "doc_id", "left_anti").select(*docs.columns)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that one with a smaller id has; untouched texts stay as they are."""
    return substring.cleaned(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece with its sequence and offset; `row` finds its ids among the written pieces."""
    return packing.pack_documents(docs, queries.vocabulary_path(), keep={"ids_crc32": F.crc32("ids"), "row": F.col("row")})


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("packing", pack),
]

#: A learned model, similarity classes and a tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = W.stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
