"""The corpus pipeline: quality rules, near-duplicate removal, secret scans, mixing, packing.

Each stage is written as a table in the shared folder and read again by the next, so a lost executor costs tasks of one stage.
Every stage takes any table with doc_id, text, source and n_chars; all but the last return its columns, further ones among them,
whatever their names. An empty table gives an empty one at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factloom.llm import jaccard, mixing, packing, quality, secrets
from factloom.llm.common import Scratch


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents that the rules reject go, and of the others the lines above the limits; n_chars follows.

    Null and empty texts have too few words and go; a null source is a host of its own; repeated rows are judged alike.
    """
    return quality.keep_good_lines(docs)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: one document of each class of near copies stays, that of the least doc_id.

    Null, empty and blank texts are classes of their own and stay; a null doc_id stays only if its class has no other; of equal
    rows, and of several texts of a class under one doc_id, one stays.
    """
    return jaccard.keep_one(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: secrets are masked, n_chars follows; no document goes. Null and empty texts stay as they are."""
    return secrets.mask_secrets(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents as often as the mix takes them, in the order of training; n_chars follows a cut text.

    Texts without words, null ones among them, are never taken; a null source mixes like others, last in order; rows are told
    apart by all their columns, equal ones take turns.
    """
    return mixing.mixed_rows(docs, chars_col="n_chars")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: pieces of the sequences to train on, with their ids. Null and empty texts are the end id alone; each row is a
    document of its own, whatever its doc_id."""
    return packing.pack(docs, packing.tokenizer_file())


STAGES = [
    ("quality rules", quality_stage),
    ("n-gram Jaccard join", near_duplicates_stage),
    ("secret scans", secrets_stage),
    ("mixing sources", mixing_stage),
    ("packing", packing_stage),
]

#: Sampled paths, compression and tokenization have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents, each from the table that the one before wrote; tables two stages back are removed."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), f"stage{k}")
        if k > 1:
            scratch.drop(f"stage{k - 2}")
    return docs
