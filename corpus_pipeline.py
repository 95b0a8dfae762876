"""The corpus pipeline: quality rules, exact dedup, n-gram Jaccard join, mixing, packing.

Each stage reads the table the one before wrote and decides row by row: rows are numbered once for each stage, operators carry that number, and filters and
repetitions go by it. Kept numbers grow with the input, so they are never broadcast: filters are merge joins at every size.

Defined results: doc_id is only an attribute: rows that share one, or have none, are judged, kept and repeated each on their own; null text counts as empty and
fails the quality rules; of repeated rows exact dedup keeps one; ties go to the smallest doc_id, then to the row that comes first; extra columns are carried along
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import free_name, materialize, row_ids, table
from granary.llm.exact_dedup import exact_dedup
from granary.llm.mixing import mix, repeat_documents
from granary.llm.ngram_join import near_duplicates
from granary.llm.packing import pack
from granary.llm.quality_rules import quality_rules
from granary.llm.queries import tokenizer_path


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a number for each row, and the name of that column."""
    key = free_name(docs, "row_key")
    return docs.withColumn(key, row_ids(docs)), key


def keep(docs: DataFrame, key: str, verdicts: DataFrame) -> DataFrame:
    """Rows of docs whose number (row_id in verdicts) is kept; columns as in docs but for key."""
    kept = verdicts.filter("kept").select(F.col("row_id").alias(key)).hint("merge")
    return docs.join(kept, key, "left_semi").drop(key)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality rules keep."""
    rows, key = numbered(docs)
    return keep(rows, key, quality_rules(rows, key=key))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts."""
    rows, key = numbered(docs)
    return keep(rows, key, exact_dedup(rows, key=key))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, the one with the smallest doc_id, of each component of near copies (five words, 0.8)."""
    rows, key = numbered(docs)
    return keep(rows, key, near_duplicates(rows, size=5, num=8, den=10, key=key))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows repeated as the mix takes them; the last repetition of one row a source can be a part."""
    rows, key = numbered(docs)
    out = repeat_documents(rows, mix(rows, key=key), key)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in out.columns else out


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all repetitions in sequences of 2048 tokens. Workers live on into other stages, so each remembers fewer words than it would for packing alone."""
    return pack(docs, tokenizer_path(), kept=200_000)


STAGES = [("quality_rules", quality), ("exact_dedup", exact), ("ngram_join", near), ("mixing", mixed), ("packing", packed)]
# Best-fit decreasing over token ids is not expressible in SQL; tests/llm compares with a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
