"""Reading and writing of pages, documents, snapshots and intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a fresh one where that is unset and all run on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="granary-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read again; cuts lineage without relying on executors."""
    path = f"{shared_dir(df.sparkSession)}/granary/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def few_rows_a_batch(df: DataFrame, name: str, rows: int = 4) -> DataFrame:
    """materialize for rows of some megabytes, of which few go to Python at once."""
    key, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    before = conf.get(key)
    conf.set(key, str(rows))
    try:
        return materialize(df, name)
    finally:
        conf.set(key, before)


def read_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, host, path, html."""
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", "url", F.regexp_extract("url", "^https?://([^/]*)", 1).alias("host"), F.regexp_extract("url", "^https?://[^/]*([^?#]*)", 1).alias("path"), "html")


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per UTF-8 file: lang (from names like corpus-en.txt) and the whole text."""
    files = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    return files.select(F.regexp_extract("file", r"-([a-z]+)\.[a-z]+$", 1).alias("lang"), F.col("value").alias("text"))


def write_snapshots(docs: DataFrame, path: str) -> DataFrame:
    """Texts by language as Parquet and one manifest record per document as JSON; returns the records."""
    from granary.functions.text import snapshot_records

    docs.write.mode("overwrite").partitionBy("lang").parquet(f"{path}/texts")
    records = snapshot_records(docs)
    records.write.mode("overwrite").json(f"{path}/manifest")
    return records


def read_snapshots(spark: SparkSession, path: str, schema) -> tuple[DataFrame, DataFrame]:
    from granary.functions.text import RECORD_SCHEMA

    return spark.read.schema(schema).parquet(f"{path}/texts"), spark.read.schema(RECORD_SCHEMA).json(f"{path}/manifest")
