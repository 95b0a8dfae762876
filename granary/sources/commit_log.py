"""An append-only log of what stages did to documents: one commit a stage and run, in a folder that all executors share.

A commit is a folder of rows and a record with its stage, its time, its parent's digest and its own. Rows are written first; without a record they do not count, and are written
anew by the next commit. Rows that the log already has from a stage are left out, so running a stage again appends nothing, and running it on more appends what is new. A stage that found nothing is on record once.
"""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS = "doc_id long, action string, reason string"
RECORDS = "stage string, at string, parent string, digest string, n long"


def versions(spark: SparkSession, path: str, part: str, schema: str) -> DataFrame:
    full = f"{schema}, version int"
    try:
        return spark.read.schema(full).parquet(f"{path}/{part}")
    except AnalysisException as e:  # the log begins
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], full)


def commits(spark: SparkSession, path: str) -> DataFrame:
    """version, stage, at, parent, digest, n."""
    return versions(spark, path, "commits", RECORDS)


def entries(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, version, stage, action, reason, at: all rows on record."""
    return versions(spark, path, "rows", ROWS).join(commits(spark, path).select("version", "stage", "at"), "version").select("doc_id", "version", "stage", "action", "reason", "at")


def digest_of(parent: str, stage: str, at: str, rows: DataFrame) -> tuple[str, int]:
    """Of the rows in any order, what they are a part of and what they follow."""
    n, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("doc_id", "action", "reason").cast("decimal(38, 0)")), F.lit(0))).first()
    return hashlib.sha256(f"{parent}|{stage}|{at}|{n}|{total}".encode()).hexdigest(), n


def append(path: str, stage: str, rows: DataFrame, at: str) -> int | None:
    """Commits rows (doc_id, action, reason) of a stage that the log has not yet; the version, or None if there is nothing to commit."""
    spark = rows.sparkSession
    done = commits(spark, path).orderBy(F.desc("version"))
    last = done.first()
    version, parent = (last.version + 1, last.digest) if last else (1, "")
    known = entries(spark, path).filter(F.col("stage") == stage)
    key = ["doc_id", "action", "reason"]
    # null-safe, and each row once
    new = rows.select(*key).distinct().join(known.select(*(F.col(c).alias(f"k_{c}") for c in key)), [F.col(c).eqNullSafe(F.col(f"k_{c}")) for c in key], "left_anti")
    at_ = f"{path}/rows/version={version}"
    new.write.mode("overwrite").parquet(at_)
    digest, n = digest_of(parent, stage, at, spark.read.schema(ROWS).parquet(at_))
    if not n and not done.filter(F.col("stage") == stage).isEmpty():
        return None
    spark.createDataFrame([(stage, at, parent, digest, n)], RECORDS).coalesce(1).write.parquet(f"{path}/commits/version={version}")
    return version


def broken(spark: SparkSession, path: str) -> list[int]:
    """Versions whose rows, or whose parent, are not those on record."""
    out, parent = [], ""
    rows = versions(spark, path, "rows", ROWS)
    for c in commits(spark, path).orderBy("version").collect():  # one row a stage and run
        if c.parent != parent or digest_of(c.parent, c.stage, c.at, rows.filter(F.col("version") == c.version)) != (c.digest, c.n):
            out.append(c.version)
        parent = c.digest
    return out
