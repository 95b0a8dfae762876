"""What the operators of this subpackage share: tables, the shared folder, small Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# White space of the contracts, as a Java/RE2 class and as bytes.
WS = r"\x20\x09-\x0D"
WORD = rf"[^{WS}]+"
WS_BYTES = b" \t\n\x0b\x0c\r"
UPPER_TO_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


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
    """Writes df as a table in the shared folder and reads it back: lineage ends there, lost executors cost nothing.

    Shuffle files of the job are released as soon as the table is written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/granary/{name}-{uuid.uuid4().hex}"
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


def row_ids(docs: DataFrame, key: str | None = None) -> Column:
    """A number for each row: the column `key` where the caller has one, else the row's place in the input files.

    Places hold as long as a table is cut into the same tasks each time it is read, so the number of tasks is fixed for the session; else it would follow the cores, of which some can be lost.
    """
    if key:
        return F.col(key)
    conf = docs.sparkSession.conf
    if conf.get("spark.sql.files.minPartitionNum", None) is None:
        conf.set("spark.sql.files.minPartitionNum", str(docs.sparkSession.sparkContext.defaultParallelism))
    return F.monotonically_increasing_id()


def free_name(df: DataFrame, name: str) -> str:
    """name, with as many _ before it as it takes to differ from all columns of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def concat_bytes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one byte array, and where each begins (one more entry for the end)."""
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=at[1:])
    return np.frombuffer(b"".join(texts), np.uint8), at


#: Bytes of text that a vectorised step takes at once (a longer text is taken alone).
SLICE_BYTES = 2 << 20


def sliced(texts: list[bytes], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about limit bytes."""
    return sliced_sizes([len(t) for t in texts], limit)


def sliced_sizes(sizes: list[int], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """The same from the sizes of texts."""
    a = size = 0
    for i, n in enumerate(sizes):
        if size and size + n > limit:
            yield a, i
            a, size = i, 0
        size += n
    if a < len(sizes):
        yield a, len(sizes)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash (public splitmix constants)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def byte_table(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def spread_of(df: DataFrame, text: str = "text") -> int:
    """Bytes of the text column, the measure by which bucket counts follow the input."""
    return int(df.agg(F.sum(F.octet_length(text))).first()[0] or 0)
