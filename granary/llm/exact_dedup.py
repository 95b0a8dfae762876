"""Exact dedup by content-defined chunk recipes.

The normalised text (UTF-8, white space deleted) is cut where a rolling hash of the last 32 bytes says so. Equal chunks
get one identifier: the 128-bit digest of the chunk, verified by comparing the bytes of all chunks with that digest; a
digest that stands for several byte strings is told apart by a rank. A document becomes the ordered list of its
identifiers (its recipe), and only recipes are compared, so a long document moves once at most (its distinct chunks, combined
before the shuffle), however many copies it has.

Defined results: null text counts as empty; empty texts are one group; a null doc_id loses ties; rows that agree in all
columns still leave one row; an empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.llm.common import WS_BYTES, batch_of, byte_table, concat_bytes, materialize, row_ids, sliced

MIN_CHUNK, MAX_CHUNK, CUT_BITS = 512, 8192, 11
GEAR = byte_table(3)


def cut_points(data: np.ndarray, at: np.ndarray, min_chunk: int = MIN_CHUNK, max_chunk: int = MAX_CHUNK, bits: int = CUT_BITS) -> list[list[int]]:
    """Per document the ends of its chunks, relative to its beginning. Depends on the document's bytes alone (min_chunk >= 32)."""
    h = GEAR[data]
    for s in (1, 2, 4, 8, 16):
        older = h[:-s] << np.uint64(s)
        h = h.copy()
        h[s:] += older
    marks = np.nonzero((h >> np.uint64(40)) & np.uint64((1 << bits) - 1) == 0)[0] + 1
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        ends, start = [], a
        while b - start > min_chunk:
            k = int(np.searchsorted(marks, start + min_chunk))
            end = min(int(marks[k]) if k < len(marks) else b, start + max_chunk, b)
            ends.append(end - a)
            start = end
        if start < b:
            ends.append(b - a)
        out.append(ends)
    return out


def _chunks(batch: pa.RecordBatch, digest_bytes: int):
    """(row, normalised text, [(digest, chunk)]) for each row of a batch whose second column is the text as bytes."""
    texts = [(t or b"").translate(None, WS_BYTES) for t in batch.column("text").to_pylist()]
    for first, last in sliced(texts):
        data, at = concat_bytes(texts[first:last])
        for i, ends in enumerate(cut_points(data, at), first):
            parts = [texts[i][a:b] for a, b in zip([0, *ends], ends)]
            yield i, texts[i], [(hashlib.blake2b(p, digest_size=digest_bytes).digest(), p) for p in parts]


def chunk_recipes(docs: DataFrame, digest_bytes: int = 16, key: str | None = None) -> DataFrame:
    """row_id, doc_id, n_points, text_sha256, recipe array<binary>: the recipe in digests, not yet verified."""
    out = pa.schema([("row_id", pa.int64()), ("doc_id", pa.int64()), ("n_points", pa.int64()), ("text_sha256", pa.string()), ("recipe", pa.list_(pa.binary()))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(hashlib.sha256(text).hexdigest(), [d for d, _ in parts]) for _, text, parts in _chunks(batch, digest_bytes)]
            yield batch_of(out, batch.column("row_id"), batch.column("doc_id"), batch.column("n_points"), [r[0] for r in rows], [r[1] for r in rows])

    read = docs.select(
        row_ids(docs, key).alias("row_id"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_points"),
        F.col("text").cast("binary").alias("text"),
    )
    return read.mapInArrow(scan, "row_id long, doc_id long, n_points long, text_sha256 string, recipe array<binary>")


def chunk_table(docs: DataFrame, digest_bytes: int = 16) -> DataFrame:
    """digest, chunk: the distinct chunks, combined within each task before they move."""
    out = pa.schema([("digest", pa.binary()), ("chunk", pa.binary())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {p: d for _, _, parts in _chunks(batch, digest_bytes) for d, p in parts}
            yield batch_of(out, list(found.values()), list(found))

    return docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(scan, "digest binary, chunk binary").groupBy("digest", "chunk").agg(F.lit(1).alias("one")).drop("one")


def _positions(docs: DataFrame, digest_bytes: int, key: str | None) -> DataFrame:
    out = pa.schema([("row_id", pa.int64()), ("pos", pa.int64()), ("digest", pa.binary()), ("chunk", pa.binary())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("row_id").to_pylist()
            rows = [(ids[i], k, d, p) for i, _, parts in _chunks(batch, digest_bytes) for k, (d, p) in enumerate(parts)]
            yield batch_of(out, *([r[c] for r in rows] for c in range(4)))

    read = docs.select(row_ids(docs, key).alias("row_id"), F.col("text").cast("binary").alias("text"))
    return read.mapInArrow(scan, "row_id long, pos long, digest binary, chunk binary")


def verified_recipes(docs: DataFrame, digest_bytes: int = 16, key: str | None = None) -> DataFrame:
    """chunk_recipes with identifiers that stand for one byte string each."""
    recipes = materialize(chunk_recipes(docs, digest_bytes, key), "recipes")
    shared = chunk_table(docs, digest_bytes).groupBy("digest").count().filter("count > 1").select("digest")
    shared = materialize(shared, "shared-digests")
    if shared.isEmpty():
        return recipes
    # Digests of several byte strings: those chunks, and only those, are ranked by their bytes.
    places = _positions(docs, digest_bytes, key).join(shared, "digest", "left_semi")
    names = places.groupBy("digest", "chunk").agg(F.min(F.struct("row_id", "pos")).alias("first"))
    told = places.join(names, ["digest", "chunk"]).select("row_id", "pos", F.concat("digest", F.encode(F.to_json("first"), "UTF-8")).alias("told"))
    whole = recipes.select("row_id", F.posexplode("recipe").alias("pos", "digest")).join(told, ["row_id", "pos"], "left")
    exact = whole.groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("pos", F.coalesce("told", "digest").alias("id")))).getField("id").alias("exact"))
    return materialize(recipes.join(exact, "row_id", "left").withColumn("recipe", F.coalesce("exact", "recipe")).drop("exact"), "verified-recipes")


def exact_dedup(docs: DataFrame, digest_bytes: int = 16, key: str | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: of equal texts the row with the most code points, then the smallest doc_id stays.

    key: a column that numbers the rows of docs; the result then has it as row_id.
    """
    recipes = verified_recipes(docs, digest_bytes, key)
    best = F.max(F.struct("n_points", F.bitwise_not("doc_id").alias("not_id"), F.bitwise_not("row_id").alias("not_row")))
    groups = recipes.groupBy("recipe").agg(F.count(F.lit(1)).alias("group_size"), best.alias("best"))
    # a table of its own, so that the planner can split the rows of a large group in the join
    groups = materialize(groups, "groups")
    return recipes.join(groups, "recipe").select(
        *["row_id"] * bool(key),
        "doc_id",
        F.bitwise_not("best.not_id").alias("keep_id"),
        "group_size",
        (F.col("row_id") == F.bitwise_not("best.not_row")).alias("kept"),
        "text_sha256",
    )
