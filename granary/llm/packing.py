"""Packing: best-fit decreasing, with a segment tree over remaining capacities.

Tokens come from a public vocabulary. A document's ids, with one separator id after them, are cut into full windows; what
is left (shorter than a window) is packed best-fit decreasing: the tree over capacities finds the open sequence with the
least room that still fits. Remainders are dealt by hash to groups of a bounded size, and each group packs on its own, so
no task holds more than about GROUP remainders; the loss is under one partly filled sequence a group.

Sequences are to be padded to the window length, but for those whose tokens number a power of two: they are complete as they are. No piece is cut to reach such a number.

Defined results: null text is empty, an empty text is the separator alone; a null doc_id stays null; repeated rows are documents of their own; other columns of the
input are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import batch_of, materialize

WINDOW, SEPARATOR, GROUP, WORDS_KEPT, LONGEST_KEPT = 2048, 1, 16384, 500_000, 64
PIECES = "row_id long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class WordIds(dict):
    """Token ids (bytes, little-endian 32-bit) of white-space-separated words, remembered up to a bound: two generations of `kept` words of at most LONGEST_KEPT bytes.

    Right for tokenizers that lower the case and whose tokens never span white space.
    """

    def __init__(self, path: str, kept: int = WORDS_KEPT):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.older, self.kept = Tokenizer.from_file(path), {}, kept

    def __missing__(self, word: bytes) -> bytes:
        found = self.older.get(word)
        if found is None:
            found = array("I", self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids).tobytes()
        if len(word) > LONGEST_KEPT:
            return found
        if len(self) >= self.kept:
            self.older = dict(self)
            self.clear()
        self[word] = found
        return found

    def ids(self, text: bytes) -> bytes:
        if b"<|" not in text:  # else the case of what looks like a special token must stay
            text = text.lower()
        return b"".join([self[w] for w in text.split()])  # bytes split on ASCII white space alone


@cache
def coder_of(path: str, kept: int) -> WordIds:
    """One for each worker process, which serves many tasks."""
    return WordIds(path, kept)


def token_pieces(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, separator: int = SEPARATOR, kept: int = WORDS_KEPT) -> DataFrame:
    """One row per piece (PIECES): full windows of each document and its remainder. kept: words that a worker remembers, about 200 bytes each, twice over."""
    out = pa.schema([(x.split()[0], pa.int64()) for x in PIECES.split(", ")])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(tokenizer_path, kept)
        end = np.array([separator], "<u4").tobytes()
        for batch in batches:
            rows = []
            for row, doc, text in zip(batch.column("row_id").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = memoryview(coder.ids(text or b"") + end)
                n = len(ids) // 4
                rows += [(row, doc, a, min(window, n - a), zlib.crc32(ids[4 * a : 4 * (a + window)]), n) for a in range(0, n, window)]
            yield batch_of(out, *zip(*rows)) if rows else batch_of(out, *([] for _ in out))

    read = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    return read.mapInArrow(scan, PIECES)


def best_fit_decreasing(sizes: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset for each size (1..window). The tree counts open sequences by room left; a query finds the least room >= size."""
    leaves = 1 << int(window).bit_length()
    tree = [0] * (2 * leaves)
    open_by_room: list[list[int]] = [[] for _ in range(window + 1)]
    seq, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)

    def add(room: int, by: int) -> None:
        k = room + leaves
        while k:
            tree[k] += by
            k >>= 1

    def tightest(size: int) -> int:
        """Least room >= size with an open sequence, or -1."""
        k = size + leaves
        if tree[k]:
            return size
        while k > 1:
            if not k & 1 and tree[k + 1]:
                k += 1
                while k < leaves:
                    k = 2 * k if tree[2 * k] else 2 * k + 1
                return k - leaves
            k >>= 1
        return -1

    opened = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        room = tightest(size)
        if room < 0:
            s, room, opened = opened, window, opened + 1
        else:
            s = open_by_room[room].pop()
            add(room, -1)
        seq[i], offset[i] = s, window - room
        if room > size:
            open_by_room[room - size].append(s)
            add(room - size, 1)
    return seq, offset


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, separator: int = SEPARATOR, group: int = GROUP, kept: int = WORDS_KEPT) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. Sequence ids are unique, not dense."""
    pieces = materialize(token_pieces(docs, tokenizer_path, window, separator, kept), "pieces")
    rests = pieces.filter(F.col("length") < window)
    groups = max(1, -(-rests.count() // group))
    out = pa.schema([*((x.split()[0], pa.int64()) for x in PIECES.split(", ")), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def place(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("row_id", "ascending")])
        g = rows.column("bin")[0].as_py()
        seq, offset = best_fit_decreasing(rows.column("length").to_numpy(), window)
        ids = seq * np.int64(groups) + g
        return pa.table([*(rows.column(f.name) for f in list(out)[:-2]), 2 * ids + 1, offset], schema=out)

    dealt = rests.withColumn("bin", F.pmod(F.xxhash64("row_id"), F.lit(groups)))
    placed = dealt.groupBy("bin").applyInArrow(place, f"{PIECES}, sequence_id long, offset long")
    # a full window is a sequence of its own: even ids
    full = pieces.filter(F.col("length") == window)
    full = full.withColumn("sequence_id", 2 * F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    return full.unionByName(placed).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
