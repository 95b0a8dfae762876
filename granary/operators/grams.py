"""Word windows of texts: one scan of each text, whatever lengths are asked for.

A text is lower-cased and its words are joined by single blanks. A polynomial hash over the bytes is summed up once, so that the hash of any window of words is one subtraction; windows
of all lengths are cut from the same sums. Patterns are found by a filter of bounded size (a bit for each of a fixed number of hash values): windows that
pass it come out as text and are joined with the patterns by their text, so a hash alone decides nothing there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.sources.tables import materialize

FILTER_BITS = 1 << 24  # 2 MB, sent to every task
SLICE_BYTES = 1 << 20  # bytes of text that are hashed at once (a longer text is taken alone)
BASE = 0x9E3779B97F4A7C15
BYTE_VALUES = np.random.default_rng(31).integers(1, 1 << 63, 256, dtype=np.uint64)


class Words:
    """The words of several texts: texts[i] is the text that word i is of, places[i] its number there."""

    def __init__(self, texts: list[bytes]):
        self.data = b"".join(b" ".join(t.split()) + b"\n" for t in texts)  # bytes.split: exactly the white space of ASCII
        bytes_ = np.frombuffer(self.data, np.uint8)
        ends = np.nonzero((bytes_ == 32) | (bytes_ == 10))[0]
        starts = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
        text = np.concatenate(([0], np.cumsum(bytes_[ends[:-1]] == 10))) if len(ends) else ends
        real = ends > starts
        self.starts, self.ends, self.texts = starts[real], ends[real], text[real]
        self.sizes = np.bincount(self.texts, minlength=len(texts))
        self.places = np.arange(len(self.texts)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        up = np.full(len(bytes_), np.uint64(BASE))
        down = np.full(len(bytes_), np.uint64(pow(BASE, -1, 1 << 64)))
        up[:1], down[:1] = 1, 1
        self.powers = np.multiply.accumulate(up)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(BYTE_VALUES[bytes_] * np.multiply.accumulate(down), dtype=np.uint64)))

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of all windows of size words, and hashes of the windows."""
        first = np.arange(max(len(self.texts) - size + 1, 0))
        first = first[self.texts[first] == self.texts[first + size - 1]]
        a, b = self.starts[first], self.ends[first + size - 1]
        h = (self.sums[b] - self.sums[a]) * self.powers[b - 1]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return first, h ^ (h >> np.uint64(32))

    def text(self, first: np.ndarray, size: int) -> list[str]:
        return [self.data[a:b].decode() for a, b in zip(self.starts[first].tolist(), self.ends[first + size - 1].tolist())]


def slices(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about SLICE_BYTES."""
    a = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > SLICE_BYTES:
            yield a, i
            a, size = i, 0
        size += len(t)
    if a < len(texts):
        yield a, len(texts)


def lowered(docs: DataFrame, key: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("key"), F.lower(F.coalesce("text", F.lit(""))).cast("binary").alias("text"))


def window_hashes(docs: DataFrame, size: int, key: str = "doc_id") -> DataFrame:
    """key, place, h: a hash for each window of size words."""
    schema = pa.schema([(key, pa.int64()), ("place", pa.int32()), ("h", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keys = batch.column("text").to_pylist(), batch.column("key")
            for a, b in slices(texts):
                words = Words(texts[a:b])
                first, h = words.windows(size)
                yield pa.record_batch([keys.take(pa.array(a + words.texts[first])), pa.array(words.places[first], pa.int32()), pa.array(h.view(np.int64))], schema=schema)

    return lowered(docs, key).mapInArrow(scan, f"{key} long, place int, h long")


FOUND = "place int, size int, n_words int, gram string, h long"


def cut_grams(docs: DataFrame, key: str, sizes: list[int], passing: np.ndarray | None = None, own_size: int = 0) -> DataFrame:
    """key, place, size, n_words (of the text), gram, h: windows of the sizes asked for. passing: only those whose bit is set. own_size: only those of own_size words, of shorter texts the whole."""
    schema = pa.schema([(key, pa.int64()), ("place", pa.int32()), ("size", pa.int32()), ("n_words", pa.int32()), ("gram", pa.string()), ("h", pa.int64())])
    shared = docs.sparkSession.sparkContext.broadcast(passing)  # FILTER_BITS

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            texts, keys = batch.column("text").to_pylist(), batch.column("key")
            for a, b in slices(texts):
                words = Words(texts[a:b])
                for size in sizes:
                    first, h = words.windows(size)
                    if bits is not None:
                        slot = h & np.uint64(64 * len(bits) - 1)
                        use = bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1) == 1
                        first, h = first[use], h[use]
                    if own_size:
                        use = np.minimum(words.sizes[words.texts[first]], own_size) == size
                        first, h = first[use], h[use]
                    n = words.sizes[words.texts[first]]
                    columns = [keys.take(pa.array(a + words.texts[first])), words.places[first], np.full(len(first), size), n, words.text(first, size), h.view(np.int64)]
                    yield pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return lowered(docs, key).mapInArrow(scan, f"{key} long, {FOUND}")


def item_grams(items: DataFrame, size: int) -> DataFrame:
    """item_id, place, size, n_words, gram, h: windows of size words of each item; a shorter item is one window. A table."""
    return materialize(cut_grams(items, "item_id", list(range(1, size + 1)), own_size=size), "item-grams")


def hits(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """doc_id, place, gram: windows of documents that are one of patterns (gram, size, h), or that the filter takes for one; a join on gram sorts these out."""
    sizes = sorted(r[0] for r in patterns.select("size").distinct().collect())  # at most the largest window
    slot = F.col("h").bitwiseAND(F.lit(FILTER_BITS - 1))
    word = patterns.select(F.shiftright(slot, 6).alias("word"), F.expr(f"shiftleft(1L, cast(h & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    bits = np.zeros(FILTER_BITS // 64, np.uint64)
    for r in word.toLocalIterator():  # at most FILTER_BITS / 64 rows
        bits[r.word] = np.uint64(r.bits & 0xFFFFFFFFFFFFFFFF)
    return cut_grams(docs, "doc_id", sizes, bits).select("doc_id", "place", "gram")
