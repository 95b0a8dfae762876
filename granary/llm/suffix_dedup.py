"""Repeated-window removal by a depth-limited most-significant-digit radix sort of suffixes.

Every suffix is ordered through its first `window` bytes only; a group that stays equal to that depth is a repeated window.
Digits are taken so that most suffixes drop out early and in bulk:

1. The first digit of a window is the least of its grams by a hash (where it lies in the window counts too), so equal
   windows agree in it. Neighbouring windows that share the gram at one place form a run, and runs, not windows, are dealt by the digit. Runs whose
   gram is in one document only, or whose 16 bytes on neither side of it agree with another document, drop out.
2. The second digit is the whole run: a run that a document with a smaller id has too is removed at once.
3. What is left (runs that agree in part, at the edges of passages) goes window by window. A digit of 40 bits of all bytes is dealt alone, and windows that share
   it with no other row drop out. The others are sorted on the bytes, in digits of eight, only through `window` bytes; groups with one member leave after each pass.

Equal runs, and in step 3 equal windows, of a batch are combined before they move, so a passage in a third of all documents makes
one row a batch and not one a document. Edges of such a passage differ, and step 3 deals windows by all their bytes.

Defined results: null text is empty; texts shorter than the window keep all bytes; rows with the same doc_id do not remove
each other; a null doc_id counts as larger than all others; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.blobs import bucket_count, cut, joined, runs
from granary.llm.common import batch_of, byte_table, concat_bytes, materialize, mix64, sliced, spread_of
from granary.llm.ngram_join import POWERS

WINDOW, GRAM, SIDE = 50, 18, 16  # window - gram >= 2 * SIDE
CHARS = byte_table(11)
POS_BITS = 24
SEGMENT = 1 << 20
LAST = np.int64(2**63 - 1)
RUN = np.dtype([("gram", "<u8"), ("whole", "<u8"), ("left", "<u2"), ("right", "<u2"), ("start", "<i4"), ("n", "u1"), ("q", "u1")])


class Hashes:
    """Hash of any stretch of one byte array."""

    def __init__(self, data: np.ndarray):
        up, self.down = POWERS.to(len(data) + 1)
        self.total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(CHARS[data] * up[: len(data)], dtype=np.uint64)))

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix64((self.total[b] - self.total[a]) * self.down[a] + (b - a).astype(np.uint64))


def segments(texts: list[bytes], window: int) -> list[tuple[int, bytes, int, int, int]]:
    """(text, bytes, offset, low, high): texts whole, or where very long in overlapping parts that own the windows beginning at low..high-1."""
    out = []
    for i, t in enumerate(texts):
        if len(t) <= 2 * SEGMENT:
            out.append((i, t, 0, 0, len(t)))
            continue
        for c in range(0, len(t), SEGMENT):
            a = max(0, c - 2 * window)
            out.append((i, t[a : c + SEGMENT + 3 * window], a, c - a, c - a + SEGMENT))
    return out


def window_runs(data: np.ndarray, at: np.ndarray, low_at: np.ndarray, high_at: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(index of the text, RUN record) for each run of windows with one least gram; `start` is relative to the text. len(data) < 2**POS_BITS.

    low_at, high_at: which windows of each text count, by where they begin.
    """
    spread = window - gram + 1
    sizes = np.diff(at)
    last = len(data) - window
    if last < 0 or sizes.max() < window:
        return np.zeros(0, np.int64), np.zeros(0, RUN)
    h = Hashes(data)
    i = np.arange(len(data) - gram + 1)
    grams = h.of(i, i + gram)
    low = np.uint64((1 << POS_BITS) - 1)
    m, reach = (grams & ~low) | i.astype(np.uint64), 1
    while 2 * reach <= spread:
        m, reach = np.minimum(m[:-reach], m[reach:]), 2 * reach
    m = np.minimum(m[: last + 1], m[spread - reach : spread - reach + last + 1])
    place = (m & low).astype(np.int64)
    text = np.repeat(np.arange(len(sizes)), sizes)[: last + 1]
    p = np.arange(last + 1)
    valid = (p + window <= at[text + 1]) & (p >= low_at[text]) & (p < high_at[text])
    p = np.nonzero(valid)[0]
    if not len(p):
        return np.zeros(0, np.int64), np.zeros(0, RUN)
    place, text = place[p], text[p]
    first = np.nonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (text[1:] != text[:-1]))))[0]
    a, q, text = p[first], place[first], text[first]
    b = p[np.concatenate((first[1:], [len(p)])) - 1]  # first byte of the last window
    out = np.zeros(len(a), RUN)
    begin, end = at[text], at[text + 1]
    out["gram"] = grams[q]
    out["whole"] = mix64(h.of(a, b + window) + ((q - a) * 64 + (b - a)).astype(np.uint64))
    out["left"] = h.of(np.maximum(q - SIDE, begin), q) >> np.uint64(49)
    out["right"] = h.of(q + gram, np.minimum(q + gram + SIDE, end)) >> np.uint64(49)
    # a side shorter than SIDE cannot be inside a window beyond it: marked apart
    out["left"] |= ((q - SIDE < begin).astype("<u2")) << np.uint16(15)
    out["right"] |= ((q + gram + SIDE > end).astype("<u2")) << np.uint16(15)
    out["start"], out["n"], out["q"] = a - begin, b - a + 1, q - a
    return text, out


SPAN = np.dtype([("row", "<i8"), ("start", "<i4"), ("n", "u1")])
OPEN = np.dtype([("row", "<i8"), ("doc", "<i8"), ("start", "<i4"), ("n", "u1"), ("q", "u1"), ("sides", "u1")])
BINARY = pa.binary()


def table_of(rows: list[tuple], names: list[str]) -> pa.Table:
    columns = zip(*rows) if rows else [[]] * len(names)
    return pa.table([pa.array(c, pa.int64() if n == "bucket" else BINARY) for n, c in zip(names, columns)], names=names)


def ddl(names: list[str]) -> str:
    return ", ".join(f"{n} {'long' if n == 'bucket' else 'binary'}" for n in names)


def deltas(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=np.int64(0))


def low_bytes(x: np.ndarray, k: int) -> np.ndarray:
    return x.view("u1").reshape(-1, 8)[:, :k]


def from_low_bytes(x: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros((len(x) // k, 8), np.uint8)
    out[:, :k] = x.reshape(-1, k)
    return out.reshape(-1).view("<u8")


def spans(row: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    out = np.zeros(len(row), SPAN)
    out["row"], out["start"], out["n"] = row, start, n
    return out


def least_by(keys: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry the smallest and the largest doc among entries with its key."""
    order = np.argsort(keys, kind="stable")
    start, length = runs(keys[order])
    low, high = np.empty(len(keys), np.int64), np.empty(len(keys), np.int64)
    if len(keys):
        low[order] = np.repeat(np.minimum.reduceat(doc[order], start), length)
        high[order] = np.repeat(np.maximum.reduceat(doc[order], start), length)
    return low, high


RUNS = ["bucket", "gram", "whole", "sides", "start", "n", "q", "doc", "row", "span"]
FOUND = ["bucket", "span", "open"]
DIGITS = ["bucket", "digit", "row", "start", "span"]
WINDOWS = ["bucket", "bytes", "doc", "row", "start"]


def numbered(docs: DataFrame) -> DataFrame:
    """row_id, doc_id, order_id (by which the first document is told), text."""
    doc = F.col("doc_id").cast("long")
    return docs.select(F.monotonically_increasing_id().alias("row_id"), doc.alias("doc_id"), F.coalesce(doc, F.lit(int(LAST))).alias("order_id"), F.col("text").cast("binary").alias("text"))


def deal_runs(docs: DataFrame, buckets: int, window: int) -> DataFrame:
    """Runs by their gram (RUNS); of equal runs in one batch only those of the smallest doc move, the others are spans at once."""
    out = pa.schema([(n, pa.int64() if n == "bucket" else BINARY) for n in RUNS])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column("text").to_pylist()]
            rows, ids = batch.column("row_id").to_numpy(), batch.column("order_id").to_numpy()
            parts = segments(texts, window)
            for a, b in sliced([p[1] for p in parts]):
                own = parts[a:b]
                data, at = concat_bytes([p[1] for p in own])
                text, r = window_runs(data, at, at[:-1] + [p[3] for p in own], at[:-1] + [p[4] for p in own], window)
                if not len(r):
                    continue
                which = np.array([p[0] for p in own])[text]
                start, row, doc = r["start"] + np.array([p[2] for p in own])[text], rows[which], ids[which]
                low, _ = least_by(mix64(r["gram"]) ^ r["whole"], doc)
                later = doc > low
                gone = spans(row[later], start[later], r["n"][later])
                r, start, row, doc = r[~later], start[~later], row[~later], doc[~later]
                bucket, gram = (r["gram"] % np.uint64(buckets)).astype(np.int64), r["gram"] >> np.uint64(16)
                sides = np.stack([r["left"], r["right"]], axis=1)
                order = np.argsort(bucket, kind="stable")
                moved = []
                for k, s0, s1 in zip(*_groups(bucket[order])):
                    i = order[s0:s1]
                    moved.append((k, low_bytes(gram[i], 5).tobytes(), low_bytes(r["whole"][i], 5).tobytes(), sides[i].tobytes(), start[i].astype("<i4").tobytes(), r["n"][i].tobytes(), r["q"][i].tobytes(), deltas(doc[i]).tobytes(), deltas(row[i]).tobytes(), None))
                moved += [(k, *[None] * 8, s) for k, s in cut(gone["row"] % buckets, [gone])]
                yield batch_of(out, *zip(*moved))

    return numbered(docs).select("row_id", "order_id", "text").mapInArrow(scan, ddl(RUNS))


def _groups(sorted_keys: np.ndarray) -> tuple[list, list, list]:
    start, length = runs(sorted_keys)
    return sorted_keys[start].tolist(), start.tolist(), (start + length).tolist()


def match_runs(buckets: int):
    """Reducer over one bucket of runs: spans of runs that a smaller doc has whole, and runs left open."""

    def match(table: pa.Table) -> pa.Table:
        get = lambda n, t: joined(table, n, t)
        gram, whole = from_low_bytes(get("gram", "u1"), 5), from_low_bytes(get("whole", "u1"), 5)
        doc, row = (np.concatenate([np.zeros(0, np.int64), *(np.cumsum(np.frombuffer(x, "<i8")) for x in table.column(c).to_pylist() if x)]) for c in ("doc", "row"))
        sides, start, n, q = get("sides", "<u2").reshape(-1, 2).astype(np.uint64), get("start", "<i4"), get("n", "u1"), get("q", "u1")
        low, high = least_by(gram, doc)
        alive = low < high
        gram, whole, doc, row, sides, start, n, q = (x[alive] for x in (gram, whole, doc, row, sides, start, n, q))
        first, _ = least_by(mix64(gram) ^ mix64(whole + np.uint64(1)), doc)
        later = doc > first
        gone = spans(row[later], start[later], n[later])
        agree = []
        for c in (0, 1):
            low, high = least_by(mix64(gram) ^ mix64(sides[:, c] + np.uint64(2)), doc)
            agree.append((low < high) << c)
        either = (agree[0] | agree[1]).astype(np.uint8)
        # a run whose only likeness is itself, elsewhere, has nothing to compare
        least, most = least_by(gram, whole.view(np.int64))
        same = least == most
        keep = ~later & (either > 0) & ~same
        left = np.zeros(int(keep.sum()), OPEN)
        for c, v in (("row", row), ("doc", doc), ("start", start), ("n", n), ("q", q), ("sides", either)):
            left[c] = v[keep]
        passed = joined(table, "span", SPAN)
        out = [(k, s, None) for k, s in cut(gone["row"] % buckets, [gone]) + cut(passed["row"] % buckets, [passed])]
        out += [(k, None, s) for k, s in cut(left["row"] % buckets, [left])]
        return table_of(out, FOUND)

    return match


def digits_of(windows: np.ndarray) -> np.ndarray:
    """Windows of bytes as rows of big-endian eight-byte digits."""
    n, w = windows.shape
    padded = np.zeros((n, -(-w // 8) * 8), np.uint8)
    padded[:, :w] = windows
    return padded.view(">u8").astype(np.uint64)


def radix_groups(digits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(members, group) of all rows equal to another in every digit; one pass a digit, most significant first, and only over rows still tied."""
    members, group = np.arange(len(digits)), np.zeros(len(digits), np.int64)
    for d in range(digits.shape[1]):
        key = digits[members, d]
        order = np.lexsort((key, group))
        members, key, group = members[order], key[order], group[order]
        new = np.concatenate(([True], (key[1:] != key[:-1]) | (group[1:] != group[:-1]))) if len(key) else np.zeros(0, bool)
        number = np.cumsum(new) - 1
        tied = np.bincount(number, minlength=1)[number] > 1 if len(key) else new
        members, group = members[tied], number[tied]
    return members, group


def later_windows(windows: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which windows a row with a smaller doc has too."""
    members, group = radix_groups(digits_of(windows))
    out = np.zeros(len(doc), bool)
    if len(members):
        low, _ = least_by(group, doc[members])
        out[members] = doc[members] > low
    return out


def hash_of(windows: np.ndarray) -> np.ndarray:
    h = np.zeros(len(windows), np.uint64)
    for c in digits_of(windows).T:
        h = mix64(h * np.uint64(31) + c)
    return h


def text_of(texts: pa.Table) -> dict[int, bytes]:
    return {r: t or b"" for r, t in zip(texts.column("row_id").to_pylist(), texts.column("text").to_pylist())}


def places(text: dict[int, bytes], row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts of some rows (sorted) as one byte array, and for each row where its text begins."""
    rows = np.unique(row)
    data, at = concat_bytes([text[x] for x in rows.tolist()])
    return data, at[np.searchsorted(rows, row)]


def planes(x: np.ndarray) -> bytes:
    """Numbers by bytes of one weight after the other, so that leading zeros lie together."""
    return np.ascontiguousarray(x.astype("<i8").view("u1").reshape(-1, 8).T).tobytes()


def from_planes(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(x, "u1").reshape(8, -1).T).view("<i8").ravel()


def open_windows(buckets: int, window: int, gram: int):
    """Cogroup of texts and open runs by bucket: a digit of each of their windows, dealt by all bytes; of equal ones in the bucket only the smallest doc's moves."""

    def windows(texts: pa.Table, found: pa.Table) -> pa.Table:
        runs_ = joined(found, "open", OPEN) if found.num_rows else np.zeros(0, OPEN)
        runs_ = runs_[np.argsort(runs_["row"], kind="stable")]
        text = text_of(texts) if len(runs_) else {}
        out = []
        for k in range(0, len(runs_), 20_000):
            r = runs_[k : k + 20_000]
            data, base = places(text, r["row"])
            i = np.repeat(np.arange(len(r)), r["n"])
            o = np.arange(len(i)) - np.repeat(np.cumsum(r["n"].astype(np.int64)) - r["n"], r["n"])
            before = r["q"][i].astype(np.int64) - o  # bytes of the window before its gram
            side = r["sides"][i]
            need = ((side & 1 > 0) & (before >= SIDE)) | ((side & 2 > 0) & (window - gram - before >= SIDE))
            i, o = i[need], o[need]
            if not len(i):
                continue
            w = np.lib.stride_tricks.sliding_window_view(data, window)[base[i] + r["start"][i] + o]
            doc, row, start = r["doc"][i], r["row"][i], (r["start"][i] + o).astype("<i4")
            later = later_windows(w, doc)
            gone = spans(row[later], start[later], np.ones(int(later.sum()), np.uint8))
            h, row, start = hash_of(w[~later]), row[~later], start[~later]
            bucket, digit = (h % np.uint64(buckets)).astype(np.int64), low_bytes(h >> np.uint64(24), 5)
            order = np.argsort(bucket, kind="stable")
            for b, s0, s1 in zip(*_groups(bucket[order])):
                i = order[s0:s1]
                out.append((b, digit[i].tobytes(), planes(deltas(row[i])), planes(start[i]), None))
            out += [(b, None, None, None, s) for b, s in cut(gone["row"] % buckets, [gone])]
        return table_of(out, DIGITS)

    return windows


def match_digits(buckets: int):
    """Reducer over one bucket of digits: windows that share theirs with another row, each a span left open."""

    def match(table: pa.Table) -> pa.Table:
        digit = from_low_bytes(joined(table, "digit", "u1"), 5)
        row, start = (np.concatenate([np.zeros(0, np.int64), *(f(from_planes(x)) for x in table.column(c).to_pylist() if x)]) for c, f in (("row", np.cumsum), ("start", np.asarray)))
        low, high = least_by(digit, row)
        tied = low < high
        left, gone = spans(row[tied], start[tied], np.ones(int(tied.sum()), np.uint8)), joined(table, "span", SPAN)
        return table_of([(k, s, None) for k, s in cut(gone["row"] % buckets, [gone])] + [(k, None, s) for k, s in cut(left["row"] % buckets, [left])], FOUND)

    return match


def tied_windows(buckets: int, window: int):
    """Cogroup of texts and windows left open by bucket: their bytes, dealt by all of them."""

    def windows(texts: pa.Table, found: pa.Table) -> pa.Table:
        left = joined(found, "open", SPAN) if found.num_rows else np.zeros(0, SPAN)
        left = left[np.argsort(left["row"], kind="stable")]
        text = text_of(texts) if len(left) else {}
        ids, out = dict(zip(texts.column("row_id").to_pylist(), texts.column("order_id").to_pylist())), []
        for k in range(0, len(left), 200_000):
            r = left[k : k + 200_000]
            data, base = places(text, r["row"])
            w = np.lib.stride_tricks.sliding_window_view(data, window)[base + r["start"]]
            doc = np.array([ids[x] for x in r["row"].tolist()], np.int64)
            out += cut((hash_of(w) % np.uint64(buckets)).astype(np.int64), [w, doc, r["row"], r["start"]])
        return table_of(out, WINDOWS)

    return windows


def match_windows(buckets: int, window: int):
    def match(table: pa.Table) -> pa.Table:
        w, doc, row, start = joined(table, "bytes", "u1").reshape(-1, window), joined(table, "doc", "<i8"), joined(table, "row", "<i8"), joined(table, "start", "<i4")
        later = later_windows(w, doc)
        gone = spans(row[later], start[later], np.ones(int(later.sum()), np.uint8))
        return table_of([(k, s, None) for k, s in cut(gone["row"] % buckets, [gone])], FOUND)

    return match


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, removed array<struct<start, end>> (byte ranges, maximal), kept binary.

    docs is read four times and must give the same rows in the same files each time, as a table does.
    """
    buckets = bucket_count(spread_of(docs))
    found = materialize(deal_runs(docs, buckets, window).groupBy("bucket").applyInArrow(match_runs(buckets), ddl(FOUND)), "runs")
    read = numbered(docs).withColumn("bucket", F.pmod("row_id", F.lit(buckets)))
    texts = read.select("bucket", "row_id", "order_id", "text").groupBy("bucket")
    opened = lambda found: found.filter("open is not null").select("bucket", "open").groupBy("bucket")
    digits = texts.cogroup(opened(found)).applyInArrow(open_windows(buckets, window, gram), ddl(DIGITS))
    ties = materialize(digits.groupBy("bucket").applyInArrow(match_digits(buckets), ddl(FOUND)), "ties")
    windows = texts.cogroup(opened(ties)).applyInArrow(tied_windows(buckets, window), ddl(WINDOWS))
    more = materialize(windows.groupBy("bucket").applyInArrow(match_windows(buckets, window), ddl(FOUND)), "windows")
    every = reduce(DataFrame.unionByName, (x.filter("span is not null").select("bucket", "span") for x in (found, ties, more)))
    pair = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    out = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("removed", pa.list_(pair)), ("kept", BINARY)])

    def apply(texts: pa.Table, gone: pa.Table) -> pa.Table:
        s = joined(gone, "span", SPAN) if gone.num_rows else np.zeros(0, SPAN)
        s = s[np.argsort(s["row"], kind="stable")]
        rows = texts.column("row_id").to_numpy()
        a, b = np.searchsorted(s["row"], rows), np.searchsorted(s["row"], rows, "right")
        size, cuts, kept = [], [], []
        for i, t in enumerate(texts.column("text").to_pylist()):
            t = t or b""
            size.append(len(t))
            mark = np.zeros(len(t) + 1, np.int32)
            own = s[a[i] : b[i]]
            np.add.at(mark, own["start"], 1)
            np.add.at(mark, own["start"] + own["n"].astype(np.int64) + window - 1, -1)
            inside = np.concatenate(([False], np.cumsum(mark) > 0))
            edge = np.nonzero(inside[1:] != inside[:-1])[0].tolist()
            cuts.append([{"start": x, "end": y} for x, y in zip(edge[::2], edge[1::2])])
            kept.append(b"".join(t[x:y] for x, y in zip([0, *edge[1::2]], [*edge[::2], len(t)])))
        return pa.table([texts.column("doc_id"), pa.array(size, pa.int64()), pa.array(cuts, pa.list_(pair)), pa.array(kept, BINARY)], schema=out)

    result = read.select("bucket", "row_id", "doc_id", "text").groupBy("bucket").cogroup(every.groupBy("bucket")).applyInArrow(apply, "doc_id long, n_bytes long, removed array<struct<start: long, end: long>>, kept binary")
    return result
