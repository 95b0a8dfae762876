"""N-gram Jaccard join, size-aware: subsets for light sets, inverted lists for heavy sets.

One scan turns each text into its set of word shingles (64-bit hashes). Shingles are dealt by hash to count in how many
documents each occurs; one that occurs once can be in no intersection. Sets keep their shared shingles, rarest first. A
set whose prefix (size - ceil(t * size) + 1 shingles) is all unshared has no link and is done there.

Light sets (size up to a boundary) meet through all subsets of the size that a link between two given sizes needs; heavy
sets scan the inverted lists of prefix shingles, in which light sets are entered too. The boundary is the one for which
enumerated subsets plus scanned entries are fewest, from counts over all sets.

Documents with equal sets are one class. Within a key (subset or list) not all pairs are formed: a few pivots are compared
with the rest (pairs whose parity sketches differ in too many bits cannot link and are not formed), exact links merge classes into components, and keys whose members are all in one component are done. Pivots leave their
key when compared with all of it, and their number grows fourfold each round, so every pair that is not already connected is verified and no
link between components is lost.

Defined results: null or blank text has an empty set, linked with nothing; fewer words than the shingle length give one shingle; a null doc_id is
carried along and never the smallest unless alone; repeated rows are one class; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.blobs import bucket_count, cut, joined, runs
from granary.llm.common import UPPER_TO_LOWER, batch_of, byte_table, materialize, mix64, row_ids, sliced_sizes, spread_of
from granary.llm.graph import components

MAX_LIGHT, WORDS_OF_SKETCH, BASE, ALL_PAIRS = 40, 8, np.uint64(0x9E3779B97F4A7C15), 8
CHARS = byte_table(7)
IS_WS = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
RES_BITS = np.uint64(48)
SKETCH = [f"k{i}" for i in range(WORDS_OF_SKETCH)]


class Powers:
    """Powers of an odd number modulo 2**64, and of its inverse."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int):
        if len(self.up) < n:
            up, down = np.full(n, BASE), np.full(n, np.uint64(pow(int(BASE), -1, 1 << 64)))
            up[0] = down[0] = 1
            self.up, self.down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        return self.up, self.down


POWERS = Powers()


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in order, and where each text's words begin (one more entry for the end)."""
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    space = IS_WS[data]
    begin = np.nonzero(~space & np.concatenate(([True], space[:-1])))[0]
    end = np.nonzero(space & np.concatenate(([False], ~space[:-1])))[0]
    up, down = POWERS.to(len(data) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(CHARS[data] * up[: len(data)], dtype=np.uint64)))
    h = mix64((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64))
    at = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return h, np.searchsorted(begin, at)


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text (lower-cased A-Z)."""
    h, at = word_hashes([t.translate(UPPER_TO_LOWER) for t in texts])
    grams = h[: max(0, len(h) - size + 1)].copy()
    for j in range(1, size):
        grams = mix64(grams * BASE + h[j : j + len(grams)])
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(grams[a : b - size + 1]))
        elif b > a:
            g = h[a : a + 1].copy()
            for j in range(a + 1, b):
                g = mix64(g * BASE + h[j : j + 1])
            out.append(mix64(g + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


META = [("row_id", "<i8"), ("doc_id", "<i8"), ("has_id", "u1"), ("n", "<i8"), ("hi", "<u8"), ("lo", "<u8")]


def parity_sketch(tokens: np.ndarray) -> np.ndarray:
    """Bits that tokens flip, one each: two sketches differ in no more bits than their sets differ in tokens."""
    bits = np.bincount((mix64(tokens.view(np.uint64)) & np.uint64(64 * WORDS_OF_SKETCH - 1)).astype(np.int64), minlength=64 * WORDS_OF_SKETCH) & 1
    return np.packbits(bits.astype(np.uint8)).view("<i8")


def document_sets(docs: DataFrame, size: int, num: int, den: int, key: str | None = None) -> DataFrame:
    """row_id, doc_id, n, set_hi, set_lo, n_shared, prefix array<long>, shared array<long> (both empty where no link is possible) and SKETCH of the shared ones."""
    buckets = bucket_count(spread_of(docs))
    # the bucket stands for the low bits of a hash where its number fits beside the rest; else all 64 bits are dealt
    width = 6 if buckets < 1 << 15 else 8
    dealt = pa.schema([("bucket", pa.int64()), ("res", pa.binary()), ("doc", pa.binary()), ("meta", pa.binary())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # only one slice of the batch is held as Python strings
            column = batch.column("text")
            rows, docs_ = batch.column("row_id").to_numpy(), batch.column("doc_id").to_pylist()
            for a, b in sliced_sizes(pc.fill_null(pc.binary_length(column), 0).to_pylist()):
                sets = shingle_sets([t or b"" for t in column.slice(a, b - a).to_pylist()], size)
                lengths = np.array([len(s) for s in sets], np.int64)
                whole = np.concatenate(sets)
                meta = np.zeros(b - a, META)
                meta["row_id"], meta["n"] = rows[a:b], lengths
                meta["doc_id"], meta["has_id"] = [d or 0 for d in docs_[a:b]], [d is not None for d in docs_[a:b]]
                meta["hi"], meta["lo"] = [np.add.reduce(mix64(s)) for s in sets], [np.add.reduce(mix64(s ^ BASE)) for s in sets]
                doc = np.repeat(rows[a:b], lengths)
                pieces = cut((whole % np.uint64(buckets)).astype(np.int64), [(whole >> np.uint64(8 * (8 - width))).view("u1").reshape(-1, 8)[:, :width], doc])
                out = [(k, res, ids, None) for k, res, ids in pieces] + [(k, None, None, m) for k, m in cut(meta["row_id"] % buckets, [meta])]
                yield batch_of(dealt, *zip(*out))

    def count(table: pa.Table) -> pa.Table:
        """Shared shingles of this bucket go to their documents with their counts; so does what is known of documents."""
        k = table.column("bucket")[0].as_py()
        dealt_res = joined(table, "res", "u1").reshape(-1, width)
        res = np.zeros((len(dealt_res), 8), np.uint8)
        res[:, :width] = dealt_res
        token, doc = res.reshape(-1).view("<u8"), joined(table, "doc", "<i8")
        order = np.argsort(token, kind="stable")
        start, length = runs(token[order])
        df = np.repeat(length, length)
        many = df > 1
        token, doc, df = token[order][many], doc[order][many], df[many]
        token = (token | np.uint64(k) << RES_BITS if width == 6 else token).view(np.int64)
        out = [(b, ids, t, n, None) for b, ids, t, n in cut(doc % buckets, [doc, token, df.astype("<u4")])]
        meta = joined(table, "meta", META)
        out += [(b, None, None, None, m) for b, m in cut(meta["row_id"] % buckets, [meta])]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, [pa.int64()] + [pa.binary()] * 4)], names=["bucket", "doc", "token", "df", "meta"])

    found = pa.schema([*((c, pa.int64()) for c in ("row_id", "doc_id", "n", "set_hi", "set_lo", "n_shared")), ("prefix", pa.list_(pa.int64())), ("shared", pa.list_(pa.int64())), *((c, pa.int64()) for c in SKETCH)])

    def gather(table: pa.Table) -> pa.Table:
        meta = joined(table, "meta", META)
        doc, token, df = joined(table, "doc", "<i8"), joined(table, "token", "<i8"), joined(table, "df", "<u4")
        order = np.lexsort((token, df, doc))
        doc, token = doc[order], token[order]
        a, b = np.searchsorted(doc, meta["row_id"]), np.searchsorted(doc, meta["row_id"], "right")
        prefixes, shares, sketches = [], [], np.zeros((len(meta), WORDS_OF_SKETCH), np.int64)
        for i, (x, y, n) in enumerate(zip(a.tolist(), b.tolist(), meta["n"].tolist())):
            take = n - -(-num * n // den) + 1 - (n - (y - x)) if n else 0  # prefix length less the unshared shingles
            prefixes.append(token[x : x + take] if take > 0 else token[:0])
            shares.append(np.sort(token[x:y]) if take > 0 else token[:0])
            if take > 0:
                sketches[i] = parity_sketch(token[x:y])
        ids = pa.array(meta["doc_id"], pa.int64(), mask=meta["has_id"] == 0)
        lists = [pa.array(p, pa.list_(pa.int64())) for p in (prefixes, shares)]
        return pa.table([meta["row_id"], ids, meta["n"], meta["hi"].view("<i8"), meta["lo"].view("<i8"), b - a, *lists, *sketches.T.copy()], schema=found)

    read = docs.select(row_ids(docs, key).alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    tokens = read.mapInArrow(deal, "bucket long, res binary, doc binary, meta binary")
    shared = tokens.groupBy("bucket").applyInArrow(count, "bucket long, doc binary, token binary, df binary, meta binary")
    schema = "row_id long, doc_id long, n long, set_hi long, set_lo long, n_shared long, prefix array<long>, shared array<long>, " + ", ".join(f"{c} long" for c in SKETCH)
    return materialize(shared.groupBy("bucket").applyInArrow(gather, schema), "sets")


def needed(n: int, m: int, num: int, den: int) -> int:
    """Least intersection of sets of sizes n and m that link."""
    return -(-num * (n + m) // (num + den))


def subset_sizes(n: int, num: int, den: int) -> list[int]:
    return sorted({needed(n, m, num, den) for m in range(max(1, -(-num * n // den)), den * n // num + 1)})


def boundary(sets: DataFrame, num: int, den: int) -> int:
    """Largest size that counts as light: fewest subsets enumerated plus list entries scanned."""
    small = sets.filter(F.col("n") <= MAX_LIGHT)
    enumerated, scanned = {}, {}
    for n, s, k in small.groupBy("n", "n_shared").count().collect():  # at most MAX_LIGHT**2 rows
        enumerated[n] = enumerated.get(n, 0) + k * sum(comb(s, c) for c in subset_sizes(n, num, den))
    entries = sets.select("n", F.explode("prefix").alias("key"))
    lengths = materialize(entries.groupBy("key").agg(F.count(F.lit(1)).alias("length")), "lengths")
    for n, k in entries.filter(F.col("n") <= MAX_LIGHT).join(lengths, "key").groupBy("n").agg(F.sum("length")).collect():
        scanned[n] = k
    costs = {x: sum(v for n, v in enumerated.items() if n <= x) + sum(v for n, v in scanned.items() if n > x) for x in range(MAX_LIGHT + 1)}
    return min(costs, key=costs.get)


def subset_keys(light: DataFrame, num: int, den: int) -> DataFrame:
    """key, id: hashes of all subsets of the sizes needed, from shared shingles alone."""
    out = pa.schema([("key", pa.int64()), ("id", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, n, shared in zip(*(batch.column(c).to_pylist() for c in ("id", "n", "shared"))):
                tokens = mix64(np.array(shared, np.int64).view(np.uint64))
                keys = []
                for c in subset_sizes(n, num, den):
                    if c <= len(tokens):  # leave out the few that the subset lacks
                        gone = np.array([np.add.reduce(tokens[list(x)]) for x in combinations(range(len(tokens)), len(tokens) - c)], np.uint64)
                        keys.append(mix64(np.add.reduce(tokens) - gone + np.uint64(c)))
                if keys:
                    key = np.concatenate(keys).view(np.int64)
                    yield batch_of(out, key, np.full(len(key), i))

    return light.select("id", "n", "shared").mapInArrow(scan, "key long, id long")


def links(entries: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """id, label: components of classes that exact links connect. entries: key, id, n, n_shared, SKETCH, light (met through subsets), key_kind."""
    spark = entries.sparkSession
    sets = sets.select("id", "n", "shared")
    labels = None
    work = materialize(entries.withColumn("comp", F.col("id")), "entries")
    pivots = 1
    while True:
        per_key = work.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.min(F.struct(F.xxhash64("id").alias("h"), "id")).alias("first"))
        # sums of a key are a table of their own before they meet its entries, so that the planner can split the entries of a frequent key
        per_key = materialize(per_key.filter("c0 <> c1").select("key", "size", F.col("first.id").alias("first")), "keys")
        live = materialize(work.join(per_key, "key"), "live")
        if live.isEmpty():
            return labels if labels is not None else spark.createDataFrame([], "id long, label long")
        # small keys: every member is a pivot; large keys: the first by hash and about `pivots` more
        is_pivot = (F.col("size") <= ALL_PAIRS) | (F.col("id") == F.col("first")) | (F.pmod(F.xxhash64("id", F.lit(pivots)), F.lit(1 << 30)) < F.lit(float(pivots << 30)) / F.col("size"))
        live = live.withColumn("pivot", is_pivot)
        p = live.filter("pivot").select("key", *(F.col(c).alias(f"p_{c}") for c in ("id", "n", "n_shared", "light", "comp", *SKETCH)))
        # shingles that differ at least: the unshared ones and the bits in which sketches of the shared ones differ
        differ = F.col("n") - F.col("n_shared") + F.col("p_n") - F.col("p_n_shared") + sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"p_{c}"))) for c in SKETCH), F.lit(0))
        need = F.ceil((F.col("n") + F.col("p_n")) * F.lit(num) / F.lit(float(num + den)) - 1e-9)
        pairs = live.join(p, "key").filter(
            (F.col("comp") != F.col("p_comp"))
            & (~F.col("pivot") | (F.col("id") < F.col("p_id")))
            & ~(F.col("light") & F.col("p_light") & (F.col("key_kind") == 0))
            & (F.least("n", "p_n") * den >= F.greatest("n", "p_n") * num)
            & (F.least("n_shared", "p_n_shared") >= need)
            & (differ <= F.col("n") + F.col("p_n") - 2 * need)
        )
        pairs = pairs.select(F.least("id", "p_id").alias("a"), F.greatest("id", "p_id").alias("b"), F.least("comp", "p_comp").alias("ca"), F.greatest("comp", "p_comp").alias("cb")).distinct()
        left = sets.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("shared").alias("s_a"))
        right = sets.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("shared").alias("s_b"))
        both = F.size(F.array_intersect("s_a", "s_b"))
        linked = pairs.join(left, "a").join(right, "b").filter(den * both >= num * (F.col("n_a") + F.col("n_b") - both))
        merged = materialize(linked.select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct(), "links")
        rest = live.filter("not pivot").drop("pivot", "size", "first")
        if not merged.isEmpty():
            new = components(merged)
            moved = new.select(F.col("id").alias("comp"), F.col("label").alias("now"))
            rest = rest.join(moved, "comp", "left").withColumn("comp", F.coalesce("now", "comp")).drop("now")
            if labels is None:
                labels = new
            else:
                old = labels.join(new.select(F.col("id").alias("label"), F.col("label").alias("now")), "label", "left").select("id", F.coalesce("now", "label").alias("label"))
                labels = materialize(old.unionByName(new.join(labels, "id", "left_anti")), "labels")
        work = materialize(rest.select(*work.columns), "entries")
        pivots *= 4


def near_duplicates(docs: DataFrame, size: int = 5, num: int = 8, den: int = 10, key: str | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id: documents whose shingle sets have Jaccard >= num / den are linked; component_id is the smallest doc_id reachable.

    key: a column that numbers the rows of docs; the result then has it as row_id, and kept, true for one row of each component (the smallest doc_id, then the smallest row).
    """
    found = document_sets(docs, size, num, den, key)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_id")).alias("first")
    # sums of a group are tables of their own before they meet its rows, so that the planner can split the rows of a large group
    classes = materialize(found.filter("n > 0").groupBy("n", "set_hi", "set_lo").agg(F.min("row_id").alias("id"), first), "class-sums")
    rows = materialize(found.select("row_id", "doc_id", "n", "set_hi", "set_lo").join(classes, ["n", "set_hi", "set_lo"], "left"), "classes")
    open_ = found.filter(F.size("prefix") > 0).withColumnRenamed("row_id", "id")
    open_ = materialize(open_.join(classes.select("id"), "id", "left_semi"), "open")
    x = boundary(open_, num, den)
    light = (F.col("n") <= x).alias("light")
    facts = open_.select("id", "n", "n_shared", light, *SKETCH)
    lists = open_.select(F.explode("prefix").alias("key"), "id", "n", "n_shared", light, *SKETCH, F.lit(0).alias("key_kind"))
    subsets = subset_keys(open_.filter(F.col("n") <= x), num, den).join(facts, "id").withColumn("key_kind", F.lit(1))
    labels = links(lists.unionByName(subsets), open_, num, den)
    least = classes.join(labels, "id").groupBy("label").agg(F.min("first").alias("least"))  # one row for each component of two classes or more
    merged = materialize(labels.join(materialize(least, "components"), "label").select("id", "least"), "merged")
    named = rows.join(merged, "id", "left").withColumn("one", F.coalesce("least", "first"))
    kept = F.coalesce(F.col("one.row_id") == F.col("row_id"), F.lit(True)).alias("kept")
    component = F.coalesce("one.doc_id", "doc_id").alias("component_id")
    return named.select(*["row_id"] * bool(key), "doc_id", F.col("n").alias("n_shingles"), component, *[kept] * bool(key))
