"""Source divergence audit: how far the term frequencies of a source lie from those of other sources of its language, and which terms set it apart.

Terms of each language that occur in enough of its documents are kept. A group (lang, source) and a language give each kept term a smoothed frequency in whole
billionths. Part `pair`: the summed absolute difference to each other source of the language. Part `term`: terms more frequent in the group than in the language, the first
`top` by difference.

Counting: each task counts terms of whole texts by group, and documents by term, before anything moves; one shuffle by language and term gives group counts, language
counts and document counts together.

Terms: dominance skyband. A term dominates another if its group count is not lower, its language count not higher, and it comes earlier in UTF-8: then its value is not lower
either, and it wins ties. A term dominated by `top` others cannot be among the first `top`. Tasks keep, for each group, the terms that fewer than `top` others dominate; these
skybands are merged group by group as they stream in, and only what is left is valued and ranked exactly.

Pairs: the terms of a language are cut into buckets, its sources into blocks; a task holds one bucket for two blocks as a dense matrix and sums differences. Terms that neither
source of a pair has differ by the same amount each, so they are counted, not listed.

Defined results: null text, lang and source count as empty; so '' is a language and a source as others are; repeated rows count each; a language without kept terms gives pairs of value 0 and
no terms; a source alone in its language gives no pairs; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from granary.llm.common import batch_of, materialize

MIN_DOCS, SMOOTH, WHOLE, TOP = 30, 5, 10**9, 50
#: Bytes of terms stay, A-Z lower-cased; others separate.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
HELD_ENTRIES = 1_000_000  # counts that a task holds before it passes them on
BUCKET_TERMS, BLOCK_SOURCES = 4096, 64
CHUNK, HELD_ROWS = 1024, 400_000  # rows of a group that are compared at once; rows that a task holds for all its groups


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term (bytes), n, docs, summed up within tasks; a row with the empty term for every group."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("n", pa.int64()), ("docs", pa.int64())])

    def flush(counts: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in counts.items():
            terms = [b"", *n]
            yield batch_of(schema, [lang] * len(terms), [source] * len(terms), terms, [0, *n.values()], [0, *(docs[t] for t in n)])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        for batch in batches:
            for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text"))):
                if (lang, source) not in counts:
                    counts[lang, source] = (Counter(), Counter())
                n, docs = counts[lang, source]
                words = text.translate(TERM_BYTES).split()
                n.update(words)
                docs.update(set(words))
            if sum(len(n) for n, _ in counts.values()) > HELD_ENTRIES:
                yield from flush(counts)
                counts = {}
        yield from flush(counts)

    some = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    read = docs.select(some("lang"), some("source"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    return read.mapInArrow(scan, "lang string, source string, term binary, n long, docs long")


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, source, term, n, lang_n, head (one row of each term of a language has it): counts of terms in min_docs documents of the language; the empty term stands for its group."""
    counts = term_counts(docs).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    rows = counts.withColumns({"lang_n": F.sum("n").over(term), "in_docs": F.sum("docs").over(term), "head": F.col("source") == F.min("source").over(term)})
    return rows.filter((F.col("term") == F.lit(b"")) | (F.col("in_docs") >= min_docs)).select("lang", "source", "term", "n", "lang_n", "head")


def frequency(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(WHOLE * (count + SMOOTH) / (total + SMOOTH * terms)), exactly; 0 where nothing is kept."""
    wide = lambda c: c.cast("decimal(19, 0)")
    whole = F.lit(WHOLE).cast("decimal(10, 0)") * (wide(count) + F.lit(SMOOTH).cast("decimal(1, 0)"))
    under = wide(total) + F.lit(SMOOTH).cast("decimal(1, 0)") * wide(terms)
    # decimals divide exactly to a whole number by the remainder
    return F.when(terms > 0, 1 + ((whole - whole % under) / under).cast("long")).otherwise(F.lit(0).cast("long"))


def group_facts(kept: DataFrame) -> DataFrame:
    """lang, source, total (occurrences of kept terms), terms (kept by the language), lang_total, p0 (of a term that the group has not), block, blocks, buckets."""
    term = F.col("term") != F.lit(b"")
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))  # every group has its row with the empty term
    langs = kept.groupBy("lang").agg(F.sum(F.when(term & F.col("head"), 1).otherwise(0)).alias("terms"), F.sum("n").alias("lang_total"), F.count(F.when(~term, 1)).alias("sources"))
    facts = totals.join(langs, "lang").withColumn("p0", frequency(F.lit(0), F.col("total"), F.col("terms")))
    parts = lambda n, size: F.greatest(F.ceil(n / size), F.lit(1)).cast("int")
    facts = facts.withColumns({"blocks": parts(F.col("sources"), BLOCK_SOURCES), "buckets": parts(F.col("terms"), BUCKET_TERMS)})
    return facts.withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int")).drop("sources")


def with_others(rows: DataFrame) -> DataFrame:
    """Each row once for every pair of blocks (a, b) that its block is of."""
    other = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return other.withColumns({"a": F.least("block", "other"), "b": F.greatest("block", "other")}).drop("other")


def differences(p: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Summed absolute differences of rows left and rows right of p."""
    return np.stack([np.abs(p[right] - p[i]).sum(axis=1) for i in left]) if len(left) else np.zeros((0, len(right)), np.int64)


def pair_sums(kept: DataFrame, facts: DataFrame) -> DataFrame:
    """lang, i, j, value for every two sources of a language, i before j."""
    key = ["lang", "bucket", "a", "b"]
    rows = kept.filter(F.col("term") != F.lit(b"")).join(facts, ["lang", "source"])
    rows = rows.withColumns({"p": frequency(F.col("n"), F.col("total"), F.col("terms")), "bucket": F.pmod(F.xxhash64("term"), F.col("buckets")).cast("int")})
    rows = with_others(rows.select("lang", "bucket", "block", "blocks", "source", "term", "p")).select(*key, "source", "term", "p")
    sources = with_others(facts.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)))).select(*key, "source", "block", "p0")
    schema = pa.schema([("lang", pa.string()), ("i", pa.string()), ("j", pa.string()), ("value", pa.int64()), ("n_terms", pa.int64()), ("apart", pa.int64())])

    def add_up(groups: pa.Table, terms: pa.Table) -> pa.Table:
        if not groups.num_rows:
            return schema.empty_table()
        found = sorted(zip(*(groups.column(c).to_pylist() for c in ("source", "block", "p0"))))
        names, block, p0 = [f[0] for f in found], np.array([f[1] for f in found]), np.array([f[2] for f in found], np.int64)
        at = {s: i for i, s in enumerate(names)}
        coded = terms.column("term").combine_chunks().dictionary_encode()
        p = np.repeat(p0[:, None], len(coded.dictionary), axis=1)
        p[[at[s] for s in terms.column("source").to_pylist()], coded.indices.to_numpy()] = terms.column("p").to_numpy()
        a, b = groups.column("a")[0].as_py(), groups.column("b")[0].as_py()
        left, right = np.nonzero(block == a)[0], np.nonzero(block == b)[0]
        sums = differences(p, left, right)
        i, j = np.repeat(left, len(right)), np.tile(right, len(left))
        use = i < j if a == b else np.ones(len(i), bool)
        i, j, sums = i[use], j[use], sums.ravel()[use]
        low, high = np.minimum(i, j), np.maximum(i, j)
        lang = groups.column("lang")[0].as_py()
        listed = [[names[x] for x in low], [names[x] for x in high]]
        return pa.Table.from_batches([batch_of(schema, [lang] * len(i), *listed, sums, [p.shape[1]] * len(i), np.abs(p0[i] - p0[j]))])

    parts = sources.groupBy(*key).cogroup(rows.groupBy(*key)).applyInArrow(add_up, "lang string, i string, j string, value long, n_terms long, apart long")
    sums = parts.groupBy("lang", "i", "j").agg(F.sum("value").alias("value"), F.sum("n_terms").alias("n_terms"), F.max("apart").alias("apart"))
    langs = facts.groupBy("lang").agg(F.max("terms").alias("terms"))
    return sums.join(langs, "lang").select("lang", "i", "j", (F.col("value") + (F.col("terms") - F.col("n_terms")) * F.col("apart")).alias("value"))


def undominated(n: np.ndarray, lang_n: np.ndarray, k: int) -> np.ndarray:
    """Which rows, in the order of their terms, fewer than k rows dominate: those before them with no lower n and no higher lang_n."""
    keep = np.zeros(len(n), bool)
    for a in range(0, len(n), CHUNK):
        b = min(a + CHUNK, len(n))
        over = (n[None, :b] >= n[a:b, None]) & (lang_n[None, :b] <= lang_n[a:b, None]) & (np.arange(b)[None, :] < np.arange(a, b)[:, None])
        keep[a:b] = over.sum(axis=1) < k
    return keep


class Skyband:
    """The terms of one group that fewer than k others dominate, of all that were added."""

    def __init__(self, k: int):
        self.k, self.terms, self.counts, self.waiting = k, [], np.zeros((2, 0), np.int64), []

    def add(self, terms: list[bytes], n: np.ndarray, lang_n: np.ndarray) -> None:
        self.waiting.append((terms, np.stack([n, lang_n])))
        if sum(len(t) for t, _ in self.waiting) >= CHUNK:
            self.merge()

    def merge(self) -> None:
        terms = self.terms + [t for ts, _ in self.waiting for t in ts]
        counts = np.concatenate([self.counts, *(c for _, c in self.waiting)], axis=1)
        order = sorted(range(len(terms)), key=terms.__getitem__)
        counts = counts[:, order]
        keep = undominated(*counts, self.k)
        self.terms, self.counts, self.waiting = [terms[i] for i, k in zip(order, keep) if k], counts[:, keep], []

    def __len__(self) -> int:
        return len(self.terms) + sum(len(t) for t, _ in self.waiting)


def skybands(rows: DataFrame, k: int) -> DataFrame:
    """lang, source, term, n, lang_n: of the rows of each task, those that fewer than k others of their group dominate."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("n", pa.int64()), ("lang_n", pa.int64())])

    def flush(held: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), band in held.items():
            band.merge()
            yield batch_of(schema, [lang] * len(band), [source] * len(band), band.terms, *band.counts)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], Skyband] = {}
        for batch in batches:
            group = {}
            for i, g in enumerate(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist())):
                group.setdefault(g, []).append(i)
            terms = batch.column("term").to_pylist()
            n, lang_n = batch.column("n").to_numpy(), batch.column("lang_n").to_numpy()
            for g, at in group.items():
                if g not in held:
                    held[g] = Skyband(k)
                held[g].add([terms[i] for i in at], n[at], lang_n[at])
            if sum(map(len, held.values())) > HELD_ROWS:
                yield from flush(held)
                held = {}
        yield from flush(held)

    return rows.select("lang", "source", "term", "n", "lang_n").mapInArrow(scan, "lang string, source string, term binary, n long, lang_n long")


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank."""
    kept = materialize(kept_terms(docs, min_docs), "kept-terms")
    facts = materialize(group_facts(kept), "group-facts")
    sums = materialize(pair_sums(kept, facts), "pair-sums")
    pairs = sums.select("lang", F.col("i").alias("source"), F.col("j").alias("item"), "value").unionByName(sums.select("lang", F.col("j").alias("source"), F.col("i").alias("item"), "value"))
    place = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(place).alias("rank"))
    local = skybands(kept.filter(F.col("n") > 0), top)
    merged = skybands(local.repartition("lang", "source"), top).join(facts, ["lang", "source"])
    p, q = frequency(F.col("n"), F.col("total"), F.col("terms")), frequency(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    terms = merged.select("lang", "source", F.col("term").cast("string").alias("item"), (p - q).alias("value")).filter("value > 0")
    terms = terms.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= top)
    return pairs.unionByName(terms.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))
