"""Curation: rights, language and quality, duplicates, privacy, decontamination, caps, records."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType
from pyspark.sql.window import Window

from granary.functions.sampling import uniform
from granary.operators.grams import hits, item_grams, window_hashes
from granary.operators.language import SCRIPTS
from granary.sources.tables import materialize

WORD = r"[^\x20\x09-\x0D]+"

LEXICON = {"en": ["the", "of", "and", "that"], "fr": ["le", "et", "des", "une"], "de": ["der", "die", "und", "von"], "es": ["el", "los", "las", "por"]}


def words_of(x: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit(WORD), 0)


def among(values: list[str]):
    return lambda x: x.isin(values)


def quality_signals(docs: DataFrame) -> DataFrame:
    """doc_id, lang, n_words and shares: symbols and upper case of characters, function words of words, duplicate and bullet lines of lines."""
    w, lines = F.col("w"), F.split("text", "\n")
    stop = F.coalesce(*(F.when(F.col("lang") == k, F.size(F.filter(w, among(ws)))) for k, ws in LEXICON.items()), F.lit(0))
    share = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    rows = docs.withColumn("w", words_of(F.col("text"))).withColumn("l", lines)
    n = F.length("text")
    return rows.select(
        "doc_id", "lang", F.size("w").cast("long").alias("n_words"), share(F.regexp_count("text", F.lit("[#*$%&|<>]")), n).alias("symbol_ratio"), share(stop, F.size("w")).alias("stopword_share"),
        share(F.regexp_count("text", F.lit(r"\p{Lu}")), n).alias("upper_share"), share(F.size("l") - F.size(F.array_distinct("l")), F.size("l")).alias("dup_line_share"),
        share(F.size(F.filter("l", lambda x: x.rlike(r"^[-*|]| \| "))), F.size("l")).alias("bullet_share"),
    )


def score(signals: DataFrame) -> DataFrame:
    """doc_id, lang, score: 0..100, whole."""
    bad = 4 * F.col("symbol_ratio") + F.col("dup_line_share") + F.col("bullet_share")
    return signals.select("doc_id", "lang", F.floor(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(0.5) + F.col("stopword_share") - bad / 2)) * 100 + 1e-9).cast("long").alias("score"))


def quality_filter(scores: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, lang, score, cutoff, kept: per language the cut-off with most agreement (kept and good, or dropped and bad), the smallest among equals."""
    seen = scores.join(labels.filter(F.col("quality").isNotNull()).select("doc_id", "quality"), "doc_id")
    per = seen.groupBy("lang", "score").agg(F.sum("quality").alias("good"), F.sum(1 - F.col("quality")).alias("bad"))  # at most 101 rows a language
    below = Window.partitionBy("lang").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    up = Window.partitionBy("lang").orderBy("score").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    agree = F.coalesce(F.sum("bad").over(below), F.lit(0)) + F.sum("good").over(up)
    cuts = per.select("lang", "score", agree.alias("agree")).groupBy("lang").agg(F.max(F.struct("agree", (-F.col("score")).alias("s"))).alias("m"))
    cuts = cuts.select("lang", (-F.col("m.s")).alias("cutoff"))
    return scores.join(cuts, "lang", "left").select("doc_id", "lang", "score", "cutoff", (F.col("score") >= F.coalesce("cutoff", F.lit(0))).alias("kept"))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, sha256, keep_id (smallest), cluster_size, kept."""
    rows = materialize(docs.select("doc_id", F.sha2("text", 256).alias("sha256")), "digests")  # null texts have a null digest and are one cluster
    groups = rows.groupBy(F.col("sha256").alias("digest")).agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("cluster_size"))
    # a table of its own, so that the planner can split the rows of a large cluster in the join
    both = rows.join(materialize(groups, "clusters"), F.col("sha256").eqNullSafe(F.col("digest")))
    return both.select("doc_id", "sha256", "keep_id", "cluster_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"))


def repeated_spans(docs: DataFrame, min_docs: int = 2, n: int = 10) -> DataFrame:
    """doc_id, n_lines, n_repeated_lines (lines in min_docs documents or twice in one), n_repeated_words (words inside n-word windows that occur twice or more, in one text or in
    several, the first included; overlaps count once) and repeated_word_share of all words.

    Windows are counted over the corpus by a 64-bit hash.
    """
    lines = docs.select("doc_id", F.explode(F.split("text", "\n")).alias("l")).filter(F.col("l") != "").groupBy("doc_id", F.xxhash64("l").alias("h")).agg(F.count(F.lit(1)).alias("k"))
    lines = materialize(lines, "lines")
    often = lines.groupBy("h").agg(F.count(F.lit(1)).alias("docs"), F.max("k").alias("most")).filter((F.col("docs") >= min_docs) | (F.col("most") > 1))
    often = materialize(often.select("h", "docs"), "repeated-lines")  # a table, so that the planner can split a line that many documents have
    marked = lines.join(often, "h", "left")
    per = marked.groupBy("doc_id").agg(F.sum("k").alias("n_lines"), F.sum(F.when((F.col("docs") >= min_docs) | (F.col("k") > 1), F.col("k")).otherwise(0)).alias("n_repeated_lines"))
    windows = materialize(window_hashes(docs, n), "windows")
    twice = materialize(windows.groupBy("h").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("h"), "repeated-windows")
    # intervals of n words, joined up: each counts as far as the next one in its text begins
    following = F.lead("place").over(Window.partitionBy("doc_id").orderBy("place")) - F.col("place")
    covered = windows.join(twice, "h", "left_semi").select("doc_id", F.least(F.coalesce(following, F.lit(n)), F.lit(n)).alias("k"))
    covered = covered.groupBy("doc_id").agg(F.sum("k").alias("n_repeated_words"))
    words = docs.select("doc_id", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).alias("n_words"))
    some = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    rows = words.join(per, "doc_id", "left").join(covered, "doc_id", "left")
    share = F.round(F.coalesce(F.try_divide("n_repeated_words", "n_words"), F.lit(0.0)), 6)
    return rows.select("doc_id", some("n_lines"), some("n_repeated_lines"), some("n_repeated_words"), share.alias("repeated_word_share"))


def shingles(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, s: sorted distinct hashes of word shingles; a shorter text is one shingle, an empty one none."""
    rows = docs.select("doc_id", words_of(F.col("text")).alias("w"))
    many = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - (size - 1), F.lit(1))), lambda i: F.xxhash64(F.slice("w", i, size)))
    return rows.filter(F.size("w") > 0).select("doc_id", F.sort_array(F.array_distinct(many)).alias("s"))


def minhash_bands(rows: DataFrame, bands: int, per_band: int) -> DataFrame:
    """rows (doc_id, s) plus b: one hash for each band."""
    a = np.random.default_rng(17).integers(1, 2**62, bands * per_band, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    @F.pandas_udf(ArrayType(LongType()))
    def band_hashes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            out = []
            for s in x:
                h = np.asarray(s, np.int64).view(np.uint64)[:, None] * a
                h ^= h >> np.uint64(29)
                least = (h * np.uint64(0xBF58476D1CE4E5B9)).min(axis=0).reshape(bands, per_band)
                mixed = np.zeros(bands, np.uint64)
                for c in least.T:
                    mixed = (mixed ^ c) * np.uint64(0x9E3779B97F4A7C15)
                out.append(mixed.view(np.int64).tolist())
            yield pd.Series(out)

    return rows.withColumn("b", band_hashes("s"))


def minhash_pairs(docs: DataFrame, size: int = 5, bands: int = 32, per_band: int = 4, t: float = 0.8) -> DataFrame:
    """id_a, id_b, jaccard between representatives (smallest id) of classes with equal shingle sets; exact_shingle_classes gives the members."""
    rows = shingle_table(docs, size)
    reps = materialize(rows.groupBy("h", "d").agg(F.min_by("s", "doc_id").alias("s"), F.min("doc_id").alias("doc_id")).select("s", "doc_id"), "reps")
    keyed = minhash_bands(reps, bands, per_band).select("doc_id", F.size("s").alias("n"), F.posexplode("b").alias("band", "h"))
    other = keyed.select(F.col("doc_id").alias("id_b"), F.col("n").alias("n_b"), "band", "h")
    near = keyed.join(other, ["band", "h"]).filter((F.col("doc_id") < F.col("id_b")) & (F.least("n", "n_b") >= t * F.greatest("n", "n_b")))
    pairs = near.select(F.col("doc_id").alias("id_a"), "id_b").distinct()
    a, b = reps.toDF("s_a", "id_a"), reps.toDF("s_b", "id_b")
    both = pairs.join(a, "id_a").join(b, "id_b").withColumn("i", F.size(F.array_intersect("s_a", "s_b")))
    return both.withColumn("jaccard", F.col("i") / (F.size("s_a") + F.size("s_b") - F.col("i"))).filter(F.col("jaccard") >= t).select("id_a", "id_b", "jaccard")


def shingle_table(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, s as from shingles, and two digests of s (h, d), as a table: a join on digests that are still expressions would split the text anew in each of them."""
    digest = F.sha2(F.array_join(F.transform("s", lambda x: x.cast("string")), ","), 256)
    return materialize(shingles(docs, size).select("doc_id", "s", F.xxhash64("s").alias("h"), digest.alias("d")), "shingles")


def shingle_classes(docs: DataFrame, size: int = 5) -> DataFrame:
    """doc_id, class_id: smallest doc_id with the same shingle set (itself for empty texts)."""
    rows = shingle_table(docs, size).select("doc_id", "h", "d")
    classes = materialize(rows.groupBy("h", "d").agg(F.min("doc_id").alias("class_id")), "shingle-classes")
    named = rows.join(classes, ["h", "d"]).select("doc_id", "class_id")
    return docs.select("doc_id").join(named, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))


def connected(edges: DataFrame) -> DataFrame:
    """id, label (smallest id reachable) for edges (a, b): minimum labels with pointer jumping, a table each round."""
    both = materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("m"))
        least = materialize(labels.join(near, "id").select("id", F.col("label").alias("old"), F.least("label", "m").alias("label")), "labels")
        up = least.select(F.col("id").alias("label"), F.col("label").alias("up"))
        new = materialize(least.join(up, "label", "left").select("id", "old", F.coalesce("up", "label").alias("label")), "labels")
        labels = new.select("id", "label")
        if new.filter("old <> label").isEmpty():
            return labels


def dedup_clusters(docs: DataFrame, pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """doc_id, cluster_id (smallest doc_id), cluster_size, kept."""
    labels = connected(pairs.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")))
    rows = classes.join(labels.withColumnRenamed("id", "class_id"), "class_id", "left").select("doc_id", F.coalesce("label", "class_id").alias("cluster_id"))
    rows = materialize(rows, "clustered")
    sizes = materialize(rows.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("cluster_size")), "cluster-sizes")
    return rows.join(sizes, "cluster_id").select("doc_id", "cluster_id", "cluster_size", (F.col("doc_id") == F.col("cluster_id")).alias("kept"))


# Identifiers and credentials.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
CARD = r"\b(?:[0-9]{13,19}|[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}(?:[ -][0-9]{3})?|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})\b"
AADHAAR, PAN = r"\b[2-9][0-9]{3}[ -]?[0-9]{4}[ -]?[0-9]{4}\b", r"\b[A-Z]{5}[0-9]{4}[A-Z]\b"
PHONE = r"\+[0-9]{1,3}[ -]?(?:\([0-9]{1,4}\)[ -]?)?[0-9]{2,5}(?:[ -]?[0-9]{2,5}){1,3}\b|\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}\b|\b[0-9]{3}-[0-9]{3}-[0-9]{4}\b|\b[6-9][0-9]{4}[ -][0-9]{5}\b"
IP = r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b"
SECRET = r'(?:token|secret|api_key|password) = "[0-9A-Za-z_\-]{16,}"|AKIA[0-9A-Z]{16}|-----BEGIN [A-Z ]*PRIVATE KEY-----'
VERHOEFF_MUL = ["0123456789", "1234067895", "2340178956", "3401289567", "4012395678", "5987604321", "6598710432", "7659821043", "8765932104", "9876543210"]
VERHOEFF_PERM = ["0123456789", "1576283094", "5803796142", "8916043527", "9453126870", "4286573901", "2793806415", "7046913258"]


def digits_from_right(x: Column) -> Column:
    """The digits of a string with separators, last first."""
    d = F.reverse(F.regexp_replace(x, "[^0-9]", ""))
    return F.transform(F.sequence(F.lit(1), F.length(d)), lambda i: F.substr(d, i, F.lit(1)).cast("int"))


def luhn_ok(x: Column) -> Column:
    """Whether the digits of a string, at least one, satisfy the Luhn check."""
    parts = F.transform(digits_from_right(x), lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d))
    return F.aggregate(parts, F.lit(0), lambda a, d: a + d) % 10 == 0


def verhoeff_ok(x: Column) -> Column:
    """Whether the digits of a string, at least one, satisfy the Verhoeff check."""
    mul, perm = F.lit("".join(VERHOEFF_MUL)), F.lit("".join(VERHOEFF_PERM))
    moved = F.transform(digits_from_right(x), lambda d, i: F.substr(perm, 10 * (i % 8) + d + 1, F.lit(1)).cast("int"))
    return F.aggregate(moved, F.lit(0), lambda c, p: F.substr(mul, c * 10 + p + 1, F.lit(1)).cast("int")) == 0


def masked(name: str):
    return lambda t, x: F.regexp_replace(t, F.concat(F.lit(r"\b"), x, F.lit(r"\b")), F.lit(f"[{name}]"))


def pii_redact(docs: DataFrame) -> DataFrame:
    """doc_id, text_redacted and counts. Card and identity numbers, in one run or in groups, only where their check digit holds; they go first, the rest is sought in what is left."""
    numbers = lambda p, ok: F.filter(F.regexp_extract_all("text", F.lit(p), 0), ok)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("cards", numbers(CARD, luhn_ok))
    rows = rows.withColumn("text", F.aggregate(F.array_distinct("cards"), F.col("text"), masked("BANK"))).withColumn("aadhaars", numbers(AADHAAR, verhoeff_ok))
    rows = rows.withColumn("text", F.aggregate(F.array_distinct("aadhaars"), F.col("text"), masked("AADHAAR")))
    out = F.col("text")
    for p, name in ((EMAIL, "EMAIL"), (PHONE, "PHONE"), (IP, "IP"), (PAN, "PAN")):
        out = F.regexp_replace(out, p, f"[{name}]")
    count = lambda p: F.regexp_count("text", F.lit(p)).cast("long")
    size = lambda c: F.size(c).cast("long")
    return rows.select("doc_id", out.alias("text_redacted"), size("aadhaars").alias("n_aadhaar"), count(PAN).alias("n_pan"), size("cards").alias("n_bank"), count(PHONE).alias("n_phone"), count(EMAIL).alias("n_email"), count(IP).alias("n_ip"))


def secret_scan(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.regexp_replace("text", SECRET, "[SECRET]").alias("text_clean"), F.regexp_count("text", F.lit(SECRET)).cast("long").alias("n_secrets"))


def removal_audit(removed: DataFrame, labels: DataFrame, docs: DataFrame) -> DataFrame:
    """lang, source (null for all), n, n_removed, n_false_positive, fp_rate, fp_ratio_to_all. removed: doc_id, removed."""
    rows = docs.select("doc_id", "lang", "source").join(removed, "doc_id").join(labels.dropDuplicates(["doc_id"]), "doc_id", "left")
    fp = F.col("removed") & (F.col("quality") == 1) & (F.col("toxic") == 0)
    out = rows.rollup("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("removed"), 1)).alias("n_removed"), F.count(F.when(fp, 1)).alias("n_false_positive"), F.grouping_id().alias("level"))
    out = out.withColumn("fp_rate", F.col("n_false_positive") / F.col("n"))
    whole = out.filter("level = 3").select(F.col("fp_rate").alias("all_rate"))
    return out.crossJoin(F.broadcast(whole)).select("lang", "source", "n", "n_removed", "n_false_positive", F.round("fp_rate", 9).alias("fp_rate"), F.round(F.try_divide("fp_rate", "all_rate"), 6).alias("fp_ratio_to_all"))


def decontaminate_ngram(docs: DataFrame, bench: DataFrame, n: int = 13) -> DataFrame:
    """doc_id, item_id, n_shared: different n-word windows that both have; items with fewer words match as a whole."""
    patterns = item_grams(bench, n)
    grams = materialize(patterns.select("item_id", "gram").distinct(), "patterns")
    found = hits(docs, patterns).select("doc_id", "gram").distinct()
    return found.join(grams, "gram").groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("n_shared"))


def decontaminate_exact(docs: DataFrame, bench: DataFrame, anchor: int = 5) -> DataFrame:
    """doc_id, item_id: documents that hold a whole item (words compared, case ignored).

    An item is laid out in pieces of `anchor` words, the last one flush with its end; a document holds it where all its pieces follow each other at the right distances.
    """
    pieces = item_grams(bench, anchor).filter((F.col("place") % anchor == 0) | (F.col("place") == F.col("n_words") - F.col("size")))
    pieces = materialize(pieces.select("item_id", "size", "h", F.col("place").alias("offset"), "gram", F.count(F.lit(1)).over(Window.partitionBy("item_id")).alias("n")), "pieces")
    found = hits(docs, pieces).join(pieces.select("item_id", "offset", "gram", "n"), "gram")
    met = found.groupBy("doc_id", "item_id", "n", (F.col("place") - F.col("offset")).alias("start")).agg(F.count(F.lit(1)).alias("k"))
    return met.filter("k = n").select("doc_id", "item_id").distinct()


def decontaminate_minhash(docs: DataFrame, bench: DataFrame, size: int = 5, t: float = 0.8) -> DataFrame:
    """doc_id, item_id, containment: the largest share, t or more, of an item's different word shingles that one window of the document has. A window has 1 / t times the words
    of the item, rounded up, so items whose parts are spread over a long text are no match. Exact: items' shingles are the index.
    """
    patterns = item_grams(bench, size)
    items = patterns.select("item_id", "gram", "size", F.ceil(F.col("n_words") / F.lit(t)).cast("int").alias("width"))
    items = items.distinct().withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("item_id")))
    items = materialize(items, "item-shingles")
    found = hits(docs, patterns).join(items, "gram")
    # pairs that have enough in the whole text, then their windows
    pairs = found.groupBy("doc_id", "item_id", "n").agg(F.countDistinct("gram").alias("k")).filter(F.col("k") >= F.col("n") * t).select("doc_id", "item_id")
    there = found.join(materialize(pairs, "pairs"), ["doc_id", "item_id"], "left_semi")
    places = F.sort_array(F.collect_list(F.struct("place", "gram")))  # of one text
    there = there.groupBy("doc_id", "item_id", "n", (F.col("width") - F.col("size")).alias("reach")).agg(places.alias("places"))
    best = there.select("doc_id", "item_id", "n", best_window("places", "reach").alias("k")).filter(F.col("k") >= F.col("n") * t)
    return best.select("doc_id", "item_id", F.round(F.col("k") / F.col("n"), 6).alias("containment"))


@F.pandas_udf(IntegerType())
def best_window(places: pd.Series, reach: pd.Series) -> pd.Series:
    """Most different grams at places at most reach apart."""
    out = []
    for hits_, far in zip(places, reach):
        inside, last, best = Counter(), 0, 0
        for h in hits_:
            inside[h["gram"]] += 1
            while h["place"] - hits_[last]["place"] > far:
                gone = hits_[last]["gram"]
                inside[gone] -= 1
                if not inside[gone]:
                    del inside[gone]
                last += 1
            best = max(best, len(inside))
        out.append(best)
    return pd.Series(out, dtype="int32")


def synthetic_cap(docs: DataFrame, cap: float = 0.12, cells: int = 4096, salt: str = "cap") -> DataFrame:
    """doc_id, kept: synthetic documents stay in hash order while their tokens are at most cap of all tokens kept. docs: doc_id, origin (null: not synthetic), tokens.

    Tokens are summed by hash cell; only the cell in which the allowance ends is ordered by row.
    """
    rows = docs.withColumn("u", uniform("doc_id", salt)).withColumn("cell", F.floor(F.col("u") * cells))
    base = rows.agg(F.coalesce(F.sum(F.when(~F.col("origin").eqNullSafe("synthetic"), F.col("tokens"))), F.lit(0)).alias("b")).first().b
    allowed = base * cap / (1 - cap)
    made = rows.filter("origin = 'synthetic'")
    so_far = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    per = made.groupBy("cell").agg(F.sum("tokens").alias("t")).withColumn("before", F.coalesce(F.sum("t").over(so_far), F.lit(0)))  # at most `cells` rows
    in_cell = F.sum("tokens").over(Window.partitionBy("cell").orderBy("u", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    state = F.when(F.col("before") + F.col("t") <= allowed, 1).when(F.col("before") > allowed, -1).otherwise(0)
    cut = made.join(per.select("cell", "before", state.alias("state")), "cell")
    edge = cut.filter("state = 0").withColumn("kept", F.col("before") + in_cell <= allowed)
    return rows.filter(~F.col("origin").eqNullSafe("synthetic")).select("doc_id", F.lit(True).alias("kept")).unionByName(edge.select("doc_id", "kept")).unionByName(cut.filter("state <> 0").select("doc_id", (F.col("state") > 0).alias("kept")))


def data_card(docs: DataFrame, log: DataFrame) -> DataFrame:
    """lang, source, stage, action, reason, n_docs, n_bytes, n_words: what each stage removed or changed, and what no stage removed (stage kept). log: doc_id, stage, action, reason."""
    rows = docs.select("doc_id", "lang", "source", F.octet_length("text").alias("b"), F.size(words_of(F.col("text"))).alias("w"))
    kept = survivors(rows, log).select("lang", "source", F.lit("kept").alias("stage"), F.lit("kept").alias("action"), F.lit("").alias("reason"), "b", "w")
    seen = rows.join(log.select("doc_id", "stage", "action", "reason"), "doc_id").select("lang", "source", "stage", "action", "reason", "b", "w")
    return kept.unionByName(seen).groupBy("lang", "source", "stage", "action", "reason").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("b").cast("long").alias("n_bytes"), F.sum("w").cast("long").alias("n_words"))


def removals(log: DataFrame) -> DataFrame:
    """doc_id, stage, reason, version, removed_at: every removal on record."""
    return log.filter("action = 'removed'").select("doc_id", "stage", "reason", "version", F.col("at").alias("removed_at"))


def survivors(docs: DataFrame, log: DataFrame) -> DataFrame:
    """docs that no stage removed."""
    return docs.join(log.filter("action = 'removed'").select("doc_id").distinct(), "doc_id", "left_anti")


def ledger(docs: DataFrame, labels: DataFrame, rights: DataFrame, origin: DataFrame, log: DataFrame) -> DataFrame:
    """doc_id, source, rights, sha256, lang, script (most letters), transformations (stages on record, in the order of their commits), changed_at (the last), quality, region, origin, opt_out_id,
    status (the first removal)."""
    counts = F.array(*(F.regexp_count("text", F.lit(rf"\p{{Is{s}}}")) for s in SCRIPTS))
    most = F.array_max("by")
    script = F.when(most > 0, F.element_at(F.array(*map(F.lit, SCRIPTS)), F.array_position("by", most).cast("int"))).otherwise("none")
    q = labels.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    # one entry a stage and run for each document
    steps = F.sort_array(F.collect_list(F.struct("version", "stage", "action", "at")))
    done = log.groupBy("doc_id").agg(steps.alias("steps"))
    rows = docs.withColumn("by", counts).join(rights.select("doc_id", "licence"), "doc_id", "left").join(q, "doc_id", "left").join(origin, "doc_id", "left").join(done, "doc_id", "left")
    steps = F.coalesce("steps", F.array().cast(done.schema["steps"].dataType))
    removed = F.try_element_at(F.filter(steps, lambda s: s["action"] == "removed"), F.lit(1))
    return rows.select(
        "doc_id", "source", F.col("licence").alias("rights"), F.sha2("text", 256).alias("sha256"), "lang", script.alias("script"), F.transform(steps, lambda s: s["stage"]).alias("transformations"),
        F.array_max(F.transform(steps, lambda s: s["at"])).alias("changed_at"), F.col("quality").cast("long").alias("quality"), F.col("source").alias("region"), "origin",
        F.when(F.exists(steps, lambda s: s["stage"] == "opt_out"), F.col("doc_id")).alias("opt_out_id"), F.coalesce(F.concat(F.lit("removed:"), removed["stage"]), F.lit("kept")).alias("status"),
    )
