"""Comparing languages by tokens per unit: ratios, spread, gates, reconciliation of stored statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from granary.functions.text import Measures, classes, word_count
from granary.operators.bpe_codec import Batches, encode
from granary.operators.bpe_train import Vocabulary
from granary.operators.language import main_script, measured, script_sums
from granary.sources.tables import materialize

GATE, PENALTY_AT = 1.2, 1.2


def language_ratios(docs: DataFrame, v: Vocabulary, *keys: str) -> DataFrame:
    """lang (and keys), tokens, units, ratio."""
    rows = docs.select(*keys, "lang", "text")
    shared = docs.sparkSession.sparkContext.broadcast((v, classes(docs.sparkSession)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, measure = Batches(shared.value[0]), Measures(shared.value[1])
        for batch in batches:
            texts = batch.column("text").to_pylist()
            none, texts = np.array([t is None for t in texts], bool), [t or "" for t in texts]
            yield pa.record_batch([*batch.columns[:-1], pa.array(codec.token_counts(texts)), pa.array(measure(texts)[1], mask=none)], names=[*keys, "lang", "tokens", "units"])

    rows = rows.mapInArrow(scan, StructType([*rows.schema.fields[:-1], StructField("tokens", LongType()), StructField("units", LongType())]))
    rows = rows.groupBy(*keys, "lang").agg(F.sum("tokens").alias("tokens"), F.sum("units").alias("units"))
    return rows.withColumn("ratio", F.try_divide("tokens", "units"))


def source_records(docs: DataFrame) -> DataFrame:
    """lang, script (with most characters), sources, documents, bytes, words, units: what a ratio was measured on, one row a language."""
    sources = docs.groupBy(F.col("lang").alias("l")).agg(F.countDistinct("source").alias("sources"))
    rows = measured(docs.withColumn("bytes", F.octet_length("text").cast("long")), "lang", "bytes")
    found = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("documents"), *(F.sum(c).alias(c) for c in ("bytes", "words", "units")), *script_sums()).withColumn("script", main_script())
    found = found.join(sources, F.col("lang").eqNullSafe(F.col("l")))  # a document without lang has a record, too
    return found.select("lang", "script", "sources", "documents", "bytes", "words", "units")


def ratios_with_records(ratios: DataFrame, records: DataFrame) -> DataFrame:
    """The source record of each language with its tokens, ratio and rank (smallest ratio first). Both sides have one row a language."""
    found = ratios.select(F.col("lang").alias("l"), "tokens", "ratio")
    rank = F.row_number().over(Window.orderBy(F.col("ratio").asc_nulls_last(), "lang")).cast("long")
    return records.join(found, F.col("lang").eqNullSafe(F.col("l"))).drop("l").withColumn("rank", rank)


def corpus_spread(ratios: DataFrame) -> DataFrame:
    """corpus, lang, tokens, units, ratio, spread (largest less smallest ratio of the corpus), score (1000 / spread), languages. ratios: from language_ratios by corpus; languages without units have no part in a spread."""
    per = ratios.groupBy(F.col("corpus").alias("c")).agg((F.max("ratio") - F.min("ratio")).alias("spread"), F.count("ratio").alias("languages"))
    score = F.when(F.col("spread") == 0, F.lit(float("inf"))).otherwise(F.try_divide(F.lit(1000.0), F.col("spread")))
    return ratios.join(per, F.col("corpus") == F.col("c")).select("corpus", "lang", "tokens", "units", "ratio", "spread", score.alias("score"), "languages")


def fairness_score(ratios: DataFrame, penalty_lang: str, *keys: str) -> DataFrame:
    """(keys,) spread, score = 1000 / spread (infinite without spread), penalty, adjusted; ratios: (keys,) lang, ratio."""
    one = ratios.groupBy(*keys).agg((F.max("ratio") - F.min("ratio")).alias("spread"), F.max(F.when(F.col("lang") == penalty_lang, F.col("ratio"))).alias("p"))
    score = F.when(F.col("spread") == 0, F.lit(float("inf"))).otherwise(F.try_divide(F.lit(1000.0), F.col("spread")))
    penalty = F.exp(F.greatest(F.lit(0.0), F.coalesce(F.col("p"), F.lit(0.0)) / PENALTY_AT - 1))
    return one.select(*keys, "spread", score.alias("score"), penalty.alias("penalty"), (score / penalty).alias("adjusted"))


def ratio_gate(ratios: DataFrame, gate: float = GATE, *keys: str) -> DataFrame:
    """(keys,) lang, ratio, rank, pass: one row per language."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("ratio", "lang"))
    return ratios.select(*keys, "lang", "ratio", rank.cast("long").alias("rank"), (F.col("ratio") <= gate).alias("pass"))


def verify_stats(stored: DataFrame, found: DataFrame, fields: list[str]) -> DataFrame:
    """lang, field, stored, found for every mismatch."""
    tall = lambda df, name: df.select("lang", F.inline(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("double").alias(name)) for c in fields))))
    both = tall(stored, "stored").join(tall(found, "found"), ["lang", "field"], "full_outer")
    return both.filter(~F.col("stored").eqNullSafe(F.col("found")))


def fertility(docs: DataFrame, v: Vocabulary, base: str = "en") -> DataFrame:
    """lang, mean, p50, p95 tokens per word, bytes_per_token, relative to the base language, byte_share."""
    first = len(v.tokens) - 256
    rows = encode(docs, v).select("lang", F.size("ids").alias("tokens"), word_count(F.col("text")).alias("words"), F.octet_length("text").alias("bytes"), F.size(F.filter("ids", lambda i: i >= first)).alias("byte_tokens"))
    per = F.try_divide("tokens", "words")
    out = rows.groupBy("lang").agg(
        F.try_divide(F.sum("tokens"), F.sum("words")).alias("mean"), F.percentile_approx(per, 0.5).alias("p50"), F.percentile_approx(per, 0.95).alias("p95"),
        F.try_divide(F.sum("bytes"), F.sum("tokens")).alias("bytes_per_token"), F.try_divide(F.sum("byte_tokens"), F.sum("tokens")).alias("byte_share"),
    )
    out = materialize(out, "fertility")  # one row a language
    at = out.filter(F.col("lang") == base).select(F.col("mean").alias("base_mean"))
    return out.crossJoin(F.broadcast(at)).withColumn("relative", F.col("mean") / F.col("base_mean")).drop("base_mean")  # one row on the right


def gate(value: Column, op: str, threshold: Column) -> Column:
    return F.coalesce(F.when(F.lit(op) == "<=", value <= threshold).otherwise(value >= threshold), F.lit(False))


def fertility_gate(ratios: DataFrame, ceilings: dict[str, float], macro: float = 1.95, most: float = 3.0, fallback: float = 0.001) -> DataFrame:
    """scope, value, threshold, pass: each language under its ceiling, then the unweighted mean and the maximum, and the largest byte_share where ratios has one."""
    limit = F.coalesce(*(F.when(F.col("lang") == k, F.lit(c)) for k, c in ceilings.items()))
    each = ratios.filter(limit.isNotNull()).select(F.col("lang").alias("scope"), F.col("ratio").alias("value"), limit.alias("threshold"))
    whole = ratios.agg(F.avg("ratio").alias("a"), F.max("ratio").alias("m")).select(F.inline(F.array(
        F.struct(F.lit("macro").alias("scope"), F.col("a").alias("value"), F.lit(macro).alias("threshold")),
        F.struct(F.lit("maximum").alias("scope"), F.col("m").alias("value"), F.lit(most).alias("threshold")),
    )))
    if "byte_share" in ratios.columns:
        whole = whole.unionByName(ratios.agg(F.max("byte_share").alias("value")).select(F.lit("byte fallback").alias("scope"), "value", F.lit(fallback).alias("threshold")))
    return each.unionByName(whole).withColumn("pass", F.coalesce(F.col("value") <= F.col("threshold"), F.lit(False)))


def source_disjoint_split(docs: DataFrame, share: float, salt: str) -> DataFrame:
    """doc_id, source, split: whole sources go to eval or train."""
    from granary.functions.sampling import uniform

    return docs.select("doc_id", "source", F.when(uniform("source", salt) < share, "eval").otherwise("train").alias("split"))


JSON_ATOM = r'"(?:[^"\\]|\\.)*"|-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null|[\[\]{},:]'


def json_atoms(x: Column) -> Column:
    return F.regexp_count(x, F.lit(JSON_ATOM)).cast("long")
