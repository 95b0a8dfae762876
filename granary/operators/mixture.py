"""Mixture: buckets, shares, exposure, sampling, budgets and caps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions.sampling import uniform
from granary.operators.curate import words_of

#: Buckets by priority: an earlier bucket takes what also matches a later one.
RULES = [("agent", r'"[a-z_]+"\s*:|token = "'), ("code", r"\b(def|class|return|import|SELECT)\b|[{};]\n"), ("stem", r"[0-9]+\.[0-9]+|[=+]\s*[0-9]")]


def exclusive_buckets(docs: DataFrame, base_lang: str = "en") -> DataFrame:
    """doc_id, bucket: each document in exactly one bucket; other languages before general text."""
    bucket = F.coalesce(*(F.when(F.col("text").rlike(p), F.lit(b)) for b, p in RULES), F.when(F.col("lang") != base_lang, F.lit("native")), F.lit("general"))
    return docs.select("doc_id", bucket.alias("bucket"))


def mixture_shares(buckets: DataFrame, tokens: DataFrame, targets: dict[str, float]) -> DataFrame:
    """bucket, tokens, share, target, delta; tokens: doc_id, tokens."""
    per = buckets.join(tokens, "doc_id").groupBy("bucket").agg(F.sum("tokens").alias("tokens"))
    total = per.agg(F.sum("tokens").alias("total"))
    target = F.coalesce(*(F.when(F.col("bucket") == k, F.lit(v)) for k, v in targets.items()), F.lit(0.0))
    rows = per.crossJoin(F.broadcast(total)).select("bucket", "tokens", (F.col("tokens") / F.col("total")).alias("share"), target.alias("target"))  # one row on the right
    return rows.withColumn("delta", F.col("share") - F.col("target"))


def exposure_plan(per: DataFrame, targets: dict[str, float], scheduled: float, max_passes: float = 4.0) -> DataFrame:
    """bucket, scheduled, available, passes, ok. per: bucket, tokens."""
    target = F.coalesce(*(F.when(F.col("bucket") == k, F.lit(v)) for k, v in targets.items()), F.lit(0.0))
    rows = per.select("bucket", (target * scheduled).alias("scheduled"), F.col("tokens").alias("available"))
    return rows.withColumn("passes", F.try_divide("scheduled", "available")).withColumn("ok", F.coalesce(F.col("passes") <= max_passes, F.lit(False)))


def exposure_decision(plan: DataFrame, required_share: float = 0.5) -> DataFrame:
    """scheduled, unique_equivalent, required, over_passes, go: one row over a plan.

    Unique-equivalent tokens are those a plan takes for the first time, the lesser of scheduled and available in each bucket; a plan goes ahead when they reach
    required_share of all scheduled tokens and no bucket is passed over too often. A plan without rows does not.
    """
    first = F.least("scheduled", F.col("available").cast("double"))
    one = plan.agg(F.sum("scheduled").alias("scheduled"), F.sum(first).alias("unique_equivalent"), F.count(F.when(~F.col("ok"), 1)).alias("over_passes"))
    one = one.select("scheduled", "unique_equivalent", (F.col("scheduled") * required_share).alias("required"), "over_passes")
    return one.withColumn("go", F.coalesce((F.col("unique_equivalent") >= F.col("required")) & (F.col("over_passes") == 0), F.lit(False)))


def sample_mixture(buckets: DataFrame, plan: DataFrame, salt: str) -> DataFrame:
    """doc_id, bucket, copy_no: floor(passes) copies, and one more where the document's uniform is under the fraction."""
    rows = buckets.join(plan.select("bucket", "passes"), "bucket")
    n = F.floor("passes") + F.when(uniform("doc_id", salt) < F.col("passes") - F.floor("passes"), 1).otherwise(0)
    return rows.withColumn("n", n.cast("int")).filter("n > 0").select("doc_id", "bucket", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy_no"))


def language_budget(per: DataFrame, budgets: dict[str, int]) -> DataFrame:
    """lang, available, budget, shortfall for every budgeted language, also those without text. per: lang, tokens."""
    plan = per.sparkSession.createDataFrame(list(budgets.items()), "lang string, budget long")
    rows = plan.join(per, "lang", "left").select("lang", F.coalesce("tokens", F.lit(0)).cast("long").alias("available"), "budget")
    return rows.withColumn("shortfall", F.greatest(F.lit(0), F.col("budget") - F.col("available")).cast("long"))


def composition_caps(rows: DataFrame) -> DataFrame:
    """metric, value, limit, pass. rows: origin, official, tokens."""
    share = lambda c: F.try_divide(F.sum(F.when(c, F.col("tokens")).otherwise(0)), F.sum("tokens"))
    one = rows.agg(share(F.col("origin") == "native").alias("native"), share(F.col("origin") == "translated").alias("translated"), share(F.col("origin") == "synthetic").alias("synthetic"), share(F.col("official")).alias("official"))
    limits = [("native", 0.55, True), ("translated", 0.30, False), ("synthetic", 0.15, False), ("official", 0.25, False)]
    tall = F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), F.lit(x).alias("limit"), F.coalesce(F.col(m) >= x if floor else F.col(m) <= x, F.lit(False)).alias("pass")) for m, x, floor in limits)))
    return one.select(tall)


def region_floor(rows: DataFrame, regions: DataFrame, floor: float = 0.0025) -> DataFrame:
    """region, tokens, share, pass for every listed region, also those without rows. rows: region, tokens."""
    per = rows.groupBy("region").agg(F.sum("tokens").alias("tokens"))
    total = rows.agg(F.sum("tokens").alias("total"))
    out = regions.join(per, "region", "left").crossJoin(F.broadcast(total))
    out = out.select("region", F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"), F.coalesce(F.try_divide(F.coalesce("tokens", F.lit(0)), "total"), F.lit(0.0)).alias("share"))
    return out.withColumn("pass", F.col("share") >= floor)


def word_tokens(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.size(words_of(F.col("text"))).cast("long").alias("tokens"))
