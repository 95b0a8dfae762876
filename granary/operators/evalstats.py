"""Evaluation statistics and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions.sampling import uniform
from granary.operators.curate import words_of

# Cumulative probabilities of a Poisson count with mean 1.
POISSON = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119]


def macro_worst_gap(results: DataFrame, max_gap: float) -> DataFrame:
    """metric, macro, worst_lang, worst, gap, pass. results: metric, lang, seed, value."""
    per = results.groupBy("metric", "lang").agg(F.avg("value").alias("v"))
    rows = per.groupBy("metric").agg(F.avg("v").alias("macro"), F.min(F.struct("v", "lang")).alias("w"), (F.max("v") - F.min("v")).alias("gap"))
    return rows.select("metric", "macro", F.col("w.lang").alias("worst_lang"), F.col("w.v").alias("worst"), "gap", (F.col("gap") <= max_gap).alias("pass"))


def bootstrap_ci(results: DataFrame, rounds: int = 200, salt: str = "boot") -> DataFrame:
    """group, mean, lo, hi (95 %): each item counts a Poisson(1) number of times a round, from a hash of item and round. results: group, item, value."""
    rows = results.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(rounds))))
    u = uniform(F.concat_ws(":", F.col("item").cast("string"), F.col("b").cast("string")), salt)
    weight = sum((F.when(u >= c, 1).otherwise(0) for c in POISSON), F.lit(0))
    per = rows.withColumn("w", weight).groupBy("group", "b").agg(F.try_divide(F.sum(F.col("w") * F.col("value")), F.sum("w")).alias("m"))
    ci = per.groupBy("group").agg(F.percentile("m", 0.025).alias("lo"), F.percentile("m", 0.975).alias("hi"))
    return results.groupBy("group").agg(F.avg("value").alias("mean")).join(ci, "group").select("group", "mean", "lo", "hi")


def noninferiority(ci: DataFrame, baseline: DataFrame, margin: float = 2.0) -> DataFrame:
    """group, lo, gate, pass: the lower bound, in points, against baseline - margin. baseline: group, base."""
    rows = ci.join(baseline, "group", "left").select("group", (F.col("lo") * 100).alias("lo"), (F.col("base") - margin).alias("gate"))
    return rows.withColumn("pass", F.coalesce(F.col("lo") >= F.col("gate"), F.lit(False)))


def eval_split(items: DataFrame, salt: str, quarters: int = 4, hidden: float = 0.2, refreshed: float = 0.3) -> DataFrame:
    """item_id, split, refresh_quarter (first quarter, of `quarters`, in which the item is replaced; null if never)."""
    refresh = F.coalesce(*(F.when(uniform("item_id", f"{salt}-q{q}") < refreshed, F.lit(q)) for q in range(1, quarters + 1)))
    return items.select("item_id", F.when(uniform("item_id", salt) < hidden, "hidden").otherwise("public").alias("split"), refresh.alias("refresh_quarter"))


def after_cutoff(events: DataFrame, cutoff: str) -> DataFrame:
    return events.filter(F.col("ts") > F.lit(cutoff).cast("timestamp"))


def canary_scan(docs: DataFrame, canaries: DataFrame) -> DataFrame:
    """doc_id, canary_id: found by the canary's longest word, verified on the text."""
    word = F.array_max(F.transform(words_of(F.col("text")), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    keys = canaries.select("canary_id", F.col("text").alias("canary"), word.alias("w"))
    rows = docs.select("doc_id", F.explode(F.array_distinct(words_of(F.col("text")))).alias("w"))
    hits = rows.join(keys, "w").select("doc_id", "canary_id", "canary")
    return hits.join(docs.select("doc_id", "text"), "doc_id").filter(F.contains("text", "canary")).select("doc_id", "canary_id").distinct()


def preference_winrate(judgements: DataFrame, z: float = 1.96) -> DataFrame:
    """lang, n, win_rate = (wins + ties / 2) / n, lo (Wilson), pass. judgements: lang, outcome."""
    per = judgements.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("outcome") == "win", 1.0).when(F.col("outcome") == "tie", 0.5).otherwise(0.0)).alias("s"))
    p, n = F.col("s") / F.col("n"), F.col("n")
    lo = (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    return per.select("lang", "n", p.alias("win_rate"), lo.alias("lo")).withColumn("pass", F.col("lo") > 0.5)


def launch_gates(metrics: DataFrame, gates: DataFrame) -> DataFrame:
    """metric, scope, value, op, threshold, pass, and one row `overall`; a gate without a metric fails."""
    rows = gates.join(metrics, ["metric", "scope"], "left")
    ok = F.when(F.col("op") == ">=", F.col("value") >= F.col("threshold")).when(F.col("op") == "<=", F.col("value") <= F.col("threshold")).when(F.col("op") == ">", F.col("value") > F.col("threshold"))
    rows = rows.select("metric", "scope", "value", "op", "threshold", F.coalesce(ok, F.lit(False)).alias("pass"))
    whole = rows.agg(F.every("pass").alias("pass")).select(F.lit("overall").alias("metric"), F.lit("all").alias("scope"), F.lit(None).cast("double").alias("value"), F.lit("").alias("op"), F.lit(None).cast("double").alias("threshold"), "pass")
    return rows.unionByName(whole)


def next_token_pairs(docs: DataFrame) -> DataFrame:
    """left, right, n, p: neighbouring words within a sentence and the conditional probability of the right one."""
    s = docs.select(F.explode(F.split("text", r"[.!?\n]+")).alias("s")).select(words_of(F.col("s")).alias("w")).filter(F.size("w") > 1)
    pairs = F.arrays_zip(F.expr("slice(w, 1, size(w) - 1)").alias("left"), F.expr("slice(w, 2, size(w) - 1)").alias("right"))
    n = s.select(F.inline(pairs)).toDF("left", "right").groupBy("left", "right").agg(F.count(F.lit(1)).alias("n"))
    total = n.groupBy("left").agg(F.sum("n").alias("t"))
    return n.join(total, "left").select("left", "right", "n", (F.col("n") / F.col("t")).alias("p"))


def cross_entropy(pairs: DataFrame) -> DataFrame:
    """pairs, cross_entropy: mean -ln p of the count model on its own pairs."""
    return pairs.agg(F.sum("n").alias("pairs"), (F.sum(-F.col("n") * F.log("p")) / F.sum("n")).alias("cross_entropy"))
