"""Alignment data: conversations, mixes, preferences, rewards, judges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from granary.functions.sampling import uniform
from granary.operators.curate import words_of
from granary.operators.language import Profiles, text_languages
from granary.sources.tables import materialize


def assemble_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, turns, n_turns, n_tokens (words), content_sha, is_first (smallest conv_id of equal content)."""
    t = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(t)).alias("turns"))
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    rows = rows.select("conv_id", "turns", F.size("turns").cast("long").alias("n_turns"), F.aggregate("turns", F.lit(0), lambda a, x: a + F.size(words_of(x["text"]))).cast("long").alias("n_tokens"), F.sha2(said, 256).alias("content_sha"))
    first = rows.groupBy("content_sha").agg(F.min("conv_id").alias("first"))
    return rows.join(first, "content_sha").select("conv_id", "turns", "n_turns", "n_tokens", "content_sha", (F.col("conv_id") == F.col("first")).alias("is_first"))


def conversation_languages(turns: DataFrame, profiles: Profiles) -> DataFrame:
    """conv_id, lang: the language of all turns of a conversation as one text, by learned profiles; `other` where they give none."""
    texts = turns.groupBy("conv_id").agg(F.array_join(F.sort_array(F.collect_list(F.coalesce("text", F.lit("")))), " ").alias("text"))
    return text_languages(materialize(texts, "conversation-texts"), "conv_id", profiles)


def sft_mix(turns: DataFrame, langs: DataFrame, targets: dict[str, float]) -> DataFrame:
    """task, lang, n, share, target over conversations; task by number of turns. langs: conv_id, lang."""
    rows = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("k")).join(langs, "conv_id")
    rows = rows.select(F.when(F.col("k") <= 2, "single").when(F.col("k") <= 4, "short").otherwise("long").alias("task"), "lang")
    per = rows.groupBy("task", "lang").agg(F.count(F.lit(1)).alias("n"))
    target = F.coalesce(*(F.when(F.col("lang") == k, F.lit(v)) for k, v in targets.items()), F.lit(0.0))
    return per.crossJoin(F.broadcast(per.agg(F.sum("n").alias("all")))).select("task", "lang", "n", (F.col("n") / F.col("all")).alias("share"), target.alias("target"))


def sibling_pairs(turns: DataFrame, langs: DataFrame, cell: int = 1024) -> DataFrame:
    """pair_id, lang (of the first answer's conversation; langs: conv_id, lang), prompt, first, second: answers to one prompt, each with the next by conversation and turn; equal answers make no pair.

    The prompt is the text a user opens a conversation with; all answers of conversations that open alike are its siblings. Pairs grow with the answers, not with their square; the answers of a prompt
    that many conversations share are cut by a hash into cells of about `cell`, and only neighbours in a cell are paired.
    """
    order = F.struct("turn", "text")
    prompts = turns.filter("role = 'user' AND text IS NOT NULL").groupBy("conv_id").agg(F.min(order).alias("m")).select("conv_id", F.col("m.text").alias("prompt"))
    answers = turns.filter("role = 'assistant' AND text IS NOT NULL").select("conv_id", "turn", F.col("text").alias("first")).join(prompts, "conv_id")
    answers = materialize(answers.withColumn("key", F.sha2("prompt", 256)), "answers")
    counts = materialize(answers.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / cell).alias("cells")), "answers-by-prompt")
    rows = answers.join(counts, "key").withColumn("cell", F.floor(uniform("conv_id", "siblings") * F.col("cells")))
    following = F.lead("first").over(Window.partitionBy("key", "cell").orderBy("conv_id", "turn", "first"))
    pairs = rows.withColumn("second", following).filter("first <> second")
    name = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    return pairs.join(langs, "conv_id", "left").select(name.alias("pair_id"), F.coalesce("lang", F.lit("other")).alias("lang"), "prompt", "first", "second")


def outcomes(judgements: DataFrame, *keys: str) -> DataFrame:
    """keys, n_raters, win, tie, loss. judgements: keys, rater, outcome (win, tie, loss) of the first answer."""
    return judgements.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_raters"), *(F.count(F.when(F.col("outcome") == o, 1)).alias(o) for o in ("win", "tie", "loss")))


def preference_pairs(pairs: DataFrame, judgements: DataFrame) -> DataFrame:
    """pair_id, lang, prompt, chosen, rejected (texts), n_raters, majority, agreement (share of the majority); pairs whose majority is a tie make no preference. judgements: pair_id, rater, outcome."""
    top = F.greatest("win", "tie", "loss")
    major = F.when(F.col("win") == top, "win").when(F.col("loss") == top, "loss").otherwise("tie")
    per = outcomes(judgements, "pair_id").select("pair_id", "n_raters", major.alias("majority"), (top / F.col("n_raters")).alias("agreement")).filter("majority <> 'tie'")
    won = F.col("majority") == "win"
    rows = pairs.join(per, "pair_id")
    return rows.select("pair_id", "lang", "prompt", F.when(won, F.col("first")).otherwise(F.col("second")).alias("chosen"), F.when(won, F.col("second")).otherwise(F.col("first")).alias("rejected"), "n_raters", "majority", "agreement")


def rater_agreement(judgements: DataFrame) -> DataFrame:
    """lang, items, observed, expected, kappa: Fleiss' chance-corrected agreement over items that two raters or more judged; null where chance alone would always agree. judgements: pair_id, lang, rater, outcome."""
    rows = outcomes(judgements, "lang", "pair_id").filter("n_raters > 1")
    n, kinds = F.col("n_raters"), ("win", "tie", "loss")
    same = sum((F.col(k) * F.col(k) for k in kinds), F.lit(0)) - n
    per = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("items"), F.avg(same / (n * (n - 1))).alias("observed"), *((F.sum(k) / F.sum("n_raters")).alias(k) for k in kinds))
    expected = sum((F.col(k) * F.col(k) for k in kinds), F.lit(0.0))
    per = per.select("lang", "items", "observed", expected.alias("expected"))
    return per.withColumn("kappa", F.when(F.col("expected") < 1, (F.col("observed") - F.col("expected")) / (1 - F.col("expected"))))


def rollout_rewards(rollouts: DataFrame, learned_cap: float = 0.2) -> DataFrame:
    """episode_id, prompt_id, reward, terminated_at: weighted means over steps up to a critical one, which sets the reward to -1."""
    w = Window.partitionBy("episode_id").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    live = rollouts.withColumn("before", F.coalesce(F.max(F.col("critical").cast("int")).over(w), F.lit(0))).filter("before = 0")
    learned = F.least(F.col("learned"), F.lit(learned_cap))
    step = 0.55 * F.col("task") + 0.15 * F.col("schema_ok").cast("double") + 0.10 * F.col("grounding") + 0.10 * F.col("efficiency") + 0.10 * F.least(F.col("language"), learned * 5)
    per = live.groupBy("episode_id", "prompt_id").agg(F.avg(step).alias("mean"), F.max(F.col("critical")).alias("bad"), F.max("step").alias("last"))
    return per.select("episode_id", "prompt_id", F.when(F.col("bad"), -1.0).otherwise(F.col("mean")).alias("reward"), F.when(F.col("bad"), F.col("last")).alias("terminated_at"))


def judge_calibration(scores: DataFrame, bins: int = 10) -> DataFrame:
    """lang, n, auc, ece, kappa (quadratic), pass. scores: lang, score 0..1 in steps, label 0/1. Counted by (lang, score) before any window."""
    per = scores.groupBy("lang", "score").agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("q"))
    below = Window.partitionBy("lang").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("under", F.coalesce(F.sum("q").over(below), F.lit(0)))
    auc = per.groupBy("lang").agg(F.sum(F.col("p") * (F.col("under") + F.col("q") / 2)).alias("u"), F.sum("p").alias("np"), F.sum("q").alias("nq"))
    b = per.withColumn("bin", F.least(F.floor(F.col("score") * bins), F.lit(bins - 1))).groupBy("lang", "bin").agg(F.sum(F.col("p") + F.col("q")).alias("n"), F.sum("p").alias("pos"), F.sum(F.col("score") * (F.col("p") + F.col("q"))).alias("s"))
    ece = b.groupBy("lang").agg((F.sum(F.abs(F.col("pos") - F.col("s"))) / F.sum("n")).alias("ece"))
    # for two grades the quadratic weights are 0 and 1
    says = F.when(F.col("score") >= 0.5, F.lit(1)).otherwise(0)
    k = per.groupBy("lang").agg(F.sum(F.col("p") + F.col("q")).alias("n"), F.sum("p").alias("pos"), F.sum(says * (F.col("p") + F.col("q"))).alias("yes"), F.sum(says * F.col("q") + (1 - says) * F.col("p")).alias("off"))
    chance = (F.col("yes") * (F.col("n") - F.col("pos")) + (F.col("n") - F.col("yes")) * F.col("pos")) / F.col("n")
    k = k.select("lang", "n", F.when(chance == 0, F.lit(None)).otherwise(1 - F.col("off") / chance).alias("kappa"))
    rows = auc.select("lang", F.try_divide("u", F.col("np") * F.col("nq")).alias("auc")).join(ece, "lang").join(k, "lang")
    return rows.select("lang", "n", "auc", "ece", "kappa", F.coalesce((F.col("auc") >= 0.8) & (F.col("ece") <= 0.05) & (F.col("kappa") >= 0.65), F.lit(False)).alias("pass"))


def audit_sample(rollouts: DataFrame, share: float = 0.05, salt: str = "audit") -> DataFrame:
    return rollouts.select("episode_id").distinct().filter(uniform("episode_id", salt) < share)
