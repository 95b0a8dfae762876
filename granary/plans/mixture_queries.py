"""Registered queries: mixture, alignment data, evaluation statistics, re-aimed models. Fixtures are derived from the tables by hashes."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.functions.sampling import uniform, uniform_sql
from granary.operators import align as A
from granary.operators import evalstats as E
from granary.operators import mixture as M
from granary.operators import vectors as V
from granary.operators.curate import quality_signals
from granary.plans.curation_queries import ORIGINS, SIGNALS_CTE, WORDS, docs_of, language_ctes, origins, profiles
from granary.sources.tables import materialize, table

TARGETS = {"agent": 0.1, "code": 0.1, "stem": 0.2, "native": 0.3, "general": 0.3}
BUDGETS = {"en": 400_000, "fr": 21_000, "de": 90_000, "es": 21_000, "hi": 21_000}
SFT = {"en": 0.35, "fr": 0.25, "de": 0.2, "es": 0.2}
_case = lambda m, key, other: f"CASE {key} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in m.items()) + f" ELSE {other} END"


def r9(df, *columns):
    return df.withColumns({c: F.round(c, 9) for c in columns})


BUCKETS_CTE = f"bk AS (SELECT doc_id, CASE {' '.join(f'''WHEN regexp_matches(text, '{p}') THEN '{b}' ''' for b, p in M.RULES)} WHEN lang <> 'en' THEN 'native' ELSE 'general' END AS bucket, len({WORDS}) AS tokens FROM documents)"
SHARES_CTE = f"{BUCKETS_CTE}, sh AS (SELECT bucket, sum(tokens)::BIGINT AS tokens FROM bk GROUP BY 1)"
PASSES = f"{SHARES_CTE}, pl AS (SELECT bucket, {_case(TARGETS, 'bucket', 0.0)}::DOUBLE * 400000.0::DOUBLE AS scheduled, tokens AS available FROM sh)"


def q_exclusive_buckets(spark, d):
    return M.exclusive_buckets(docs_of(spark, d))


def shares(spark, d):
    docs = docs_of(spark, d)
    return M.mixture_shares(M.exclusive_buckets(docs), M.word_tokens(docs), TARGETS)


def q_mixture_shares(spark, d):
    return r9(shares(spark, d), "share", "delta")


SHARES = f"WITH {SHARES_CTE} SELECT bucket, tokens, round(tokens / sum(tokens) OVER (), 9) AS share, {_case(TARGETS, 'bucket', 0.0)}::DOUBLE AS target, round(tokens / sum(tokens) OVER () - {_case(TARGETS, 'bucket', 0.0)}, 9) AS delta FROM sh"


def plan(spark, d):
    return M.exposure_plan(shares(spark, d).select("bucket", "tokens"), TARGETS, 400_000.0)


def q_exposure_plan(spark, d):
    return r9(plan(spark, d), "passes")


EXPOSURE = f"WITH {PASSES} SELECT bucket, scheduled, available, round(scheduled / nullif(available, 0), 9) AS passes, coalesce(scheduled / nullif(available, 0) <= 4, false) AS ok FROM pl"


def q_exposure_decision(spark, d):
    return r9(M.exposure_decision(plan(spark, d)), "scheduled", "unique_equivalent", "required")


DECISION = f"""WITH {PASSES}, o AS (SELECT sum(scheduled) AS s, sum(least(scheduled, available::DOUBLE)) AS u, count(*) FILTER (NOT coalesce(scheduled / nullif(available, 0) <= 4, false)) AS n FROM pl)
SELECT round(s, 9) AS scheduled, round(u, 9) AS unique_equivalent, round(s * 0.5, 9) AS required, n AS over_passes, coalesce(u >= s * 0.5 AND n = 0, false) AS go FROM o"""


def q_sample_mixture(spark, d):
    return M.sample_mixture(M.exclusive_buckets(docs_of(spark, d)), plan(spark, d), "sample")


SAMPLE = f"""WITH {PASSES}, c AS (SELECT doc_id, bk.bucket, scheduled / available AS p FROM bk JOIN pl USING (bucket)),
n AS (SELECT doc_id, bucket, (floor(p) + ({uniform_sql('doc_id', 'sample')} < p - floor(p))::INT)::INT AS n FROM c) SELECT doc_id, bucket, i::INT AS copy_no FROM n, unnest(range(1, n + 1)) AS u(i)"""


def q_language_budget(spark, d):
    docs = docs_of(spark, d)
    per = docs.select("doc_id", "lang").join(M.word_tokens(docs), "doc_id").groupBy("lang").agg(F.sum("tokens").alias("tokens"))
    return M.language_budget(per, BUDGETS)


BUDGET = f"""WITH b(lang, budget) AS (VALUES {', '.join(f"('{k}', {v}::BIGINT)" for k, v in BUDGETS.items())}), t AS (SELECT lang, sum(len({WORDS}))::BIGINT AS t FROM documents GROUP BY 1)
SELECT lang, coalesce(t, 0) AS available, budget, greatest(0, budget - coalesce(t, 0)) AS shortfall FROM b LEFT JOIN t USING (lang)"""


def q_composition_caps(spark, d):
    return r9(M.composition_caps(origins(docs_of(spark, d))), "value")


CAPS = f"""WITH {ORIGINS}, s AS (SELECT sum(tokens) FILTER (origin = 'native') / sum(tokens) AS n, sum(tokens) FILTER (origin = 'translated') / sum(tokens) AS t, sum(tokens) FILTER (origin = 'synthetic') / sum(tokens) AS y, sum(tokens) FILTER (official) / sum(tokens) AS f FROM o)
SELECT 'native' AS metric, round(n, 9) AS value, 0.55::DOUBLE AS "limit", n >= 0.55 AS "pass" FROM s UNION ALL SELECT 'translated', round(t, 9), 0.30, t <= 0.30 FROM s UNION ALL SELECT 'synthetic', round(y, 9), 0.15, y <= 0.15 FROM s UNION ALL SELECT 'official', round(f, 9), 0.25, f <= 0.25 FROM s"""


def q_region_floor(spark, d):
    rows = origins(docs_of(spark, d))
    listed = rows.select("region").distinct().unionByName(spark.createDataFrame([("src-missing",)], "region string"))
    return r9(M.region_floor(rows, listed, 0.04), "share")


REGIONS = f"""WITH {ORIGINS}, l AS (SELECT DISTINCT region FROM o UNION ALL SELECT 'src-missing'), p AS (SELECT region, sum(tokens)::BIGINT AS tokens FROM o GROUP BY 1), a AS (SELECT sum(tokens) AS total FROM o)
SELECT region, coalesce(tokens, 0) AS tokens, round(coalesce(tokens, 0) / total, 9) AS share, coalesce(tokens, 0) / total >= 0.04 AS "pass" FROM l LEFT JOIN p USING (region), a"""


def q_assemble_conversations(spark, d):
    return A.assemble_conversations(table(spark, d, "conversations")).drop("turns")


ASSEMBLE = f"""WITH c AS (SELECT conv_id, count(*) AS n_turns, sum(len({WORDS}))::BIGINT AS n_tokens, sha256(string_agg(coalesce(role, '') || chr(10) || coalesce(text, '') || chr(10), '' ORDER BY turn, role, text)) AS content_sha FROM conversations GROUP BY 1)
SELECT *, conv_id = min(conv_id) OVER (PARTITION BY content_sha) AS is_first FROM c"""


def conversation_languages(spark, d):
    return materialize(A.conversation_languages(table(spark, d, "conversations"), profiles(spark, d)), "conversation-languages")


_chats = "SELECT conv_id AS doc_id, 0 AS para_no, p FROM (SELECT conv_id, replace(string_agg(coalesce(text, ''), ' ' ORDER BY coalesce(text, '')), chr(10), ' ') AS p FROM conversations GROUP BY 1) WHERE p <> ''"
CHATS_CTE = f"{language_ctes(_chats)}, cl AS (SELECT DISTINCT conv_id, coalesce(lang, 'other') AS lang FROM conversations LEFT JOIN f ON f.doc_id = conv_id)"


def q_sft_mix(spark, d):
    return r9(A.sft_mix(table(spark, d, "conversations"), conversation_languages(spark, d), SFT), "share")


def q_conversation_languages(spark, d):
    return conversation_languages(spark, d)


CHAT_LANGS = f"WITH {CHATS_CTE} SELECT conv_id, lang FROM cl"


SFT_MIX = f"""WITH {CHATS_CTE}, c0 AS (SELECT conv_id, count(*) AS k FROM conversations GROUP BY 1),
sm AS (SELECT CASE WHEN k <= 2 THEN 'single' WHEN k <= 4 THEN 'short' ELSE 'long' END AS task, lang FROM c0 JOIN cl USING (conv_id))
SELECT task, lang, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share, {_case(SFT, 'lang', 0.0)}::DOUBLE AS target FROM sm GROUP BY 1, 2"""


def judgements(spark, d):
    """Three raters' outcomes on every document, from hashes."""
    rows = docs_of(spark, d).select(F.col("doc_id").alias("item_id"), "lang", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("rater"))
    u = uniform(F.concat_ws(":", F.col("item_id").cast("string"), F.col("rater").cast("string")), "judge")
    return rows.withColumn("outcome", F.when(u < 0.5, "win").when(u < 0.65, "tie").otherwise("loss"))


_u = uniform_sql("doc_id::VARCHAR || ':' || rater", "judge")
JUDGE_CTE = f"j AS (SELECT doc_id AS item_id, lang, rater, CASE WHEN {_u} < 0.5 THEN 'win' WHEN {_u} < 0.65 THEN 'tie' ELSE 'loss' END AS outcome FROM documents, range(1, 4) AS r(rater))"


def pair_judgements(pairs):
    """Three raters' outcomes on every pair of answers, from hashes."""
    rows = pairs.select("pair_id", "lang", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("rater"))
    u = uniform(F.concat_ws(":", "pair_id", F.col("rater").cast("string")), "judge")
    return rows.withColumn("outcome", F.when(u < 0.5, "win").when(u < 0.65, "tie").otherwise("loss"))


def q_preference_pairs(spark, d):
    pairs = materialize(A.sibling_pairs(table(spark, d, "conversations"), conversation_languages(spark, d)), "sibling-pairs")
    rows = A.preference_pairs(pairs, pair_judgements(pairs))
    return r9(rows.withColumns({c: F.sha2(c, 256) for c in ("prompt", "chosen", "rejected")}), "agreement")


_up = uniform_sql("pair_id || ':' || rater", "judge")
SIBLINGS_CTE = f"""{CHATS_CTE}, pr AS (SELECT conv_id, arg_min(text, (turn, text)) AS prompt FROM conversations WHERE role = 'user' AND text IS NOT NULL GROUP BY 1),
an AS (SELECT conv_id, turn, text AS first, prompt, count(*) OVER (PARTITION BY prompt) AS n FROM conversations JOIN pr USING (conv_id) WHERE role = 'assistant' AND text IS NOT NULL),
sb AS (SELECT *, lead(first) OVER (PARTITION BY prompt, floor({uniform_sql("conv_id", "siblings")} * ceil(n / 1024)) ORDER BY conv_id, turn, first) AS second FROM an),
sp AS (SELECT conv_id || '-' || turn AS pair_id, lang, prompt, first, second FROM sb JOIN cl USING (conv_id) WHERE first <> second),
pj AS (SELECT pair_id, lang, rater, CASE WHEN {_up} < 0.5 THEN 'win' WHEN {_up} < 0.65 THEN 'tie' ELSE 'loss' END AS outcome FROM sp, range(1, 4) AS r(rater)),
po AS (SELECT pair_id, lang, count(*) AS n_raters, count(*) FILTER (outcome = 'win') AS w, count(*) FILTER (outcome = 'tie') AS t, count(*) FILTER (outcome = 'loss') AS l FROM pj GROUP BY ALL)"""
PREFERENCE = f"""WITH {SIBLINGS_CTE}, m AS (SELECT *, greatest(w, t, l) AS top, CASE WHEN w = greatest(w, t, l) THEN 'win' WHEN l = greatest(w, t, l) THEN 'loss' ELSE 'tie' END AS majority FROM po)
SELECT pair_id, m.lang, sha256(prompt) AS prompt, sha256(CASE majority WHEN 'win' THEN first ELSE second END) AS chosen, sha256(CASE majority WHEN 'win' THEN second ELSE first END) AS rejected, n_raters, majority, round(top / n_raters, 9) AS agreement
FROM m JOIN sp USING (pair_id) WHERE majority <> 'tie'"""


def q_rater_agreement(spark, d):
    pairs = materialize(A.sibling_pairs(table(spark, d, "conversations"), conversation_languages(spark, d)), "sibling-pairs")
    return r9(A.rater_agreement(pair_judgements(pairs)), "observed", "expected", "kappa")


AGREEMENT = f"""WITH {SIBLINGS_CTE}, a AS (SELECT lang, count(*) AS items, avg((w * w + t * t + l * l - n_raters) / (n_raters * (n_raters - 1))) AS o, sum(w) / sum(n_raters) AS w, sum(t) / sum(n_raters) AS t, sum(l) / sum(n_raters) AS l FROM po WHERE n_raters > 1 GROUP BY 1),
e AS (SELECT lang, items, o, w * w + t * t + l * l AS e FROM a)
SELECT lang, items, round(o, 9) AS observed, round(e, 9) AS expected, round(CASE WHEN e < 1 THEN (o - e) / (1 - e) END, 9) AS kappa FROM e"""


def rollouts(spark, d):
    """Episodes of steps from the event stream: one episode per user and day."""
    e = table(spark, d, "events")
    u = lambda salt: uniform("event_id", salt)
    episode = F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyyMMdd"))
    return e.select(episode.alias("episode_id"), (F.col("user_id") % 50).alias("prompt_id"), F.col("event_id").alias("step"), u("task").alias("task"), (u("schema") < 0.9).alias("schema_ok"), u("ground").alias("grounding"), u("eff").alias("efficiency"), u("lang").alias("language"), u("learned").alias("learned"), ((F.col("event_type") == "error") & (u("critical") < 0.2)).alias("critical"))


_ue = lambda salt: uniform_sql("event_id", salt)
ROLLOUT_CTE = f"""ro AS (SELECT user_id::VARCHAR || '-' || strftime(ts, '%Y%m%d') AS episode_id, user_id % 50 AS prompt_id, event_id AS step, {_ue('task')} AS task, ({_ue('schema')} < 0.9)::INT AS schema_ok, {_ue('ground')} AS grounding, {_ue('eff')} AS efficiency,
 {_ue('lang')} AS language, {_ue('learned')} AS learned, event_type = 'error' AND {_ue('critical')} < 0.2 AS critical FROM events)"""


def q_rollout_rewards(spark, d):
    return r9(A.rollout_rewards(rollouts(spark, d)), "reward")


REWARDS_CTE = f"""{ROLLOUT_CTE}, lv AS (SELECT *, coalesce(max(critical::INT) OVER (PARTITION BY episode_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ro),
rw AS (SELECT episode_id, prompt_id, avg(0.55 * task + 0.15 * schema_ok + 0.10 * grounding + 0.10 * efficiency + 0.10 * least(language, least(learned, 0.2) * 5)) AS m, bool_or(critical) AS bad, max(step) AS last FROM lv WHERE before = 0 GROUP BY 1, 2)"""
REWARDS = f"WITH {REWARDS_CTE} SELECT episode_id, prompt_id, round(CASE WHEN bad THEN -1 ELSE m END, 9) AS reward, CASE WHEN bad THEN last END AS terminated_at FROM rw"


def q_prompt_rewards(spark, d):
    per = A.rollout_rewards(rollouts(spark, d)).groupBy("prompt_id").agg(F.count(F.lit(1)).alias("samples"), F.avg("reward").alias("mean_reward"))
    return r9(per, "mean_reward")


PROMPTS = f"WITH {REWARDS_CTE} SELECT prompt_id, count(*) AS samples, round(avg(CASE WHEN bad THEN -1 ELSE m END), 9) AS mean_reward FROM rw GROUP BY 1"


def judged(spark, d):
    """A judge's score in hundredths for each labelled document: function-word share, moved by its label."""
    s = quality_signals(docs_of(spark, d)).join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    return s.select("lang", (F.floor(F.least(F.lit(1.0), F.col("stopword_share") * 1.5 + 0.4 * F.col("quality")) * 100 + 1e-9) / 100).alias("score"), F.col("quality").alias("label"))


JUDGED_CTE = f"{SIGNALS_CTE}, jd AS (SELECT lang, floor(least(1.0, stopword_share * 1.5 + 0.4 * quality) * 100 + 1e-9) / 100 AS score, quality AS label FROM q JOIN labels USING (doc_id))"


def q_judge_calibration(spark, d):
    return r9(A.judge_calibration(judged(spark, d)), "auc", "ece", "kappa")


CALIBRATION = f"""WITH {JUDGED_CTE}, a AS (SELECT x.lang, avg(CASE WHEN x.score > y.score THEN 1.0 WHEN x.score = y.score THEN 0.5 ELSE 0 END) AS auc FROM jd x JOIN jd y ON x.lang = y.lang AND x.label = 1 AND y.label = 0 GROUP BY 1),
b AS (SELECT lang, least(floor(score * 10), 9) AS bin, count(*) AS n, sum(label) AS pos, sum(score) AS s FROM jd GROUP BY 1, 2), e AS (SELECT lang, sum(abs(pos - s)) / sum(n) AS ece FROM b GROUP BY 1),
k AS (SELECT lang, count(*) AS n, sum(label) AS pos, count(*) FILTER (score >= 0.5) AS yes, count(*) FILTER ((score >= 0.5) <> (label = 1)) AS off FROM jd GROUP BY 1),
z AS (SELECT lang, n, off, (yes * (n - pos) + (n - yes) * pos) / n AS chance FROM k), w AS (SELECT lang, n, auc, ece, CASE WHEN chance = 0 THEN NULL ELSE 1 - off / chance END AS kappa FROM z JOIN e USING (lang) LEFT JOIN a USING (lang))
SELECT lang, n, round(auc, 9) AS auc, round(ece, 9) AS ece, round(kappa, 9) AS kappa, coalesce(auc >= 0.8 AND ece <= 0.05 AND kappa >= 0.65, false) AS "pass" FROM w"""


def q_audit_sample(spark, d):
    return A.audit_sample(rollouts(spark, d))


AUDIT_SAMPLE = f"WITH {ROLLOUT_CTE} SELECT episode_id FROM (SELECT DISTINCT episode_id FROM ro) WHERE {uniform_sql('episode_id', 'audit')} < 0.05"


def results(spark, d):
    """Per-document outcomes as three seeds' results: the label, flipped by a hash."""
    rows = docs_of(spark, d).select("doc_id", "lang").join(table(spark, d, "labels").select("doc_id", "quality", "toxic"), "doc_id")
    rows = rows.select("doc_id", "lang", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("seed"), F.inline(F.array(F.struct(F.lit("quality").alias("metric"), F.col("quality").alias("v")), F.struct(F.lit("safety").alias("metric"), (1 - F.col("toxic")).alias("v")))))
    flip = uniform(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("seed").cast("string"), F.col("metric")), "seed") < 0.1
    return rows.select("metric", "lang", "seed", "doc_id", F.when(flip, 1 - F.col("v")).otherwise(F.col("v")).cast("double").alias("value"))


_uf = uniform_sql("doc_id::VARCHAR || ':' || seed || ':' || metric", "seed")
RESULTS_CTE = f"""rs AS (SELECT metric, lang, seed, doc_id, (CASE WHEN {_uf} < 0.1 THEN 1 - v ELSE v END)::DOUBLE AS value FROM (
 SELECT 'quality' AS metric, lang, seed, doc_id, quality AS v FROM documents JOIN labels USING (doc_id), range(1, 4) AS r(seed) UNION ALL SELECT 'safety', lang, seed, doc_id, 1 - toxic FROM documents JOIN labels USING (doc_id), range(1, 4) AS r(seed)))"""


def q_macro_worst_gap(spark, d):
    return r9(E.macro_worst_gap(results(spark, d), 0.08), "macro", "worst", "gap")


GAP = f"""WITH {RESULTS_CTE}, p AS (SELECT metric, lang, avg(value) AS v FROM rs GROUP BY 1, 2)
SELECT metric, round(avg(v), 9) AS macro, arg_min(lang, v) AS worst_lang, round(min(v), 9) AS worst, round(max(v) - min(v), 9) AS gap, max(v) - min(v) <= 0.08 AS "pass" FROM p GROUP BY 1"""


def ci(spark, d):
    rows = docs_of(spark, d).select("doc_id", "lang").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    return E.bootstrap_ci(rows.select(F.col("lang").alias("group"), F.col("doc_id").alias("item"), F.col("quality").cast("double").alias("value")), 100)


def q_bootstrap_ci(spark, d):
    return r9(ci(spark, d), "mean", "lo", "hi")


_ub = uniform_sql("doc_id::VARCHAR || ':' || b", "boot")
CI_CTE = f"""bs AS (SELECT lang, b, quality, {" + ".join(f"(u >= {c!r})::INT" for c in E.POISSON)} AS w FROM (SELECT lang, b, quality, {_ub} AS u FROM documents JOIN labels USING (doc_id), range(1, 101) AS r(b))),
bm AS (SELECT lang, b, sum(w * quality)::DOUBLE / nullif(sum(w), 0) AS m FROM bs GROUP BY 1, 2), bc AS (SELECT lang, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM bm GROUP BY 1),
ci AS (SELECT lang AS "group", mean, lo, hi FROM (SELECT lang, avg(quality) AS mean FROM documents JOIN labels USING (doc_id) GROUP BY 1) JOIN bc USING (lang))"""
CI = f'WITH {CI_CTE} SELECT "group", round(mean, 9) AS mean, round(lo, 9) AS lo, round(hi, 9) AS hi FROM ci'


def q_noninferiority(spark, d):
    """Lower bounds by language against the mean over all labelled documents."""
    base = table(spark, d, "labels").agg((F.avg("quality") * 100).alias("base"))
    bounds = materialize(ci(spark, d), "ci")
    return r9(E.noninferiority(bounds, bounds.select("group").crossJoin(F.broadcast(base))), "lo", "gate")  # one row on the right


NONINFERIOR = f'WITH {CI_CTE}, b AS (SELECT avg(quality) * 100 AS base FROM labels) SELECT "group", round(lo * 100, 9) AS lo, round(base - 2, 9) AS gate, lo * 100 >= base - 2 AS "pass" FROM ci, b'


def q_eval_split(spark, d):
    return E.eval_split(table(spark, d, "benchmark"), "split")


EVAL_SPLIT = f"""SELECT item_id, CASE WHEN {uniform_sql('item_id', 'split')} < 0.2 THEN 'hidden' ELSE 'public' END AS split, CASE {" ".join(f"WHEN {uniform_sql('item_id', f'split-q{q}')} < 0.3 THEN {q}" for q in range(1, 5))} END AS refresh_quarter FROM benchmark"""


def q_after_cutoff(spark, d):
    return E.after_cutoff(table(spark, d, "events"), "2024-01-20 00:00:00").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"))


CUTOFF = "SELECT event_type, count(*) AS n, min(event_id) AS first_id FROM events WHERE ts > TIMESTAMP '2024-01-20 00:00:00' GROUP BY 1"


def q_canary_scan(spark, d):
    """Canaries appended to a few documents by hash, and one that is planted nowhere."""
    canaries = spark.createDataFrame([(1, "CANARY zq81-violet-gate 77"), (2, "canary guid b5e1f0c2-0001"), (3, "never planted xk-404")], "canary_id long, text string")
    u = uniform("doc_id", "canary")
    text = F.when(u < 0.01, F.concat("text", F.lit("\nCANARY zq81-violet-gate 77"))).when(u > 0.99, F.concat("text", F.lit(" canary guid b5e1f0c2-0001"))).otherwise(F.col("text"))
    return E.canary_scan(docs_of(spark, d).select("doc_id", text.alias("text")), canaries)


CANARY = f"SELECT doc_id, CASE WHEN {uniform_sql('doc_id', 'canary')} < 0.01 THEN 1 ELSE 2 END::BIGINT AS canary_id FROM documents WHERE {uniform_sql('doc_id', 'canary')} < 0.01 OR {uniform_sql('doc_id', 'canary')} > 0.99"


def q_preference_winrate(spark, d):
    return r9(E.preference_winrate(judgements(spark, d)), "win_rate", "lo")


WINRATE = f"""WITH {JUDGE_CTE}, p AS (SELECT lang, count(*) AS n, sum(CASE outcome WHEN 'win' THEN 1.0 WHEN 'tie' THEN 0.5 ELSE 0 END)::DOUBLE / count(*) AS p FROM j GROUP BY 1),
w AS (SELECT lang, n, p, (p + 3.8416 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4.0 * n * n))) / (1 + 3.8416 / n) AS lo FROM p) SELECT lang, n, round(p, 9) AS win_rate, round(lo, 9) AS lo, lo > 0.5 AS "pass" FROM w"""


def q_launch_gates(spark, d):
    """Measured values by language (win rate, quality) against gates, one of which has no metric."""
    wins = E.preference_winrate(judgements(spark, d)).select(F.lit("win_rate").alias("metric"), F.col("lang").alias("scope"), F.col("win_rate").alias("value"))
    quality = results(spark, d).filter("metric = 'quality'").groupBy("lang").agg(F.avg("value").alias("value")).select(F.lit("quality").alias("metric"), F.col("lang").alias("scope"), "value")
    langs = docs_of(spark, d).select("lang").distinct()
    gates = langs.select(F.inline(F.array(F.struct(F.lit("win_rate").alias("metric"), F.lit(">=").alias("op"), F.lit(0.55).alias("threshold")), F.struct(F.lit("quality").alias("metric"), F.lit(">=").alias("op"), F.lit(0.68).alias("threshold")))), F.col("lang").alias("scope"))
    gates = gates.unionByName(spark.createDataFrame([("absent", ">", 0.0, "all")], "metric string, op string, threshold double, scope string"))
    return r9(E.launch_gates(wins.unionByName(quality), gates), "value")


GATES = f"""WITH {JUDGE_CTE}, {RESULTS_CTE}, m AS (SELECT 'win_rate' AS metric, lang AS scope, sum(CASE outcome WHEN 'win' THEN 1.0 WHEN 'tie' THEN 0.5 ELSE 0 END)::DOUBLE / count(*) AS value FROM j GROUP BY 2 UNION ALL SELECT 'quality', lang, avg(value) FROM rs WHERE metric = 'quality' GROUP BY 2),
g AS (SELECT 'win_rate' AS metric, '>=' AS op, 0.55::DOUBLE AS threshold, lang AS scope FROM documents GROUP BY lang UNION ALL SELECT 'quality', '>=', 0.68, lang FROM documents GROUP BY lang UNION ALL SELECT 'absent', '>', 0.0, 'all'),
r AS (SELECT metric, scope, value, op, threshold, coalesce(CASE WHEN op = '>=' THEN value >= threshold ELSE value > threshold END, false) AS "pass" FROM g LEFT JOIN m USING (metric, scope))
SELECT metric, scope, round(value, 9) AS value, op, threshold, "pass" FROM r UNION ALL SELECT 'overall', 'all', NULL, '', NULL, bool_and("pass") FROM r"""


def q_next_token_pairs(spark, d):
    return r9(E.next_token_pairs(docs_of(spark, d)), "p")


PAIRS_CTE = f"""s AS (SELECT unnest(regexp_split_to_array(text, '[.!?\\n]+')) AS text FROM documents), w AS (SELECT {WORDS} AS w FROM s),
np AS (SELECT w[i] AS "left", w[i + 1] AS "right", count(*) AS n FROM w, unnest(range(1, len(w))) AS u(i) GROUP BY 1, 2), nt AS (SELECT *, n / sum(n) OVER (PARTITION BY "left") AS p FROM np)"""
PAIRS = f'WITH {PAIRS_CTE} SELECT "left", "right", n, round(p, 9) AS p FROM nt'


def q_pair_cross_entropy(spark, d):
    return r9(E.cross_entropy(E.next_token_pairs(docs_of(spark, d))), "cross_entropy")


ENTROPY = f"WITH {PAIRS_CTE} SELECT sum(n)::BIGINT AS pairs, round(sum(-n * ln(p)) / sum(n), 9) AS cross_entropy FROM nt"


def q_cosine_neighbors(spark, d):
    return V.cosine_neighbors(table(spark, d, "embeddings")).withColumn("cosine", F.round("cosine", 5))


NEIGHBORS = """WITH v AS (SELECT vec_id, embedding::DOUBLE[64] AS e FROM embeddings), p AS (SELECT a.vec_id, b.vec_id AS neighbor, array_cosine_similarity(a.e, b.e) AS c FROM v a JOIN v b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(c, 9) DESC, neighbor) AS rank FROM p) SELECT vec_id, rank, neighbor, round(c, 5) AS cosine FROM r WHERE rank <= 5"""


def q_embedding_projection(spark, d):
    return V.embedding_projection(table(spark, d, "embeddings"))


# Sizes of the nested training sets.
TRAIN_SIZES = [20, 200, 2000]
FEATURES = ["symbol_ratio", "stopword_share", "dup_line_share", "bullet_share"]


def labelled(spark, d):
    rows = quality_signals(docs_of(spark, d)).join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    return rows.withColumn("u", uniform("doc_id", "gap"))


def q_logistic_train(spark, d):
    w = V.logistic_train(labelled(spark, d), FEATURES, "quality")
    return spark.createDataFrame(list(zip([*FEATURES, "bias"], w)), "feature string, weight double")


def q_binary_metrics(spark, d):
    rows = judged(spark, d).select("lang", F.col("score").alias("p"), "label")
    return r9(V.binary_metrics(rows, "label", "lang"), "accuracy", "log_loss")


METRICS = f"""WITH {JUDGED_CTE} SELECT lang, count(*) AS n, round(avg(((score >= 0.5) = (label = 1))::INT), 9) AS accuracy, round(avg(-CASE WHEN label = 1 THEN ln(least(greatest(score, 1e-6), 1 - 1e-6)) ELSE ln(1 - least(greatest(score, 1e-6), 1 - 1e-6)) END), 9) AS log_loss FROM jd GROUP BY 1"""


def q_generalization_gap(spark, d):
    """Nested training sets of growing size against one held-out part: losses, their gap, and the worst gap of all sizes."""
    rows = materialize(labelled(spark, d), "labelled")
    test, out = rows.filter("u >= 0.7"), None
    for size in TRAIN_SIZES:
        train = materialize(rows.filter("u < 0.7").orderBy("u", "doc_id").limit(size), "train")
        w = V.logistic_train(train, FEATURES, "quality", epochs=25)
        a, b = (V.binary_metrics(V.logistic_score(x, FEATURES, w), "quality").select(F.col("n").alias(f"{n}_n"), F.col("log_loss").alias(f"{n}_loss")) for x, n in ((train, "train"), (test, "test")))
        row = a.crossJoin(b).select(F.lit(size).alias("size"), "train_n", "test_n", "train_loss", "test_loss", (F.col("test_loss") - F.col("train_loss")).alias("gap"))  # one row each
        out = row if out is None else out.unionByName(row)
    out = materialize(out, "gaps")  # one row a size
    return out.crossJoin(F.broadcast(out.agg(F.max("gap").alias("worst_gap"))))  # one row on the right


REGISTRY = {
    "exclusive_buckets": (q_exclusive_buckets, f"WITH {BUCKETS_CTE} SELECT doc_id, bucket FROM bk"),
    "mixture_shares": (q_mixture_shares, SHARES),
    "exposure_plan": (q_exposure_plan, EXPOSURE),
    "exposure_decision": (q_exposure_decision, DECISION),
    "sample_mixture": (q_sample_mixture, SAMPLE),
    "language_budget": (q_language_budget, BUDGET),
    "composition_caps": (q_composition_caps, CAPS),
    "region_floor": (q_region_floor, REGIONS),
    "assemble_conversations": (q_assemble_conversations, ASSEMBLE),
    "conversation_languages": (q_conversation_languages, CHAT_LANGS),
    "sft_mix": (q_sft_mix, SFT_MIX),
    "preference_pairs": (q_preference_pairs, PREFERENCE),
    "rater_agreement": (q_rater_agreement, AGREEMENT),
    "rollout_rewards": (q_rollout_rewards, REWARDS),
    "prompt_rewards": (q_prompt_rewards, PROMPTS),
    "judge_calibration": (q_judge_calibration, CALIBRATION),
    "audit_sample": (q_audit_sample, AUDIT_SAMPLE),
    "macro_worst_gap": (q_macro_worst_gap, GAP),
    "bootstrap_ci": (q_bootstrap_ci, CI),
    "noninferiority": (q_noninferiority, NONINFERIOR),
    "eval_split": (q_eval_split, EVAL_SPLIT),
    "after_cutoff": (q_after_cutoff, CUTOFF),
    "canary_scan": (q_canary_scan, CANARY),
    "preference_winrate": (q_preference_winrate, WINRATE),
    "launch_gates": (q_launch_gates, GATES),
    "next_token_pairs": (q_next_token_pairs, PAIRS),
    "pair_cross_entropy": (q_pair_cross_entropy, ENTROPY),
    "cosine_neighbors": (q_cosine_neighbors, NEIGHBORS),
    "embedding_projection": (q_embedding_projection, None),
    "logistic_train": (q_logistic_train, None),
    "binary_metrics": (q_binary_metrics, METRICS),
    "generalization_gap": (q_generalization_gap, None),
}
