"""Registered queries on the first merges of the trained vocabulary. These SQL can repeat, training included: it counts pairs, merges the first of them in all pieces, and again.

SIZES are numbers of merges: as many rounds as SQL makes over all distinct pieces in a few seconds. Tables are read whole at every size.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.functions import config as C
from granary.operators import bpe_codec as codec
from granary.operators import bpe_train as bpe
from granary.operators import fairness as fair
from granary.operators import nested as N
from granary.operators.mixture import exclusive_buckets, mixture_shares
from granary.plans.mixture_queries import BUCKETS_CTE, TARGETS, _case
from granary.plans.text_queries import UNIT, WORD
from granary.plans.tokenizer_queries import WEIGHTED, docs_of, rounded, trained

SIZES = (0, 16, 64, 128)
MOST, GATE = max(SIZES), 3.0

# a symbol is written as its string between the characters 1 and 2; one row without a string holds the entries made so far, whose places are their ids
SYMBOLS = "string_split(s[2:-2], chr(2) || chr(1))"
BY_ID = "CASE WHEN length({0}) > 1 THEN list_position(made, {0}) ELSE 0 END, {0}"
TRAINED = rf"""{WEIGHTED}, e AS (SELECT doc_id, lang, unnest(regexp_extract_all(replace(text, ' ', '▁'), '▁[^▁]*|[^▁]+')) AS piece FROM documents),
a AS (SELECT piece, sum(count)::BIGINT AS count FROM (SELECT piece, count FROM c UNION ALL SELECT DISTINCT piece, 0 FROM e) GROUP BY piece),
m AS (SELECT 0 AS step, regexp_replace(piece, '(?s)(.)', chr(1) || '\1' || chr(2), 'g') AS s, count, NULL::VARCHAR AS l, NULL::VARCHAR AS r, NULL::VARCHAR[] AS made FROM a
UNION ALL SELECT 0, NULL, NULL, NULL, NULL, []::VARCHAR[]
UNION ALL (WITH y AS (SELECT {SYMBOLS} AS y, count FROM m WHERE s IS NOT NULL),
 p AS (SELECT y[i] AS l, y[i + 1] AS r, sum(count) AS n FROM (SELECT y, count, unnest(range(1, len(y))) AS i FROM y) GROUP BY ALL),
 b AS (SELECT l, r FROM p, (SELECT made FROM m WHERE made IS NOT NULL) AS o WHERE n > 0 ORDER BY n DESC, {BY_ID.format("l")}, {BY_ID.format("r")} LIMIT 1)
 SELECT step + 1, replace(s, chr(1) || b.l || chr(2) || chr(1) || b.r || chr(2), chr(1) || b.l || b.r || chr(2)), count, CASE WHEN s IS NULL THEN b.l END, CASE WHEN s IS NULL THEN b.r END,
  CASE WHEN s IS NULL AND NOT list_contains(made, b.l || b.r) THEN list_append(made, b.l || b.r) ELSE made END FROM m, b WHERE step < {MOST})),
t AS (SELECT step AS merges, replace(replace(s, chr(1), ''), chr(2), '') AS piece, {SYMBOLS} AS y FROM m WHERE s IS NOT NULL AND step IN {SIZES})"""
DOCS = f"{TRAINED}, d AS (SELECT doc_id, merges, sum(len(y))::BIGINT AS tokens FROM e JOIN t USING (piece) GROUP BY ALL)"
SUMS = f"""{DOCS}, z AS (SELECT merges, lang, sum(tokens) AS tokens, sum(len(regexp_extract_all(text, '{UNIT}'))) AS units, sum(len(regexp_extract_all(text, '{WORD}'))) AS words,
 sum(octet_length(encode(text))) AS bytes FROM d JOIN documents USING (doc_id) GROUP BY ALL), r AS (SELECT merges, lang, tokens::BIGINT AS tokens, units::BIGINT AS units, tokens::DOUBLE / units AS ratio FROM z)"""


def sums(spark, d):
    return N.sums_by_size(docs_of(spark, d), trained(spark, d), SIZES)


def ratios(spark, d):
    return sums(spark, d).select("merges", "lang", "tokens", "units", F.try_divide("tokens", "units").alias("ratio"))


def q_bpe_train_nested(spark, d):
    return bpe.merges_frame(spark, N.nested(trained(spark, d), MOST))


MERGES = f'WITH RECURSIVE {TRAINED} SELECT (step - 1)::INT AS rank, l AS "left", r AS "right" FROM m WHERE s IS NULL AND step > 0'


def q_encode_nested(spark, d):
    return N.token_counts(docs_of(spark, d).select("doc_id", "text"), trained(spark, d), SIZES).select("doc_id", "merges", "tokens", "byte_tokens")


ENCODE = f"WITH RECURSIVE {DOCS} SELECT doc_id, merges, tokens, 0::BIGINT AS byte_tokens FROM d"


def q_encode_tokens_nested(spark, d):
    """How often each entry is used, and by how many documents."""
    rows = codec.encode_tokens(docs_of(spark, d), N.nested(trained(spark, d), MOST))
    return rows.groupBy("kind", "label", "hex").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("documents"))


TOKENS = f"""WITH RECURSIVE {TRAINED}, u AS (SELECT doc_id, unnest(y) AS label FROM e JOIN t USING (piece) WHERE merges = {MOST})
SELECT 'merge' AS kind, label, hex(encode(label)) AS hex, count(*) AS n, count(DISTINCT doc_id) AS documents FROM u GROUP BY label"""


def q_language_ratios_nested(spark, d):
    rows = ratios(spark, d)
    ranks = fair.ratio_gate(rows, GATE, "merges").select("merges", "lang", "rank", "pass")
    return rounded(rows.join(ranks, ["merges", "lang"]), "ratio")


RATIOS = f'WITH RECURSIVE {SUMS} SELECT merges, lang, tokens, units, round(ratio, 9) AS ratio, row_number() OVER (PARTITION BY merges ORDER BY ratio, lang) AS rank, ratio <= {GATE} AS "pass" FROM r'


def q_fairness_nested(spark, d):
    found = fair.fairness_score(ratios(spark, d), C.PENALTY_LANG, "merges")
    return found.select("merges", F.round("spread", 9).alias("spread"), F.round("score", 6).alias("score"), F.round("penalty", 9).alias("penalty"), F.round("adjusted", 6).alias("adjusted"))


FAIRNESS = f"""WITH RECURSIVE {SUMS}, o AS (SELECT merges, max(ratio) - min(ratio) AS spread, max(ratio) FILTER (lang = '{C.PENALTY_LANG}') AS p FROM r GROUP BY merges),
x AS (SELECT merges, spread, 1000 / spread AS score, exp(greatest(0, p / 1.2 - 1)) AS penalty FROM o)
SELECT merges, round(spread, 9) AS spread, round(score, 6) AS score, round(penalty, 9) AS penalty, round(score / penalty, 6) AS adjusted FROM x"""


def q_fertility_nested(spark, d):
    return rounded(N.fertility_by_size(sums(spark, d)), "mean", "bytes_per_token", "relative", "byte_share")


FERTILITY = f"""WITH RECURSIVE {SUMS}, f AS (SELECT merges, lang, tokens::DOUBLE / words AS mean, bytes::DOUBLE / tokens AS b FROM z)
SELECT f.merges, f.lang, round(f.mean, 9) AS mean, round(f.b, 9) AS bytes_per_token, 0.0::DOUBLE AS byte_share, round(f.mean / o.mean, 9) AS relative FROM f JOIN f AS o ON o.merges = f.merges AND o.lang = 'en'"""


def q_fertility_gate_nested(spark, d):
    rows = N.fertility_by_size(sums(spark, d)).filter(F.col("merges") == MOST).select("lang", F.col("mean").alias("ratio"), "byte_share")
    return rounded(fair.fertility_gate(rows, C.CEILINGS), "value")


FERTILITY_GATE = f"""WITH RECURSIVE {SUMS}, f AS (SELECT lang, tokens::DOUBLE / words AS mean FROM z WHERE merges = {MOST}),
g AS (SELECT lang AS scope, mean AS value, {_case(C.CEILINGS, "lang", "NULL")}::DOUBLE AS threshold FROM f WHERE lang IN {tuple(C.CEILINGS)}
UNION ALL SELECT 'macro', avg(mean), 1.95 FROM f UNION ALL SELECT 'maximum', max(mean), 3.0 FROM f UNION ALL SELECT 'byte fallback', 0.0, 0.001)
SELECT scope, round(value, 9) AS value, threshold, value <= threshold AS "pass" FROM g"""


def q_smallest_passing_size(spark, d):
    """The first of SIZES at which a language has at most GATE tokens a unit."""
    return N.smallest_passing(ratios(spark, d), GATE)


SMALLEST = f"WITH RECURSIVE {SUMS} SELECT lang, min(merges) FILTER (merges > coalesce(last, -1)) AS merges FROM (SELECT *, max(merges) FILTER (ratio > {GATE}) OVER (PARTITION BY lang) AS last FROM r) GROUP BY lang"


def q_mixture_shares_nested(spark, d):
    docs = docs_of(spark, d)
    tokens = N.token_counts(docs.select("doc_id", "text"), trained(spark, d), (MOST,)).select("doc_id", "tokens")
    return rounded(mixture_shares(exclusive_buckets(docs), tokens, TARGETS), "share", "delta")


MIXTURE = f"""WITH RECURSIVE {DOCS}, {BUCKETS_CTE}, sh AS (SELECT bucket, sum(d.tokens)::BIGINT AS tokens FROM bk JOIN d USING (doc_id) WHERE merges = {MOST} GROUP BY 1)
SELECT bucket, tokens, round(tokens / sum(tokens) OVER (), 9) AS share, {_case(TARGETS, "bucket", 0.0)}::DOUBLE AS target, round(tokens / sum(tokens) OVER () - {_case(TARGETS, "bucket", 0.0)}, 9) AS delta FROM sh"""

REGISTRY = {
    "bpe_train_nested": (q_bpe_train_nested, MERGES),
    "encode_nested": (q_encode_nested, ENCODE),
    "encode_tokens_nested": (q_encode_tokens_nested, TOKENS),
    "language_ratios_nested": (q_language_ratios_nested, RATIOS),
    "fairness_nested": (q_fairness_nested, FAIRNESS),
    "fertility_nested": (q_fertility_nested, FERTILITY),
    "fertility_gate_nested": (q_fertility_gate_nested, FERTILITY_GATE),
    "smallest_passing_size": (q_smallest_passing_size, SMALLEST),
    "mixture_shares_nested": (q_mixture_shares_nested, MIXTURE),
}
