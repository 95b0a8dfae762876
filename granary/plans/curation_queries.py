"""Registered queries of the curation pipeline."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from granary.functions.sampling import uniform, uniform_sql
from granary.operators import curate as K
from granary.operators import language as L
from granary.operators import rights as R
from granary.operators import vectors as V
from granary.operators.near_clusters import near_clusters
from granary.plans.text_queries import WORD as FULL_WORD
from granary.functions.text import word_count
from granary.sources import commit_log as log
from granary.sources.tables import materialize, shared_dir, table

WORDS = r"regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+')"
OPT_OUT = 0.02


def docs_of(spark, d):
    return table(spark, d, "documents")


def origins(docs):
    """Derived fixture: where a text comes from, whether it is official, and its tokens (words)."""
    u = uniform("doc_id", "origin")
    kind = F.when(u < 0.6, "native").when(u < 0.85, "translated").otherwise("synthetic")
    return docs.select("doc_id", kind.alias("origin"), (uniform("doc_id", "official") < 0.2).alias("official"), F.col("source").alias("region"), word_count(F.col("text")).alias("tokens"))


ORIGINS = f"""o AS (SELECT doc_id, CASE WHEN {uniform_sql('doc_id', 'origin')} < 0.6 THEN 'native' WHEN {uniform_sql('doc_id', 'origin')} < 0.85 THEN 'translated' ELSE 'synthetic' END AS origin,
 {uniform_sql('doc_id', 'official')} < 0.2 AS official, source AS region, len(regexp_extract_all(text, '{FULL_WORD}')) AS tokens FROM documents)"""


def q_rights_filter(spark, d):
    return R.rights_filter(docs_of(spark, d))


def q_rights_shares(spark, d):
    return R.rights_shares(q_rights_filter(spark, d))


def _normalised(x):
    x = f"lower({x})"
    for pattern, to in R.SPELLINGS:
        x = f"regexp_replace({x}, '{pattern}', '{to.replace('$', chr(92))}', 'g')"
    return f"' ' || array_to_string(list_filter(string_split(trim({x}), ' '), lambda w: NOT list_contains({_listed(R.STOP)}, w)), ' ') || ' '"


def _listed(ws):
    return "[" + ", ".join(f"'{w}'" for w in ws) + "]"


_notices = ", ".join(f"(' {p} ', {len(p.split())}, '{k}', {not R.LICENCES[k]})" for p, k in R.NAMES)
_grants = ", ".join(f"({_listed(sorted(set(t.split())))}, '{k}', {not R.LICENCES[k]})" for k, t in R.GRANTS)
RIGHTS_CTE = rf"""rl AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
rw AS (SELECT doc_id, {_normalised("l[i]")} AS line, {_normalised(f"array_to_string(l[i : i + {R.WINDOW - 1}], ' ')")} AS near FROM rl, unnest(range(1, len(l) + 1)) AS u(i) WHERE regexp_matches(l[i], '{R.LINE}')),
rm AS (SELECT doc_id, refused, n, k, 1.0::DOUBLE AS sim FROM rw JOIN (VALUES {_notices}) AS v(p, n, k, refused) ON contains(line, p)
 UNION ALL SELECT doc_id, refused, len(ws), k, len(list_filter(ws, lambda w: contains(near, ' ' || w || ' '))) / len(ws) FROM rw, (VALUES {_grants}) AS v(ws, k, refused) WHERE len(list_filter(ws, lambda w: contains(near, ' ' || w || ' '))) >= len(ws) - len(ws) // {R.MISSED}),
rb AS (SELECT doc_id, k, refused, sim FROM rm QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY refused DESC, n DESC, k DESC, sim DESC) = 1),
rights AS (SELECT doc_id, coalesce(k, 'unresolved') AS licence, round(coalesce(sim, 0), 6) AS similarity, NOT coalesce(refused, false) AS allowed FROM documents LEFT JOIN rb USING (doc_id))"""
RIGHTS = f"WITH {RIGHTS_CTE} SELECT doc_id, licence, similarity, allowed, CASE WHEN NOT allowed THEN 'licence' END AS reason FROM rights"
SHARES = f"WITH {RIGHTS_CTE} SELECT licence, allowed, count(*) AS n, round(count(*) / (SELECT count(*) FROM rights), 9) AS share FROM rights GROUP BY ALL"


PROFILE_SHARE = 0.5


def profiles(spark, d):
    """Language profiles from half of the documents, by a hash of their id."""
    return L.learn_profiles(docs_of(spark, d).filter(uniform("doc_id", "profile") < PROFILE_SHARE))


def q_paragraph_lang_script(spark, d):
    """Paragraphs of all documents."""
    return L.paragraph_lang_script(docs_of(spark, d), profiles(spark, d))


_plain = lambda c: f"' ' || trim(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{M}}]+', ' ', 'g')) || ' '"
_scripts = "[" + ", ".join(f"'{x}'" for x in L.SCRIPTS) + "]"
_only = "CASE script " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in L.ONLY.items()) + " END"


def language_ctes(paragraphs):
    """Profiles from documents and the language and script of paragraphs (doc_id, para_no, p), as relation f."""
    return rf"""tr AS (SELECT lang, {_plain("text")} AS t, text FROM documents WHERE lang IS NOT NULL AND {uniform_sql('doc_id', 'profile')} < {PROFILE_SHARE}),
g AS (SELECT lang, substr(t, i, 3) AS g, count(*) AS n FROM tr, unnest(range(1, length(t) - 1)) AS u(i) GROUP BY ALL),
top AS (SELECT g FROM g GROUP BY g ORDER BY sum(n) DESC, g LIMIT {L.GRAMS}),
l0 AS (SELECT lang, [{", ".join(f"sum(len(regexp_extract_all(text, '\\p{{{x}}}')))" for x in L.SCRIPTS)}] AS k FROM tr GROUP BY lang),
l AS (SELECT lang, {_scripts}[list_position(k, list_max(k))] AS script FROM l0),
c AS (SELECT x.lang, x.g, coalesce(n, 0) AS n FROM (SELECT lang, g FROM l, top) x LEFT JOIN g ON g.lang = x.lang AND g.g = x.g),
t AS (SELECT lang, sum(n) + count(*) AS total FROM c GROUP BY lang),
w AS (SELECT lang, g, round(1000 * ln((n + 1) / total))::BIGINT AS w FROM c JOIN t USING (lang)),
p0 AS ({paragraphs}),
p1 AS (SELECT doc_id, para_no, {_plain("p")} AS t, len(regexp_extract_all(p, '\p{{L}}')) AS letters, [{", ".join(f"len(regexp_extract_all(p, '\\p{{{x}}}'))" for x in L.SCRIPTS)}] AS k FROM p0),
p AS (SELECT *, list_max(k) AS m, CASE WHEN list_max(k) > 0 THEN {_scripts}[list_position(k, list_max(k))] ELSE 'none' END AS script, len(list_filter(k, lambda n: n > 0 AND n >= letters * {L.MIXED_SHARE})) AS n_scripts FROM p1),
pg AS (SELECT doc_id, para_no, script, substr(t, i, 3) AS g FROM p, unnest(range(1, length(t) - 1)) AS u(i)),
sc AS (SELECT doc_id, para_no, l.lang, count(*) AS n, sum(coalesce(w.w, round(1000 * ln(1 / total))::BIGINT)) AS score FROM pg JOIN l ON l.script = pg.script JOIN t ON t.lang = l.lang LEFT JOIN w ON w.lang = l.lang AND w.g = pg.g GROUP BY ALL),
r AS (SELECT doc_id, para_no, list(lang ORDER BY score DESC, lang) AS langs, list(score ORDER BY score DESC, lang) AS scores, any_value(n) AS n FROM sc GROUP BY ALL),
f AS (SELECT doc_id, para_no, script, round(CASE WHEN letters = 0 THEN 0 ELSE m / letters END, 6) AS script_share, n_scripts, coalesce(langs[1], {_only}) AS lang, ((scores[1] - scores[2]) // n)::BIGINT AS margin FROM p LEFT JOIN r USING (doc_id, para_no))"""


_paragraphs = "SELECT doc_id, i - 1 AS para_no, l[i] AS p FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), unnest(range(1, len(l) + 1)) AS u(i) WHERE l[i] <> ''"
PARAGRAPHS = f"""WITH {language_ctes(_paragraphs)}
SELECT *, n_scripts > 1 OR coalesce(margin < {L.MIXED_MARGIN}, false) AS mixed FROM f"""


def q_quality_signals(spark, d):
    return K.quality_signals(docs_of(spark, d))


_stop = "CASE lang " + " ".join(f"WHEN '{k}' THEN len(list_filter(w, lambda x: list_contains({_listed(ws)}, x)))" for k, ws in K.LEXICON.items()) + " ELSE 0 END"
SIGNALS_CTE = rf"""q0 AS (SELECT doc_id, lang, text, {WORDS} AS w, string_split(text, chr(10)) AS l, length(text) AS n FROM documents),
q AS (SELECT doc_id, lang, len(w) AS n_words, round(coalesce(len(regexp_extract_all(text, '[#*$%&|<>]')) / nullif(n, 0), 0), 6) AS symbol_ratio, round(coalesce({_stop} / nullif(len(w), 0), 0), 6) AS stopword_share,
 round(coalesce(len(regexp_extract_all(text, '\p{{Lu}}')) / nullif(n, 0), 0), 6) AS upper_share, round((len(l) - len(list_distinct(l))) / len(l), 6) AS dup_line_share,
 round(len(list_filter(l, lambda x: regexp_matches(x, '^[-*|]| \| '))) / len(l), 6) AS bullet_share FROM q0)"""
SIGNALS = f"WITH {SIGNALS_CTE} SELECT * FROM q"


def q_quality_filter(spark, d):
    return K.quality_filter(K.score(K.quality_signals(docs_of(spark, d))), table(spark, d, "labels"))


SCORE_CTE = "sc AS (SELECT doc_id, lang, floor(least(1.0, greatest(0.0, 0.5 + stopword_share - (4 * symbol_ratio + dup_line_share + bullet_share) / 2)) * 100 + 1e-9)::BIGINT AS score FROM q)"
QUALITY = f"""WITH {SIGNALS_CTE}, {SCORE_CTE},
p AS (SELECT lang, score, sum(quality) AS good, sum(1 - quality) AS bad FROM sc JOIN labels USING (doc_id) WHERE quality IS NOT NULL GROUP BY ALL),
a AS (SELECT lang, score, coalesce(sum(bad) OVER (PARTITION BY lang ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + sum(good) OVER (PARTITION BY lang ORDER BY score ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS agree FROM p),
c AS (SELECT lang, arg_max(score, agree * 1000 - score) AS cutoff FROM a GROUP BY lang)
SELECT doc_id, sc.lang, score, cutoff, score >= coalesce(cutoff, 0) AS kept FROM sc LEFT JOIN c ON sc.lang = c.lang"""


def q_exact_dedup(spark, d):
    return K.exact_dedup(docs_of(spark, d))


EXACT = "SELECT doc_id, sha256(text) AS sha256, min(doc_id) OVER w AS keep_id, count(*) OVER w AS cluster_size, doc_id = min(doc_id) OVER w AS kept FROM documents WINDOW w AS (PARTITION BY text)"


def q_repeated_spans(spark, d):
    return K.repeated_spans(docs_of(spark, d))


SPANS = rf"""WITH l AS (SELECT doc_id, l, count(*) AS k FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) WHERE l <> '' GROUP BY ALL),
m AS (SELECT doc_id, k, count(*) OVER (PARTITION BY l) AS docs FROM l),
a AS (SELECT doc_id, sum(k)::BIGINT AS n_lines, coalesce(sum(k) FILTER (docs >= 2 OR k > 1), 0)::BIGINT AS n_repeated_lines FROM m GROUP BY doc_id),
w AS (SELECT doc_id, {WORDS} AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i : i + 9], ' ') AS g FROM w, unnest(range(1, len(w) - 8)) AS r(i)),
t AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY g) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT i + o) AS k FROM t, range(10) AS r(o) GROUP BY doc_id)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_repeated_lines, 0) AS n_repeated_lines, coalesce(k, 0) AS n_repeated_words,
 round(coalesce(k / nullif(len(w), 0), 0), 6) AS repeated_word_share FROM w LEFT JOIN a USING (doc_id) LEFT JOIN c USING (doc_id)"""


def q_minhash_pairs(spark, d):
    rows = K.minhash_pairs(docs_of(spark, d))
    return rows.withColumn("jaccard", F.round("jaccard", 6))


SHINGLES_CTE = rf"""w AS (SELECT doc_id, {WORDS} AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM w, unnest(range(1, greatest(len(w) - 3, 2))) AS u(i) WHERE len(w) > 0),
h AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS h FROM g GROUP BY doc_id),
k AS (SELECT doc_id, n, min(doc_id) OVER (PARTITION BY h) AS class_id FROM h),
r AS (SELECT g.doc_id, g FROM g JOIN k USING (doc_id) WHERE doc_id = class_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM r a JOIN r b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
pairs AS (SELECT a AS id_a, b AS id_b, i / (x.n + y.n - i) AS jaccard FROM c JOIN k x ON x.doc_id = a JOIN k y ON y.doc_id = b WHERE i / (x.n + y.n - i) >= 0.8)"""
MINHASH = f"WITH {SHINGLES_CTE} SELECT id_a, id_b, round(jaccard, 6) AS jaccard FROM pairs"


def q_dedup_clusters(spark, d):
    return near_clusters(docs_of(spark, d))


CLUSTERS = f"""WITH RECURSIVE {SHINGLES_CTE}, e AS (SELECT id_a AS a, id_b AS b FROM pairs UNION ALL SELECT id_b, id_a FROM pairs),
t(id, root) AS (SELECT a, a FROM e UNION SELECT e.b, t.root FROM t JOIN e ON e.a = t.id), m AS (SELECT id, min(root) AS root FROM t GROUP BY id),
z AS (SELECT d.doc_id, coalesce(m.root, k.class_id, d.doc_id) AS cluster_id FROM documents d LEFT JOIN k USING (doc_id) LEFT JOIN m ON m.id = k.class_id)
SELECT doc_id, cluster_id, count(*) OVER (PARTITION BY cluster_id) AS cluster_size, doc_id = cluster_id AS kept FROM z"""


def q_semantic_clusters(spark, d):
    return V.semantic_clusters(table(spark, d, "embeddings"), 0.9)


NORMED = "v AS (SELECT vec_id, embedding::DOUBLE[64] AS e FROM embeddings)"
SEMANTIC = f"""WITH RECURSIVE {NORMED}, p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id < b.vec_id AND array_cosine_similarity(a.e, b.e) >= 0.9),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p), t(id, root) AS (SELECT a, a FROM e UNION SELECT e.b, t.root FROM t JOIN e ON e.a = t.id), m AS (SELECT id, min(root) AS root FROM t GROUP BY id),
z AS (SELECT vec_id, coalesce(root, vec_id) AS cluster_id FROM v LEFT JOIN m ON id = vec_id) SELECT vec_id, cluster_id, count(*) OVER (PARTITION BY cluster_id) AS cluster_size FROM z"""


def q_pii_redact(spark, d):
    rows = K.pii_redact(docs_of(spark, d))
    return rows.withColumn("text_redacted", F.sha2("text_redacted", 256)).withColumnRenamed("text_redacted", "redacted_sha256")


_d = "regexp_replace(x, '[^0-9]', '', 'g')"
_right = f"list_reverse(list_transform(string_split({_d}, ''), lambda c: c::INT))"
_luhn = f"list_sum(list_transform({_right}, lambda d, i: CASE WHEN i % 2 = 1 THEN d WHEN d > 4 THEN 2 * d - 9 ELSE 2 * d END)) % 10 = 0"
_moved = f"list_transform({_right}, lambda d, i: substr('{''.join(K.VERHOEFF_PERM)}', 10 * ((i - 1) % 8)::INT + d + 1, 1)::INT)"
_verhoeff = f"list_reduce(list_prepend(0, {_moved}), lambda c, p: substr('{''.join(K.VERHOEFF_MUL)}', c * 10 + p + 1, 1)::INT) = 0"
_without = lambda t, c, name: f"CASE WHEN len({c}) = 0 THEN {t} ELSE regexp_replace({t}, '\\b(' || array_to_string({c}, '|') || ')\\b', '[{name}]', 'g') END"
PII = rf"""WITH f AS (SELECT doc_id, coalesce(text, '') AS t0, list_filter(regexp_extract_all(coalesce(text, ''), '{K.CARD}'), lambda x: {_luhn}) AS c FROM documents),
g AS (SELECT *, {_without('t0', 'c', 'BANK')} AS t1 FROM f), h AS (SELECT *, list_filter(regexp_extract_all(t1, '{K.AADHAAR}'), lambda x: {_verhoeff}) AS a FROM g),
u AS (SELECT *, {_without('t1', 'a', 'AADHAAR')} AS text FROM h)
SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '{K.EMAIL}', '[EMAIL]', 'g'), '{K.PHONE}', '[PHONE]', 'g'), '{K.IP}', '[IP]', 'g'), '{K.PAN}', '[PAN]', 'g')) AS redacted_sha256,
 len(a) AS n_aadhaar, len(regexp_extract_all(text, '{K.PAN}')) AS n_pan, len(c) AS n_bank, len(regexp_extract_all(text, '{K.PHONE}')) AS n_phone,
 len(regexp_extract_all(text, '{K.EMAIL}')) AS n_email, len(regexp_extract_all(text, '{K.IP}')) AS n_ip FROM u"""


def q_secret_scan(spark, d):
    rows = K.secret_scan(docs_of(spark, d))
    return rows.select("doc_id", F.sha2("text_clean", 256).alias("clean_sha256"), "n_secrets")


SECRETS = f"SELECT doc_id, sha256(regexp_replace(text, '{K.SECRET}', '[SECRET]', 'g')) AS clean_sha256, len(regexp_extract_all(text, '{K.SECRET}')) AS n_secrets FROM documents"


def q_removal_audit(spark, d):
    docs, labels = docs_of(spark, d), table(spark, d, "labels")
    kept = K.quality_filter(K.score(K.quality_signals(docs)), labels)
    return K.removal_audit(kept.select("doc_id", (~F.col("kept")).alias("removed")), labels, docs)


AUDIT = f"""WITH k AS ({QUALITY}), r AS (SELECT lang, source, NOT kept AS removed, NOT kept AND coalesce(quality = 1 AND toxic = 0, false) AS fp FROM documents JOIN (SELECT doc_id, kept FROM k) USING (doc_id) LEFT JOIN labels USING (doc_id)),
a AS (SELECT lang, source, count(*) AS n, count(*) FILTER (removed) AS n_removed, count(*) FILTER (fp) AS n_false_positive FROM r GROUP BY ROLLUP (lang, source)),
t AS (SELECT n_false_positive / n AS all_rate FROM a WHERE lang IS NULL AND source IS NULL)
SELECT lang, source, n, n_removed, n_false_positive, round(n_false_positive / n, 9) AS fp_rate, round(n_false_positive / n / nullif(all_rate, 0), 6) AS fp_ratio_to_all FROM a, t"""


def q_decontaminate_exact(spark, d):
    return K.decontaminate_exact(docs_of(spark, d), table(spark, d, "benchmark"))


FLAT = f"a AS (SELECT doc_id, ' ' || array_to_string({WORDS}, ' ') || ' ' AS t FROM documents), b AS (SELECT item_id, ' ' || array_to_string({WORDS}, ' ') || ' ' AS i FROM benchmark)"
DECON_EXACT = f"WITH {FLAT} SELECT doc_id, item_id FROM a JOIN b ON contains(t, i) WHERE i <> '  '"


def q_decontaminate_13gram(spark, d):
    return K.decontaminate_ngram(docs_of(spark, d), table(spark, d, "benchmark"))


def _windows(table_, key, size):
    return f"SELECT DISTINCT {key}, least(len(w), {size}) AS k, array_to_string(w[i : i + {size - 1}], ' ') AS g FROM (SELECT {key}, {WORDS} AS w FROM {table_}) z, unnest(range(1, greatest(len(w) - {size - 2}, 2))) AS u(i) WHERE len(w) > 0"


DECON_NGRAM = f"""WITH i AS ({_windows('benchmark', 'item_id', 13)}), ks AS (SELECT DISTINCT k FROM i), w AS (SELECT doc_id, {WORDS} AS w FROM documents),
d AS (SELECT DISTINCT doc_id, k, array_to_string(w[p : p + k - 1], ' ') AS g FROM w, ks, unnest(range(1, len(w) - k + 2)) AS u(p) WHERE len(w) >= k)
SELECT doc_id, item_id, count(*) AS n_shared FROM d JOIN i USING (k, g) GROUP BY ALL"""


def q_decontaminate_minhash(spark, d):
    return K.decontaminate_minhash(docs_of(spark, d), table(spark, d, "benchmark"))


# windows of a document: from each place where it has a shingle of the item, as many words as the item has, over 0.8
DECON_MINHASH = f"""WITH i AS ({_windows('benchmark', 'item_id', 5)}), n AS (SELECT item_id, count(*) AS n FROM i GROUP BY 1), z AS (SELECT item_id, ceil(len({WORDS}) / 0.8)::BIGINT AS width FROM benchmark),
w AS (SELECT doc_id, {WORDS} AS w FROM documents), ks AS (SELECT DISTINCT k FROM i),
d AS (SELECT doc_id, k, p, array_to_string(w[p : p + k - 1], ' ') AS g FROM w, ks, unnest(range(1, len(w) - k + 2)) AS u(p) WHERE len(w) >= k),
h AS (SELECT doc_id, item_id, p, k, g, n, width FROM d JOIN i USING (k, g) JOIN n USING (item_id) JOIN z USING (item_id)),
c AS (SELECT a.doc_id, a.item_id, a.p, any_value(a.n) AS n, count(DISTINCT b.g) AS k FROM h a JOIN h b ON a.doc_id = b.doc_id AND a.item_id = b.item_id AND b.p BETWEEN a.p AND a.p + a.width - a.k GROUP BY ALL)
SELECT doc_id, item_id, round(max(k / n), 6) AS containment FROM c GROUP BY ALL HAVING max(k / n) >= 0.8"""


def q_decontaminate_semantic(spark, d):
    """Evaluation vectors: every row whose id is divisible by 20, against all other rows."""
    rows = table(spark, d, "embeddings")
    return V.near_eval(rows, rows.filter("vec_id % 20 = 0"), 0.5).filter("vec_id <> eval_id").withColumn("cosine", F.round("cosine", 5))


DECON_SEMANTIC = f"WITH {NORMED} SELECT a.vec_id, b.vec_id AS eval_id, round(array_cosine_similarity(a.e, b.e), 5) AS cosine FROM v a JOIN v b ON a.vec_id <> b.vec_id AND b.vec_id % 20 = 0 AND array_cosine_similarity(a.e, b.e) >= 0.5"


def q_synthetic_cap(spark, d):
    return K.synthetic_cap(origins(docs_of(spark, d)))


CAP_CTE = f"""{ORIGINS}, b AS (SELECT coalesce(sum(tokens) FILTER (origin <> 'synthetic'), 0) * 0.12 / (1 - 0.12) AS allowed FROM o),
s AS (SELECT doc_id, sum(tokens) OVER (ORDER BY floor({uniform_sql('doc_id', 'cap')} * 4096), {uniform_sql('doc_id', 'cap')}, doc_id ROWS UNBOUNDED PRECEDING) AS t FROM o WHERE origin = 'synthetic')"""
CAP = f"WITH {CAP_CTE} SELECT doc_id, true AS kept FROM o WHERE origin <> 'synthetic' UNION ALL SELECT doc_id, t <= allowed FROM s, b"


RUN_AT = "2024-01-01T{:02d}:00:00Z"  # when a commit is made: a parameter of a run


def stages_of(spark, d):
    """(stage, doc_id, action, reason) in the order of the pipeline."""
    docs = docs_of(spark, d)
    acted = lambda rows, action, reason: rows.select("doc_id", F.lit(action).alias("action"), F.lit(reason).alias("reason"))
    found = K.pii_redact(docs)
    return [
        ("rights", acted(R.rights_filter(docs).filter("NOT allowed"), "removed", "licence")),
        ("quality", acted(K.quality_filter(K.score(K.quality_signals(docs)), table(spark, d, "labels")).filter("NOT kept"), "removed", "score")),
        ("exact_dedup", acted(K.exact_dedup(docs).filter("NOT kept"), "removed", "copy")),
        ("decontaminate", acted(K.decontaminate_exact(docs, table(spark, d, "benchmark")), "removed", "benchmark")),
        ("pii", acted(found.filter("n_aadhaar + n_pan + n_bank + n_phone + n_email + n_ip > 0"), "changed", "identifier")),
        ("secrets", acted(K.secret_scan(docs).filter("n_secrets > 0"), "changed", "credential")),
    ]


def logged(spark, d):
    """A log of two runs: the second has more opt-outs, so it appends these alone."""
    path = f"{shared_dir(spark)}/granary/log-{uuid.uuid4().hex}"
    request = lambda share: docs_of(spark, d).filter(uniform("doc_id", "opt-out") < share).select("doc_id", F.lit("removed").alias("action"), F.lit("request").alias("reason"))
    stages = [(k, materialize(rows, k)) for k, rows in stages_of(spark, d)]
    version = 0
    for share in (OPT_OUT / 2, OPT_OUT):
        for stage, rows in [("opt_out", request(share)), *stages]:
            version = log.append(path, stage, rows, RUN_AT.format(version + 1)) or version
    return log.entries(spark, path)


def q_deletion_log(spark, d):
    return K.removals(logged(spark, d))


_u = uniform_sql("doc_id", "opt-out")
LOG_CTE = f"""x AS (SELECT doc_id, 1 AS version, 'opt_out' AS stage, 'removed' AS action, 'request' AS reason FROM documents WHERE {_u} < {OPT_OUT / 2}
 UNION ALL SELECT doc_id, 2, 'rights', 'removed', 'licence' FROM ({RIGHTS}) WHERE NOT allowed
 UNION ALL SELECT doc_id, 3, 'quality', 'removed', 'score' FROM ({QUALITY}) WHERE NOT kept
 UNION ALL SELECT doc_id, 4, 'exact_dedup', 'removed', 'copy' FROM ({EXACT}) WHERE NOT kept
 UNION ALL SELECT DISTINCT doc_id, 5, 'decontaminate', 'removed', 'benchmark' FROM ({DECON_EXACT})
 UNION ALL SELECT doc_id, 6, 'pii', 'changed', 'identifier' FROM ({PII}) WHERE n_aadhaar + n_pan + n_bank + n_phone + n_email + n_ip > 0
 UNION ALL SELECT doc_id, 7, 'secrets', 'changed', 'credential' FROM ({SECRETS}) WHERE n_secrets > 0
 UNION ALL SELECT doc_id, 8, 'opt_out', 'removed', 'request' FROM documents WHERE {_u} >= {OPT_OUT / 2} AND {_u} < {OPT_OUT}),
log AS (SELECT *, '2024-01-01T0' || version || ':00:00Z' AS logged_at FROM x)"""
DELETIONS = f"WITH {LOG_CTE} SELECT doc_id, stage, reason, version, logged_at AS removed_at FROM log WHERE action = 'removed'"


def q_survivors(spark, d):
    """What the log leaves, and proof that no document on record as removed is among it."""
    docs = docs_of(spark, d)
    done = materialize(logged(spark, d), "log")
    left = materialize(K.survivors(docs, done), "survivors")
    still = left.join(K.removals(done).select("doc_id"), "doc_id").agg(F.count(F.lit(1)).alias("still_there"))
    return left.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(still))  # one row on the right


SURVIVORS = f"WITH {LOG_CTE} SELECT lang, count(*) AS n, 0::BIGINT AS still_there FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM log WHERE action = 'removed') GROUP BY lang"


def q_data_card(spark, d):
    return K.data_card(docs_of(spark, d), materialize(logged(spark, d), "log"))


CARD = f"""WITH {LOG_CTE}, a AS (SELECT doc_id, stage, action, reason FROM log UNION ALL SELECT doc_id, 'kept', 'kept', '' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM log WHERE action = 'removed'))
SELECT lang, source, stage, action, reason, count(*) AS n_docs, sum(octet_length(encode(text)))::BIGINT AS n_bytes, sum(len({WORDS}))::BIGINT AS n_words FROM documents JOIN a USING (doc_id) GROUP BY ALL"""


def q_ledger(spark, d):
    docs = docs_of(spark, d)
    rows = K.ledger(docs, table(spark, d, "labels"), R.rights_filter(docs), origins(docs).select("doc_id", "origin"), logged(spark, d))
    return rows.withColumn("transformations", F.array_join("transformations", ","))


LEDGER = f"""WITH {RIGHTS_CTE}, {LOG_CTE}, {ORIGINS},
s AS (SELECT doc_id, string_agg(stage, ',' ORDER BY version) AS transformations, max(logged_at) AS changed_at, bool_or(stage = 'opt_out') AS out, arg_min(stage, version) FILTER (action = 'removed') AS first FROM log GROUP BY doc_id),
k AS (SELECT doc_id, [{", ".join(f"len(regexp_extract_all(text, '\\p{{{x}}}'))" for x in L.SCRIPTS)}] AS k FROM documents)
SELECT d.doc_id, source, licence AS rights, sha256(text) AS sha256, lang, CASE WHEN list_max(k) > 0 THEN {_scripts}[list_position(k, list_max(k))] ELSE 'none' END AS script, coalesce(transformations, '') AS transformations, changed_at,
 q.quality, source AS region, o.origin, CASE WHEN out THEN d.doc_id END AS opt_out_id, coalesce('removed:' || first, 'kept') AS status
FROM documents d LEFT JOIN k USING (doc_id) LEFT JOIN rights USING (doc_id) LEFT JOIN (SELECT doc_id, max(quality)::BIGINT AS quality FROM labels GROUP BY 1) q USING (doc_id) LEFT JOIN o USING (doc_id) LEFT JOIN s USING (doc_id)"""

REGISTRY = {
    "ledger": (q_ledger, LEDGER),
    "rights_filter": (q_rights_filter, RIGHTS),
    "rights_shares": (q_rights_shares, SHARES),
    "paragraph_lang_script": (q_paragraph_lang_script, PARAGRAPHS),
    "quality_signals": (q_quality_signals, SIGNALS),
    "quality_filter": (q_quality_filter, QUALITY),
    "exact_dedup": (q_exact_dedup, EXACT),
    "repeated_spans": (q_repeated_spans, SPANS),
    "minhash_pairs": (q_minhash_pairs, MINHASH),
    "dedup_clusters": (q_dedup_clusters, CLUSTERS),
    "semantic_clusters": (q_semantic_clusters, SEMANTIC),
    "pii_redact": (q_pii_redact, PII),
    "secret_scan": (q_secret_scan, SECRETS),
    "removal_audit": (q_removal_audit, AUDIT),
    "decontaminate_exact": (q_decontaminate_exact, DECON_EXACT),
    "decontaminate_13gram": (q_decontaminate_13gram, DECON_NGRAM),
    "decontaminate_minhash": (q_decontaminate_minhash, DECON_MINHASH),
    "decontaminate_semantic": (q_decontaminate_semantic, DECON_SEMANTIC),
    "synthetic_cap": (q_synthetic_cap, CAP),
    "data_card": (q_data_card, CARD),
    "deletion_log": (q_deletion_log, DELETIONS),
    "survivors": (q_survivors, SURVIVORS),
}
