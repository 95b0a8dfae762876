"""DuckDB SQL for the queries that SQL can express."""

from granary.llm import centroids as C
from granary.llm import mixing as M
from granary.llm import quality_rules as Q
from granary.llm import source_divergence as D
from granary.llm import topk_search as T

WS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

MIX = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '{M.SEED}'), 1, 8))::BIGINT AS u FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, [{", ".join(map(str, M.WEIGHTS))}][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % {len(M.WEIGHTS)} + 1)::INT]::BIGINT AS weight,
             source_size * {M.MAX_EPOCHS} AS cap FROM s),
-- sources by cap for each unit of weight: the first k are clamped, for the least k at which the next is not above its cap
o AS (SELECT *, row_number() OVER (ORDER BY cap::DOUBLE / weight, source) - 1 AS k,
             coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
             sum(weight) OVER (ORDER BY cap::DOUBLE / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w,
             (sum(source_size) OVER ()) * {int(2 * M.BUDGET)} AS twice FROM r),
f AS (SELECT min(k) AS k FROM o WHERE weight * (twice - 2 * held) <= cap * 2 * w),
c AS (SELECT (twice - 2 * held)::BIGINT AS num, w::BIGINT AS w, o.k FROM o JOIN f ON o.k = f.k),
p AS (SELECT o.source, o.source_size,
             CASE WHEN c.k IS NULL OR o.k < c.k OR o.cap <= 0 THEN o.cap::DOUBLE ELSE (o.weight * c.num)::DOUBLE / (2 * c.w)::DOUBLE END AS target
      FROM o LEFT JOIN c ON true),
q AS (SELECT *, floor(target + 0.5)::BIGINT AS words FROM p),
e AS (SELECT *, CASE WHEN source_size > 0 THEN words // source_size ELSE 0 END AS copies FROM q),
g AS (SELECT d.doc_id, d.size, e.source_size, e.target, e.copies, e.words - e.copies * e.source_size AS rest,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.u, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, (copies * size + greatest(0, least(size, rest - before)))::BIGINT AS taken FROM g
"""

EXACT = rf"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS pts, regexp_replace(coalesce(text, ''), '{WS}', '', 'g') AS t FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER w = 1 AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t ORDER BY pts DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
"""


def _listed(words):
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def quality() -> str:
    every = sorted({w for ws in Q.COMMON_WORDS.values() for w in ws})
    classes = Q.CHAR_CLASSES
    n_c, n_w = len(classes) + 1, len(next(iter(Q.COMMON_WORDS.values()))) + 1
    counts = ", ".join(f"len(regexp_extract_all(t, '{c}'))" for c in classes)
    case = " ".join(f"WHEN '{k}' THEN {_listed(ws)}" for k, ws in Q.COMMON_WORDS.items())

    def bins(p, q, n):
        p, q = [f"({p}[{i}]::DOUBLE / {p}_n)" for i in range(1, n + 1)], [f"({q}[{i}]::DOUBLE / {q}_n)" for i in range(1, n + 1)]
        term = lambda a, b: f"(CASE WHEN {a} > 0 THEN {a} * log2(2.0 * {a} / ({a} + {b})) ELSE 0 END)"
        return "sqrt(greatest(0, " + " + ".join(f"0.5 * ({term(a, b)} + {term(b, a)})" for a, b in zip(p, q)) + "))"

    return rf"""
WITH t AS (SELECT doc_id, lang, coalesce(text, '') AS t, row_number() OVER () AS rid FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{WORD}') AS words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
             CASE lang {case} END AS listed FROM t),
g AS (SELECT rid, i, array_to_string(words[i : i + {Q.REPEAT_WINDOW - 1}], ' ') AS gram FROM w, unnest(range(1, len(words) - {Q.REPEAT_WINDOW - 2})) AS u(i)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS n FROM g) WHERE n > 1),
v AS (SELECT rid, sum(least({Q.REPEAT_WINDOW}, coalesce(nxt - i, {Q.REPEAT_WINDOW})))::BIGINT AS n_repeat_words
      FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM r) GROUP BY rid),
a AS (SELECT rid, doc_id, lang, len(words)::BIGINT AS n_words, length(regexp_replace(t, '{WS}+', '', 'g'))::BIGINT AS word_chars,
             len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
             [{counts}] AS c4, length(t) AS n_chars, listed, list_filter(list_transform(words, lambda x: lower(x)), lambda x: list_contains({_listed(every)}, x)) AS common FROM w),
b AS (SELECT *, list_append(c4, n_chars - list_sum(c4)) AS chars, list_transform(listed, lambda x: len(list_filter(common, lambda y: y = x))) AS pw FROM a),
d AS (SELECT * EXCLUDE (c4, common), CASE WHEN listed IS NOT NULL THEN list_append(pw, n_words - list_sum(pw)) END AS commons FROM b),
e AS (SELECT d.*, coalesce(v.n_repeat_words, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN v USING (rid)),
b2 AS (SELECT *, n_words < {Q.MIN_WORDS} OR 100 * n_repeat_words > {Q.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM e),
f AS (SELECT lang AS l, [{", ".join(f"sum(chars[{i}])" for i in range(1, n_c + 1))}] AS rc, [{", ".join(f"sum(commons[{i}])" for i in range(1, n_w + 1))}] AS rw, [{", ".join("0" * (n_w - 1))}, 1] AS zero, 1::DOUBLE AS zero_n
      FROM b2 WHERE NOT base_failed GROUP BY lang),
h AS (SELECT *, list_sum(rc)::DOUBLE AS rc_n, list_sum(rw)::DOUBLE AS rw_n FROM f),
h2 AS (SELECT *, CASE WHEN rw_n > 0 THEN {Q.WORD_LIMIT} * {bins("zero", "rw", n_w)} END AS word_limit FROM h),
j AS (SELECT b2.*, rc, rw, rc_n, rw_n, word_limit, list_sum(chars)::DOUBLE AS chars_n, list_sum(commons)::DOUBLE AS commons_n FROM b2 LEFT JOIN h2 ON b2.lang IS NOT DISTINCT FROM h2.l),
k AS (SELECT *, CASE WHEN word_chars >= {Q.GUARD_CHARS} AND rc_n > 0 THEN {bins("chars", "rc", n_c)} END AS cd,
             CASE WHEN n_words >= {Q.GUARD_WORDS} AND rw_n > 0 THEN {bins("commons", "rw", n_w)} END AS wd FROM j)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(cd, 0) <= {Q.MAX_CHAR_DISTANCE} AND coalesce(wd <= word_limit, true) AS kept FROM k
"""


CHAT = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, length(replace(replace(text, '~', '~0'), '<', '~1')) + length(replace(replace(replace(role, '~', '~0'), '<', '~1'), '>', '~2')) + 15 AS chars FROM t),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
             coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss, sum(chars)::BIGINT AS formatted_chars FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
"""

NGRAMS = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS gram FROM w, unnest(range(1, greatest(len(w) - 1, 2))) AS u(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
h AS (SELECT doc_id, md5(string_agg(gram, chr(10) ORDER BY gram)) AS h FROM g GROUP BY doc_id),
k AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS k FROM h),
r AS (SELECT g.doc_id, gram FROM g JOIN k USING (doc_id) WHERE doc_id = k.k),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM r a JOIN r b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
t(id, root) AS (SELECT a, a FROM e UNION SELECT e.b, t.root FROM t JOIN e ON e.a = t.id),
m AS (SELECT id, min(root) AS root FROM t GROUP BY id)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m.root, k.k, w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id) LEFT JOIN m ON m.id = k.k
"""

REPEATS = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS w FROM d, unnest(range(0, length(h) // 2 - 49)) AS u(i)),
g AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY w) AS first FROM w) WHERE first < doc_id),
-- removed runs: windows that begin within 50 bytes of the one before join up
s AS (SELECT doc_id, i, sum(CASE WHEN i - p <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run
      FROM (SELECT doc_id, i, coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -1000) AS p FROM g)),
r AS (SELECT doc_id, run, min(i) AS a, max(i) + 50 AS b FROM s GROUP BY ALL),
k AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS f, a AS t, b, lead(a) OVER (PARTITION BY doc_id ORDER BY a) IS NULL AS final FROM r),
t AS (SELECT k.doc_id, sum(b - t)::BIGINT AS n_removed, count(*) AS n_spans,
             string_agg(substr(h, 2 * f + 1, 2 * (t - f)) || CASE WHEN final THEN substr(h, 2 * b + 1) ELSE '' END, '' ORDER BY t) AS kept
      FROM k JOIN d USING (doc_id) GROUP BY k.doc_id)
SELECT d.doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id)
"""

FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0"

TOP = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda v: floor({T.SCALE} * v::DOUBLE)::BIGINT) AS x, row_number() OVER () AS rid FROM embeddings WHERE {FINITE}),
s AS (SELECT q.vec_id AS query_id, q.rid, c.vec_id, c.rid AS other, coalesce(list_sum(list_transform(list_zip(q.x, c.x), lambda z: coalesce(z[1], 0) * coalesce(z[2], 0))), 0)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % {T.QUERY_STEP} = 0 AND q.rid <> c.rid),
r AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id NULLS LAST, other)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {T.K}
"""

_lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_p = lambda count, total: f"(1 + {D.WHOLE}::HUGEINT * ({count} + {D.SMOOTH}) // ({total} + {D.SMOOTH} * v))"
DIVERGENCE = rf"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_lower} AS text, row_number() OVER () AS rid FROM documents),
w AS (SELECT lang, source, rid, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM d),
k AS (SELECT lang, t, count(*) AS lang_n FROM w GROUP BY ALL HAVING count(DISTINCT rid) >= {D.MIN_DOCS}),
c AS (SELECT lang, source, t, count(*) AS n FROM w SEMI JOIN k USING (lang, t) GROUP BY ALL),
l AS (SELECT lang, count(t) AS v, coalesce(sum(lang_n), 0) AS lang_total FROM (SELECT DISTINCT lang FROM d) LEFT JOIN k USING (lang) GROUP BY lang),
g AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.t, coalesce(n, 0) AS n, {_p("coalesce(n, 0)", "total")} AS p, {_p("lang_n", "lang_total")} AS q
      FROM g JOIN l USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.t = k.t),
s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p))::BIGINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.t = b.t AND a.source <> b.source GROUP BY ALL),
x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
      UNION ALL SELECT lang, source, 'term', t, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM x)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= {D.TOP}
"""


def clusters() -> str:
    """Rounds are tables, one after the other."""
    seeds = f"row_number() OVER (ORDER BY sha256('{C.SALT}' || vec_id::VARCHAR) NULLS LAST, x)"
    # the distance and the number of the nearest centroid as one integer
    near = lambda c: f"SELECT rid, any_value(x) AS x, min(list_sum(list_transform(range(1, {C.DIMS + 1}), lambda i: (x[i] - m[i]) * (x[i] - m[i])))::BIGINT * {C.K} + c) AS best FROM v, {c} GROUP BY rid"
    whole = "(sum(x[i]) - ((sum(x[i]) % count(*)) + count(*)) % count(*)) // count(*)"
    rounds = ""
    for r in range(C.ROUNDS):
        rounds += f"""
a{r} AS MATERIALIZED ({near(f"c{r}")}),
u{r} AS (SELECT c, list(s ORDER BY i) AS m FROM (SELECT best % {C.K} AS c, i, {whole} AS s FROM a{r}, range(1, {C.DIMS + 1}) AS t(i) GROUP BY ALL) GROUP BY c),
c{r + 1} AS MATERIALIZED (SELECT c, coalesce(u{r}.m, c{r}.m)::BIGINT[] AS m FROM c{r} LEFT JOIN u{r} USING (c)),"""
    return f"""
WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda v: floor({C.SCALE} * v::DOUBLE)::BIGINT) AS x, row_number() OVER () AS rid FROM embeddings WHERE {FINITE} AND len(embedding) = {C.DIMS}),
c0 AS MATERIALIZED (SELECT {seeds} - 1 AS c, x AS m FROM v QUALIFY {seeds} <= {C.K}),{rounds}
f AS (SELECT rid, best % {C.K} AS c, best // {C.K} AS d FROM ({near(f"c{C.ROUNDS}")}))
SELECT vec_id, c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM f JOIN v USING (rid) JOIN c{C.ROUNDS} USING (c)
"""


ORACLE = {"op1_mixing": MIX, "op3_exact_dedup": EXACT, "op5_suffix_dedup": REPEATS, "op6_quality_rules": quality(), "op7_ngram_join": NGRAMS, "op9_chat_format": CHAT}
ORACLE |= {"op11_topk_search": TOP, "op12_source_divergence": DIVERGENCE, "op13_centroid_clustering": clusters()}
