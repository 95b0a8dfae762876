"""Registered queries of the tokenizer: training, encoding, scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.functions import config as C
from granary.functions import text as T
from granary.functions.html import parse_pages
from granary.functions.sampling import uniform_sql
from granary.operators import bpe_codec as codec
from granary.operators import bpe_train as bpe
from granary.operators import fairness as fair
from granary.operators.language import SCRIPTS
from granary.operators.mixture import exclusive_buckets, mixture_shares
from granary.plans.mixture_queries import TARGETS, conversation_languages
from granary.plans.text_queries import UNIT, WORD
from granary.sources.tables import materialize, table
from granary.sources.tokenizer_file import stats_report, tokenizer_json, tokenizer_from_json

_TRAINED: dict[tuple, bpe.Vocabulary] = {}

PIECES = r"""l AS (SELECT doc_id, lang, unnest(regexp_extract_all(text, '[^\n]*\n|[^\n]+')) AS line FROM documents),
p AS (SELECT doc_id, lang, unnest(regexp_extract_all(replace(line, ' ', '▁'), '▁[^▁]*|[^▁]+')) AS piece FROM l)"""
W = "CASE lang " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in C.WEIGHTS.items()) + " ELSE 1 END"
WEIGHTED = f"{PIECES}, c AS (SELECT piece, sum(n * {W})::BIGINT AS count FROM (SELECT lang, piece, count(*) AS n FROM p GROUP BY ALL) GROUP BY piece)"


def trained(spark, d: str) -> bpe.Vocabulary:
    """The vocabulary of the documents as they are: trained once for each content (a digest of all rows is taken every time) and size."""
    docs = table(spark, d, "documents")
    seen = docs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("lang", "text").cast("decimal(38, 0)")), F.sum(F.crc32(F.col("text").cast("binary")))).first()
    key = (*seen, C.VOCAB_SIZE, *C.WEIGHTS.items())
    if key not in _TRAINED:
        _TRAINED[key] = bpe.train(bpe.weighted_piece_counts(docs, C.WEIGHTS), C.VOCAB_SIZE, strict=False)
    return _TRAINED[key]


def docs_of(spark, d):
    return table(spark, d, "documents")


def q_metaspace_pieces(spark, d):
    rows = docs_of(spark, d).select("doc_id", F.explode(T.lines(F.col("text"))).alias("line")).select("doc_id", F.explode(T.metaspace_pieces(F.col("line"))).alias("p"))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.count(F.when(F.col("p") == "▁", 1)).alias("lone"), F.sum(F.length("p")).cast("long").alias("characters"))


METASPACE = f"WITH {PIECES} SELECT doc_id, count(*) AS pieces, count(*) FILTER (piece = '▁') AS lone, sum(length(piece))::BIGINT AS characters FROM p GROUP BY doc_id"


def q_weighted_piece_counts(spark, d):
    return bpe.weighted_piece_counts(docs_of(spark, d), C.WEIGHTS)


def q_alphabet(spark, d):
    return bpe.alphabet(bpe.piece_counts(docs_of(spark, d)))


ALPHABET = f"WITH {PIECES}, s AS (SELECT DISTINCT unnest(regexp_extract_all(piece, '(?s).')) AS token FROM p) SELECT row_number() OVER (ORDER BY token)::INT AS id, token FROM s"


def q_pair_counts(spark, d):
    words = bpe.weighted_piece_counts(docs_of(spark, d), C.WEIGHTS).select(bpe.wrap(F.col("piece")).alias("wrapped"), "count")
    return bpe.pair_counts(words)


PAIRS = f"""WITH {WEIGHTED}, s AS (SELECT regexp_extract_all(piece, '(?s).') AS s, count FROM c)
SELECT s[i] AS "left", s[i + 1] AS "right", sum(count)::BIGINT AS count FROM s, unnest(range(1, len(s))) AS u(i) GROUP BY ALL"""


def q_bpe_train(spark, d):
    return bpe.merges_frame(spark, trained(spark, d))


def q_byte_fallback_vocab(spark, d):
    """Byte entries behind the alphabet of the corpus."""
    first = bpe.alphabet(bpe.piece_counts(docs_of(spark, d))).count() + 1
    return bpe.byte_fallback_vocab(spark, first)


BYTES = f"WITH {PIECES}, s AS (SELECT count(DISTINCT ch) + 1 AS first FROM (SELECT unnest(regexp_extract_all(piece, '(?s).')) AS ch FROM p)) SELECT (first + b)::INT AS id, printf('<0x%02X>', b) AS token, 'byte' AS kind FROM s, range(256) AS r(b)"


def q_vocab_composition(spark, d):
    """Entries by kind; those of one character are the alphabet."""
    vocab = bpe.vocab_frame(spark, trained(spark, d))
    vocab = vocab.withColumn("kind", F.when((F.col("kind") == "merge") & (F.length("token") == 1), "alphabet").otherwise(F.col("kind")))
    return bpe.vocab_composition(vocab).select("kind", "entries")


# entries that merges made are those that are left beside the alphabet, the unknown token and the bytes
COMPOSITION = f"""WITH {PIECES}, a AS (SELECT count(DISTINCT ch) AS n FROM (SELECT unnest(regexp_extract_all(piece, '(?s).')) AS ch FROM p))
SELECT * FROM (SELECT 'special' AS kind, 1::BIGINT AS entries UNION ALL SELECT 'byte', 256 UNION ALL SELECT 'alphabet', n FROM a UNION ALL SELECT 'merge', {C.VOCAB_SIZE} - 257 - n FROM a)"""


def q_vocab_table(spark, d):
    v = trained(spark, d)
    return bpe.vocab_table(bpe.vocab_frame(spark, v), bpe.merges_frame(spark, v))


def q_vocab_search(spark, d):
    return bpe.vocab_search(q_vocab_table(spark, d), "en", page=1)


def q_tokenizer_artifact(spark, d):
    """The vocabulary after a round trip through its file form."""
    back = tokenizer_from_json(tokenizer_json(trained(spark, d)))
    return bpe.vocab_table(bpe.vocab_frame(spark, back), bpe.merges_frame(spark, back))


def q_encode(spark, d):
    return codec.encode(docs_of(spark, d), trained(spark, d)).select("doc_id", F.size("ids").cast("long").alias("tokens"), F.xxhash64("ids").alias("ids_hash"))


def q_decode(spark, d):
    v = trained(spark, d)
    return codec.decode(codec.encode(docs_of(spark, d), v), v).select("doc_id", F.sha2("decoded", 256).alias("sha256"))


DECODE = "SELECT doc_id, sha256(replace(text, '▁', ' ')) AS sha256 FROM documents"


def q_parse_token_ids(spark, d):
    """Id lists written as text (from n_chars and doc_id, some of them faulty) parsed again."""
    docs = docs_of(spark, d)
    raw = F.concat(F.lit("["), F.col("doc_id").cast("string"), F.lit(", "), F.col("n_chars").cast("string"), F.when(F.col("doc_id") % 7 == 0, F.lit(" x")).otherwise(F.lit(" 3")), F.lit("]"))
    rows = docs.select("doc_id", codec.parse_token_ids(raw, 5000).alias("p"))
    return rows.select("doc_id", F.array_join("p.ids", ",").alias("ids"), F.col("p.error").alias("error"))


PARSE = """SELECT doc_id, CASE WHEN doc_id % 7 <> 0 AND doc_id < 5000 AND n_chars < 5000 THEN doc_id || ',' || n_chars || ',3' END AS ids,
CASE WHEN doc_id % 7 = 0 THEN 'not a list of numbers' WHEN doc_id >= 5000 OR n_chars >= 5000 THEN 'out of range' END AS error FROM documents"""


def q_encode_tokens(spark, d):
    return codec.token_usage(docs_of(spark, d), trained(spark, d))


def q_playground_stats(spark, d):
    return codec.playground_stats(docs_of(spark, d), trained(spark, d)).select("doc_id", "words", "units", (F.col("tokens") >= F.col("words")).alias("enough"))


PLAYGROUND = f"SELECT doc_id, len(regexp_extract_all(text, '{WORD}')) AS words, len(regexp_extract_all(text, '{UNIT}')) AS units, true AS enough FROM documents"


def q_roundtrip_gate(spark, d):
    rows = codec.roundtrip(docs_of(spark, d), trained(spark, d))
    n = lambda c: F.count(F.when(F.col(c), 1)).alias(c)
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), n("exact"), n("visible_equal"), n("ids_in_range"))


ROUNDTRIP = "SELECT lang, count(*) AS n, count(*) AS exact, count(*) AS visible_equal, count(*) AS ids_in_range FROM documents GROUP BY lang"


def q_roundtrip_failures(spark, d):
    """Texts in which blanks before a to m are written, in every third document, as the sign that stands for blanks in tokens: those cannot come back as they were, and are listed."""
    docs = docs_of(spark, d)
    broken = docs.withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.regexp_replace("text", " ([a-m])", "▁$1")).otherwise(F.col("text")))
    return codec.roundtrip_failures(codec.roundtrip(broken, trained(spark, d)))


# ▁ comes back as a blank, which is not visible: both comparisons fail where there is one
FAILURES = r"""SELECT doc_id, lang, failure FROM documents, (VALUES ('exact'), ('visible_equal')) AS v(failure) WHERE (doc_id % 3 = 0 AND regexp_matches(text, ' [a-m]')) OR contains(text, '▁')"""


def q_unknown_tokens(spark, d):
    return codec.unknown_tokens(docs_of(spark, d), trained(spark, d))


UNKNOWN = "SELECT lang, 0::BIGINT AS unknown FROM documents GROUP BY lang"


def ratios_of_tokens(spark, d):
    return fair.language_ratios(docs_of(spark, d), trained(spark, d))


def q_language_ratios(spark, d):
    """Ratios joined to what they were measured on."""
    return fair.ratios_with_records(ratios_of_tokens(spark, d), fair.source_records(docs_of(spark, d)))


def q_source_records(spark, d):
    return fair.source_records(docs_of(spark, d))


RECORDS = f"""WITH k AS (SELECT lang, [{", ".join(f"sum(len(regexp_extract_all(text, '\\p{{{x}}}')))" for x in SCRIPTS)}]::BIGINT[] AS k FROM documents GROUP BY lang)
SELECT lang, CASE WHEN list_max(any_value(k)) > 0 THEN [{", ".join(f"'{x}'" for x in SCRIPTS)}][list_position(any_value(k), list_max(any_value(k)))] ELSE 'none' END AS script, count(DISTINCT source) AS sources, count(*) AS documents,
 sum(octet_length(encode(text)))::BIGINT AS bytes, sum(len(regexp_extract_all(text, '{WORD}')))::BIGINT AS words, sum(len(regexp_extract_all(text, '{UNIT}')))::BIGINT AS units FROM documents JOIN k USING (lang) GROUP BY lang"""


def q_mixture_shares_of_tokens(spark, d):
    """Shares by the tokens of the final tokenizer."""
    docs = docs_of(spark, d)
    tokens = codec.encode(docs, trained(spark, d)).select("doc_id", F.size("ids").cast("long").alias("tokens"))
    return mixture_shares(exclusive_buckets(docs), tokens, TARGETS)


def q_fairness_of_tokens(spark, d):
    return fair.fairness_score(ratios_of_tokens(spark, d), C.PENALTY_LANG)


def q_ratio_gate_of_tokens(spark, d):
    return fair.ratio_gate(ratios_of_tokens(spark, d).select("lang", "ratio"))


def q_fertility_gate_of_tokens(spark, d):
    """Mean tokens a word against the ceiling of each language that has one, macro mean, maximum, and byte fallback."""
    found = q_fertility(spark, d).select("lang", F.col("mean").alias("ratio"), "byte_share")
    return fair.fertility_gate(found, C.CEILINGS | C.NATIVE_CEILINGS)


def piece_ratios(spark, d):
    """lang, ratio of metaspace pieces to units: the scoring on a tokenization that SQL can repeat."""
    rows = docs_of(spark, d).select("lang", F.size(T.metaspace_pieces(F.col("text"))).alias("p"), T.faithful_units(F.col("text")).alias("u"))
    return rows.groupBy("lang").agg((F.sum("p") / F.sum("u")).alias("ratio"))


RATIOS = f"r AS (SELECT lang, sum(len(regexp_extract_all(replace(text, ' ', '▁'), '▁[^▁]*|[^▁]+')))::DOUBLE / sum(len(regexp_extract_all(text, '{UNIT}'))) AS ratio FROM documents GROUP BY lang)"


def rounded(df, *columns):
    return df.withColumns({c: F.round(c, 9) for c in columns})


def q_fairness_score(spark, d):
    return fair.fairness_score(piece_ratios(spark, d), C.PENALTY_LANG).select(F.round("spread", 9).alias("spread"), F.round("score", 6).alias("score"), F.round("penalty", 9).alias("penalty"), F.round("adjusted", 6).alias("adjusted"))


SCORE = f"""WITH {RATIOS}, o AS (SELECT max(ratio) - min(ratio) AS spread, max(ratio) FILTER (lang = '{C.PENALTY_LANG}') AS p FROM r),
s AS (SELECT spread, 1000 / spread AS score, exp(greatest(0, p / 1.2 - 1)) AS penalty FROM o)
SELECT round(spread, 9) AS spread, round(score, 6) AS score, round(penalty, 9) AS penalty, round(score / penalty, 6) AS adjusted FROM s"""


def q_ratio_gate(spark, d):
    return rounded(fair.ratio_gate(piece_ratios(spark, d), 0.6), "ratio")


RATIO_GATE = f'WITH {RATIOS} SELECT lang, round(ratio, 9) AS ratio, row_number() OVER (ORDER BY ratio, lang) AS rank, ratio <= 0.6 AS "pass" FROM r'


def q_verify_stats(spark, d):
    """Recounted units and words by language against stored ones, of which one language's are off by one."""
    found = T.corpus_summary(docs_of(spark, d)).select("lang", "words", "faithful_units")
    stored = found.withColumn("words", F.col("words") + F.when(F.col("lang") == "de", 1).otherwise(0))
    return fair.verify_stats(stored, found, ["words", "faithful_units"])


VERIFY = f"SELECT lang, 'words' AS field, (w + 1)::DOUBLE AS stored, w::DOUBLE AS found FROM (SELECT lang, sum(len(regexp_extract_all(text, '{WORD}'))) AS w FROM documents WHERE lang = 'de' GROUP BY lang)"


def q_cross_corpus_eval(spark, d):
    """Ratios of one vocabulary by corpus and language, and each corpus's spread and score: documents, conversations (their language by learned profiles) and pages as Markdown."""
    docs = docs_of(spark, d).select(F.lit("documents").alias("corpus"), "lang", "text")
    chats = table(spark, d, "conversations").join(conversation_languages(spark, d), "conv_id").select(F.lit("conversations").alias("corpus"), "lang", "text")
    pages = table(spark, d, "pages")
    lang = pages.select("page_id", F.regexp_extract("html", 'lang="([a-z]+)"', 1).alias("lang"))
    pages = parse_pages(pages).join(lang, "page_id").select(F.lit("pages").alias("corpus"), "lang", F.col("markdown").alias("text"))
    return fair.corpus_spread(materialize(fair.language_ratios(docs.unionByName(chats).unionByName(pages), trained(spark, d), "corpus"), "corpus-ratios"))


def q_fertility(spark, d):
    return fair.fertility(docs_of(spark, d), trained(spark, d))


def q_fertility_gate(spark, d):
    words = docs_of(spark, d).select("lang", F.size(T.metaspace_pieces(F.col("text"))).alias("p"), T.word_count(F.col("text")).alias("w"))
    return rounded(fair.fertility_gate(words.groupBy("lang").agg((F.sum("p") / F.sum("w")).alias("ratio")), C.CEILINGS), "value")


CEIL = "CASE lang " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in C.CEILINGS.items()) + " END"
FERTILITY_GATE = f"""WITH r AS (SELECT lang, sum(len(regexp_extract_all(replace(text, ' ', '▁'), '▁[^▁]*|[^▁]+')))::DOUBLE / sum(len(regexp_extract_all(text, '{WORD}'))) AS ratio FROM documents GROUP BY lang),
s AS (SELECT lang AS scope, ratio AS value, {CEIL}::DOUBLE AS threshold FROM r UNION ALL SELECT 'macro', avg(ratio), 1.95 FROM r UNION ALL SELECT 'maximum', max(ratio), 3.0 FROM r)
SELECT scope, round(value, 9) AS value, threshold, value <= threshold AS "pass" FROM s"""


def q_source_disjoint_split(spark, d):
    return fair.source_disjoint_split(docs_of(spark, d), 0.25, "eval")


SPLIT = f"SELECT doc_id, source, CASE WHEN {uniform_sql('source', 'eval')} < 0.25 THEN 'eval' ELSE 'train' END AS split FROM documents"


def q_domain_density(spark, d):
    rows = table(spark, d, "events").select("event_type", fair.json_atoms(F.col("props")).alias("atoms"), F.length("props").alias("chars"))
    return rows.groupBy("event_type").agg(F.sum("atoms").alias("atoms"), F.sum("chars").cast("long").alias("characters"))


DENSITY = r"""SELECT event_type, sum(len(regexp_extract_all(props, '"(?:[^"\\]|\\.)*"|-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null|[\[\]{},:]')))::BIGINT AS atoms, sum(length(props))::BIGINT AS characters FROM events GROUP BY 1"""


def q_domain_density_tokens(spark, d):
    rows = table(spark, d, "events").select("event_type", F.col("props").alias("text"), fair.json_atoms(F.col("props")).alias("atoms"))
    rows = codec.encode(rows, trained(spark, d)).groupBy("event_type").agg((F.sum(F.size("ids")) / F.sum("atoms")).alias("tokens_per_atom"))
    return rows.withColumn("pass", F.col("tokens_per_atom") <= 1.2)


def q_stats_report(spark, d):
    return stats_report(ratios_of_tokens(spark, d), trained(spark, d), C.WEIGHTS)


def q_tune_weights(spark, d):
    """Tuned weights of the full vocabulary, the first spread and the smallest."""
    docs, v = docs_of(spark, d), trained(spark, d)
    counts = materialize(bpe.piece_counts(docs), "piece-counts")
    ratios = lambda v: {r.lang: r.ratio for r in fair.language_ratios(docs, v).collect()}  # noqa: E731  one row a language
    best, spreads = bpe.tune_weights(counts, C.WEIGHTS, ratios, C.VOCAB_SIZE, first=v)
    return spark.createDataFrame([(k, C.WEIGHTS[k], w, spreads[0], min(spreads)) for k, w in best.items()], "lang string, first_weight int, weight double, first_spread double, spread double")


def q_superword_train(spark, d):
    """Second-stage merges, all of which cross a space."""
    _, merges = codec.superword_train(docs_of(spark, d), trained(spark, d), C.SUPERWORDS)
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(merges)], "rank int, left string, right string")


REGISTRY = {
    "metaspace_pieces": (q_metaspace_pieces, METASPACE),
    "weighted_piece_counts": (q_weighted_piece_counts, f"WITH {WEIGHTED} SELECT piece, count FROM c"),
    "alphabet": (q_alphabet, ALPHABET),
    "pair_counts": (q_pair_counts, PAIRS),
    "bpe_train": (q_bpe_train, None),
    "byte_fallback_vocab": (q_byte_fallback_vocab, BYTES),
    "vocab_composition": (q_vocab_composition, COMPOSITION),
    "vocab_table": (q_vocab_table, None),
    "vocab_search": (q_vocab_search, None),
    "tune_weights": (q_tune_weights, None),
    "superword_train": (q_superword_train, None),
    "tokenizer_artifact": (q_tokenizer_artifact, None),
    "stats_report": (q_stats_report, None),
    "encode": (q_encode, None),
    "decode": (q_decode, DECODE),
    "parse_token_ids": (q_parse_token_ids, PARSE),
    "encode_tokens": (q_encode_tokens, None),
    "playground_stats": (q_playground_stats, PLAYGROUND),
    "roundtrip_gate": (q_roundtrip_gate, ROUNDTRIP),
    "roundtrip_failures": (q_roundtrip_failures, FAILURES),
    "unknown_tokens": (q_unknown_tokens, UNKNOWN),
    "language_ratios": (q_language_ratios, None),
    "source_records": (q_source_records, RECORDS),
    "mixture_shares_of_tokens": (q_mixture_shares_of_tokens, None),
    "fairness_of_tokens": (q_fairness_of_tokens, None),
    "ratio_gate_of_tokens": (q_ratio_gate_of_tokens, None),
    "fertility_gate_of_tokens": (q_fertility_gate_of_tokens, None),
    "fairness_score": (q_fairness_score, SCORE),
    "ratio_gate": (q_ratio_gate, RATIO_GATE),
    "verify_stats": (q_verify_stats, VERIFY),
    "cross_corpus_eval": (q_cross_corpus_eval, None),
    "fertility": (q_fertility, None),
    "fertility_gate": (q_fertility_gate, FERTILITY_GATE),
    "source_disjoint_split": (q_source_disjoint_split, SPLIT),
    "domain_density": (q_domain_density, DENSITY),
    "domain_density_tokens": (q_domain_density_tokens, None),
}
