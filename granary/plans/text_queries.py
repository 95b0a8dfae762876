"""Registered queries over pages and documents: reading, cleaning, measuring."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from granary.functions import html, text as T
from granary.functions.sampling import uniform, uniform_sql
from granary.sources.tables import materialize, read_documents, read_pages, read_snapshots, shared_dir, table, write_snapshots

# The same classes in RE2.
WS = r"[\t-\r\x1c-\x1f\x20\x{85}\p{Z}]"
WORD = r"[^\t-\r\x1c-\x1f\x20\x{85}\p{Z}]+"
UNIT = r"[\p{L}\p{M}\p{N}]+|[^\t-\r\x1c-\x1f\x20\x{85}\p{Z}\p{L}\p{M}\p{N}]"


def q_read_pages(spark, d):
    return read_pages(spark, d).select("page_id", "url", "host", "path", F.length("html").cast("long").alias("html_chars"), F.sha2("html", 256).alias("sha256"))


READ_PAGES = r"""SELECT page_id, url, regexp_extract(url, '^https?://([^/]*)', 1) AS host, regexp_extract(url, '^https?://[^/]*([^?#]*)', 1) AS path,
 length(html) AS html_chars, sha256(html) AS sha256 FROM pages"""


def q_read_documents(spark, d):
    return read_documents(spark, d).select("doc_id", "lang", "source", "n_chars", F.length("text").cast("long").alias("characters"), F.sha2("text", 256).alias("sha256"))


READ_DOCUMENTS = "SELECT doc_id, lang, source, n_chars, length(text) AS characters, sha256(text) AS sha256 FROM documents"


def q_training_lines(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("line_no", "line")).withColumn("line_no", F.col("line_no").cast("long"))


TRAINING_LINES = r"""SELECT doc_id, i - 1 AS line_no, l[i] AS line FROM (SELECT doc_id, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS l FROM documents), unnest(range(1, len(l) + 1)) AS u(i)"""


def q_write_snapshots(spark, d):
    docs = table(spark, d, "documents")
    path = f"{shared_dir(spark)}/granary/snapshots-{uuid.uuid4().hex}"
    write_snapshots(docs, path)
    texts, manifest = read_snapshots(spark, path, docs.schema)
    bad = T.integrity_check(manifest, T.snapshot_records(texts), "doc_id", ["sha256", "bytes", "characters", "words", "faithful_units"])
    per = texts.groupBy("lang").agg(F.count(F.lit(1)).alias("n_texts"))
    rec = manifest.groupBy("lang").agg(F.count(F.lit(1)).alias("n_records"), F.sum("bytes").alias("bytes"))
    one = bad.agg(F.count(F.lit(1)).alias("mismatches"))
    return per.join(rec, "lang").crossJoin(F.broadcast(one))  # one row on the right


WRITE_SNAPSHOTS = "SELECT lang, count(*) AS n_texts, count(*) AS n_records, sum(octet_length(encode(text)))::BIGINT AS bytes, 0::BIGINT AS mismatches FROM documents GROUP BY lang"


def q_write_page_snapshots(spark, d):
    """Pages cleaned to Markdown, with their language from the html element, written with a manifest, read again and checked."""
    pages = table(spark, d, "pages")
    lang = F.coalesce(F.nullif(F.regexp_extract("html", '<html[^>]* lang="([a-z]+)"', 1), F.lit("")), F.lit("und"))
    named = pages.select(F.col("page_id").alias("doc_id"), lang.alias("lang"), F.regexp_extract("url", "^https?://([^/]*)", 1).alias("source"))
    cleaned = html.parse_pages(pages).select(F.col("page_id").alias("doc_id"), T.normalize_markdown(F.col("markdown")).alias("text"))
    docs = materialize(cleaned.join(named, "doc_id").select("doc_id", "text", "lang", "source"), "cleaned-pages")
    path = f"{shared_dir(spark)}/granary/page-snapshots-{uuid.uuid4().hex}"
    write_snapshots(docs, path)
    texts, manifest = read_snapshots(spark, path, docs.schema)
    fields = ["sha256", "bytes", "characters", "words", "faithful_units"]
    bad = T.integrity_check(manifest, T.snapshot_records(texts), "doc_id", fields).unionByName(T.integrity_check(manifest, T.snapshot_records(docs), "doc_id", fields))
    per = texts.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n_texts"))
    rec = manifest.join(named.select("doc_id", "source"), "doc_id").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n_records"))
    return per.join(rec, ["lang", "source"]).crossJoin(F.broadcast(bad.agg(F.count(F.lit(1)).alias("mismatches"))))  # one row on the right


WRITE_PAGE_SNAPSHOTS = """SELECT coalesce(nullif(regexp_extract(html, '<html[^>]* lang="([a-z]+)"', 1), ''), 'und') AS lang, regexp_extract(url, '^https?://([^/]*)', 1) AS source, count(*) AS n_texts, count(*) AS n_records, 0::BIGINT AS mismatches FROM pages GROUP BY 1, 2"""


def q_strip_technical_nodes(spark, d):
    rows = html.parse_pages(table(spark, d, "pages"))
    left = F.col("markdown").contains("track(") | F.col("markdown").contains("margin:0")
    return rows.select("page_id", left.alias("technical_left"), (F.length("markdown") > 0).alias("has_text"))


STRIP = "SELECT page_id, false AS technical_left, true AS has_text FROM pages"


def q_absolute_links(spark, d):
    rows = html.parse_pages(table(spark, d, "pages")).select("page_id", F.posexplode("links").alias("n", "l"))
    return rows.select("page_id", F.col("n").cast("long").alias("n"), F.col("l.tag").alias("tag"), F.col("l.url").alias("url"), F.col("l.text").alias("text"))


ABSOLUTE_LINKS = r"""SELECT page_id, i - 1 AS n, 'a' AS tag, regexp_extract(url, '^(https?://[^/]*)', 1) || regexp_extract(a[i], 'href="([^"]*)"', 1) AS url, regexp_extract(a[i], '>([^<]*)<', 1) AS text
 FROM (SELECT page_id, url, regexp_extract_all(html, '<a href="/[^"]*">[^<]*</a>') AS a FROM pages), unnest(range(1, len(a) + 1)) AS u(i)"""


def q_html_to_markdown(spark, d):
    rows = html.parse_pages(table(spark, d, "pages"))
    m = F.col("markdown")
    return rows.select("page_id", F.regexp_count(m, F.lit(r"(?m)^# ")).cast("long").alias("headings"), F.regexp_count(m, F.lit(r"(?m)^- \[")).cast("long").alias("bullets"), F.regexp_count(m, F.lit(r"\]\(https?://")).cast("long").alias("links"), m.endswith("\n").alias("ends_line"))


HTML_TO_MARKDOWN = r"""SELECT page_id, len(regexp_extract_all(html, '<h1>')) AS headings, len(regexp_extract_all(html, '<li><a ')) AS bullets, len(regexp_extract_all(html, '<a href=')) AS links, true AS ends_line FROM pages"""


def q_normalize_markdown(spark, d):
    rows = table(spark, d, "documents").select("doc_id", T.normalize_markdown(F.col("text")).alias("t"))
    return rows.select("doc_id", F.length("t").cast("long").alias("characters"), F.sha2("t", 256).alias("sha256"))


NORMALIZE = rf"""WITH a AS (SELECT doc_id, regexp_replace(replace(text, chr(160), ' '), '[ \t]+\n', chr(10), 'g') AS t FROM documents),
b AS (SELECT doc_id, regexp_replace(t, '\n{{4,}}', chr(10) || chr(10) || chr(10), 'g') AS t FROM a),
c AS (SELECT doc_id, regexp_replace(regexp_replace(t, '\A{WS}+', ''), '{WS}+\z', '') || chr(10) AS t FROM b)
SELECT doc_id, length(t) AS characters, sha256(t) AS sha256 FROM c"""


def q_nfc_normalize(spark, d):
    rows = T.nfc_normalize(table(spark, d, "documents"))
    return rows.select("doc_id", F.sha2("text", 256).alias("sha256"), "changed", F.col("joiners").cast("long").alias("joiners"))


NFC = "SELECT doc_id, sha256(nfc_normalize(text)) AS sha256, nfc_normalize(text) <> text AS changed, len(regexp_extract_all(text, '[\\x{200C}\\x{200D}]')) AS joiners FROM documents"


def q_visible_text(spark, d):
    rows = table(spark, d, "documents").select("doc_id", T.visible_text(F.col("text")).alias("t"))
    return rows.select("doc_id", F.length("t").cast("long").alias("visible"), F.sha2("t", 256).alias("sha256"))


VISIBLE = f"WITH v AS (SELECT doc_id, regexp_replace(text, '{WS}', '', 'g') AS t FROM documents) SELECT doc_id, length(t) AS visible, sha256(t) AS sha256 FROM v"


def q_faithful_units(spark, d):
    return table(spark, d, "documents").select("doc_id", T.faithful_units(F.col("text")).alias("units"))


UNITS = f"SELECT doc_id, len(regexp_extract_all(text, '{UNIT}')) AS units FROM documents"


def q_snapshot_records(spark, d):
    return T.snapshot_records(table(spark, d, "documents"))


RECORDS = f"SELECT doc_id, lang, sha256(text) AS sha256, octet_length(encode(text)) AS bytes, length(text) AS characters, len(regexp_extract_all(text, '{WORD}')) AS words, len(regexp_extract_all(text, '{UNIT}')) AS faithful_units FROM documents"


def q_corpus_summary(spark, d):
    return T.corpus_summary(table(spark, d, "documents"))


SUMMARY = f"SELECT lang, count(*) AS documents, sum(bytes)::BIGINT AS bytes, sum(characters)::BIGINT AS characters, sum(words)::BIGINT AS words, sum(faithful_units)::BIGINT AS faithful_units FROM ({RECORDS}) GROUP BY lang"


def q_integrity_check(spark, d):
    """Stored n_chars against a recount, with every 50th stored value disturbed so that mismatches occur."""
    docs = table(spark, d, "documents")
    stored = docs.select("doc_id", F.when(uniform("doc_id", "disturb") < 0.02, F.col("n_chars") + 1).otherwise(F.col("n_chars")).alias("n_chars"))
    return T.integrity_check(stored, docs.select("doc_id", F.length("text").cast("long").alias("n_chars")), "doc_id", ["n_chars"])


INTEGRITY = f"SELECT doc_id, 'n_chars' AS field, (n_chars + 1)::VARCHAR AS stored, length(text)::VARCHAR AS found FROM documents WHERE {uniform_sql('doc_id', 'disturb')} < 0.02"

REGISTRY = {
    "read_pages": (q_read_pages, READ_PAGES),
    "read_documents": (q_read_documents, READ_DOCUMENTS),
    "training_lines": (q_training_lines, TRAINING_LINES),
    "write_snapshots": (q_write_snapshots, WRITE_SNAPSHOTS),
    "write_page_snapshots": (q_write_page_snapshots, WRITE_PAGE_SNAPSHOTS),
    "strip_technical_nodes": (q_strip_technical_nodes, STRIP),
    "absolute_links": (q_absolute_links, ABSOLUTE_LINKS),
    "html_to_markdown": (q_html_to_markdown, HTML_TO_MARKDOWN),
    "normalize_markdown": (q_normalize_markdown, NORMALIZE),
    "nfc_normalize": (q_nfc_normalize, NFC),
    "visible_text": (q_visible_text, VISIBLE),
    "faithful_units": (q_faithful_units, UNITS),
    "snapshot_records": (q_snapshot_records, RECORDS),
    "corpus_summary": (q_corpus_summary, SUMMARY),
    "integrity_check": (q_integrity_check, INTEGRITY),
}
