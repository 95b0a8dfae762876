"""Language and script of paragraphs, by evidence: Unicode ranges for scripts, and character trigrams learned from labelled rows for languages.

Scripts come first. Where languages that were learned are written in a paragraph's script, naive Bayes over character trigrams chooses among them; a script that only one listed
language uses names that language; any other gives none. Weights are whole numbers (thousandths of a logarithm), so scores add up alike everywhere.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from granary.functions.text import Measures, classes, sliced_sizes
from granary.sources.tables import materialize

# Scripts by their Unicode names, and the language of those that one listed language alone uses.
SCRIPTS = ["Latin", "Devanagari", "Bengali", "Gurmukhi", "Gujarati", "Oriya", "Tamil", "Telugu", "Kannada", "Malayalam", "Arabic", "Ol_Chiki", "Meetei_Mayek", "Cyrillic", "Greek", "Han"]
ONLY = {"Gurmukhi": "pa", "Gujarati": "gu", "Oriya": "or", "Tamil": "ta", "Telugu": "te", "Kannada": "kn", "Malayalam": "ml", "Ol_Chiki": "sat", "Meetei_Mayek": "mni", "Bengali": "bn", "Devanagari": "hi", "Arabic": "ur"}

GRAMS = 50_000  # most trigrams of a model
SLICE, ALPHABET = 1 << 20, 128  # characters that are counted together; different ones among them, up to which their trigrams have a place each
MIXED_SHARE, MIXED_MARGIN = 0.1, 100  # a second script's share of letters; thousandths a trigram between the two best languages
PLAIN = r"[^\p{L}\p{M}]+"


def paragraphs(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, para_no, p (lines that are not empty), and keep."""
    return docs.select("doc_id", *keep, F.posexplode(F.split("text", "\n")).alias("para_no", "p")).filter(F.col("p") != "")


def plain(p: Column) -> Column:
    """Words of letters in lower case, a blank around each."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(p), PLAIN, " ")), F.lit(" "))


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, code) of all windows of three characters; a code is 21 bits a character."""
    sizes = np.array([len(t) for t in texts], np.int64)
    x = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    text = np.repeat(np.arange(len(texts)), sizes)
    if len(x) < 3:
        return text[:0], x[:0]
    inside = text[:-2] == text[2:]
    return text[:-2][inside], (x[:-2] << 42 | x[1:-1] << 21 | x[2:])[inside]


def gram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of trigrams, ascending, and how often each is there; by slices, and with few characters (ALPHABET) by counting places in place of sorting codes."""
    found = []
    for a, b in sliced_sizes([len(t) for t in texts], SLICE):
        x = np.frombuffer("".join(texts[a:b]).encode("utf-32-le", "surrogatepass"), np.uint32)
        if len(x) < 3:
            continue
        chars = np.nonzero(np.bincount(x))[0]
        k = len(chars)
        if k > ALPHABET:
            found.append(np.unique(trigrams(texts[a:b])[1], return_counts=True))
            continue
        place = np.zeros(chars[-1] + 1, np.int32)
        place[chars] = np.arange(k)
        x, ends, inside = place[x], np.cumsum([len(t) for t in texts[a:b]]), np.ones(len(x), bool)
        for before in (1, 2):  # windows over the end of a text
            inside[(ends - before)[ends >= before]] = False
        n = np.bincount(((x[:-2] * k + x[1:-1]) * k + x[2:])[inside[:-2]], minlength=k**3)
        i = np.nonzero(n)[0]
        found.append((chars[i // k**2] << 42 | chars[i // k % k] << 21 | chars[i % k], n[i]))
    codes, n = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    codes, at = np.unique(codes, return_inverse=True)
    sums = np.zeros(len(codes), np.int64)
    np.add.at(sums, at, n)
    return codes, sums


def trigram_counts(rows: DataFrame) -> DataFrame:
    """lang, code, n over rows (lang, t): summed up in each batch before they move."""
    schema = pa.schema([("lang", pa.string()), ("code", pa.int64()), ("n", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = defaultdict(list)
            for lang, t in zip(batch.column("lang").to_pylist(), batch.column("t").to_pylist()):
                texts[lang].append(t)
            for lang, own in texts.items():
                codes, n = gram_counts(own)
                yield pa.record_batch([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(n, pa.int64())], schema=schema)

    return rows.select("lang", "t").mapInArrow(scan, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


class Profiles:
    """Weights of trigrams by language, and the script that each language is written in."""

    def __init__(self, langs: list[str], scripts: list[str], codes: np.ndarray, counts: np.ndarray):
        self.langs, self.scripts, self.codes = langs, scripts, codes
        total = counts.sum(axis=0)
        log = lambda c: np.rint(1000 * np.log((c + 1) / (total + len(codes)))).astype(np.int64)
        self.weights = np.vstack([log(counts), log(np.zeros_like(total))[None, :]])  # the last row: of trigrams that are not in the model

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sums of weights by text and language; trigrams by text."""
        text, code = trigrams(texts)
        place = np.minimum(np.searchsorted(self.codes, code), max(len(self.codes) - 1, 0))
        known = self.codes[place] == code if len(self.codes) else np.zeros(len(code), bool)
        w = self.weights[np.where(known, place, len(self.codes))]
        out = np.zeros((len(texts), len(self.langs)), np.int64)
        np.add.at(out, text, w)
        return out, np.bincount(text, minlength=len(texts))


def measured(docs: DataFrame, *keep: str) -> DataFrame:
    """keep, words, units and the characters of each of SCRIPTS (by) of every text, null for null: one pass of batches over classes of code points."""
    rows = docs.select(*keep, "text")
    shared = docs.sparkSession.sparkContext.broadcast(classes(docs.sparkSession, SCRIPTS))  # a byte for each code point

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = Measures(shared.value, len(SCRIPTS))
        for batch in batches:
            texts = batch.column("text").to_pylist()
            none = np.array([t is None for t in texts], bool)
            words, units, by = measure([t or "" for t in texts])
            by = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * by.shape[1], pa.int32()), pa.array(by.ravel(), pa.int64()))
            yield pa.record_batch([*(batch.column(c) for c in range(len(keep))), pa.array(words, mask=none), pa.array(units, mask=none), pc.if_else(pa.array(none), None, by)], names=[*keep, "words", "units", "by"])

    return rows.mapInArrow(scan, StructType([*rows.schema.fields[: len(keep)], StructField("words", LongType()), StructField("units", LongType()), StructField("by", ArrayType(LongType()))]))


def script_sums() -> list[Column]:
    return [F.sum(F.get("by", F.lit(i))).alias(s) for i, s in enumerate(SCRIPTS)]


def script_letters(docs: DataFrame) -> DataFrame:
    """lang and the characters of its texts in each script: one row a language."""
    return measured(docs, "lang").groupBy("lang").agg(*script_sums())


def main_script() -> Column:
    """The script with most characters in columns of SCRIPTS, the first listed among equals; none without any."""
    counts = F.array(*(F.coalesce(F.col(s), F.lit(0)) for s in SCRIPTS))
    most = F.array_max(counts)
    return F.when(most > 0, F.element_at(F.array(*map(F.lit, SCRIPTS)), F.array_position(counts, most).cast("int"))).otherwise("none")


def main_scripts(docs: DataFrame) -> DataFrame:
    """lang, script: as main_script."""
    return script_letters(docs).select("lang", main_script().alias("script"))


def learn_profiles(docs: DataFrame, most: int = GRAMS) -> Profiles:
    """From text and lang of docs. The driver sees `most` trigrams at most, of each labelled language."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = materialize(trigram_counts(rows.select("lang", plain(F.col("text")).alias("t"))), "trigrams")
    top = counts.groupBy("code").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "code").limit(most).select("code")
    found = counts.join(F.broadcast(top), "code").collect()  # `most` codes a language
    scripts = script_letters(rows).orderBy("lang").collect()  # one row a language
    langs = [r.lang for r in scripts]
    at = {k: i for i, k in enumerate(langs)}
    codes = np.array(sorted({r.code for r in found}), np.int64)
    table = np.zeros((len(codes), len(langs)), np.int64)
    for r in found:
        table[np.searchsorted(codes, r.code), at[r.lang]] = r.n
    return Profiles(langs, [max(SCRIPTS, key=lambda s: r[s]) for r in scripts], codes, table)


def paragraph_lang_script(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """doc_id, para_no, script (most letters; none without letters of a listed one), script_share (of letters), n_scripts (with MIXED_SHARE of letters or more), lang, margin (to the
    next language, thousandths a trigram; null where no language was chosen by trigrams), mixed (two scripts, or two languages within MIXED_MARGIN). Mixed paragraphs are kept.
    """
    counts = [F.regexp_count("p", F.lit(rf"\p{{Is{s}}}")).alias(s) for s in SCRIPTS]
    rows = paragraphs(docs).select("doc_id", "para_no", plain(F.col("p")).alias("t"), F.regexp_count("p", F.lit(r"\p{L}")).alias("letters"), F.array(*counts).alias("by"))
    most = F.array_max("by")
    script = F.when(most > 0, F.element_at(F.array(*map(F.lit, SCRIPTS)), F.array_position("by", most).cast("int"))).otherwise("none")
    share = F.round(F.coalesce(F.try_divide(most, "letters"), F.lit(0.0)), 6)
    several = F.size(F.filter("by", lambda n: (n > 0) & (n >= F.col("letters") * MIXED_SHARE)))
    rows = rows.select("doc_id", F.col("para_no").cast("long").alias("para_no"), "t", script.alias("script"), share.alias("script_share"), several.cast("long").alias("n_scripts"))
    shared = docs.sparkSession.sparkContext.broadcast(profiles)  # GRAMS rows
    schema = pa.schema([("doc_id", pa.int64()), ("para_no", pa.int64()), ("script", pa.string()), ("script_share", pa.float64()), ("n_scripts", pa.int64()), ("lang", pa.string()), ("margin", pa.int64()), ("mixed", pa.bool_())])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            scripts, langs, margins = batch.column("script").to_pylist(), [], []
            sums, sizes = model.scores(batch.column("t").to_pylist())
            for s, score, n in zip(scripts, sums.tolist(), sizes.tolist()):
                ranked = sorted((-x, k) for x, k, own in zip(score, model.langs, model.scripts) if own == s)
                langs.append(ranked[0][1] if ranked else ONLY.get(s))
                margins.append((ranked[1][0] - ranked[0][0]) // max(n, 1) if len(ranked) > 1 else None)
            mixed = [n > 1 or (m is not None and m < MIXED_MARGIN) for n, m in zip(batch.column("n_scripts").to_pylist(), margins)]
            yield pa.record_batch([batch.column(c) for c in ("doc_id", "para_no", "script", "script_share", "n_scripts")] + [pa.array(langs, pa.string()), pa.array(margins, pa.int64()), pa.array(mixed, pa.bool_())], schema=schema)

    return rows.mapInArrow(choose, "doc_id long, para_no long, script string, script_share double, n_scripts long, lang string, margin long, mixed boolean")


def text_languages(rows: DataFrame, key: str, profiles: Profiles) -> DataFrame:
    """key (a whole number), lang of each whole text as of one paragraph; `other` where there is none."""
    whole = rows.select(F.col(key).cast("long").alias("doc_id"), F.replace("text", F.lit("\n"), F.lit(" ")).alias("text"))
    found = paragraph_lang_script(whole, profiles).select(F.col("doc_id").alias(key), "lang")
    return rows.select(key).join(found, key, "left").select(key, F.coalesce("lang", F.lit("other")).alias("lang"))
