"""Text measures and normalisation as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# White space and faithful units, the same in Java, RE2 and Python.
WS = r"[\t-\r\x1c-\x1f\x20\x85\p{Z}]"
WORD = r"[^\t-\r\x1c-\x1f\x20\x85\p{Z}]+"
UNIT = r"[\p{L}\p{M}\p{N}]+|[^\t-\r\x1c-\x1f\x20\x85\p{Z}\p{L}\p{M}\p{N}]"
RECORD_SCHEMA = "doc_id long, lang string, sha256 string, bytes long, characters long, words long, faithful_units long"


def sliced_sizes(sizes: Sequence[int], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of these sizes, about limit each; a larger row is taken alone."""
    a = size = 0
    for i, n in enumerate(sizes):
        if size and size + n > limit:
            yield a, i
            a, size = i, 0
        size += n
    if a < len(sizes):
        yield a, len(sizes)


def visible_text(x: Column) -> Column:
    return F.regexp_replace(x, WS, "")


def faithful_units(x: Column) -> Column:
    return F.regexp_count(x, F.lit(UNIT)).cast("long")


def word_count(x: Column) -> Column:
    return F.regexp_count(x, F.lit(WORD)).cast("long")


def normalize_markdown(x: Column) -> Column:
    x = F.replace(x, F.lit("\u00a0"), F.lit(" "))
    x = F.regexp_replace(x, r"[ \t]+\n", "\n")
    x = F.regexp_replace(x, r"\n{4,}", "\n\n\n")
    x = F.regexp_replace(x, rf"\A{WS}+|{WS}+\z", "")
    return F.concat(x, F.lit("\n"))


def lines(x: Column) -> Column:
    """Lines with their ends, as a trainer reads files."""
    return F.regexp_extract_all(x, F.lit("[^\n]*\n|[^\n]+"), 0)


def metaspace_pieces(x: Column) -> Column:
    return F.regexp_extract_all(F.replace(x, F.lit(" "), F.lit("▁")), F.lit("▁[^▁]*|[^▁]+"), 0)


def split_pieces(text: str, line_ends: bool = True) -> list[str]:
    """Pieces of a text, a blank in the place of ▁, among them empty strings that count for nothing. line_ends: pieces end there too, as those of lines do."""
    text = text.replace("▁", " ")
    cut = next(c for c in map(chr, range(1, 0x110000)) if c not in " \n▁" and c not in text)
    if line_ends:
        text = text.replace("\n", "\n" + cut)
    return text.replace(" ", cut + " ").split(cut)


def characters(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit("(?s)."), 0)


def snapshot_records(docs: DataFrame) -> DataFrame:
    t = F.col("text")
    return docs.select(
        "doc_id", "lang", F.sha2(t, 256).alias("sha256"), F.octet_length(t).cast("long").alias("bytes"), F.length(t).cast("long").alias("characters"), word_count(t).alias("words"), faithful_units(t).alias("faithful_units")
    )


def corpus_summary(docs: DataFrame) -> DataFrame:
    return snapshot_records(docs).groupBy("lang").agg(F.count(F.lit(1)).alias("documents"), *(F.sum(c).alias(c) for c in ("bytes", "characters", "words", "faithful_units")))


def integrity_check(stored: DataFrame, found: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, field, stored, found for every field that differs; rows on one side only differ in all fields."""

    def tall(df: DataFrame, name: str) -> DataFrame:
        pairs = F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias(name)) for c in fields))
        return df.select(key, F.inline(pairs))

    both = tall(stored, "stored").join(tall(found, "found"), [key, "field"], "full_outer")
    return both.filter(~F.col("stored").eqNullSafe(F.col("found")))


_CLASSES: dict[tuple, np.ndarray] = {}
SPACE, LETTER = 128, 64  # in a class, beside the place of a script in a list, from 1


def classes(spark: SparkSession, scripts: Sequence[str] = ()) -> np.ndarray:
    """For each code point its class, as the expressions above see it: SPACE, LETTER (of a unit), and which of scripts, in one byte."""
    key = (spark.sparkContext.applicationId, *scripts)
    if key not in _CLASSES:

        def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.record_batch([batch.column("id"), pa.array([chr(i) for i in batch.column("id").to_pylist()])], names=["id", "c"])

        rows = spark.range(0x110000).filter("id < 55296 or id > 57343").mapInArrow(written, "id long, c string")  # no surrogates
        is_ = lambda pattern, n: F.when(F.col("c").rlike(pattern), n).otherwise(0)
        script = F.coalesce(*(F.when(F.col("c").rlike(rf"\p{{Is{s}}}"), i + 1) for i, s in enumerate(scripts)), F.lit(0))
        found = rows.select("id", (script + is_(WS, SPACE) + is_(r"[\p{L}\p{M}\p{N}]", LETTER)).alias("n")).toArrow()
        table = np.zeros(0x110000, np.uint8)
        table[found["id"].to_numpy()] = found["n"].to_numpy()
        _CLASSES[key] = table
    return _CLASSES[key]


class Measures:
    """words, units and the characters of each script, by text, from classes."""

    def __init__(self, table: np.ndarray, scripts: int = 0):
        self.table, self.scripts = table, scripts

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = [self.some(texts[a:b]) for a, b in sliced_sizes([len(t) for t in texts], 1 << 20)]
        return tuple(np.concatenate([np.zeros((0, self.scripts) if k == 2 else 0, np.int64), *(f[k] for f in found)]) for k in range(3))

    def some(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.array([len(t) for t in texts], np.int64)
        kind = self.table[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")]
        at = np.concatenate(([0], np.cumsum(sizes)))
        first = np.zeros(len(kind) + 1, bool)
        first[at] = True
        first = first[:-1]
        seen, letter = kind < SPACE, (kind & LETTER) > 0
        after = lambda x: np.concatenate(([False], x[:-1])) & ~first  # noqa: E731  whether the character before it in the text is one
        begins = letter & ~after(letter)
        by_text = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[at])
        script, text = kind & (LETTER - 1), np.repeat(np.arange(len(sizes)), sizes)
        by = np.bincount(text * (self.scripts + 1) + script, minlength=len(sizes) * (self.scripts + 1)).reshape(len(sizes), -1)[:, 1:] if self.scripts else np.zeros((len(sizes), 0), np.int64)
        return by_text(seen & ~after(seen)), by_text(begins | (seen & ~letter)), by


@F.pandas_udf(StringType())
def nfc(x: pd.Series) -> pd.Series:
    return x.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def nfc_normalize(docs: DataFrame) -> DataFrame:
    """doc_id, text, changed, joiners (zero-width joiners and non-joiners, which NFC keeps)."""
    rows = docs.select("doc_id", F.col("text").alias("before"), nfc("text").alias("text"))
    return rows.select("doc_id", "text", (~F.col("text").eqNullSafe(F.col("before"))).alias("changed"), F.regexp_count("text", F.lit("[\u200c\u200d]")).alias("joiners"))
