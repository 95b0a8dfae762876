"""Language identification with string kernels.

Kernel: blended spectrum of byte n-grams (n = 1, 2, 3) by presence, normalised: grams that both texts have, over the root of the product of
the two texts' numbers of distinct grams. Nystroem: kernel columns to a bounded set of landmark documents, whitened by
the landmarks' own kernel. On these features one-versus-rest kernel ridge regression is solved in closed form.
Scoring is a product of presence rows with one weight matrix (grams by languages), in batches; grams that no landmark has count in the norm alone.

Bounds, all parameters: `per_lang` training rows a language, chosen by a hash of doc_id among those that may be learned
from, `max_rows` in all (languages in turn), and `landmarks` of them. Texts are read whole, in training and in scoring; a text has at most CODES grams.

Defined results: null text, or a text without a letter, is `und` with score 0; so is every text when nothing can be learned; a null
doc_id is not held out and not learned from; repeated rows are scored each; other columns of the input are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from granary.llm.common import UPPER_TO_LOWER, batch_of, concat_bytes, row_ids, sliced

PER_LANG, MAX_ROWS, LANDMARKS, RIDGE, UNKNOWN = 256, 4096, 192, 1e-3, "und"


def gram_codes(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text index, code) of every 1-, 2- and 3-gram; codes of different lengths differ."""
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    wide = data.astype(np.int32)
    yield text, wide
    if len(data) > 1:
        two = (wide[:-1] << 8 | wide[1:]) + (1 << 8)
        inside = text[:-1] == text[1:]
        yield text[:-1][inside], two[inside]
    if len(data) > 2:
        three = (wide[:-2] << 16 | wide[1:-1] << 8 | wide[2:]) + (1 << 8) + (1 << 16)
        inside = text[:-2] == text[2:]
        yield text[:-2][inside], three[inside]


CODES = (1 << 8) + (1 << 16) + (1 << 24)


def distinct_count(codes: np.ndarray, last: np.ndarray) -> int:
    """How many different codes there are: those that are the last of their kind. last: one number for each possible code, whatever it holds."""
    at = np.arange(len(codes), dtype=last.dtype)
    last[codes] = at
    return int(np.count_nonzero(last[codes] == at))


@dataclass
class Model:
    langs: list[str]
    grams: np.ndarray  # sorted codes
    weights: np.ndarray  # grams x langs

    def places(self) -> np.ndarray:
        """Row of each code in weights, plus one; 0 where there is none."""
        out = np.zeros(CODES, np.uint16 if len(self.grams) < 65_000 else np.uint32)
        out[self.grams] = np.arange(1, len(self.grams) + 1)
        return out

    def scores(self, texts: list[bytes], places: np.ndarray, last: np.ndarray) -> np.ndarray:
        data, at = concat_bytes(texts)
        seen = np.zeros((len(texts), len(self.grams) + 1), np.float32)
        distinct = np.zeros(len(texts), np.int64)
        for text, code in gram_codes(data, at):
            seen[text, places[code]] = 1
            begin = np.searchsorted(text, np.arange(len(texts) + 1))
            for i, (a, b) in enumerate(zip(begin[:-1].tolist(), begin[1:].tolist())):
                distinct[i] += distinct_count(code[a:b], last)
        return (seen[:, 1:] @ self.weights) / np.sqrt(np.maximum(distinct[:, None], 1))


def train(rows: list[tuple[str, np.ndarray]], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model | None:
    """rows: language and sorted distinct gram codes, languages in turn."""
    langs = sorted({r[0] for r in rows})
    if not langs:
        return None
    marks = [r[1] for r in rows[:landmarks]]
    grams = np.unique(np.concatenate(marks))
    if not len(grams):
        return None

    def presence(sets: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(sets), len(grams)), np.float32)
        for i, s in enumerate(sets):
            k = np.searchsorted(grams, s)
            k = k[(k < len(grams))]
            out[i, k[np.isin(grams[k], s)]] = 1
        return out / np.sqrt(np.maximum(np.array([[len(s)] for s in sets]), 1))

    mark, every = presence(marks), presence([r[1] for r in rows])
    values, vectors = np.linalg.eigh((mark @ mark.T).astype(np.float64))
    good = values > 1e-6 * values.max()
    whiten = vectors[:, good] / np.sqrt(values[good])
    z = (every @ mark.T).astype(np.float64) @ whiten
    y = np.array([[1.0 if r[0] == k else -1.0 for k in langs] for r in rows])
    share = {k: sum(r[0] == k for r in rows) for k in langs}
    w = np.array([len(rows) / (len(langs) * share[r[0]]) for r in rows])[:, None]  # languages count alike
    solved = np.linalg.solve((z * w).T @ z + ridge * len(rows) * np.eye(z.shape[1]), (z * w).T @ y)
    return Model(langs, grams, (mark.T.astype(np.float64) @ whiten @ solved).astype(np.float32))


def training_rows(docs: DataFrame, per_lang: int = PER_LANG, max_rows: int = MAX_ROWS) -> list[tuple[str, np.ndarray]]:
    """At most per_lang rows a language and max_rows in all as gram sets, languages in turn; the choice depends on doc_id, then on the row."""
    may = docs.select(row_ids(docs).alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    may = may.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) != 2))
    keys = may.select("row_id", "lang", F.md5(F.col("doc_id").cast("string")).alias("u"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("u", "row_id"))
    chosen = keys.withColumn("rank", rank).filter(F.col("rank") <= per_lang).orderBy("rank", "lang").limit(max_rows).select("row_id", "rank")
    out = pa.schema([("lang", pa.string()), ("rank", pa.int32()), ("doc_id", pa.int64()), ("grams", pa.list_(pa.int32()))])

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = []
            for t in batch.column("text").to_pylist():
                data, at = concat_bytes([t.translate(UPPER_TO_LOWER)])
                sets.append(np.unique(np.concatenate([np.unique(c) for _, c in gram_codes(data, at)])))
            yield batch_of(out, batch.column("lang"), batch.column("rank"), batch.column("doc_id"), [s.tolist() for s in sets])

    # at most max_rows keys
    picked = may.join(F.broadcast(chosen), "row_id").select("lang", "rank", "doc_id", F.col("text").cast("binary").alias("text"))
    rows = picked.mapInArrow(grams, "lang string, rank int, doc_id long, grams array<int>").collect()
    return [(r.lang, np.array(r.grams, np.int32)) for r in sorted(rows, key=lambda r: (r["rank"], r.lang, r.doc_id))]


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    out = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # grams of the landmarks times languages

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        places, last = (m.places(), np.zeros(CODES, np.int32)) if m else (None, None)
        for batch in batches:
            texts = [(t or b"").translate(UPPER_TO_LOWER) for t in batch.column("text").to_pylist()]
            letter = batch.column("letter").to_pylist()
            langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
            for a, b in sliced(texts, 1 << 20) if m else ():
                for c in range(a, b, 256):
                    f = m.scores(texts[c : min(c + 256, b)], places, last)
                    best = f.argmax(axis=1)
                    sure = np.clip((f[np.arange(len(f)), best] + 1) / 2, 0, 1)
                    for i, (k, s) in enumerate(zip(best.tolist(), sure.tolist()), c):
                        if letter[i]:
                            langs[i], scores[i] = m.langs[k], s
            yield batch_of(out, batch.column("doc_id"), batch.column("held_out"), langs, scores)

    read = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False)).alias("held_out"),
        F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letter"),
        F.col("text").cast("binary").alias("text"),
    )
    return read.mapInArrow(scan, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, per_lang: int = PER_LANG, landmarks: int = LANDMARKS) -> DataFrame:
    return predict(docs, train(training_rows(docs, per_lang), landmarks))
