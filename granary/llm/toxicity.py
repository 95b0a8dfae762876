"""Toxicity by a classifier chain.

Categories are predicted in order; each category's linear model sees the words of the text and the probabilities of the
categories before it. For training those probabilities are out of fold: each labelled document gets its own from models
that did not see it, so a later model learns from probabilities like those it will meet.

Words are runs of letters, lower-cased, by presence; the vocabulary has the words of at least MIN_DOCS labelled documents, so no two words share a
feature; the models are logistic regressions with a lasso penalty, which keeps the words that matter. Bounds, all parameters: at most `max_labelled` labelled documents are fitted on, the first by a
hash of doc_id (of rows that share a doc_id the first); of their words at most VOCABULARY, the most frequent, then in alphabetical order. So one fit is one task, and the fits of a
category (all documents, and all but each fold) are tasks side by side. All documents are scored, by whole text.

Defined results: null or empty text has no words and gets the base rate; documents without a label, or with a null label in some category, are not fitted on; several
labels of one document count as the largest; without labelled documents every probability is 0; where no word is in MIN_DOCS of them, all get the categories' shares;
repeated rows are scored each; a null doc_id has no label; other columns of the input are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import batch_of, materialize, row_ids

MAX_LABELLED, MIN_DOCS, VOCABULARY, FOLDS, PENALTY, THRESHOLD = 20_000, 5, 50_000, 3, 0.1, 0.2
# A fit ends when ten rounds change its objective by less than TOLERANCE of it; ROUNDS is only a stop for one that never would.
TOLERANCE, ROUNDS, GROWTH = 1e-7, 20_000, 64


@dataclass
class Model:
    """Logistic regression over the words of a vocabulary (by place) and the probabilities of earlier categories."""

    weights: np.ndarray
    earlier: np.ndarray
    intercept: float

    def probabilities(self, row: np.ndarray, place: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        """One for each row of earlier; the words of row[i] are at place[i]."""
        z = np.bincount(row, self.weights[place], len(earlier)) + earlier @ self.earlier + self.intercept
        return 1 / (1 + np.exp(-z))


def rows_of(lists: pa.ListArray) -> np.ndarray:
    return np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))


def words_in(words: pa.ListArray, known: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(list, place in known) of each word of each list that is known."""
    places = pc.index_in(words.flatten(), known)
    found = places.is_valid().to_numpy(zero_copy_only=False)
    return rows_of(words)[found], places.drop_null().to_numpy().astype(np.int64)


def lasso(row: np.ndarray, place: np.ndarray, size: int, dense: np.ndarray, y: np.ndarray, penalty: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights of presence features (those that are `place` in `row`; size of them), of dense ones, and the intercept, which bears no penalty.

    Minimises mean log loss + penalty * sum of absolute weights. Most weights are zero, so steps are taken over a working set, to which features
    are added whose gradient exceeds the penalty, until none is left: in a round as many as the set has (GROWTH at least), those that exceed it most first, as few of
    the many that exceed it at first still do when others are in.
    """
    n = len(y)
    dense = np.column_stack([dense, np.ones(n)])
    w = np.zeros(size + dense.shape[1])
    work = np.zeros(size, bool)
    z = np.zeros(n)
    while True:
        used = np.nonzero(work)[0]
        mine = np.nonzero(work[place])[0]
        at = np.concatenate([used, np.arange(size, len(w))])
        w[at], z = descend(row[mine], (np.cumsum(work) - 1)[place[mine]], len(used), dense, y, penalty, w[at])
        error = (1 / (1 + np.exp(-z)) - y) / n
        gradient = np.where(work, 0, np.abs(np.bincount(place, error[row], size)))
        more = np.nonzero(gradient > penalty * (1 + 1e-3))[0]
        if not len(more):
            return w[:size], w[size:-1], float(w[-1])
        work[more[np.argsort(-gradient[more], kind="stable")[: max(GROWTH, len(used))]]] = True


def descend(row: np.ndarray, place: np.ndarray, size: int, dense: np.ndarray, y: np.ndarray, penalty: float, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lasso over given features from w, and its scores: proximal gradient steps with momentum, restarted when the objective rises.

    Each coordinate has its own step, from a diagonal bound of the curvature: a row adds its own sum of features to the bound of each of them.
    """
    n = len(y)
    weight = np.bincount(row, minlength=n) + np.abs(dense).sum(axis=1)
    bound = np.concatenate([np.bincount(place, weight[row], size), np.abs(dense).T @ weight]) / (4 * n)
    step = 1 / np.where(bound > 0, bound, 1)
    shrink = step * penalty
    shrink[-1] = 0
    scores = lambda w: np.bincount(row, w[place], n) + dense @ w[size:]
    objective = lambda w, z: np.mean(np.logaddexp(0, z) - y * z) + penalty * np.abs(w[:-1]).sum()
    z = scores(w)
    best, v, z_v, k, seen = objective(w, z), w, z, 1.0, []
    for _ in range(ROUNDS):
        error = (1 / (1 + np.exp(-z_v)) - y) / n
        moved = v - step * np.concatenate([np.bincount(place, error[row], size), dense.T @ error])
        new = np.sign(moved) * np.maximum(np.abs(moved) - shrink, 0)
        z_new = scores(new)
        value = objective(new, z_new)
        if value > best and k > 1:
            v, z_v, k = w, z, 1.0
            continue
        k, old = (1 + (1 + 4 * k * k) ** 0.5) / 2, k
        m = (old - 1) / k
        v, z_v = new + m * (new - w), z_new + m * (z_new - z)
        w, z, best = new, z_new, min(value, best)
        seen.append(value)
        if len(seen) > 10 and seen[-11] - value <= TOLERANCE * abs(value):
            break
    return w, z


def words(docs: DataFrame, *more: Column | str) -> DataFrame:
    found = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(F.col("text"), F.lit(""))), F.lit(r"\p{L}+"), 0))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), found.alias("words"), *more)


def placed(rows: DataFrame, vocabulary: list[str]) -> DataFrame:
    """rows with places array<int>, those of its words in the vocabulary, instead of words."""
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(shared.value, pa.string())
        for batch in batches:
            row, place = words_in(batch.column("words"), known)
            offsets = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=batch.num_rows))))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(place, pa.int32()))
            rest = batch.drop_columns(["words"])
            yield rest.append_column("places", lists)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "words")
    return rows.mapInArrow(scan, f"{schema}, places array<int>")


def fits(rows: DataFrame, category: str, size: int, penalty: float) -> list[Model]:
    """Models of one category, one for each number that occurs in `fits`. rows: doc_id, places, earlier array<double>, category, fits array<int>; a bounded sample."""

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by("doc_id").combine_chunks()
        lists = table.column("places").combine_chunks()
        earlier = np.array(table.column("earlier").to_pylist(), float).reshape(len(table), -1)
        w, e, b = lasso(rows_of(lists), lists.flatten().to_numpy(), size, earlier, table.column("y").to_numpy(), penalty)
        used = np.nonzero(w)[0]
        return pa.table([table.column("fit")[:1], [used.tolist()], [w[used].tolist()], [e.tolist()], [b]], schema=out)

    numbers = pa.list_(pa.float64())
    out = pa.schema([("fit", pa.int32()), ("places", pa.list_(pa.int32())), ("weights", numbers), ("earlier", numbers), ("intercept", pa.float64())])
    given = rows.select("doc_id", "places", "earlier", F.col(category).alias("y"), F.explode("fits").alias("fit"))
    found = given.groupBy("fit").applyInArrow(one, "fit int, places array<int>, weights array<double>, earlier array<double>, intercept double")
    models = []
    for r in sorted(found.collect(), key=lambda r: r.fit):  # at most FOLDS + 1 rows of VOCABULARY weights; sorted by Spark, every fit would be made twice, once to find the ranges
        weights = np.zeros(size)
        weights[r.places] = r.weights
        models.append(Model(weights, np.array(r.earlier), r.intercept))
    return models


def predicted(rows: DataFrame, models: list[Model], model_of: str) -> DataFrame:
    """rows (places, earlier and more) with the probability by the model that the column model_of numbers appended to earlier."""
    shared = rows.sparkSession.sparkContext.broadcast(models)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, which = batch.column("places"), batch.column(model_of).to_numpy()
            row, place = rows_of(lists), lists.flatten().to_numpy()
            earlier = np.array(batch.column("earlier").to_pylist(), float).reshape(batch.num_rows, -1)
            p = np.zeros(batch.num_rows)
            for k in np.unique(which).tolist():
                p = np.where(which == k, shared.value[k].probabilities(row, place, earlier), p)
            more = pa.array(np.column_stack([earlier, p]).tolist(), pa.list_(pa.float64()))
            yield batch.set_column(batch.schema.get_field_index("earlier"), pa.field("earlier", more.type), more)

    return rows.mapInArrow(scan, rows.schema)


def chain(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], max_labelled: int = MAX_LABELLED) -> DataFrame:
    """doc_id and p_<category> for each of categories (name -> 0/1 column over labels), in chain order."""
    names = list(categories)
    marks = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*(F.max(c.cast("double")).alias(n) for n, c in categories.items())).dropna()
    marks = marks.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(max_labelled).withColumn("fold", F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS)))
    # at most max_labelled rows, so documents without a label drop out before any shuffle
    fitted = words(docs, row_ids(docs).alias("row_id")).join(F.broadcast(marks), "doc_id")
    fitted = fitted.groupBy("doc_id", *names, "fold").agg(F.min_by("words", "row_id").alias("words"))
    all_but = F.filter(F.sequence(F.lit(0), F.lit(FOLDS)), lambda f: f != F.col("fold"))
    rows = materialize(fitted.select("doc_id", *names, "fold", "words", F.array().cast("array<double>").alias("earlier"), all_but.alias("fits")), "labelled")
    size = rows.count()
    counts = rows.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= MIN_DOCS)
    vocabulary = [r.word for r in counts.orderBy(F.desc("n"), "word").limit(VOCABULARY).collect()]
    if not vocabulary:
        shares = rows.agg(*(F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in names)).first()
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.lit(shares[c]).alias(f"p_{c}") for c in names))
    rows = materialize(placed(rows, vocabulary), "placed")
    penalty = PENALTY / size**0.5  # lasso: falls with the root of the sample
    models: list[Model] = []
    for c in names:
        if c == names[-1]:
            rows = rows.withColumn("fits", F.array(F.lit(FOLDS)))
        *folds, model = fits(rows, c, len(vocabulary), penalty)
        models.append(model)
        if folds:
            rows = materialize(predicted(rows, folds, "fold"), "out-of-fold")
    used = np.nonzero(np.any([m.weights != 0 for m in models], axis=0))[0]
    models = [Model(m.weights[used], m.earlier, m.intercept) for m in models]
    return scored(docs, names, [vocabulary[i] for i in used], models)


def scored(docs: DataFrame, names: list[str], vocabulary: list[str], models: list[Model]) -> DataFrame:
    """doc_id and p_<name> by the chain of models over the vocabulary."""
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, models))
    out = pa.schema([("doc_id", pa.int64()), *((f"p_{c}", pa.float64()) for c in names)])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, chain = pa.array(shared.value[0], pa.string()), shared.value[1]
        for batch in batches:
            row, place = words_in(batch.column("words"), known)
            earlier = np.zeros((batch.num_rows, 0))
            for model in chain:
                earlier = np.column_stack([earlier, model.probabilities(row, place, earlier)])
            yield batch_of(out, batch.column("doc_id"), *earlier.T)

    return words(docs).mapInArrow(scan, ", ".join(["doc_id long", *(f"p_{c} double" for c in names)]))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, p_low_quality, p_toxic, toxic."""
    scored = chain(docs, labels, {"low_quality": 1 - F.col("quality"), "toxic": F.col("toxic")})
    return scored.withColumn("toxic", F.col("p_toxic") >= threshold)
