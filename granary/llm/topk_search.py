"""Exact top-k search by inner product with M-trees.

Vectors are dealt to the nearest of a bounded sample of pivots; a pivot's vectors are cut by a hash into shards of bounded size, so a hot pivot only has more shards. Each
shard is an M-tree of pages: a node has a routing vector, a covering radius, the distance to its parent's routing vector and the largest norm below it;
leaf pages hold up to LEAF vectors, ordered by their distance to the page's routing vector.

The search is best first, for all queries of a block at once. From d(q, x)^2 = |q|^2 + |x|^2 - 2 q.x, a lower bound of the distance is an upper bound of the
inner product. What cannot reach a query's k-th score so far is passed over: children by |d(q, parent) - d(parent, child)| - radius, before their own distance is
worked out; pages by d(q, page) - radius; vectors of a page by |d(q, page) - d(page, vector)|, a range of the page's order. Bounds are doubles with a margin, scores are exact.

A block of queries first searches the shard it lies in. With the k-th scores found there the other shards follow, each pair of a block and a shard whose covering balls leave
room for a better score; a pair returns at most k rows for a query. So any set of queries meets all rows in blocks, and one task holds a block and a shard.

Defined results: vectors that are null or hold null or non-finite components take no part; a shorter vector counts as one that ends in zeros; equal scores go to the
smaller vec_id, rows without vec_id last, then to the row that comes first; rows that share an id are candidates and queries each (a query's own row alone is left out); a row without vec_id
is no query; an empty table gives an empty result. Integers and scores beyond 64 bits count as the nearest integer of 64 bits. Other columns are not read.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from granary.llm.common import batch_of, materialize, row_ids
from granary.llm.integer_vectors import clipped, integer_vectors, largest, matrix

K, SCALE, QUERY_STEP = 20, 64, 20
LEAF, FANOUT, PIVOTS = 128, 16, 1024
NEVER = np.iinfo(np.int64).min
EXACT = float(1 << 53)  # doubles hold all integers below
HIT = pa.struct([("query_row", pa.int64()), ("query_id", pa.int64()), ("row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
HITS = "query_row: long, query_id: long, row: long, vec_id: long, score: long"


def shard_rows(n: int) -> int:
    """Vectors a shard: as many shards as rows in them, nearly, up to what a task can hold."""
    return int(min(32768, max(1024, 8 * n**0.5)))


def norms(x: np.ndarray) -> np.ndarray:
    return (x.astype(np.float64) ** 2).sum(axis=1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(norms(a)[:, None] + norms(b)[None, :] - 2 * (a.astype(np.float64) @ b.astype(np.float64).T), 0))


def build(x: np.ndarray, leaf: int = LEAF, fanout: int = FANOUT) -> dict:
    """The tree of the rows of x: order (rows by page), nodes level by level with children or rows lo to hi, and each row's distance to its page's routing vector."""
    wide, n2 = x.astype(np.float64), norms(x)
    order, to_page, nodes = np.empty(len(x), np.int64), np.empty(len(x)), []
    middle = int(((wide - wide.mean(axis=0)) ** 2).sum(axis=1).argmin())
    waiting, done, told = [(np.arange(len(x)), middle, 0.0)], 0, 1
    while waiting:
        level, waiting = waiting, []
        for rows, centre, to_parent in level:
            d = distances(wide[rows], wide[[centre]])[:, 0]
            node = {"centre": centre, "radius": d.max(), "to_parent": to_parent, "n2": n2[rows].max(), "leaf": len(rows) <= leaf}
            near = np.argsort(d, kind="stable")
            if node["leaf"]:
                order[done : done + len(rows)], to_page[done : done + len(rows)] = rows[near], d[near]
                node |= {"lo": done, "hi": done + len(rows)}
                done += len(rows)
            else:
                parts = min(fanout, -(-len(rows) // leaf))
                seeds = rows[near[np.linspace(0, len(rows) - 1, parts).astype(int)]]
                group = distances(wide[rows], wide[seeds]).argmin(axis=1)
                if np.bincount(group).max() > 0.9 * len(rows):  # equal vectors, or nearly so: by distance, in equal parts
                    group[near] = np.arange(len(rows)) * parts // len(rows)
                own = [(rows[group == g], int(seeds[g])) for g in range(parts) if (group == g).any()]
                waiting += [(r, s, float(distances(wide[[s]], wide[[centre]])[0, 0])) for r, s in own]
                node |= {"lo": told, "hi": told + len(own)}
                told += len(own)
            nodes.append(node)
    place = np.empty(len(x), np.int64)
    place[order] = np.arange(len(x))
    tree = {k: np.array([node[k] for node in nodes]) for k in ("centre", "radius", "to_parent", "n2", "leaf", "lo", "hi")}
    return tree | {"order": order, "to_page": to_page, "centre": place[tree["centre"]]}


class Best:
    """The k best rows of each query so far, and the score that others have to reach."""

    def __init__(self, floor: np.ndarray, k: int, tie: np.ndarray):
        self.k, self.tie, self.floor = k, tie, floor.copy()
        self.score, self.at = np.full((len(floor), k), NEVER), np.full((len(floor), k), -1)

    def add(self, query: np.ndarray, at: np.ndarray, score: np.ndarray) -> None:
        named, query = np.unique(query, return_inverse=True)
        old = self.at[named] >= 0
        q = np.concatenate([query, np.nonzero(old)[0]])
        at, score = np.concatenate([at, self.at[named][old]]), np.concatenate([score, self.score[named][old]])
        by = np.lexsort((self.tie[at], ~score, q))  # ~ reverses the order of integers
        q, at, score = q[by], at[by], score[by]
        rank = np.arange(len(q)) - np.searchsorted(q, np.arange(len(named)))[q]
        keep = rank < self.k
        self.score[named], self.at[named] = NEVER, -1
        self.score[named[q[keep]], rank[keep]], self.at[named[q[keep]], rank[keep]] = score[keep], at[keep]
        full = named[self.at[named, self.k - 1] >= 0]
        self.floor[full] = np.maximum(self.floor[full], self.score[full, self.k - 1])


def search(tree: dict, q: np.ndarray, floor: np.ndarray, own: np.ndarray | None, k: int = K) -> tuple[Best, int]:
    """The k best rows of tree for each row of q, of those that score floor or more; and how many products and distances were worked out.

    tree: as from build, with x (rows in page order) and tie (their order among equal scores). own: the place of each query in the tree, which is no candidate.
    """
    x, wide_q, best, worked = tree["x"], q.astype(np.float64), Best(floor, k, tree["tie"]), 0
    q2 = norms(q)
    limit = float(np.sqrt(q2.max() * tree["n2"][0])) if len(q) else 0.0
    exact = limit < EXACT
    products = (lambda i, a, b: wide_q[i] @ tree["wide"][a:b].T) if exact else (lambda i, a, b: clipped(q[i].astype(object) @ x[a:b].astype(object).T))
    margin = 1e-7 * (np.sqrt(q2) + np.sqrt(tree["n2"][0])) + 1e-6

    def bound(lower: np.ndarray, n2: float) -> np.ndarray:
        """Upper bounds of inner products from lower bounds of distances."""
        most = q2 + n2
        return (most - np.maximum(lower - margin, 0) ** 2) / 2 + 1e-12 * most + 1

    away = distances(q, x[tree["centre"][[0]]])[:, 0]
    heap = [(-np.inf, 0, away, bound(away - tree["radius"][0], tree["n2"][0]))]
    while heap:
        room, node, away, most = heapq.heappop(heap)
        if -room < 0:  # floors only rise, so nothing that is left can reach one
            break
        live = np.nonzero(most >= best.floor)[0]
        if not len(live):
            continue
        lo, hi = tree["lo"][node], tree["hi"][node]
        if tree["leaf"][node]:
            reach = np.where(best.floor[live] == NEVER, np.inf, np.sqrt(np.maximum(q2[live] + tree["n2"][node] - 2.0 * best.floor[live], 0)) + 2 * margin[live])
            a = lo + np.searchsorted(tree["to_page"][lo:hi], (away[live] - reach).min())
            b = lo + np.searchsorted(tree["to_page"][lo:hi], (away[live] + reach).max(), "right")
            if a >= b:
                continue
            scores = products(live, a, b)
            worked += scores.size
            good = scores >= best.floor[live][:, None]
            if own is not None:
                mine = np.nonzero((own[live] >= a) & (own[live] < b))[0]
                good[mine, own[live][mine] - a] = False
            i, j = np.nonzero(good)
            if len(i):
                best.add(live[i], a + j, scores[i, j].astype(np.int64))
            continue
        for child in range(lo, hi):
            lower = np.abs(away - tree["to_parent"][child]) - tree["radius"][child]
            may = np.nonzero((most >= best.floor) & (bound(lower, tree["n2"][child]) >= best.floor))[0]
            if not len(may):
                continue
            d = np.full(len(q), np.inf)
            d[may] = distances(wide_q[may], tree["wide"][tree["centre"][[child]]])[:, 0]
            worked += len(may)
            ceiling = np.full(len(q), -np.inf)
            ceiling[may] = bound(d - tree["radius"][child], tree["n2"][child])[may]
            room = (ceiling[may] - best.floor[may]).max()
            if room >= 0:
                heapq.heappush(heap, (-room, child, d, ceiling))
    return best, worked


def found(best: Best, tree: dict, queries: dict) -> list[dict]:
    """Hits as rows."""
    i, j = np.nonzero(best.at >= 0)
    at = best.at[i, j]
    ids, missing = tree["ids"][at].tolist(), tree["missing"][at].tolist()
    named = zip(queries["rows"][i].tolist(), queries["ids"][i].tolist(), tree["rows"][at].tolist(), ids, missing, best.score[i, j].tolist())
    return [{"query_row": a, "query_id": b, "row": c, "vec_id": None if m else d, "score": s} for a, b, c, d, m, s in named]


def pivots(rows: DataFrame, n: int) -> np.ndarray:
    """At most n rows (n is at most PIVOTS), chosen by a hash of their number."""
    return np.array([r.x for r in rows.orderBy(F.xxhash64("row"), "row").limit(n).select("x").collect()], np.int64)


def sharded(rows: DataFrame, n: int, dims: int) -> tuple[DataFrame, int]:
    """rows plus shard, and the number of shards: those of the nearest pivot, by a hash of the row."""
    size = shard_rows(n)
    routing = pivots(rows, min(PIVOTS, -(-n // size)))
    schema = pa.schema([("row", pa.int64()), ("vec_id", pa.int64()), ("x", pa.list_(pa.int64())), ("pivot", pa.int32())])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("x"), dims)
            near = np.concatenate([distances(x[a : a + 4096], routing).argmin(axis=1) for a in range(0, len(x), 4096)] or [np.zeros(0, int)])
            yield batch_of(schema, batch.column("row"), batch.column("vec_id"), batch.column("x"), near.astype(np.int32))

    near = materialize(rows.mapInArrow(assign, "row long, vec_id long, x array<long>, pivot int"), "near-pivots")
    parts, at = [], 0
    for r in near.groupBy("pivot").count().orderBy("pivot").collect():  # at most PIVOTS rows
        parts.append((r.pivot, at, -(-r["count"] // size)))
        at += parts[-1][2]
    cut = near.sparkSession.createDataFrame(parts, "pivot int, first int, parts int")
    shard = (F.col("first") + F.pmod(F.xxhash64("row", F.lit("shard")), F.col("parts"))).cast("int")
    return near.join(F.broadcast(cut), "pivot").select("row", "vec_id", "x", shard.alias("shard")), at


def trees(rows: DataFrame, dims: int, is_query) -> DataFrame:
    """shard, its covering ball (centre, radius, n2) and tree: one row a shard."""
    schema = pa.schema([("shard", pa.int32()), ("centre", pa.list_(pa.float64())), ("radius", pa.float64()), ("n2", pa.float64()), ("tree", pa.binary())])

    def plant(group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by("row")
        x = matrix(group.column("x").chunk(0), dims)
        tree = build(x)
        order = tree.pop("order")
        missing = group.column("vec_id").is_null().to_numpy()[order]
        ids = group.column("vec_id").fill_null(0).to_numpy()[order]
        numbers = group.column("row").to_numpy()[order]
        tie = np.empty(len(order), np.int64)
        tie[np.lexsort((numbers, ids, missing))] = np.arange(len(order))
        x = x[order]
        tree |= {"x": x.astype(np.int32) if largest(x) < 1 << 31 else x, "ids": ids, "missing": missing, "rows": numbers, "tie": tie, "query": group.column("query").to_numpy()[order]}
        root = x[tree["centre"][0]].astype(np.float64).tolist()
        return pa.Table.from_batches([batch_of(schema, [group.column("shard")[0].as_py()], [root], [float(tree["radius"][0])], [float(tree["n2"][0])], [pickle.dumps(tree)])])

    marked = rows.withColumn("query", is_query)
    return marked.groupBy("shard").applyInArrow(plant, "shard int, centre array<double>, radius double, n2 double, tree binary")


def opened(packed: bytes) -> dict:
    tree = pickle.loads(packed)
    return tree | {"wide": tree["x"].astype(np.float64)}


def few_rows_a_batch(df: DataFrame, name: str) -> DataFrame:
    """materialize for rows of some megabytes, of which few go to Python at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf = df.sparkSession.conf
    before = conf.get(key)
    conf.set(key, "4")
    try:
        return materialize(df, name)
    finally:
        conf.set(key, before)


def at_home(planted: DataFrame, k: int) -> DataFrame:
    """block, ball of the shard it lies in, q2 and floor (largest norm and least k-th score of its queries), packed queries, n_worked, and hits in that shard; blocks without a query are left out."""
    ball = [("centre", pa.list_(pa.float64())), ("radius", pa.float64())]
    schema = pa.schema([("block", pa.int32()), *ball, ("q2", pa.float64()), ("floor", pa.int64()), ("queries", pa.binary()), ("n_worked", pa.int64()), ("hits", pa.list_(HIT))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                tree = opened(row["tree"])
                own = np.nonzero(tree["query"])[0]
                if not len(own):
                    continue
                q = tree["x"][own]
                best, worked = search(tree, q, np.full(len(own), NEVER), own, k)
                queries = {"x": q, "rows": tree["rows"][own], "ids": tree["ids"][own], "floor": best.floor}
                yield batch_of(schema, [row["shard"]], [row["centre"]], [row["radius"]], [norms(q).max()], [int(best.floor.min())], [pickle.dumps(queries)], [worked], [found(best, tree, queries)])

    return planted.mapInArrow(scan, f"block int, centre array<double>, radius double, q2 double, floor long, queries binary, n_worked long, hits array<struct<{HITS}>>")


def abroad(pairs: DataFrame, k: int) -> DataFrame:
    """n_worked and hits of pairs of a shard and a block of another (shard, tree, queries)."""
    schema = pa.schema([("n_worked", pa.int64()), ("hits", pa.list_(HIT))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, tree = None, None
        for batch in batches:
            shards, packed = batch.column("shard").to_pylist(), batch.column("tree")
            for i, (shard, asked) in enumerate(zip(shards, batch.column("queries").to_pylist())):
                if shard != at:
                    at, tree = shard, opened(packed[i].as_py())
                queries = pickle.loads(asked)
                best, worked = search(tree, queries["x"], queries["floor"], None, k)
                yield batch_of(schema, [worked], [found(best, tree, queries)])

    return pairs.select("shard", "tree", "queries").mapInArrow(scan, f"n_worked long, hits array<struct<{HITS}>>")


def top_k(vectors: DataFrame, is_query: Column, k: int = K, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows for each row that is_query (a condition on vec_id) holds for."""
    return ranked(all_hits(vectors, is_query, k, scale)[0], k)


def all_hits(vectors: DataFrame, is_query: Column, k: int = K, scale: int = SCALE) -> tuple[DataFrame, DataFrame]:
    """Candidates of all queries, and n_worked by part of the search."""
    spark = vectors.sparkSession
    rows = materialize(integer_vectors(vectors, scale, row_ids(vectors).alias("row"), F.col("vec_id").cast("long").alias("vec_id")), "vectors")
    n, dims = rows.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
    if not n:
        return spark.createDataFrame([], HITS.replace(":", "")), spark.createDataFrame([], "part string, n_worked long")
    dims = max(dims, 1)
    rows = rows.withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(dims) - F.size("x"))))
    dealt, shards = sharded(rows, n, dims)
    planted = few_rows_a_batch(trees(dealt, dims, F.coalesce(is_query, F.lit(False))), "trees")
    home = few_rows_a_batch(at_home(planted, k), "home")
    # covering balls: the nearest a vector of the shard can lie to a query of the block
    balls = planted.select("shard", F.col("centre").alias("c"), F.col("radius").alias("r"), "n2")
    pairs = home.select("block", "centre", "radius", "q2", "floor", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")).filter("shard <> block").join(balls, "shard")
    gap = F.sqrt(F.aggregate(F.zip_with("centre", "c", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)) - F.col("radius") - F.col("r")
    gap = F.greatest(gap - 1e-6 * (F.sqrt("q2") + F.sqrt("n2")) - 1e-6, F.lit(0.0))
    reached = (F.col("q2") + F.col("n2") - gap * gap) / 2 + 1e-9 * (F.col("q2") + F.col("n2")) + 1 >= F.col("floor")
    pairs = pairs.filter(reached).select("block", "shard")
    far = pairs.join(home.select("block", "queries"), "block").join(planted.select("shard", "tree"), "shard")
    far = few_rows_a_batch(abroad(far, k), "abroad")
    hits = home.select(F.explode("hits").alias("h")).unionByName(far.select(F.explode("hits").alias("h"))).select("h.*")
    worked = home.select(F.lit("home").alias("part"), "n_worked").unionByName(far.select(F.lit("abroad").alias("part"), "n_worked"))
    return hits, worked.groupBy("part").agg(F.sum("n_worked").alias("n_worked"))


def ranked(hits: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "row"))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
