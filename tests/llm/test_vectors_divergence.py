"""Top-k search, centroid clustering and source divergence against brute force, with nulls, ties, repeats, hostile numbers, empty tables and clashing columns."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.llm import centroids, source_divergence, topk_search
from granary.llm.integer_vectors import clipped

VECTORS = "vec_id long, embedding array<float>, label int"
CLASHING = ("x", "row", "pivot", "shard", "cluster", "distance", "n", "score", "rank", "tree", "block", "source", "term")


def whole(embedding, scale):
    if embedding is None or any(v is None or not math.isfinite(v) for v in embedding):
        return None
    clip = lambda v: max(-(2**63), min(v, 2**63 - 1))
    return [clip(math.floor(float(np.float32(v)) * scale)) for v in embedding]


def vectors(spark, rows):
    frame = spark.createDataFrame([(i, e, 0) for i, e in rows], VECTORS)
    for c in CLASHING:
        frame = frame.withColumn(c, F.lit("clash"))
    return frame


def best_others(rows, k, step):
    found = []
    kept = [(i, whole(e, 64)) for i, e in rows]
    kept = [(i, x) for i, x in kept if x is not None]
    for at, (i, q) in enumerate(kept):
        if i is None or i % step:
            continue
        scored = [(max(-(2**63), min(sum(a * b for a, b in zip(q, x)), 2**63 - 1)), j) for n, (j, x) in enumerate(kept) if n != at]
        scored.sort(key=lambda s: (-s[0], s[1] is None, s[1] or 0))
        found += [(i, r, j, s) for r, (s, j) in enumerate(scored[:k], 1)]
    return sorted(found, key=repr)


def hostile_vectors(dims):
    r = np.random.default_rng(3)
    centres = r.normal(size=(6, dims)) / 8
    rows = [(i, (centres[i % 6] + r.normal(size=dims) * [0.01, 0.2][i % 2]).astype(np.float32).tolist()) for i in range(700)]
    rows += [(1000 + i, rows[0][1]) for i in range(300)]  # a hot vector, at third of all rows
    rows += [(20, rows[7][1]), (20, rows[7][1]), (None, rows[7][1]), (None, rows[0][1])]  # repeated and missing ids
    rows += [(2000, None), (2020, [float("nan")] * dims), (2040, [None] * dims), (2060, [float("inf")] + [0.0] * (dims - 1)), (2080, [0.0] * dims)]
    return rows


@pytest.mark.parametrize("size", [1024, 90])
def test_top_k_by_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(topk_search, "shard_rows", lambda n: size)
    rows = hostile_vectors(16) + [(2100, []), (2120, [0.5, -0.5, 1.0])]
    got = topk_search.top_k(vectors(spark, rows), F.col("vec_id") % 20 == 0, 7).collect()
    assert sorted(map(tuple, got), key=repr) == best_others(rows, 7, 20)


def test_top_k_of_numbers_beyond_doubles_and_few_rows(spark):
    rows = [(i, [3e9 * (i - 4), 1.5, -(2.0**40) * i]) for i in range(9)] + [(40, [3e38, -3e38, 1.0]), (60, [3e38, 3e38, 1.0])]
    got = topk_search.top_k(vectors(spark, rows), F.col("vec_id") % 20 == 0, 20).collect()
    assert sorted(map(tuple, got), key=repr) == best_others(rows, 20, 20)
    for few in ([], [(0, None)], [(0, [1.0])], [(1, [1.0]), (2, [2.0])]):
        assert topk_search.top_k(vectors(spark, few), F.col("vec_id") % 20 == 0).collect() == []


def test_tree_bounds_hold_and_spare_work():
    r = np.random.default_rng(5)
    x = np.concatenate([np.floor(64 * (c + r.normal(size=(400, 8)) * 0.02)) for c in r.normal(size=(12, 8))]).astype(np.int64)
    x = np.concatenate([x, np.repeat(x[:1], 900, axis=0)])
    tree = topk_search.build(x, 32, 8)
    order = tree["order"]
    assert sorted(order) == list(range(len(x)))
    placed = x[order]
    for n in range(len(tree["leaf"])):
        below = [n]
        while not all(tree["leaf"][b] for b in below):
            below = [c for b in below for c in ([b] if tree["leaf"][b] else range(tree["lo"][b], tree["hi"][b]))]
        rows = np.concatenate([np.arange(tree["lo"][b], tree["hi"][b]) for b in below])
        d = topk_search.distances(placed[rows], placed[[tree["centre"][n]]])[:, 0]
        assert d.max() <= tree["radius"][n] + 1e-6 and topk_search.norms(placed[rows]).max() == tree["n2"][n]
        assert not tree["leaf"][n] or len(rows) <= 32
    tree |= {"x": placed, "wide": placed.astype(float), "tie": np.arange(len(x))}
    q = placed[::50]
    best, worked = topk_search.search(tree, q, np.full(len(q), topk_search.NEVER), np.arange(0, len(x), 50), 10)
    scores = q @ placed.T
    scores[np.arange(len(q)), np.arange(0, len(x), 50)] = -(10**9)
    for i in range(len(q)):
        assert best.at[i].tolist() == np.lexsort((np.arange(len(x)), -scores[i]))[:10].tolist()
    assert worked < 0.6 * scores.size


def lloyd(rows, dims=64, k=8, rounds=10):
    kept = [(i, whole(e, 1024)) for i, e in rows]
    kept = [(i, x) for i, x in kept if x is not None and len(x) == dims]
    seeds = sorted(kept, key=lambda v: (v[0] is None, hashlib.sha256(f"3:{v[0]}".encode()).hexdigest(), v[1]))[:k]
    means = [x for _, x in seeds]
    nearest = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, m)), c) for c, m in enumerate(means))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, x in kept:
            groups[nearest(x)[1]].append(x)
        means = [[sum(v) // len(groups[c]) for v in zip(*groups[c])] if c in groups else m for c, m in enumerate(means)]
    found = [(i, *nearest(x)) for i, x in kept]
    clip = lambda v: min(v, 2**63 - 1)
    per = Counter()
    for _, d, c in found:
        per[c] += clip(d)
    digest = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in means]
    return sorted([(i, c, clip(d), clip(per[c]), clip(sum(per.values())), digest[c]) for i, d, c in found], key=repr)


def test_centroids_by_brute_force(spark):
    rows = hostile_vectors(64) + [(3000, [1.0] * 63), (3001, []), (3002, [1.0] * 65)]
    got = centroids.clusters(vectors(spark, rows)).collect()
    assert sorted(map(tuple, got), key=repr) == lloyd(rows)


def test_centroids_of_few_equal_and_huge_vectors(spark):
    for rows in ([], [(1, None)], [(1, [0.5] * 64)], [(i, [0.25] * 64) for i in range(30)], [(i, [3e38 * (-1) ** i, *[float(i)] * 63]) for i in range(12)], [(i, [2e15 * (i % 5), *[1.0] * 63]) for i in range(40)]):
        got = centroids.clusters(vectors(spark, rows)).collect()
        assert sorted(map(tuple, got), key=repr) == lloyd(rows)


def test_threshold_algorithm_stops_only_beyond_the_best():
    r = np.random.default_rng(1)
    for dims, k in ((1, 40), (2, 25), (3, 9), (64, 8)):
        means, x = r.integers(-9, 10, (k, dims)), r.integers(-12, 13, (500, dims))
        which, best, exact = centroids.nearest(x, means)
        d = ((x[:, None, :] - means[None]) ** 2).sum(axis=2)
        assert (which == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()
        assert exact <= d.size and (dims > 1 or exact < d.size / 3)
    assert clipped(np.array([2**70, -(2**70), 5], object)).tolist() == [2**63 - 1, -(2**63), 5]


TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def audited(rows, min_docs, top):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    n, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source, terms = lang or "", source or "", TERM.findall((text or "").translate(lower))
        groups[lang].add(source)
        n[lang, source].update(terms)
        n[lang, None].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, d in docs[lang].items() if d >= min_docs]
        total = {s: sum(n[lang, s][t] for t in kept) for s in [*sources, None]}
        p = {s: {t: 1 + 10**9 * (n[lang, s][t] + 5) // (total[s] + 5 * len(kept)) for t in kept} for s in [*sources, None]}
        for s in sources:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            out += [(lang, s, "pair", o, -v, r) for r, (v, _, o) in enumerate(sorted(pairs), 1)]
            terms = [(p[None][t] - p[s][t], t.encode(), t) for t in kept if n[lang, s][t] and p[s][t] > p[None][t]]
            out += [(lang, s, "term", t, -v, r) for r, (v, _, t) in enumerate(sorted(terms)[:top], 1)]
    return sorted(out)


def corpus():
    r = np.random.default_rng(8)
    words = [f"{a}{b}{c}" for a in ("k", "É", "Zz", "\U0001f642", "￮") for b in ("a", "B", "") for c in "abcdefghij"]
    rows = []
    for i in range(400):
        picked = r.choice(words, int(r.integers(0, 60)), p=np.arange(len(words), 0, -1) / sum(range(len(words) + 1)))
        rows.append((" ".join(picked), ["en", None, "", "de"][i % 4], [None, "b", "a", "퟿", "\U00010000", ""][int(r.integers(0, 6)) if i % 3 else 1]))
    rows += [(None, "en", "b"), ("", "fr", "one"), ("1 2_3@", "xx", "p"), (None, "xx", "q"), ("ab " * 50_000, "en", "a")]
    return rows + rows[:30]


@pytest.mark.parametrize("min_docs, top", [(3, 50), (9, 4), (200, 5)])
def test_divergence_by_brute_force(spark, min_docs, top):
    rows = corpus()
    docs = spark.createDataFrame(rows, "text string, lang string, source string").repartition(5)
    for c in ("term", "n", "docs", "p0", "block", "bucket", "item", "value", "rank", "total"):
        docs = docs.withColumn(c, F.lit("clash"))
    got = source_divergence.divergence(docs, min_docs, top)
    assert sorted(map(tuple, got.collect())) == audited(rows, min_docs, top)
    assert source_divergence.divergence(docs.limit(0)).collect() == []


def test_divergence_with_many_sources_and_buckets(spark, monkeypatch):
    monkeypatch.setattr(source_divergence, "BLOCK_SOURCES", 4)
    monkeypatch.setattr(source_divergence, "BUCKET_TERMS", 16)
    r = np.random.default_rng(2)
    rows = [(" ".join(r.choice([f"w{chr(97 + a)}{chr(97 + b)}" for a in range(9) for b in range(9)], 12)), "l", f"s{int(r.integers(0, 17))}") for _ in range(300)]
    got = source_divergence.divergence(spark.createDataFrame(rows, "text string, lang string, source string"), 20)
    assert sorted(map(tuple, got.collect())) == audited(rows, 20, 50)


def test_skybands_merge_to_the_skyband_of_all():
    r = np.random.default_rng(4)
    terms = sorted({bytes(r.integers(97, 123, 4).astype(np.uint8)) for _ in range(5000)})
    n, lang_n = r.integers(1, 60, len(terms)), r.integers(60, 300, len(terms))
    want = {t for t, k in zip(terms, source_divergence.undominated(n, lang_n, 6)) if k}
    plain = {terms[i] for i in range(len(terms)) if ((n[:i] >= n[i]) & (lang_n[:i] <= lang_n[i])).sum() < 6}
    band, order = source_divergence.Skyband(6), r.permutation(len(terms))
    for a in range(0, len(order), 700):
        at = order[a : a + 700]
        band.add([terms[i] for i in at], n[at], lang_n[at])
    band.merge()
    assert want == plain == set(band.terms) and len(want) < len(terms) / 4
