"""Core library: measures, page cleaning, tokenizer, scoring, curation, on hand-made rows."""

import json
import math
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.functions.html import convert, parse_pages
from granary.operators import align, curate, evalstats, fairness, mixture, vectors
from granary.operators import bpe_codec as codec
from granary.operators import bpe_train as bpe
from granary.sources import tokenizer_file
from granary.sources.tokenizer_file import tokenizer_from_json, tokenizer_json

def drawn(seed, n=40):
    """Texts of runs of characters, each run from one class of code points."""
    rng = random.Random(seed)
    classes = ["abcXYZ", "0123456789", " ", " \t\n", ".,'-!%", [chr(c) for c in range(0x904, 0x940)], [chr(c) for c in range(0xC05, 0xC4D)], [chr(c) for c in range(0x1F600, 0x1F640)], [chr(c) for c in range(0x12000, 0x12080)], "\u00a0\u2003"]
    return ["".join("".join(rng.choices(rng.choice(classes), k=rng.randint(1, 5))) for _ in range(rng.randint(0, 9))) for _ in range(n)]


def counted(text):
    """(units, words): runs of letters, marks and numbers, and each other character that is no white space; runs of what is no white space."""
    kinds = ["s" if c.isspace() else "a" if unicodedata.category(c)[0] in "LMN" else "o" for c in text]
    before = ["s", *kinds]
    return sum(k == "o" or (k == "a" and b != "a") for k, b in zip(kinds, before)), sum(k != "s" and b == "s" for k, b in zip(kinds, before))


def test_units_and_words(documents):
    texts = drawn(1)
    rows = documents(list(enumerate(texts))).select("doc_id", T.faithful_units(F.col("text")).alias("u"), T.word_count(F.col("text")).alias("w")).collect()
    assert {r.doc_id: (r.u, r.w) for r in rows} == {i: counted(t) for i, t in enumerate(texts)}


def test_normalize_markdown(documents):
    text = "\u3000a\u00a0b \t\n\n\n\n\nc\u3000 "
    assert documents([(1, text), (2, "")]).select(T.normalize_markdown(F.col("text"))).orderBy("doc_id").toPandas().iloc[:, 0].tolist() == ["a b\n\n\nc\n", "\n"]


def test_nfc_keeps_joiners(documents):
    r = T.nfc_normalize(documents([(1, "e\u0301 \u0915\u094d\u200d\u0937")])).first()
    assert (r.text, r.changed, r.joiners) == ("\u00e9 \u0915\u094d\u200d\u0937", True, 1)


def test_integrity_check(spark):
    a = spark.createDataFrame([(1, 5), (2, 6), (3, None)], "id long, n long")
    b = spark.createDataFrame([(1, 5), (2, 7), (4, 1)], "id long, n long")
    assert sorted(tuple(r) for r in T.integrity_check(a, b, "id", ["n"]).collect()) == [(2, "n", "6", "7"), (4, "n", None, "1")]


def test_html_to_markdown():
    page = """<html><head><title>t</title><style>x{}</style><link rel="stylesheet" href="s.css"><link rel="mw:PageProp/Category" href="./Cat"></head>
    <body><script>track(1)</script><h2>Head</h2><p>One <b>two</b> <a href="/x?y=1">three</a><br>four</p><ul><li>a<li>b</ul><ol><li>c</li></ol>
    <img src="i.png" alt="pic"><span>kept</span></body></html>"""
    text, links = convert(page, "https://h.org/d/p")
    for part in ("## Head", "One **two** [three](https://h.org/x?y=1)  \nfour", "\n- a\n- b", "\n1. c", "![pic](https://h.org/d/i.png)", "kept"):
        assert part in text, part
    assert "track(" not in text and "x{}" not in text and "s.css" not in text
    assert [x["url"] for x in links] == ["https://h.org/x?y=1", "https://h.org/d/i.png"]
    assert convert(None, None) == ("", [])


def test_parse_pages_rows(spark):
    rows = parse_pages(spark.createDataFrame([(1, "http://h/", "<p>x</p>"), (2, None, None)], "page_id long, url string, html string")).orderBy("page_id").collect()
    assert [r.markdown for r in rows] == ["x\n", "\n"]


@pytest.fixture(scope="module")
def vocabulary(spark, documents):
    docs = documents([(1, "the cat sat on the mat\nthe cat ate the rat that sat\n", "en"), (2, "le chat et le rat\nle chat dort", "fr")])
    counts = bpe.weighted_piece_counts(docs, {"en": 2, "fr": 3})
    return bpe.train(counts, 256 + 36), counts


def sequential(counts, size):
    """One merge at a time, for comparison."""
    words = [(list(r.piece), r["count"]) for r in counts.collect()]
    tokens = ["[UNK]", *sorted({c for w, _ in words for c in w})]
    merges = []
    while len(tokens) < size - 256:
        n = {}
        for w, k in words:
            for p in zip(w, w[1:]):
                n[p] = n.get(p, 0) + k
        ids = {t: i for i, t in enumerate(tokens)}
        a, b = min(n, key=lambda p: (-n[p], ids[p[0]], ids[p[1]]))
        merges.append((a, b))
        if a + b not in ids:
            tokens.append(a + b)
        for w, _ in words:
            i = 0
            while i + 1 < len(w):
                if (w[i], w[i + 1]) == (a, b):
                    w[i : i + 2] = [a + b]
                i += 1
    return tokens, merges


def test_training_equals_sequential_merging(vocabulary):
    v, counts = vocabulary
    tokens, merges = sequential(counts, 292)
    assert v.tokens[:-256] == tokens and v.merges == merges


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_training_with_many_ties_and_runs_equals_sequential_merging(documents, seed):
    """Few letters and equal counts: runs of one symbol, pairs that share symbols, strings made twice; words are written anew on the way."""
    rng = random.Random(seed)
    lines = [" ".join("".join(rng.choice("aabc") for _ in range(rng.randint(1, 9))) for _ in range(6)) for _ in range(25)]
    counts = bpe.weighted_piece_counts(documents([(1, "\n".join(lines))]), {})
    v = bpe.train(counts, 256 + 60)
    tokens, merges = sequential(counts, 256 + 60)
    assert v.tokens[:-256] == tokens and v.merges == merges


def test_merging_skips_word_ends_and_symbols_that_are_not_trained(spark):
    words = spark.createDataFrame([([1, 1, 1, 1, 1], 3), ([1, 9, 1, 0, 1], 50), ([1], 50), ([], 1), ([2, 1], 2)], bpe.WORDS)
    tokens, merges = bpe.grow(words, ["[UNK]", "a", "b"], 5)
    assert tokens[3:] == ["aa", "aaa"] and merges == [("a", "a"), ("aa", "a")]  # aa aa a: of equal counts the smaller right id
    with pytest.raises(ValueError):
        bpe.grow(words.limit(0), ["[UNK]", "a", "b"], 4)


def test_training_equals_public_trainer(spark, documents, tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers, trainers

    lines = ["the cat sat on the mat", "a cat that ate the rat", "  two  spaces and more"] * 3
    (tmp_path / "t.txt").write_text("\n".join(lines) + "\n")
    public = Tokenizer(models.BPE(unk_token="[UNK]"))
    public.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="never")
    public.train([str(tmp_path / "t.txt")], trainers.BpeTrainer(vocab_size=50, min_frequency=1, special_tokens=["[UNK]"]))
    want = json.loads(public.to_str())["model"]
    v = bpe.train(bpe.weighted_piece_counts(documents([(1, "\n".join(lines) + "\n")]), {}), 306)
    assert {t: i for i, t in enumerate(v.tokens[:-256])} == want["vocab"]
    assert v.merges == [tuple(m) for m in want["merges"]]


def test_too_large_vocabulary_raises(documents):
    with pytest.raises(ValueError):
        bpe.train(bpe.weighted_piece_counts(documents([(1, "ab")]), {}), 300)


def test_codec_round_trip_and_public_agreement(vocabulary, spark, documents):
    from tokenizers import Tokenizer

    v, _ = vocabulary
    public = Tokenizer.from_str(tokenizer_json(v))
    assert tokenizer_from_json(tokenizer_json(v)) == v
    samples = drawn(2, 20)
    docs = documents(list(enumerate([*samples, "the cat\n sat ▁ thththe" + "a" * 3000])))
    rows = codec.decode(codec.encode(docs, v), v).orderBy("doc_id").collect()
    for r in rows:
        assert r.decoded == r.text.replace("▁", " ")
        assert list(r.ids) == public.encode(r.text).ids
    gate = {r.doc_id: r.exact for r in codec.roundtrip(docs, v).collect()}
    assert gate == {**{i: True for i in range(20)}, 20: False}


def test_broken_bytes_decode_to_replacement(vocabulary):
    c = codec.Codec(vocabulary[0])
    assert c.decode([c.ids["<0xFF>"], c.ids["t"]]) == "�t"


def test_parse_token_ids(spark):
    rows = spark.createDataFrame([("[1, 2 3]",), ("",), ("1,,2",), ("1, 2,",), ("99",), ("a",)], "t string").select(codec.parse_token_ids(F.col("t"), 50).alias("p")).collect()
    assert [r.p.ids for r in rows] == [[1, 2, 3], [], None, None, None, None]
    assert [r.p.error is None for r in rows] == [True, True, False, False, False, False]


def test_fairness_on_published_ratios(spark):
    rows = spark.createDataFrame([("en", 118271 / 225817), ("kn", 7675 / 14389), ("hi", 56168 / 105111), ("te", 23251 / 43472)], "lang string, ratio double")
    r = fairness.fairness_score(rows, "hi").first()
    assert math.isclose(r.spread, 0.011102913445981577) and math.isclose(r.score, 90066.45011376948) and r.penalty == 1.0
    assert fairness.fairness_score(rows.limit(1), "hi").first().score == math.inf
    assert [x["rank"] for x in fairness.ratio_gate(rows).orderBy("ratio").collect()] == [1, 2, 3, 4]


def test_pii_spellings(documents):
    """Identifiers as people write them: in one run or in groups, national and international."""
    hit = {
        "[BANK]": ["4111111111111111", "4111 1111 1111 1111", "4111-1111-1111-1111", "3782 822463 10005", "378282246310005", "4222222222222"],
        "[AADHAAR]": ["234123412346", "2341 2341 2346", "2341-2341-2346"],
        "[PHONE]": ["+1 (212) 555-0100", "+91 98765 43210", "+919876543210", "555-123-4567", "(212) 555-0100", "98765 43210", "+44 20 7946 0958"],
        "[PAN]": ["ABCDE1234F"], "[IP]": ["10.0.0.1"], "[EMAIL]": ["a.b@c.org"],
    }
    miss = ["4111 1111 1111 1112", "2341 2341 2347", "1234 5678", "2024-05-06", "12345", "page 100-200", "1.5.2"]
    rows = [(i, f"x {t} y", w) for i, (t, w) in enumerate([(t, w) for w, ts in hit.items() for t in ts] + [(t, t) for t in miss])]
    got = {r.doc_id: r.text_redacted for r in curate.pii_redact(documents([r[:2] for r in rows])).collect()}
    assert [got[i] for i, _, _ in rows] == [f"x {w} y" for _, _, w in rows]


def test_exact_dedup_of_null_texts_and_clusters(documents):
    rows = documents([(1, "a b"), (2, None), (3, "a b"), (4, None), (5, "")])
    assert {r.doc_id: (r.keep_id, r.cluster_size, r.kept) for r in curate.exact_dedup(rows).collect()} == {1: (1, 2, True), 3: (1, 2, False), 2: (2, 2, True), 4: (2, 2, False), 5: (5, 1, True)}
    assert {r.doc_id: r.class_id for r in curate.shingle_classes(rows).collect()} == {1: 1, 3: 1, 2: 2, 4: 4, 5: 5}


def test_superwords_cross_spaces_and_keep_the_first_stage(documents, vocabulary):
    v, _ = vocabulary
    docs = documents([(1, "the cat sat on the mat. the cat sat on a rat\nthe cat sat\n"), (2, "the cat sat"), (3, "1 2 1 2 1 2 1 2 1 2\n")])
    grown, merges = codec.superword_train(docs, v, 3)
    assert grown.tokens[: len(v.tokens) - 256] == v.tokens[:-256] and len(grown.tokens) == len(v.tokens) + 3
    assert grown.merges == [*v.merges, *merges] and all("▁" in (a + b)[1:] and not set(".!?\n") & set(a) for a, b in merges)
    assert not any("1" in a + b for a, b in merges)  # no prose


def test_merge_entries():
    assert tokenizer_file.merge_pair("a b") == tokenizer_file.merge_pair(["a", "b"]) == ("a", "b")
    for bad in ("ab", "a b c", ["a"], ["a", ""], "a ", 3):
        with pytest.raises(ValueError):
            tokenizer_file.merge_pair(bad)


def test_check_digits(spark):
    rows = spark.createDataFrame([("4111111111111111", "234123412346"), ("4111111111111112", "234123412347")], "c string, a string").select(curate.luhn_ok(F.col("c")).alias("c"), curate.verhoeff_ok(F.col("a")).alias("a")).collect()
    assert [tuple(r) for r in rows] == [(True, True), (False, False)]


def test_pii_and_secrets(documents):
    text = 'mail a.b@c.org, card 4111111111111111, id 234123412346, +1 (212) 555-0100, 10.0.0.1, ABCDE1234F, token = "0123456789abcdef0123"'
    r = curate.pii_redact(documents([(1, text), (2, None)])).orderBy("doc_id").collect()
    assert r[0].text_redacted == 'mail [EMAIL], card [BANK], id [AADHAAR], [PHONE], [IP], [PAN], token = "0123456789abcdef0123"'
    assert [r[0][c] for c in ("n_aadhaar", "n_pan", "n_bank", "n_phone", "n_email", "n_ip")] == [1] * 6
    assert curate.secret_scan(documents([(1, text)])).first().n_secrets == 1


def test_minhash_and_clusters(documents):
    base = " ".join(f"w{i}" for i in range(60))
    docs = documents([(1, base), (2, base + " x"), (3, base), (4, "other text that is not like it at all"), (5, ""), (6, None)])
    pairs = curate.minhash_pairs(docs)
    assert [(r.id_a, r.id_b) for r in pairs.collect()] == [(1, 2)]
    rows = {r.doc_id: (r.cluster_id, r.cluster_size) for r in curate.dedup_clusters(docs, pairs, curate.shingle_classes(docs)).collect()}
    assert rows == {1: (1, 3), 2: (1, 3), 3: (1, 3), 4: (4, 1), 5: (5, 1), 6: (6, 1)}


def test_decontamination(spark, documents):
    bench = spark.createDataFrame([(1, "Alpha beta gamma delta epsilon zeta"), (2, "One two")], "item_id long, text string")
    docs = documents([(1, "x alpha BETA gamma\ndelta epsilon zeta y"), (2, "one three two"), (3, "so one two it is"), (4, None)])
    assert sorted(tuple(r) for r in curate.decontaminate_exact(docs, bench).collect()) == [(1, 1), (3, 2)]
    assert sorted(tuple(r) for r in curate.decontaminate_ngram(docs, bench).collect()) == [(1, 1, 1), (3, 2, 1)]
    assert curate.decontaminate_exact(docs, bench.limit(0)).count() == 0


def test_synthetic_cap_holds_after_capping(spark):
    docs = spark.createDataFrame([(i, "synthetic" if i % 2 else "native", 10) for i in range(200)], "doc_id long, origin string, tokens long")
    rows = curate.synthetic_cap(docs).join(docs, "doc_id").filter("kept")
    t = {r.origin: r.t for r in rows.groupBy("origin").agg(F.sum("tokens").alias("t")).collect()}
    assert t["native"] == 1000 and 120 <= t["synthetic"] <= 1000 * 0.12 / 0.88


def test_mixture(spark, documents):
    docs = documents([(1, 'def f(): return "x"'), (2, "plain words"), (3, "mots", "fr")])
    assert {r.doc_id: r.bucket for r in mixture.exclusive_buckets(docs).collect()} == {1: "code", 2: "general", 3: "native"}
    plan = spark.createDataFrame([("general", 2.0), ("code", 0.0)], "bucket string, passes double")
    assert [tuple(r) for r in mixture.sample_mixture(mixture.exclusive_buckets(docs), plan, "s").orderBy("copy_no").collect()] == [(2, "general", 1), (2, "general", 2)]


def test_rewards_stop_at_critical_step(spark):
    cols = "episode_id string, prompt_id long, step long, task double, schema_ok boolean, grounding double, efficiency double, language double, learned double, critical boolean"
    rows = spark.createDataFrame([("a", 1, 1, 1.0, True, 1.0, 1.0, 1.0, 1.0, False), ("b", 1, 1, 1.0, True, 1.0, 1.0, 1.0, 1.0, False), ("b", 1, 2, 0.0, True, 0.0, 0.0, 0.0, 0.0, True), ("b", 1, 3, 0.0, True, 0.0, 0.0, 0.0, 0.0, False)], cols)
    got = {r.episode_id: (round(r.reward, 9), r.terminated_at) for r in align.rollout_rewards(rows).collect()}
    assert got == {"a": (1.0, None), "b": (-1.0, 2)}


def test_gates_fail_without_metric(spark):
    m = spark.createDataFrame([("x", "en", 1.0)], "metric string, scope string, value double")
    g = spark.createDataFrame([("x", "en", ">=", 1.0), ("y", "en", ">=", 1.0)], "metric string, scope string, op string, threshold double")
    assert {r.metric: r["pass"] for r in evalstats.launch_gates(m, g).collect()} == {"x": True, "y": False, "overall": False}


def test_vectors_against_numpy(spark):
    import numpy as np

    x = np.random.default_rng(1).normal(size=(50, 6))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    c = u @ u.T
    np.fill_diagonal(c, -9)
    assert {(r.vec_id, r.neighbor) for r in vectors.cosine_neighbors(df, 1).collect()} == set(enumerate(c.argmax(axis=1).tolist()))
    p = vectors.embedding_projection(df).orderBy("vec_id").toPandas()[["x", "y"]].to_numpy()
    want = (x - x.mean(axis=0)) @ np.linalg.svd(x - x.mean(axis=0))[2][:2].T
    assert np.allclose(np.abs(p), np.abs(want / np.abs(want).max()), atol=1e-6)


def test_logistic_against_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    x, w = rng.normal(size=(80, 2)), np.zeros(3)
    y = (x[:, 0] > 0).astype(float)
    a = np.c_[x, np.ones(80)]
    for _ in range(5):
        w = w - a.T @ (1 / (1 + np.exp(-a @ w)) - y) / 80
    df = spark.createDataFrame([(*map(float, r), int(k)) for r, k in zip(x, y)], "a double, b double, y int")
    assert np.allclose(vectors.logistic_train(df, ["a", "b"], "y", epochs=5), w)


def test_registry_runs_on_empty_tables(spark, tmp_path):
    """A few queries over tables without rows."""
    from granary.plans import registry

    for name in ("documents", "labels", "conversations", "events", "benchmark", "embeddings"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    for name in ("corpus_summary", "exact_dedup", "quality_filter", "synthetic_cap", "repeated_spans", "minhash_pairs", "assemble_conversations", "rollout_rewards", "pii_redact", "sample_mixture",
                 "decontaminate_exact", "decontaminate_13gram", "decontaminate_minhash", "paragraph_lang_script", "cosine_neighbors", "semantic_clusters", "embedding_projection", "bpe_train", "encode", "rights_shares", "deletion_log", "ledger", "preference_pairs", "rater_agreement"):
        assert registry.queries()[name](spark, str(tmp_path)).count() == 0, name


def test_exposure_decision(spark):
    plan = lambda rows: mixture.exposure_decision(mixture.exposure_plan(spark.createDataFrame(rows, "bucket string, tokens long"), {"a": 0.5, "b": 0.5}, 100.0)).first()
    assert tuple(plan([("a", 80), ("b", 20), ("c", 9)])) == (100.0, 70.0, 50.0, 0, True)
    assert tuple(plan([("a", 80), ("b", 10)])) == (100.0, 60.0, 50.0, 1, False)  # b five times
    assert tuple(plan([("a", 20), ("b", 20)])) == (100.0, 40.0, 50.0, 0, False)
    assert plan([]).go is False


def test_generalization_gap_sizes(spark):
    from granary.plans.mixture_queries import TRAIN_SIZES, labelled, q_generalization_gap

    d = "/root/testdata/sf0.001"
    there = labelled(spark, d).filter("u < 0.7").count()
    rows = sorted(q_generalization_gap(spark, d).collect())
    assert [r.train_n for r in rows] == [min(n, there) for n in TRAIN_SIZES]
    assert len({r.test_n for r in rows}) == 1
    assert {r.worst_gap for r in rows} == {max(r.gap for r in rows)}
