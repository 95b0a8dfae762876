"""Training by segments, word windows and what is built on them, exact vector searches, against plain versions."""

import json
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.functions import config
from granary.operators import bpe_codec as codec
from granary.operators import bpe_train as bpe
from granary.operators import curate, grams, vectors
from granary.sources.tokenizer_file import tokenizer_json

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def trained(spark):
    """(merges of a public trainer, our vocabulary) of 10,000 entries on the smallest documents."""
    from tokenizers import Tokenizer, models, pre_tokenizers, trainers

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    public = Tokenizer(models.BPE(unk_token="[UNK]"))
    public.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="never")
    weighted = (line for r in docs.collect() for line in r.text.splitlines(keepends=True) if line for _ in range(config.WEIGHTS.get(r.lang, 1)))
    public.train_from_iterator((x for x in weighted), trainers.BpeTrainer(vocab_size=config.VOCAB_SIZE - 256, special_tokens=["[UNK]"], show_progress=False))
    return json.loads(public.to_str())["model"], bpe.train(bpe.weighted_piece_counts(docs, config.WEIGHTS), config.VOCAB_SIZE)


def test_ten_thousand_entries_equal_a_public_trainers(trained):
    want, v = trained
    assert len(v.tokens) == config.VOCAB_SIZE and v.complete
    assert v.merges == [tuple(m) for m in want["merges"]]
    assert {t: i for i, t in enumerate(v.tokens[:-256])} == want["vocab"]


def test_tokens_by_language_equal_a_public_tokenizers(spark, trained):
    from tokenizers import Tokenizer

    v = trained[1]
    public = Tokenizer.from_str(tokenizer_json(v))
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = Counter()
    for r in docs.collect():
        want[r.lang] += len(public.encode(r.text).ids)
    got = codec.encode(docs, v).groupBy("lang").agg(F.sum(F.size("ids")).alias("n"))
    assert {r.lang: r.n for r in got.collect()} == dict(want)


@pytest.mark.parametrize("candidates, segments", [(1, 10**6), (3, 5), (64, 40), (4, 10**6)])
def test_epochs_of_any_size_give_the_same_merges(spark, documents, monkeypatch, candidates, segments):
    from test_core import sequential

    monkeypatch.setattr(bpe, "SEGMENTS", segments)
    monkeypatch.setattr(bpe, "CANDIDATES", candidates)
    rng = random.Random(candidates)
    lines = [" ".join("".join(rng.choice("aabcd") for _ in range(rng.randint(1, 9))) for _ in range(5)) for _ in range(20)]
    counts = bpe.weighted_piece_counts(documents([(1, "\n".join(lines))]), {})
    tokens, merges = sequential(counts, 256 + 45)
    got = bpe.grow_by_segments(bpe.symbol_ids(counts, tokens[:7]), [t for t in tokens if len(t) == 1 or t == "[UNK]"], 45, candidates)
    assert got == (tokens, merges)


def test_a_string_that_is_made_twice_ends_the_epoch():
    """ab c and a bc both make abc: the second merge takes the id of the first, and its pairs add up only in the next epoch."""
    found = [(np.array(s, np.int32).tobytes(), n) for s, n in (([1, 2, 3], 5), ([2, 3], 50), ([1, 2], 60), ([1, 4, 4], 1))]
    tokens = ["[UNK]", "a", "b", "c", "d"]
    ids = {t: i for i, t in enumerate(tokens)}
    merges, outcome = bpe.merge_segments(found, tokens, ids, None, 100)
    assert merges[:3] == [("a", "b"), ("b", "c"), ("ab", "c")] and tokens[5:8] == ["ab", "bc", "abc"]
    again = {"[UNK]": 0, "a": 1, "b": 2, "ab": 3}
    assert bpe.merge_segments([(np.array([1, 2, 1, 2], np.int32).tobytes(), 2)], list(again), dict(again), None, 9)[0] == [("a", "b")]


def test_training_on_little_text_gives_what_there_is(documents):
    for rows in ([(1, "ab")], [(1, "")], [(1, None)], []):
        v = bpe.train(bpe.weighted_piece_counts(documents(rows), {}), 300, strict=False)
        assert not v.complete and v.tokens[0] == "[UNK]" and len(v.tokens) <= 300
        with pytest.raises(ValueError):
            bpe.train(bpe.weighted_piece_counts(documents(rows), {}), 300)


TEXTS = ["One two  three\tone two\nthree one two three", "", " \n", "é ü é ü é", "x", "a b c d e f g", "one TWO three four", "A b\x0bc"]


def test_windows_by_brute_force():
    words = grams.Words([t.lower().encode() for t in TEXTS])
    seen = {}
    for size in (1, 2, 3, 5):
        first, h = words.windows(size)
        plain = [(i, p, " ".join(w[p : p + size])) for i, t in enumerate(TEXTS) for w in [t.lower().split()] for p in range(len(w) - size + 1)]
        assert [(i, p, g) for i, p, g in zip(words.texts[first].tolist(), words.places[first].tolist(), words.text(first, size))] == plain
        for (_, _, g), x in zip(plain, h.tolist()):
            assert seen.setdefault(g, x) == x
    assert len(set(seen.values())) == len(seen)
    assert [len(list(grams.slices(t))) for t in ([], [b""], [b"x" * (2 << 20), b"y"])] == [0, 1, 2]


def covered(texts, n):
    grams_ = {i: [" ".join(w[p : p + n]) for p in range(len(w) - n + 1)] for i, t in texts for w in [(t or "").lower().split()]}
    often = Counter(g for gs in grams_.values() for g in gs)
    return {i: len({p + o for p, g in enumerate(gs) if often[g] > 1 for o in range(n)}) for i, gs in grams_.items()}


def test_repeated_words_are_covered_positions(documents):
    ten = " ".join(f"r{i}" for i in range(10))
    prose = lambda a, n: " ".join(f"{a}{i}" for i in range(n))
    texts = [(1, f"{prose('a', 30)} {ten} {prose('b', 40)} {ten} {prose('c', 10)}"), (2, "z " * 30), (3, prose("d", 50)), (4, f"{prose('d', 12)} e"), (5, None), (6, ""), (7, prose("f", 9)), (8, prose("f", 9))]
    rows = {r.doc_id: r for r in curate.repeated_spans(documents(texts)).collect()}
    assert rows[1].repeated_word_share == 0.2  # 20 of 100 words
    assert {i: r.n_repeated_words for i, r in rows.items()} == covered(texts, 10)
    assert (rows[3].n_repeated_words, rows[4].n_repeated_words, rows[7].n_repeated_words) == (12, 12, 0)


def test_spread_shingles_are_no_match(spark, documents):
    item = [f"w{i}" for i in range(40)]
    filler = lambda a, n: [f"{a}{i}" for i in range(n)]
    spread = filler("x", 500).copy()
    for k, at in zip(range(0, 40, 10), range(50, 500, 110)):
        spread[at:at] = item[k : k + 13]
    near = item[:18] + ["other"] + item[18:]
    docs = documents([(1, " ".join(filler("y", 99) + near + filler("z", 99))), (2, " ".join(spread)), (3, " ".join(item)), (4, "two words"), (5, None), (6, "here are two words more")])
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "Two words"), (3, ""), (4, None)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.containment for r in curate.decontaminate_minhash(docs, bench).collect()}
    assert got == {(1, 1): round(32 / 36, 6), (3, 1): 1.0, (4, 2): 1.0, (6, 2): 1.0}


def test_exact_items_at_all_lengths_and_places(spark, documents):
    r = random.Random(2)
    words = [r.choice("a b c d e".split()) for _ in range(400)]
    docs = documents([(i, " ".join(words[i * 20 : i * 20 + 60])) for i in range(18)] + [(50, None), (51, "a")])
    bench = [(i, " ".join(words[a : a + n])) for i, (a, n) in enumerate([(0, 1), (30, 4), (40, 5), (41, 6), (77, 11), (90, 17), (100, 33), (5, 60), (5, 61)])] + [(20, ""), (21, None), (22, "e d c b a e d c b a e e e")]
    items = spark.createDataFrame(bench, "item_id long, text string")
    has = lambda t, i: f" {i} " in f" {t} "
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    want = {(d, i) for d, t in texts.items() for i, item in bench if item and has(t, item)}
    assert {tuple(x) for x in curate.decontaminate_exact(docs, items).collect()} == want
    assert curate.decontaminate_minhash(docs, items.limit(0)).count() == curate.decontaminate_ngram(docs, items.limit(0)).count() == 0


def test_rows_without_origin_stay(spark):
    docs = spark.createDataFrame([(1, None, 10), (2, "synthetic", 10), (3, "native", 100)], "doc_id long, origin string, tokens long")
    assert {r.doc_id: r.kept for r in curate.synthetic_cap(docs).collect()} == {1: True, 2: True, 3: True}


@pytest.fixture
def crowded(spark):
    """Crowds of close vectors, equal ones, scattered ones, a zero vector, a null one."""
    r = np.random.default_rng(6)
    centres = r.normal(size=(4, 8))
    x = np.concatenate([c + r.normal(size=(40, 8)) * 0.05 for c in centres] + [np.repeat(centres[:1], 60, axis=0), r.normal(size=(50, 8)), np.zeros((1, 8))])
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None)]
    return x, spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def cosines(x):
    u = x / np.where(np.linalg.norm(x, axis=1) == 0, 1, np.linalg.norm(x, axis=1))[:, None]
    return u @ u.T


def test_vector_searches_by_blocks(spark, monkeypatch, crowded):
    x, df = crowded
    monkeypatch.setattr(vectors.blocks, "__defaults__", (30,))
    c = cosines(x)
    nine = np.round(c, 9)
    np.fill_diagonal(nine, -9)
    want = {(i, r, int(j)) for i in range(len(x)) for r, j in enumerate(np.lexsort((np.arange(len(x)), -nine[i]))[:4], 1)}
    assert {(r.vec_id, r.rank, r.neighbor) for r in vectors.cosine_neighbors(df, 4).collect()} == want
    pairs = {(r.vec_id, r.eval_id) for r in vectors.near_eval(df, df.filter("vec_id % 10 = 0"), 0.95).collect()}
    assert pairs == {(i, j) for i in range(len(x)) for j in range(0, len(x), 10) if c[i, j] >= 0.95}
    label = list(range(len(x)))
    for _ in label:
        label = [min([label[j] for j in np.nonzero(c[i] >= 0.97)[0]] + [label[i]]) for i in range(len(x))]
    got = {r.vec_id: (r.cluster_id, r.cluster_size) for r in vectors.semantic_clusters(df, 0.97).collect()}
    sizes = Counter(label)
    assert got == {**{i: (k, sizes[k]) for i, k in enumerate(label)}, 900: (900, 1)}
    dealt = vectors.blocks(vectors.unit_vectors(df.filter("vec_id < 160")), 10)
    n = dealt.count()
    assert vectors.block_pairs(dealt, dealt, F.lit(0.97)).count() < 0.5 * n * n  # crowds lie apart
    empty = df.limit(0)
    assert vectors.cosine_neighbors(empty).count() == vectors.near_eval(df, empty).count() == vectors.semantic_clusters(empty).count() == 0


def test_no_block_moves_for_a_pair(spark, monkeypatch, crowded):
    x, df = crowded
    monkeypatch.setattr(vectors.blocks, "__defaults__", (30,))
    monkeypatch.setattr(vectors, "GROUP", 70 * 8 * x.shape[1], raising=False)  # two blocks or three
    plans, write = [], vectors.few_rows_a_batch

    def seen(df, name, *rows):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return write(df, name, *rows)

    monkeypatch.setattr(vectors, "few_rows_a_batch", seen)
    c = np.round(cosines(x), 9)
    np.fill_diagonal(c, -9)
    want = {(i, r, int(j)) for i in range(len(x)) for r, j in enumerate(np.lexsort((np.arange(len(x)), -c[i]))[:6], 1)}
    assert {(r.vec_id, r.rank, r.neighbor) for r in vectors.cosine_neighbors(df, 6).collect()} == want
    products = [p for name, p in plans if name == "block-products"]
    assert len(products) > 1 and not any("Join" in p or "Exchange" in p for p in products)  # before: a join of pairs with both blocks


def test_spanning_links_connect_the_same():
    r = np.random.default_rng(3)
    for density in (0.0, 0.02, 0.1, 1.0):
        links = r.random((30, 25)) < density
        p, q = vectors.spanning(links)
        assert len(p) < 55 and links[p, q].all()

        def parts(edges):
            label = list(range(55))
            for _ in range(55):
                for a, b in edges:
                    label[a] = label[30 + b] = min(label[a], label[30 + b])
            return label

        assert parts(list(zip(p.tolist(), q.tolist()))) == parts(list(zip(*map(list, np.nonzero(links)))))


HAND = {  # script, language
    "यह एक वाक्य है": ("Devanagari", "hi"), "ఇది ఒక వాక్యం": ("Telugu", "te"), "ಇದು ಒಂದು ವಾಕ್ಯ": ("Kannada", "kn"), "இது ஒரு வாக்கியம்": ("Tamil", "ta"), "এটি একটি বাক্য": ("Bengali", "bn"),
    "123 !": ("none", None), "это предложение": ("Cyrillic", None),
}


def test_languages_of_held_out_documents_and_scripts(spark, documents):
    from granary.functions.sampling import uniform
    from granary.operators import language

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    profiles = language.learn_profiles(docs.filter(uniform("doc_id", "profile") < 0.5))
    held = docs.filter(uniform("doc_id", "profile") >= 0.5)
    rows = language.paragraph_lang_script(held, profiles).join(held.select("doc_id", F.col("lang").alias("given")), "doc_id")
    long = rows.join(language.paragraphs(held).filter(F.length("p") >= 60).select("doc_id", F.col("para_no").cast("long").alias("para_no")), ["doc_id", "para_no"])
    for r in long.groupBy("given").agg(F.avg((F.col("given") == F.col("lang")).cast("int")).alias("right"), F.count(F.lit(1)).alias("n")).collect():
        assert r.right > 0.9 and r.n > 20, r
    hand = documents(list(enumerate(HAND)) + [(90, "यह एक sentence है in two"), (91, None), (92, ""), (93, "\n \n")])
    got = {r.doc_id: r for r in language.paragraph_lang_script(hand, profiles).collect()}
    for i, (script, lang) in enumerate(HAND.values()):
        assert (got[i].script, got[i].lang, got[i].mixed) == (script, lang, False)
    assert (got[90].n_scripts, got[90].mixed) == (2, True) and set(got) == {*range(len(HAND)), 90, 93}
    learned = documents([(1, "यह एक वाक्य है और", "hi"), (2, "हे एक वाक्य आहे आणि", "mr"), (3, "plain words here", "en")] * 3)
    own = language.learn_profiles(learned)
    assert own.scripts == ["Latin", "Devanagari", "Devanagari"]
    assert [r.lang for r in language.paragraph_lang_script(documents([(1, "आहे आणि वाक्य"), (2, "है और")]), own).orderBy("doc_id").collect()] == ["mr", "hi"]
    nothing = language.learn_profiles(documents([]))
    assert [r.lang for r in language.paragraph_lang_script(documents([(1, "words"), (2, "தமிழ்")]), nothing).orderBy("doc_id").collect()] == [None, "ta"]


def test_changed_licence_notices_are_found(documents):
    from granary.operators import rights

    mit = "Permission is hereby granted, free of charge, to any person\nobtaining a copy of this programme and associated documentation files,\nto deal in the Software without any restriction, 1999 J. Doe"
    texts = {
        "x\nLicensed under the Apache Licence v2.0": "Apache-2.0", "(c) 2019 A. Name. The MIT Licence": "MIT", mit: "MIT", "GNU General Public Licence, Version 3": "GPL-3.0", "under GPLv3": "GPL-3.0", "LICENSE: GPL v2": "GPL-2.0",
        "Creative Commons Attribution-NonCommercial 4.0 International": "CC-BY-NC-4.0", "CC BY 4.0": "CC-BY-4.0", "CC-BY-NC-SA 4.0": "CC-BY-NC-SA-4.0", "MIT License\nsome parts: CC BY-NC 4.0": "CC-BY-NC-4.0",
        "mit der Lizenz": "unresolved", "a license to fish, with MIT people": "unresolved", "Permission to fish is granted": "unresolved", "": "unresolved",
        "Redistributions and\nRedistribution and use in source and binary forms, with or without changes, are permitted provided that the following conditions are met": "BSD",
    }
    rows = documents([*enumerate(texts), (90, None)])
    got = {r.doc_id: r for r in rights.rights_filter(rows).collect()}
    assert {t: got[i].licence for i, t in enumerate(texts)} == texts
    assert got[90].licence == "unresolved" and got[14].similarity < 1 and not got[9].allowed and got[9].reason == "licence" and got[90].allowed
    shares = {r.licence: r.share for r in rights.rights_shares(rights.rights_filter(rows)).collect()}
    assert shares["unresolved"] == round(5 / 16, 9) and abs(sum(shares.values()) - 1) < 1e-6


def test_log_appends_only_what_is_new_and_notices_changes(spark, tmp_path):
    from granary.sources import commit_log as log

    path = f"file://{tmp_path}/log"
    rows = lambda ids: spark.createDataFrame([(i, "removed", "r") for i in ids], log.ROWS)
    assert log.commits(spark, path).count() == log.entries(spark, path).count() == 0 and log.broken(spark, path) == []
    assert [log.append(path, "a", rows([1, 2, 2, None]), "t1"), log.append(path, "b", rows([]), "t2"), log.append(path, "a", rows([1, 2, None]), "t3")] == [1, 2, None]
    before = {tuple(r) for r in log.commits(spark, path).collect()}
    spark.createDataFrame([(9, "removed", "lost")], log.ROWS).write.mode("overwrite").parquet(f"{path}/rows/version=3")  # rows of a run that died before its record
    assert log.entries(spark, path).count() == 3
    assert [log.append(path, "a", rows([2, 3]), "t4"), log.append(path, "b", rows([2]), "t5"), log.append(path, "b", rows([]), "t6")] == [3, 4, None]
    assert before < {tuple(r) for r in log.commits(spark, path).collect()}
    assert sorted((r.doc_id, r.version, r.stage, r.at) for r in log.entries(spark, path).filter("doc_id is not null").collect()) == [(1, 1, "a", "t1"), (2, 1, "a", "t1"), (2, 4, "b", "t5"), (3, 3, "a", "t4")]
    assert log.broken(spark, path) == []
    rows([7]).write.mode("append").parquet(f"{path}/rows/version=3")
    assert log.broken(spark, path) == [3]


def test_ledger_reads_the_log(spark, documents):
    log_ = spark.createDataFrame([(1, 2, "pii", "changed", "x", "t2"), (1, 1, "opt_out", "removed", "y", "t1"), (2, 2, "pii", "changed", "x", "t2")], "doc_id long, version int, stage string, action string, reason string, at string")
    docs = documents([(1, "one"), (2, "तीन three"), (3, None)])
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = curate.ledger(docs, none, docs.select("doc_id", F.lit("MIT").alias("licence")), docs.select("doc_id", F.lit("native").alias("origin")), log_).orderBy("doc_id").collect()
    assert [(r.transformations, r.changed_at, r.opt_out_id, r.status) for r in rows] == [(["opt_out", "pii"], "t2", 1, "removed:opt_out"), (["pii"], "t2", None, "kept"), ([], None, None, "kept")]
    card = {(r.stage, r.action): r.n_docs for r in curate.data_card(docs, log_).collect()}
    assert card == {("opt_out", "removed"): 1, ("pii", "changed"): 2, ("kept", "kept"): 2}


def test_siblings_of_one_prompt_and_chance_corrected_agreement(spark):
    from granary.operators import align

    rows = [(1, 0, "user", "Q"), (1, 1, "assistant", "a"), (2, 0, "system", "s"), (2, 1, "user", "Q"), (2, 2, "assistant", "b"), (2, 3, "user", "more"), (2, 4, "assistant", "b"), (3, 0, "user", "other"), (3, 1, "assistant", "c"), (4, 0, "user", None), (4, 1, "assistant", "d"), (5, 0, "user", "Q"), (5, 1, "assistant", None)]
    langs = spark.createDataFrame([(1, "en"), (2, "de")], "conv_id long, lang string")
    pairs = align.sibling_pairs(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"), langs)
    assert [r.lang for r in pairs.collect()] == ["en"]
    assert [tuple(r)[2:] for r in pairs.collect()] == [("Q", "a", "b")]  # b and b are equal
    judged = lambda votes: spark.createDataFrame([(p, "en", i, o) for p, os in votes.items() for i, o in enumerate(os)], "pair_id string, lang string, rater int, outcome string")
    r = align.preference_pairs(pairs, judged({"1-1": ["loss", "loss", "win"]})).first()
    assert (r.prompt, r.chosen, r.rejected, r.majority, round(r.agreement, 3)) == ("Q", "b", "a", "loss", 0.667)
    assert align.preference_pairs(pairs, judged({"1-1": ["tie", "tie", "win"]})).count() == 0
    k = align.rater_agreement(judged({"a": ["win"] * 3, "b": ["loss"] * 3, "c": ["win", "win", "loss"], "d": ["tie"]})).first()
    p = [(3 + 2) / 9, 0, (3 + 1) / 9]
    expected = sum(x * x for x in p)
    assert k["items"] == 3 and abs(k.kappa - ((1 + 1 + 1 / 3) / 3 - expected) / (1 - expected)) < 1e-9
    assert align.rater_agreement(judged({"a": ["win"] * 3})).first().kappa is None
    crowd = spark.createDataFrame([(i, t, r, x) for i in range(300) for t, r, x in ((0, "user", "Q"), (1, "assistant", f"a{i}"))], "conv_id long, turn int, role string, text string")
    assert 250 < align.sibling_pairs(crowd, langs, 20).count() < 300


def test_round_trip_lists_failures_and_null_counts_as_empty(trained, documents):
    rows = documents([(1, "plain text"), (2, "a▁b"), (3, None), (4, ""), (5, "́ ज् 🙂 \n\n")])
    got = codec.roundtrip(rows, trained[1])
    assert {r.doc_id: (r.exact, r.visible_equal, r.ids_in_range) for r in got.collect()} == {i: (i != 2, i != 2, True) for i in range(1, 6)}
    assert sorted(tuple(r) for r in codec.roundtrip_failures(got).collect()) == [(2, "en", "exact"), (2, "en", "visible_equal")]


def test_records_of_languages_and_spread_by_corpus(spark, documents):
    from granary.operators import fairness

    docs = documents([(1, "one two", "en", "s"), (2, "three", "en", "t"), (3, "यह वाक्य", "hi", "s"), (4, "12", "xx", "s"), (5, "no language", None, "s")])
    got = {r.lang: r for r in fairness.source_records(docs).collect()}
    assert {k: (r.script, r.sources, r.documents, r.words) for k, r in got.items()} == {"en": ("Latin", 2, 2, 3), "hi": ("Devanagari", 1, 1, 2), "xx": ("none", 1, 1, 1), None: ("Latin", 1, 1, 2)}
    ratios = spark.createDataFrame([("en", 6, 2.0), ("hi", 2, 1.0), ("xx", 1, None), (None, 4, 2.0)], "lang string, tokens long, ratio double")
    rows = fairness.ratios_with_records(ratios, fairness.source_records(docs)).orderBy("rank").collect()
    assert [(r.lang, r.tokens, r.rank) for r in rows] == [("hi", 2, 1), (None, 4, 2), ("en", 6, 3), ("xx", 1, 4)]
    by = spark.createDataFrame([("a", "en", 2, 1, 2.0), ("a", "de", 3, 2, 1.5), ("a", "xx", 0, 0, None), ("b", "en", 2, 1, 2.0)], "corpus string, lang string, tokens long, units long, ratio double")
    spread = {(r.corpus, r.lang): (r.spread, r.score, r.languages) for r in fairness.corpus_spread(by).collect()}
    assert spread[("a", "xx")] == (0.5, 2000.0, 2) and spread[("b", "en")] == (0.0, float("inf"), 1)
