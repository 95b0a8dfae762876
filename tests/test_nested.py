"""Smaller vocabularies out of a larger one, against training of their own and a public tokenizer."""

import json

import pytest

from granary.functions import config
from granary.operators import bpe_codec as codec
from granary.operators import bpe_train as bpe
from granary.operators import nested as N
from granary.sources.tokenizer_file import tokenizer_json

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def trained(spark):
    counts = bpe.weighted_piece_counts(spark.read.parquet(f"{SMALL}/documents.parquet"), config.WEIGHTS)
    return counts, bpe.train(counts, 1200)


@pytest.mark.parametrize("merges", [0, 1, 17, 300])
def test_first_merges_are_what_training_for_less_gives(trained, merges):
    counts, v = trained
    small = N.nested(v, merges)
    own = bpe.train(counts, len(small.tokens))
    assert own.tokens == small.tokens and own.merges == small.merges and small.complete
    assert not N.nested(v, len(v.merges) + 1).complete


def test_a_string_made_twice_is_one_entry():
    v = bpe.Vocabulary(bpe.with_bytes(["[UNK]", "a", "b", "ab", "abb", "bb"]), [("a", "b"), ("ab", "b"), ("b", "b"), ("a", "bb")])
    assert N.nested(v, 4).tokens == v.tokens and N.nested(v, 2).tokens == bpe.with_bytes(["[UNK]", "a", "b", "ab", "abb"])


def test_counts_at_all_sizes_equal_a_public_tokenizers(spark, documents, trained):
    from tokenizers import Tokenizer

    v = trained[1]
    texts = ["", None, " ", "  The quick\n\nbrown fox ", "the the the", "🙂 ज् and the", "x" * 5000 + " the end", "tab\tand space"]
    docs = documents([(i % 7, t) for i, t in enumerate(texts)]).withColumnRenamed("n_chars", "n_characters")
    sizes = (0, 5, 300)
    got = sorted((r.doc_id, r.text or "", r.merges, r.tokens, r.byte_tokens) for r in N.token_counts(docs, v, sizes).collect())
    want = []
    for m in sizes:
        public = Tokenizer.from_str(tokenizer_json(N.nested(v, m)))
        for i, t in enumerate(texts):
            tokens = public.encode(t or "").tokens
            want.append((i % 7, t or "", m, len(tokens), sum(x.startswith("<0x") for x in tokens)))
    assert got == sorted(want)
    assert N.token_counts(docs.limit(0), v, sizes).collect() == []
    one = codec.encode(docs, N.nested(v, 300)).collect()
    assert sorted(len(r.ids) for r in one) == sorted(w[3] for w in want if w[2] == 300)


def test_fertility_relative_to_a_base_that_can_be_absent(spark):
    sums = spark.createDataFrame([(0, "en", 10, 0, 8, 5, 20), (0, "de", 12, 3, 8, 4, 24), (9, "de", 8, 0, 8, 4, 24), (9, None, 0, 0, 0, 0, 0)], "merges int, lang string, tokens long, byte_tokens long, units long, words long, bytes long")
    got = {(r.merges, r.lang): (r.mean, r.bytes_per_token, r.byte_share, r.relative) for r in N.fertility_by_size(sums).collect()}
    assert got == {(0, "en"): (2.0, 2.0, 0.0, 1.0), (0, "de"): (3.0, 2.0, 0.25, 1.5), (9, "de"): (2.0, 3.0, 0.0, None), (9, None): (None, None, None, None)}


def test_smallest_size_from_which_on_a_gate_is_passed(spark):
    rows = [("a", 0, 4.0), ("a", 8, 1.0), ("a", 16, 1.0), ("b", 0, 1.0), ("b", 8, 4.0), ("b", 16, 1.0), ("c", 0, 1.0), ("c", 8, 1.0), ("c", 16, 2.0), (None, 0, 1.2), (None, 8, 1.0), ("n", 0, None)]
    ratios = spark.createDataFrame(rows, "lang string, merges int, ratio double")
    assert {r.lang: r.merges for r in N.smallest_passing(ratios, 1.2).collect()} == {"a": 8, "b": 16, "c": None, None: 0, "n": None}


def test_tuned_weights_go_on_from_the_best_round(monkeypatch):
    asked = []
    monkeypatch.setattr(bpe, "weigh", lambda counts, weights, other: dict(weights))
    monkeypatch.setattr(bpe, "train", lambda counts, size, strict: counts)

    def ratios(answers):
        left = iter(answers)

        def of(v):
            asked.append(v)
            return next(left)

        return of

    # the second round is worse, so the third goes on from the first, half as far
    best, spreads = bpe.tune_weights(None, {"a": 1, "b": 2}, ratios([{"a": 1.0, "b": 3.0, "c": None}, {"a": 1.0, "b": 4.0}, {"a": 1.0, "b": 2.0}]), 9, first="given")
    assert spreads == [2.0, 3.0, 1.0] and asked == ["given", {"a": 16, "b": 288}, {"a": 32, "b": 192}] and best == {"a": 0.5, "b": 3.0}
    # nothing is gained: the given weights stay
    best, spreads = bpe.tune_weights(None, {"a": 1.5}, ratios([{"a": 1.0, "b": 3.0}, {"a": 1.0, "b": 3.0}, {}]), 9, rounds=2)
    assert best == {"a": 1.5} and spreads == [2.0, 2.0]
    assert bpe.tune_weights(None, {"a": 1}, ratios([{}]), 9, rounds=1) == ({"a": 1.0}, [0.0])


def test_strings_made_in_several_ways_and_cut_texts():
    import random

    rng = random.Random(5)
    for _ in range(100):
        made, merges = list("ab▁"), []
        for _ in range(14):
            a, b = rng.choice(made), rng.choice(made)
            if (a, b) not in merges and len(a + b) < 7 and "▁" not in b:
                merges.append((a, b))
                made += [a + b] * (a + b not in made)
        v = bpe.Vocabulary(bpe.with_bytes(["[UNK]", *made]), merges)
        sizes = (len(merges), 0, 3)
        at, single = N.Sizes(v, sizes), [codec.Codec(N.nested(v, m)) for m in sizes]
        texts = ["".join(rng.choice("aabb é") for _ in range(rng.randint(0, 30))) for _ in range(20)] + [None]
        got = sum(at.texts(parts, len(texts)) for parts in N.chunks(texts, rng.randint(1, 60)))
        assert got.tolist() == [[*(len(c.encode(t or "")) for c in single), 2 * (t or "").count("é")] for t in texts]
