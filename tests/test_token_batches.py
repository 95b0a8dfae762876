"""Texts coded and measured in batches, against one at a time and against column expressions."""

import random

from pyspark.sql import functions as F

from granary.functions import text as T
from granary.operators import bpe_codec as codec
from granary.operators import bpe_train as bpe
from granary.operators import fairness as fair
from granary.operators import language
from granary.operators.language import SCRIPTS, measured

ODD = ["", None, " ", "\n\n", "  The quick\n\nbrown fox ", "▁x ▁▁ y\n", "the\nthe the\n z", "🙂 ज् and\u0085the ‍", "x" * 300 + " the end", "tab\tand \x01 space\x02", "l'été, 12½ №5!", "Ωμέγα 漢字 ᱚᱞ ꯃꯤ _a_", "\U0001f9ff  \x1c."]


def vocabulary(rng, letters="ab\n▁"):
    made, merges = list(letters), []
    for _ in range(14):
        a, b = rng.choice(made), rng.choice(made)
        if (a, b) not in merges and len(a + b) < 7 and "▁" not in b:
            merges.append((a, b))
            made += [a + b] * (a + b not in made)
    return bpe.Vocabulary(bpe.with_bytes([bpe.UNK, *made]), merges)


def test_pieces_coded_together_are_coded_as_one_by_one(monkeypatch):
    rng = random.Random(7)
    monkeypatch.setattr(codec, "REMEMBERED", 40), monkeypatch.setattr(codec, "KEPT", 9)
    across = set()
    for _ in range(60):
        v = vocabulary(rng)
        texts = ["".join(rng.choice("aabbb é\n") for _ in range(rng.randint(0, 90))) for _ in range(30)]
        alone, together, got = codec.Codec(v), codec.Batches(v), []
        across.add(together.line_ends)
        for a in range(0, 30, 7):
            for _, _, numbers, sizes in together.slices(texts[a : a + 7]):
                ids, n = together.ids_of(numbers, sizes)
                got += [x.tolist() for x in codec.np.split(ids, codec.np.cumsum(n)[:-1])]
        want = [alone.encode(t) for t in texts]
        assert got == want and together.token_counts(texts).tolist() == [len(w) for w in want]
    assert across == {True, False}


def test_measures_of_texts_equal_column_expressions(documents):
    docs = documents([(i, t, ["en", "fr"][i % 2]) for i, t in enumerate(ODD)])
    got = {r.doc_id: (r.words, r.units, r.by) for r in measured(docs, "doc_id").collect()}
    by = F.array(*(F.regexp_count("text", F.lit(rf"\p{{Is{s}}}")).cast("long") for s in SCRIPTS))
    text = F.col("text")
    want = {r.doc_id: (r.w, r.u, None if r.w is None else r.by) for r in docs.select("doc_id", T.word_count(text).alias("w"), T.faithful_units(text).alias("u"), by.alias("by")).collect()}
    assert got == want and got[0] == (0, 0, [0] * len(SCRIPTS)) and got[1] == (None, None, None)


def test_ratios_by_language_equal_codes_of_each_text(documents):
    v = vocabulary(random.Random(3), "the qu\n▁")
    docs = documents([(i, t, ["en", "fr", None][i % 3]) for i, t in enumerate(ODD)] + [(99, None, "only null")])
    alone = codec.Codec(v)
    want = {}
    for r in docs.withColumn("units", T.faithful_units(F.col("text"))).collect():
        tokens, units = want.get(r.lang, (0, None))
        want[r.lang] = (tokens + len(alone.encode(r.text or "")), units if r.units is None else (units or 0) + r.units)
    got = {r.lang: (r.tokens, r.units, r.ratio) for r in fair.language_ratios(docs, v).collect()}
    assert got == {k: (t, u, t / u if u else None) for k, (t, u) in want.items()}


def test_usage_of_tokens_is_what_one_row_a_token_sums_up_to(spark, documents):
    v = vocabulary(random.Random(5), "the qu\n▁")
    docs = documents([([1, 2, 2, None, 5, None, 2][i % 7], t) for i, t in enumerate(ODD * 12)])
    for own in (docs, docs.filter("doc_id = 2 or doc_id is null"), documents([(i, t) for i, t in enumerate(ODD)]), docs.limit(0)):
        want = codec.encode_tokens(own, v).groupBy("kind", "label", "hex").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("documents"))
        assert sorted(map(tuple, codec.token_usage(own, v).collect())) == sorted(map(tuple, want.collect()))


def test_pieces_are_counted_by_tasks(spark, documents):
    found = bpe.piece_counts(documents([(i, t, ["en", None][i % 2]) for i, t in enumerate(ODD)]).repartition(3))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan  # before: a row for each piece of each text
    pieces = [(["en", None][i % 2], p) for i, t in enumerate(ODD) for line in codec.re.findall("[^\n]*\n|[^\n]+", t or "") for p in codec.PIECE.findall(line.replace(" ", "▁"))]
    assert sorted((str(r.lang), r.piece, r.n) for r in found.collect()) == sorted((str(k), p, pieces.count((k, p))) for k, p in set(pieces))


def test_trigrams_are_counted_by_places_as_by_sorting(monkeypatch):
    rng = random.Random(2)
    monkeypatch.setattr(language, "SLICE", 200)
    for letters in ("ab ", "abcdeé漢\U0001f642 ", "".join(map(chr, range(0x4E00, 0x4E00 + 400)))):
        texts = ["".join(rng.choices(letters, k=rng.choice((0, 1, 2, 3, 50, 300)))) for _ in range(40)]
        codes, n = language.gram_counts(texts)
        want = language.np.unique(language.trigrams(texts)[1], return_counts=True)
        assert codes.tolist() == want[0].tolist() and n.tolist() == want[1].tolist()
    assert [len(x) for x in language.gram_counts(["", "ab"])] == [0, 0]
