"""The operators of granary.llm against brute force on small fixtures with nulls, empty and long texts, ties, repeats, and columns with clashing names."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from granary.llm import blobs, chat_format, exact_dedup, language_id, mixing, ngram_join, packing, page_text, quality_rules, suffix_dedup, toxicity
from granary.llm.queries import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
R = random.Random(4)
VOCAB = ["".join(R.choices("abcdefgh", k=R.randint(1, 6))) for _ in range(300)]


def prose(n, r=R):
    return " ".join(r.choices(VOCAB, k=n))


BASE, PASSAGE = prose(120), prose(60)
TEXTS = {
    1: BASE,
    2: BASE + " extra",
    3: BASE,
    4: BASE.replace(" ", "\n"),
    5: None,
    6: "",
    7: " \t\n",
    8: "one",
    9: "One ",
    10: prose(80) + " " + PASSAGE + " " + prose(80),
    11: PASSAGE + "\n" + prose(30),
    12: prose(40) + " " + PASSAGE,
    13: prose(5000),
    14: "é" * 49 + "x",
    15: "x" * 400,
    16: "x" * 120,
    17: " ".join(BASE.split()[:-1]),
    18: "the same eight words come here again now " * 6,
    19: prose(9),
    20: "\U0001f642 " * 30,
}


@pytest.fixture(scope="module")
def docs(documents):
    rows = [(i, t, ["en", "de", None][i % 3], ["b", "a", None, "ä"][i % 4]) for i, t in TEXTS.items()]
    extra = documents(rows).repartition(3, "doc_id")
    for c in ("row_id", "bucket", "size", "u", "n", "words", "rank", "_id", "copies", "kept", "label", "key", "digest"):
        extra = extra.withColumn(c, F.lit("clash"))
    return extra


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def words(t):
    return WORD.findall(t or "")


# -- mixing


def test_mixing(docs, empty):
    rows = mixing.mix(docs).collect()
    assert sorted(r.doc_id for r in rows) == sorted(TEXTS)
    size = defaultdict(int)
    for i, t in TEXTS.items():
        size[["b", "a", None, "ä"][i % 4]] += len(words(t))
    order = sorted((k for k in size if k is not None)) + [None]
    weight = dict(zip(order, [3, 1, 2, 3]))
    total, clamped = 1.5 * sum(size.values()), set()
    while True:  # plain water-filling
        left, w = total - sum(2 * size[k] for k in clamped), sum(weight[k] for k in order if k not in clamped)
        target = {k: 2 * size[k] if k in clamped else weight[k] * left / w for k in order}
        over = {k for k in order if target[k] > 2 * size[k]}
        if not over:
            break
        clamped |= over
    taken = Counter()
    for r in rows:
        assert r.size == len(words(TEXTS[r.doc_id])) and 0 <= r.taken <= 2 * r.size
        assert abs(r.target - target[r.source]) < 1e-6 and r.source_size == size[r.source]
        taken[r.source] += r.taken
    assert all(abs(taken[k] - target[k]) <= 1 for k in order)
    assert mixing.mix(docs).collect() and sorted(map(tuple, mixing.mix(docs).collect()), key=repr) == sorted(map(tuple, rows), key=repr)
    assert mixing.mix(empty).count() == 0


def test_repetitions_follow_the_mix(docs):
    keyed = docs.withColumn("no", F.monotonically_increasing_id())
    mixed = mixing.mix(keyed, key="no")
    out = mixing.repeat_documents(keyed, mixed, "no")
    assert out.columns == docs.columns
    got = Counter()
    for r in out.collect():
        got[r.doc_id] += len(words(r.text))
    assert {r.doc_id: r.taken for r in mixed.collect() if r.taken} == {k: v for k, v in got.items() if v}


def test_mixing_of_rows_without_and_with_equal_ids(documents):
    """Rows that share an id, or have none, lie in one cell: taken words still come to the target, the last of them in part."""
    rows = [(None, "a b c", "en", "x")] * 40 + [(7, "d e", "en", "x")] * 40 + [(7, "d e f", "en", "x")] * 3 + [(i, "w " * 50, "en", "y") for i in range(20)]
    docs = documents(rows).repartition(5).withColumn("no", F.monotonically_increasing_id())
    keyed = mixing.materialize(docs, "keyed")
    mixed = mixing.mix(keyed, key="no").collect()
    assert len(mixed) == len(rows) and len({r.row_id for r in mixed}) == len(rows)
    for s in "xy":
        mine = [r for r in mixed if r.source == s]
        assert sum(r.taken for r in mine) == int(mine[0].target + 0.5) and all(0 <= r.extra <= r.size for r in mine)
        assert len({(r.doc_id, r.size) for r in mine if 0 < r.extra < r.size}) <= 1 and sum(0 < r.extra < r.size for r in mine) <= 1
    out = mixing.repeat_documents(keyed, mixing.mix(keyed, key="no"), "no")
    got = Counter()
    for r in out.collect():
        got[r.source] += len(words(r.text))
    assert got == {s: sum(r.taken for r in mixed if r.source == s) for s in "xy"}


# -- exact dedup


def brute_exact(texts):
    groups = defaultdict(list)
    for i, t in texts.items():
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append(i)
    return {i: (min(g, key=lambda j: (-len(texts[j] or ""), j)), len(g), hashlib.sha256(k.encode()).hexdigest()) for k, g in groups.items() for i in g}


@pytest.mark.parametrize("digest_bytes", [16, 1])
def test_exact_dedup(docs, empty, digest_bytes):
    """One byte of digest makes different chunks collide: verification must tell them apart."""
    rows = exact_dedup.exact_dedup(docs, digest_bytes).collect()
    assert {r.doc_id: (r.keep_id, r.group_size, r.text_sha256) for r in rows} == brute_exact(TEXTS)
    assert all(r.kept == (r.doc_id == r.keep_id) for r in rows)
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_exact_dedup_of_repeated_rows(documents):
    rows = exact_dedup.exact_dedup(documents([(7, "a b"), (7, "a b"), (7, "a b"), (None, "a  b"), (8, "ab")])).collect()
    assert sum(r.kept for r in rows) == 1 and {r.group_size for r in rows} == {5}


def test_chunks_depend_on_content_alone():
    r = np.random.default_rng(3)
    a = bytes(r.integers(97, 123, 60_000, dtype=np.uint8))
    cut = lambda t: exact_dedup.cut_points(*exact_dedup.concat_bytes([b"zz", t]))[1]
    whole, shifted = cut(a), cut(b"inserted" + a)
    assert len(whole) > 10 and len(set(whole) & {e - 8 for e in shifted}) > len(whole) // 2
    assert exact_dedup.cut_points(*exact_dedup.concat_bytes([a]))[0] == whole


# -- n-gram join


def brute_links(texts, size, num, den):
    sets = {}
    for i, t in texts.items():
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = frozenset(tuple(w[j : j + size]) for j in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                i = len(sets[a] & sets[b])
                if i and den * i >= num * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    return {i: (len(sets[i]), root[i]) for i in sets}


@pytest.mark.parametrize("size,num,den", [(3, 90, 100), (5, 8, 10), (1, 6, 10)])
def test_ngram_join(docs, empty, size, num, den):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs, size, num, den).collect()}
    assert got == brute_links(TEXTS, size, num, den)
    assert ngram_join.near_duplicates(empty, size, num, den).count() == 0


def test_joined_numbers_are_read_in_place():
    """Slices, chunks, missing and empty rows; and no second copy of a bucket as Python bytes."""
    import tracemalloc

    pieces = [None, np.arange(3).tobytes(), b"", None, np.arange(3, 7).tobytes(), None]
    for kind in (pa.binary(), pa.large_binary()):
        table = pa.table({"n": pa.chunked_array([pa.array(pieces, kind), pa.array([None], kind), pa.array([], kind), pa.array(pieces, kind)[4:]])})
        assert blobs.joined(table, "n", "<i8").tolist() == [*range(7), *range(3, 7)]
        assert blobs.joined(table[1:2], "n", "<i8").tolist() == [0, 1, 2] and blobs.joined(table[:1], "n", "<i8").dtype == np.int64
        assert len(blobs.joined(table[:0], "n", "<i8")) == 0
    big = pa.table({"n": pa.array([b"x" * 100_000] * 200)})
    tracemalloc.start()
    assert len(blobs.joined(big, "n", "u1")) == 20_000_000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 5_000_000, peak


def test_ngram_join_small_sets_and_chains(documents):
    """Many short texts that differ by a word or two: subsets, lists and chains of links."""
    r = random.Random(8)
    texts = {}
    for g in range(25):
        base = [r.choice("abcdefghij") + str(g) for _ in range(r.randint(3, 45))]
        for _ in range(6):
            w = list(base)
            for _ in range(r.randint(0, 2)):
                w.insert(r.randrange(len(w) + 1), "n" + str(r.randrange(9)))
            texts[len(texts)] = " ".join(w)
    for size, num, den in ((1, 8, 10), (2, 8, 10), (1, 9, 10)):
        got = {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.near_duplicates(documents(list(texts.items())), size, num, den).collect()}
        assert got == brute_links(texts, size, num, den)


def test_sketch_never_differs_in_more_bits_than_sets():
    r = np.random.default_rng(5)
    for _ in range(50):
        a = r.integers(0, 2**62, r.integers(1, 400))
        b = np.unique(np.concatenate((a[: r.integers(0, len(a) + 1)], r.integers(0, 2**62, r.integers(1, 50)))))
        bits = sum(int(x).bit_count() for x in (ngram_join.parity_sketch(np.unique(a)) ^ ngram_join.parity_sketch(b)).view(np.uint64))
        assert bits <= len(set(a.tolist()) ^ set(b.tolist()))


# -- suffix dedup


def brute_repeats(texts, k=50):
    first = {}
    data = {i: (t or "").encode() for i, t in texts.items()}
    for i in sorted(data):
        for p in range(len(data[i]) - k + 1):
            first.setdefault(data[i][p : p + k], i)
    out = {}
    for i, b in data.items():
        gone = [False] * len(b)
        for p in range(len(b) - k + 1):
            if first[b[p : p + k]] < i:
                gone[p : p + k] = [True] * k
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(g and (j == 0 or not gone[j - 1]) for j, g in enumerate(gone))
        out[i] = (len(b), sum(gone), spans, kept)
    return out


def repeats_of(df):
    return {r.doc_id: (r.n_bytes, sum(x["end"] - x["start"] for x in r.removed), len(r.removed), bytes(r.kept)) for r in suffix_dedup.remove_repeats(df).collect()}


def test_suffix_dedup(docs, empty):
    assert repeats_of(docs) == brute_repeats(TEXTS)
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_suffix_dedup_shifted_passages_and_long_texts(documents, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 700)  # texts above twice that go through in parts; workers of this session are forked before, so the parts are cut here as well
    r = random.Random(9)
    passages = [prose(r.randint(8, 40), r) for _ in range(6)]
    texts = {i: "".join(prose(r.randint(0, 20), r)[r.randint(0, 3) :] + r.choice(passages)[r.randint(0, 30) : -r.randint(1, 30)] for _ in range(4)) for i in range(40)}
    texts[41] = "abc" * 200
    texts[42] = "bca" * 100
    assert repeats_of(documents(list(texts.items()))) == brute_repeats(texts)


def test_suffix_dedup_of_texts_that_go_in_parts(documents):
    """Passages over the ends of parts, in workers with the SEGMENT they import."""
    r, part = random.Random(4), suffix_dedup.SEGMENT
    long = bytearray("".join(r.choices("abcdefghijklmnop é\n", k=2 * part + 150_000)).encode())
    cut = lambda a, n: long[a : a + n].decode("utf-8", "ignore")
    passages = [cut(e + o, n) for e in (part, 2 * part) for o, n in ((-25, 50), (-49, 60), (-200, 400), (-1, 52))]
    texts = {1: "\n\n".join(passages[:5]), 2: long.decode(), 3: cut(part - 3000, 6000) + cut(len(long) - 70, 70), 4: "".join(passages[5:])}
    assert len(long) > 2 * part
    got = repeats_of(documents(list(texts.items())))
    assert got == brute_repeats(texts)
    assert got[2][1] > 400 and got[3][0] == got[3][1]


def test_long_text_in_segments_gives_the_same_runs():
    t = prose(4000).encode()
    whole = {(int(r["gram"]), int(r["start"]) + o) for r in _runs(t, 1 << 30) for o in range(r["n"])}
    parts = {(int(r["gram"]), int(r["start"]) + o) for r in _runs(t, 700) for o in range(r["n"])}
    assert whole == parts and len(whole) == len(t) - 49


def _runs(text, segment):
    old, suffix_dedup.SEGMENT = suffix_dedup.SEGMENT, segment
    try:
        out = []
        for p in suffix_dedup.segments([text], 50):
            data, at = suffix_dedup.concat_bytes([p[1]])
            _, r = suffix_dedup.window_runs(data, at, at[:-1] + [p[3]], at[:-1] + [p[4]])
            r["start"] += p[2]
            out += list(r)
        return out
    finally:
        suffix_dedup.SEGMENT = old


def test_open_windows_move_as_digits_and_only_tied_ones_as_bytes():
    sd = suffix_dedup
    shared = prose(60, random.Random(3))[:90].encode()
    texts = {0: prose(300, random.Random(1)).encode() + shared, 4: prose(300, random.Random(2)).encode() + shared + prose(9, random.Random(5)).encode()}
    runs = []
    for row, t in texts.items():
        _, r = sd.window_runs(*sd.concat_bytes([t]), np.zeros(1, np.int64), np.array([len(t)]))
        x = np.zeros(len(r), sd.OPEN)
        x["row"], x["doc"], x["start"], x["n"], x["q"], x["sides"] = row, row + 10, r["start"], r["n"], r["q"], 3
        runs.append(x)
    dealt = {}  # row_id modulo buckets is the bucket of a text; here each row comes in a batch of its own
    for row, x in zip(texts, runs):
        table = sd.pa.table({"row_id": [row], "order_id": [row + 10], "text": [texts[row]]})
        found = sd.table_of([(0, None, x.tobytes())], sd.FOUND)
        out = sd.open_windows(1, 50, 18)(table, found)
        assert out.nbytes < 24 * int(x["n"].sum())  # before: 70 bytes a window
        dealt[row] = out
    ties = sd.match_digits(1)(sd.pa.concat_tables(dealt.values()))
    left = sd.joined(ties, "open", sd.SPAN)
    windows = {row: [t[p : p + 50] for p in range(len(t) - 49)] for row, t in texts.items()}
    want = {(row, p) for row, other in ((0, 4), (4, 0)) for p, w in enumerate(windows[row]) if w in windows[other]}
    assert len(want) > 80
    assert {(int(r), int(s)) for r, s, _ in left} == want
    moved = sd.tied_windows(1, 50)(sd.pa.table({"row_id": list(texts), "order_id": [10, 14], "text": list(texts.values())}), ties)
    gone = sd.joined(sd.match_windows(1, 50)(moved), "span", sd.SPAN)
    assert {(int(r), int(s)) for r, s, _ in gone} == {(4, p) for row, p in want if row == 4}


def test_radix_groups_are_the_equal_rows():
    r = np.random.default_rng(1)
    rows = r.integers(0, 3, (400, 5)).astype(np.uint64)
    members, group = suffix_dedup.radix_groups(rows)
    got = defaultdict(set)
    for m, g in zip(members.tolist(), group.tolist()):
        got[g].add(m)
    want = defaultdict(set)
    for i, x in enumerate(rows.tolist()):
        want[tuple(x)].add(i)
    assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


# -- packing


def test_packing(docs, empty):
    from tokenizers import Tokenizer
    import zlib

    tok = Tokenizer.from_file(tokenizer_path())
    ids = {i: tok.encode(t or "", add_special_tokens=False).ids + [1] for i, t in TEXTS.items()}
    rows = packing.pack(docs, tokenizer_path(), group=8).collect()
    whole, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.doc_tokens == len(ids[r.doc_id])
        assert zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
        whole[r.doc_id].append((r.start, r.length))
        seqs[r.sequence_id].append((r.offset, r.length))
    for i, p in whole.items():
        assert [a for a, _ in sorted(p)] == [0, *np.cumsum([n for _, n in sorted(p)])[:-1].tolist()] and sum(n for _, n in p) == len(ids[i])
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 2048
    assert set(whole) == set(TEXTS) and packing.pack(empty, tokenizer_path()).count() == 0


def test_best_fit_decreasing_equals_plain_search():
    r = np.random.default_rng(2)
    sizes = r.integers(1, 101, 500)
    seq, offset = packing.best_fit_decreasing(sizes, 100)
    room, fits = [], {}
    for i in np.argsort(-sizes, kind="stable"):
        open_ = [k for k, x in enumerate(room) if x >= sizes[i]]
        best = min((room[k] for k in open_), default=None)
        if best is None:
            room.append(100)
            best = 100
        k = seq[i]
        assert room[k] == best and offset[i] == 100 - best
        room[k] -= sizes[i]
    assert len(room) == seq.max() + 1


def test_word_ids_equal_whole_text_encoding():
    coder = packing.WordIds(tokenizer_path(), kept=5)
    for t in ["It's A.B, 12. x.. é …. <|endoftext|>, a <|EndOfText|> ßZ", "", " \n", prose(50)]:
        assert np.frombuffer(coder.ids(t.encode()), "<u4").tolist() == coder.tokenizer.encode(t, add_special_tokens=False).ids


# -- quality rules


def test_quality_base_counts(docs, empty):
    rows = {r.doc_id: r for r in quality_rules.quality_rules(docs).collect()}
    assert set(rows) == set(TEXTS)
    for i, t in TEXTS.items():
        w, t = words(t), t or ""
        grams = Counter(tuple(w[j : j + 8]) for j in range(len(w) - 7))
        inside = {k for j in range(len(w) - 7) if grams[tuple(w[j : j + 8])] > 1 for k in range(j, j + 8)}
        lines = [x for x in t.split("\n") if words(x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(inside))
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, i
        assert r.base_failed == (len(w) < 20 or 100 * len(inside) > 30 * len(w)) and not (r.base_failed and r.kept)
    assert quality_rules.quality_rules(empty).count() == 0


def test_quality_distance(spark, documents):
    row = spark.createDataFrame([([1, 3, 0], [2, 2, 4])], "p array<long>, q array<long>").select(quality_rules.distance(F.col("p"), F.col("q")).alias("d")).first()
    p, q = np.array([1, 3, 0]) / 4, np.array([2, 2, 4]) / 8
    m = (p + q) / 2
    kl = lambda a: sum(x * np.log2(x / y) for x, y in zip(a, m) if x)
    assert abs(row.d - np.sqrt((kl(p) + kl(q)) / 2)) < 1e-12
    good = [" ".join(R.choice(["the", "of", "in", "is"]) + " " + w for w in prose(90).split()) for _ in range(30)]
    rows = quality_rules.quality_rules(documents([*enumerate(good), (99, " ".join("#$%" + str(i) * 5 for i in range(150)))])).collect()
    assert {r.doc_id for r in rows if not r.kept} == {99}


def test_both_quality_histograms_reject(documents):
    """A text without common words, beside prose whose rest bin holds 0.84; and short text of capitals and marks."""
    r = random.Random(9)
    usual = lambda k: " ".join(r.choice(quality_rules.COMMON_WORDS[k]) if j % 6 == 0 else prose(1, r) for j in range(240))
    texts = [(100 * n + i, usual(k), k) for n, k in enumerate(quality_rules.COMMON_WORDS) for i in range(20)]
    none = [(900 + n, prose(150, r), k) for n, k in enumerate(quality_rules.COMMON_WORDS)]
    rows = quality_rules.quality_rules(documents([*texts, *none, (950, "SE!! CION!! " + " ".join(w.upper() + "!!" for w in prose(24, r).split()), "es")])).collect()
    assert not any(x.base_failed for x in rows) and {x.doc_id for x in rows if not x.kept} == {900, 901, 902, 903, 950}


def test_quality_of_unlisted_and_missing_languages(documents):
    """Characters are judged against the language's own documents; what fails the base rules is in no reference; extra columns do not matter."""
    r = random.Random(10)
    symbols = lambda: " ".join(w + "$#%" for w in prose(60, r).split())
    texts = [(i, prose(60, r), k) for n, k in enumerate([None, "xx"]) for i in range(20 * n, 20 * n + 20)] + [(90, symbols(), None), (91, symbols(), "xx"), (92, symbols(), "yy")]
    texts += [(93 + i, "## $$ ## $$ " * 500, "xx") for i in range(3)]
    docs = documents(texts).withColumn("limit", F.lit("s")).withColumn("chars", F.lit(1)).withColumn("no", F.monotonically_increasing_id())
    rows = quality_rules.quality_rules(docs, key="no").collect()
    assert len({x.row_id for x in rows}) == len(texts)
    assert {x.doc_id for x in rows if x.base_failed} == {93, 94, 95} and {x.doc_id for x in rows if not x.kept} == {90, 91, 93, 94, 95}
    assert all((x.char_distance is None) == (x.doc_id is None) and x.word_distance is None for x in rows)


# -- chat format


def test_chat_round_trip(spark):
    texts = [r"\### Assistant: </turn> ok", "~0~1<turn:user>a</turn>\n", "", None, "plain > text\n\n", "</turn>\n</turn>\n~"]
    turns = [(c, t, r, texts[(c + t) % 6]) for c in (1, 2, 3) for t, r in enumerate(["user", "assistant", "a>b<c~2", "assistant", None])] + [(None, 0, "user", "x"), (4, 0, "user", "r"), (4, 0, "user", "r")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(3)
    rows = {r.conv_id: r for r in chat_format.digests(chat_format.format_conversations(chat_format.text_parts(df))).collect()}
    by = defaultdict(list)
    for c, t, r, x in turns:
        by[c].append((t, r or "", x or ""))
    for c, ts in by.items():
        ts.sort()
        loss = "".join(x for _, r, x in ts if r == "assistant")
        said = "".join(f"{r}\n{x}\n" for _, r, x in ts)
        assert (rows[c].n_turns, rows[c].turns_sha256) == (len(ts), hashlib.sha256(said.encode()).hexdigest()), c
        assert (rows[c].loss_chars, rows[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat_format.digests(chat_format.format_conversations(chat_format.text_parts(df.limit(0)))).count() == 0


def test_chat_long_texts_and_clashing_columns(spark):
    texts = ["~<a>\n" * 300_000, "word " * 200_000 + "</turn>", "é🙂~" * 100_000]
    turns = [(1, 0, "user", texts[0], "x"), (1, 1, "assistant", texts[1], "y"), (1, 2, "assistant", texts[2], None)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, parts string")
    for c in ("n_turns", "rendered", "loss", "formatted", "mask", "content", "turns", "ord"):
        df = df.withColumn(c, F.lit("clash"))
    row = chat_format.digests(chat_format.format_conversations(chat_format.text_parts(df))).first()
    said = "".join(f"{r}\n{x}\n" for _, _, r, x, _ in turns)
    assert (row.n_turns, row.turns_sha256) == (3, hashlib.sha256(said.encode()).hexdigest())
    assert (row.loss_chars, row.loss_sha256) == (len(texts[1]) + len(texts[2]), hashlib.sha256((texts[1] + texts[2]).encode()).hexdigest())


def test_chat_media_parts(spark):
    parts = "array<struct<type: string, text: string, ref: string, units: long>>"
    df = spark.createDataFrame([(1, 0, "user", [("text", "see <image>", None, 0), ("image", None, "i.png", 2), ("document", None, "d.pdf", 3)]), (1, 1, "assistant", [("text", "ok", None, 0), ("audio", None, "a.wav", 4)])], f"conv_id long, turn long, role string, parts {parts}")
    r = chat_format.format_conversations(df).first()
    assert r.formatted == "<turn:user>see ~1image><image><document></turn>\n<turn:assistant>ok<audio></turn>\n"
    assert [(a.ordinal, a.type, a.ref, a.tokens) for a in r.attachments] == [(0, "image", "i.png", 512), (1, "document", "d.pdf", 1536), (2, "audio", "a.wav", 100)]
    assert r.expanded_tokens == 2148 and [s.text for s in r.segments if s.loss] == ["ok"]


# -- page text


def test_page_parts():
    page = """<!DOCTYPE html><html><head><title>t</title><script>if (a</b>) x("<p>")</script></head><body class="menu page"><header>Site</header><nav><a>m</a></nav>
    <div id="cookie-notice">cookies</div><aside>side</aside><article><header><h1>Head &amp; <b>line</b></h1></header><p>One<br>two  &lt;x&gt;<p>Un<i>closed</i>
    <form>f<input></form><div class="ad">buy</div><ul><li>a<li>b</ul><script>x</script><!-- <p>no</p> --><section class="comments"><article>c</article></section></article><div class="comment">c</div><footer>f</footer></body></html>"""
    assert [x.text for x in page_text.lines_of(page) if x.article and not x.furniture] == ["Head & line", "One two <x>", "Unclosed", "a", "b"]
    assert page_text.lines_of("") == [] and page_text.lines_of("<p>a<script>never closed") == [("a", False, False)]
    # classes inside an article count as whole words only; forms are told by what they hold; furniture inside a line is a line of its own
    assert page_text.lines_of('<div class="article-header"><h1>T</h1></div><article><section class="related-work">w</section><div class="ad">x</div></article>') == [("T", False, False), ("w", True, False), ("x", True, True)]
    assert page_text.lines_of("<form><p>most of the page</p></form><form>go</form>") == [("most of the page", False, False), ("go", False, True)]
    assert page_text.lines_of("<form><article><p>a</p></article><p>much longer text that is outside</p></form><p>b</p>")[0] == ("a", True, False)
    assert page_text.lines_of('<p>one <span class="ad">buy</span> two</p>') == [("one two", False, False), ("buy", False, True)]


def test_article_text_is_kept_and_adverts_and_comments_go():
    kept = lambda page: [x.text for x in page_text.lines_of(page) if not x.furniture]
    article = "<article><p>Let <math><mi>x</mi></math> be</p><p class='share'>shared</p><li class='social notice'>item</li><object><p>fallback</p></object><p class='ad'>buy</p><div class='share'>bar</div></article>"
    assert kept(article) == ["Let x be", "shared", "item", "fallback"]
    assert kept("<article class='ad'><p>buy</p></article><div class='ad-content'>buy</div><div class='comments-content'>hi</div><div class='post-comments'>hi</div>") == []
    assert kept("<div class='entry-content ad-free'>a</div><article class='post has-comments'>b</article><div class='content-area no-sidebar'>c</div>") == ["a", "b", "c"]
    assert kept("<p>a<!-- x --!>b</p><p>c</ p>d</p>e</>f<p>g</1 <p>h") == ["ab", "cd", "ef", "gh"]
    assert kept("<svg><text>drawn</text></svg><noscript>n</noscript><textarea>t</textarea><p>a</") == ["a</"]


@pytest.mark.parametrize("junk", ['<a "', "<a '", "a <b c ", '<a="', "</script ", "<script></script ", "<!--", "<", "<div>", "<form>"])
def test_junk_pages_are_scanned_once(junk):
    from time import perf_counter

    start = perf_counter()
    page_text.lines_of(junk * (400_000 // len(junk)))
    assert perf_counter() - start < 5


def test_alignment_of_repeated_lines_is_bounded():
    from time import perf_counter

    start = perf_counter()
    r = random.Random(8)
    a, b = ([r.randint(0, 2) for _ in range(8000)] for _ in range(2))
    got = page_text.common_lines(a, b)
    it = iter(b)
    assert perf_counter() - start < 5 and len(got) == page_text.lengths(a, b)[-1] and all(a[i] in it for i in got)


def brute_pages(rows):
    """Plain pages (one element a line, furniture in nav, articles in article): pairing, alignment by a table and the two rules."""
    from urllib.parse import urlsplit

    lines = []
    for _, url, page in rows:
        found = []
        for part in re.findall(r"<article>.*?</article>|<(?:p|nav)>.*?</(?:p|nav)>", page or "", re.S):
            if part.startswith("<article>"):
                found += [(t, True, False) for t in re.findall("<p>(.*?)</p>", part)]
            else:
                found.append((re.sub("<.*?>", "", part), False, part.startswith("<nav>")))
        lines.append(found)
    where = [(urlsplit(u or "").netloc, urlsplit(u or "").path + "?" + urlsplit(u or "").query, i) for i, (_, u, _) in enumerate(rows)]
    same = [[x for x in f if x[1]] or [("", False, True), *((t, False, False) for t, _, _ in f)] for f in lines]
    order = sorted((i for i in range(len(rows)) if lines[i]), key=lambda i: where[i])
    out = []
    for i, found in enumerate(lines):
        near = []
        if i in order:
            k = order.index(i)
            for side in (order[:k][::-1], order[k + 1 :]):
                near += [j for j in side if where[j][0] == where[i][0] and same[j] != same[i]][:1]
        if not near:
            out.append(("\n\n".join(t for t, a, f in found if a or not f), 0))
            continue
        common = lambda x, y: next((n for n, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
        other = [t for t, _, _ in lines[max(near, key=lambda j: common(where[j][1], where[i][1]))]]
        # a shared line: one whose removal from the alignment would shorten it; texts are distinct within a page here, so the table's walk is unique enough
        own = [t for t, _, _ in found]
        shared = {t for t in own if t in other}
        deleted = [x for x in found if x[0] in shared and not x[1]]
        out.append(("\n\n".join(t for t, a, f in found if a or not (t in shared or f)), len(deleted)))
    return out


def test_main_text_equals_brute_force(spark):
    r = random.Random(11)
    rows = []
    for i in range(60):
        host = r.choice(["a.org", "a.org", "b.org", "c.net"])
        top, bottom = f"<nav>Menu of {host}</nav><p>Welcome to {host}</p>", f"<nav>Only {i}</nav><p>Rights of {host}</p>"
        body = "".join(f"<p>{prose(6, r)} {i}</p>" for _ in range(r.randint(1, 3)))
        rows.append((i, f"http://{host}/{r.choice('xyz')}/{r.randint(0, 30)}", top + (f"<article>{body}</article>" if r.random() < 0.6 else body) + bottom))
    rows += [rows[3], rows[4], (90, None, None), (91, "http://a.org/x", ""), (None, "http://lone.org/", "<p>alone</p><nav>m</nav>"), (92, "http://b.org/long", f"<p>{'w ' * 300_000}</p>"), (93, "http://b.org/junk", "<p>q</p>" + '<a "' * 50_000)]
    df = spark.createDataFrame([(*x, 1, "s", [1]) for x in rows], "page_id long, url string, html string, row_id long, shared string, lines array<long>").coalesce(1)
    got = page_text.main_text(df).collect()
    want = brute_pages([(i, u, (h or "").split('<a "')[0].replace("w w", "w") if i == 93 else h) for i, u, h in rows])
    tidy = lambda t: re.sub(" +", " ", t).strip()
    assert sorted((repr(x.page_id), x.url or "", x.text, x.n_shared) for x in got) == sorted((repr(i), u or "", "\n\n".join(map(tidy, t.split("\n\n"))), n) for (i, u, _), (t, n) in zip(rows, want))
    assert sum(x.n_shared for x in got) > 100 and sum(x.n_named for x in got) > 30
    assert all(x.n_lines == 0 for x in got if not x.text and x.page_id in (90, 91))


def test_common_lines_is_a_longest_common_subsequence():
    r = random.Random(6)
    for _ in range(200):
        a, b = ([r.randint(0, 5) for _ in range(r.randint(0, 12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        got = page_text.common_lines(a, b)
        it = iter(b)
        assert len(got) == table[-1][-1] and got == sorted(set(got)) and all(a[i] in it for i in got)


def test_differencing_deletes_shared_lines(spark):
    page = lambda i: f"<div>Welcome to the site</div><div>{prose(9)} {i}</div><p>{prose(12)}</p><p>{prose(12)}</p><div>All rights</div>"
    rows = [(i, f"http://h.org/en/{i}", page(i)) for i in range(6)] + [(10, "http://other.org/1", "<p>alone</p>"), (11, None, None), (12, "http://h.org/en/7", "<article><p>Welcome to the site</p></article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in page_text.main_text(df).collect()}
    for i in range(6):
        assert "Welcome" not in got[i] and "rights" not in got[i] and got[i].count("\n\n") == 2
    assert (got[10], got[11], got[12]) == ("alone", "", "Welcome to the site")
    assert {r.page_id: r.n_by_difference_alone for r in page_text.main_text(df).collect()} == {**{i: 2 for i in range(6)}, 10: 0, 11: 0, 12: 0}
    copies = spark.createDataFrame([(i, f"http://c.org/{i}", "<p>same</p><p>page</p>") for i in (1, 2)], df.schema)
    assert [r.text for r in page_text.main_text(copies).collect()] == ["same\n\npage"] * 2
    assert page_text.main_text(df.limit(0)).count() == 0


def test_every_page_is_paired_and_the_article_is_exempt_by_line(spark):
    article = lambda w: f"<div>Top bar</div><p>Lead {w}</p><article><p>Shared words</p><p>Body {w}</p></article><div>All rights</div>"
    quoted = "<div>Top bar</div><p>Story</p><!-- <article> --><div>All rights</div>"
    rows = [(i, f"http://h.org/a/{i}", article(i)) for i in (1, 2)] + [(i, f"http://h.org/a/{i}", article("mirror")) for i in (3, 4, 5)]
    rows += [(6, "http://h.org/a/6", "<div>Top bar</div><p>No article</p><div>All rights</div>"), (7, "http://h.org/a/7", quoted), (8, "http://lone.org/", article(8))]
    for n in (1, 9):  # one range partition, and ends that lie inside a run of mirrors
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got = {r.page_id: r.text for r in page_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        for i in range(1, 6):
            w = i if i < 3 else "mirror"
            assert got[i] == f"Lead {w}\n\nShared words\n\nBody {w}"
        assert (got[6], got[7]) == ("No article", "Story")
        assert got[8] == "Top bar\n\nLead 8\n\nShared words\n\nBody 8\n\nAll rights"  # alone on its host: nothing is shared, and no name speaks against a line


# -- language identification, toxicity


def test_language_identification(documents, empty):
    r = random.Random(3)
    kinds = {"xx": ["bala", "kolo", "mana", "lobo"], "yy": ["strix", "grend", "sklor", "wurst"]}
    texts = [(i, " ".join(r.choices(kinds[k], k=20)), k) for i in range(160) for k in [["xx", "yy"][i % 2]]] + [(900, None, "xx"), (901, "12 !", "yy"), (902, "", None), (None, "bala kolo", None)]
    rows = language_id.identify(documents(texts)).collect()
    assert len(rows) == len(texts)
    want = {i: k for i, _, k in texts}
    for x in rows:
        if x.doc_id is not None and x.doc_id < 900:
            assert x.lang_pred == want[x.doc_id] and 0 <= x.score <= 1
    assert {x.lang_pred for x in rows if x.doc_id in (900, 901, 902)} == {"und"} and any(x.held_out for x in rows)
    assert language_id.identify(empty).count() == 0
    assert {x.lang_pred for x in language_id.identify(documents([(1, "abc", None)])).collect()} == {"und"}


def test_kernel_scores_equal_the_dual_form():
    """Collapsed weights give what kernel columns to the landmarks, whitening and ridge regression give one after the other."""
    r = random.Random(2)
    texts = [(k, " ".join(r.choices({"a": ["ab", "ba", "bb"], "b": ["cd", "dc", "ab"]}[k], k=12)).encode()) for k in ["a", "b"] * 10]
    sets = [(k, np.unique(np.concatenate([c for _, c in language_id.gram_codes(*language_id.concat_bytes([t]))]))) for k, t in texts]
    m = language_id.train(sets, landmarks=6)
    kernel = lambda x, y: len(np.intersect1d(x, y)) / np.sqrt(len(x) * len(y))
    k_mm = np.array([[kernel(x, y) for _, y in sets[:6]] for _, x in sets[:6]])
    k_nm = np.array([[kernel(x, y) for _, y in sets[:6]] for _, x in sets])
    values, vectors = np.linalg.eigh(k_mm)
    good = values > 1e-6 * values.max()
    z = k_nm @ (vectors[:, good] / np.sqrt(values[good]))
    y = np.array([[1.0 if k == c else -1.0 for c in "ab"] for k, _ in texts])
    want = z @ np.linalg.solve(z.T @ z + language_id.RIDGE * len(z) * np.eye(z.shape[1]), z.T @ y)
    other = [b"xyz xyz xyz ab", b"cd", b"\xff\xfe"]
    got = m.scores([t for _, t in texts] + other, m.places(), np.zeros(language_id.CODES, np.int32))
    assert np.abs(got[: len(texts)] - want).max() < 1e-3
    grams = [np.unique(np.concatenate([c for _, c in language_id.gram_codes(*language_id.concat_bytes([t]))])) for t in other]
    k = np.array([[kernel(x, y) for _, y in sets[:6]] for x in grams])  # grams without a landmark count in the norm
    beyond = k @ (vectors[:, good] / np.sqrt(values[good])) @ np.linalg.solve(z.T @ z + language_id.RIDGE * len(z) * np.eye(z.shape[1]), z.T @ y)
    assert np.abs(got[len(texts) :] - beyond).max() < 1e-3


def test_language_rows_are_bounded_by_rows(documents):
    import zlib

    a, b, c = [i for i in range(50) if zlib.crc32(str(i).encode()) % 4 != 2][:3]
    docs = documents([(a, "bala kolo", "xx")] * 30 + [(b, "strix grend", "yy")] * 30 + [(c, "long " * 200_000, "zz")]).withColumn("grams", F.lit(1)).withColumn("rank", F.lit("s"))
    rows = language_id.training_rows(docs, per_lang=3, max_rows=5)
    assert len(rows) == 5 and Counter(k for k, _ in rows) == {"xx": 2, "yy": 2, "zz": 1}
    assert {x.lang_pred for x in language_id.identify(docs).collect()} <= {"xx", "yy", "zz"}


def test_toxicity(spark, documents, empty):
    r = random.Random(1)
    bad = lambda i: i % 5 == 0
    docs = documents([(i, prose(30, r) + (" vile rotten" if bad(i) else "")) for i in range(300)] + [(900, None), (901, prose(20, r) + " vile"), (901, prose(20, r))])
    labels = spark.createDataFrame([(i, 1, int(bad(i))) for i in range(200)] + [(5, 0, 0), (7, None, 1)], "doc_id long, quality int, toxic int")
    rows = toxicity.toxicity(docs, labels).collect()
    assert len(rows) == 303
    wrong = [x.doc_id for x in rows if x.doc_id < 300 and x.toxic != bad(x.doc_id)]
    assert len(wrong) <= 6, wrong
    assert toxicity.toxicity(empty, labels).count() == 0
    assert not any(x.toxic for x in toxicity.toxicity(docs, labels.limit(0)).collect())


def test_toxicity_chain_equals_brute_force(spark, documents):
    """The chain in numpy: words of enough labelled documents, out-of-fold probabilities of the first category as a feature of the second, lasso fits to the end."""
    import zlib

    r = random.Random(5)
    bad = lambda i: i % 4 == 0
    texts = [(i, prose(12, r) + (" Vile" if bad(i) and r.random() < 0.9 else "") + (" poor" if i % 3 == 0 else "")) for i in range(240)] + [(7, "another row of seven"), (None, "vile"), (500, None), (501, "vile " * 100_000)]
    docs = documents(texts).withColumn("fold", F.lit("s")).withColumn("features", F.lit(1)).coalesce(1)
    labels = {i: (int(i % 3 != 0), int(bad(i))) for i in range(200)}
    frame = spark.createDataFrame([(i, q, t) for i, (q, t) in labels.items()] + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    got = sorted(((x.doc_id, x.p_low_quality, x.p_toxic) for x in toxicity.toxicity(docs, frame).collect()), key=repr)
    sets = lambda t: set(re.findall(r"[a-zé]+", (t or "").lower()))
    first = {}
    for i, t in texts:
        first.setdefault(i, sets(t))
    ids = list(labels)
    counts = Counter(w for i in ids for w in first[i])
    vocabulary = [w for w, n in counts.items() if n >= toxicity.MIN_DOCS]
    rows = lambda some: np.array([[float(w in s) for w in vocabulary] for s in some])
    fold = np.array([zlib.crc32(str(i).encode()) % toxicity.FOLDS for i in ids])
    penalty = toxicity.PENALTY / len(ids) ** 0.5

    def fit(x, y):
        """Proximal gradient with momentum; the last coefficient is the intercept, which is not penalised."""
        x = np.hstack([x, np.ones((len(x), 1))])
        w = v = np.zeros(x.shape[1])
        step, k = 4 * len(x) / np.linalg.norm(x, 2) ** 2, 1.0
        for _ in range(20_000):
            g = v - step * (x.T @ (1 / (1 + np.exp(-x @ v)) - y)) / len(x)
            new = np.append(np.sign(g[:-1]) * np.maximum(np.abs(g[:-1]) - step * penalty, 0), g[-1])
            k, old = (1 + (1 + 4 * k * k) ** 0.5) / 2, k
            w, v = new, new + (old - 1) / k * (new - w)
        return w

    p = lambda w, x: 1 / (1 + np.exp(-(x @ w[:-1] + w[-1])))
    x, low, tox = rows(first[i] for i in ids), np.array([1 - labels[i][0] for i in ids]), np.array([labels[i][1] for i in ids])
    out = np.zeros(len(ids))
    for f in range(toxicity.FOLDS):
        out[fold == f] = p(fit(x[fold != f], low[fold != f]), x[fold == f])
    one, two = fit(x, low), fit(np.hstack([x, out[:, None]]), tox)
    every = rows(sets(t) for _, t in texts)
    p_low = p(one, every)
    p_tox = p(two, np.hstack([every, p_low[:, None]]))
    want = sorted(zip((i for i, _ in texts), p_low, p_tox), key=repr)
    assert len(got) == len(want)
    by = lambda rs: sorted((repr(i), round(a, 2), round(b, 2)) for i, a, b in rs)
    assert all(i == j and abs(a - c) < 0.011 and abs(b - d) < 0.011 for (i, a, b), (j, c, d) in zip(by(got), by(want)))


def test_toxicity_bounds(spark, documents):
    """A fit takes max_labelled documents at most; where no word is frequent enough every document gets the shares."""
    docs = documents([(i, f"w{i}") for i in range(20)] * 3)
    labels = spark.createDataFrame([(i, 1, i % 4 == 0) for i in range(20)], "doc_id long, quality int, toxic boolean")
    rows = toxicity.chain(docs, labels, {"toxic": F.col("toxic").cast("int")}).collect()
    assert len(rows) == 60 and {round(x.p_toxic, 6) for x in rows} == {0.25}
    few = toxicity.chain(documents([(i, "same words") for i in range(40)]), labels, {"toxic": F.lit(1) * F.col("toxic").cast("int")}, max_labelled=7).collect()
    order = sorted(range(20), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())[:7]
    assert {round(x.p_toxic, 4) for x in few} == {round(sum(i % 4 == 0 for i in order) / 7, 4)}


def test_lasso_equals_a_public_trainer(spark):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import Vectors

    r = random.Random(3)
    sets = [[j for j in range(40) if r.random() < (0.05 + 0.4 * (j % 7 == i % 3))] for i in range(400)]
    y = [float(i % 3 == 0 or r.random() < 0.1) for i in range(400)]
    dense = [r.random() for _ in range(400)]
    rows = spark.createDataFrame([(v, Vectors.sparse(41, [*((j, 1.0) for j in x), (40, d)])) for v, x, d in zip(y, sets, dense)], ["y", "x"])
    model = LogisticRegression(featuresCol="x", labelCol="y", regParam=0.002, elasticNetParam=1.0, maxIter=3000, tol=1e-12, standardization=False).fit(rows)
    row, place = np.array([(i, j) for i, x in enumerate(sets) for j in x]).T
    w, e, b = toxicity.lasso(row, place, 40, np.array(dense)[:, None], np.array(y), 0.002)
    assert np.abs(np.append(w, e) - model.coefficients.toArray()).max() < 0.02 and abs(b - model.intercept) < 0.02
    assert (w == 0).sum() >= 5


def test_lasso_works_on_few_features(monkeypatch):
    """Where hundreds of features tell the same, few of them enter the working set; the weights are optimal over all."""
    r = np.random.default_rng(4)
    cause = r.random(600) < 0.3
    x = np.column_stack([cause, *((cause & (r.random(600) < 0.8)) | (r.random(600) < 0.1) for _ in range(500))])
    y = (cause ^ (r.random(600) < 0.05)).astype(float)
    sizes, descend = [], toxicity.descend
    monkeypatch.setattr(toxicity, "descend", lambda row, place, size, *rest: (sizes.append(size), descend(row, place, size, *rest))[1])
    row, place = np.nonzero(x)
    w, _, b = toxicity.lasso(row, place, x.shape[1], np.zeros((600, 0)), y, 0.004)
    gradient = x.T @ (1 / (1 + np.exp(-(x @ w + b))) - y) / 600
    assert np.abs(gradient).max() < 0.004 * 1.01 and np.abs(gradient[w != 0] + 0.004 * np.sign(w[w != 0])).max() < 0.004 * 0.05
    assert max(sizes) <= 2 * toxicity.GROWTH, sizes


def test_each_fit_is_made_once(spark, tmp_path, monkeypatch):
    notes, lasso = str(tmp_path / "fits"), toxicity.lasso

    def noted(*given):
        with open(notes, "a") as f:
            f.write("fit\n")
        return lasso(*given)

    monkeypatch.setattr(toxicity, "lasso", noted)
    rows = spark.createDataFrame([(i, [i % 2], [], float(i % 2), [0, 1, 2]) for i in range(60)], "doc_id long, places array<int>, earlier array<double>, y double, fits array<int>")
    models = toxicity.fits(rows, "y", 2, 0.01)
    assert len(models) == 3 and open(notes).read().count("fit") == 3


# -- pipeline


def brute_pipeline(rows):
    """Row numbers that the first three stages keep: base rules (no histogram is judged or far in these texts), equal texts, near copies."""
    def rules(i):
        w = words(rows[i][1])
        grams = Counter(tuple(w[j : j + 8]) for j in range(len(w) - 7))
        return len(w) >= 20 and 100 * len({k for j in range(len(w) - 7) if grams[tuple(w[j : j + 8])] > 1 for k in range(j, j + 8)}) <= 30 * len(w)

    rank = lambda i: (rows[i][0] is None, rows[i][0] or 0, i)
    one = [i for i in range(len(rows)) if rules(i)]
    groups = defaultdict(list)
    for i in one:
        groups["".join(words(rows[i][1]))].append(i)
    two = [min(g, key=lambda i: (-len(rows[i][1]), *rank(i))) for g in groups.values()]
    links = brute_links({i: rows[i][1] for i in two}, 5, 8, 10)
    three = defaultdict(list)
    for i in two:
        three[links[i][1]].append(i)
    return [one, two, [min(g, key=rank) for g in three.values()]]


@pytest.mark.parametrize("case", ["unique ids", "repeated and missing ids", "empty"])
def test_pipeline_stages(spark, tmp_path, documents, case):
    import corpus_pipeline as P

    r = random.Random(12)
    good = {i: prose(r.randint(40, 90), r) for i in range(30)}
    texts = [*good.items(), (30, good[0].replace(" ", "  ")), (31, good[1] + " x"), (32, "short"), (33, None), (34, "same words again " * 40)]
    if case != "unique ids":
        texts = [(None if i % 5 == 0 else i // 3, t) for i, t in texts] + [(3, good[3])] * 3 + [(None, good[5])] * 2 + [(1, "short")]
    if case == "empty":
        texts = []
    extra = documents(texts).coalesce(1).withColumn("row_key", F.lit("mine")).withColumn("row_id", F.lit(1)).withColumn("size", F.lit(2.5)).withColumn("kept", F.lit(None).cast("boolean"))
    extra.write.parquet(f"{tmp_path}/documents.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.filter("row_key <> 'mine' or row_id <> 1 or size <> 2.5 or kept is not null").isEmpty()
        seen.append(sorted(((x.doc_id, x.text) for x in docs.collect()), key=repr))
    for got, want in zip(seen, brute_pipeline(texts)):
        assert got == sorted((texts[i] for i in want), key=repr)
    pool = Counter(seen[2])
    whole, words_taken = Counter(x for x in seen[3] if x in pool), sum(len(words(t)) for _, t in seen[3])
    assert all(n <= 2 * pool[x] for x, n in whole.items()) and sum(x not in pool for x in seen[3]) <= 1
    assert words_taken == int(1.5 * sum(len(words(t)) for _, t in seen[2]) + 0.5)
    rows = P.run(spark, str(tmp_path)).collect()
    assert Counter(x.doc_id for x in rows if x.start == 0) == Counter(i for i, _ in seen[3])
    seqs = Counter()
    for x in rows:
        seqs[x.sequence_id] += x.length
    assert all(n <= 2048 for n in seqs.values())
