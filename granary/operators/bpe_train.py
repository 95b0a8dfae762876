"""Shared BPE vocabulary from weighted piece counts, as Spark jobs.

The distinct pieces with their weighted counts are the only data, as lists of symbol ids; merging is left to right and never overlapping.

Training goes by epochs. The candidates of an epoch are the most frequent pairs. Between two symbols that are no candidate nothing merges as long as all merges rank above the first
pair that is left out: a pair of merged symbols is no more frequent than the pair of symbols that met there at the start, and has newer ids, so it loses ties too. So every
piece falls into segments, which are cut where neighbours are no candidate; equal segments of all pieces are summed up, and merging them one by one is merging
all pieces one by one. The driver does that for a bounded number of distinct segments (with too many, fewer candidates are taken), executors look the outcome up.

The second stage of superwords goes by rounds instead: Arrow batches apply the latest merges and sum adjacent pairs, Spark adds the sums up, and merges are taken together where that cannot change the outcome: see `batch`.
"""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.text import characters, lines, split_pieces
from granary.sources.tables import materialize

OPEN, CLOSE, UNK = "\x01", "\x02", "[UNK]"
FETCH, KEEP_ROUNDS, TASK_SYMBOLS = 512, 12, 200_000
FINE = 64  # parts of a weight of 1 when weights are tuned
HELD = 200_000  # most distinct pieces that a task counts before it hands them on, but for those of one batch
CANDIDATES, SEGMENTS = 4096, 100_000  # most candidate pairs of an epoch, and most distinct segments
WORDS, PACKED = "ids array<int>, count long", "ids binary, sizes binary, counts binary"
SHIFT, LOW = 32, (1 << 32) - 1  # a pair of ids as one number


def piece_counts(docs: DataFrame) -> DataFrame:
    """lang, piece, n over training lines; pieces never cross a line end. Counted by each task before they move, HELD distinct ones or so at a time."""
    schema = pa.schema([("lang", pa.string()), ("piece", pa.string()), ("n", pa.int64())])

    def given(counts: dict[str | None, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, found in counts.items():
            found.pop("", None)
            pieces = pc.replace_substring(pa.array(list(found), pa.string()), " ", "▁")
            yield pa.record_batch([pa.array([lang] * len(found), pa.string()), pieces, pa.array(list(found.values()), pa.int64())], schema=schema)
        counts.clear()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str | None, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                if text:
                    own = counts.setdefault(lang, Counter())
                    own.update(split_pieces(text))
                    if len(own) > HELD:
                        yield from given({lang: counts.pop(lang)})
            if sum(map(len, counts.values())) > HELD:
                yield from given(counts)
        yield from given(counts)

    return docs.select(F.col("lang").cast("string"), "text").mapInArrow(scan, "lang string, piece string, n long").groupBy("lang", "piece").agg(F.sum("n").alias("n"))


def weighted_piece_counts(docs: DataFrame, weights: dict[str, int]) -> DataFrame:
    """piece, count; each language's counts times its weight (1 if unnamed). Text is never repeated."""
    return weigh(piece_counts(docs), weights)


def weigh(counts: DataFrame, weights: dict[str, int], other: int = 1) -> DataFrame:
    """piece, count over languages; other: the weight of languages that are not named."""
    w = F.coalesce(*(F.when(F.col("lang") == k, F.lit(v)) for k, v in weights.items()), F.lit(other))
    return counts.groupBy("piece").agg(F.sum(F.col("n") * w).alias("count"))


def alphabet(pieces: DataFrame, column: str = "piece") -> DataFrame:
    """id, token: distinct characters by code point, from 1 (0 is the unknown token). One row per character, so a bounded table."""
    from pyspark.sql.window import Window

    chars = pieces.select(F.explode(characters(F.col(column))).alias("token")).distinct()
    return chars.select(F.row_number().over(Window.orderBy("token")).cast("int").alias("id"), "token")


def wrap(piece: Column) -> Column:
    return F.concat(F.lit(OPEN), F.array_join(characters(piece), CLOSE + OPEN), F.lit(CLOSE))


def pair_counts(words: DataFrame) -> DataFrame:
    """left, right, count over wrapped words (wrapped, count)."""
    symbols = F.split(F.expr("substring(wrapped, 2, length(wrapped) - 2)"), CLOSE + OPEN)
    rows = words.select("count", symbols.alias("s"))  # no filter on s: it would be worked out once more for each
    pairs = F.arrays_zip(F.expr("slice(s, 1, size(s) - 1)").alias("left"), F.expr("slice(s, 2, size(s) - 1)").alias("right"))
    return rows.select("count", F.inline(pairs)).toDF("count", "left", "right").groupBy("left", "right").agg(F.sum("count").alias("count"))


@dataclass
class Vocabulary:
    tokens: list[str]  # by id
    merges: list[tuple[str, str]]  # by rank
    complete: bool = True  # whether the text gave as many entries as were asked for

    @property
    def ids(self) -> dict[str, int]:
        return {t: i for i, t in enumerate(self.tokens)}


def batch(ranked: list[tuple[str, str]], ids: dict[str, int], room: int) -> list[tuple[str, str]]:
    """The longest run of top pairs that sequential merging would take in this order.

    ranked: pairs by (count desc, left id, right id). A pair joins the run if it shares no symbol end to end with pairs taken, so that
    its count stands, is no self pair, and makes a new string. Nothing overtakes it meanwhile: a merge only lowers counts of old pairs,
    and a pair it makes is no more frequent than the old pair it comes from, which is further down, and has a newer id in the place
    of an older one, so it loses ties too.
    """
    taken: list[tuple[str, str]] = []
    lefts, rights, made = set(), set(), set()
    for a, b in ranked[:room]:
        alone = a == b or a + b in ids or a + b in made
        if taken and (alone or a in rights or b in lefts):
            break
        taken.append((a, b))
        if alone:
            break
        lefts.add(a), rights.add(b), made.add(a + b)
    return taken


def train(counts: DataFrame, vocab_size: int, strict: bool = True) -> Vocabulary:
    """Merges until vocab_size less the 256 byte tokens is reached; counts: piece, count. If the text gives fewer: an error, or, not strict, what it gives, marked as not complete."""
    counts = materialize(counts, "counts")  # read for the alphabet and for the words
    tokens = [UNK] + [r.token for r in alphabet(counts).orderBy("id").collect()]
    tokens, merges = grow_by_segments(symbol_ids(counts, tokens), tokens, vocab_size - 256)
    if strict and len(tokens) < vocab_size - 256:
        raise ValueError(f"only {len(tokens)} of {vocab_size - 256} trained entries can be made from this text")
    return Vocabulary(with_bytes(tokens), merges, len(tokens) >= vocab_size - 256)


def spans(x: np.ndarray, word: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where segments of two symbols or more begin and end: runs of a word in which each two neighbours are one of codes (sorted)."""
    code = x[:-1] << SHIFT | x[1:]
    place = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
    linked = np.concatenate(([False], (codes[place] == code) & (word[:-1] == word[1:]), [False]))
    return np.nonzero(~linked[:-1] & linked[1:])[0], np.nonzero(linked[:-1] & ~linked[1:])[0] + 1


def packed_row(x: np.ndarray, sizes: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """Words as one row of numbers: their symbols one after the other, how many each has, and its count. Words that are one symbol are of no more use and left out."""
    some = sizes > 1
    columns = (x[np.repeat(some, sizes)].astype(np.int32), sizes[some].astype(np.int32), counts[some].astype(np.int64))
    return pa.record_batch([pa.array([c.tobytes()], pa.binary()) for c in columns], names=["ids", "sizes", "counts"])


def packed_words(words: DataFrame) -> DataFrame:
    """words (ids, count) in rows of about TASK_SYMBOLS symbols."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            ids = batch.column("ids")
            held.append((ids.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(ids).to_numpy(zero_copy_only=False), batch.column("count").to_numpy()))
            n += len(held[-1][0])
            if n >= TASK_SYMBOLS:
                yield packed_row(*(np.concatenate(c) for c in zip(*held)))
                held, n = [], 0
        if held:
            yield packed_row(*(np.concatenate(c) for c in zip(*held)))

    return words.mapInArrow(scan, PACKED)


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Symbols, the word each belongs to, sizes and counts of words, of each packed row that has words."""
    for batch in batches:
        for x, sizes, counts in zip(*(batch.column(c).to_pylist() for c in ("ids", "sizes", "counts"))):
            if sizes:
                sizes = np.frombuffer(sizes, np.int32)
                yield np.frombuffer(x, np.int32).astype(np.int64), np.repeat(np.arange(len(sizes)), sizes), sizes, np.frombuffer(counts, np.int64)


def packed_pairs(words: DataFrame) -> DataFrame:
    """code, count of adjacent pairs over packed words."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, word, _, counts in unpacked(batches):
            code, n = summed_pairs(x, word, counts, -1, None)
            yield pa.record_batch([pa.array(code), pa.array(n)], names=["code", "count"])

    return words.mapInArrow(scan, "code long, count long").groupBy("code").agg(F.sum("count").alias("count"))


def segment_counts(words: DataFrame, codes: np.ndarray) -> DataFrame:
    """segment (ids as 32-bit numbers), count over packed words."""

    def given(sums: Counter) -> pa.RecordBatch:
        return pa.record_batch([pa.array(list(sums), pa.binary()), pa.array(list(sums.values()), pa.int64())], names=["segment", "count"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Counter = Counter()
        for x, word, _, counts in unpacked(batches):
            start, end = spans(x, word, codes)
            packed = x.astype(np.int32).tobytes()
            for a, b, n in zip((4 * start).tolist(), (4 * end).tolist(), counts[word[start]].tolist()):
                sums[packed[a:b]] += n
            if len(sums) > HELD:
                yield given(sums)
                sums.clear()
        yield given(sums)

    return words.mapInArrow(scan, "segment binary, count long").groupBy("segment").agg(F.sum("count").alias("count"))


def merge_segments(found: list[tuple[bytes, int]], tokens: list[str], ids: dict[str, int], bound: tuple | None, target: int) -> tuple[list[tuple[str, str]], dict[bytes, bytes]]:
    """Merges one by one, tokens and ids grow with them: the most frequent pair of all segments, as long as it ranks above bound, (-count, left, right) of the first pair
    that is no candidate. Returns the merges and the segments that they changed.

    A merge whose string is an entry already ends the epoch: its symbol then stands for different symbols of the start, and counts of its pairs could add up.
    """
    symbols, counts = [np.frombuffer(s, np.int32).tolist() for s, _ in found], [n for _, n in found]
    pairs: Counter = Counter()
    holders = defaultdict(set)
    for i, (x, n) in enumerate(zip(symbols, counts)):
        for p in zip(x, x[1:]):
            pairs[p] += n
            holders[p].add(i)
    heap = [(-n, *p) for p, n in pairs.items()]
    heapq.heapify(heap)
    merges, changed = [], set()
    while heap and len(tokens) < target:
        best = heapq.heappop(heap)
        n, a, b = best
        if pairs[a, b] != -n:  # has changed since
            continue
        if bound is not None and best >= bound:
            break
        text = tokens[a] + tokens[b]
        merges.append((tokens[a], tokens[b]))
        again = text in ids
        if not again:
            ids[text] = len(tokens)
            tokens.append(text)
        new, touched = ids[text], set()
        for i in holders.pop((a, b)):
            x, y, at = symbols[i], [], 0
            while at < len(x):
                joins = x[at] == a and at + 1 < len(x) and x[at + 1] == b
                y.append(new if joins else x[at])
                at += 2 if joins else 1
            if len(x) == len(y):
                continue
            for p in zip(x, x[1:]):
                pairs[p] -= counts[i]
                touched.add(p)
            for p in zip(y, y[1:]):
                pairs[p] += counts[i]
                holders[p].add(i)
                touched.add(p)
            symbols[i] = y
            changed.add(i)
        for p in touched:
            if pairs[p] > 0:
                heapq.heappush(heap, (-pairs[p], *p))
        if again:
            break
    return merges, {found[i][0]: np.array(symbols[i], np.int32).tobytes() for i in changed}


def rewritten(words: DataFrame, codes: np.ndarray, outcome: dict[bytes, bytes]) -> DataFrame:
    """Packed words with their segments replaced."""
    shared = words.sparkSession.sparkContext.broadcast(outcome)  # at most SEGMENTS entries

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, word, sizes, counts in unpacked(batches):
            start, end = spans(x, word, codes)
            packed, parts, last, sizes = x.astype(np.int32).tobytes(), [], 0, sizes.copy()
            for a, b, w in zip(start.tolist(), end.tolist(), word[start].tolist()):
                new = shared.value.get(packed[4 * a : 4 * b])
                if new is not None:
                    parts += [packed[4 * last : 4 * a], new]
                    sizes[w] -= b - a - len(new) // 4
                    last = b
            yield packed_row(np.frombuffer(b"".join([*parts, packed[4 * last :]]), np.int32), sizes, counts)

    return words.mapInArrow(scan, PACKED)


def dealt_words(words: DataFrame) -> DataFrame:
    """words as a table of tasks of about TASK_SYMBOLS symbols."""
    words = materialize(words, "words")
    tasks = -(-(words.agg(F.sum(F.size("ids"))).first()[0] or 0) // TASK_SYMBOLS)  # follows the size of the table
    return materialize(words.repartition(max(1, tasks)), "words")


def grow_by_segments(words: DataFrame, tokens: list[str], target: int, candidates: int = 256) -> tuple[list[str], list[tuple[str, str]]]:
    """tokens and more, until there are target of them or words give no more, and the merges that make them. words: ids (places in tokens), count.

    candidates is how many an epoch begins with; the number follows what segments leave room for.
    """
    tokens, merges = list(tokens), []
    ids = {t: i for i, t in enumerate(tokens)}
    words = materialize(packed_words(words.filter(F.size("ids") > 1)), "words")
    conf, key = words.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(key)
    conf.set(key, "8")  # rows of about a megabyte
    try:
        while len(tokens) < target:
            top = packed_pairs(words).orderBy(F.desc("count"), "code").limit(CANDIDATES + 1).collect()
            if not top:
                break
            while True:
                codes = np.array(sorted(r.code for r in top[:candidates]), np.int64)
                found = segment_counts(words, codes).limit(SEGMENTS + 1).collect()
                if len(found) <= SEGMENTS or candidates == 1:  # of a single pair, segments differ in the length of runs alone
                    break
                candidates = max(1, candidates // 4)
            left_out = top[candidates] if candidates < len(top) else None
            bound = left_out and (-left_out["count"], left_out.code >> SHIFT, left_out.code & LOW)
            new, outcome = merge_segments([(bytes(r.segment), r["count"]) for r in found], tokens, ids, bound, target)
            merges += new
            if len(tokens) < target:
                words = materialize(rewritten(words, codes, outcome), "words")
            if len(found) < SEGMENTS // 4:
                candidates = min(2 * candidates, CANDIDATES)
    finally:
        conf.set(key, before)
    return tokens, merges


def symbol_ids(counts: DataFrame, tokens: list[str]) -> DataFrame:
    """ids, count: pieces as the ids of their characters."""
    ids = {t: i for i, t in enumerate(tokens)}

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[ids[c] for c in piece] for piece in batch.column("piece").to_pylist()]
            yield pa.record_batch([pa.array(rows, pa.list_(pa.int32())), batch.column("count")], names=["ids", "count"])

    return counts.select("piece", F.col("count").cast("long").alias("count")).mapInArrow(look_up, WORDS)


def symbols_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All symbols of a batch in one array, and the word each belongs to."""
    ids = batch.column("ids")
    sizes = pc.list_value_length(ids).to_numpy(zero_copy_only=False)
    return ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(sizes)), sizes)


def merge(x: np.ndarray, word: np.ndarray, codes: np.ndarray, made: np.ndarray, stop: int) -> tuple[np.ndarray, np.ndarray]:
    """x and word after the merges of one round: each pair in codes (sorted) becomes its entry of made, left to right and never overlapping."""
    first, second = np.zeros(stop + 1, bool), np.zeros(stop + 1, bool)
    first[codes >> SHIFT], second[codes & LOW] = True, True
    at = np.nonzero(first[x[:-1]] & second[x[1:]] & (word[:-1] == word[1:]))[0]
    code = x[at] << SHIFT | x[at + 1]
    place = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
    at, place = at[codes[place] == code], place[codes[place] == code]
    # only a pair of equal symbols can meet itself: of such a run every second one counts
    n = np.arange(len(at))
    begin = np.maximum.accumulate(np.where(np.diff(at, prepend=-2) != 1, n, 0)) if len(at) else n
    at, place = at[(n - begin) % 2 == 0], place[(n - begin) % 2 == 0]
    x[at] = made[place]
    keep = np.ones(len(x), bool)
    keep[at + 1] = False
    return x[keep], word[keep]


def summed_pairs(x: np.ndarray, word: np.ndarray, counts: np.ndarray, stop: int, allowed: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
    """Codes of adjacent pairs and their counts. allowed: per symbol, whether it may be the left one of any pair, or the right one."""
    a, b = x[:-1], x[1:]
    use = (word[:-1] == word[1:]) & (a != stop) & (b != stop)
    if allowed:
        use &= allowed[0][a] | allowed[1][b]
    code, n = (a << SHIFT | b)[use], counts[word[:-1][use]]
    order = np.argsort(code, kind="stable")
    code, n = code[order], n[order]
    start = np.nonzero(np.concatenate(([True], code[1:] != code[:-1])))[0] if len(code) else np.zeros(0, np.int64)
    return code[start], np.add.reduceat(n, start) if len(start) else n


def advance(words: DataFrame, rounds: list[tuple[np.ndarray, np.ndarray]], stop: int) -> DataFrame:
    """words after the merges of rounds; words that are one symbol are of no more use and left out."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, word = symbols_of(batch)
            for codes, made in rounds:
                x, word = merge(x, word, codes, made, stop)
            at = np.concatenate(([0], np.cumsum(np.bincount(word, minlength=batch.num_rows)))).astype(np.int32)
            yield pa.record_batch([pa.ListArray.from_arrays(pa.array(at), pa.array(x.astype(np.int32))), batch.column("count")], names=["ids", "count"])

    return words.mapInArrow(apply, WORDS).filter(F.size("ids") > 1)


def counted_pairs(words: DataFrame, rounds: list[tuple[np.ndarray, np.ndarray]], stop: int, allowed: tuple[np.ndarray, np.ndarray] | None) -> DataFrame:
    """code, count over words after the merges of rounds: summed in each batch before they move."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, word = symbols_of(batch)
            for codes, made in rounds:
                x, word = merge(x, word, codes, made, stop)
            code, n = summed_pairs(x, word, batch.column("count").to_numpy(zero_copy_only=False), stop, allowed)
            yield pa.record_batch([pa.array(code), pa.array(n)], names=["code", "count"])

    return words.mapInArrow(scan, "code long, count long").groupBy("code").agg(F.sum("count").alias("count"))


def grow(words: DataFrame, tokens: list[str], target: int, across_spaces: bool = False) -> tuple[list[str], list[tuple[str, str]]]:
    """tokens and more, until there are target of them, and the merges that make them.

    words: ids (places in tokens; any other id, and 0, is never merged), count. across_spaces: only merges whose result has a space
    behind its first character. A round is one job over the distinct words; merges of the last few rounds are applied as words
    are read, and words are written anew every KEEP_ROUNDS rounds.
    """
    tokens, merges, rounds = list(tokens), [], []
    ids = {t: i for i, t in enumerate(tokens)}
    known = lambda i: F.when((i > 0) & (i < len(ids)), i).otherwise(F.lit(target)).cast("int")
    words = dealt_words(words.select(F.transform("ids", known).alias("ids"), "count"))
    behind, anywhere = np.zeros(target + 1, bool), np.zeros(target + 1, bool)
    spaced = 0
    while len(tokens) < target:
        for i in range(spaced, len(tokens)):
            behind[i], anywhere[i] = "▁" in tokens[i][1:], "▁" in tokens[i]
        spaced = len(tokens)
        found = counted_pairs(words, rounds, target, (behind, anywhere) if across_spaces else None)
        top = found.orderBy(F.desc("count"), "code").limit(FETCH).collect()  # codes order as (left, right)
        if not top:
            raise ValueError(f"only {len(tokens)} of {target} trained entries can be made from this text")
        new = batch([(tokens[r.code >> SHIFT], tokens[r.code & LOW]) for r in top], ids, target - len(tokens))
        made = {}
        for a, b in new:
            code = ids[a] << SHIFT | ids[b]
            merges.append((a, b))
            if a + b not in ids:
                ids[a + b] = len(tokens)
                tokens.append(a + b)
            made[code] = ids[a + b]
        rounds.append((np.array(sorted(made), np.int64), np.array([made[c] for c in sorted(made)], np.int64)))
        if len(rounds) == KEEP_ROUNDS:
            words, rounds = materialize(advance(words, rounds, target), "words"), []
    return tokens, merges


def with_bytes(tokens: list[str]) -> list[str]:
    more = [f"<0x{b:02X}>" for b in range(256)]
    if set(more) & set(tokens):
        raise ValueError("a trained entry looks like a byte token")
    return tokens + more


def byte_fallback_vocab(spark, first_id: int) -> DataFrame:
    return spark.range(256).select((F.col("id") + first_id).cast("int").alias("id"), F.format_string("<0x%02X>", F.col("id")).alias("token"), F.lit("byte").alias("kind"))


def vocab_frame(spark, v: Vocabulary) -> DataFrame:
    kind = F.when(F.col("token") == UNK, "special").when(F.col("token").rlike("^<0x[0-9A-F]{2}>$"), "byte").otherwise("merge")
    return spark.createDataFrame(list(enumerate(v.tokens)), "id int, token string").withColumn("kind", kind)


def merges_frame(spark, v: Vocabulary) -> DataFrame:
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(v.merges)], "rank int, left string, right string")


def vocab_table(vocab: DataFrame, merges: DataFrame) -> DataFrame:
    """id, text, kind, hex, left, right: the parents are the last merge that makes the token."""
    parents = merges.groupBy(F.concat("left", "right").alias("token")).agg(F.max_by(F.struct("left", "right"), "rank").alias("p"))
    return vocab.join(parents, "token", "left").select("id", F.col("token").alias("text"), "kind", F.hex(F.encode("token", "UTF-8")).alias("hex"), F.col("p.left").alias("left"), F.col("p.right").alias("right"))


def vocab_search(found: DataFrame, term: str, page: int = 0, size: int = 50) -> DataFrame:
    """id, text, kind, hex, total, page: one page (clamped) of the entries that contain the term."""
    hits = found.filter(F.contains(F.lower(F.concat_ws(" ", F.col("id").cast("string"), "kind", "text", "hex")), F.lit(term.lower())))
    total = hits.count()
    page = max(0, min(page, -(-total // size) - 1))
    return hits.orderBy("id").offset(page * size).limit(size).select("id", "text", "kind", "hex", F.lit(total).cast("long").alias("total"), F.lit(page).alias("page"))


def vocab_composition(vocab: DataFrame) -> DataFrame:
    return vocab.groupBy("kind").agg(F.count(F.lit(1)).alias("entries"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


def tune_weights(counts: DataFrame, weights: dict[str, float], ratios_of, vocab_size: int, rounds: int = 3, first: Vocabulary | None = None) -> tuple[dict[str, float], list[float]]:
    """Weights that bring languages nearer to equal tokens per unit, and the spread of ratios of each round; counts are weighed anew, never recounted.

    Each round goes on from the best weights so far, by the square of what a language's ratio is above or below the mean; a round that makes the spread no smaller halves that exponent.
    Weights are multiples of 1 / FINE. first: the vocabulary of the given weights, if it is there already. ratios_of: ratio by language of a vocabulary; languages without one take no part.
    """
    best = current = {k: max(1, round(w * FINE)) for k, w in weights.items()}
    spreads, power, seen = [], 2.0, {}
    for i in range(rounds):
        v = first if first and not i else train(weigh(counts, current, FINE), vocab_size, strict=False)
        ratios = {k: r for k, r in ratios_of(v).items() if r}
        spreads.append(max(ratios.values(), default=0.0) - min(ratios.values(), default=0.0))
        if i and spreads[-1] >= min(spreads[:-1]):
            power /= 2
        else:
            best, seen = current, ratios
        mean = sum(seen.values()) / max(len(seen), 1)
        current = {k: max(1, round(w * (seen.get(k, mean) / mean) ** power)) if mean else w for k, w in best.items()}
    return {k: w / FINE for k, w in best.items()}, spreads


SENTENCE = "[^.!?\n]+[.!?\n]*|[.!?\n]+"


def sentence_counts(docs: DataFrame, min_prose: float = 0.6) -> DataFrame:
    """piece, count: sentences of prose, spaces as ▁. Prose: lines whose letters are at least min_prose of the visible characters."""
    rows = docs.select(F.explode(lines(F.col("text"))).alias("line"))
    letters = F.regexp_count("line", F.lit(r"\p{L}")) / F.greatest(F.regexp_count("line", F.lit(r"[^\s]")), F.lit(1))
    pieces = rows.filter(letters >= min_prose).select(F.explode(F.regexp_extract_all(F.replace("line", F.lit(" "), F.lit("▁")), F.lit(SENTENCE), 0)).alias("piece"))
    return pieces.groupBy("piece").agg(F.count(F.lit(1)).alias("count"))
