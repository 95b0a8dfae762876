"""Smaller vocabularies out of a larger one.

Training for fewer entries takes the same merges and only ends earlier, so the first merges of a vocabulary are the vocabulary of that size: one training serves
every size, and texts are encoded for all sizes in one pass. Sizes are numbers of merges; 0 is the alphabet with its bytes.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from granary.functions.text import faithful_units, word_count
from granary.operators.bpe_train import SHIFT, UNK, Vocabulary, merge, with_bytes

CHUNK = 500_000  # characters that are merged together


def nested(v: Vocabulary, merges: int) -> Vocabulary:
    """v as training would have left it after its first merges; not complete if it has fewer."""
    made = dict.fromkeys(a + b for a, b in v.merges[:merges])  # a string that is made twice is one entry
    first = [t for t in v.tokens[:-256] if t == UNK or len(t) == 1]
    return Vocabulary(with_bytes([*first, *made]), v.merges[:merges], len(v.merges) >= merges)


def rounds(merges: list[tuple[str, str]], ids: dict[str, int], ends: set[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray, bool]]:
    """Merges in order, as many together as do not touch each other's symbols: rank of the first, pairs as sorted codes, what they become, whether the string was there before. No round crosses a rank in ends."""
    found, lefts, rights, seen, begin = {}, set(), set(), {t for t in ids if len(t) == 1}, 0
    for r, (a, b) in enumerate([*merges, ("", "")]):
        again = a + b in seen
        if found and (r == len(merges) or r in ends or again or a == b or alone or a in rights or b in lefts):
            codes = sorted(found)
            yield begin, np.array(codes, np.int64), np.array([found[c] for c in codes], np.int64), twice
            found, lefts, rights = {}, set(), set()
        if r < len(merges):
            begin = begin if found else r
            found[ids[a] << SHIFT | ids[b]] = ids[a + b]
            alone, twice = again or a == b, again
            # what a round makes is no part of another of its pairs
            lefts |= {a, a + b}
            rights |= {b, a + b}
            seen.add(a + b)


def chunks(texts: pd.Series, most: int) -> Iterator[list[tuple[int, str]]]:
    """(place of the text, part of it) in lists of about `most` characters; texts are cut only where a piece begins."""
    out, size = [], 0
    for i, t in enumerate(texts):
        t, at = (t or "").replace(" ", "▁"), 0
        while at < len(t):
            end = len(t)
            if end - at > most:
                end = t.rfind("▁", at + 1, at + most)
                end = end if end > 0 else t.find("▁", at + most)
                end = end if end > 0 else len(t)
            out.append((i, t[at:end]))
            size, at = size + end - at, end
            if size >= most:
                yield out
                out, size = [], 0
    if out:
        yield out


class Sizes:
    """Counts tokens at several sizes: lowest rank first, a vocabulary of m merges has done all it can when only ranks from m on are left, so one pass serves all."""

    def __init__(self, v: Vocabulary, sizes: Sequence[int]):
        self.sizes = sorted(set(sizes))
        whole = nested(v, self.sizes[-1])
        self.known, self.places, self.stop = set(whole.tokens), [self.sizes.index(m) for m in sizes], len(whole.tokens)
        self.ranks = {p: i for i, p in reversed(list(enumerate(whole.merges)))}
        ids = whole.ids
        self.chars = np.array(sorted(ord(t) for t in ids if len(t) == 1) or [0x110000], np.int64)
        self.char_ids = np.array([ids.get(chr(c), self.stop) if c < 0x110000 else self.stop for c in self.chars], np.int64)
        self.rounds = list(rounds(whole.merges, ids, set(self.sizes)))

    def texts(self, parts: list[tuple[int, str]], n: int) -> np.ndarray:
        """For each of n texts its tokens at each size, then byte tokens; parts: what chunks gives.

        All pieces go through the merges together, rank by rank. A string that is made a second time can bring an earlier rank up again: pieces in which that happens are counted one by one.
        """
        code = np.frombuffer("".join(t for _, t in parts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        sizes = np.array([len(t) for _, t in parts])
        start = code == ord("▁")
        start[np.cumsum(sizes) - sizes] = True
        first, word = np.nonzero(start)[0], np.cumsum(start) - 1
        text = np.repeat([i for i, _ in parts], sizes)[first]
        place = np.minimum(np.searchsorted(self.chars, code), len(self.chars) - 1)
        known = self.chars[place] == code
        x = np.where(known, self.char_ids[place], self.stop)
        n_bytes = np.bincount(word, np.where(known, 0, 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)), len(first))
        more = n_bytes - np.bincount(word, ~known, len(first))
        per, redo = [], np.zeros(len(first), bool)
        for rank, codes, made, twice in self.rounds:
            while self.sizes[len(per)] <= rank:
                per.append(np.bincount(word, minlength=len(first)) + more)
            before = np.bincount(word, minlength=len(first)) if twice else None
            x, word = merge(x, word, codes, made, self.stop)
            if twice:
                redo |= np.bincount(word, minlength=len(first)) < before
        while len(per) < len(self.sizes):
            per.append(np.bincount(word, minlength=len(first)) + more)
        per = np.array([*(per[k] for k in self.places), n_bytes])
        end = np.append(first[1:], len(code))
        for w in np.nonzero(redo)[0]:
            per[:, w] = self.piece("".join(map(chr, code[first[w] : end[w]])))
        return np.array([np.bincount(text, k, n) for k in per]).T.astype(np.int64)

    def piece(self, text: str) -> list[int]:
        """Tokens at each size, then byte tokens. A merge leaves its string at the place of its first symbol."""
        symbols, n_bytes = list(text), 0
        if not self.known.issuperset(symbols):
            symbols = [x for c in text for x in ([c] if c in self.known else [f"<0x{b:02X}>" for b in c.encode("utf-8", "surrogatepass")])]
            n_bytes = sum(len(x) > 1 for x in symbols)
        rank, size = self.ranks.get, len(symbols)
        heap = [(r, i, i + 1) for i, p in enumerate(zip(symbols, symbols[1:])) if (r := rank(p)) is not None]
        heapq.heapify(heap)
        after, before, left = list(range(1, size + 1)), list(range(-1, size - 1)), size
        counts, waiting = [], 0
        while heap:
            r, i, j = heapq.heappop(heap)
            if symbols[i] is None or j >= size or after[i] != j or rank((symbols[i], symbols[j])) != r:
                continue  # one of the two has been merged meanwhile
            while self.sizes[waiting] <= r:
                counts.append(left)
                waiting += 1
            symbols[i], symbols[j], after[i], left = symbols[i] + symbols[j], None, after[j], left - 1
            if after[i] < size:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < size and (r := rank((symbols[x], symbols[y]))) is not None:
                    heapq.heappush(heap, (r, x, y))
        counts += [left] * (len(self.sizes) - len(counts))
        return [*(counts[k] for k in self.places), n_bytes]


def token_counts(docs: DataFrame, v: Vocabulary, sizes: Sequence[int]) -> DataFrame:
    """docs plus merges, tokens, byte_tokens: one row for each text and size. Null text has no tokens."""
    shared = docs.sparkSession.sparkContext.broadcast((nested(v, max(sizes)), tuple(sizes)))  # as large as the vocabulary asked for

    @F.pandas_udf("array<long>")
    def counts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        at = Sizes(*shared.value)
        for x in batches:
            total = np.zeros((len(x), len(sizes) + 1), np.int64)
            for parts in chunks(x, CHUNK):
                total += at.texts(parts, len(x))
            yield pd.Series(list(total))

    rows = docs.withColumn("_n", counts("text"))
    each = F.array(*(F.struct(F.lit(m).alias("merges"), F.get("_n", F.lit(i)).alias("tokens"), F.get("_n", F.lit(len(sizes))).alias("byte_tokens")) for i, m in enumerate(sizes)))
    return rows.select(*(c for c in docs.columns), F.inline(each))


def sums_by_size(docs: DataFrame, v: Vocabulary, sizes: Sequence[int]) -> DataFrame:
    """merges, lang, tokens, byte_tokens, units, words, bytes: one row a size and language."""
    measures = {"units": faithful_units(F.col("text")), "words": word_count(F.col("text")), "bytes": F.octet_length("text").cast("long")}
    rows = token_counts(docs.select("lang", "text").withColumns(measures), v, sizes)
    return rows.groupBy("merges", "lang").agg(*(F.sum(c).alias(c) for c in ("tokens", "byte_tokens", "units", "words", "bytes")))


def fertility_by_size(sums: DataFrame, base: str = "en") -> DataFrame:
    """merges, lang, mean tokens a word, bytes_per_token, relative to the base language at that size (null without it), byte_share."""
    rows = sums.select("merges", "lang", F.try_divide("tokens", "words").alias("mean"), F.try_divide("bytes", "tokens").alias("bytes_per_token"), F.try_divide("byte_tokens", "tokens").alias("byte_share"))
    at = F.max(F.when(F.col("lang") == base, F.col("mean"))).over(Window.partitionBy("merges"))  # one row a language
    return rows.withColumn("relative", F.try_divide(F.col("mean"), at))


def smallest_passing(ratios: DataFrame, gate: float) -> DataFrame:
    """lang, merges: the smallest of the sizes in ratios (merges, lang, ratio) from which on all larger ones pass the gate as well; null where the largest does not."""
    fails = F.max(F.when(F.coalesce(F.col("ratio") > gate, F.lit(True)), F.col("merges")))
    last = ratios.groupBy(F.col("lang").alias("l")).agg(F.coalesce(fails, F.lit(-1)).alias("last"))
    both = ratios.join(last, F.col("lang").eqNullSafe(F.col("l")))
    return both.groupBy("lang").agg(F.min(F.when(F.col("merges") > F.col("last"), F.col("merges"))).alias("merges"))
