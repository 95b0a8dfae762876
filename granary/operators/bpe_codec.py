"""Encoding and decoding with a shared BPE vocabulary, in Arrow batches.

Only the per-piece merge loop is Python, and distinct pieces are remembered by each worker; counting, exploding and comparing are DataFrame work.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.text import faithful_units, sliced_sizes, split_pieces, visible_text, word_count
from granary.operators.bpe_train import UNK, Vocabulary, grow, sentence_counts, vocab_frame, with_bytes
from granary.sources.tables import materialize

REMEMBERED, KEPT = 200_000, 50_000
SLICE, LONG = 1 << 21, 64  # characters of texts that are coded together; longest piece that goes through the merges with others
PIECE, BYTE = re.compile("▁[^▁]*|[^▁]+"), re.compile(r"<0x([0-9A-F]{2})>")


class Codec:
    def __init__(self, v: Vocabulary):
        self.tokens, self.ids = v.tokens, v.ids
        self.ranks = {p: i for i, p in reversed(list(enumerate(v.merges)))}
        self.known: dict[str, list[int]] = {}

    def piece(self, text: str) -> list[int]:
        """Lowest-rank merge first, leftmost among equals: a heap over neighbours in a linked list, so long pieces stay near-linear."""
        symbols: list[str] = []
        for c in text:
            symbols += [c] if c in self.ids else [f"<0x{b:02X}>" for b in c.encode("utf-8", "surrogatepass")]
        after, before = list(range(1, len(symbols))) + [-1], list(range(-1, len(symbols) - 1))
        heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(len(symbols) - 1) if (r := self.ranks.get((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(heap)
        gone = [False] * len(symbols)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j < 0 or symbols[i] != a or symbols[j] != b:
                continue
            symbols[i], gone[j], after[i] = a + b, True, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (r := self.ranks.get((symbols[x], symbols[y]))) is not None:
                    heapq.heappush(heap, (r, x, symbols[x], symbols[y]))
        unknown = self.ids[UNK]
        return [self.ids.get(s, unknown) for s, g in zip(symbols, gone) if not g]

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for p in PIECE.findall(text.replace(" ", "▁")):
            found = self.known.get(p)
            if found is None:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                found = self.known[p] = self.piece(p)
            out += found
        return out

    def decode(self, ids: list[int]) -> str:
        """Neighbouring byte tokens are decoded together; bytes that are no UTF-8 become replacement characters."""
        out, waiting = [], bytearray()
        for i in ids:
            t = self.tokens[i]
            if m := BYTE.fullmatch(t):
                waiting.append(int(m[1], 16))
                continue
            if waiting:
                out.append(waiting.decode("utf-8", "replace"))
                waiting.clear()
            out.append(t)
        return "".join([*out, waiting.decode("utf-8", "replace")]).replace("▁", " ")


class Batches(Codec):
    """Codes many texts at once: distinct pieces have numbers, those not met before go through the merges together.

    No merge goes on behind the end of a line where no entry that ends with one is the left part of a merge: then pieces are cut at line ends as well, as there are fewer distinct ones.
    """

    def __init__(self, v: Vocabulary):
        super().__init__(v)
        self.line_ends = not any(a.endswith("\n") for a, _ in v.merges)
        self.n = len(self.tokens)
        self.plain = all(a in self.ids and b in self.ids and a + b in self.ids for a, b in v.merges)  # else symbols are no ids
        ranked = sorted((self.ids[a] * self.n + self.ids[b], r) for (a, b), r in self.ranks.items()) if self.plain else []
        self.codes, self.rank = np.array([c for c, _ in ranked] or [-1], np.int64), np.array([r for _, r in ranked] or [0], np.int64)
        self.made = np.array([self.ids[a + b] for a, b in v.merges] if self.plain else [], np.int64)
        self.none = len(v.merges)
        self.of_char = np.full(0x110000, -1, np.int32)
        for t, i in self.ids.items():
            if len(t) == 1:
                self.of_char[ord(t)] = i
        self.numbers, self.flat, self.sizes = {"": 0}, [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]

    def forget(self) -> None:
        """All but the KEPT pieces that were met first, common ones among them."""
        self.numbers = dict(islice(self.numbers.items(), KEPT))
        self.sizes = [self.sizes[0][:KEPT].copy()]
        self.flat = [self.flat[0][: self.sizes[0].sum()].copy()]

    def ranks_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        code = a * self.n + b
        place = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[place] == code, self.rank[place], self.none)

    def merged(self, x: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of words (sizes of one or more) after all merges, and how many are left of each: each round merges the leftmost pair of lowest rank in every word."""
        word = np.repeat(np.arange(len(sizes)), sizes)
        rank = np.full(len(x), self.none)
        inside = np.nonzero(word[:-1] == word[1:])[0]
        rank[inside] = self.ranks_of(x[inside], x[inside + 1])
        done, left = [(x[:0], word[:0])], np.zeros(len(sizes), np.int64)
        while len(x):
            best = np.minimum.reduceat(rank << 32 | np.arange(len(x)), np.cumsum(sizes) - sizes)
            go = best >> 32 < self.none
            keep = np.repeat(go, sizes)
            done.append((x[~keep], word[~keep]))
            at = (np.cumsum(keep) - 1)[best[go] & 0xFFFFFFFF]
            x, word, rank, sizes = x[keep], word[keep], rank[keep], sizes[go] - 1
            if not len(x):
                break
            x[at] = self.made[rank[at]]
            stay = np.ones(len(x), bool)
            stay[at + 1] = False
            x, word, rank = x[stay], word[stay], rank[stay]
            at -= np.arange(len(at))  # each word before has lost a symbol
            rank[at] = self.none
            i = at[(at + 1 < len(x)) & (word[np.minimum(at + 1, len(x) - 1)] == word[at])]
            rank[i] = self.ranks_of(x[i], x[i + 1])
            i = at[(at > 0) & (word[at - 1] == word[at])] - 1
            rank[i] = self.ranks_of(x[i], x[i + 1])
        x, word = (np.concatenate(c) for c in zip(*done))
        left = np.bincount(word, minlength=len(left))
        return x[np.argsort(word, kind="stable")], left

    def learn(self, pieces: list[str]) -> None:
        """Numbers for pieces that have none."""
        for k in range(0, len(pieces), 50_000):
            some = [p.replace(" ", "▁") for p in pieces[k : k + 50_000]]
            sizes = np.array([len(p) for p in some], np.int64)
            x = self.of_char[np.frombuffer("".join(some).encode("utf-32-le", "surrogatepass"), "<u4")].astype(np.int64)
            alone = (sizes > LONG) | (np.minimum.reduceat(x, np.cumsum(sizes) - sizes) < 0) | (not self.plain)
            x, left = self.merged(x[np.repeat(~alone, sizes)], sizes[~alone])
            self.flat.append(x.astype(np.int32))
            self.sizes.append(left)
            order = np.concatenate((np.nonzero(~alone)[0], np.nonzero(alone)[0])).tolist()
            for i in order[len(left) :]:
                ids = np.array(self.piece(some[i]), np.int32)
                self.flat.append(ids)
                self.sizes.append(np.array([len(ids)], np.int64))
            begin = len(self.numbers)
            self.numbers.update(zip([pieces[k + i] for i in order], range(begin, begin + len(order))))
        self.flat, self.sizes = [np.concatenate(self.flat)], [np.concatenate(self.sizes)]

    def numbered(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the pieces of all texts, and how many each text has."""
        if len(self.numbers) > REMEMBERED:
            self.forget()
        pieces, sizes = [], []
        for t in texts:
            own = split_pieces(t, self.line_ends)
            pieces += own
            sizes.append(len(own))
        found = [*map(self.numbers.get, pieces)]
        if None in found:
            self.learn([*dict.fromkeys(p for p, n in zip(pieces, found) if n is None)])
            found = [*map(self.numbers.get, pieces)]
        return np.array(found, np.int64), np.array(sizes, np.int64)

    def slices(self, texts: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(from, to, numbers, pieces a text) for ranges of texts."""
        for a, b in sliced_sizes([len(t) for t in texts], SLICE):
            yield a, b, *self.numbered(texts[a:b])

    def token_counts(self, texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        for a, b, numbers, sizes in self.slices(texts):
            out[a:b] = np.add.reduceat(self.sizes[0][numbers], np.cumsum(sizes) - sizes)
        return out

    def ids_of(self, numbers: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of texts one after the other, and how many each has."""
        n = self.sizes[0][numbers]
        begin = (np.cumsum(self.sizes[0]) - self.sizes[0])[numbers] - (np.cumsum(n) - n)
        return self.flat[0][np.repeat(begin, n) + np.arange(n.sum())], np.add.reduceat(n, np.cumsum(sizes) - sizes)


def encode(docs: DataFrame, v: Vocabulary, text: str = "text") -> DataFrame:
    """docs plus ids array<int>; null text gives no ids."""
    shared = docs.sparkSession.sparkContext.broadcast(v)  # as large as the vocabulary asked for

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = Batches(shared.value)
        for x in batches:
            out = []
            for _, _, numbers, sizes in codec.slices([t or "" for t in x]):
                found, n = codec.ids_of(numbers, sizes)
                out += np.split(found, np.cumsum(n)[:-1])
            yield pd.Series(out, dtype=object)

    return docs.withColumn("ids", ids(text))


def decode(rows: DataFrame, v: Vocabulary, ids: str = "ids") -> DataFrame:
    """rows plus decoded."""
    shared = rows.sparkSession.sparkContext.broadcast(v)

    @F.pandas_udf("string")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = Codec(shared.value)
        for x in batches:
            yield x.map(lambda i: codec.decode(list(i) if i is not None else []))

    return rows.withColumn("decoded", texts(ids))


def parse_token_ids(x: Column, size: int) -> Column:
    """struct(ids, error) from text such as "[1, 2 3]"."""
    body = F.trim(F.regexp_replace(F.regexp_replace(F.trim(x), r"^\[", ""), r"\]$", ""))
    parts = F.split(body, r"\s*,\s*|\s+")
    digits = F.forall(parts, lambda p: p.rlike("^[0-9]+$"))
    numbers = F.transform(parts, lambda p: p.try_cast("int"))
    in_range = F.forall(numbers, lambda n: F.coalesce(n < size, F.lit(False)))
    error = F.when(body == "", F.lit(None)).when(~digits, F.lit("not a list of numbers")).when(~in_range, F.lit("out of range"))
    return F.struct(F.when(body == "", F.array().cast("array<int>")).when(digits & in_range, numbers).alias("ids"), error.alias("error"))


def labels(spark: SparkSession, v: Vocabulary) -> DataFrame:
    """id, kind, label, hex: one row an entry."""
    label = F.when(F.col("kind") == "byte", F.concat(F.lit("byte 0x"), F.substring("token", 4, 2))).otherwise(F.col("token"))
    return vocab_frame(spark, v).select("id", "kind", label.alias("label"), F.hex(F.encode("token", "UTF-8")).alias("hex"))


def encode_tokens(docs: DataFrame, v: Vocabulary) -> DataFrame:
    """doc_id, position, id, kind, label, hex: one row per token."""
    rows = encode(docs, v).select("doc_id", F.posexplode("ids").alias("position", "id"))
    return rows.join(F.broadcast(labels(docs.sparkSession, v)), "id").select("doc_id", "position", "id", "kind", "label", "hex")


def token_usage(docs: DataFrame, v: Vocabulary) -> DataFrame:
    """kind, label, hex, n, documents (different doc_id, null not among them): what encode_tokens comes to by token, summed up by each task.

    Only rows whose doc_id is in several rows hand on what they have apart, a row for each of their tokens.
    """
    several = materialize(docs.groupBy("doc_id").count().filter("count > 1 and doc_id is not null").select("doc_id", F.lit(True).alias("again")), "repeated-ids")
    shared, kind = docs.sparkSession.sparkContext.broadcast(v), docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text").join(several, "doc_id", "left").select("doc_id", F.col("doc_id").isNotNull().alias("named"), "text", F.col("again").isNotNull().alias("again"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, doc_id = Batches(shared.value), None
        n, documents = np.zeros(codec.n, np.int64), np.zeros(codec.n, np.int64)
        given = lambda ids, n, documents, docs: pa.record_batch([pa.array(ids, pa.int32()), pa.array(n, pa.int64()), pa.array(documents, pa.int64()), docs], names=["id", "n", "documents", "doc_id"])
        for batch in batches:
            doc_id, texts = batch.column("doc_id"), [t or "" for t in batch.column("text").to_pylist()]
            named, again = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("named", "again"))
            for a, b, numbers, sizes in codec.slices(texts):
                ids, size = codec.ids_of(numbers, sizes)
                at = np.concatenate(([0], np.cumsum(size)))
                for c in range(0, b - a, 128):
                    d = min(c + 128, b - a)
                    own = ids[at[c] : at[d]]
                    has = np.zeros((d - c, codec.n), bool)
                    has[np.repeat(np.arange(d - c), size[c:d]), own] = True
                    n += np.bincount(own, minlength=codec.n)
                    documents += has[(named & ~again)[a + c : a + d]].sum(axis=0)
                    if again[a + c : a + d].any():
                        p, q = np.nonzero(has & again[a + c : a + d, None])
                        yield given(q, np.zeros(len(q)), np.zeros(len(q)), doc_id.take(pa.array(p + a + c)))
        if doc_id is not None:
            used = np.nonzero(n)[0]
            yield given(used, n[used], documents[used], pa.nulls(len(used), doc_id.type))

    found = rows.mapInArrow(scan, f"id int, n long, documents long, doc_id {kind}").groupBy("id", "doc_id").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))
    found = found.groupBy("id").agg(F.sum("n").alias("n"), (F.sum("documents") + F.count("doc_id")).alias("documents"))
    return found.join(F.broadcast(labels(docs.sparkSession, v)), "id").select("kind", "label", "hex", "n", "documents")


def playground_stats(docs: DataFrame, v: Vocabulary) -> DataFrame:
    """doc_id, tokens, words, units, tokens_per_unit (0 without units)."""
    rows = encode(docs, v).select("doc_id", F.size("ids").cast("long").alias("tokens"), word_count(F.col("text")).alias("words"), faithful_units(F.col("text")).alias("units"))
    return rows.withColumn("tokens_per_unit", F.coalesce(F.try_divide("tokens", "units"), F.lit(0.0)))


def roundtrip(docs: DataFrame, v: Vocabulary) -> DataFrame:
    """doc_id, lang, exact, visible_equal, ids_in_range: texts are encoded, decoded and compared in one pass of batches; only texts that differ come back. Null counts as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(v)

    @F.pandas_udf("differs boolean, decoded string, ids_in_range boolean")
    def check(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = Codec(shared.value)
        size = len(codec.tokens)
        for x in batches:
            found = []
            for t in x:
                ids = codec.encode(t or "")
                back = codec.decode(ids)
                same = back == (t or "")
                found.append((not same, None if same else back, not ids or (min(ids) >= 0 and max(ids) < size)))
            yield pd.DataFrame(found, columns=["differs", "decoded", "ids_in_range"])

    rows = materialize(docs.select("doc_id", "lang", "text", check("text").alias("c")).select("doc_id", "lang", F.when(F.col("c.differs"), F.col("text")).alias("text"), "c.*"), "roundtrip")
    seen = ~F.col("differs") | (visible_text(F.col("decoded")) == visible_text(F.coalesce("text", F.lit(""))))
    return rows.select("doc_id", "lang", (~F.col("differs")).alias("exact"), seen.alias("visible_equal"), "ids_in_range")


def roundtrip_failures(rows: DataFrame) -> DataFrame:
    """doc_id, lang, failure: one row for each check that a text of roundtrip did not pass."""
    checks = F.array(*(F.when(~F.col(c), F.lit(c)) for c in ("exact", "visible_equal", "ids_in_range")))
    return rows.select("doc_id", "lang", F.explode(F.array_compact(checks)).alias("failure"))


def unknown_tokens(docs: DataFrame, v: Vocabulary) -> DataFrame:
    unk = v.ids[UNK]
    return encode(docs, v).groupBy("lang").agg(F.sum(F.size(F.filter("ids", lambda i: i == unk))).alias("unknown"))


def superword_train(docs: DataFrame, v: Vocabulary, more: int) -> tuple[Vocabulary, list[tuple[str, str]]]:
    """The second stage: v grown by `more` entries that cross a space, and the merges that make them.

    Sentences of prose are encoded by v and its tokens merged on, so v's trained ids stay as they are (byte entries move behind the new ones); no merge crosses the end of a sentence.
    """
    trained = v.tokens[:-256]
    grown, merges = grow(encode(sentence_counts(docs), v, "piece"), trained, len(trained) + more, across_spaces=True)
    return Vocabulary(with_bytes(grown), [*v.merges, *merges]), merges
