"""File forms of a vocabulary and of the statistics report."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.operators.bpe_train import UNK, Vocabulary


def merge_pair(entry: object) -> tuple[str, str]:
    """One entry of a merge list, written as two strings or as one string with a blank between the sides; a side is never empty."""
    if isinstance(entry, str):
        left, blank, right = entry.partition(" ")
        sides = [left, right] if blank and " " not in right else []
    else:
        sides = list(entry) if isinstance(entry, (list, tuple)) else []
    if len(sides) != 2 or not all(isinstance(x, str) and x for x in sides):
        raise ValueError(f"not a merge: {entry!r}")
    return sides[0], sides[1]


def tokenizer_json(v: Vocabulary) -> str:
    """The tokenizers-JSON form that public libraries load."""
    metaspace = {"type": "Metaspace", "replacement": "▁", "prepend_scheme": "never", "split": True}
    return json.dumps({
        "version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None, "pre_tokenizer": metaspace, "post_processor": None,
        "decoder": {"type": "Sequence", "decoders": [{"type": "ByteFallback"}, metaspace]},
        "model": {"type": "BPE", "dropout": None, "unk_token": UNK, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": True, "ignore_merges": False, "vocab": v.ids, "merges": [list(m) for m in v.merges]},
    }, ensure_ascii=False)


def tokenizer_from_json(text: str) -> Vocabulary:
    model = json.loads(text)["model"]
    tokens = sorted(model["vocab"], key=model["vocab"].get)
    if sorted(model["vocab"].values()) != list(range(len(tokens))):
        raise ValueError("ids are not 0..V-1")
    return Vocabulary(tokens, [merge_pair(m) for m in model["merges"]])


def stats_report(ratios: DataFrame, v: Vocabulary, weights: dict[str, int]) -> DataFrame:
    """One row: the nested report as JSON, languages by ratio ascending."""
    rows = F.sort_array(F.collect_list(F.struct("ratio", "lang", "tokens", "units")))  # one entry a language
    facts = F.struct(F.lit(len(v.tokens)).alias("vocabulary"), F.lit(256).alias("byte_entries"), F.lit(len(v.merges)).alias("merges"), F.lit(v.complete).alias("complete"), F.create_map(*(F.lit(x) for kv in weights.items() for x in kv)).alias("weights"))
    return ratios.agg(rows.alias("languages"), (F.max("ratio") - F.min("ratio")).alias("spread")).select(F.to_json(F.struct(facts.alias("tokenizer"), "spread", "languages")).alias("report"))
