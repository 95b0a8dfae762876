"""Licences of documents, found by similarity to canonical notices: years, names, spellings and versions are normalised first, so that a changed notice is found.

A licence is named (a short phrase of normalised words) or granted (most of the different words of a longer notice, within three lines). Lines without any word that a notice has are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Licences, whether they are permissive or public domain, names after normalisation, and what a grant says.
LICENCES = {
    "Apache-2.0": True, "MIT": True, "BSD": True, "MPL-2.0": True, "CC0-1.0": True, "CC-BY-4.0": True, "CC-BY-SA-4.0": True, "public-domain": True,
    "GPL-2.0": False, "GPL-3.0": False, "LGPL": False, "AGPL-3.0": False, "CC-BY-ND-4.0": False, "CC-BY-NC-4.0": False, "CC-BY-NC-SA-4.0": False, "CC-BY-NC-ND-4.0": False, "all-rights-reserved": False,
}
NAMES = [
    ("apache license 2", "Apache-2.0"), ("mit license", "MIT"), ("bsd license", "BSD"), ("bsd 2 clause", "BSD"), ("bsd 3 clause", "BSD"), ("mozilla public license 2", "MPL-2.0"), ("cc0", "CC0-1.0"), ("cc zero", "CC0-1.0"),
    ("cc by 4", "CC-BY-4.0"), ("cc by sa 4", "CC-BY-SA-4.0"), ("public domain dedication", "public-domain"), ("released into public domain", "public-domain"), ("gnu general public license 2", "GPL-2.0"), ("gpl 2", "GPL-2.0"), ("gplv2", "GPL-2.0"),
    ("gnu general public license 3", "GPL-3.0"), ("gpl 3", "GPL-3.0"), ("gplv3", "GPL-3.0"), ("gnu lesser general public license", "LGPL"), ("lgpl", "LGPL"), ("gnu affero general public license", "AGPL-3.0"), ("agpl", "AGPL-3.0"),
    ("cc by nd 4", "CC-BY-ND-4.0"), ("cc by nc 4", "CC-BY-NC-4.0"), ("cc by nc sa 4", "CC-BY-NC-SA-4.0"), ("cc by nc nd 4", "CC-BY-NC-ND-4.0"), ("all rights reserved", "all-rights-reserved"),
]
GRANTS = [
    ("MIT", "permission hereby granted free charge any person obtaining copy software associated documentation files deal without restriction"),
    ("BSD", "redistribution use source binary forms with without modification permitted provided following conditions met"),
    ("Apache-2.0", "may not use this file except compliance with license obtain copy license at apache"),
    ("GPL-3.0", "program free software redistribute it modify under terms gnu general public license published free software foundation either 3"),
]
LINE = r"(?i)licen[cs]e|creative commons|\bcc[ -]?(?:by|0|zero)|\b[al]?gpl|public domain|rights reserved|permission|redistribut"
SPELLINGS = [
    (r"licen[cs]e[sd]?", "license"), (r"creative commons", "cc"), (r"attribution", "by"), (r"non[- ]?commercial", "nc"), (r"no[- ]?deriv(?:ative)?s", "nd"), (r"share[- ]?alike", "sa"),
    (r"\b(?:version|v)[. ]{0,2}([0-9])", r"$1"), (r"([0-9])\.0\b", r"$1"), (r"\b(?:19|20)[0-9][0-9]\b", " "), (r"[^a-z0-9]+", " "),
]
STOP = ["the", "of", "and", "a", "an", "or", "to", "in", "is", "as", "by the", "copyright", "c"]
WINDOW, MISSED = 3, 6  # lines a grant is sought in; of so many words one can be missing


def normalised(x: Column) -> Column:
    """Words of a notice, a blank around each."""
    x = F.lower(x)
    for pattern, to in SPELLINGS:
        x = F.regexp_replace(x, pattern, to)
    words = F.filter(F.split(F.trim(x), " "), lambda w: ~w.isin(STOP))
    return F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))


def rights_filter(docs: DataFrame) -> DataFrame:
    """doc_id, licence, similarity (share of the notice's words), allowed, reason. Of several licences a refused one decides, then the longest notice, then the name. A document without a notice
    stays, marked unresolved (similarity 0).
    """
    lines = F.split("text", "\n")
    near = F.transform(lines, lambda _, i: F.array_join(F.slice(lines, i + 1, WINDOW), " "))
    rows = docs.select("doc_id", F.explode(F.filter(F.zip_with(lines, near, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda s: s["a"].rlike(LINE))).alias("s"))
    rows = rows.select("doc_id", normalised(F.col("s.a")).alias("line"), F.array_distinct(F.split(F.trim(normalised(F.col("s.b"))), " ")).alias("words"))
    named = [F.when(F.contains("line", F.lit(f" {p} ")), F.struct(F.lit(not LICENCES[k]).alias("refused"), F.lit(len(p.split())).alias("n"), F.lit(k).alias("licence"), F.lit(1.0).alias("similarity"))) for p, k in NAMES]
    granted = []
    for k, notice in GRANTS:
        own = sorted(set(notice.split()))
        share = F.size(F.array_intersect("words", F.array(*map(F.lit, own)))) / len(own)
        granted.append(F.when(share * len(own) >= len(own) - len(own) // MISSED, F.struct(F.lit(not LICENCES[k]).alias("refused"), F.lit(len(own)).alias("n"), F.lit(k).alias("licence"), share.alias("similarity"))))
    best = rows.select("doc_id", F.greatest(*named, *granted).alias("m")).groupBy("doc_id").agg(F.max("m").alias("m"))
    found = docs.select("doc_id").join(best, "doc_id", "left")
    licence, allowed = F.coalesce("m.licence", F.lit("unresolved")), ~F.coalesce("m.refused", F.lit(False))
    return found.select("doc_id", licence.alias("licence"), F.round(F.coalesce("m.similarity", F.lit(0.0)), 6).alias("similarity"), allowed.alias("allowed"), F.when(~allowed, F.lit("licence")).alias("reason"))


def rights_shares(rights: DataFrame) -> DataFrame:
    """licence, allowed, n, share of all documents: the unresolved ones too."""
    counts = rights.groupBy("licence", "allowed").agg(F.count(F.lit(1)).alias("n"))
    whole = counts.agg(F.sum("n").alias("all"))
    return counts.crossJoin(F.broadcast(whole)).select("licence", "allowed", "n", F.round(F.col("n") / F.col("all"), 9).alias("share"))  # one row on the right
