"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

Targets: the budget is shared by weight; a source above its cap (max_epochs times its size) is clamped there and its
excess goes to the others by weight, until none is above. Repetitions: every document of a source is taken
floor(target / size) times whole; what is missing is taken in the order of a seeded hash, the last document in part (its
first words), so that a source's taken words equal its rounded target.

The running sums never gather a source in one task: words are summed by (source, upper hash bits) first, and only in the one
cell in which a source's remainder ends are documents ordered, as groups of equal doc_id and size. Of the one group in which it ends rows are numbered task by task,
so any number of rows can share a doc_id, or have none.

Defined results: null text has size 0 and takes 0; a null source is a source of its own, last in order; documents with the same doc_id and
size are interchangeable, repeated rows take part each; sources of size 0 have target 0; other columns of the input are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from granary.llm.common import WORD, materialize, row_ids

WEIGHTS, BUDGET, MAX_EPOCHS, SEED, CELLS = (3, 1, 2), 1.5, 2, "mix-1", 4096


def unit_hash(seed: str):
    """32 bits from md5 of doc_id and seed; the same in other SQL engines."""
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(seed))), 1, 8), 16, 10).cast("long")


def sized(docs: DataFrame, seed: str = SEED, key: str | None = None) -> DataFrame:
    """row_id, doc_id, source, size, u, and where the row is: part (its task), place (in order within it)."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(row_ids(docs, key).alias("row_id"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), unit_hash(seed).alias("u"))


def ranked_sources(sizes: DataFrame) -> DataFrame:
    """source, source_size, rank from 0 by code point, null last. Ranks come from range partitions and their counts, so the sources never meet in one task."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    last = F.col("source").isNull()
    parts = materialize(totals.withColumn("last", last).repartitionByRange("last", "source").withColumn("part", F.spark_partition_id()), "sources")
    within = parts.withColumn("in_part", F.row_number().over(Window.partitionBy("part").orderBy("last", "source")) - 1)
    counts = parts.groupBy("part").count()
    # one row per range partition, not per source
    before = counts.withColumn("before", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return within.join(before.select("part", "before"), "part").select("source", "source_size", (F.col("before") + F.col("in_part")).alias("rank"))


def water_fill(sources: DataFrame, budget: float, max_epochs: int) -> DataFrame:
    """sources (source, source_size, weight) plus target. Each round moves only three sums to the driver."""
    sources = materialize(sources.withColumn("cap", F.col("source_size") * max_epochs), "weights")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    twice = int(total * budget * 2)  # halves of words, so that sums stay whole numbers
    clamped = F.col("cap") <= 0
    while True:
        row = sources.agg(
            F.sum(F.when(clamped, F.col("cap")).otherwise(0)).alias("held"),
            F.sum(F.when(clamped, 0).otherwise(F.col("weight"))).alias("weight"),
            F.count(F.when(clamped, 1)).alias("n"),
        ).first()
        left, weight = twice - 2 * int(row.held or 0), int(row.weight or 0)
        if not weight:
            break
        above = clamped | (F.col("weight") * F.lit(left) > F.col("cap") * F.lit(2 * weight))
        if sources.agg(F.count(F.when(above, 1))).first()[0] == row.n:
            break
        clamped = above
    share = (F.col("weight") * F.lit(left)).cast("double") / F.lit(float(2 * max(weight, 1)))
    return sources.withColumn("target", F.when(clamped, F.col("cap").cast("double")).otherwise(share)).drop("cap")


def edge_extras(rows: DataFrame) -> DataFrame:
    """rows of one cell a source (s, left: words the fraction takes of the cell, u, id_key, doc_id, size, part, place) plus extra: left is spent in the order u, doc_id, size."""
    same = ["s", "u", "id_key", "size"]
    groups = rows.groupBy(*same).agg(F.count(F.lit(1)).alias("n"), F.first("doc_id").alias("d"), F.first("left").alias("left"))
    before = F.sum(F.col("n") * F.col("size")).over(Window.partitionBy("s").orderBy("u", "d", "size").rowsBetween(Window.unboundedPreceding, -1))
    rest = F.col("left") - F.coalesce(before, F.lit(0))
    state = F.when(rest >= F.col("n") * F.col("size"), "all").when(rest <= 0, "none").otherwise("some")
    # a table of its own, so that the planner can split the rows of a large group in the join
    groups = materialize(groups.withColumn("spend", rest).withColumn("take", state).select(*same, "spend", "take"), "edge-groups")
    rows = rows.drop("left").join(groups, same)
    some = materialize(rows.filter("take = 'some'"), "edge-some")  # at most one group a source
    counts = some.groupBy("s", "part").agg(F.count(F.lit(1)).alias("n"))
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("s").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    some = some.join(counts.select("s", "part", earlier.alias("earlier")), ["s", "part"])
    number = F.col("earlier") + F.row_number().over(Window.partitionBy("s", "part").orderBy("place")) - 1
    some = some.withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), F.col("spend") - number * F.col("size"))))
    other = rows.filter("take <> 'some'").withColumn("extra", F.when(F.col("take") == "all", F.col("size")).otherwise(F.lit(0)))
    return some.drop("earlier").unionByName(other)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, max_epochs: int = MAX_EPOCHS, seed: str = SEED, key: str | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, copies (whole repetitions), extra (words of the fractional one), taken.

    key: a column that numbers the rows of docs; the result then has it as row_id.
    """
    sizes = materialize(sized(docs, seed, key), "sizes")
    pick = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    filled = water_fill(ranked_sources(sizes).withColumn("weight", pick.cast("long")).drop("rank"), budget, max_epochs)
    words = F.floor(F.col("target") + 0.5).cast("long")
    whole = F.when(F.col("source_size") > 0, F.expr("CAST(FLOOR(target + 0.5D) AS BIGINT) DIV greatest(source_size, 1)")).otherwise(F.lit(0)).cast("long")
    plan = materialize(filled.withColumn("copies", whole).withColumn("rest", words - F.col("copies") * F.col("source_size")).withColumn("s", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))), "plan")

    sizes = sizes.withColumn("s", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))).withColumn("cell", F.floor(F.col("u") / (2**32 // CELLS)))
    cells = sizes.groupBy("s", "cell").agg(F.sum("size").alias("cell_size"))
    so_far = Window.partitionBy("s").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("cell_before", F.coalesce(F.sum("cell_size").over(so_far), F.lit(0))).join(plan.drop("source"), "s")
    left = F.col("rest") - F.col("cell_before")
    state = F.when(left >= F.col("cell_size"), "all").when(left <= 0, "none").otherwise("edge")
    cells = materialize(cells.withColumn("state", state), "cells")

    # at most CELLS rows a source: the sizes side is large, so the join is left to the planner's own checks
    rows = sizes.drop("source").join(cells, ["s", "cell"])
    edge = edge_extras(materialize(rows.filter("state = 'edge'").withColumn("left", left).withColumn("id_key", F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), "edge"))
    other = rows.filter("state <> 'edge'").withColumn("extra", F.when(F.col("state") == "all", F.col("size")).otherwise(F.lit(0)))
    source = F.when(F.substring("s", 1, 1) == "s", F.expr("substring(s, 2)"))
    shown = ["row_id", "doc_id", "s", "size", "source_size", "target", "copies", "extra"]
    return edge.select(*shown).unionByName(other.select(*shown)).select(
        *["row_id"] * bool(key), "doc_id", source.alias("source"), "size", "source_size", "target", "copies", F.col("extra").cast("long"), (F.col("copies") * F.col("size") + F.col("extra")).cast("long").alias("taken")
    )


def repeat_documents(docs: DataFrame, mixed: DataFrame, key: str) -> DataFrame:
    """The mix itself: each row copies times, and once more its first `extra` words where extra > 0. Columns as in docs but for key, the column that numbers its rows (row_id in mixed)."""
    plan = mixed.filter("taken > 0").select("row_id", "copies", "extra", "size")
    rows = docs.select(F.struct("*").alias("_doc"))  # so that columns of docs cannot clash with those of the plan
    both = rows.join(plan, rows["_doc"][key] == plan["row_id"])
    # a list of word counts: the whole text (-1) for whole repetitions, a part for the last
    part = F.when(F.col("extra") <= 0, F.array().cast("array<long>")).when(F.col("extra") == F.col("size"), F.array(F.lit(-1).cast("long"))).otherwise(F.array(F.col("extra")))
    times = F.concat(F.expr("array_repeat(-1L, CAST(copies AS INT))"), part)
    both = both.withColumn("_take", F.explode(times))
    first = F.array_join(F.slice(F.regexp_extract_all(F.col("_doc.text"), F.lit(WORD), 0), 1, F.greatest(F.col("_take").cast("int"), F.lit(0))), " ")
    text = F.when(F.col("_take") < 0, F.col("_doc.text")).otherwise(first)
    return both.select(*(text.alias(c) if c == "text" else F.col("_doc").getField(c).alias(c) for c in docs.columns if c != key))
