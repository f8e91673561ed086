"""Mixing sources to target weights, with DataFrame operations only.

Every document gets a hash-random key. Rows are sorted by source and key across the cluster by range partitioning; running
sums of words inside each range, and the sums of the ranges before it, are prefix sums over each source. A source's budget
gives its whole epochs, and the prefix sum tells which documents the last, unfinished epoch still takes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloudloom.operators.ordering import attach_groups, explode_range, ordered_prefix
from cloudloom.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
PART_ROWS = 1 << 20  # rows, without their texts, of one range
WEIGHTS, MAX_EPOCHS = (1, 2, 3), 3


def n_words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, source_col: str, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """`sizes` (one row per source: `source_col`, source_size) with weight and target.

    Sources in code point order, null last, take the weights in turn. The targets share the sum of all sizes by weight; one
    that would pass `max_epochs` times its source's size stops there, and the excess goes to the others by weight. In
    order of size per weight, stopped sources come first, so that running sums tell where stopping ends.
    """
    table = ordered_prefix(sizes, [], [F.col(source_col).asc_nulls_last()], count="_rank")
    given = F.array(*[F.lit(float(w)) for w in weights])
    table = table.withColumn("weight", F.get(given, (F.col("_rank") % len(weights)).cast("int")))
    table = table.withColumn("_cap", F.col("source_size") * max_epochs)
    table = cut_lineage(table.withColumn("_ratio", F.col("_cap") / F.col("weight")))
    all_of = table.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    table = ordered_prefix(table, [], ["_ratio", "_rank"], sums={"_caps": "_cap", "_weights": "weight"})
    table = table.withColumn("_left", F.lit(float(all_of["size"] or 0)) - F.col("_caps"))
    table = cut_lineage(table.withColumn("_share", F.lit(float(all_of["weight"] or 0)) - F.col("_weights")))
    open_ = table.filter(F.col("_ratio") * F.col("_share") > F.col("_left"))
    level = open_.agg(F.min(F.struct("_ratio", "_rank", "_left", "_share")).alias("first")).first()["first"]
    target = F.col("_cap").cast("double")
    if level:  # the first source that does not stop: what is left from there on, by weight
        left, share = F.lit(level["_left"]), F.lit(level["_share"])
        target = F.when(F.col("_ratio") * share <= left, target).otherwise(F.col("weight") * left / share)
    return table.select(source_col, "source_size", "weight", target.alias("target"))


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights=WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    seed: int = 0,
    carry: list[str] | None = None,
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """The columns `carry` (all, if None) of every row of `docs`, with size, source_size, target and taken.

    size: words of the text, 0 for null. target: the source's share of all words (see `source_targets`). taken: words that
    the mix takes from this text: whole epochs, then those of the unfinished epoch, in which texts come in the order of a
    hash of seed and id; the last one of a source is cut, so that the words taken add up to the rounded target. Null
    sources are one source; rows of one id come in order of size; equal rows are interchangeable. A source without
    words has target 0. No rows give no rows. Columns named like a result are replaced.
    """
    results = ("size", "source_size", "target", "taken")
    own = [c for c in (docs.columns if carry is None else carry) if c not in results]
    key = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")).cast("binary")), 1, 16)
    rows = docs.select(
        F.struct(*own).alias("_row"), F.col(source_col).alias("_source"), key.alias("_key"),
        F.col(id_col).alias("_id"), n_words(F.col(text_col)).alias("_size"),
    )
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(docs.count() / part_rows))
    # the checkpoint fixes the ranges, so that the rows and the sums of the ranges agree
    rows = cut_lineage(rows.repartitionByRange(parts, "_source", "_key", "_id", "_size").withColumn("_part", F.spark_partition_id()))

    ranges = cut_lineage(rows.groupBy("_source", "_part").agg(F.sum("_size").alias("_words")))
    before = Window.partitionBy("_source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("_skip", F.coalesce(F.sum("_words").over(before), F.lit(0)))
    sources = ranges.groupBy("_source").agg(F.sum("_words").alias("source_size"))
    sources = source_targets(cut_lineage(sources), "_source", weights, max_epochs)
    budget = F.floor(F.col("target") + 0.5).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size")).cast("long")).otherwise(F.lit(0))
    sources = sources.select("_source", "source_size", "target", epochs.alias("_epochs"), (budget - epochs * F.col("source_size")).alias("_rest"))
    ranges = attach_groups(ranges.drop("_words"), cut_lineage(sources), ["_source"])

    local = Window.partitionBy("_source", "_part").orderBy("_key", "_id", "_size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_here", F.coalesce(F.sum("_size").over(local), F.lit(0)))
    rows = attach_groups(rows, cut_lineage(ranges), ["_source", "_part"])
    last = F.greatest(F.lit(0), F.least(F.col("_size"), F.col("_rest") - F.col("_skip") - F.col("_here")))
    taken = F.col("_epochs") * F.col("_size") + last
    return rows.select("_row.*", F.col("_size").alias("size"), "source_size", "target", taken.cast("long").alias("taken"))


def mixture(mixed: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of the mix: one per row of `mixed` (from `mix_sources`, with its texts) and epoch, with epoch (from 0),
    words, and the text, of which the last one of a source keeps its first words only, joined by spaces."""
    rows = explode_range(mixed.filter("taken > 0"), "epoch", F.lit(0), F.floor((F.col("taken") - 1) / F.col("size")))
    words = F.least(F.col("size"), F.col("taken") - F.col("epoch") * F.col("size"))
    cut = F.array_join(F.slice(F.regexp_extract_all(text_col, F.lit(WORD), F.lit(0)), 1, F.col("words").cast("int")), " ")
    rows = rows.withColumn("words", words)
    return rows.withColumn(text_col, F.when(F.col("words") < F.col("size"), cut).otherwise(F.col(text_col)))
