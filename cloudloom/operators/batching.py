"""Batches of samples: size-bounded packing, offsets, fixed-size batches.

A manifest row is a sample (a tile or a draw of one), never a point.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloudloom.operators.ordering import GROUP_ROWS, explode_range, join_rows, ordered_prefix, with_group_stats
from cloudloom.session import cut_lineage

BLOCK = 100_000  # samples that one task walks through in order


def _reached(follow: np.ndarray, start: int) -> np.ndarray:
    """Places on the chain start, follow[start], … of ever larger places, up to the end len(follow). Every doubling squares
    the jump, so that the chain is known after as many array operations as its length has bits."""
    n = len(follow)
    jump = np.append(follow, n)
    on = np.array([start])
    while on[-1] < n:
        on = np.concatenate([on, jump[on]])
        jump = jump[jump]
    return np.unique(on[on < n])


def _walk(sizes: np.ndarray, max_points: int) -> np.ndarray:
    """Batch of each sample: the next batch starts at the first sample that takes the running size beyond the limit."""
    n = len(sizes)
    ends = np.cumsum(sizes)
    follow = np.maximum(np.searchsorted(ends, ends - sizes + max_points, side="right"), np.arange(1, n + 1))
    batch = np.zeros(n, np.int64)
    batch[_reached(follow, 0)] = 1
    return np.cumsum(batch) - 1


def pack_batches(samples: DataFrame, order: str, size: str, max_points: int, shard: list[str] = (), block: int = BLOCK) -> DataFrame:
    """Next-fit packing in order: an open batch takes the next sample while it stays within
    `max_points`; a sample above the limit gets a batch of its own. Adds `batch_id`, dense per shard. A null size counts as 0; a
    null shard is a shard.

    A shard of at most `block` samples is packed in one task, by array operations. For a longer one the same result is
    found without a sequential pass: if a batch starts at sample i, the next one starts at the
    sample that covers position S(i) + max_points on the line of running sizes. These links are
    followed block by block, and the chain of blocks is closed by pointer doubling.
    """
    shard = list(shard)
    df = samples.withColumn("_n", F.coalesce(F.col(size).cast("long"), F.lit(0)))
    sizes = df.groupBy(*shard).count() if shard else df.agg(F.count(F.lit(1)).alias("count"))
    largest = sizes.agg(F.max("count")).first()[0] or 0
    if largest <= block:
        keys = shard or ["_all"]
        slim = df.select(*shard, F.col(order).alias("_o"), "_n")
        if not shard:
            slim = slim.withColumn("_all", F.lit(0))

        def pack(pdf):
            pdf = pdf.sort_values("_o", kind="stable")
            return pdf.assign(batch_id=_walk(pdf["_n"].fillna(0).to_numpy(np.int64), max_points))[[*keys, "_o", "batch_id"]]

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema if f.name in [*keys, "_o"])
        got = slim.groupBy(*keys).applyInPandas(pack, schema + ", batch_id bigint")
        return join_rows(samples, got.withColumnRenamed("_o", order).drop("_all"), [*shard, order])

    rows = ordered_prefix(df, shard, [order], "_i", {"_s": "_n"}, largest=largest, group_rows=block)
    rows = cut_lineage(rows)
    links = cut_lineage(_links(rows.select(*shard, "_i", "_s", "_n"), shard, max_points, block))
    entries = _block_entries(links, shard, largest, block)
    starts = _starts(links, entries, shard, block)
    marked = rows.join(starts.withColumn("_start", F.lit(1)), [*shard, "_i"], "left")
    marked = marked.withColumn("_start", F.coalesce("_start", F.lit(0)))
    out = ordered_prefix(marked, shard, ["_i"], sums={"_b": "_start"}, largest=largest, group_rows=block)
    out = out.withColumn("batch_id", (F.col("_b") + F.col("_start") - 1).cast("long"))
    return out.select(*samples.columns, "batch_id")


def _links(rows, shard, max_points, block):
    """`_next`: where the batch after one that starts at `_i` starts; null past the end.

    The line of running sizes is cut into stretches of max_points. A stretch meets at most max_points samples of positive
    size, and is asked at no more places, so the window below is bounded. Samples without points ask where the
    next one with points does. Nobody asks further into a sample than max_points, so a large one lies on three stretches.
    """
    cell = lambda c: F.floor(c / F.lit(max_points))
    end = F.col("_s") + F.col("_n")
    data = rows.filter(F.col("_n") > 0).select(
        *shard,
        F.explode(F.sequence(cell(F.col("_s")), F.least(cell(end - 1), cell(F.col("_s") + F.lit(max_points))))).alias("_cell"),
        end.alias("_v"),
        F.lit(1).alias("_kind"),
        "_i",
        F.lit(None).cast("long").alias("_s"),
    )
    at = F.col("_s") + F.lit(max_points)
    ask = rows.select(*shard, "_s").distinct()
    ask = ask.select(*shard, cell(at).alias("_cell"), at.alias("_v"), F.lit(0).alias("_kind"), F.lit(None).cast("long").alias("_i"), "_s")
    w = Window.partitionBy(*shard, "_cell").orderBy(F.col("_v").desc(), "_kind")
    w = w.rowsBetween(Window.unboundedPreceding, -1)
    both = data.unionByName(ask).withColumn("_next", F.min(F.when(F.col("_kind") == 1, F.col("_i"))).over(w))
    found = both.filter("_kind = 0").select(*shard, "_s", "_next")
    nxt = F.when(F.col("_next").isNotNull(), F.greatest(F.col("_next"), F.col("_i") + 1))
    rows = join_rows(rows, found, [*shard, "_s"])
    return rows.select(*shard, F.floor(F.col("_i") / F.lit(block)).alias("_blk"), "_i", nxt.alias("_next"))


def _block_entries(links, shard, largest, block):
    """The first batch start inside each block that has one."""
    keys = [*shard, "_blk"]

    def leave(pdf):
        pdf = pdf.sort_values("_i")
        first = int(pdf["_i"].iloc[0])
        nxt = pdf["_next"].fillna(-1).to_numpy().astype(np.int64)
        n = len(nxt)
        inside = (nxt >= 0) & (nxt < first + n)
        last = np.where(inside, nxt - first, np.arange(n))  # the last place of the block on the chain, by doubling
        while (last[last] != last).any():
            last = last[last]
        return pdf.assign(_exit=nxt[last])[[*shard, "_i", "_exit"]]

    fields = {f.name: f.dataType.simpleString() for f in links.schema}
    schema = ", ".join(f"`{c}` {fields[c]}" for c in [*shard, "_i"]) + ", _exit bigint"
    jump = links.groupBy(*keys).applyInPandas(leave, schema).filter("_exit >= 0")
    jump = cut_lineage(jump)
    reach = links.filter("_i = 0").select(*shard, "_i")
    for _ in range(max(1, math.ceil(math.log2(math.ceil(largest / block) + 1)))):
        step = reach.join(jump, [*shard, "_i"]).select(*shard, F.col("_exit").alias("_i"))
        reach = cut_lineage(reach.unionByName(step).distinct())
        far = jump.select(*shard, F.col("_i").alias("_exit"), F.col("_exit").alias("_far"))
        jump = cut_lineage(jump.join(far, [*shard, "_exit"]).select(*shard, "_i", F.col("_far").alias("_exit")))
    return reach.select(*shard, F.floor(F.col("_i") / F.lit(block)).alias("_blk"), F.col("_i").alias("_entry"))


def _starts(links, entries, shard, block):
    keys = [*shard, "_blk"]

    def mark(pdf):
        pdf = pdf.sort_values("_i")
        first, n = int(pdf["_i"].iloc[0]), len(pdf)
        nxt = pdf["_next"].fillna(-1).to_numpy().astype(np.int64)
        follow = np.where((nxt >= 0) & (nxt < first + n), nxt - first, n)
        return pdf.iloc[_reached(follow, int(pdf["_entry"].iloc[0]) - first)][[*shard, "_i"]]

    fields = {f.name: f.dataType.simpleString() for f in links.schema}
    schema = ", ".join(f"`{c}` {fields[c]}" for c in [*shard, "_i"])
    return links.join(entries, keys).groupBy(*keys).applyInPandas(mark, schema)


def batch_offsets(packed: DataFrame, order: str, size: str, batch=("batch_id",)) -> DataFrame:
    """Running total of sample sizes inside each batch (end offset of every sample)."""
    df = ordered_prefix(packed, list(batch), [order], sums={"_before": size})
    return df.withColumn("offset", F.col("_before") + F.col(size)).drop("_before")


def offset_to_counts(offsets: DataFrame, keys: list[str], element="element", offset="offset") -> DataFrame:
    """Sizes from running totals: the difference to the element before."""
    prev = offsets.select(*keys, (F.col(element) + 1).alias(element), F.col(offset).alias("_p"))
    df = offsets.join(prev, [*keys, element], "left")
    return df.withColumn("n", F.col(offset) - F.coalesce("_p", F.lit(0))).drop("_p")


def counts_to_offset(counts: DataFrame, keys: list[str], element="element", n="n") -> DataFrame:
    df = ordered_prefix(counts, keys, [element], sums={"_p": n})
    return df.withColumn("offset", F.col("_p") + F.col(n)).drop("_p")


def offset_to_rows(offsets: DataFrame, keys: list[str], element="element", offset="offset") -> DataFrame:
    """Element number of every packed row."""
    df = offset_to_counts(offsets, keys, element, offset).filter("n > 0")
    return explode_range(df, "row", F.col(offset) - F.col("n"), F.col(offset) - 1).select(*keys, element, "row")


def rows_to_offset(rows: DataFrame, keys: list[str], element="element") -> DataFrame:
    counts = rows.groupBy(*keys, element).agg(F.count(F.lit(1)).alias("n"))
    return counts_to_offset(counts, keys, element)


def batch_count_exact(packed: DataFrame, shard: list[str] = ()) -> DataFrame:
    return packed.agg(F.count_distinct(*shard, "batch_id").alias("batches"))


def batch_count_estimate(samples: DataFrame, size: str, max_points: int) -> DataFrame:
    """max(1, int(samples / (max_points / mean size) * 0.95))."""
    per_batch = F.lit(float(max_points)) / F.avg(size)
    raw = F.floor(F.count(F.lit(1)) / per_batch * F.lit(0.95))
    return samples.agg(F.greatest(raw, F.lit(1)).cast("long").alias("batches"))


def fixed_batches(samples: DataFrame, order: str, batch_size: int, drop_last=False, group_rows: int = GROUP_ROWS) -> DataFrame:
    df = ordered_prefix(samples, [], [order], "_i", group_rows=group_rows)
    df = df.withColumn("batch_id", F.floor(F.col("_i") / F.lit(batch_size))).drop("_i")
    if not drop_last:
        return df
    return with_group_stats(df, ["batch_id"], [F.count(F.lit(1)).alias("_m")]).filter(F.col("_m") == batch_size).drop("_m")


def collate(points: DataFrame, packed: DataFrame, sample: list[str], order: str, id_col="point_id", batch=("batch_id",)) -> DataFrame:
    """Points of each batch one after another, in sample order, with their place in the batch."""
    df = points.join(packed.select(*sample, *batch, order), sample)
    return ordered_prefix(df, list(batch), [order, id_col], "pos_in_batch")


def batch_summary(packed: DataFrame, size: str, batch=("batch_id",)) -> DataFrame:
    per = packed.groupBy(*batch).agg(F.count(F.lit(1)).alias("samples"), F.sum(size).alias("points"))
    return per.agg(
        F.count(F.lit(1)).alias("batches"),
        *[f(c).alias(f"{n}_{c}") for c in ("samples", "points") for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))],
    )
