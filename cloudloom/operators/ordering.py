"""Ranks and running sums inside groups whose size is not bounded.

A plain window sends a group to one task. These helpers do the same work when a single group holds
a large share of all rows: the group is cut into ordered chunks, each chunk is ranked on its own,
and the small table of chunk totals supplies the offset of each chunk.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloudloom.session import cut_lineage

GROUP_ROWS = 1 << 20  # largest group that one task sorts whole


def _before(keys, order):
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def rank_by_id(
    df: DataFrame,
    keys: list[str],
    id_col: str,
    rank: str = "rank",
    size: str | None = None,
    bound_keys: list[str] | None = None,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Adds the 0-based rank in id order inside `keys`, and the group size under `size`.

    `bound_keys` is a subset of `keys` whose groups are cheap to count (tiles for voxels). Groups up to `group_rows` rows
    take one window. The rows of larger ones are cut, over all such groups, into ranges of ids by splitters that Spark
    samples, so that a chunk holds about `group_rows` rows whatever the ids look like, also where they are hashes. The
    checkpoint fixes the chunks; the sizes of the chunks before give the offset of each. Null keys are a group.
    """
    bound = bound_keys or keys
    sizes = df.groupBy(*bound).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > group_rows)
    sizes = cut_lineage(sizes)
    total = sizes.agg(F.sum("_n")).first()[0]
    ranks = lambda w: {rank: (F.row_number().over(w.orderBy(id_col)) - 1).cast("long")} | ({size: F.count(F.lit(1)).over(w)} if size else {})
    whole = Window.partitionBy(*keys)
    if not total:
        return df.withColumns(ranks(whole))

    flagged = attach_groups(df, sizes.select(*bound, F.lit(True).alias("_large")), bound)
    small = flagged.filter("_large IS NULL").drop("_large").withColumns(ranks(whole))
    large = flagged.filter("_large").drop("_large").repartitionByRange(math.ceil(total / group_rows), *bound, id_col)
    large = cut_lineage(large.withColumn("_chunk", F.spark_partition_id()))
    piece = [*keys, "_chunk"]
    counts = cut_lineage(large.groupBy(*piece).agg(F.count(F.lit(1)).alias("_m")))
    offsets = counts.withColumns({"_skip": F.coalesce(F.sum("_m").over(_before(keys, ["_chunk"])), F.lit(0)), "_all": F.sum("_m").over(whole)})
    local = F.row_number().over(Window.partitionBy(*piece).orderBy(id_col)) - 1
    large = attach_groups(large.withColumn("_local", local), offsets.drop("_m"), piece)
    found = {rank: (F.col("_local") + F.col("_skip")).cast("long")} | ({size: F.col("_all").cast("long")} if size else {})
    return small.unionByName(large.withColumns(found).select(*small.columns))


def ordered_prefix(
    df: DataFrame,
    keys: list[str],
    order: list[Column | str],
    count: str | None = None,
    sums: dict[str, Column | str] | None = None,
    maxes: dict[str, Column | str] | None = None,
    group_rows: int = GROUP_ROWS,
    largest: int | None = None,
) -> DataFrame:
    """Adds the number of rows (`count`), sums and maxima (name -> expression) over the rows before
    the current one in `order` inside `keys`. `order` must be total. A maximum over no rows is null.

    Groups up to `group_rows` rows use one window. Larger ones are sorted across the cluster by
    range partitioning, which splits a group wherever it has to; the checkpoint fixes the split so
    that both later reads agree. Pass `largest` to spare the count that picks the path.
    """
    expr = lambda d: {n: (F.col(c) if isinstance(c, str) else c) for n, c in (d or {}).items()}
    sums, maxes = expr(sums), expr(maxes)
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    total = None
    if largest is None:
        sizes = df.groupBy(*keys).count() if keys else df.agg(F.count(F.lit(1)).alias("count"))
        row = sizes.agg(F.max("count").alias("m"), F.sum("count").alias("t")).first()
        largest, total = row["m"] or 0, row["t"] or 0
    if largest <= group_rows:
        w = _before(keys, order)
        cols = {n: F.coalesce(F.sum(c).over(w), F.lit(0)) for n, c in sums.items()}
        cols.update({n: F.max(c).over(w) for n, c in maxes.items()})
        if count:
            cols[count] = F.count(F.lit(1)).over(w)
        return df.withColumns(cols)

    if total is None:
        total = df.count()
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(parts, math.ceil(total / group_rows))
    work = df.withColumns({f"_s_{n}": c for n, c in {**sums, **maxes}.items()})
    key_cols = [F.col(k) for k in keys]
    work = cut_lineage(
        work.repartitionByRange(parts, *key_cols, *order).withColumn("_part", F.spark_partition_id())
    )
    piece = [*keys, "_part"]
    w = _before(piece, order)
    cols = {f"_l_{n}": F.coalesce(F.sum(f"_s_{n}").over(w), F.lit(0)) for n in sums}
    cols.update({f"_l_{n}": F.max(f"_s_{n}").over(w) for n in maxes})
    cols["_l_rows"] = F.count(F.lit(1)).over(w)
    local = work.withColumns(cols)
    aggs = [F.count(F.lit(1)).alias("_t_rows")] + [F.sum(f"_s_{n}").alias(f"_t_{n}") for n in sums]
    aggs += [F.max(f"_s_{n}").alias(f"_t_{n}") for n in maxes]
    chunks = work.groupBy(*piece).agg(*aggs)
    wc = _before(keys, ["_part"])
    chunks = chunks.select(
        *piece,
        *[
            F.coalesce(F.sum(f"_t_{n}").over(wc), F.lit(0)).alias(f"_b_{n}")
            for n in ["rows", *sums]
        ],
        *[F.max(f"_t_{n}").over(wc).alias(f"_b_{n}") for n in maxes],
    )
    out = local.join(chunks, piece)
    final = {n: F.col(f"_l_{n}") + F.col(f"_b_{n}") for n in sums}
    final.update({n: F.greatest(f"_l_{n}", f"_b_{n}") for n in maxes})
    if count:
        final[count] = F.col("_l_rows") + F.col("_b_rows")
    keep = [c for c in df.columns if c not in final]
    return out.select(*keep, *[c.alias(n) for n, c in final.items()])


MADE_AT_ONCE = 10_000  # values of one array


def explode_range(df: DataFrame, name: str, lo: Column, hi: Column, step: Column | int = 1) -> DataFrame:
    """One row for each of lo, lo + step, … up to hi (none if hi < lo). Arrays stay short, however many values a row has."""
    step = F.lit(step).cast("long") if isinstance(step, int) else step.cast("long")
    lo, hi = lo.cast("long"), hi.cast("long")
    many = F.floor((hi - lo) / step)
    df = df.filter(hi >= lo).withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(many / MADE_AT_ONCE))))
    first = lo + F.col("_block") * MADE_AT_ONCE * step
    last = F.least(hi, first + (MADE_AT_ONCE - 1) * step)
    return df.withColumn(name, F.explode(F.sequence(first, last, step))).drop("_block")


SMALL_ROWS = 100_000  # largest table, one row per group, that is sent to every task


def attach_groups(df: DataFrame, table: DataFrame, keys: list[str], small_rows: int = SMALL_ROWS) -> DataFrame:
    """Joins a table with one row per group to the rows; a null key matches a null key, and every row stays.

    The table is counted first, and sent to every task only up to `small_rows` rows; beyond that both sides
    are shuffled, and adaptive execution splits a hot key.
    """
    right = table.select(*[F.col(k).alias(f"_key_{k}") for k in keys], *[c for c in table.columns if c not in keys])
    same = F.lit(True)
    for k in keys:
        same = same & df[k].eqNullSafe(right[f"_key_{k}"])
    few = right.limit(small_rows + 1).count() <= small_rows
    return df.join(F.broadcast(right) if few else right, same, "left").drop(*[f"_key_{k}" for k in keys])


def join_rows(df: DataFrame, table: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Joins on keys of which null matches null; the other columns of `table` must have names of their own."""
    right = table.withColumnsRenamed({k: f"_key_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & df[k].eqNullSafe(right[f"_key_{k}"])
    return df.join(right, same, how).drop(*[f"_key_{k}" for k in keys])


def with_group_stats(df: DataFrame, keys: list[str], stats: list[Column]) -> DataFrame:
    """Joins per-group aggregates back to the rows.

    Aggregate-then-join instead of a window: the aggregate combines before its shuffle, and the small
    result is checkpointed before it is joined. The plan of the rows therefore names its input once,
    however many such steps follow each other; a chain of n steps reads its input n + 1 times in all.
    A window would send each hot group to one task. Without keys the statistics are one row, which
    becomes literals of the plan.
    """
    if not keys:
        one = df.agg(*stats)
        row = one.first()
        return df.withColumns({f.name: F.lit(row[f.name]).cast(f.dataType) for f in one.schema})
    return attach_groups(df, cut_lineage(df.groupBy(*keys).agg(*stats)), keys)
