"""Tiling of a cloud: window assignment, overlap passes, merging and splitting, tile tables."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloudloom.operators.neighbors import knn_join
from cloudloom.operators.ordering import GROUP_ROWS, attach_groups, ordered_prefix, with_group_stats
from cloudloom.schemas import TILE, TILE_PART
from cloudloom.session import cut_lineage


def tile_overlap(points: DataFrame, window=(50.0, 50.0), factor: int = 1) -> DataFrame:
    """Window cell of each point, counted from the cloud's own minimum; `factor`^2 passes, each
    shifted by a multiple of window/factor, give every point one tile per pass.

    Adds pass_id, xb, yb. Only the per-cloud minimum needs a shuffle.
    """
    wx, wy = (float(w) for w in window)
    df = with_group_stats(points, ["file_id"], [F.min("x").alias("_x0"), F.min("y").alias("_y0")])
    shifts = [
        F.struct(F.lit(i * factor + j).alias("p"), F.lit(wx * i / factor).alias("dx"), F.lit(wy * j / factor).alias("dy"))
        for i in range(factor)
        for j in range(factor)
    ]
    df = df.withColumn("_s", F.explode(F.array(*shifts)) if factor > 1 else shifts[0])
    df = df.withColumns(
        {
            "pass_id": F.col("_s.p"),
            "xb": F.floor((F.col("x") - (F.col("_x0") - F.col("_s.dx"))) / F.lit(wx)),
            "yb": F.floor((F.col("y") - (F.col("_y0") - F.col("_s.dy"))) / F.lit(wy)),
        }
    )
    return df.drop("_x0", "_y0", "_s")


def tile_assign(points: DataFrame, window=(50.0, 50.0)) -> DataFrame:
    return tile_overlap(points, window, 1)


def tile_centroids(tiled: DataFrame) -> DataFrame:
    return tiled.groupBy(*TILE).agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("cx"), F.avg("y").alias("cy")
    )


def _tile_number(xb="xb", yb="yb"):
    return F.shiftleft(F.col(xb), 31) + F.col(yb)


def nearest_tile(small: DataFrame, valid: DataFrame, **knn) -> DataFrame:
    """For each small tile the valid tile of the same file and pass whose centroid is nearest."""
    num = F.lit((1 << 31) - 1).cast("long")
    edges = knn_join(
        small.withColumn("_t", _tile_number()),
        valid.withColumn("_t", _tile_number()),
        1,
        ["file_id", "pass_id"],
        ("cx", "cy"),
        "_t",
        "_t",
        **knn,
    )
    return edges.select(
        "file_id",
        "pass_id",
        F.shiftright("src", 31).alias("xb"),
        F.col("src").bitwiseAND(num).alias("yb"),
        F.shiftright("dst", 31).alias("to_xb"),
        F.col("dst").bitwiseAND(num).alias("to_yb"),
        "dist2",
    )


def tile_merge_small(tiled: DataFrame, min_points: int, **knn) -> DataFrame:
    """Tiles below `min_points` join their nearest tile that is not below it. Centroids stay those
    before merging; a file and pass without a valid tile is left as it is."""
    tiles = tile_centroids(tiled)
    small = tiles.filter(F.col("n") < min_points)
    valid = tiles.filter(F.col("n") >= min_points)
    moves = nearest_tile(small, valid, **knn).drop("dist2")
    out = tiled.join(moves, TILE, "left").withColumns(
        {"xb": F.coalesce("to_xb", "xb"), "yb": F.coalesce("to_yb", "yb")}
    )
    return out.drop("to_xb", "to_yb")


TASK_ROWS = 1 << 18  # largest part that one task splits to the end
NO_PLACE = -1.7e308  # where a null coordinate is sorted
BINS, CANDIDATES = 1024, 4096  # bins of a histogram; rows among which a rank is looked up in order


def _split_in_task(max_points: int):
    """Splits a whole part to the end: its rows with their final `part`."""

    def fn(table: pa.Table) -> pa.Table:
        x, y = (table[c].to_numpy() for c in "xy")  # nulls become NaN
        ids = table["point_id"]
        if ids.null_count:
            ids = ids.fill_null(np.iinfo(np.int64).min if pa.types.is_int64(ids.type) else ids.type.to_pandas_dtype()())
        ids = ids.to_numpy()
        part = np.full(len(ids), table["part"][0].as_py(), np.int64)
        todo = [np.arange(len(ids))]
        while todo:
            rows = todo.pop()
            if len(rows) <= max_points:
                continue
            a, b = x[rows], y[rows]
            v = a if np.fmax.reduce(a) - np.fmin.reduce(a) >= np.fmax.reduce(b) - np.fmin.reduce(b) else b
            rows = rows[np.lexsort((ids[rows], np.where(np.isnan(v), NO_PLACE, v)))]
            half = len(rows) // 2
            part[rows] *= 2
            part[rows[half:]] += 1
            todo += [rows[:half], rows[half:]]
        return table.set_column(table.schema.get_field_index("part"), "part", pa.array(part))

    return fn


def _narrow(rows: DataFrame, keys: list[str], at: str, ranks: DataFrame, bins: int, candidates: int) -> DataFrame:
    """Per group the range (_lo, _hi) of `at` that holds the row of rank _k: its rows (_c), and the rank among them (_k).

    Every pass counts the rows of the range in `bins` bins and goes on with one of them, until the range has at most
    `candidates` rows or one value. Only counts are shuffled.
    """
    inside = attach_groups(rows, ranks, keys).filter(F.col("_k").isNotNull())
    ends = inside.groupBy(*keys, "_k").agg(F.min(at).alias("_lo"), F.max(at).alias("_hi"), F.count(F.lit(1)).alias("_c"))
    state, wide = cut_lineage(ends), (F.col("_c") > candidates) & (F.col("_lo") < F.col("_hi"))
    while state.filter(wide).limit(1).count():
        inside = attach_groups(rows, state.filter(wide).drop("_c"), keys).filter(F.col(at).between(F.col("_lo"), F.col("_hi")))
        # ids beyond 2^53 may share a double: then their distance, a small number, is the bin
        low, high, v = (c.cast("double") for c in (F.col("_lo"), F.col("_hi"), F.col(at)))
        bin_ = F.when(high > low, F.least(F.floor((v - low) / (high - low) * bins), F.lit(bins - 1))).otherwise((F.col(at) - F.col("_lo")).cast("long"))
        counts = inside.groupBy(*keys, "_k", bin_.alias("_bin")).agg(F.count(F.lit(1)).alias("_c"), F.min(at).alias("_lo"), F.max(at).alias("_hi"))
        before = F.sum("_c").over(Window.partitionBy(*keys).orderBy("_lo")) - F.col("_c")
        picked = counts.withColumn("_b", before).filter((F.col("_b") <= F.col("_k")) & (F.col("_k") < F.col("_b") + F.col("_c")))
        picked = picked.withColumn("_k", F.col("_k") - F.col("_b")).select(*state.columns)
        state = cut_lineage(state.filter(~wide).unionByName(picked))
    return state


def row_of_rank(rows: DataFrame, keys: list[str], value: str, ident: str, ranks: DataFrame, bins: int = BINS, candidates: int = CANDIDATES) -> DataFrame:
    """Per group, value (`_tv`) and id (`_ti`) of the row with 0-based rank in (value, id) order; no rows are sorted.

    `ranks` has one row per group: the keys and _k. Histograms narrow the range of values; where only equal values are
    left, those of ids. What is left is looked up, at most `candidates` rows a group. `rows` is read once a pass.
    """
    found = _narrow(rows, keys, value, ranks, bins, candidates)
    crowded = F.col("_c") > candidates
    parts = [(found.filter(~crowded), F.lit(True))]
    one_value = found.filter(crowded).select(*keys, "_k", F.col("_lo").alias("_one"))
    if one_value.limit(1).count():
        equal = attach_groups(rows, one_value.drop("_k"), keys).filter(F.col(value) == F.col("_one")).drop("_one")
        by_id = _narrow(equal, keys, ident, one_value.drop("_one"), bins, candidates)
        by_id = attach_groups(by_id.withColumnsRenamed({"_lo": "_from", "_hi": "_to"}), one_value.drop("_k"), keys)
        parts.append((cut_lineage(by_id.withColumns({"_lo": F.col("_one"), "_hi": F.col("_one")})), F.col(ident).between(F.col("_from"), F.col("_to"))))
    out = []
    for state, also in parts:
        few = attach_groups(rows, state, keys).filter(F.col("_k").isNotNull() & F.col(value).between(F.col("_lo"), F.col("_hi")) & also)
        order = F.sort_array(F.collect_list(F.struct(F.col(value).alias("v"), F.col(ident).alias("i"))))
        few = few.groupBy(*keys, "_k").agg(order.alias("_all"))
        out.append(few.select(*keys, F.get("_all", F.col("_k").cast("int"))["v"].alias("_tv"), F.get("_all", F.col("_k").cast("int"))["i"].alias("_ti")))
    return cut_lineage(reduce(DataFrame.unionByName, out))


def tile_split_large(tiled: DataFrame, max_points: int, task_rows: int = TASK_ROWS, bins: int = BINS, candidates: int = CANDIDATES) -> DataFrame:
    """Halves tiles above `max_points` at the median of their wider axis (x when equal) until none
    is left. Adds `part`: 1 for an unsplit tile, and 2p / 2p+1 for the halves of p; the lower half
    gets n div 2 points, ties in id order, points without the coordinate first. No row is lost.

    Tiles that are small enough are not moved. Parts of more than `task_rows` points are halved at an exact median that
    histograms find, all of one round together; once below, a part goes to one task, which splits it to the end.
    """
    if max_points < 1:
        raise ValueError("max_points must be at least 1")
    sizes = cut_lineage(tiled.groupBy(*TILE).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > max_points))
    largest = sizes.agg(F.max("_n")).first()[0]
    whole = tiled.withColumn("part", F.lit(1).cast("long"))
    if not largest:
        return whole
    whole = attach_groups(whole, sizes, TILE)
    cur, out = whole.filter(F.col("_n").isNotNull()), whole.filter(F.col("_n").isNull()).drop("_n")
    ready = []
    while largest > task_rows:
        ready.append(cur.filter(F.col("_n") <= task_rows).drop("_n"))
        cur = cut_lineage(cur.filter(F.col("_n") > task_rows))
        box = [f(c).alias(f"_{n}{c}") for c in "xy" for n, f in (("lo", F.min), ("hi", F.max))]
        box = cut_lineage(cur.groupBy(*TILE_PART, "_n").agg(*box))
        wide_x = (F.col("_hix") - F.col("_lox") >= F.col("_hiy") - F.col("_loy")).alias("_wide_x")
        half = F.floor(F.col("_n") / 2)
        rows = attach_groups(cur.drop("_n"), box.select(*TILE_PART, wide_x), TILE_PART)
        along = F.when(F.col("_wide_x"), F.col("x")).otherwise(F.col("y")).cast("double")
        rows = rows.withColumn("_v", F.coalesce(along, F.lit(NO_PLACE))).drop("_wide_x")
        ends = row_of_rank(rows.select(*TILE_PART, "_v", "point_id"), TILE_PART, "_v", "point_id", box.select(*TILE_PART, half.alias("_k")), bins, candidates)
        ends = attach_groups(ends, box.select(*TILE_PART, half.alias("_half"), "_n"), TILE_PART)
        rows = attach_groups(rows, cut_lineage(ends), TILE_PART)
        upper = (F.col("_v") > F.col("_tv")) | (F.col("_v") == F.col("_tv")) & (F.col("point_id") >= F.col("_ti"))
        upper = F.coalesce(upper, F.lit(False))
        moved = {"part": F.col("part") * 2 + upper.cast("long"), "_n": F.when(upper, F.col("_n") - F.col("_half")).otherwise(F.col("_half"))}
        cur = rows.withColumns(moved).drop("_v", "_tv", "_ti", "_half")
        largest = (largest + 1) // 2
    for part in [*ready, cur.drop("_n")]:
        schema = part.schema
        out = out.unionByName(part.groupBy(*TILE_PART).applyInArrow(_split_in_task(max_points), schema))
    return out


def tile_ids(tiled: DataFrame, tile: list[str] = TILE, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Dense segment_id per file, in tile order. Numbers the tile table, not the points."""
    keys = tiled.select(*tile).distinct()
    keys = ordered_prefix(keys, ["file_id"], [c for c in tile if c != "file_id"], "segment_id", group_rows=group_rows)
    return attach_groups(tiled, cut_lineage(keys), tile)


def tile_stats(tiled: DataFrame, tile: list[str] = TILE) -> DataFrame:
    box = [F.count(F.lit(1)).alias("num_points")]
    for c in "xyz":
        box += [F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")]
    t = tiled.groupBy(*tile).agg(*box)
    return t.select(
        *tile,
        "num_points",
        F.struct(*[F.col(f"{c}_min").alias(c) for c in "xyz"]).alias("local_min"),
        F.struct(*[f"{c}_{e}" for c in "xyz" for e in ("min", "max")]).alias("bounds"),
    )


def tile_labels(tiled: DataFrame, tile: list[str] = TILE, label="classification") -> DataFrame:
    """Histogram map and sorted distinct labels; the second level holds one entry per class."""
    per_class = tiled.groupBy(*tile, label).agg(F.count(F.lit(1)).alias("n"))
    entries = F.array_sort(F.collect_list(F.struct(label, "n")))
    t = per_class.groupBy(*tile).agg(entries.alias("_e"))
    return t.select(
        *tile,
        F.map_from_entries("_e").alias("label_counts"),
        F.transform("_e", lambda e: e[label]).alias("unique_labels"),
    )
