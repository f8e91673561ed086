"""Exact k-nearest-neighbour joins.

How the search is spread over the cluster:

1. Query and reference rows get an integer cell address inside their batch's bounding cube; a cell
   at depth d is the top d bits of the address, so each depth refines the one before.
2. Query cells are paired with reference cells of the same depth. For a query cell, reference cells
   are taken in order of their farthest possible distance until they hold k rows; that distance
   bounds the k-th neighbour of every query in the cell, and reference cells that start beyond it
   are dropped. Only cell summaries (count and tight box) take part, never points.
3. A query cell whose surviving reference rows fit one task is settled. The others are split,
   together with their surviving reference cells, and step 2 runs one depth further. A crowded
   region therefore goes deeper while an empty one stops early.
4. Settled cells become blocks: bounded sets of query rows beside the reference rows they need.
   Inside a block, queries are halved at medians and references cut to those within reach, until
   small matrices are left.

Copies of one position cannot be split by depth, so reference rows are first cut to the k with the
smallest ids per position; ties are broken by id, which makes the rest unreachable as neighbours.
Query rows of a crowded cell are spread over several blocks. A cell that needs too many reference
rows even at full depth (very many rows at nearly one distance) gets them in several chunks, whose
answers are merged.

What edges need of their rows (attributes, relative positions) travels in the blocks with the rows: a
join of the edges, k times as many as the points, back to the points would sort and shuffle them all.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloudloom.operators.ordering import SMALL_ROWS, join_rows
from cloudloom.session import cut_lineage

DEPTH = 20  # a cell at full depth is 2^-20 of the batch's extent
BLOCK_REFS = 24_000  # reference rows a settled query cell may need
BLOCK_QUERIES = 32_768
BLOCK_UP = 2  # a block is the cell this many depths above its settled cells
PART_DISTANCES = 200_000_000  # pairs of a query and a reference in reach of its cell that a partition gets, about
CELLS = ("_c0", "_c1", "_c2")


def _join_cells(df, cells, keys):
    """Rows beside their cells. A short table of cells goes to every task: by a few keys, rows would pile up in a few tasks."""
    few = cells.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS
    return df.join(F.broadcast(cells) if few else cells, keys)


def _address(df, frame, batch, coords):
    df = _join_cells(df, frame, batch)
    cells = {}
    for c, axis in zip(CELLS, coords):
        step = F.floor((F.col(axis) - F.col(f"_o_{axis}")) / F.col("_side") * F.lit(float(1 << DEPTH)))
        step = F.when(F.col("_side") > 0, step).otherwise(F.lit(0))
        cells[c] = F.least(F.greatest(step, F.lit(0)), F.lit((1 << DEPTH) - 1)).cast("long")
    return df.withColumns(cells).drop("_side", *[f"_o_{a}" for a in coords])


def _cells(df, batch, coords, depth, tag):
    """Count and tight box of each occupied cell at `depth`."""
    n = len(coords)
    at = [F.shiftright(F.col(CELLS[i]), DEPTH - depth).alias(f"{tag}{i}") for i in range(n)]
    box = []
    for i, axis in enumerate(coords):
        box += [F.min(axis).alias(f"{tag}lo{i}"), F.max(axis).alias(f"{tag}hi{i}")]
    return df.groupBy(*batch, *at).agg(F.count(F.lit(1)).alias(f"{tag}n"), *box)


def _prune(pairs, batch, dims, k):
    near, far = [], []
    for i in range(dims):
        qlo, qhi, rlo, rhi = (F.col(f"{t}{e}{i}") for t in "qr" for e in ("lo", "hi"))
        gap = F.greatest(rlo - qhi, qlo - rhi, F.lit(0.0))
        reach = F.greatest(qhi - rlo, rhi - qlo)
        near.append(gap * gap)
        far.append(reach * reach)
    pairs = pairs.withColumns(
        {"_near": reduce(lambda a, b: a + b, near), "_far": reduce(lambda a, b: a + b, far)}
    )
    q = [*batch, *[f"q{i}" for i in range(dims)]]
    grow = Window.partitionBy(*q).orderBy("_far", *[f"r{i}" for i in range(dims)])
    whole = Window.partitionBy(*q)
    pairs = pairs.withColumn("_got", F.sum("rn").over(grow))
    pairs = pairs.withColumn("_reach", F.min(F.when(F.col("_got") >= k, F.col("_far"))).over(whole))
    pairs = pairs.filter(F.col("_reach").isNull() | (F.col("_near") <= F.col("_reach")))
    pairs = pairs.withColumn("_need", F.sum("rn").over(whole))
    return pairs.select(*q, *[f"r{i}" for i in range(dims)], "qn", "rn", "_need")


LEAF = 6  # depths up to this one are rolled up from one table of cells


def _roll_up(leaf, batch, dims, above, tag):
    """Cells `above` depths over the given ones: counts add up, boxes span."""
    at = [F.shiftright(F.col(f"{tag}{i}"), above).alias(f"{tag}{i}") for i in range(dims)]
    box = []
    for i in range(dims):
        box += [F.min(f"{tag}lo{i}").alias(f"{tag}lo{i}"), F.max(f"{tag}hi{i}").alias(f"{tag}hi{i}")]
    return leaf.groupBy(*batch, *at).agg(F.sum(f"{tag}n").alias(f"{tag}n"), *box)


def _children(df, cells, batch, dims, tag, depth):
    """Cells at `depth` below the given cells of the depth before."""
    up = [F.shiftright(F.col(f"{tag}{i}"), 1).alias(f"_p{i}") for i in range(dims)]
    kids = df.select("*", *up)
    parents = cells.select(*batch, *[F.col(f"{tag}{i}").alias(f"_p{i}") for i in range(dims)])
    return kids.join(parents.distinct(), [*batch, *[f"_p{i}" for i in range(dims)]], "left_semi")


LEAF_QUERIES = 32  # queries of a block that are compared with the same references
AT_ONCE = 1_000_000  # distances held at a time


def _within_reach(low, high, rx, near_k):
    """References (a mask, or None for all) that can be among the nearest of some query in the box low..high.

    The sums run over the axes in the order of the distances themselves, so rounding never puts a bound on the wrong side.
    """
    if len(rx) <= near_k:
        return None
    near, far = np.zeros(len(rx)), np.zeros(len(rx))
    for i in range(rx.shape[1]):
        below, above = low[i] - rx[:, i], rx[:, i] - high[i]
        gap = np.maximum(np.maximum(below, above), 0.0)
        near += gap * gap
        reach = np.maximum(high[i] - rx[:, i], rx[:, i] - low[i])
        far += reach * reach
    return near <= np.partition(far, near_k - 1)[near_k - 1]


def _nearest(qx, mine, rx, want):
    """(query, rank from 0, reference, squared distance) arrays: the `want` nearest references of each query, ties by position.

    `mine` is the position of a query's own reference, which does not count, or -1. Queries are halved at medians until a few
    are left, and every half keeps the references that are within reach of its box.
    """
    near_k = want + bool((mine >= 0).any())
    todo, found = [(np.nonzero(np.isfinite(qx).all(axis=1))[0], np.nonzero(np.isfinite(rx).all(axis=1))[0])], []
    while todo:
        rows, refs = todo.pop()
        if not len(rows) or not len(refs):
            continue
        x = qx[rows]
        low, high = x.min(axis=0), x.max(axis=0)
        inside = _within_reach(low, high, rx[refs], near_k)
        refs = refs if inside is None else refs[inside]
        axis = int(np.argmax(high - low))
        if len(rows) > LEAF_QUERIES and len(refs) > 4 * near_k and high[axis] > low[axis]:
            half = len(rows) // 2
            order = np.argpartition(x[:, axis], half)
            todo += [(rows[order[:half]], refs), (rows[order[half:]], refs)]
            continue
        r, step = rx[refs], max(1, AT_ONCE // len(refs))
        for start in range(0, len(rows), step):
            some = rows[start : start + step]
            d2 = np.zeros((len(some), len(refs)))
            for i in range(qx.shape[1]):
                diff = np.subtract.outer(qx[some, i], r[:, i])
                diff *= diff
                d2 += diff
            at = np.minimum(np.searchsorted(refs, mine[some]), len(refs) - 1)
            here = np.nonzero(refs[at] == mine[some])[0]
            d2[here, at[here]] = np.inf
            kth = np.partition(d2, want - 1, axis=1)[:, want - 1] if len(refs) > want else np.full(len(some), np.finfo(float).max)
            at_q, at_r = np.nonzero(d2 <= np.minimum(kth, np.finfo(float).max)[:, None])
            value = d2[at_q, at_r]
            order = np.lexsort((at_r, value, at_q))
            at_q, at_r, value = at_q[order], at_r[order], value[order]
            rank = np.arange(len(at_q)) - np.searchsorted(at_q, np.arange(len(some)))[at_q]
            ok = rank < want
            found.append((some[at_q[ok]], rank[ok], refs[at_r[ok]], value[ok]))
    return [np.concatenate(p) for p in zip(*found)] if found else [np.zeros(0, np.int64)] * 3 + [np.zeros(0)]


def _nearest_in_block(k, dims, with_self, block, brought, offsets):
    """`brought`: (name on the edge, end of the edge, column of the blocks); `offsets`: names of the relative positions."""

    def run(key, q, r):
        r = r.take(pc.sort_indices(r["_id"]))  # ties go by id
        q_ids, r_ids = (t["_id"].combine_chunks() for t in (q, r))
        qx, rx = (np.column_stack([t[f"_x{i}"].to_numpy() for i in range(dims)]) for t in (q, r))
        mine = np.full(len(q_ids), -1)
        if with_self and len(r_ids):
            both = pa.chunked_array([q_ids, r_ids]).combine_chunks().dictionary_encode("encode")
            code = both.indices.to_numpy()
            at = np.full(len(both.dictionary), -1)
            at[code[len(q_ids) :][::-1]] = np.arange(len(r_ids))[::-1]  # the first of equal ids
            mine = at[code[: len(q_ids)]]
        want = k - 1 if with_self else k
        src, rank, dst, d2 = _nearest(qx, mine, rx, want) if want else [np.zeros(0, np.int64)] * 3 + [np.zeros(0)]
        ranks, far = rank + (2 if with_self else 1), d2
        if with_self:  # a row's own edge comes first; its own reference may be cut, so both ends are the query
            own = np.arange(len(q_ids))
            src, dst = np.concatenate([own, src]), np.concatenate([own, dst + len(q_ids)])
            ranks, far = np.concatenate([np.ones(len(q_ids), np.int64), ranks]), np.concatenate([np.zeros(len(q_ids)), far])
        at = {"src": pa.array(src), "dst": pa.array(dst)}

        def end(side, column):
            parts = [q[column]] if side == "src" else [q[column], r[column]] if with_self else [r[column]]
            return pa.chunked_array([c for p in parts for c in p.cast(parts[-1].type).chunks], parts[-1].type).combine_chunks().take(at[side])

        cols = {"_src": end("src", "_id"), "_rank": pa.array(ranks, pa.int32()), "_dst": end("dst", "_id"), "_d2": pa.array(far, pa.float64())}
        cols |= {name: end(side, column) for name, side, column in brought}
        x = np.concatenate([qx, rx]) if with_self else rx
        cols |= {name: pa.array(x[dst, i] - qx[src, i], pa.float64()) for i, name in enumerate(offsets)}
        return pa.table(cols | {name: pa.repeat(value, len(src)) for name, value in zip(block, key)})

    return run


NULLS = "_nulls"


def _without_nulls(df: DataFrame, batch: list[str]) -> DataFrame:
    """Batch keys with a stand-in for null, and the set of null ones as a further key."""
    types = {f.name: f.dataType for f in df.schema}
    bits = reduce(lambda a, b: a + b, [F.when(F.col(k).isNull(), 1 << i).otherwise(0) for i, k in enumerate(batch)], F.lit(0))
    filler = {k: F.lit("") if types[k].typeName() == "string" else F.lit(0).cast(types[k]) for k in batch}
    return df.withColumn(NULLS, bits).withColumns({k: F.coalesce(F.col(k), v) for k, v in filler.items()})


def knn_join(
    queries: DataFrame,
    refs: DataFrame,
    k: int,
    batch: list[str],
    coords: list[str] = ("x", "y", "z"),
    query_id: str = "point_id",
    ref_id: str = "point_id",
    with_self: bool = False,
    block_refs: int = BLOCK_REFS,
    block_queries: int = BLOCK_QUERIES,
    src_attrs: dict[str, str] | None = None,
    dst_attrs: dict[str, str] | None = None,
    offsets: list[str] = (),
) -> DataFrame:
    """Edges `(batch…, src, rank, dst, dist2)`: for each query row its k nearest reference rows of
    the same batch, ties by reference id. A batch with fewer than k rows yields fewer edges.

    A null batch key is a batch like another. Rows with a null coordinate are nobody's neighbours and have none.
    `with_self`: queries and references are the same rows, and each row is its own rank 1.
    `src_attrs`, `dst_attrs`: columns of the query and of the reference row that its edges bring along, as name on the
    edge -> column. `offsets`: names for the position of the reference relative to the query, one per coordinate.
    """
    batch, placed = list(batch), reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in coords])
    q, r = (_without_nulls(df.filter(placed), batch) for df in (queries, refs))
    bring = (src_attrs or {}, dst_attrs or {}, list(offsets))
    found = _knn_join(q, r, k, [*batch, NULLS], coords, query_id, ref_id, with_self, block_refs, block_queries, *bring)
    null = {b: F.when(F.col(NULLS).bitwiseAND(F.lit(1 << i)) == 0, F.col(b)) for i, b in enumerate(batch)}
    return found.withColumns(null).drop(NULLS)


def _knn_join(
    queries: DataFrame,
    refs: DataFrame,
    k: int,
    batch: list[str],
    coords: list[str] = ("x", "y", "z"),
    query_id: str = "point_id",
    ref_id: str = "point_id",
    with_self: bool = False,
    block_refs: int = BLOCK_REFS,
    block_queries: int = BLOCK_QUERIES,
    src_attrs: dict[str, str] = {},
    dst_attrs: dict[str, str] = {},
    offsets: list[str] = (),
) -> DataFrame:
    coords, dims = list(coords), len(coords)
    q_cols = sorted({*src_attrs.values(), *(dst_attrs.values() if with_self else ())})
    r_cols = sorted(set(dst_attrs.values()))
    brought = [(n, "src", f"_a_{c}") for n, c in src_attrs.items()] + [(n, "dst", f"_a_{c}") for n, c in dst_attrs.items()]
    q_cols, r_cols = ([F.col(c).alias(f"_a_{c}") for c in cols] for cols in (q_cols, r_cols))
    q = queries.select(*batch, F.col(query_id).alias("_id"), *[F.col(c).cast("double") for c in coords], *q_cols)
    r = refs.select(*batch, F.col(ref_id).alias("_id"), *[F.col(c).cast("double") for c in coords], *r_cols)
    q_cols, r_cols = ([c for c in df.columns if c.startswith("_a_")] for df in (q, r))
    same_place = Window.partitionBy(*batch, *coords).orderBy("_id")
    everywhere = q if with_self else q.select(*batch, *coords).unionByName(r.select(*batch, *coords))
    frame = everywhere.groupBy(*batch).agg(
        *[F.min(c).alias(f"_o_{c}") for c in coords],
        F.greatest(*([F.max(c) - F.min(c) for c in coords] + [F.lit(0.0)])).alias("_side"),
    )
    r = r.withColumn("_copy", F.row_number().over(same_place)).filter(F.col("_copy") <= k).drop("_copy")
    frame = cut_lineage(frame)
    q = _address(q, frame, batch, coords)
    r = cut_lineage(_address(r, frame, batch, coords))
    q = cut_lineage(q)

    qa, ra = [f"q{i}" for i in range(dims)], [f"r{i}" for i in range(dims)]
    deep = min(LEAF, DEPTH)
    leaves = {"q": cut_lineage(_cells(q, batch, coords, deep, "q")), "r": cut_lineage(_cells(r, batch, coords, deep, "r"))}

    def cells(df, depth, tag):
        return _roll_up(leaves[tag], batch, dims, deep - depth, tag) if depth <= deep else _cells(df, batch, coords, depth, tag)

    pairs = cells(q, 0, "q").join(cells(r, 0, "r"), batch)
    settled, depth, distances = [], 0, 0
    while True:
        pairs = cut_lineage(_prune(pairs, batch, dims, k))
        fits = (F.col("_need") <= block_refs) if depth < DEPTH else F.lit(True)
        work = F.sum(F.when(fits, F.col("qn").cast("double") * F.col("rn")))
        some, more, most, work = pairs.agg(F.count_if(fits), F.count_if(~fits), F.max("_need"), work).first()
        distances += work or 0
        if some or not settled and not more:
            settled.append((depth, pairs.filter(fits)))
        if not more:
            crowded = depth == DEPTH and (most or 0) > block_refs
            break
        todo = pairs.filter(~fits).select(*batch, *qa, *ra)
        depth += 1
        qk = _children(cells(q, depth, "q"), todo, batch, dims, "q", depth)
        rk = _children(cells(r, depth, "r"), todo, batch, dims, "r", depth)
        for tag, kids in (("q", qk), ("r", rk)):
            up = [f"_u{tag}{i}" for i in range(dims)]
            kids = kids.select(
                "*", *[F.shiftright(F.col(f"{tag}{i}"), 1).alias(f"_u{tag}{i}") for i in range(dims)]
            )
            todo = todo.withColumnsRenamed({f"{tag}{i}": f"_u{tag}{i}" for i in range(dims)})
            todo = todo.join(kids.drop(*[f"_p{i}" for i in range(dims)]), [*batch, *up])
        pairs = todo.drop(*[f"_u{t}{i}" for t in "qr" for i in range(dims)])

    # A block lies above settled cells, which share most of the reference rows they need.
    blk = [f"_b{i}" for i in range(dims)]
    block = [*batch, "_depth", *blk, "_part", "_chunk"]
    q_side, r_side = [], []
    for d, pairs in settled:
        up = [F.shiftright(F.col(f"q{i}"), min(BLOCK_UP, d)).alias(f"_b{i}") for i in range(dims)]
        pairs = pairs.withColumn("_depth", F.lit(d)).select("*", *up)
        cell = [*batch, *qa]
        load = pairs.select(*cell, "_depth", *blk, "qn").distinct()
        parts = load.groupBy(*batch, "_depth", *blk).agg(
            F.ceil(F.sum("qn") / F.lit(block_queries)).cast("int").alias("_parts")
        )
        need = pairs.select(*batch, "_depth", *blk, *ra, "rn").distinct()
        if crowded and d == DEPTH:
            chunks = F.ceil(F.sum("rn") / F.lit(block_refs)).cast("int").alias("_chunks")
            parts = parts.join(need.groupBy(*batch, "_depth", *blk).agg(chunks), [*batch, "_depth", *blk])
        else:
            parts = parts.withColumn("_chunks", F.lit(1))
        load = load.drop("qn").join(parts, [*batch, "_depth", *blk])
        at = [F.shiftright(F.col(CELLS[i]), DEPTH - d).alias(f"q{i}") for i in range(dims)]
        mine = q.select(*batch, "_id", *q_cols, *[F.col(c).alias(f"_x{i}") for i, c in enumerate(coords)], *at)
        mine = _join_cells(mine, load, cell).withColumn("_part", F.pmod(F.xxhash64("_id"), F.col("_parts")).cast("int"))
        mine = mine.withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)))
        q_side.append(mine.select(*block, "_id", *[f"_x{i}" for i in range(dims)], *q_cols))
        need = need.drop("rn").join(parts, [*batch, "_depth", *blk])
        need = need.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
        at = [F.shiftright(F.col(CELLS[i]), DEPTH - d).alias(f"r{i}") for i in range(dims)]
        theirs = r.select(*batch, "_id", *r_cols, *[F.col(c).alias(f"_x{i}") for i, c in enumerate(coords)], *at)
        theirs = _join_cells(theirs, need, [*batch, *ra])
        theirs = theirs.withColumn("_chunk", F.pmod(F.xxhash64("_id"), F.col("_chunks")).cast("int"))
        r_side.append(theirs.select(*block, "_id", *[f"_x{i}" for i in range(dims)], *r_cols))
    union = lambda parts: reduce(DataFrame.unionByName, parts)
    q_blocks, r_blocks = union(q_side), union(r_side)
    r_block = [f"_ref{b}" for b in block]
    r_blocks = r_blocks.toDF(*r_block, *r_blocks.columns[len(block) :])
    fields = [T.StructField("_src", q.schema["_id"].dataType), T.StructField("_rank", T.IntegerType())]
    fields += [T.StructField("_dst", r.schema["_id"].dataType), T.StructField("_d2", T.DoubleType())]
    fields += [T.StructField(n, (q if side == "src" else r).schema[c].dataType) for n, side, c in brought]
    fields += [T.StructField(n, T.DoubleType()) for n in offsets]
    fields += [q_blocks.schema[b] for b in block]
    extra = [*[n for n, _, _ in brought], *offsets]
    # as many partitions as the pairs in reach ask for: adaptive execution would merge them by bytes, but a
    # block costs far more time than its bytes suggest
    n = max(1, math.ceil(distances / PART_DISTANCES))
    q_blocks, r_blocks = q_blocks.repartition(n, *block), r_blocks.repartition(n, *r_block)
    edges = (
        q_blocks.groupBy(*block)
        .cogroup(r_blocks.groupBy(*r_block))
        .applyInArrow(_nearest_in_block(k, dims, with_self, block, brought, offsets), T.StructType(fields))
    )
    if crowded:
        best = Window.partitionBy(*batch, "_src").orderBy((F.col("_src") != F.col("_dst")) if with_self else F.lit(0), "_d2", "_dst")
        edges = edges.select(*batch, "_src", "_dst", "_d2", *extra).dropDuplicates([*batch, "_src", "_dst", "_d2"])
        edges = edges.withColumn("_rank", F.row_number().over(best)).filter(F.col("_rank") <= k)
    return edges.select(
        *batch,
        F.col("_src").alias("src"),
        F.col("_rank").alias("rank"),
        F.col("_dst").alias("dst"),
        F.col("_d2").alias("dist2"),
        *extra,
    )


def knn_self(points, k, batch, coords=("x", "y", "z"), id_col="point_id", **kw) -> DataFrame:
    """k nearest rows of the same batch; the row itself is rank 1."""
    return knn_join(points, points, k, batch, coords, id_col, id_col, with_self=True, **kw)


def inverse_distance(edges: DataFrame, values: DataFrame, batch, value: str, ref_id="point_id", out="value"):
    """Mean of the neighbours' values weighted by 1/(distance + 1e-8)."""
    v = values.select(*batch, F.col(ref_id).alias("dst"), F.col(value).alias("_v"))
    return _inverse_distance(join_rows(edges, v, [*batch, "dst"], "inner"), batch, out)


def _inverse_distance(valued, batch, out):
    w = F.lit(1.0) / (F.sqrt("dist2") + F.lit(1e-8))
    return valued.groupBy(*batch, "src").agg((F.sum(w * F.col("_v")) / F.sum(w)).alias(out))


def knn_idw(queries, refs, value, batch, coords=("x", "y"), k=3, query_id="point_id", ref_id="point_id", out="value", **kw):
    """Interpolates `value` of the reference rows at the query rows."""
    valued = knn_join(queries, refs, k, batch, coords, query_id, ref_id, dst_attrs={"_v": value}, **kw)
    return _inverse_distance(valued, batch, out)


def gather_neighbours(edges, points, batch, attrs, coords=None, id_col="point_id") -> DataFrame:
    """Attributes of the neighbour on each edge; with `coords` also its position relative to src."""
    coords = list(coords or [])
    dst = points.select(
        *batch, F.col(id_col).alias("dst"), *attrs, *[F.col(c).alias(f"_n_{c}") for c in coords]
    )
    out = join_rows(edges, dst, [*batch, "dst"], "inner")
    if coords:
        src = points.select(*batch, F.col(id_col).alias("src"), *[F.col(c).alias(f"_s_{c}") for c in coords])
        out = join_rows(out, src, [*batch, "src"], "inner")
        out = out.withColumns({f"d{c}": F.col(f"_n_{c}") - F.col(f"_s_{c}") for c in coords})
        out = out.drop(*[f"_{t}_{c}" for t in "ns" for c in coords])
    return out


def knn_gather(points, k, batch, attrs=(), coords=("x", "y", "z"), id_col="point_id", offsets=False, **kw) -> DataFrame:
    """The edges of `knn_self` with attributes of the neighbour, and with `offsets` its position relative to src as d{coord}.

    What `gather_neighbours` gives on these edges, without a join of the edges to the points.
    """
    near = [f"d{c}" for c in coords] if offsets else []
    return knn_self(points, k, batch, coords, id_col, dst_attrs={a: a for a in attrs}, offsets=near, **kw)


def topk_neighbours(edges: DataFrame, batch, k: int) -> DataFrame:
    """First k edges of each source by distance, ties by id; the window limit runs before the shuffle."""
    w = Window.partitionBy(*batch, "src").orderBy("dist2", "dst")
    return edges.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def fourier_features(rel: DataFrame, bands: int, src_cols=("dx", "dy", "dz")) -> DataFrame:
    """Position encoding of an edge: offsets, distance, then sin/cos of pi*2^i times the planar
    offsets and of the height offset: 4 + 6 * bands values."""
    dx, dy, dz = (F.col(c) for c in src_cols)
    cols = [dx, dy, dz, F.sqrt(dx * dx + dy * dy + dz * dz)]
    freqs = [F.lit(math.pi * 2**i) for i in range(bands)]
    for f in freqs:
        cols += [F.sin(dx * f), F.sin(dy * f), F.cos(dx * f), F.cos(dy * f)]
    for f in freqs:
        cols += [F.sin(dz * f), F.cos(dz * f)]
    return rel.withColumn("encoding", F.array(*cols))
