"""Hard-negative mining by angular triangle filtering.

The angle between two vectors lies between the difference and the sum of their angles to any third direction. Angles to a
few reference directions are stored once; intervals of them, taken over a block of rows, give an interval for the cosine of
an anchor with any row of the block, and with the norms an interval for the score, widened by more than rounding can
be wrong. Only blocks whose interval overlaps what an anchor still looks for are scored, in integers.

1. rows are sorted across the cluster by label, nearest reference and angle to it, and packed into blocks of one label,
   some blocks to a part;
2. an anchor is scored in its own part first. What it finds there bounds from below what other parts must offer, and it
   goes only to parts that may: to rows of its label for positives, to the others for negatives;
3. parts return the best few of each anchor (and window of scores), and windowed ranks merge them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloudloom.llm.tables import thin
from cloudloom.session import cut_lineage

REFERENCES, SAMPLE = 8, 1024  # directions, and rows of the sample that they are chosen from
BLOCK_ROWS, ANCHOR_ROWS = 512, 8192  # rows scored at once, anchors that meet a part at once
PART_ROWS, PARTS = (4096, 65536), 256  # rows of a part, least and most; parts wanted between the two
MAX_PARTS = 1 << 16  # beyond, parts grow: their intervals go to every task
SLACK = 1e-4  # radians, far more than rounding of stored angles
EXACT = 1 << 53
NO_ID = (1 << 63) - 1  # stands for null, and is last among equals
NONE = -(1 << 63) + 1  # no score
_TYPES = (np.int16, np.int32, np.int64)


def usable(vector: Column) -> Column:
    """True if the vector and all its components are there and finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column, shorter ones filled with 0."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(column), dim))
    out[np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


def references(sample: np.ndarray, k: int = REFERENCES) -> np.ndarray:
    """`k` unit directions (fewer if there are not so many), each as far as can be from those before it."""
    size = np.sqrt((sample**2).sum(1))
    unit = sample[size > 0] / size[size > 0, None]
    if not len(unit):
        return np.zeros((0, sample.shape[1]))
    mean = unit.mean(0)
    picked = [mean / np.sqrt(mean @ mean) if mean @ mean > 1e-12 else unit[0]]
    nearest = unit @ picked[0]
    while len(picked) < min(k, len(unit)):
        i = int(np.argmin(nearest))
        picked.append(unit[i])
        nearest = np.maximum(nearest, unit @ unit[i])
    return np.array(picked)


def angles_to(vectors: np.ndarray, norms: np.ndarray, refs: np.ndarray) -> np.ndarray:
    cos = vectors @ refs.T / np.where(norms > 0, norms, 1)[:, None]
    return np.arccos(np.clip(cos, -1, 1))


def score_bounds(norm, angle, norm_low, norm_high, angle_low, angle_high):
    """Least and largest score of each anchor (rows) with any row of each block (columns), by the triangle of angles."""
    a = angle[:, None, :]
    if a.shape[2]:
        gap = np.maximum(0, np.maximum(angle_low - a, a - angle_high)).max(2) - SLACK
        wide = np.minimum(a + angle_high, 2 * math.pi - a - angle_low).min(2) + SLACK
    else:
        gap, wide = np.zeros((len(norm), len(norm_low))), np.full((len(norm), len(norm_low)), math.pi)
    most, least = np.cos(np.maximum(gap, 0)), np.cos(np.minimum(wide, math.pi))
    top = np.where(most > 0, norm_high, norm_low) * most * norm[:, None]
    low = np.where(least > 0, norm_low, norm_high) * least * norm[:, None]
    safe = 1 + 1e-9 * norm[:, None] * norm_high
    return low - safe, top + safe


def best_of(score, ids, wanted, k, largest):
    """The `k` highest wanted scores of each row, ties by smaller id (columns come in order of ids): (rows, scores, ids)."""
    rows = np.flatnonzero(wanted.any(1))
    score, wanted = score[rows], wanted[rows]
    width = score.shape[1]
    if width > k:
        if largest < EXACT >> 12:  # score and column fit one number
            key = np.where(wanted, score * width + np.arange(width - 1, -1, -1), NONE)
            at = np.argpartition(-key, k - 1, axis=1)[:, :k]
        else:
            at = np.argsort(np.where(wanted, -score, NO_ID), axis=1, kind="stable")[:, :k]
    else:
        at = np.broadcast_to(np.arange(width), score.shape)
    there = np.take_along_axis(wanted, at, 1)
    return rows, np.where(there, np.take_along_axis(score, at, 1), NONE), np.where(there, ids[at], NO_ID)


def merge(scores, ids, rows, more_scores, more_ids):
    """Puts further finds of some rows into the sorted lists of the best."""
    k = scores.shape[1]
    s, i = np.concatenate([scores[rows], more_scores], 1), np.concatenate([ids[rows], more_ids], 1)
    order = np.argsort(i, axis=1, kind="stable")
    s, i = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
    order = np.argsort(-s, axis=1, kind="stable")[:, :k]
    scores[rows], ids[rows] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)


class Anchors:
    """Columns of a table of anchors as arrays."""

    def __init__(self, table, dim: int):
        self.row, self.part = table["row"].to_numpy(), table["part"].to_numpy()
        self.label = np.array(table["label"].to_pylist())
        self.vector = _vectors(table["vector"].to_pylist(), dim)
        self.norm = table["norm"].to_numpy()
        self.angle = _grid(table["angle"], np.float64)


class Block:
    """Rows of one label, in order of ids."""

    def __init__(self, row: dict, dim: int):
        self.part, self.first, self.label = row["part"], row["first"], row["label"]
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.vector = _vectors([row["vectors"]], dim, len(self.ids))
        self.anchor = np.frombuffer(row["anchor"], np.uint8).astype(bool)
        self.norm_low, self.norm_high = row["norm_low"], row["norm_high"]
        self.angle_low, self.angle_high = np.array(row["angle_low"], np.float64), np.array(row["angle_high"], np.float64)

    def row(self) -> np.ndarray:
        return _row(self.part, self.first + np.arange(len(self.ids)))


def _row(part: int, place):
    return (np.int64(part) << 40) + place


def _vectors(packed: list[bytes], dim: int, rows: int | None = None) -> np.ndarray:
    """Vectors from bytes of the integer type that their length tells."""
    rows = len(packed) if rows is None else rows
    data = b"".join(packed)
    kind = {2: np.int16, 4: np.int32, 8: np.int64}[len(data) // (rows * dim)] if rows * dim else np.int16
    return np.frombuffer(data, kind).reshape(rows, dim)


def search(anchors: Anchors, blocks: list[Block], same: bool, lows, highs, scores, ids, largest: int):
    """Improves the lists `scores` and `ids` (anchor, window, place) by the rows of `blocks`.

    Wanted are rows of the anchor's label (`same`) or of another, and of each window of scores `lows` to `highs`
    the best. Blocks whose bounds leave no place in any window are not scored.
    """
    if not blocks or not len(anchors.row):
        return
    low, top = score_bounds(
        anchors.norm, anchors.angle, np.array([b.norm_low for b in blocks]), np.array([b.norm_high for b in blocks]),
        np.array([b.angle_low for b in blocks]), np.array([b.angle_high for b in blocks]),
    )
    kind = np.float64 if largest < EXACT else np.int64  # floating point is exact, and fast, while no partial sum can pass 2^53
    vector = anchors.vector.astype(kind)
    for j, block in enumerate(blocks):
        least = np.maximum(lows, scores[:, :, -1])
        open_ = (top[:, j, None] >= least) & (low[:, j, None] <= highs) & (lows <= highs)
        here = np.flatnonzero(open_.any(1) & ((anchors.label == block.label) == same))
        if not len(here):
            continue
        score = (vector[here] @ block.vector.T.astype(kind)).astype(np.int64)
        other = np.ones(score.shape, bool)
        if same:
            mine = anchors.row[here] - _row(block.part, block.first)
            inside = np.flatnonzero((mine >= 0) & (mine < len(block.ids)))
            other[inside, mine[inside]] = False
        for w in range(lows.shape[1]):
            wanted = other & (score >= least[here, w, None]) & (score <= highs[here, w, None])
            if wanted.any():
                rows, s, i = best_of(score, block.ids, wanted, scores.shape[2], largest)
                merge(scores[:, w], ids[:, w], here[rows], s, i)


def _grid(column, kind) -> np.ndarray:
    """A column of lists of one length as a matrix."""
    rows = column.to_pylist()
    return np.array(rows, kind).reshape(len(rows), -1) if rows else np.zeros((0, 1), kind)


def _empty(n: int, windows: int, k: int):
    return np.full((n, windows, k), NONE, np.int64), np.full((n, windows, k), NO_ID, np.int64)


def _place(dim: int, refs: np.ndarray, kind, label_type: pa.DataType):
    """Vectors as bytes, with the nearest reference and the angle to it."""
    schema = pa.schema([("id", pa.int64()), ("label", label_type), ("anchor", pa.bool_()), ("vector", pa.binary()), ("cell", pa.int32()), ("angle", pa.float64())])

    def fn(batches):
        for batch in batches:
            q = _matrix(batch.column("q"), dim)
            angle = angles_to(q, np.sqrt((q**2).sum(1)), refs)
            cell = angle.argmin(1) if len(refs) else np.zeros(len(q), np.int64)
            near = angle[np.arange(len(q)), cell] if len(refs) else np.zeros(len(q))
            packed = [v.tobytes() for v in q.astype(kind)]
            columns = [batch.column("id"), batch.column("label"), batch.column("anchor"), pa.array(packed, pa.binary()), pa.array(cell, pa.int32()), pa.array(near)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return fn


def _pack(dim: int, refs: np.ndarray, label_type: pa.DataType):
    """Sorted rows of a part as blocks of one label."""
    doubles = pa.list_(pa.float64())
    schema = pa.schema(
        [("part", pa.int32()), ("first", pa.int64()), ("label", label_type), ("ids", pa.binary()), ("vectors", pa.binary()), ("anchor", pa.binary()),
         ("norm_low", pa.float64()), ("norm_high", pa.float64()), ("angle_low", doubles), ("angle_high", doubles)]
    )

    def fn(batches):
        done = 0
        for batch in batches:
            labels, parts = batch.column("label").to_pylist(), batch.column("part").to_pylist()
            packed, ids = batch.column("vector").to_pylist(), batch.column("id").to_numpy()
            anchor = batch.column("anchor").to_numpy(zero_copy_only=False)
            out, start = [], 0
            while start < len(labels):
                end = start + 1
                while end < len(labels) and end - start < BLOCK_ROWS and labels[end] == labels[start]:
                    end += 1
                order = start + np.argsort(ids[start:end], kind="stable")
                v = _vectors([packed[i] for i in order], dim)
                exact = v.astype(np.float64)
                norms = np.sqrt((exact**2).sum(1))
                angle = angles_to(exact, norms, refs)
                out.append(
                    {"part": parts[start], "first": done + start, "label": labels[start], "ids": ids[order].tobytes(), "vectors": v.tobytes(),
                     "anchor": anchor[order].astype(np.uint8).tobytes(), "norm_low": float(norms.min()), "norm_high": float(norms.max()),
                     "angle_low": angle.min(0).tolist(), "angle_high": angle.max(0).tolist()}
                )
                start = end
            done += len(labels)
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return fn


def _home(dim: int, refs: np.ndarray, label_type: pa.DataType, k: int, largest: int):
    """The anchors of a part, each with its best positives there."""
    longs, doubles = pa.list_(pa.int64()), pa.list_(pa.float64())
    schema = pa.schema(
        [("row", pa.int64()), ("id", pa.int64()), ("label", label_type), ("part", pa.int32()), ("vector", pa.binary()), ("norm", pa.float64()),
         ("angle", doubles), ("scores", longs), ("ids", longs)]
    )

    def fn(batches):
        blocks = [Block(r, dim) for batch in batches for r in batch.to_pylist()]
        for own in blocks:  # at most BLOCK_ROWS anchors at a time
            at = np.flatnonzero(own.anchor)
            if not len(at):
                continue
            v = own.vector[at]
            norm = np.sqrt((v.astype(np.float64) ** 2).sum(1))
            rows = {
                "row": own.row()[at], "id": own.ids[at], "label": pa.array([own.label] * len(at), label_type), "part": np.full(len(at), own.part, np.int32),
                "vector": pa.array([x.tobytes() for x in v], pa.binary()), "norm": norm, "angle": pa.array(angles_to(v.astype(np.float64), norm, refs).tolist(), doubles),
            }
            scores, ids = _empty(len(at), 1, k)
            lows, highs = np.full((len(at), 1), NONE, np.int64), np.full((len(at), 1), NO_ID, np.int64)
            search(Anchors(pa.table(rows), dim), [b for b in blocks if b.part == own.part], True, lows, highs, scores, ids, largest)
            rows["scores"], rows["ids"] = pa.array(scores[:, 0].tolist(), longs), pa.array(ids[:, 0].tolist(), longs)
            yield from pa.table(rows, schema=schema).to_batches()

    return fn


class Parts:
    """Intervals of every part."""

    def __init__(self, rows: list, n_refs: int):
        self.part = np.array([r["part"] for r in rows], np.int32)
        self.label = np.array([r["label_low"] for r in rows]), np.array([r["label_high"] for r in rows])
        self.norm = np.array([r["norm_low"] for r in rows]), np.array([r["norm_high"] for r in rows])
        self.angle = tuple(np.array([[r[f"{end}{k}"] for k in range(n_refs)] for r in rows], np.float64).reshape(len(rows), -1) for end in ("low", "high"))


def _targets(parts: Parts, same: bool, dim: int):
    """Sends anchors to the parts that may hold what they look for; of their label, not to their own part again."""

    def fn(batches):
        for batch in batches:
            if not len(batch):
                continue
            a = Anchors(batch, dim)
            lows, highs = _grid(batch.column("lows"), np.int64), _grid(batch.column("highs"), np.int64)
            low, top = score_bounds(a.norm, a.angle, *parts.norm, *parts.angle)
            may = ((top[:, :, None] >= lows[:, None]) & (low[:, :, None] <= highs[:, None]) & (lows <= highs)[:, None]).any(2)
            label = a.label[:, None]
            if same:
                may &= (label >= parts.label[0]) & (label <= parts.label[1]) & (a.part[:, None] != parts.part)
            else:
                may &= (label != parts.label[0]) | (label != parts.label[1])
            for at in np.array_split(np.arange(len(a.row)), max(1, len(a.row) // 256)):
                i, j = np.nonzero(may[at])
                table = batch.take(pa.array(at[i]))
                yield pa.RecordBatch.from_arrays([pa.array(parts.part[j]), *table.columns], ["target", *table.schema.names])

    return fn


def _visit(dim: int, same: bool, k: int, largest: int):
    """Anchors that meet a part: the best of each window there, as (row, slot, score, id)."""

    def fn(left: pa.Table, right: pa.Table) -> pa.Table:
        n = left.num_rows
        lows, highs = _grid(left["lows"], np.int64), _grid(left["highs"], np.int64)
        scores, ids = _empty(n, lows.shape[1], k)
        if n and right.num_rows:
            search(Anchors(left, dim), [Block(r, dim) for r in right.to_pylist()], same, lows, highs, scores, ids, largest)
        i, w, p = np.nonzero(scores != NONE)
        row = left["row"].to_numpy()[i]
        return pa.table({"row": row, "slot": w.astype(np.int32), "score": scores[i, w, p], "id": ids[i, w, p]})

    return fn


_FOUND = "row long, slot int, score long, id long"


def _best(found: DataFrame, k: int) -> DataFrame:
    """The first `k` of each anchor and slot, with rank."""
    order = Window.partitionBy("row", "slot").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine_hard_negatives(
    vectors: DataFrame,
    anchor: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    scale: int = 256,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    part_rows: int | None = None,
) -> DataFrame:
    """For each row where `anchor` holds and each of its positives: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A component x counts as floor(scale * x); a score is the inner product of an anchor and a row, in integers. Positives are
    the first `positives` other rows of the anchor's label, negatives of a positive the first `negatives` rows of another
    label with low * positive_score <= 100 * negative_score <= high * positive_score. Higher scores come first, then smaller
    ids. Rows with a null label or vector, or with a component that is null or not finite, take no part. A null id is last
    among equal scores; `anchor` null is false. Repeated rows are rows of their own. Shorter vectors count as filled with 0.
    Vectors that may score 2^56 or more are an error. No rows, or no anchors, give no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    q = F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * scale).cast("double"))
    ident = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    base = vectors.filter(usable(F.col(vector_col)) & F.col(label_col).isNotNull()).select(
        ident.alias("id"), F.col(label_col).alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), q.alias("q")
    )
    size = F.aggregate("q", F.lit(0.0), lambda s, x: s + x * x)
    facts = base.agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("anchor"), 1)).alias("anchors"), F.max(F.size("q")).alias("dim"),
        F.max(F.array_max(F.transform("q", F.abs))).alias("widest"), F.max(size).alias("largest"),
    ).first()
    if not facts["anchors"]:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    if facts["largest"] >= 2.0**56:
        raise ValueError("hundred times a score may not fit 64 bits")
    dim, largest = facts["dim"], int(facts["largest"])
    kind = next(t for t in _TYPES if (facts["widest"] or 0) < np.iinfo(t).max)
    label = base.schema["label"].dataType.simpleString()
    label_type = pa.Table.from_pylist([], schema=base.select("label").limit(0).toArrow().schema).schema.field(0).type

    picked = thin(base, F.xxhash64("id", "label"), SAMPLE, margin=2).orderBy(F.xxhash64("id", "label")).limit(SAMPLE).select("q").toArrow()
    refs = references(_matrix(picked["q"], dim))
    rows = part_rows or max(PART_ROWS[0], min(PART_ROWS[1], facts["n"] // PARTS), facts["n"] // MAX_PARTS)
    placed = base.mapInArrow(_place(dim, refs, kind, label_type), f"id long, label {label}, anchor boolean, vector binary, cell int, angle double")
    placed = placed.repartitionByRange(math.ceil(facts["n"] / rows), "label", "cell", "angle", "id").sortWithinPartitions("label", "cell", "angle", "id")
    blocks = "part int, first long, label {}, ids binary, vectors binary, anchor binary, norm_low double, norm_high double, angle_low array<double>, angle_high array<double>"
    blocks = cut_lineage(placed.withColumn("part", F.spark_partition_id()).mapInArrow(_pack(dim, refs, label_type), blocks.format(label)))

    ends = [F.min(F.get("angle_low", F.lit(k))).alias(f"low{k}") for k in range(len(refs))] + [F.max(F.get("angle_high", F.lit(k))).alias(f"high{k}") for k in range(len(refs))]
    spans = blocks.groupBy("part").agg(
        F.min("label").alias("label_low"), F.max("label").alias("label_high"), F.min("norm_low").alias("norm_low"), F.max("norm_high").alias("norm_high"), *ends
    )
    parts = Parts(spans.orderBy("part").collect(), len(refs))  # at most MAX_PARTS rows of numbers
    shape = f"row long, id long, label {label}, part int, vector binary, norm double, angle array<double>"
    anchors = cut_lineage(blocks.mapInArrow(_home(dim, refs, label_type, positives, largest), f"{shape}, scores array<long>, ids array<long>"))

    chunks = math.ceil(facts["anchors"] / ANCHOR_ROWS)
    dealt = blocks.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))

    def visit(asking: DataFrame, same: bool, k: int) -> DataFrame:
        asking = asking.select("row", "id", "label", "part", "vector", "norm", "angle", "lows", "highs")
        sent = asking.mapInArrow(_targets(parts, same, dim), f"target int, {shape}, lows array<long>, highs array<long>")
        sent = sent.withColumn("chunk", F.pmod(F.xxhash64("row"), F.lit(chunks)).cast("int"))
        return sent.groupBy("target", "chunk").cogroup(dealt.groupBy("part", "chunk")).applyInArrow(_visit(dim, same, k, largest), _FOUND)

    lows = F.array(F.element_at("scores", -1))
    elsewhere = visit(anchors.withColumns({"lows": lows, "highs": F.array(F.lit(NO_ID))}), True, positives)
    at_home = anchors.select("row", F.lit(0).alias("slot"), F.explode(F.arrays_zip("scores", "ids")).alias("x"))
    at_home = at_home.select("row", "slot", F.col("x.scores").alias("score"), F.col("x.ids").alias("id")).filter(F.col("score") != NONE)
    first = cut_lineage(_best(at_home.union(elsewhere), positives))

    # div cuts towards zero: bounds of the windows, rounded inwards
    hundredth = lambda x: F.call_function("div", x, F.lit(100).cast("long"))
    lower, upper = F.col("score") * low, F.col("score") * high
    up = hundredth(lower + F.when(lower > 0, 99).otherwise(0))
    down = hundredth(upper - F.when(upper < 0, 99).otherwise(0))
    by_rank = F.sort_array(F.collect_list(F.struct("rank", up.alias("low"), down.alias("high"))))
    windows = first.groupBy("row").agg(by_rank.alias("w"))
    empty = positives - F.size("w")
    asking = anchors.join(windows, "row").withColumns(
        {
            "lows": F.concat(F.transform("w", lambda x: x["low"]), F.array_repeat(F.lit(1).cast("long"), empty)),
            "highs": F.concat(F.transform("w", lambda x: x["high"]), F.array_repeat(F.lit(0).cast("long"), empty)),
        }
    )
    found = _best(visit(asking, False, negatives), negatives)
    named = first.select("row", (F.col("rank") - 1).alias("slot"), F.col("id").alias("positive"), F.col("score").alias("positive_score"))
    named = named.join(anchors.select("row", F.col("id").alias("anchor_id")), "row")
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return found.join(named, ["row", "slot"]).select(
        real("anchor_id").alias("anchor_id"), real("positive").alias("positive_id"), "rank", real("id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )
