"""Registry of named queries with their DuckDB twins, and the SQL pieces the twins share."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudloom.fixtures import CLASSES, LOGIT_EXPRS, POINT_EXPRS, RUN_EXPRS, TELEMETRY_EXPRS, Tables
from cloudloom.functions.seeded import MULT, PRIME
from cloudloom.operators import tiling, voxels
from cloudloom.operators.augment import tag
from cloudloom.schemas import TILE

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
WINDOW, GRID = (256.0, 256.0), 32.0
MAPPING = list(range(1, CLASSES + 1))
T = ", ".join(TILE)


def query(name: str, sql: str | None = None):
    """Registers `fn(tables) -> DataFrame` under `name`."""

    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def out(df: DataFrame, *cols) -> DataFrame:
    """The named columns; floating point rounded to 6 digits, minus zero made zero."""
    df = df.select(*cols) if cols else df
    keep = []
    for f in df.schema:
        if f.dataType.typeName() in ("double", "float"):
            keep.append((F.round(F.col(f.name).cast("double"), 6) + F.lit(0.0)).alias(f.name))
        else:
            keep.append(F.col(f.name))
    return df.select(*keep)


def sql(ctes: str, body: str, plain: str, dbl: str = "", recursive=False) -> str:
    """The twin of `out`: `plain` columns as they are, `dbl` columns rounded."""
    cols = plain.split() + [f"round({c}, 6) + 0e0 AS {c}" for c in dbl.split()]
    head = f"WITH {'RECURSIVE ' if recursive else ''}{ctes} " if ctes else ""
    return f"{head}SELECT {', '.join(cols)} FROM ({body}) AS _q"


def cte(*parts) -> str:
    return ", ".join(p for p in parts if p)


def _exprs(exprs):
    return ", ".join(f"{e} AS {n}" for n, e in exprs.items())


# --- shared views ---------------------------------------------------------------------------
PTS = f"pts AS (SELECT {_exprs(POINT_EXPRS)} FROM orders)"
ORG = "org AS (SELECT file_id, min(x) AS x0, min(y) AS y0 FROM pts GROUP BY file_id)"


def tp_cte(window=WINDOW[0], name="tp"):
    return (
        f"{name} AS (SELECT pts.*, CAST(0 AS INTEGER) AS pass_id, CAST(floor((x - x0) / {window}e0) AS BIGINT) AS xb, "
        f"CAST(floor((y - y0) / {window}e0) AS BIGINT) AS yb FROM pts JOIN org USING (file_id))"
    )


TP = cte(PTS, ORG, tp_cte())


def vx_cte(grid=GRID, src="tp", name="vx"):
    cells = ", ".join(
        f"CAST(floor(({c} - min({c}) OVER (PARTITION BY {T})) / {grid}e0) AS BIGINT) AS v{c}" for c in "xyz"
    )
    return f"{name} AS (SELECT *, {cells} FROM {src})"


VX = cte(TP, vx_cte())
V = f"{T}, vx, vy, vz"
IX = cte(
    VX,
    f"ix AS (SELECT *, row_number() OVER (PARTITION BY {V} ORDER BY point_id) - 1 AS voxel_rank, "
    f"count(*) OVER (PARTITION BY {V}) AS voxel_n FROM vx)",
)
TILES = cte(
    VX,
    f"vt AS (SELECT {V}, count(*) AS n FROM vx GROUP BY {V})",
    f"tiles AS (SELECT {T}, CAST(sum(n) AS BIGINT) AS num_points, count(*) AS num_voxels, max(n) AS max_voxel_density FROM vt GROUP BY {T})",
)
SEG = f"seg AS (SELECT *, CAST(dense_rank() OVER (PARTITION BY file_id ORDER BY pass_id, xb, yb) - 1 AS BIGINT) AS segment_id FROM tp)"
PRD = cte(
    PTS,
    "prk AS (SELECT *, unnest(range(0, point_id % 3 + 1)) AS k FROM pts WHERE point_id % 7 <> 0)",
    f"prd AS (SELECT file_id, point_id, point_id % 5 AS segment_id, CAST(k AS INTEGER) AS loop_idx, point_id % 97 AS batch_id, "
    f"[{', '.join(LOGIT_EXPRS)}] AS logits, CASE WHEN classification = 0 THEN -1 ELSE classification - 1 END AS target FROM prk)",
)
C = range(CLASSES)
SM = cte(
    PRD,
    "prw AS (SELECT *, list_max(logits) AS mx, " + ", ".join(f"logits[{c + 1}] AS l{c}" for c in C) + " FROM prd)",
    "prs AS (SELECT *, " + " + ".join(f"exp(l{c} - mx)" for c in C) + " AS se FROM prw)",
    "sm AS (SELECT *, "
    + ", ".join(f"exp(l{c} - mx) / se AS p{c}, l{c} - (mx + ln(se)) AS q{c}" for c in C)
    + ", CAST(list_position(logits, mx) - 1 AS INTEGER) AS pred FROM prs)",
)
CM = cte(SM, "cm AS (SELECT target, pred, count(*) AS n FROM sm WHERE target <> -1 GROUP BY target, pred)")
PER = cte(
    CM,
    f"cls AS (SELECT CAST(unnest(range(0, {CLASSES})) AS INTEGER) AS class)",
    "tpf AS (SELECT class, CAST(coalesce(sum(n) FILTER (WHERE target = class AND pred = class), 0) AS BIGINT) AS tp, "
    "CAST(coalesce(sum(n) FILTER (WHERE target <> class AND pred = class), 0) AS BIGINT) AS fp, "
    "CAST(coalesce(sum(n) FILTER (WHERE target = class AND pred <> class), 0) AS BIGINT) AS fn FROM cls CROSS JOIN cm GROUP BY class)",
    "per0 AS (SELECT *, tp / (tp + fp + fn + 1e-10) AS iou, tp / (tp + fp + 1e-10) AS precision, tp / (tp + fn + 1e-10) AS recall FROM tpf)",
    "per AS (SELECT *, 2 * precision * recall / (precision + recall + 1e-10) AS f1, concat('Class ', class + 1) AS name FROM per0)",
)
SMP = (
    "smp AS (SELECT o_custkey AS sample_id, o_custkey % 2 AS file_id, count(*) AS num_points, "
    "(o_custkey % 7 + 1) / 8e0 AS weight FROM orders GROUP BY o_custkey)"
)
TEL = (
    f"tl0 AS (SELECT {_exprs(TELEMETRY_EXPRS)} FROM events), "
    "tel AS (SELECT *, row_number() OVER (PARTITION BY run, stage ORDER BY ts, event_id) - 1 AS i FROM tl0)"
)
RUN = f"runs AS (SELECT {_exprs(RUN_EXPRS)} FROM events)"
FEA = (
    "fea AS (SELECT vec_id AS point_id, vec_id % 4 AS batch_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, "
    "CAST(embedding[3] AS DOUBLE) AS z, label, CAST(embedding AS DOUBLE[]) AS feature FROM embeddings)"
)
PACK_LIMIT = 50
PACK = cte(
    SMP,
    "sn AS (SELECT *, row_number() OVER (ORDER BY sample_id) AS rn FROM smp)",
    "pk0 AS (SELECT rn, num_points AS held, CAST(0 AS BIGINT) AS batch_id FROM sn WHERE rn = 1 UNION ALL "
    f"SELECT sn.rn, CASE WHEN pk0.held + sn.num_points <= {PACK_LIMIT} THEN pk0.held + sn.num_points ELSE sn.num_points END, "
    f"CASE WHEN pk0.held + sn.num_points <= {PACK_LIMIT} THEN pk0.batch_id ELSE pk0.batch_id + 1 END "
    "FROM pk0 JOIN sn ON sn.rn = pk0.rn + 1)",
    "pk AS (SELECT sn.*, pk0.batch_id FROM pk0 JOIN sn USING (rn))",
)
KNN_K = 8


def knn_cte(src, batch, k, name="knn", ref=None, coords="xyz", qid="point_id", rid="point_id"):
    """Brute force over all pairs of a batch, self first, ties by id."""
    d2 = " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in coords)
    on = " AND ".join(f"a.{b} = b.{b}" for b in batch)
    keys = ", ".join(f"a.{b} AS {b}" for b in batch)
    part = ", ".join(f"a.{b}" for b in batch)
    me = "CASE WHEN a.{0} = b.{0} THEN 0 ELSE 1 END, ".format(qid) if ref is None else ""
    return (
        f"{name} AS (SELECT {keys}, a.{qid} AS src, b.{rid} AS dst, {d2} AS dist2, "
        f"CAST(row_number() OVER (PARTITION BY {part}, a.{qid} ORDER BY {me}{d2}, b.{rid}) AS INTEGER) AS rank "
        f"FROM {src} a JOIN {ref or src} b ON {on} QUALIFY rank <= {k})"
    )


# --- seeded draws ---------------------------------------------------------------------------
def hash_sql(seed, *keys):
    h = f"CAST({int(seed) % PRIME} AS BIGINT)"
    for k in keys:
        h = f"(({h} * 31 + CAST({k} AS BIGINT) % {PRIME}) * {MULT} + 11) % {PRIME}"
    h = f"({h})"
    return f"({h} * ({h} + 7) % {PRIME})"


def uniform_sql(seed, *keys):
    return f"(CAST({hash_sql(seed, *keys)} AS DOUBLE) / {PRIME}e0)"


def gaussian_sql(seed, *keys):
    u1, u2 = uniform_sql(seed, *keys, "1"), uniform_sql(seed, *keys, "2")
    return f"(sqrt(-2e0 * ln(1e0 - {u1})) * cos({2 * math.pi!r} * {u2}))"


class DrawSql:
    """SQL text of the per-tile and per-point draws of an augmentation."""

    def __init__(self, op, seed=0, epoch=0):
        self.op, self.seed, self.keys = op, seed, [str(epoch), *TILE]

    def _s(self, name):
        return tag(self.seed, f"{self.op}.{name}")

    def value(self, name, lo, hi):
        return f"({float(lo)!r} + {uniform_sql(self._s(name), *self.keys)} * {float(hi) - float(lo)!r}e0)".replace("e0e0", "e0")

    def on(self, p, name="on"):
        return f"({uniform_sql(self._s(name), *self.keys)} < {float(p)!r})"

    def pick(self, name, n):
        return f"({hash_sql(self._s(name), *self.keys)} % {n})"

    def noise(self, name):
        return gaussian_sql(self._s(name), *self.keys, "point_id")

    def point_uniform(self, name):
        return uniform_sql(self._s(name), *self.keys, "point_id")


def clip_sql(e, lo, hi):
    return f"least(greatest({e}, {lo}), {hi})"


# --- shared DataFrames ----------------------------------------------------------------------
def tiled(t, window=WINDOW):
    return tiling.tile_assign(t.points(), window)


def cells(t):
    return voxels.voxel_coord(tiled(t), GRID)


def index(t):
    return voxels.voxel_rank(cells(t))


def tile_table(t):
    c = cells(t)
    n = c.groupBy(*TILE).agg(F.count(F.lit(1)).alias("num_points"))
    return n.join(voxels.voxel_counts(c), TILE)


def segmented(t):
    return tiling.tile_ids(tiled(t))


def samples(t):
    k = F.col("o_custkey")
    s = t.raw("orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("num_points"))
    return s.select(
        k.alias("sample_id"), (k % 2).alias("file_id"), "num_points", ((k % 7 + 1) / F.lit(8.0)).alias("weight")
    )
