"""Normalisation, augmentation, neighbourhoods, pooling, inference and streams."""

from __future__ import annotations

import math
from itertools import permutations

from pyspark.sql import functions as F

from cloudloom.catalog.base import (
    CLASSES, FEA, GRID, IX, KNN_K, MAPPING, PACK, PTS, SM, T, TEL, TP, V, VX, DrawSql, cells, clip_sql, cte, hash_sql, index,
    gaussian_sql, knn_cte, out, query, samples, sql, tiled, uniform_sql, vx_cte, PACK_LIMIT,
)
from cloudloom.catalog.scores import CM, packed
from cloudloom.catalog.storage import MCOLS, VOTE, means
from cloudloom.fixtures import LOGIT_EXPRS
from cloudloom.functions.vectors import argmax
from cloudloom.operators import augment, losses, neighbors, normalize, pooling, project, voxels
from cloudloom.operators.augment import tag
from cloudloom.operators.project import argmax_label, ground_flag
from cloudloom.plans.jobs import predict_points, predict_tiles
from cloudloom.plans.transforms import REGISTRY, pipeline, register_transform
from cloudloom.schemas import TILE
from cloudloom.session import new_table_path
from cloudloom.streaming import predictions as streams

TC = T.replace(",", "")
ID = [*TILE, "point_id"]
W = f"WINDOW w AS (PARTITION BY {T})"


def per_tile(select, dbl, plain="", src=TP, table="tp"):
    return sql(src, f"SELECT {T}, point_id, {select} FROM {table} {W}", f"{TC} point_id {plain}", dbl)


# --- normalisation ----------------------------------------------------------------------------
query(
    "normalize_unit_sphere",
    sql(cte(TP, f"ce AS (SELECT *, x - avg(x) OVER w AS a, y - avg(y) OVER w AS b, z - avg(z) OVER w AS c FROM tp {W})",
            f"no AS (SELECT *, max(sqrt(a * a + b * b + c * c)) OVER w AS r FROM ce {W})"),
        f"SELECT {T}, point_id, a / r AS x, b / r AS y, c / r AS z FROM no", f"{TC} point_id", "x y z"),
)(lambda t: out(normalize.normalize_unit_sphere(tiled(t)), *ID, "x", "y", "z"))


def norm(name, fn, exprs, src=TP, table="tp", prepare=tiled, whole=False):
    """`whole`: the columns hold whole numbers."""
    select = ", ".join(f"{e} AS {c}" for c, e in exprs.items())
    names = " ".join(exprs)
    query(name, per_tile(select, "" if whole else names, names if whole else "", src, table))(lambda t: out(fn(prepare(t)), *ID, *exprs))


def z(c):
    return f"({c} - avg({c}) OVER w) / stddev_pop({c}) OVER w"


norm("standardize_coord", lambda d: normalize.standardize_coord(d, apply_z=False), {"x": z("x"), "y": z("y"), "z": "z"})
norm("minmax_coord", normalize.minmax_coord, {c: f"({c} - min({c}) OVER w) / (max({c}) OVER w - min({c}) OVER w)" for c in "xyz"})
norm("positive_shift", normalize.positive_shift, {c: f"{c} - min({c}) OVER w" for c in "xyz"})
norm("center_shift", normalize.center_shift, {**{c: f"{c} - (min({c}) OVER w + max({c}) OVER w) / 2" for c in "xy"}, "z": "z - min(z) OVER w"})
norm("centroid_shift", normalize.centroid_shift, {c: f"{c} - avg({c}) OVER w" for c in "xyz"})
I = "intensity"
norm(
    "auto_intensity",
    lambda d: normalize.auto_intensity(d, target=(-1, 1)),
    {I: "(CASE WHEN max(intensity) OVER w <= 255 THEN intensity / 255e0 ELSE intensity / 65535e0 END) * 2 - 1"},
)
norm("scale_intensity", lambda d: normalize.scale_intensity(d, 255.0), {I: "intensity / 255e0"})
norm("standardize_intensity", normalize.standardize_intensity, {I: z(I)})
norm("minmax_intensity", lambda d: normalize.minmax_intensity(d, target=(-1, 1)), {I: "(intensity - min(intensity) OVER w) / (max(intensity) OVER w - min(intensity) OVER w) * 2e0 - 1"})
norm("auto_color", normalize.auto_color, {c: f"{c} / 65535e0 * 255" for c in ("red", "green", "blue")})
norm("scale_color", lambda d: normalize.scale_color(d, 16, (0, 1)), {c: f"{c} / 65535e0" for c in ("red", "green", "blue")})
HN = "z - min(z) OVER w"


def heights(t):
    """A simple height column: above the lowest point of the tile."""
    return normalize.positive_shift(tiled(t).withColumn("_z", F.col("z"))).withColumn("h_norm", F.col("z"))


HSRC = cte(TP, f"hp AS (SELECT *, {HN} AS h_norm FROM tp {W})")


def height(name, fn, e):
    norm(name, fn, {"h_norm": e}, src=HSRC, table="hp", prepare=heights)


height("clip_height", lambda d: normalize.clip_height(d, 2.0, 30.0), "least(greatest(h_norm, 2e0), 30e0)")
height("standardize_height", normalize.standardize_height, z("h_norm"))
height("log_height", normalize.log_height, "ln(greatest(h_norm, 0e0) + 1e-6)")
height("bin_height", lambda d: normalize.bin_height(d, 10, 0.0, 20.0), "least(greatest(floor(h_norm / 2e0), 0), 9) / 9e0")
RES = 48.0
GR = cte(
    TP,
    "gp AS (SELECT *, classification = 2 AS is_ground FROM tp)",
    f"gs AS (SELECT *, count(*) FILTER (WHERE is_ground) OVER w AS g, min(z) OVER w AS zmin, min(CASE WHEN is_ground THEN z END) OVER w AS gzmin, "
    f"CAST(floor((x - min(x) OVER w) / {RES}e0) AS BIGINT) AS cx, CAST(floor((y - min(y) OVER w) / {RES}e0) AS BIGINT) AS cy FROM gp {W})",
    f"rs AS (SELECT {T}, cx, cy, avg(z) AS cell_z FROM gs WHERE is_ground GROUP BY {T}, cx, cy)",
    "gr AS (SELECT * FROM gs WHERE is_ground)",
    knn_cte("gs", TILE, 3, "k3", ref="gr", coords="xy"),
    f"iw AS (SELECT k3.file_id, k3.pass_id, k3.xb, k3.yb, src AS point_id, sum(gr.z / (sqrt(dist2) + 1e-8)) / sum(1 / (sqrt(dist2) + 1e-8)) AS near_z "
    f"FROM k3 JOIN gr ON gr.point_id = dst AND gr.file_id = k3.file_id GROUP BY ALL)",
    f"dm AS (SELECT gs.*, coalesce(cell_z, near_z) AS ground_z, near_z FROM gs LEFT JOIN rs USING ({T}, cx, cy) LEFT JOIN iw USING ({T}, point_id))",
)
query("dtm_raster", sql(GR, "SELECT *, z - ground_z AS h_norm FROM dm", f"{TC} point_id", "ground_z h_norm"))(
    lambda t: out(normalize.dtm_raster(ground_flag(tiled(t)), resolution=RES), *ID, "ground_z", "h_norm")
)
query(
    "height_above_ground",
    sql(GR, "SELECT *, z - CASE WHEN g = 0 THEN zmin WHEN g < 10 THEN gzmin WHEN g < 50 THEN near_z ELSE ground_z END AS h_norm FROM dm", f"{TC} point_id", "h_norm"),
)(lambda t: out(normalize.height_above_ground(ground_flag(tiled(t)), resolution=RES), *ID, "h_norm"))

# --- augmentation -----------------------------------------------------------------------------
SEED, EPOCH = 7, 1
KW = {"seed": SEED, "epoch": EPOCH}


def draw(op):
    return DrawSql(op, SEED, EPOCH)


def aug(name, op, fn, build, prepare=tiled, src=TP, table="tp", whole=False):
    """`build` gets the SQL draws and returns column -> expression."""
    d = draw(op)
    norm(name, lambda df: fn(df, **KW), build(d), src=src, table=table, prepare=prepare, whole=whole)


def when(d, p, value, old):
    return f"CASE WHEN {d.on(p)} THEN {value} ELSE {old} END"


aug("aug_shift", "shift", lambda df, **k: augment.aug_shift(df, ((-2, 2), (-2, 2), (0, 1)), **k),
    lambda d: {c: f"{c} + {d.value(c, *s)}" for c, s in zip("xyz", ((-2, 2), (-2, 2), (0, 1)))})


def turned(d, angle, p):
    a = f"({angle} * {math.pi!r})"
    mid = {c: f"((min({c}) OVER w + max({c}) OVER w) / 2)" for c in "xy"}
    x, y = (f"({c} - {mid[c]})" for c in "xy")
    return {
        "x": when(d, p, f"{x} * cos({a}) - {y} * sin({a}) + {mid['x']}", "x"),
        "y": when(d, p, f"{x} * sin({a}) + {y} * cos({a}) + {mid['y']}", "y"),
        "z": "z",
        "normal_x": when(d, p, f"normal_x * cos({a}) - normal_y * sin({a})", "normal_x"),
        "normal_y": when(d, p, f"normal_x * sin({a}) + normal_y * cos({a})", "normal_y"),
    }


aug("aug_rotate", "rotate", augment.aug_rotate, lambda d: turned(d, d.value("angle", -1, 1), 0.5))
aug("aug_rotate_choice", "rotate_choice", augment.aug_rotate_choice, lambda d: turned(d, f"([0.5e0, 1e0, 1.5e0][{d.pick('angle', 3)} + 1])", 0.75))
aug("aug_scale", "scale", lambda df, **k: augment.aug_scale(df, (0.8, 1.2), True, **k), lambda d: {c: f"{c} * {d.value(c, 0.8, 1.2)}" for c in "xyz"})
aug("aug_flip", "flip", augment.aug_flip, lambda d: {c: f"CASE WHEN {d.on(0.5, c[-1])} THEN -{c} ELSE {c} END" for c in ("x", "y", "normal_x", "normal_y")})
aug("aug_jitter", "jitter", augment.aug_jitter, lambda d: {c: f"{c} + {clip_sql(d.noise(c) + ' * 0.01e0', '-0.05e0', '0.05e0')}" for c in "xyz"})
aug("aug_clip_gauss", "clip_gauss", augment.aug_clip_gauss, lambda d: {c: f"{c} + {clip_sql(d.noise(c) + ' / 1.96e0', '-1e0', '1e0')} * 0.02e0" for c in "xyz"})
UNIT = cte(TP, "ut AS (SELECT * EXCLUDE (intensity), intensity / 65535e0 AS intensity FROM tp)")


def unit(t):
    return normalize.scale_intensity(tiled(t))


def unit_aug(name, op, fn, build):
    aug(name, op, fn, build, prepare=unit, src=UNIT, table="ut")


unit_aug("aug_intensity_scale", "intensity_scale", augment.aug_intensity_scale, lambda d: {I: when(d, 0.95, clip_sql(f"intensity * {d.value('f', 0.8, 1.2)}", "0e0", "1e0"), I)})
# the raw 16-bit regime: shift by a share of the maximum, whole numbers
aug("aug_intensity_shift", "intensity_shift", augment.aug_intensity_shift,
    lambda d: {I: when(d, 0.95, f"CAST(floor({clip_sql('intensity + ' + d.value('s', -0.1, 0.1) + ' * 65535e0', '0e0', '65535e0')}) AS BIGINT)", I)},
    whole=True)
unit_aug("aug_intensity_noise", "intensity_noise", augment.aug_intensity_noise, lambda d: {I: when(d, 0.5, clip_sql(f"intensity + {d.noise('n')} * 0.01e0", "0e0", "1e0"), I)})
unit_aug("aug_intensity_drop", "intensity_drop", lambda df, **k: augment.aug_intensity_drop(df, 0.1, 0.6, **k),
         lambda d: {I: f"CASE WHEN {d.on(0.6)} AND {d.point_uniform('drop')} < 0.1 THEN 0e0 ELSE intensity END"})
unit_aug("aug_intensity_gamma", "intensity_gamma", augment.aug_intensity_gamma, lambda d: {I: when(d, 0.5, f"pow(intensity, {d.value('g', 0.8, 1.2)})", I)})
BYTE = cte(TP, "bt AS (SELECT * EXCLUDE (red, green, blue), " + ", ".join(f"floor({c} / 257e0) AS {c}" for c in ("red", "green", "blue")) + " FROM tp)")
RGB = ("red", "green", "blue")


def byte(t):
    return tiled(t).withColumns({c: F.floor(F.col(c) / F.lit(257.0)).cast("double") for c in RGB})


def rgb_aug(name, op, fn, build):
    aug(name, op, fn, build, prepare=byte, src=BYTE, table="bt")


rgb_aug("aug_auto_contrast", "auto_contrast", lambda df, **k: augment.aug_auto_contrast(df, 0.6, **k),
        lambda d: {c: when(d, 0.6, f"(1 - {d.value('blend', 0, 1)}) * {c} + {d.value('blend', 0, 1)} * (({c} - min({c}) OVER w) * 255e0 / (max({c}) OVER w - min({c}) OVER w))", c) for c in RGB})
rgb_aug("aug_color_shift", "color_shift", augment.aug_color_shift, lambda d: {c: when(d, 0.95, clip_sql(f"{c} + {d.value(c, -12.75, 12.75)}", "0e0", "255e0"), c) for c in RGB})
rgb_aug("aug_color_jitter_noise", "color_noise", augment.aug_color_jitter_noise, lambda d: {c: when(d, 0.95, clip_sql(f"{c} + {d.noise(c)} * {0.005 * 255.0!r}", "0e0", "255e0"), c) for c in RGB})
GRAY = "(0.2989e0 * red + 0.587e0 * green + 0.114e0 * blue)"
rgb_aug("aug_grayscale", "grayscale", augment.aug_grayscale, lambda d: {c: when(d, 0.2, GRAY, c) for c in RGB})
rgb_aug("aug_color_drop", "color_drop", lambda df, **k: augment.aug_color_drop(df, 0.5, 0.25, **k), lambda d: {c: when(d, 0.5, f"{c} * 0.25e0", c) for c in RGB})


def hsv_steps(name, src, shift, sat, scale):
    """CTEs that turn the hue by `shift` and multiply the saturation by `sat`; result in r_, g_, b_
    times `scale`, from channels divided by `scale`."""
    r, g, b = (f"({c} / {scale})" for c in RGB)
    hi, lo = f"greatest({r}, {g}, {b})", f"least({r}, {g}, {b})"
    six = f"CASE WHEN {r} = hi THEN ({g} - {b}) / sp WHEN {g} = hi THEN 2 + ({b} - {r}) / sp ELSE 4 + ({r} - {g}) / sp END / 6"

    def channel(n):
        k = f"({n} + h2 * 6 - floor(({n} + h2 * 6) / 6) * 6)"
        return f"(hi - hi * s2 * greatest(least({k}, 4 - {k}, 1), 0)) * {scale}"

    return cte(
        f"{name}0 AS (SELECT *, {hi} AS hi, {hi} - {lo} AS sp0, CASE WHEN {hi} = {lo} THEN 1 ELSE {hi} - {lo} END AS sp FROM {src})",
        f"{name}1 AS (SELECT *, CASE WHEN sp0 = 0 THEN 0 ELSE {six} END AS h0, CASE WHEN sp0 = 0 THEN 0 ELSE sp0 / CASE WHEN hi = 0 THEN 1 ELSE hi END END AS s0 FROM {name}0)",
        f"{name}2 AS (SELECT *, h0 - floor(h0) + {shift} AS h1, {clip_sql(f's0 * {sat}', '0e0', '1e0') if sat != '1e0' else 's0'} AS s2 FROM {name}1)",
        f"{name}3 AS (SELECT *, h1 - floor(h1) AS h2 FROM {name}2)",
        f"{name} AS (SELECT * EXCLUDE (hi, sp0, sp, h0, s0, h1, s2, h2), {channel(5)} AS r_, {channel(3)} AS g_, {channel(1)} AS b_ FROM {name}3)",
    )


HS = draw("hue_saturation")
query(
    "aug_hue_saturation",
    sql(cte(BYTE, hsv_steps("hs", "bt", HS.value("hue", -0.5, 0.5), HS.value("sat", 0.8, 1.2), "1e0")),
        f"SELECT {T}, point_id, " + ", ".join(f"{clip_sql(f'floor({e} + 1e-9)', '0e0', '255e0')} AS {c}" for c, e in zip(RGB, ("r_", "g_", "b_"))) + " FROM hs", f"{TC} point_id", "red green blue"),
)(lambda t: out(augment.aug_hue_saturation(byte(t), **KW), *ID, *RGB))


def _jitter_sql():
    d, parts, src = draw("color_jitter"), [BYTE], "j"
    orders = "[" + ", ".join(f"[{', '.join(map(str, o))}]" for o in permutations(range(4))) + "]"
    parts.append(f"j AS (SELECT *, {orders}[{d.pick('order', 24)} + 1] AS ord, list_position({orders}[{d.pick('order', 24)} + 1], 1) - 1 AS turn FROM bt)")

    def mix(base, c, name):
        f = d.value(name, 0.6, 1.4)
        return clip_sql(f"{f} * {c} + (1 - {f}) * {base}", "0e0", "255e0")

    def place(n, op, src):
        name = f"j{'a' if op == '<' else 'b'}{n}"
        parts.append(hsv_steps(f"{name}h", src, d.value("hue", -0.2, 0.2), "1e0", "255e0"))
        cols = []
        for c, hue in zip(RGB, ("r_", "g_", "b_")):
            use = lambda i, nm: f"{n} {op} turn AND ord[{n + 1}] = {i} AND {d.on(0.95, f'on_{nm}')}"
            cols.append(
                f"CASE WHEN {use(0, 'brightness')} THEN {mix('0', c, 'brightness')} WHEN {use(2, 'saturation')} THEN {mix(GRAY, c, 'saturation')} "
                f"WHEN {use(3, 'hue')} THEN {hue} ELSE {c} END AS {c}"
            )
        parts.append(f"{name} AS (SELECT * EXCLUDE (red, green, blue, r_, g_, b_), {', '.join(cols)} FROM {name}h)")
        return name

    for n in range(4):
        src = place(n, "<", src)
    parts.append(f"jg AS (SELECT *, avg({GRAY}) OVER w AS gray FROM {src} {W})")
    parts.append("jc AS (SELECT * EXCLUDE (red, green, blue), " + ", ".join(f"CASE WHEN {d.on(0.95, 'on_contrast')} THEN {mix('gray', c, 'contrast')} ELSE {c} END AS {c}" for c in RGB) + " FROM jg)")
    src = "jc"
    for n in range(4):
        src = place(n, ">", src)
    return sql(cte(*parts), f"SELECT {T}, point_id, red, green, blue FROM {src}", f"{TC} point_id", "red green blue")


query("aug_color_jitter", _jitter_sql())(lambda t: out(augment.aug_color_jitter(byte(t), 0.4, 0.4, 0.4, 0.2, **KW), *ID, *RGB))
aug("aug_height_scale", "height_scale", augment.aug_height_scale, lambda d: {"h_norm": when(d, 0.5, f"h_norm * {d.value('f', 0.9, 1.1)}", "h_norm")}, prepare=heights, src=HSRC, table="hp")
aug("aug_height_noise", "height_noise", augment.aug_height_noise, lambda d: {"h_norm": when(d, 0.5, f"h_norm + {d.noise('n')} * 0.1e0", "h_norm")}, prepare=heights, src=HSRC, table="hp")


ELASTIC = ((32.0, 2.0), (64.0, 4.0))


def _elastic_sql():
    """Per level: corners of every point, lattice nodes by brute force over 5 x 5 x 5 taps, trilinear displacement."""
    d, parts, src = draw("elastic"), [TP], "tp"

    def weight(n, j, s):  # of tap j in two rounds of a 3-tap mean at node n, nothing outside 0..s-1
        paths = " + ".join(f"CASE WHEN {n} + {o} BETWEEN 0 AND {s} - 1 AND abs({n} + {o} - {j}) <= 1 THEN 1 ELSE 0 END" for o in (-1, 0, 1))
        return f"(CASE WHEN {j} BETWEEN 0 AND {s} - 1 THEN ({paths}) / 9e0 ELSE 0e0 END)"

    for lv, (grain, magnitude) in enumerate(ELASTIC):
        at = ", ".join(
            f"({c} - min({c}) OVER w) / {grain}e0 + 1 AS t{i}, CAST(floor((max({c}) OVER w - min({c}) OVER w) / {grain}e0) AS BIGINT) + 3 AS s{i}" for i, c in enumerate("xyz")
        )
        parts.append(f"el{lv} AS (SELECT *, {at} FROM {src} {W})")
        addr = ", ".join(f"CAST(floor(t{i}) AS BIGINT) + (k >> {i}) % 2 AS i{i}" for i in range(3))
        part = " * ".join(f"(CASE WHEN (k >> {i}) % 2 = 1 THEN t{i} - floor(t{i}) ELSE 1 - (t{i} - floor(t{i})) END)" for i in range(3))
        parts.append(f"ec{lv} AS (SELECT {T}, point_id, s0, s1, s2, {addr}, {part} AS cw FROM el{lv} CROSS JOIN (SELECT unnest(range(0, 8)) AS k))")
        taps = ", ".join(f"i{i} + (o // {n}) % 5 - 2 AS j{i}" for i, n in enumerate((25, 5, 1)))
        parts.append(f"en{lv} AS (SELECT *, {taps} FROM (SELECT DISTINCT {T}, s0, s1, s2, i0, i1, i2 FROM ec{lv}) CROSS JOIN (SELECT unnest(range(0, 125)) AS o))")
        share = " * ".join(weight(f"i{i}", f"j{i}", f"s{i}") for i in range(3))
        parts.append(f"et{lv} AS (SELECT * FROM (SELECT *, {share} AS share FROM en{lv}) WHERE share > 0)")
        noise = ", ".join(f"sum(share * {gaussian_sql(d._s(str(lv)), *d.keys, 'j0', 'j1', 'j2', str(i))}) AS n{c}" for i, c in enumerate("xyz"))
        parts.append(f"ev{lv} AS (SELECT {T}, i0, i1, i2, {noise} FROM et{lv} GROUP BY {T}, i0, i1, i2)")
        push = ", ".join(f"sum(cw * n{c}) AS d{c}" for c in "xyz")
        parts.append(f"ed{lv} AS (SELECT {T}, point_id, {push} FROM ec{lv} JOIN ev{lv} USING ({T}, i0, i1, i2) GROUP BY {T}, point_id)")
        moved = ", ".join(f"CASE WHEN {d.on(0.95)} THEN {c} + d{c} * {magnitude}e0 ELSE {c} END AS {c}" for c in "xyz")
        parts.append(f"ep{lv} AS (SELECT {T}, point_id, {moved} FROM {src} JOIN ed{lv} USING ({T}, point_id))")
        src = f"ep{lv}"
    return sql(cte(*parts), f"SELECT * FROM {src}", f"{TC} point_id", "x y z")


query("aug_elastic", _elastic_sql())(lambda t: out(augment.aug_elastic(tiled(t), ELASTIC, **KW), *ID, "x", "y", "z"))


def _train_sql():
    """Centroid shift, dropout, turn, scale, flip, jitter and features, each from the one before."""

    def replaced(exprs):
        return "* REPLACE (" + ", ".join(f"{e} AS {c}" for c, e in exprs.items()) + ")"

    drop = f"row_number() OVER (PARTITION BY {T} ORDER BY {hash_sql(3, 'point_id')}, point_id) - 1 AS r_, count(*) OVER w AS n_, {uniform_sql(4, *TILE)} AS u_"
    turn = turned(draw("rotate"), draw("rotate").value("angle", -1, 1), 0.5)
    scale, flip, jitter = draw("scale"), draw("flip"), draw("jitter")
    steps = [
        f"c0 AS (SELECT {replaced({c: f'{c} - avg({c}) OVER w' for c in 'xyz'})} FROM tp {W})",
        f"c1 AS (SELECT * FROM (SELECT *, {drop} FROM c0 {W}) WHERE u_ >= 0.5 OR r_ < floor(n_ * 0.8e0))",
        f"c2 AS (SELECT {replaced({c: turn[c] for c in 'xy'})} FROM c1 {W})",
        f"c3 AS (SELECT {replaced({c: c + ' * ' + scale.value('all', 0.95, 1.05) for c in 'xyz'})} FROM c2)",
        f"c4 AS (SELECT {replaced({c: f'CASE WHEN {flip.on(0.5, c)} THEN -{c} ELSE {c} END' for c in 'xy'})} FROM c3)",
        f"c5 AS (SELECT {replaced({c: c + ' + ' + clip_sql(jitter.noise(c) + ' * 0.01e0', '-0.05e0', '0.05e0') for c in 'xyz'})} FROM c4)",
    ]
    features = ", ".join(f"CAST(CAST({c} AS FLOAT) AS DOUBLE) AS f{i}" for i, c in enumerate(("x", "y", "z", "intensity")))
    return sql(cte(TP, *steps), f"SELECT {T}, point_id, {features} FROM c5", f"{TC} point_id", "f0 f1 f2 f3")


@query("train_chain", _train_sql())
def _(t):
    steps = [
        "centroid_shift", ("random_dropout", {"ratio": 0.2, "p": 0.5, "seed": 3}), ("aug_rotate", KW), ("aug_scale", KW), ("aug_flip", KW), ("aug_jitter", KW),
        ("collect_features", {"keys": ID, "features": ["x", "y", "z", "intensity"]}),
    ]
    d = pipeline(tiled(t), steps)
    return out(d.select(*ID, *[F.get("feat", F.lit(i)).alias(f"f{i}") for i in range(4)]))


def _made_sql(ctes, point):
    """Real rows and made ones; the ids of made rows, hashes of another kind, count as -1."""
    real = f"SELECT {T}, point_id, x, y, z, h_norm, intensity, red, green, blue, classification, false AS is_synthetic FROM hp"
    shifted = cte(TP, f"hp AS (SELECT * REPLACE ({', '.join(f'{c} - min({c}) OVER w AS {c}' for c in 'xyz')}), {HN} AS h_norm FROM tp {W})")
    return sql(cte(shifted, ctes), f"{real} UNION ALL {point}", f"{TC} point_id classification is_synthetic", "x y z h_norm intensity red green blue")


def _made(df):
    df = df.withColumn("point_id", F.greatest("point_id", F.lit(-1)))
    return out(df, *ID, "x", "y", "z", "h_norm", "intensity", *RGB, "classification", "is_synthetic")


def _u(op, name, i="i"):
    return uniform_sql(draw(op)._s(name), *draw(op).keys, i)


LONE = cte(
    f"ot AS (SELECT {T}, count(*) AS n, min(x) AS lox, max(x) AS hix, min(y) AS loy, max(y) AS hiy, min(z) AS loz, max(z) AS hiz FROM hp GROUP BY {T})",
    f"om AS (SELECT *, CAST(greatest(floor(n * 0.02e0), 1) AS BIGINT) AS m FROM ot WHERE {draw('outliers').on(0.5)})",
    "oi AS (SELECT *, unnest(range(0, m)) AS i FROM om)",
    f"rk AS (SELECT {T}, red, green, blue, classification, row_number() OVER (PARTITION BY {T} ORDER BY point_id) - 1 AS r FROM hp)",
    f"oz AS (SELECT *, CASE WHEN i < floor(m / 2e0) THEN greatest(-10e0, hiz) + {_u('outliers', 'z')} * (100e0 - greatest(-10e0, hiz)) "
    f"ELSE -10e0 + {_u('outliers', 'z')} * (least(100e0, loz) + 10e0) END AS z, CAST(floor({_u('outliers', 'donor')} * n) AS BIGINT) AS r FROM oi)",
)
query("add_outliers", _made_sql(LONE,
    f"SELECT {T}, -1, lox + {_u('outliers', 'x')} * (hix - lox), loy + {_u('outliers', 'y')} * (hiy - loy), z, z - loz, {_u('outliers', 'intensity')}, red, green, blue, classification, true FROM oz JOIN rk USING ({T}, r)"))(
    lambda t: _made(augment.add_outliers(heights(t), ratio=0.02, height_mode="bimodal", color_value="inherit", **KW))
)
CENTRE = hash_sql(tag(SEED, "clusters.centre"), str(EPOCH), "point_id")
CLUSTERS = cte(
    f"ct AS (SELECT {T}, min(z) AS loz FROM hp GROUP BY {T} HAVING {draw('clusters').on(0.8)})",
    f"cc AS (SELECT {T}, x AS cx, y AS cy, z AS cz, row_number() OVER (PARTITION BY {T} ORDER BY {CENTRE}, point_id) AS k FROM hp)",
    f"cj AS (SELECT *, unnest(range(1, 6 + CAST(floor({_u('clusters', 'size', 'k')} * 16) AS BIGINT))) AS j FROM cc JOIN ct USING ({T}) WHERE k <= 3)",
    "ci AS (SELECT *, k * 21 + j AS i FROM cj)",
    f"cp AS (SELECT *, {_u('clusters', 'theta')} * 2 * pi() AS th, {_u('clusters', 'phi')} * pi() AS ph, {_u('clusters', 'r')} * 2e0 AS r FROM ci)",
    f"cz AS (SELECT *, cz + r * cos(ph) - 5e0 + {_u('clusters', 'dz')} * 10e0 AS z FROM cp)",
)
query("add_noise_clusters", _made_sql(CLUSTERS,
    f"SELECT {T}, -1, cx + r * sin(ph) * cos(th), cy + r * sin(ph) * sin(th), z, z - loz, {_u('clusters', 'intensity')}, "
    + ", ".join(f"{_u('clusters', c)} * 255e0" for c in RGB) + ", -1, true FROM cz"))(
    lambda t: _made(augment.add_noise_clusters(heights(t), p=0.8, **KW))
)


@query("register_transform", sql(cte(TP), f"SELECT {T}, point_id, x - y AS slant FROM tp", f"{TC} point_id", "slant"))
def _(t):
    if "slant" not in REGISTRY:
        register_transform("slant", lambda df, factor=1.0: df.withColumn("slant", (F.col("x") - F.col("y")) * factor))
    return out(pipeline(tiled(t), [("slant", {"factor": 1.0})]), *ID, "slant")


# --- neighbourhoods ---------------------------------------------------------------------------
KNN = cte(TP, knn_cte("tp", TILE, KNN_K))
EDGE = f"{TC} src rank dst"


def knn(t, k=KNN_K):
    return neighbors.knn_self(tiled(t), k, TILE)


query("knn_self", sql(KNN, "SELECT * FROM knn", EDGE, "dist2"))(lambda t: out(knn(t)))
query("topk_neighbours", sql(KNN, "SELECT * FROM knn WHERE rank <= 3", EDGE, "dist2"))(lambda t: out(neighbors.topk_neighbours(knn(t), TILE, 3)))
NG = "AND ".join(f"p.{c} = e.{c} " for c in TILE)
REL = cte(
    KNN,
    f"rel AS (SELECT e.*, p.intensity, p.x - s.x AS dx, p.y - s.y AS dy, p.z - s.z AS dz FROM knn e JOIN tp p ON {NG} AND p.point_id = dst JOIN tp s ON s.file_id = e.file_id AND s.point_id = src)",
)


def rel(t):
    return neighbors.knn_gather(tiled(t), KNN_K, TILE, ["intensity"], offsets=True)


query("gather_neighbours", sql(REL, "SELECT * FROM rel", f"{EDGE} intensity", "dx dy dz"))(
    lambda t: out(rel(t), *TILE, "src", "rank", "dst", "intensity", "dx", "dy", "dz")
)
P2 = [math.pi, 2 * math.pi]
query(
    "fourier_features",
    sql(REL, "SELECT *, sqrt(dx * dx + dy * dy + dz * dz) AS e3, " + f"sin(dx * {P2[0]!r}) AS e4, cos(dy * {P2[0]!r}) AS e7, sin(dy * {P2[1]!r}) AS e9, sin(dz * {P2[0]!r}) AS e12, cos(dz * {P2[1]!r}) AS e15 FROM rel", EDGE, "e3 e4 e7 e9 e12 e15"),
)(lambda t: out(neighbors.fourier_features(rel(t), 2).select(*TILE, "src", "rank", "dst", *[F.get("encoding", F.lit(i)).alias(f"e{i}") for i in (3, 4, 7, 9, 12, 15)])))
query("neighbour_max_pool", sql(REL, f"SELECT {T}, src, max(intensity) AS intensity FROM rel GROUP BY {T}, src", f"{TC} src intensity"))(
    lambda t: pooling.knn_max_pool(tiled(t), KNN_K, TILE, ["intensity"])
)
IDW = cte(
    TP, "gr AS (SELECT * FROM tp WHERE classification = 2)",
    knn_cte("tp", TILE, 3, "k3", ref="gr", coords="xy"),
    f"iw AS (SELECT k3.file_id, k3.pass_id, k3.xb, k3.yb, src, sum(gr.z / (sqrt(dist2) + 1e-8)) / sum(1 / (sqrt(dist2) + 1e-8)) AS ground_z FROM k3 JOIN gr ON gr.point_id = dst AND gr.file_id = k3.file_id GROUP BY ALL)",
)
query("knn_idw", sql(IDW, "SELECT * FROM iw", f"{TC} src", "ground_z"))(
    lambda t: out(neighbors.knn_idw(tiled(t), tiled(t).filter("classification = 2"), "z", TILE, out="ground_z"))
)
FILE = ["file_id"]
POOL = cte(PTS, "pc AS (SELECT *, " + ", ".join(f"CAST(floor(({c} - min({c}) OVER (PARTITION BY file_id)) / 40e0) AS BIGINT) AS v{c}" for c in "xyz") + " FROM pts)",
           "gpool AS (SELECT file_id, vx, vy, vz, avg(x) AS x, avg(y) AS y, avg(z) AS z, max(intensity) AS intensity, max(red) AS red, count(*) AS n FROM pc GROUP BY ALL)")


def pool(t):
    return pooling.grid_pool(t.points(), 40.0, FILE, ["intensity", "red"])


query("grid_pool", sql(POOL, "SELECT * FROM gpool", "file_id vx vy vz intensity red n", "x y z"))(lambda t: out(pool(t)))
query("segment_max_pool", sql(TP, f"SELECT *, max(intensity) OVER w AS intensity_max FROM tp {W}", f"{TC} point_id intensity_max"))(
    lambda t: pooling.segment_max_pool(tiled(t), TILE, ["intensity"]).select(*ID, "intensity_max")
)
query("unpool_map", sql(POOL, "SELECT pc.*, gpool.intensity AS intensity_pooled FROM pc JOIN gpool USING (file_id, vx, vy, vz)", "file_id point_id intensity_pooled"))(
    lambda t: pooling.unpool_map(pooling.pool_cells(t.points(), 40.0, FILE), pool(t), FILE, ["intensity"]).select("file_id", "point_id", "intensity_pooled")
)
UI = cte(
    VX, f"cp AS (SELECT {V}, min(point_id) AS cid, avg(x) AS x, avg(y) AS y, avg(z) AS z, max(intensity) AS value FROM vx GROUP BY {V})",
    knn_cte("tp", TILE, 3, "k3", ref="cp", rid="cid"),
    "ui AS (SELECT k3.file_id, k3.pass_id, k3.xb, k3.yb, src AS point_id, sum(cp.value / (sqrt(dist2) + 1e-8)) / sum(1 / (sqrt(dist2) + 1e-8)) AS up FROM k3 JOIN cp ON cp.cid = dst AND cp.file_id = k3.file_id GROUP BY ALL)",
)


@query("unpool_interp", sql(UI, f"SELECT {T}, point_id, up + red AS unpooled FROM ui JOIN tp USING ({T}, point_id)", f"{TC} point_id", "unpooled"))
def _(t):
    coarse = cells(t).groupBy(*TILE, "vx", "vy", "vz").agg(
        F.min("point_id").alias("cid"), *[F.avg(c).alias(c) for c in "xyz"], F.max("intensity").alias("value")
    )
    return out(pooling.unpool_interp(tiled(t), coarse, TILE, "value", "cid", skip="red"), *ID, "unpooled")


LOG0 = [e.replace("k * 17", "0 * 17") for e in LOGIT_EXPRS]
TGT = "CASE WHEN classification = 0 THEN -1 ELSE classification - 1 END"
LCS = cte(
    TP, knn_cte("tp", TILE, 4),
    f"lo AS (SELECT *, [{', '.join(LOG0)}] AS lg, {TGT} AS label FROM tp)",
    "le AS (SELECT *, " + " + ".join(f"exp(lg[{c + 1}] - list_max(lg))" for c in range(CLASSES)) + " AS se FROM lo)",
    "pr AS (SELECT *, " + ", ".join(f"exp(lg[{c + 1}] - list_max(lg)) / se AS p{c}" for c in range(CLASSES)) + " FROM le)",
    "dd AS (SELECT " + " + ".join(f"(a.p{c} - b.p{c}) * (a.p{c} - b.p{c})" for c in range(CLASSES)) + " AS d FROM knn e JOIN pr a ON a.file_id = e.file_id AND a.point_id = e.src JOIN pr b ON b.file_id = e.file_id AND b.point_id = e.dst WHERE a.label = b.label AND a.label <> -1)",
)


@query("eval_label_consistency", sql(LCS, "SELECT coalesce(sum(d), 0) / greatest(count(*), 1) AS label_consistency FROM dd", "", "label_consistency"))
def _(t):
    p = tiled(t).withColumns({"logits": F.expr("array(" + ", ".join(LOG0) + ")"), "label": F.expr(TGT)})
    return out(losses.knn_label_consistency(p, 4, TILE, CLASSES))


BCS = cte(
    FEA, knn_cte("fea", ["batch_id"], 6),
    "cs AS (SELECT a.label = b.label AS same, list_inner_product(a.feature, b.feature) / (sqrt(list_inner_product(a.feature, a.feature)) * sqrt(list_inner_product(b.feature, b.feature))) AS cos "
    "FROM knn e JOIN fea a ON a.point_id = src JOIN fea b ON b.point_id = dst)",
)
query("eval_boundary_contrast", sql(BCS, "SELECT coalesce(avg(1 - cos) FILTER (WHERE same), 0) + 0.5 * coalesce(avg(greatest(cos - 0.1e0, 0)) FILTER (WHERE NOT same), 0) AS boundary_contrast FROM cs", "", "boundary_contrast"))(
    lambda t: out(losses.eval_boundary_contrast(neighbors.knn_self(t.features(), 6, ["batch_id"]), t.features(), ["batch_id"], margin=0.1))
)

# --- inference --------------------------------------------------------------------------------


def height_model(pdf):
    """Stands in for a network: class c scores by the distance of the height above the batch's
    lowest point from 4.5 * c."""
    h = (pdf["z"] - pdf["z"].min()).to_numpy()
    return [[-((v - 4.5 * c) ** 2) for c in range(CLASSES)] for v in h]


PT = cte(PACK, f"ob AS (SELECT pts.*, batch_id FROM orders JOIN pk ON sample_id = o_custkey JOIN pts ON point_id = o_orderkey)",
         "oh AS (SELECT *, z - min(z) OVER (PARTITION BY batch_id) AS h FROM ob)",
         "lg AS (SELECT *, [" + ", ".join(f"-((h - {4.5 * c!r}e0) * (h - {4.5 * c!r}e0))" for c in range(CLASSES)) + "] AS logits FROM oh)")


@query("predict_tiles", sql(cte(PACK, PTS, *[PT[len(PACK) + 2 :]]), "SELECT *, CAST(list_position(logits, list_max(logits)) - 1 AS INTEGER) AS label, logits[3] AS l2 FROM lg", "file_id point_id batch_id label", "l2", recursive=True))
def _(t):
    member = t.raw("orders").select(F.col("o_custkey").alias("sample_id"), F.col("o_orderkey").alias("point_id"))
    batches = packed(t).select("sample_id", "batch_id")
    points = t.points().join(member, "point_id").join(batches, "sample_id").select("file_id", "point_id", "batch_id", "z")
    label = lambda d: d.withColumn("label", argmax("logits"))
    got = predict_tiles(points, height_model, ["batch_id"], ["file_id", "point_id"], postprocess=label)
    return out(got.select("file_id", "point_id", "batch_id", "label", F.get("logits", F.lit(2)).alias("l2")))


@query("predict_points", sql(PTS, "SELECT *, CAST(least(floor(z / 5e0), 7) AS INTEGER) AS label FROM pts", "file_id point_id label"))
def _(t):
    def model(pdf):
        pick = (pdf["z"] // 5.0).clip(upper=7).astype(int)
        return [[1.0 if c == i else 0.0 for c in range(CLASSES)] for i in pick]

    got = predict_points(t.points().select("file_id", "point_id", "z"), model, ["file_id", "point_id"])
    return got.select("file_id", "point_id", argmax("logits").alias("label"))


# --- streams ----------------------------------------------------------------------------------
class StreamTables:
    """The fixture views as streams over the same files."""

    def __init__(self, t):
        self.t = t

    def source(self, name):
        schema = self.t.raw(name).schema
        return self.t.spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(self.t.sf_dir)

    def view(self, kind):
        """A view of `Tables`, built on streams."""
        other = object.__new__(type(self.t))
        other.spark, other.sf_dir, other.raw = self.t.spark, self.t.sf_dir, self.source
        return getattr(other, kind)()


def finish(q):
    q.awaitTermination()
    if q.exception():
        raise q.exception()


@query("stream_predictions", sql(VOTE, "SELECT * FROM vote", "file_id point_id votes", MCOLS))
def _(t):
    from cloudloom.operators.voting import vote_logits

    path = new_table_path(t.spark, "stream-parts")
    finish(streams.stream_predictions(StreamTables(t).view("predictions"), path))
    parts = t.spark.read.parquet(path).withColumn("file_id", F.col("file_id").cast("long"))
    return means(vote_logits(parts, CLASSES))


@query("stream_confusion", sql(SM, "SELECT loop_idx AS epoch, target, pred, count(*) AS n FROM sm WHERE target <> -1 GROUP BY ALL", "epoch target pred n"))
def _(t):
    path = new_table_path(t.spark, "stream-confusion")
    p = argmax_label(StreamTables(t).view("predictions")).withColumn("epoch", F.col("loop_idx"))
    finish(streams.stream_confusion(p, path))
    return streams.read_confusion(t.spark, path)


@query("stream_votes", sql(VOTE, "SELECT * FROM vote", "file_id point_id votes", MCOLS))
def _(t):
    path = new_table_path(t.spark, "stream-votes")
    finish(streams.stream_votes(StreamTables(t).view("predictions"), path, CLASSES))
    return means(streams.read_votes(t.spark, path, CLASSES))


LIMITS = {"slowdown": 1.8, "absolute": 4.0, "interval": 25}
WHY = "CASE WHEN (t.i + 1) % 25 = 0 THEN 'periodic' WHEN m > 0 AND t.duration > m * 1.8e0 THEN 'slowdown' WHEN t.duration > 4e0 THEN 'absolute' ELSE '' END"
SLOW = cte(
    TEL,
    "sb AS (SELECT run, stage, CAST(-1 AS BIGINT) AS i, 0e0 AS duration, '' AS reason, 0e0 AS m FROM tel GROUP BY run, stage UNION ALL "
    f"SELECT t.run, t.stage, t.i, t.duration, {WHY}, CASE WHEN ({WHY}) <> '' THEN m WHEN m = 0 THEN t.duration ELSE m * 0.95e0 + t.duration * 0.05e0 END "
    "FROM sb JOIN tel t ON t.run = sb.run AND t.stage = sb.stage AND t.i = sb.i + 1)",
)
SLOW_SQL = sql(SLOW, "SELECT * FROM sb WHERE i >= 0", "run stage i reason", "duration m", recursive=True)


def steps(t):
    """Telemetry with the step number of each stage."""
    from cloudloom.operators.ordering import ordered_prefix

    return ordered_prefix(t.telemetry(), ["run", "stage"], ["ts", "event_id"], "i")


@query("slow_batches", SLOW_SQL)
def _(t):
    return out(streams.slow_batches(steps(t), ["run", "stage"], **LIMITS).withColumnRenamed("mean", "m"))


@query("slow_batch_detector", SLOW_SQL)
def _(t):
    """The step numbers are written first, because a stream does not number its rows."""
    src, path = (new_table_path(t.spark, n) for n in ("telemetry", "stream-slow"))
    steps(t).select("run", "stage", "i", "duration").write.parquet(src)
    flow = t.spark.readStream.schema(t.spark.read.parquet(src).schema).parquet(src)
    finish(streams.stream_slow_batches(flow, path, ["run", "stage"], **LIMITS))
    return out(t.spark.read.parquet(path).withColumnRenamed("mean", "m"), "run", "stage", "i", "reason", "duration", "m")
