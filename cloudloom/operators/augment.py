"""Seeded augmentation of tiles.

A parameter is drawn once per tile, as an expression over the tile's key: no parameter table, no
join, no shuffle. Per-point noise is an expression over tile key and point id. Only operators that
need a statistic of the tile aggregate and join.
"""

from __future__ import annotations

import math
import zlib
from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloudloom.functions import color as colour
from cloudloom.functions.seeded import gaussian, hash_int, uniform
from cloudloom.functions.vectors import clip
from cloudloom.operators.ordering import attach_groups, join_rows, rank_by_id, with_group_stats
from cloudloom.schemas import TILE
from cloudloom.session import cut_lineage

COORD = ("x", "y", "z")
NORMAL = ("normal_x", "normal_y", "normal_z")
RGB = ("red", "green", "blue")


def tag(seed: int, name: str) -> int:
    """Seed of one named draw."""
    return (int(seed) * 1_000_003 + zlib.crc32(name.encode())) % 2147483647


class Draw:
    """Random parameters of one operator, drawn per tile."""

    def __init__(self, op: str, seed=0, epoch=0, tile=TILE):
        self.op, self.seed, self.epoch, self.tile = op, seed, epoch, list(tile)

    def _seed(self, name):
        return tag(self.seed, f"{self.op}.{name}")

    def value(self, name: str, lo, hi) -> Column:
        if lo == hi:
            return F.lit(float(lo))
        u = uniform(self._seed(name), F.lit(self.epoch), *self.tile)
        return F.lit(float(lo)) + u * F.lit(float(hi) - float(lo))

    def on(self, p, name="on") -> Column:
        if p >= 1:
            return F.lit(True)
        return uniform(self._seed(name), F.lit(self.epoch), *self.tile) < F.lit(float(p))

    def pick(self, name: str, n: int) -> Column:
        return hash_int(self._seed(name), F.lit(self.epoch), *self.tile) % n

    def noise(self, name: str, *ids) -> Column:
        return gaussian(self._seed(name), F.lit(self.epoch), *self.tile, *(ids or ("point_id",)))

    def point_uniform(self, name: str, *ids) -> Column:
        return uniform(self._seed(name), F.lit(self.epoch), *self.tile, *(ids or ("point_id",)))


def _apply(df, on, cols):
    """New values where the tile takes part, the old ones elsewhere."""
    return df.withColumns({c: F.when(on, v).otherwise(F.col(c)) for c, v in cols.items()})


def _double(df, cols):
    return df.withColumns({c: F.col(c).cast("double") for c in cols})


def aug_shift(df, shift=((-0.2, 0.2), (-0.2, 0.2), (0, 0)), seed=0, epoch=0, tile=TILE):
    d = Draw("shift", seed, epoch, tile)
    return df.withColumns({c: F.col(c) + d.value(c, *s) for c, s in zip(COORD, shift)})


def _turn(axis, a, b, c, cos, sin):
    if axis == "x":
        return a, b * cos - c * sin, b * sin + c * cos
    if axis == "y":
        return a * cos + c * sin, b, c * cos - a * sin
    if axis == "z":
        return a * cos - b * sin, a * sin + b * cos, c
    raise ValueError("axis must be x, y or z")


def _rotate(df, angle, on, axis, center, tile):
    """`angle` in units of pi, around the given centre or the middle of the tile's box."""
    turn = angle * F.lit(math.pi)
    df = df.withColumns({"_cos": F.cos(turn), "_sin": F.sin(turn), "_on": on})
    cos, sin, on = F.col("_cos"), F.col("_sin"), F.col("_on")
    if center is None:
        df = with_group_stats(df, tile, [((F.min(c) + F.max(c)) / 2).alias(f"_o{c}") for c in COORD])
        origin = [F.col(f"_o{c}") for c in COORD]
    else:
        origin = [F.lit(float(v)) for v in center]
    moved = _turn(axis, *[F.col(c) - o for c, o in zip(COORD, origin)], cos, sin)
    cols = {c: m + o for c, m, o in zip(COORD, moved, origin)}
    if set(NORMAL) <= set(df.columns):
        cols.update(zip(NORMAL, _turn(axis, *[F.col(c) for c in NORMAL], cos, sin)))
    return _apply(df, on, cols).drop("_cos", "_sin", "_on", *[f"_o{c}" for c in COORD])


def aug_rotate(df, angle=(-1, 1), center=None, axis="z", p=0.5, seed=0, epoch=0, tile=TILE):
    d = Draw("rotate", seed, epoch, tile)
    return _rotate(df, d.value("angle", *angle), d.on(p), axis, center, tile)


def aug_rotate_choice(df, angles=(0.5, 1.0, 1.5), center=None, axis="z", p=0.75, seed=0, epoch=0, tile=TILE):
    d = Draw("rotate_choice", seed, epoch, tile)
    angle = F.element_at(F.array(*[F.lit(float(a)) for a in angles]), (d.pick("angle", len(angles)) + 1).cast("int"))
    return _rotate(df, angle, d.on(p), axis, center, tile)


def aug_scale(df, scale=(0.95, 1.05), anisotropic=False, seed=0, epoch=0, tile=TILE):
    d = Draw("scale", seed, epoch, tile)
    return df.withColumns({c: F.col(c) * d.value(c if anisotropic else "all", *scale) for c in COORD})


def aug_flip(df, p=0.5, seed=0, epoch=0, tile=TILE):
    d = Draw("flip", seed, epoch, tile)
    for axis in "xy":
        cols = [c for c in (axis, f"normal_{axis}") if c in df.columns]
        df = _apply(df, d.on(p, axis), {c: -F.col(c) for c in cols})
    return df


def aug_jitter(df, sigma=0.01, limit=0.05, seed=0, epoch=0, tile=TILE):
    d = Draw("jitter", seed, epoch, tile)
    return df.withColumns({c: F.col(c) + clip(d.noise(c) * sigma, -limit, limit) for c in COORD})


def aug_clip_gauss(df, scalar=0.02, seed=0, epoch=0, tile=TILE):
    """Noise with 95 % of its mass inside the clip bound."""
    d = Draw("clip_gauss", seed, epoch, tile)
    return df.withColumns({c: F.col(c) + clip(d.noise(c) / 1.96, -1.0, 1.0) * scalar for c in COORD})


def _top(df, col, raw_max):
    """Upper end of the value range: 1 for floating point, the type's maximum for integers."""
    whole = isinstance(df.schema[col].dataType, T.IntegralType)
    return (float(raw_max), whole)


def _store(value, whole):
    """Integer columns keep whole numbers (truncated) as double -> bigint."""
    return F.floor(value).cast("long") if whole else value


def aug_intensity_scale(df, scale=(0.8, 1.2), p=0.95, col="intensity", seed=0, epoch=0, tile=TILE):
    d = Draw("intensity_scale", seed, epoch, tile)
    return _apply(df, d.on(p), {col: clip(F.col(col) * d.value("f", *scale), 0.0, 1.0)})


def aug_intensity_shift(df, shift=(-0.1, 0.1), p=0.95, col="intensity", raw_max=65535, seed=0, epoch=0, tile=TILE):
    d = Draw("intensity_shift", seed, epoch, tile)
    top, whole = _top(df, col, raw_max)
    top = top if whole else 1.0
    value = clip(F.col(col) + d.value("s", *shift) * top, 0.0, top)
    return _apply(df, d.on(p), {col: _store(value, whole)})


def aug_intensity_noise(df, sigma=0.01, p=0.5, col="intensity", raw_max=65535, seed=0, epoch=0, tile=TILE):
    d = Draw("intensity_noise", seed, epoch, tile)
    top, whole = _top(df, col, raw_max)
    top = top if whole else 1.0
    value = clip(F.col(col) + d.noise("n") * (sigma * top), 0.0, top)
    return _apply(df, d.on(p), {col: _store(value, whole)})


def aug_intensity_drop(df, ratio=0.1, p=0.2, col="intensity", seed=0, epoch=0, tile=TILE):
    d = Draw("intensity_drop", seed, epoch, tile)
    hit = d.on(p) & (d.point_uniform("drop") < F.lit(float(ratio)))
    return _apply(df, hit, {col: F.lit(0)})


def aug_intensity_gamma(df, gamma=(0.8, 1.2), p=0.5, col="intensity", raw_max=65535, seed=0, epoch=0, tile=TILE):
    d = Draw("intensity_gamma", seed, epoch, tile)
    top, whole = _top(df, col, raw_max)
    top = top if whole else 1.0
    value = F.pow(F.col(col) / F.lit(top), d.value("g", *gamma)) * top
    return _apply(df, d.on(p), {col: _store(value, whole)})


def aug_auto_contrast(df, p=0.2, blend=None, seed=0, epoch=0, tile=TILE):
    """Stretches each channel of the tile to 0..255 and blends; a flat channel keeps its value."""
    d = Draw("auto_contrast", seed, epoch, tile)
    f = d.value("blend", 0, 1) if blend is None else F.lit(float(blend))
    df = with_group_stats(
        _double(df, RGB), tile, [fn(c).alias(f"_{n}_{c}") for c in RGB for n, fn in (("lo", F.min), ("hi", F.max))]
    )
    cols = {}
    for c in RGB:
        lo, hi = F.col(f"_lo_{c}"), F.col(f"_hi_{c}")
        full = (F.col(c) - lo) * F.lit(255.0) / F.when(hi > lo, hi - lo).otherwise(F.lit(1.0))
        cols[c] = F.when(hi > lo, (F.lit(1.0) - f) * F.col(c) + f * full).otherwise(F.col(c))
    return _apply(df, d.on(p), cols).drop(*[f"_{n}_{c}" for c in RGB for n in ("lo", "hi")])


def aug_color_shift(df, p=0.95, ratio=0.05, seed=0, epoch=0, tile=TILE):
    d = Draw("color_shift", seed, epoch, tile)
    reach = 255.0 * ratio
    return _apply(_double(df, RGB), d.on(p), {c: clip(F.col(c) + d.value(c, -reach, reach), 0.0, 255.0) for c in RGB})


def aug_color_jitter_noise(df, p=0.95, std=0.005, seed=0, epoch=0, tile=TILE):
    d = Draw("color_noise", seed, epoch, tile)
    return _apply(_double(df, RGB), d.on(p), {c: clip(F.col(c) + d.noise(c) * (std * 255.0), 0.0, 255.0) for c in RGB})


def aug_grayscale(df, p=0.2, seed=0, epoch=0, tile=TILE):
    d = Draw("grayscale", seed, epoch, tile)
    df = _double(df, RGB)
    g = colour.gray(*[F.col(c) for c in RGB])
    return _apply(df, d.on(p), {c: g for c in RGB})


def _span(value, center, low):
    if isinstance(value, (int, float)):
        if value < 0:
            raise ValueError("a single jitter strength must not be negative")
        lo, hi = center - value, center + value
        return None if value == 0 else (max(lo, low), hi)
    lo, hi = value
    return None if lo == hi == center else (lo, hi)


def aug_color_jitter(df, brightness=0.0, contrast=0.0, saturation=0.0, hue=0.0, p=0.95, seed=0, epoch=0, tile=TILE):
    """Brightness, contrast, saturation and hue, each with probability p, in a random order per tile.

    Contrast blends with the tile's mean grey at that moment, so the steps that precede it on a
    tile are applied first, the mean is taken once, and the steps that follow come after.
    """
    d = Draw("color_jitter", seed, epoch, tile)
    steps = {
        "brightness": _span(brightness, 1.0, 0.0),
        "contrast": _span(contrast, 1.0, 0.0),
        "saturation": _span(saturation, 1.0, 0.0),
        "hue": _span(hue, 0.0, -0.5),
    }
    names = list(steps)
    orders = F.array(*[F.array(*[F.lit(i) for i in o]) for o in permutations(range(4))])
    mine = F.element_at(orders, (d.pick("order", 24) + 1).cast("int"))
    # the draws of a tile become columns, so that the long chain of steps refers to them by name
    params = {"_order": mine}
    for name in names:
        if steps[name] is not None:
            params |= {f"_f_{name}": d.value(name, *steps[name]), f"_on_{name}": d.on(p, f"on_{name}")}
    df = _double(df, RGB).withColumns(params)
    df = df.withColumn("_turn", F.array_position("_order", F.lit(names.index("contrast"))) - 1)

    def mix(new, old, f):
        return clip(f * old + (F.lit(1.0) - f) * new, 0.0, 255.0)

    def changed(name, rgb):
        f = F.col(f"_f_{name}")
        base = {"brightness": F.lit(0.0), "contrast": F.col("_gray"), "saturation": colour.gray(*rgb)}[name]
        return [mix(base, c, f) for c in rgb]

    def turn_hue(df):
        """Hue step in three projections: components, turned hue, channels."""
        h, s, v = colour.rgb_to_hsv(*[F.col(c) / 255.0 for c in RGB])
        df = df.withColumns({"_h": h, "_s": s, "_v": v})
        df = df.withColumn("_h", colour.wrap_unit(F.col("_h") + F.col("_f_hue")))
        back = colour.hsv_to_rgb(F.col("_h"), F.col("_s"), F.col("_v"))
        return df.withColumns({f"_hue_{c}": v * 255.0 for c, v in zip(RGB, back)}).drop("_h", "_s", "_v")

    rgb = [F.col(c) for c in RGB]

    def run(df, places, when):
        for place in places:
            out = dict(zip(RGB, rgb))
            if steps["hue"] is not None:
                df = turn_hue(df)
            for i, name in enumerate(names):
                if steps[name] is None or name == "contrast":
                    continue
                use = when(place) & (F.get("_order", F.lit(place)) == i) & F.col(f"_on_{name}")
                new = [F.col(f"_hue_{c}") for c in RGB] if name == "hue" else changed(name, rgb)
                out = {c: F.when(use, n).otherwise(out[c]) for c, n in zip(RGB, new)}
            df = df.withColumns(out).drop(*[f"_hue_{c}" for c in RGB])
        return df

    df = run(df, range(3), lambda place: F.lit(place) < F.col("_turn"))
    if steps["contrast"]:
        df = with_group_stats(df, tile, [F.avg(colour.gray(*rgb)).alias("_gray")])
        df = _apply(df, F.col("_on_contrast"), dict(zip(RGB, changed("contrast", rgb)))).drop("_gray")
    return run(df, range(1, 4), lambda place: F.lit(place) > F.col("_turn")).drop("_turn", *params)


def aug_hue_saturation(df, hue_max=0.5, saturation_max=0.2, seed=0, epoch=0, tile=TILE):
    """Hue offset and saturation ratio; channels end as whole numbers 0..255."""
    d = Draw("hue_saturation", seed, epoch, tile)
    df = _double(df, RGB)
    h, s, v = colour.rgb_to_hsv(*[F.col(c) for c in RGB])
    h = colour.wrap_unit(h + d.value("hue", -hue_max, hue_max))
    s = clip(s * d.value("sat", 1 - saturation_max, 1 + saturation_max), 0.0, 1.0)
    # the small addend keeps an exact whole number from falling below itself
    new = [clip(F.floor(c + F.lit(1e-9)), 0, 255).cast("double") for c in colour.hsv_to_rgb(h, s, v)]
    return df.withColumns(dict(zip(RGB, new)))


def aug_color_drop(df, p=0.2, color_augment=0.0, seed=0, epoch=0, tile=TILE):
    d = Draw("color_drop", seed, epoch, tile)
    return _apply(_double(df, RGB), d.on(p), {c: F.col(c) * F.lit(float(color_augment)) for c in RGB})


def aug_height_scale(df, scale=(0.9, 1.1), p=0.5, seed=0, epoch=0, tile=TILE):
    d = Draw("height_scale", seed, epoch, tile)
    return _apply(df, d.on(p), {"h_norm": F.col("h_norm") * d.value("f", *scale)})


def aug_height_noise(df, sigma=0.1, p=0.5, seed=0, epoch=0, tile=TILE):
    d = Draw("height_noise", seed, epoch, tile)
    return _apply(df, d.on(p), {"h_norm": F.col("h_norm") + d.noise("n") * sigma})


def _box_weight(i, j, size):
    """Weight of node j in two rounds of a 3-tap mean at node i, nothing outside 0..size-1."""
    paths = F.lit(0)
    for step in (-1, 0, 1):
        m = i + step
        paths = paths + F.when((m >= 0) & (m < size) & (F.abs(m - j) <= 1), 1).otherwise(0)
    inside = (j >= 0) & (j < size)
    return F.when(inside, paths / F.lit(9.0)).otherwise(F.lit(0.0))


def aug_elastic(df, params=((0.2, 0.4), (0.8, 1.6)), p=0.95, seed=0, epoch=0, tile=TILE):
    """Smoothed Gaussian lattice, read by trilinear interpolation, times the magnitude.

    Lattice noise is a function of tile and node, so only nodes next to a point are made: the
    distinct corners of occupied cells. Their smoothing is computed inside the row. A cell's eight corners become one row, which
    is attached to the points of the cell; points are not multiplied by their corners. Points without an id or a coordinate stay where they are.
    """
    tile = list(tile)
    d = Draw("elastic", seed, epoch, tile)
    nodes = ["_i0", "_i1", "_i2"]
    for level, (grain, magnitude) in enumerate(params):
        box = [f(c).alias(f"_{n}{c}") for c in COORD for n, f in (("lo", F.min), ("hi", F.max))]
        df = with_group_stats(df, tile, box)
        g = F.lit(float(grain))
        at = {f"_t{i}": (F.col(c) - F.col(f"_lo{c}")) / g + 1 for i, c in enumerate(COORD)}
        size = {f"_s{i}": F.floor((F.col(f"_hi{c}") - F.col(f"_lo{c}")) / g) + 3 for i, c in enumerate(COORD)}
        df = df.withColumns({**at, **size}).drop(*[f"_{n}{c}" for c in COORD for n in ("lo", "hi")])
        placed = F.col("point_id").isNotNull()
        for c in COORD:
            placed = placed & F.col(c).isNotNull()
        cell = ["_b0", "_b1", "_b2"]
        df = df.withColumns({b: F.when(placed, F.floor(f"_t{i}")) for i, b in enumerate(cell)})
        cells = cut_lineage(df.filter(placed).select(*tile, *size, *cell).distinct())
        bits = [[k >> i & 1 for i in range(3)] for k in range(8)]
        corners = cells.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(7))))
        addr = [(F.col(b) + F.shiftright(F.col("_k"), i).bitwiseAND(F.lit(1))).alias(nodes[i]) for i, b in enumerate(cell)]
        corners = corners.select(*tile, *size, *cell, "_k", *addr)
        # few bytes and much work: spread by hand, since adaptive execution merges partitions by their bytes
        many, parts = cells.count(), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        parts = max(1, min(math.ceil(many / 128), parts), math.ceil(many / 20_000))
        lattice = corners.select(*tile, *size, *nodes).distinct().repartition(parts, *tile, *nodes)

        # 5 x 5 x 5 taps per node; they stay in the node's task and are added up before the shuffle
        taps = lattice.withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(124))))
        reach = {f"_j{i}": F.col(nodes[i]) + F.floor(F.col("_o") / scale) % 5 - 2 for i, scale in enumerate((25, 5, 1))}
        taps = taps.withColumns(reach)
        share = F.lit(1.0)
        for i in range(3):
            share = share * _box_weight(F.col(nodes[i]), F.col(f"_j{i}"), F.col(f"_s{i}"))
        taps = taps.withColumn("_share", share).filter(F.col("_share") > 0)
        lattice = taps.groupBy(*tile, *nodes).agg(
            *[F.sum(F.col("_share") * d.noise(str(level), "_j0", "_j1", "_j2", F.lit(i))).alias(f"_n{c}") for i, c in enumerate(COORD)]
        )
        at_corner = [F.max(F.when(F.col("_k") == k, F.col(f"_n{c}"))).alias(f"_n{c}{k}") for c in COORD for k in range(8)]
        noise = join_rows(corners.drop(*size), lattice, [*tile, *nodes]).groupBy(*tile, *cell).agg(*at_corner)
        df = attach_groups(df, cut_lineage(noise), [*tile, *cell])
        for i in range(3):
            df = df.withColumn(f"_f{i}", F.col(f"_t{i}") - F.col(cell[i]))
        weights = [reduce(lambda a, b: a * b, [F.col(f"_f{i}") if bit else F.lit(1.0) - F.col(f"_f{i}") for i, bit in enumerate(bits[k])]) for k in range(8)]
        push = {f"_d{c}": reduce(lambda a, b: a + b, [weights[k] * F.col(f"_n{c}{k}") for k in range(8)]) for c in COORD}
        df = df.withColumns(push).drop(*at, *size, *cell, "_f0", "_f1", "_f2", *[f"_n{c}{k}" for c in COORD for k in range(8)])
        moved = {c: F.col(c) + F.coalesce(f"_d{c}", F.lit(0.0)) * F.lit(float(magnitude)) for c in COORD}
        df = _apply(df, d.on(p), moved)
        df = df.drop(*[f"_d{c}" for c in COORD])
        if level + 1 < len(params):
            df = cut_lineage(df)  # a level reads its points four times
    return df


MADE_AT_ONCE = 100_000  # rows that one input row may unfold into


def _unfold(tiles, tile, n):
    """`n` numbered rows per tile. A large count is unfolded in two steps with a shuffle between,
    so that no single task makes all rows of a tile."""
    last = F.floor((F.col(n) - 1) / F.lit(MADE_AT_ONCE))
    df = tiles.filter(F.col(n) > 0).withColumn("_blk", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    df = df.repartition(*tile, "_blk")
    lo = F.col("_blk") * MADE_AT_ONCE
    hi = F.least(lo + MADE_AT_ONCE, F.col(n).cast("long")) - 1
    return df.withColumn("_i", F.explode(F.sequence(lo, hi))).drop("_blk")


def _fill(made, real, tile, d, intensity_range, color_value, class_label, floor_z):
    """Attributes of synthetic rows, for those columns that the real rows have."""
    have = set(real.columns)
    u = lambda name: d.point_uniform(name, "_i")
    donors = [c for c, want in (("classification", class_label is None),) if want and c in have]
    donors += [c for c in RGB if color_value == "inherit" and c in have]
    if donors:
        # random donor: a uniform rank among the tile's real points
        ranked = rank_by_id(real, tile, "point_id", "_r").select(*tile, "_r", *[F.col(c).alias(f"_from_{c}") for c in donors])
        pick = F.floor(u("donor") * F.col("_n")).cast("long")
        made = made.withColumn("_r", pick).join(ranked, [*tile, "_r"])
    cols = {}
    if "intensity" in have:
        lo, hi = intensity_range
        cols["intensity"] = F.lit(float(lo)) + u("intensity") * F.lit(float(hi) - float(lo))
    for i, c in enumerate(RGB):
        if c in have:
            if color_value == "random":
                cols[c] = u(c) * 255.0
            elif color_value == "inherit":
                cols[c] = F.col(f"_from_{c}")
            else:
                cols[c] = F.lit(float(color_value[i]))
    if "h_norm" in have:
        cols["h_norm"] = F.col("z") - F.col(floor_z)
    if set(NORMAL) <= have:
        raw = [d.noise(c, "_i") for c in NORMAL]
        length = F.sqrt(sum((r * r for r in raw), F.lit(0.0))) + F.lit(1e-8)
        cols.update({c: r / length for c, r in zip(NORMAL, raw)})
    for c in ("echo_first", "echo_last"):
        if c in have:
            cols[c] = F.lit(1)
    if "point_id" in have:  # below zero, so that later steps can tell made points apart from each other and from real ones
        cols["point_id"] = -1 - F.pmod(F.xxhash64(F.lit(d.op), F.lit(d.seed), F.lit(d.epoch), *tile, "_i"), F.lit(1 << 62))
    if "classification" in have:
        if class_label is None:
            cols["classification"] = F.col("_from_classification")
        else:
            cols["classification"] = F.lit(-1 if class_label == "ignore" else int(class_label))
    made = made.withColumns(cols).withColumn("is_synthetic", F.lit(True))
    keep = [*tile, *COORD, *cols, "is_synthetic"]
    widen = [c for c in (*RGB, "intensity") if c in have]
    both = _double(real, widen).withColumn("is_synthetic", F.lit(False))
    return both.unionByName(made.select(*keep), allowMissingColumns=True)


def add_outliers(df, num_outliers=None, ratio=0.01, height_range=(-10.0, 100.0), height_mode="uniform", intensity_range=(0.0, 1.0), color_value=(128, 128, 128), class_label=None, p=0.5, seed=0, epoch=0, tile=TILE):
    """Appends isolated points over the tile's box; point_id is below zero, is_synthetic true."""
    tile = list(tile)
    d = Draw("outliers", seed, epoch, tile)
    lo, hi = (float(v) for v in height_range)
    box = [f(c).alias(f"_{n}{c}") for c in COORD for n, f in (("lo", F.min), ("hi", F.max))]
    t = df.groupBy(*tile).agg(F.count(F.lit(1)).alias("_n"), *box).filter(d.on(p))
    want = F.greatest(F.floor(F.col("_n") * F.lit(float(ratio))), F.lit(1)) if num_outliers is None else F.lit(int(num_outliers))
    made = _unfold(t.withColumn("_m", want.cast("long")), tile, "_m")
    u = lambda name: d.point_uniform(name, "_i")
    between = lambda a, b: a + u("z") * (b - a)
    high = between(F.greatest(F.lit(lo), F.col("_hiz")), F.lit(hi))
    low = between(F.lit(lo), F.least(F.lit(hi), F.col("_loz")))
    modes = {
        "uniform": between(F.lit(lo), F.lit(hi)),
        "bimodal": F.when(F.col("_i") < F.floor(F.col("_m") / 2), high).otherwise(low),
        "high": high,
        "low": low,
    }
    if height_mode not in modes:
        raise ValueError(f"unknown height_mode {height_mode}; known: {sorted(modes)}")
    made = made.withColumns(
        {c: F.col(f"_lo{c}") + u(c) * (F.col(f"_hi{c}") - F.col(f"_lo{c}")) for c in "xy"} | {"z": modes[height_mode]}
    )
    return _fill(made, df, tile, d, intensity_range, color_value, class_label, "_loz")


def add_noise_clusters(df, num_clusters=3, points_per_cluster=(5, 20), radius=2.0, height_offset=(-5.0, 5.0), intensity_range=(0.0, 1.0), color_value="random", class_label="ignore", p=0.3, min_points=1, seed=0, epoch=0, tile=TILE):
    """Appends small clusters around random points of tiles with at least `min_points` points; point_id is below
    zero, is_synthetic true."""
    tile = list(tile)
    d = Draw("clusters", seed, epoch, tile)
    t = df.groupBy(*tile).agg(F.count(F.lit(1)).alias("_n"), F.min("z").alias("_loz")).filter((F.col("_n") >= min_points) & d.on(p))
    order = Window.partitionBy(*tile).orderBy(hash_int(tag(seed, "clusters.centre"), F.lit(epoch), "point_id"), "point_id")
    centres = df.select(*tile, "point_id", *[F.col(c).alias(f"_c{c}") for c in COORD])
    centres = centres.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= num_clusters)
    lo, hi = points_per_cluster
    size = F.lit(lo) + F.floor(d.point_uniform("size", "_k") * F.lit(hi - lo + 1))
    made = centres.join(t, tile).withColumn("_j", F.explode(F.sequence(F.lit(1).cast("long"), size.cast("long"))))
    made = made.withColumn("_i", F.col("_k") * (hi + 1) + F.col("_j"))
    u = lambda name: d.point_uniform(name, "_i")
    theta, phi, r = u("theta") * (2 * math.pi), u("phi") * math.pi, u("r") * float(radius)
    a, b = (float(v) for v in height_offset)
    made = made.withColumns(
        {
            "x": F.col("_cx") + r * F.sin(phi) * F.cos(theta),
            "y": F.col("_cy") + r * F.sin(phi) * F.sin(theta),
            "z": F.col("_cz") + r * F.cos(phi) + F.lit(a) + u("dz") * F.lit(b - a),
        }
    ).drop("point_id")
    return _fill(made, df, tile, d, intensity_range, color_value, class_label, "_loz")
