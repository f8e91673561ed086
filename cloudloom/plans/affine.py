"""Runs of steps that move whole tiles, as one affine map per tile.

Shifting, scaling, flipping, turning, centring and standardising all map the points of a tile by x -> M x + t. A run of
such steps therefore needs M and t once per tile, not the moved points after every step:

* random parameters are expressions over the tile's key;
* mean and deviation after any map follow from mean and covariance before it;
* a box after a map along the axes follows from the box before it; after a turn it is the range of linear forms
  of the untouched coordinates, which the same aggregate takes.

An aggregate waits only for statistics that its own linear forms depend on. A run whose turns and scales are all drawn
needs one aggregate and one read that applies the map, however long it is; a box or radius after scaling by a
statistic costs one aggregate more.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudloom.operators.augment import COORD, NORMAL, Draw
from cloudloom.operators.ordering import attach_groups
from cloudloom.schemas import TILE
from cloudloom.session import cut_lineage

Value = float | str  # a constant, or the name of a column of the tile table


class Map:
    """The map of a run so far, in names. Every name has a level: the number of aggregates it waits for."""

    def __init__(self, columns: list[str], tile: list[str]):
        self.columns, self.tile = columns, tile
        self.names: list[tuple[str, int, Column]] = []  # in order: name, level, expression over earlier names
        self.stats: dict[str, tuple[int, Column]] = {}  # name: level of its aggregate (from 1), aggregate over the points
        self.levels: dict[str, int] = {}
        self.inputs: dict[str, list[str]] = {}
        self.linear: list[list[Value]] = [[float(i == j) for j in range(3)] for i in range(3)]
        self.offset: list[Value] = [0.0] * 3
        self.normal: list[list[Value]] | None = [[float(i == j) for j in range(3)] for i in range(3)] if set(NORMAL) <= set(columns) else None

    # --- names ------------------------------------------------------------------------------
    def let(self, expression: Column, *inputs: Value) -> str:
        name = f"_a{len(self.names)}"
        self.levels[name] = max((self.level(v) for v in inputs), default=0)
        self.inputs[name] = [v for v in inputs if isinstance(v, str)]
        self.names.append((name, self.levels[name], expression))
        return name

    def level(self, v: Value) -> int:
        return self.levels[v] if isinstance(v, str) else 0

    def sum_of(self, *terms: tuple[Value, Value]) -> Value:
        """The sum of products, constants folded."""
        terms = [(a, b) for a, b in terms if a != 0.0 and b != 0.0]
        if all(not isinstance(v, str) for t in terms for v in t):
            return float(sum(a * b for a, b in terms))
        if len(terms) == 1 and 1.0 in terms[0]:
            return terms[0][0] if terms[0][1] == 1.0 else terms[0][1]
        parts = [col(b) if a == 1.0 else col(a) if b == 1.0 else col(a) * col(b) for a, b in terms]
        return self.let(sum(parts[1:], parts[0]), *[v for t in terms for v in t])

    def either(self, on: Value, yes: Value, no: Value) -> Value:
        if on == 1.0 or yes == no:
            return yes
        return self.let(F.when(col(on) == 1.0, col(yes)).otherwise(col(no)), on, yes, no)

    # --- statistics of the mapped points ----------------------------------------------------
    def _stat(self, name: str, aggregate: Column, *inputs: Value) -> str:
        if name not in self.stats:
            self.levels[name] = 1 + max((self.level(v) for v in inputs), default=0)
            self.inputs[name] = [v for v in inputs if isinstance(v, str)]
            self.stats[name] = (self.levels[name], aggregate)
        return name

    def form(self, i: int) -> Column:
        """Row i of M applied to the untouched coordinates; a coordinate without part in it may be null."""
        parts = [col(m) * F.col(c) if m != 1.0 else F.col(c) for m, c in zip(self.linear[i], COORD) if m != 0.0]
        return sum(parts[1:], parts[0]) if parts else F.lit(0.0)

    def mean(self, i: int) -> Value:
        means = [self._stat(f"_mean_{c}", F.avg(c)) if m != 0.0 else 0.0 for m, c in zip(self.linear[i], COORD)]
        return self.sum_of(*zip(self.linear[i], means), (self.offset[i], 1.0))

    def deviation(self, i: int) -> Value:
        row = self.linear[i]
        terms = []
        for j in range(3):
            for k in range(j, 3):
                if row[j] != 0.0 and row[k] != 0.0:
                    a, b = COORD[j], COORD[k]
                    c = self._stat(f"_var_{a}", F.var_pop(a)) if j == k else self._stat(f"_cov_{a}{b}", F.covar_pop(a, b))
                    terms.append((self.sum_of((row[j], row[k])), self.sum_of((c, 1.0 if j == k else 2.0))))
        variance = self.sum_of(*terms)
        return self.let(F.sqrt(F.greatest(col(variance), F.lit(0.0))), variance)

    def box(self, i: int) -> tuple[Value, Value]:
        row = self.linear[i]
        moving = [j for j in range(3) if row[j] != 0.0]
        if len(moving) == 1:
            m, c = row[moving[0]], COORD[moving[0]]
            ends = self._stat(f"_min_{c}", F.min(c)), self._stat(f"_max_{c}", F.max(c))
            a, b = (self.sum_of((m, e), (self.offset[i], 1.0)) for e in ends)
            if m == 1.0:
                return a, b
            return self.let(F.least(col(a), col(b)), a, b), self.let(F.greatest(col(a), col(b)), a, b)
        key = "_".join(str(m) for m in row).replace(".", "p").replace("-", "n")
        low = self._stat(f"_low_{key}", F.min(self.form(i)), *row)
        high = self._stat(f"_high_{key}", F.max(self.form(i)), *row)
        return self.sum_of((low, 1.0), (self.offset[i], 1.0)), self.sum_of((high, 1.0), (self.offset[i], 1.0))

    def radius(self) -> Value:
        """Largest distance of a mapped point from the mapped mean, whatever the offset."""
        means = [self._stat(f"_mean_{c}", F.avg(c)) for c in COORD]
        apart = [[col(v) * (F.col(c) - F.col(m)) for v, c, m in zip(row, COORD, means) if v != 0.0] for row in self.linear]
        norm = F.sqrt(sum((sum(parts[1:], parts[0]) ** 2 for parts in apart if parts), F.lit(0.0)))
        return self._stat(f"_radius{len(self.stats)}", F.max(norm), *[v for row in self.linear for v in row], *means)

    # --- changes of the map -----------------------------------------------------------------
    def shift(self, i: int, by: Value, sign=1.0):
        self.offset[i] = self.sum_of((self.offset[i], 1.0), (by, sign))

    def scale(self, i: int, by: Value):
        self.linear[i] = [self.sum_of((m, by)) for m in self.linear[i]]
        self.offset[i] = self.sum_of((self.offset[i], by))

    def divide(self, i: int, by: Value):
        """Division by a size; by 1 where it is 0."""
        self.scale(i, self.let(1.0 / F.when(col(by) == 0, F.lit(1.0)).otherwise(col(by)), by))

    def turn(self, turn: list[list[Value]], on: Value, center: list[Value], normals=True):
        def times(a, b):
            return [[self.sum_of(*[(a[i][k], b[k][j]) for k in range(3)]) for j in range(3)] for i in range(3)]

        moved = [self.sum_of((self.offset[i], 1.0), (center[i], -1.0)) for i in range(3)]
        offset = [self.sum_of(*[(turn[i][k], moved[k]) for k in range(3)], (center[i], 1.0)) for i in range(3)]
        linear = times(turn, self.linear)
        keep = lambda i: turn[i] == [float(i == j) for j in range(3)]  # noqa: E731 - a row that the turn leaves alone
        for i in range(3):
            if not keep(i):
                self.offset[i] = self.either(on, offset[i], self.offset[i])
                self.linear[i] = [self.either(on, a, b) for a, b in zip(linear[i], self.linear[i])]
        if normals and self.normal:
            turned = times(turn, self.normal)
            self.normal = [n if keep(i) else [self.either(on, a, b) for a, b in zip(turned[i], n)] for i, n in enumerate(self.normal)]

    def drawn(self, value: Column) -> str:
        return self.let(value.cast("double"))


def col(v: Value) -> Column:
    return F.col(v) if isinstance(v, str) else F.lit(v)


# --- steps ------------------------------------------------------------------------------------
STEPS: dict[str, Callable] = {}


def _step(fn):
    STEPS[fn.__name__] = fn
    return fn


def _axes(apply_z):
    return range(3) if apply_z else range(2)


@_step
def centroid_shift(m: Map, apply_z=True):
    for i, mean in [(i, m.mean(i)) for i in _axes(apply_z)]:
        m.shift(i, mean, -1.0)


@_step
def center_shift(m: Map, apply_z=True):
    boxes = [m.box(i) for i in _axes(apply_z)]
    for i, (low, high) in enumerate(boxes):
        m.shift(i, low if i == 2 else m.sum_of((low, 0.5), (high, 0.5)), -1.0)


@_step
def positive_shift(m: Map):
    for i, (low, _) in enumerate([m.box(i) for i in range(3)]):
        m.shift(i, low, -1.0)


@_step
def standardize_coord(m: Map, apply_z=True):
    for i, mean, size in [(i, m.mean(i), m.deviation(i)) for i in _axes(apply_z)]:
        m.shift(i, mean, -1.0)
        m.divide(i, size)


@_step
def minmax_coord(m: Map, apply_z=True):
    for i, (low, high) in [(i, m.box(i)) for i in _axes(apply_z)]:
        m.shift(i, low, -1.0)
        m.divide(i, m.sum_of((high, 1.0), (low, -1.0)))


@_step
def normalize_unit_sphere(m: Map):
    centroid_shift(m)
    radius = m.radius()
    for i in range(3):
        m.divide(i, radius)


@_step
def aug_shift(m: Map, shift=((-0.2, 0.2), (-0.2, 0.2), (0, 0)), seed=0, epoch=0):
    d = Draw("shift", seed, epoch, m.tile)
    for i, (c, s) in enumerate(zip(COORD, shift)):
        m.shift(i, m.drawn(d.value(c, *s)))


@_step
def aug_scale(m: Map, scale=(0.95, 1.05), anisotropic=False, seed=0, epoch=0):
    d = Draw("scale", seed, epoch, m.tile)
    drawn = [m.drawn(d.value(c, *scale)) for c in (COORD if anisotropic else ["all"])]
    for i in range(3):
        m.scale(i, drawn[i % len(drawn)])


@_step
def aug_flip(m: Map, p=0.5, seed=0, epoch=0):
    d = Draw("flip", seed, epoch, m.tile)
    for i, axis in enumerate("xy"):
        sign = m.drawn(F.when(d.on(p, axis), F.lit(-1.0)).otherwise(F.lit(1.0)))
        m.scale(i, sign)
        if f"normal_{axis}" in m.columns and m.normal:
            m.normal[i] = [m.sum_of((n, sign)) for n in m.normal[i]]


def _turn(m: Map, angle: Column, on: Column, axis: str, center, always: bool):
    cos, sin = m.drawn(F.cos(angle * F.lit(math.pi))), m.drawn(F.sin(angle * F.lit(math.pi)))
    back = m.sum_of((sin, -1.0))
    rows = {
        "x": [[1.0, 0.0, 0.0], [0.0, cos, back], [0.0, sin, cos]],
        "y": [[cos, 0.0, sin], [0.0, 1.0, 0.0], [back, 0.0, cos]],
        "z": [[cos, back, 0.0], [sin, cos, 0.0], [0.0, 0.0, 1.0]],
    }
    if axis not in rows:
        raise ValueError("axis must be x, y or z")
    turned = [i for i in range(3) if axis != COORD[i]]
    if center is None:  # the middle of the box; the axis of the turn needs none
        ends = {i: m.box(i) for i in turned}
        middle = [m.sum_of((ends[i][0], 0.5), (ends[i][1], 0.5)) if i in ends else 0.0 for i in range(3)]
    else:
        middle = [float(v) for v in center]
    m.turn(rows[axis], 1.0 if always else m.drawn(on), middle)


@_step
def aug_rotate(m: Map, angle=(-1, 1), center=None, axis="z", p=0.5, seed=0, epoch=0):
    d = Draw("rotate", seed, epoch, m.tile)
    _turn(m, d.value("angle", *angle), d.on(p), axis, center, p >= 1)


@_step
def aug_rotate_choice(m: Map, angles=(0.5, 1.0, 1.5), center=None, axis="z", p=0.75, seed=0, epoch=0):
    d = Draw("rotate_choice", seed, epoch, m.tile)
    angle = F.element_at(F.array(*[F.lit(float(a)) for a in angles]), (d.pick("angle", len(angles)) + 1).cast("int"))
    _turn(m, angle, d.on(p), axis, center, p >= 1)


# --- a run ------------------------------------------------------------------------------------
def _needed(m: Map, wanted: list[Value]) -> set[str]:
    """Names that some names rest on, themselves included."""
    seen, todo = set(), [v for v in wanted if isinstance(v, str)]
    while todo:
        name = todo.pop()
        if name not in seen:
            seen.add(name)
            todo += m.inputs[name]
    return seen


def run(df: DataFrame, steps: list[tuple[str, dict]], tile: list[str] = TILE) -> DataFrame:
    """Applies a run of steps of this module, each a name and its arguments; `tile` is the key of the tiles.

    Statistics ignore null coordinates, and a moved coordinate is null if one that it rests on is. Moved columns become
    DOUBLE. Null keys are a tile of their own, and no row is lost.
    """
    tile = list(tile)
    m = Map(df.columns, tile)
    for name, args in steps:
        STEPS[name](m, **args)
    out = [v for row in m.linear for v in row] + m.offset + ([v for row in m.normal for v in row] if m.normal else [])
    needed = _needed(m, out)
    names = [n for n in m.names if n[0] in needed]
    stats = {n: s for n, s in m.stats.items() if n in needed}
    drawn = {n: e for n, level, e in names if level == 0}

    table = None
    for level in range(1, max((s[0] for s in stats.values()), default=0) + 1):
        asked = [e.alias(n) for n, (at, e) in stats.items() if at == level]
        points = df.select(*tile, *COORD)
        if table is None:
            for n, e in drawn.items():
                points = points.withColumn(n, e)
        else:
            points = attach_groups(points, table, tile)
        found = cut_lineage(points.groupBy(*tile).agg(*asked))
        table = found if table is None else attach_groups(table, found, tile)
        for n, at, e in names:
            if at == level or level == 1 and at == 0:
                table = table.withColumn(n, e)
        table = cut_lineage(table)
    used = [v for v in dict.fromkeys(out) if isinstance(v, str)]
    if table is None:
        moved = df
        for n, e in drawn.items():
            moved = moved.withColumn(n, e)
    else:
        moved = attach_groups(df, table.select(*tile, *used), tile)

    def applied(row, offset, columns):
        parts = []
        for v, c in zip(row, columns):
            if v != 0.0:
                whole = F.col(c).cast("double") if v == 1.0 else col(v) * F.col(c)
                # a turn that a tile takes no part in has a coefficient of 0: the coordinate does not matter then
                parts.append(whole if v == 1.0 or len([w for w in row if w != 0.0]) == 1 else F.when(col(v) == 0, F.lit(0.0)).otherwise(whole))
        if offset != 0.0:
            parts.append(col(offset))
        return sum(parts[1:], parts[0]) if parts else F.lit(0.0)

    same = lambda row, i: row == [float(i == j) for j in range(3)]
    result = {c: applied(m.linear[i], m.offset[i], COORD) for i, c in enumerate(COORD) if not same(m.linear[i], i) or m.offset[i] != 0.0}
    if m.normal:
        result |= {c: applied(m.normal[i], 0.0, NORMAL) for i, c in enumerate(NORMAL) if not same(m.normal[i], i)}
    return moved.withColumns(result).select(*df.columns)
