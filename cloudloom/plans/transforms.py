"""Named transforms and ordered pipelines of them."""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import DataFrame

from cloudloom.operators import augment, normalize, project, sampling
from cloudloom.plans import affine
from cloudloom.schemas import TILE

REGISTRY: dict[str, Callable[..., DataFrame]] = {}


def register_transform(name: str, fn: Callable[..., DataFrame] | None = None):
    """Adds a `DataFrame -> DataFrame` function under a name; usable as a decorator."""

    def add(f):
        if name in REGISTRY:
            raise ValueError(f"transform '{name}' exists already")
        REGISTRY[name] = f
        return f

    return add(fn) if fn else add


for _module, _names in (
    (
        normalize,
        "normalize_unit_sphere standardize_coord minmax_coord positive_shift center_shift centroid_shift auto_intensity "
        "scale_intensity standardize_intensity minmax_intensity auto_color scale_color clip_height standardize_height "
        "log_height bin_height height_above_ground",
    ),
    (
        augment,
        "aug_shift aug_rotate aug_rotate_choice aug_scale aug_flip aug_jitter aug_clip_gauss aug_intensity_scale "
        "aug_intensity_shift aug_intensity_noise aug_intensity_drop aug_intensity_gamma aug_auto_contrast aug_color_shift "
        "aug_color_jitter_noise aug_grayscale aug_color_jitter aug_hue_saturation aug_color_drop aug_elastic "
        "aug_height_scale aug_height_noise add_outliers add_noise_clusters",
    ),
    (project, "local_coord set_columns coerce_types collect_features"),
    (sampling, "grid_sample_train grid_sample_test random_dropout shuffle_points"),
):
    for _name in _names.split():
        register_transform(_name, getattr(_module, _name))


BUILT_IN = dict(REGISTRY)
#: Steps that neither read nor move coordinates or normals, and keep every row: they may come after a move as well as before it.
BESIDE = frozenset(n for n in BUILT_IN if "intensity" in n or "color" in n or n in ("aug_auto_contrast", "aug_grayscale", "aug_hue_saturation"))


def _is_built_in(name) -> bool:
    return isinstance(name, str) and REGISTRY.get(name) is BUILT_IN.get(name)


def pipeline(df: DataFrame, steps: list, tile: list[str] | None = None) -> DataFrame:
    """Applies the steps in order. A step is a name, a `(name, arguments)` pair or a callable; an
    unknown name is an error. Rows that a step filters out are gone for the steps after it.

    `tile` is the key of the tiles, handed to every named step that works by tile: `segment_id` (with file_id) or `part`
    once tiles have been split. Arguments of a step come before it. Steps that move whole tiles, one after another, with
    intensity and colour steps between them, become one map per tile (see `affine`).
    """
    plan = []
    for step in steps:
        if callable(step):
            plan.append((step, None))
            continue
        name, args = (step, {}) if isinstance(step, str) else step
        if name not in REGISTRY:
            raise ValueError(f"unknown transform '{name}'; known: {sorted(REGISTRY)}")
        if tile is not None and "tile" in inspect.signature(REGISTRY[name]).parameters:
            args = {"tile": list(tile), **args}
        plan.append((name, args))

    def moves(i):
        name = plan[i][0]
        return _is_built_in(name) and name in affine.STEPS

    def key(i):
        return list(plan[i][1].get("tile", TILE))

    i = 0
    while i < len(plan):
        name, args = plan[i]
        if moves(i):
            run, beside, end = [i], [], i + 1
            while end < len(plan) and (moves(end) and key(end) == key(i) or _is_built_in(plan[end][0]) and plan[end][0] in BESIDE):
                (run if moves(end) else beside).append(end)
                end += 1
            if len(run) > 1:
                df = affine.run(df, [(plan[k][0], {a: v for a, v in plan[k][1].items() if a != "tile"}) for k in run], key(i))
                for k in beside:
                    df = REGISTRY[plan[k][0]](df, **plan[k][1])
                i = end
                continue
        df = name(df) if args is None else REGISTRY[name](df, **args)
        i += 1
    return df
