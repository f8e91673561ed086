"""Column projections, label mapping and row filters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloudloom.functions.vectors import argmax
from cloudloom.operators.ordering import with_group_stats
from cloudloom.schemas import POINTS_OPTIONAL, POINTS_REQUIRED, require

INTENSITY_MAX = 65535.0  # fixed value: 16-bit intensity


def conform_fields(points: DataFrame) -> DataFrame:
    """The full point contract; absent optional fields become null, absent classes 0."""
    require(points, POINTS_REQUIRED, "points")
    cols = [F.col(c).cast(t).alias(c) if t else F.col(c) for c, t in POINTS_REQUIRED.items()]
    for name, kind in POINTS_OPTIONAL.items():
        if name in points.columns:
            cols.append(F.col(name).cast(kind).alias(name))
        else:
            cols.append(F.lit(0 if name == "classification" else None).cast(kind).alias(name))
    return points.select(*cols)


# Asset -> (source columns, output columns)
ASSETS: dict[str, tuple[list[str], Callable[[], dict[str, Column]]]] = {}


def asset(name, *sources):
    def register(fn):
        ASSETS[name] = (list(sources), fn)
        return fn

    return register


@asset("coord", "x", "y", "z")
def _coord():
    return {c: F.col(c) for c in "xyz"}


@asset("intensity", "intensity")
def intensity_unit():
    return {"intensity": F.col("intensity") / F.lit(INTENSITY_MAX)}


@asset("color", "red", "green", "blue")
def color_triplet():
    return {"color": F.array(*[F.col(c).cast("double") for c in ("red", "green", "blue")])}


@asset("normal", "normal_x", "normal_y", "normal_z")
def normal_triplet():
    return {"normal": F.array(*[F.col(f"normal_{c}").cast("double") for c in "xyz"])}


@asset("echo", "return_number", "number_of_returns")
def echo_flags():
    def flag(test):
        return F.when(test, 1).otherwise(-1)

    return {
        "echo_first": flag(F.col("return_number") == 1),
        "echo_last": flag(F.col("return_number") == F.col("number_of_returns")),
    }


@asset("h_norm", "h_norm")
def _h_norm():
    return {"h_norm": F.col("h_norm")}


@asset("class", "classification")
def _class():
    return {"class": F.col("classification").cast("int")}


def select_assets(points: DataFrame, assets: list[str], keys: list[str], mapping=None, ignore_label=-1) -> DataFrame:
    """Only the requested assets; an unknown one or a missing source column is an error."""
    unknown = [a for a in assets if a not in ASSETS]
    if unknown:
        raise ValueError(f"unknown assets {unknown}; known: {sorted(ASSETS)}")
    out = {}
    for a in assets:
        sources, build = ASSETS[a]
        require(points, sources, f"asset '{a}'")
        out.update(build())
    if "class" in out and mapping is not None:
        out["class"] = map_class(out["class"], mapping, ignore_label)
    return points.select(*keys, *[c.alias(n) for n, c in out.items()])


def local_coord(points: DataFrame, tile: list[str], keep_offset=False) -> DataFrame:
    """Coordinates relative to the tile's minimum; `offset_*` restores them."""
    df = with_group_stats(points, tile, [F.min(c).alias(f"offset_{c}") for c in "xyz"])
    df = df.withColumns({c: F.col(c) - F.col(f"offset_{c}") for c in "xyz"})
    return df if keep_offset else df.drop(*[f"offset_{c}" for c in "xyz"])


def global_coord(points: DataFrame) -> DataFrame:
    df = points.withColumns({c: F.col(c) + F.col(f"offset_{c}") for c in "xyz"})
    return df.drop(*[f"offset_{c}" for c in "xyz"])


def ground_flag(points: DataFrame, ground_class: int | None = 2) -> DataFrame:
    if ground_class is None:
        return points
    return points.withColumn("is_ground", F.col("classification") == F.lit(ground_class))


class ClassMapping:
    """Raw label -> training label 0..K-1, given as None (identity), a list of raw labels, or a
    dict. The reverse of a many-to-one mapping keeps the last raw label."""

    def __init__(self, mapping=None, ignore_label=-1):
        self.ignore_label = ignore_label
        if mapping is None:
            self.forward = None
        elif isinstance(mapping, dict):
            self.forward = {int(k): int(v) for k, v in mapping.items()}
        elif isinstance(mapping, (list, tuple)):
            self.forward = {int(raw): i for i, raw in enumerate(mapping)}
        else:
            raise TypeError("class mapping must be None, a list or a dict")
        if self.forward:
            targets = {t for t in self.forward.values() if t != ignore_label}
            if targets != set(range(len(targets))):
                raise ValueError(f"training labels must be 0..K-1, got {sorted(targets)}")

    @property
    def reverse(self):
        return None if self.forward is None else {v: k for k, v in self.forward.items()}

    @property
    def num_classes(self):
        return None if self.forward is None else len(set(self.forward.values()) - {self.ignore_label})

    def table(self, spark) -> DataFrame:
        rows = sorted((self.forward or {}).items())
        return spark.createDataFrame(rows, "raw_label int, train_label int")


def _lookup(c: Column, mapping: dict) -> Column:
    if not mapping:
        return F.lit(None).cast("int")
    items = [F.lit(v) for kv in sorted(mapping.items()) for v in kv]
    return F.try_element_at(F.create_map(*items), c.cast("int"))


def map_class(c: Column | str, mapping, ignore_label=-1) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    m = mapping if isinstance(mapping, ClassMapping) else ClassMapping(mapping, ignore_label)
    return c.cast("int") if m.forward is None else F.coalesce(_lookup(c, m.forward), F.lit(m.ignore_label))


def unmap_class(c: Column | str, mapping, unknown="ignore", ignore_label=-1) -> Column:
    """Training label -> raw label; an unknown one becomes `ignore_label` or is kept."""
    c = F.col(c) if isinstance(c, str) else c
    m = mapping if isinstance(mapping, ClassMapping) else ClassMapping(mapping, ignore_label)
    if m.forward is None:
        return c.cast("int")
    if unknown not in ("ignore", "keep"):
        raise ValueError("unknown must be 'ignore' or 'keep'")
    return F.coalesce(_lookup(c, m.reverse), F.lit(m.ignore_label) if unknown == "ignore" else c.cast("int"))


def class_names(c: Column | str, num_classes: int, names: list[str] | None = None, reverse: dict | None = None) -> Column:
    """User names, else `Class {raw}` where a raw label is known, else `Class {i}`."""
    c = F.col(c) if isinstance(c, str) else c
    if names is not None:
        if len(names) != num_classes:
            raise ValueError(f"{len(names)} names for {num_classes} classes")
        return F.element_at(F.array(*[F.lit(n) for n in names]), c.cast("int") + 1)
    raw = F.coalesce(_lookup(c, reverse or {}), c.cast("int"))
    return F.concat(F.lit("Class "), raw.cast("string"))


def argmax_label(predictions: DataFrame, logits="logits", out="pred") -> DataFrame:
    """Labels pass through; logits give the first largest class."""
    if not isinstance(predictions.schema[logits].dataType, T.ArrayType):
        return predictions.withColumn(out, F.col(logits).cast("int"))
    return predictions.withColumn(out, argmax(logits))


def drop_ignored(df: DataFrame, target="target", ignore_index=-1) -> DataFrame:
    return df.filter(F.col(target) != F.lit(ignore_index))


def pick_tiles(tiles: DataFrame, segment_ids=None, max_segments=None, file="file_id", segment="segment_id") -> DataFrame:
    if segment_ids is not None:
        tiles = tiles.filter(F.col(segment).isin([int(s) for s in segment_ids]))
    if max_segments is not None:
        # the limit runs per map task before the shuffle (window group limit)
        w = Window.partitionBy(file).orderBy(segment)
        tiles = tiles.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= max_segments).drop("_rn")
    return tiles


def collect_features(df: DataFrame, keys: list[str], features: list[str], out="feat") -> DataFrame:
    """One feature array per point; scalar and array columns are concatenated in order."""
    parts = []
    for f in features:
        if isinstance(df.schema[f].dataType, T.ArrayType):
            parts.append(F.transform(f, lambda v: v.cast("float")))
        else:
            parts.append(F.array(F.col(f).cast("float")))
    return df.select(*keys, F.concat(*parts).alias(out))


def set_columns(df: DataFrame, values: dict) -> DataFrame:
    return df.withColumns({k: F.lit(v) for k, v in values.items()})


def _coerced(kind):
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return T.LongType()
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return T.FloatType()
    if isinstance(kind, (T.BooleanType, T.StringType)):
        return kind
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_coerced(kind.elementType))
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _coerced(f.dataType)) for f in kind])
    raise TypeError(f"cannot coerce {kind.simpleString()}")


def coerce_types(df: DataFrame) -> DataFrame:
    """Integers to bigint, floating point to float, nested types likewise; anything else raises."""
    return df.select(*[F.col(f.name).cast(_coerced(f.dataType)).alias(f.name) for f in df.schema])


def take_rows(df: DataFrame, selected: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(selected.select(*keys).distinct(), keys, "left_semi")


def repeat_dataset(manifest: DataFrame, loop: int) -> DataFrame:
    return manifest.withColumn("loop", F.explode(F.sequence(F.lit(0), F.lit(loop - 1))))


def sampling_params(tiles: DataFrame, max_loops: int | None = None, density="max_voxel_density") -> DataFrame:
    """`loops` draws of `ppl` points per voxel that together reach the densest voxel's points."""
    n = F.col(density)
    if max_loops is None:
        return tiles.withColumns({"loops": n.cast("int"), "ppl": F.lit(1)})
    capped = n > max_loops
    return tiles.withColumns(
        {
            "loops": F.when(capped, F.lit(max_loops)).otherwise(n).cast("int"),
            "ppl": F.when(capped, F.ceil(n / F.lit(max_loops))).otherwise(F.lit(1)).cast("int"),
        }
    )
