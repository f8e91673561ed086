"""Runs of moving steps as one map per tile, beside the steps one after another."""

import random

import pytest
from pyspark.sql import functions as F

from cloudloom.operators.tiling import tile_assign
from cloudloom.plans import affine
from cloudloom.plans.transforms import REGISTRY, pipeline
from cloudloom.schemas import TILE

RUNS = {
    "drawn": ["center_shift", ("aug_rotate", {"p": 1.0, "seed": 1}), ("aug_scale", {"seed": 2, "anisotropic": True}), ("aug_flip", {"seed": 3}),
              ("aug_shift", {"seed": 4, "shift": ((-5, 5), (-5, 5), (-1, 1))}), ("aug_rotate", {"p": 0.5, "seed": 5, "axis": "x"})],
    "by statistics": ["centroid_shift", "center_shift", "standardize_coord", ("aug_rotate", {"p": 1.0, "seed": 1}),
                      ("aug_rotate", {"p": 1.0, "seed": 2, "axis": "x"}), "normalize_unit_sphere"],
    "turned": [("aug_rotate_choice", {"seed": 1}), "minmax_coord", ("aug_rotate", {"p": 0.5, "seed": 2, "axis": "y"}), "standardize_coord",
               ("aug_rotate", {"p": 1.0, "seed": 3, "center": (1, 2, 3)}), "positive_shift", "minmax_coord"],
    "plane": [("center_shift", {"apply_z": False}), ("centroid_shift", {"apply_z": False}), ("standardize_coord", {"apply_z": False}), ("aug_flip", {"p": 1})],
}


def scans(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


def one_by_one(df, steps):
    for step in steps:
        name, args = (step, {}) if isinstance(step, str) else step
        df = REGISTRY[name](df, **args)
    return df


def close(a, b, columns):
    both = a.select("point_id", *columns).join(b.select("point_id", *[F.col(c).alias(f"b_{c}") for c in columns]), "point_id")
    assert both.count() == a.count() == b.count()
    apart = [f"NOT (abs({c} - b_{c}) <= 1e-7 * (1 + abs(b_{c})) OR {c} IS NULL AND b_{c} IS NULL)" for c in columns]
    assert both.filter(" OR ".join(apart)).count() == 0


@pytest.fixture(scope="module")
def tiled(cloud):
    normals = {f"normal_{c}": F.sin(F.col("point_id") * k) for k, c in enumerate("xyz", 1)}
    return tile_assign(cloud, (25.0, 25.0)).withColumns(normals).cache()


@pytest.mark.parametrize("name", RUNS)
def test_run_is_its_steps(tiled, name):
    steps = RUNS[name]
    close(pipeline(tiled, steps), one_by_one(tiled, steps), ["x", "y", "z", "normal_x", "normal_y", "normal_z"])


@pytest.mark.parametrize("seed", range(3))
def test_random_runs(tiled, seed):
    rng = random.Random(seed)
    steps = []
    for k in range(5):
        name = rng.choice(sorted(affine.STEPS))
        args = {"seed": rng.randrange(99)} if name.startswith("aug") else {}
        if name == "aug_rotate":
            args |= {"axis": rng.choice("xyz"), "p": rng.choice([0.5, 1.0])}
        steps.append((name, args))
    close(pipeline(tiled, steps), one_by_one(tiled, steps), ["x", "y", "z", "normal_x", "normal_y", "normal_z"])


def reads(monkeypatch, df, steps):
    """Reads of the input by the aggregates of a pipeline, and by the plan that it returns."""
    seen, cut = [], affine.cut_lineage
    monkeypatch.setattr(affine, "cut_lineage", lambda d: seen.append(scans(d)) or cut(d))
    out = pipeline(df, steps)
    return sum(seen), scans(out)


def test_reads_of_the_input(spark, cloud, tmp_path, monkeypatch):
    cloud.write.parquet(path := str(tmp_path / "points"))
    stored = tile_assign(spark.read.parquet(path), (25.0, 25.0))
    origin = scans(stored)  # tiling reads the origin of every file first
    assert reads(monkeypatch, stored, RUNS["drawn"]) == (origin, origin)  # six steps: one aggregate, one application
    assert reads(monkeypatch, stored, RUNS["by statistics"]) == (2 * origin, origin)
    assert reads(monkeypatch, stored, [("aug_shift", {}), ("aug_scale", {}), ("aug_flip", {})]) == (0, origin)


def test_other_columns_between(tiled):
    steps = ["center_shift", ("aug_intensity_scale", {"seed": 1}), ("aug_rotate", {"p": 1.0, "seed": 1}), "auto_color", ("aug_flip", {"seed": 2})]
    close(pipeline(tiled, steps), one_by_one(tiled, steps), ["x", "y", "z", "intensity", "red", "green"])


def test_null_keys_and_coordinates(tiled):
    odd = tiled.withColumns({
        "x": F.when(F.col("point_id") % 50 != 7, F.col("x")),
        "z": F.when(F.col("point_id") % 50 != 8, F.col("z")),
        "file_id": F.when(F.col("point_id") % 10 != 3, F.col("file_id")),
    })
    steps = ["center_shift", ("aug_rotate", {"p": 0.5, "seed": 1}), ("aug_flip", {"seed": 3})]
    close(pipeline(odd, steps), one_by_one(odd, steps), ["x", "y", "z"])
    empty = pipeline(odd.filter("false"), steps)
    assert empty.count() == 0 and empty.columns == odd.columns


def test_replaced_steps_stay_their_own(tiled, monkeypatch):
    monkeypatch.setitem(REGISTRY, "center_shift", lambda df, tile=TILE: df.withColumn("x", F.lit(1.0)))
    got = pipeline(tiled, ["center_shift", ("aug_scale", {"scale": (2.0, 2.0)})])
    assert got.filter("x <> 2").count() == 0
