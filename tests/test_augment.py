import colorsys

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudloom.functions import color
from cloudloom.operators import augment, tiling
from cloudloom.operators.augment import Draw
from cloudloom.plans.transforms import pipeline
from cloudloom.schemas import TILE


@pytest.fixture(scope="module")
def tiled(cloud):
    return tiling.tile_assign(cloud, (50.0, 50.0)).cache()


def test_elastic_equals_a_dense_lattice(spark, tiled):
    grain, size = 20.0, 3.0
    one = tiled.filter("file_id = 0 AND xb = 0 AND yb = 0")
    got = augment.aug_elastic(one, ((grain, size),), p=1).select("point_id", "x", "y", "z").toPandas().set_index("point_id")
    pts = one.select("point_id", "x", "y", "z").toPandas().set_index("point_id")
    low = pts.min().to_numpy()
    dims = ((pts.max().to_numpy() - low) // grain).astype(int) + 3
    grid = np.stack(np.meshgrid(*[np.arange(d) for d in dims], indexing="ij"), -1).reshape(-1, 3)
    nodes = spark.createDataFrame([tuple(map(int, g)) for g in grid], "_j0 bigint, _j1 bigint, _j2 bigint")
    nodes = nodes.withColumns({"file_id": F.lit(0), "pass_id": F.lit(0), "xb": F.lit(0), "yb": F.lit(0)})
    d = Draw("elastic")
    cols = [d.noise("0", "_j0", "_j1", "_j2", F.lit(i)).alias(f"n{i}") for i in range(3)]
    pdf = nodes.select("_j0", "_j1", "_j2", *cols).toPandas()
    noise = np.zeros((*dims, 3))
    noise[pdf["_j0"], pdf["_j1"], pdf["_j2"]] = pdf[["n0", "n1", "n2"]].to_numpy()
    for _ in range(2):
        for axis in range(3):
            wide = np.pad(noise, [(1, 1) if a == axis else (0, 0) for a in range(4)])
            take = lambda s: np.take(wide, range(s, s + noise.shape[axis]), axis)  # noqa: B023, E731
            noise = (take(0) + take(1) + take(2)) / 3
    for pid, p in pts.iterrows():
        at = (p.to_numpy() - low) / grain + 1
        i = np.floor(at).astype(int)
        f = at - i
        push = np.zeros(3)
        for k in range(8):
            b = np.array([k & 1, k >> 1 & 1, k >> 2])
            push += np.prod(np.where(b == 1, f, 1 - f)) * noise[tuple(i + b)]
        assert np.allclose(got.loc[pid].to_numpy(), p.to_numpy() + push * size)


@pytest.mark.parametrize("mode", ["uniform", "bimodal", "high", "low"])
def test_outliers(tiled, mode, monkeypatch):
    monkeypatch.setattr(augment, "MADE_AT_ONCE", 4)
    got = augment.add_outliers(tiled, ratio=0.05, height_mode=mode, p=1, color_value="inherit").cache()
    made, real = got.filter("is_synthetic").toPandas(), got.filter("NOT is_synthetic").toPandas()
    assert len(real) == tiled.count()
    sizes = real.groupby(TILE).size()
    counts = made.groupby(TILE).size()
    assert (counts == np.maximum(1, (sizes * 0.05).astype(int))).all()
    box = real.groupby(TILE)[["x", "y", "z"]].agg(["min", "max"])
    pairs = {k: set(map(tuple, g[["red", "green", "blue", "classification"]].to_numpy())) for k, g in real.groupby(TILE)}
    for row in made.itertuples():
        key = (row.file_id, row.pass_id, row.xb, row.yb)
        b = box.loc[key]
        assert b["x"]["min"] <= row.x <= b["x"]["max"] and b["y"]["min"] <= row.y <= b["y"]["max"]
        assert -10 <= row.z <= 100
        assert mode != "high" or row.z >= b["z"]["max"]
        assert mode != "low" or row.z <= b["z"]["min"]
        assert (row.red, row.green, row.blue, row.classification) in pairs[key]
    assert (made["point_id"] < 0).all() and made["point_id"].is_unique


def test_noise_clusters(tiled):
    got = augment.add_noise_clusters(tiled, p=1, class_label="ignore", min_points=10).filter("is_synthetic").toPandas()
    sizes = tiled.groupBy(*TILE).count().filter("count >= 10").count()
    per = got.groupby(TILE).size()
    assert len(per) == sizes and per.between(15, 60).all()
    assert (got["classification"] == -1).all()
    with pytest.raises(ValueError):
        augment.add_outliers(tiled, height_mode="sideways")


def test_same_seed_same_rows_whatever_the_partitioning(tiled):
    steps = [("aug_rotate", {"p": 1}), ("aug_jitter", {}), ("aug_color_jitter", {"brightness": 0.4, "contrast": 0.4, "hue": 0.1})]
    cols = ["point_id", *[F.round(c, 9) for c in ("x", "y", "z", "red", "green", "blue")]]
    a = pipeline(tiled, steps).select(*cols)
    b = pipeline(tiled.repartition(5), steps).select(*cols)
    assert a.exceptAll(b).isEmpty()


def test_unknown_transform(tiled):
    with pytest.raises(ValueError, match="unknown transform"):
        pipeline(tiled, ["no_such_step"])


def test_colour_space_round_trip(spark):
    rng = np.random.default_rng(0)
    rows = [tuple(float(v) for v in r) for r in rng.random((60, 3))] + [(0.5, 0.5, 0.5), (0.0, 0.0, 0.0), (1.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "r double, g double, b double")
    h, s, v = color.rgb_to_hsv(F.col("r"), F.col("g"), F.col("b"))
    df = df.withColumns({"h": h, "s": s, "v": v})
    back = color.hsv_to_rgb(F.col("h"), F.col("s"), F.col("v"))
    for r in df.select("*", *[c.alias(f"o{i}") for i, c in enumerate(back)]).collect():
        assert np.allclose((r.h, r.s, r.v), colorsys.rgb_to_hsv(r.r, r.g, r.b))
        assert np.allclose((r.o0, r.o1, r.o2), (r.r, r.g, r.b))


def test_elastic_moves_points_with_one_id_each_by_itself(spark, tiled):
    one = tiled.filter("file_id = 0 AND xb = 0 AND yb = 0")
    twice = one.unionByName(one.withColumn("point_id", F.lit(-7).cast("long")))
    got = augment.aug_elastic(twice, ((20.0, 3.0),), p=1)
    alone, same = (got.filter(c).select("x", "y", "z", "intensity").toPandas().sort_values(["intensity", "x", "y", "z"]).to_numpy() for c in ("point_id >= 0", "point_id = -7"))
    assert len(alone) == len(same) > 0 and np.allclose(alone, same)
