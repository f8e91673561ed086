import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cloudloom.operators.batching import _walk, pack_batches


def next_fit(sizes, limit):
    out, batch, held, empty = [], 0, 0, True
    for n in sizes:
        if not empty and held + n > limit:
            batch, held = batch + 1, 0
        held, empty = held + n, False
        out.append(batch)
    return out


def test_runs_without_points_and_a_very_large_sample(spark):
    sizes = [3, 0, 0, 60, *[0] * 200, 10**9, 0, 0, 64, 0, 1, *[0] * 50, 63, 64, 65, 0]
    pdf = pd.DataFrame({"o": range(len(sizes)), "n": sizes})
    for block in (20, 100_000):
        got = pack_batches(spark.createDataFrame(pdf), "o", "n", 64, block=block).toPandas().sort_values("o")
        assert got["batch_id"].tolist() == next_fit(sizes, 64)


def test_a_million_samples_without_points():
    sizes = np.zeros(1_000_000, np.int64)
    sizes[::1000] = 30
    batch = _walk(sizes, 64)
    assert batch[-1] == 499 and (np.bincount(batch, weights=sizes) == 60).all()
    ones = _walk(np.ones(200_000, np.int64), 7)
    assert (ones == np.arange(200_000) // 7).all()


def test_null_shards_and_sizes_stay(spark):
    rows = [(i, None if i % 5 == 1 else 10, None if i % 2 else "a") for i in range(40)]
    got = pack_batches(spark.createDataFrame(rows, "o long, n long, s string"), "o", "n", 35, ["s"]).toPandas()
    assert len(got) == 40
    for null in (True, False):
        mine = got[got["s"].isna() == null].sort_values("o")
        assert mine["batch_id"].tolist() == next_fit(mine["n"].fillna(0).tolist(), 35)


@pytest.mark.parametrize("shard", [[], ["s"]])
@pytest.mark.parametrize("block", [7, 100_000])
def test_packing_equals_the_sequential_walk(spark, shard, block):
    rng = np.random.default_rng(5)
    n = 300
    sizes = rng.integers(0, 30, size=n)
    sizes[::40] = 260  # above the limit
    pdf = pd.DataFrame({"o": rng.permutation(n) * 3, "n": sizes, "s": np.where(np.arange(n) % 3 == 0, 1, 0)})
    got = pack_batches(spark.createDataFrame(pdf), "o", "n", 64, shard, block=block).toPandas()
    for _, rows in got.groupby(shard or (lambda i: 0)):
        rows = rows.sort_values("o")
        assert rows["batch_id"].tolist() == next_fit(rows["n"].tolist(), 64)
        total = rows.groupby("batch_id")["n"].agg(["sum", "size"])
        assert ((total["sum"] <= 64) | (total["size"] == 1) | (rows.groupby("batch_id")["n"].max() > 64)).all()


def test_a_large_batch_passes_in_parts_or_is_refused_by_name(spark):
    from cloudloom.plans.jobs import predict_points, predict_tiles

    points = spark.range(50_000).select(F.when(F.col("id") < 40_000, 1).otherwise(2).alias("batch_id"), F.col("id").alias("point_id"), (F.col("id") % 3).cast("double").alias("z"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4000)
    try:
        def model(pdf):
            assert len(pdf) <= 4000  # never the whole batch
            return np.stack([pdf["z"], -pdf["z"]], 1)

        want = points.select("batch_id", "point_id", F.array("z", -F.col("z")).alias("logits"))
        got = predict_tiles(points, model, ["batch_id"], ["point_id"], max_rows=4000, parts=True)
        assert got.exceptAll(want).isEmpty() and got.count() == 50_000
        assert predict_points(points, model, ["batch_id", "point_id"]).exceptAll(want).isEmpty()
        with pytest.raises(Exception, match="batch batch_id = 1 has more than 10000 rows"):
            predict_tiles(points, lambda pdf: np.zeros((len(pdf), 2)), ["batch_id"], ["point_id"], max_rows=10_000).count()
        whole = predict_tiles(points, lambda pdf: np.full((len(pdf), 1), float(len(pdf))), ["batch_id"], ["point_id"], max_rows=40_000)
        sizes = whole.select("batch_id", F.col("logits")[0].alias("n")).distinct()
        assert {tuple(r) for r in sizes.collect()} == {(1, 40_000.0), (2, 10_000.0)}
        assert predict_tiles(points.limit(0), model, ["batch_id"], ["point_id"]).count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
