import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cloudloom.operators.ordering import ordered_prefix, rank_by_id


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(0)
    n = 1200
    key = np.where(np.arange(n) < 500, 0, rng.integers(1, 40, size=n))
    value = np.where(rng.random(n) < 0.4, 7, rng.integers(0, 50, size=n))  # many equal values
    return pd.DataFrame({"k": key, "id": rng.permutation(n), "v": value, "w": rng.integers(0, 9, size=n)})


def test_rank_by_id_chunks_large_groups(spark, rows):
    df = spark.createDataFrame(rows)
    want = rows.assign(r=rows.groupby("k")["id"].rank().astype(int) - 1, n=rows.groupby("k")["id"].transform("size"))
    for limit in (50, 10_000):
        got = rank_by_id(df, ["k"], "id", "r", "n", group_rows=limit).toPandas()
        merged = want.merge(got, on="id")
        assert (merged["r_x"] == merged["r_y"]).all() and (merged["n_x"] == merged["n_y"]).all()


@pytest.mark.parametrize("keys", [["k"], []])
@pytest.mark.parametrize("limit", [60, 10_000])
def test_ordered_prefix(spark, rows, keys, limit):
    got = ordered_prefix(
        spark.createDataFrame(rows), keys, [F.col("v").desc(), "id"], "c", {"s": "w"}, {"m": "w"}, group_rows=limit
    ).toPandas()
    want = rows.assign(k0=0).sort_values(["v", "id"], ascending=[False, True])
    by = want.groupby(keys or ["k0"])
    want["c"] = by.cumcount()
    want["s"] = by["w"].cumsum() - want["w"]
    want["m"] = by["w"].transform(lambda s: s.cummax().shift())
    both = want.merge(got, on="id")
    assert len(both) == len(rows)
    assert (both["c_x"] == both["c_y"]).all() and (both["s_x"] == both["s_y"]).all()
    assert (both["m_x"].fillna(-1) == both["m_y"].astype(float).fillna(-1)).all()


def test_hashed_ids_give_balanced_chunks(spark, monkeypatch):
    from cloudloom.operators import ordering

    rows = spark.range(5000).select(F.lit("hot").alias("k"), F.xxhash64("id").alias("id"), (F.col("id") % 3).alias("v"))
    cut, seen = ordering.cut_lineage, []
    monkeypatch.setattr(ordering, "cut_lineage", lambda d: seen.append(cut(d)) or seen[-1])
    got = rank_by_id(rows, ["k", "v"], "id", "r", "n", ["k"], group_rows=100).toPandas()
    offsets = next(d for d in seen if "_m" in d.columns)
    assert 40 <= offsets.select("_chunk").distinct().count() <= 60 and offsets.count() <= 180
    want = got.groupby("v")["id"].rank().astype(int) - 1
    assert (want == got["r"]).all() and (got.groupby("v")["id"].transform("size") == got["n"]).all()


def test_rank_keeps_rows_without_a_key(spark, rows):
    df = spark.createDataFrame(rows).withColumn("k", F.when(F.col("k") > 0, F.col("k")))
    for limit in (50, 10_000):
        got = rank_by_id(df, ["k"], "id", "r", "n", group_rows=limit)
        assert got.count() == len(rows)
        assert got.filter("k IS NULL").agg(F.max("r"), F.max("n")).first() == (499, 500)
