import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cloudloom.operators.neighbors import gather_neighbours, knn_gather, knn_join, knn_self


def brute(q, r, k, with_self, coords):
    out = []
    for b, qs in q.groupby("b"):
        rs = r[r.b == b].sort_values("point_id")
        rid = rs.point_id.to_numpy()
        for row in qs.itertuples():
            d = sum((getattr(row, c) - rs[c].to_numpy()) ** 2 for c in coords) + np.zeros(len(rs))
            if with_self:
                d[rid == row.point_id] = -1
            for n, j in enumerate(np.lexsort((rid, d))[:k]):
                out.append((b, row.point_id, n + 1, rid[j], max(d[j], 0.0)))
    return sorted(out)


@pytest.fixture(scope="module")
def crowded():
    """A third of the rows at one position, a third in a dense cluster, the rest spread out."""
    rng = np.random.default_rng(1)
    n = 600
    xyz = np.concatenate([np.full((200, 3), 9.0), 5 + rng.random((200, 3)) * 0.3, rng.random((200, 3)) * 100])
    cols = dict(zip("xyz", xyz.T))
    return pd.DataFrame({"b": np.arange(n) % 3 // 2, "point_id": rng.permutation(n), **cols})


@pytest.mark.parametrize("blocks", [(40, 30), (6000, 4096)])
def test_self_join_is_exact(spark, crowded, blocks):
    got = knn_self(spark.createDataFrame(crowded), 5, ["b"], block_refs=blocks[0], block_queries=blocks[1]).collect()
    assert sorted(map(tuple, got)) == brute(crowded, crowded, 5, True, "xyz")


def test_two_tables_in_the_plane(spark, crowded):
    q, r = crowded[crowded.point_id % 3 > 0], crowded[crowded.point_id % 3 == 0]
    got = knn_join(spark.createDataFrame(q), spark.createDataFrame(r), 3, ["b"], ("x", "y"), block_refs=40).collect()
    assert sorted(map(tuple, got)) == brute(q, r, 3, False, "xy")


def test_fewer_rows_than_k(spark):
    pdf = pd.DataFrame({"b": [0, 0, 1], "point_id": [1, 2, 3], "x": [0.0, 3.0, 0.0], "y": [0.0, 4.0, 0.0], "z": 0.0})
    got = sorted(map(tuple, knn_self(spark.createDataFrame(pdf), 4, ["b"]).collect()))
    assert got == [(0, 1, 1, 1, 0.0), (0, 1, 2, 2, 25.0), (0, 2, 1, 2, 0.0), (0, 2, 2, 1, 25.0), (1, 3, 1, 3, 0.0)]
    empty = spark.createDataFrame(pdf).filter("b > 5")
    assert knn_join(spark.createDataFrame(pdf), empty, 2, ["b"]).count() == 0


@pytest.mark.parametrize("with_self", [True, False])
def test_cells_that_stay_crowded_at_full_depth(spark, crowded, with_self, monkeypatch):
    from cloudloom.operators import neighbors

    monkeypatch.setattr(neighbors, "DEPTH", 2)
    df = spark.createDataFrame(crowded)
    got = knn_join(df, df, 5, ["b"], with_self=with_self, block_refs=40, block_queries=30).collect()
    assert sorted(map(tuple, got)) == brute(crowded, crowded, 5, with_self, "xyz")


def test_block_search_compares_few_pairs(monkeypatch):
    from cloudloom.operators import neighbors

    rng = np.random.default_rng(2)
    x = rng.integers(0, 40, size=(3000, 3)) / 8.0  # many ties and copies
    x[7], x[8, 1] = np.nan, np.inf
    mine = np.where(np.arange(len(x)) % 3 == 0, np.arange(len(x)), -1)
    pairs, outer = [], np.subtract.outer
    counted = type("ufunc", (), {"outer": staticmethod(lambda a, b: pairs.append(len(a) * len(b)) or outer(a, b)), "__call__": lambda self, *a: np.add(a[0], -a[1])})
    monkeypatch.setattr(neighbors.np, "subtract", counted())
    src, rank, dst, d2 = neighbors._nearest(x, mine, x, 6)
    monkeypatch.undo()
    assert sum(pairs) < 3 * len(x) ** 2 / 4  # three axes
    got = {}
    for q, n, r, d in sorted(zip(src.tolist(), rank.tolist(), dst.tolist(), d2.tolist())):
        got.setdefault(q, []).append((r, d))
    placed = np.isfinite(x).all(axis=1)
    assert sorted(got) == np.nonzero(placed)[0].tolist()
    for q in got:
        d = ((x - x[q]) ** 2).sum(axis=1)
        d[~placed] = np.inf
        if mine[q] == q:
            d[q] = np.inf
        best = np.lexsort((np.arange(len(x)), d))[:6]
        assert got[q] == [(j, d[j]) for j in best.tolist()]


def test_few_cells_are_sent_to_every_task(spark):
    from cloudloom.operators.neighbors import _join_cells

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        cells = spark.range(3).selectExpr("id AS b", "id AS v")
        plan = _join_cells(spark.range(100).selectExpr("id % 3 AS b"), cells, ["b"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


@pytest.mark.parametrize("depth", [20, 2])  # at depth 2 cells stay crowded, and their references come in chunks
def test_edges_bring_attributes_without_a_join(spark, crowded, depth, monkeypatch):
    from cloudloom.operators import neighbors

    monkeypatch.setattr(neighbors, "DEPTH", depth)
    pdf = crowded.assign(v=np.arange(len(crowded)).astype("int32"), w=[[float(i), None] if i % 7 else None for i in range(len(crowded))])
    df = spark.createDataFrame(pdf, "b long, point_id long, x double, y double, z double, v int, w array<double>")
    df = df.withColumn("b", F.when(F.col("b") > 0, F.col("b")))  # a null batch is a batch like another
    kw = dict(block_refs=40, block_queries=30)
    want = gather_neighbours(knn_self(df, 5, ["b"], **kw), df, ["b"], ["v", "w"], ("x", "y", "z"))
    got = knn_gather(df, 5, ["b"], ["v", "w"], offsets=True, **kw)
    assert got.schema.simpleString() == want.schema.simpleString()
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    above = lambda d: d._jdf.queryExecution().executedPlan().toString().split("FlatMapCoGroupsInArrow")[0]
    assert "Join" in above(want) and "Join" not in above(got)
    both = knn_self(df, 5, ["b"], src_attrs={"mine": "v"}, dst_attrs={"theirs": "v"}, **kw).collect()
    v = dict(zip(pdf.point_id, pdf.v))
    assert len(both) == 5 * len(pdf) and all((e.mine, e.theirs) == (v[e.src], v[e.dst]) for e in both)


def test_values_of_a_second_table_come_with_the_edges(spark, crowded):
    q, r = (spark.createDataFrame(crowded[crowded.point_id % 3 == m]) for m in (1, 0))
    got = knn_join(q, r, 3, ["b"], ("x", "y"), block_refs=40, src_attrs={"h": "z"}, dst_attrs={"g": "z"}, offsets=["ox", "oy"]).collect()
    at = crowded.set_index("point_id")
    assert len(got) == 3 * q.count()
    for e in got:
        s, d = at.loc[e.src], at.loc[e.dst]
        assert (e.h, e.g, e.ox, e.oy) == (s.z, d.z, d.x - s.x, d.y - s.y)
