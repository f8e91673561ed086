"""Registered queries beside their DuckDB twins. CLOUDLOOM_ALL=1 runs all of them."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check_oracle import compare, connect

SF = "/root/testdata/sf0.001"
SOME = (
    "scan_points write_tile_index tile_overlap tile_merge_small tile_split_large voxel_rank sample_voxel_random "
    "sample_voxel_modulo weighted_draws knn_self height_above_ground grid_pool vote_label write_labelled_points report_table "
    "eval_cross_entropy eval_lovasz_softmax class_weights sample_weights pack_batches standardize_coord aug_rotate "
    "aug_color_jitter predict_tiles stream_confusion slow_batches validate_tiles"
).split()
NAMES = sorted(queries()) if os.environ.get("CLOUDLOOM_ALL") else SOME


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = queries()[name](spark, SF)
    if name not in oracle_sql():
        assert df.count() > 0
        return
    why, _ = compare(df, duck, oracle_sql()[name])
    assert why is None, why


def test_entry(spark):
    assert entry(spark).count() == 32
