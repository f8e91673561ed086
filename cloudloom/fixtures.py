"""Point-cloud views over the driver's tables.

The expressions are plain SQL that reads the same in Spark and in DuckDB, so the checks in
`catalog` use one text for both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _d(e):
    return f"CAST({e} AS DOUBLE)"


POINT_EXPRS = {
    "point_id": "o_orderkey",
    "file_id": "o_orderkey % 2",
    "x": f"{_d('o_orderkey * 7919 % 8009')} / {_d('8')}",
    "y": f"{_d('o_orderkey * 104729 % 8011')} / {_d('8')}",
    "z": f"{_d('o_custkey * 37 % 301')} / {_d('8')}",
    "classification": "CAST(o_orderkey * 13 % 9 AS INT)",
    "intensity": "CAST(CAST(floor(o_totalprice) AS BIGINT) % 65536 AS INT)",
    "return_number": "CAST(o_custkey % 3 + 1 AS INT)",
    "number_of_returns": "CAST(o_custkey % 3 + 1 + o_orderkey % 2 AS INT)",
    "red": "CAST(o_orderkey * 31 % 65536 AS INT)",
    "green": "CAST(o_orderkey * 57 % 65536 AS INT)",
    "blue": "CAST(o_orderkey * 91 % 65536 AS INT)",
    "normal_x": f"{_d('o_orderkey * 3 % 17 - 8')} / {_d('8')}",
    "normal_y": f"{_d('o_orderkey * 5 % 17 - 8')} / {_d('8')}",
    "normal_z": f"{_d('o_orderkey * 7 % 17 + 1')} / {_d('8')}",
}
CLASSES = 8
LOGIT_EXPRS = [f"{_d(f'(point_id * 31 + k * 17 + {c * 53}) % 101')} / {_d('8')}" for c in range(CLASSES)]
TELEMETRY_EXPRS = {
    "event_id": "event_id",
    "run": "user_id % 16",
    "stage": "event_type",
    "ts": "ts",
    "duration": f"value / {_d('100')}",
}
RUN_EXPRS = {
    "experiment": "user_id % 16",
    "epoch": "event_id",
    "mean_iou": f"{_d('event_id * 37 % 101')} / {_d('128')}",
    "path": "concat('run_', CAST(event_id AS VARCHAR))",
    "is_best": "event_id % 50 = 0",
    "mtime": "event_id * 7919 % 100003",
}


def _select(df, exprs):
    return df.selectExpr(*[f"{e.replace('VARCHAR', 'STRING')} AS {n}" for n, e in exprs.items()])


class Tables:
    """The fixture views of one scale factor."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def points(self) -> DataFrame:
        return _select(self.raw("orders"), POINT_EXPRS)

    def predictions(self) -> DataFrame:
        """Every point with `point_id % 7 <> 0` is predicted one to three times."""
        p = self.points().filter("point_id % 7 <> 0")
        p = p.select(
            "file_id",
            "point_id",
            F.expr("CAST(point_id % 5 AS BIGINT)").alias("segment_id"),
            F.explode(F.sequence(F.lit(0).cast("long"), F.expr("point_id % 3"))).alias("k"),
            "classification",
        )
        return p.select(
            "file_id",
            "point_id",
            "segment_id",
            F.col("k").cast("int").alias("loop_idx"),
            F.expr("CAST(point_id % 97 AS BIGINT)").alias("batch_id"),
            F.expr("array(" + ", ".join(LOGIT_EXPRS) + ")").alias("logits"),
            F.when(F.col("classification") == 0, -1).otherwise(F.col("classification") - 1).alias("target"),
        )

    def telemetry(self) -> DataFrame:
        return _select(self.raw("events"), TELEMETRY_EXPRS)

    def runs(self) -> DataFrame:
        return _select(self.raw("events"), RUN_EXPRS)

    def features(self) -> DataFrame:
        return self.raw("embeddings").selectExpr(
            "vec_id AS point_id",
            "vec_id % 4 AS batch_id",
            "CAST(embedding[0] AS DOUBLE) AS x",
            "CAST(embedding[1] AS DOUBLE) AS y",
            "CAST(embedding[2] AS DOUBLE) AS z",
            "label",
            "transform(embedding, v -> CAST(v AS DOUBLE)) AS feature",
        )
