"""Column contracts of the engine's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

POINTS_REQUIRED = {"file_id": None, "point_id": "bigint", "x": "double", "y": "double", "z": "double"}
# Optional point fields and their types; an absent one is added as null (classification as 0).
POINTS_OPTIONAL = {
    "classification": "int",
    "is_ground": "boolean",
    "intensity": "int",
    "return_number": "int",
    "number_of_returns": "int",
    "scan_angle_rank": "int",
    "user_data": "int",
    "point_source_id": "int",
    "gps_time": "double",
    "red": "int",
    "green": "int",
    "blue": "int",
    "nir": "int",
    "edge_of_flight_line": "boolean",
    "normal_x": "double",
    "normal_y": "double",
    "normal_z": "double",
}
VLR = T.ArrayType(
    T.StructType(
        [
            T.StructField("user_id", T.StringType()),
            T.StructField("record_id", T.IntegerType()),
            T.StructField("description", T.StringType()),
            T.StructField("record_data", T.BinaryType()),
        ]
    )
)
TILE = ["file_id", "pass_id", "xb", "yb"]
TILE_PART = [*TILE, "part"]


def require(df: DataFrame, columns, what="input") -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks {missing}; available columns: {df.columns}")
    return df
