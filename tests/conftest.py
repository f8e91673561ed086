import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from cloudloom import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session(
        "tests", "local[8]", 4, **{"spark.driver.memory": "6g", "spark.ui.showConsoleProgress": "false"}
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def cloud(spark):
    """A small cloud in which one tile holds a third of all points."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(3)
    n = 900
    xy = rng.integers(0, 800, size=(n, 2)) / 8
    xy[: n // 3] = rng.integers(0, 8, size=(n // 3, 2)) / 8
    pdf = pd.DataFrame(
        {
            "file_id": np.where(np.arange(n) % 5 == 0, 1, 0),
            "point_id": rng.permutation(n),
            "x": xy[:, 0],
            "y": xy[:, 1],
            "z": rng.integers(0, 80, size=n) / 8,
            "classification": rng.integers(0, 9, size=n).astype("int32"),
            "intensity": rng.integers(0, 65536, size=n).astype("int32"),
            "red": rng.integers(0, 256, size=n).astype("float64"),
            "green": rng.integers(0, 256, size=n).astype("float64"),
            "blue": rng.integers(0, 256, size=n).astype("float64"),
        }
    )
    return spark.createDataFrame(pdf).cache()
