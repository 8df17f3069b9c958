import os
import sys

import numpy as np
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from imgtables import configure

    session = (
        SparkSession.builder.master("local[*]").appName("imgtables-tests")
        .config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    session.stop()


@pytest.fixture
def rng():
    return np.random.default_rng(17)


@pytest.fixture
def save():
    """Write an array below a root folder and return its path."""

    def write(root, relpath, array):
        path = os.path.join(str(root), relpath)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as handle:
            np.save(handle, array)
        return path

    return write


@pytest.fixture
def images(spark):
    """A table of image structs from ``{name: 2-D array}``."""

    def make(**columns):
        names = list(next(iter(columns.values())))
        rows = [
            (n, *[{"height": c[n].shape[0], "width": c[n].shape[1], "pixels": [float(x) for x in c[n].ravel()]}
                  for c in columns.values()])
            for n in names
        ]
        kind = "struct<height:int,width:int,pixels:array<double>>"
        return spark.createDataFrame(rows, "stem string, " + ", ".join(f"{c} {kind}" for c in columns))

    return make


def pixels(row):
    return np.array(row["pixels"]).reshape(row["height"], row["width"])
