import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cellshift import engine_session  # noqa: E402
from cellshift.model import CELL_SCHEMA, MUTATION_SCHEMA, TRACKING_SCHEMA  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    scratch = tmp_path_factory.mktemp("spark")
    session = engine_session(
        SparkSession.builder.master("local[8]")
        .appName("cellshift-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.checkpoint.dir", str(scratch / "shared"))
        .config("spark.sql.warehouse.dir", str(scratch / "warehouse"))
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def cells(spark):
    """cells(("r", "c", "v", 1), ...) with an optional super column in front of c."""

    def make(*rows, family="data"):
        full = []
        for r in rows:
            key, *sup, column, value, ts = r
            full.append(("ks", family, key, sup[0] if sup else None, column, value, ts))
        return spark.createDataFrame(full, CELL_SCHEMA)

    return make


@pytest.fixture
def mutations(spark):
    """mutations((key, super, column, op, value, ts, seq), ...)"""

    def make(*rows):
        return spark.createDataFrame(
            [("ks", "data", k, s, c, op, v, ts, seq) for k, s, c, op, v, ts, seq in rows],
            MUTATION_SCHEMA,
        )

    return make


@pytest.fixture
def tracking(spark):
    """tracking((key, state, column, value, ts), ...)"""

    def make(*rows):
        return spark.createDataFrame([("ks", "track", *r) for r in rows], TRACKING_SCHEMA)

    return make
