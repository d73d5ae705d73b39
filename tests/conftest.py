import sys
import tempfile
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from serupa.session import build_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "local[4]",
        "tests",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "4g",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="serupa-tests-"),
        },
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture
def values(spark):
    """Evaluate a column expression over rows of arguments."""
    from pyspark.sql import functions as F

    def run(rows, schema, *columns):
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "_row INT, " + schema)
        out = df.select("_row", *[c.alias(f"c{n}") for n, c in enumerate(columns)]).orderBy(F.col("_row")).collect()
        return [r[1] if len(columns) == 1 else tuple(r[1:]) for r in out]

    return run
