import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from millrace.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[8]", "tests", **{
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": "4",
    })
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def values(spark):
    """Evaluate one expression over rows of named inputs, in order."""
    def run(rows, schema, *expressions):
        frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"_i int, {schema}")
        done = frame.select("_i", *[e.alias(f"v{n}") for n, e in enumerate(expressions)]).orderBy("_i").collect()
        return [row[1] if len(expressions) == 1 else tuple(row[1:]) for row in done]

    return run
