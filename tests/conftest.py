import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from queuetide.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g",
        "spark.ui.showConsoleProgress": "false",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make(spark):
    """Observations from (airport, timestamp text, queue) rows; ids count up from 1."""

    def build(rows):
        data = [(i, q, t, a) for i, (a, t, q) in enumerate(rows, start=1)]
        df = spark.createDataFrame(data, "id bigint, queue double, timestamp string, airport string")
        return df.withColumn("timestamp", df["timestamp"].cast("timestamp_ntz"))

    return build
