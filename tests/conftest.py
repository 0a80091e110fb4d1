import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tidemark-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "America/New_York")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def hourly(spark):
    """Build a gap-free hourly frame from columns of equal length."""

    def build(start="2024-03-08 00:00:00", meter=1, **columns):
        import datetime as dt

        first = dt.datetime.fromisoformat(start)
        n = len(next(iter(columns.values())))
        kinds = {bool: "boolean", str: "string", int: "int", float: "double"}
        schema = ["meter_id bigint", "ts timestamp_ntz"]
        for name, values in columns.items():
            sample = next((v for v in values if v is not None), 0.0)
            schema.append(f"{name} {kinds[type(sample)]}")
        rows = [
            (meter, first + dt.timedelta(hours=i), *[v[i] for v in columns.values()])
            for i in range(n)
        ]
        return spark.createDataFrame(rows, ", ".join(schema))

    return build


def column(df, name, *order):
    return [r[name] for r in df.orderBy(*(order or ("meter_id", "ts"))).collect()]
