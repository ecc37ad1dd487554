from __future__ import annotations

import pytest


@pytest.fixture(scope="session")
def frame(spark):
    """Rows to a DataFrame of a given schema, dealt over a few partitions."""

    def make(rows, schema, parts=3):
        return spark.createDataFrame(rows, schema).repartition(parts)

    return make
