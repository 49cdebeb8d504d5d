from __future__ import annotations

import pytest

from shelfmark.session import session


def make_session():
    spark = session(
        "shelfmark-tests", "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "8g",
            "spark.sql.sources.parallelPartitionDiscovery.threshold": "64",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@pytest.fixture(scope="session")
def spark():
    return make_session()
