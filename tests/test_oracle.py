"""Every registered query against its SQL, on the smallest tables."""

from __future__ import annotations

import pytest

from shelfmark.plans import QUERIES
from tests.compare import DATA, compare, connection

FOLDER = DATA.format("0.001")


@pytest.fixture(scope="module")
def con():
    return connection(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    assert compare(spark, con, FOLDER, name) == ""
