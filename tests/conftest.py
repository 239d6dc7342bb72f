import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from evalmill.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(8, 8, "tests")


@pytest.fixture(scope="session")
def one(spark):
    """Evaluate Columns over one literal row."""

    def run(*cols):
        row = spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()
        return row[0] if len(cols) == 1 else tuple(row)

    return run
