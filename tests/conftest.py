import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from qapulse.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[4]",
        **{
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "4g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def make_posts(spark):
    """Posts rows from dicts; columns left out are NULL."""
    from qapulse.schemas import SCHEMAS

    schema = SCHEMAS["Posts"]

    def build(*rows):
        return spark.createDataFrame([tuple(r.get(f.name) for f in schema.fields) for r in rows], schema)

    return build


@pytest.fixture
def plan_of(spark):
    def text(df):
        return df._jdf.queryExecution().toString()

    return text
