import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    from quern.session import build_session

    session = build_session("local[4]", "quern-tests", 4, **{"spark.driver.memory": "4g", "spark.sql.execution.arrow.maxRecordsPerBatch": "500"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
