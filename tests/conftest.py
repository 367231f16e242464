import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
os.environ.setdefault("OMP_NUM_THREADS", "1")


@pytest.fixture(scope="session")
def spark():
    from loomwright.session import get_session

    session = get_session("tests", cores=4, **{"spark.driver.memory": "4g", "spark.sql.shuffle.partitions": "2"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
