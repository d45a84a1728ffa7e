import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from check_oracle import connect, spark_session

from corroborate.plans.registry import Tables
from corroborate.session import tune

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = tune(spark_session())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables(spark):
    return Tables(spark, SF)


@pytest.fixture(scope="session")
def duck():
    return connect(SF)
