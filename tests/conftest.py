import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from shelfscope.session import session

    made = session("tests", "local[8]", 8, **{
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    made.sparkContext.setLogLevel("ERROR")
    return made


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck(sf):
    from catalog_queries.check import duck as connect

    return connect(sf)


@pytest.fixture(scope="session", autouse=True)
def small_models():
    """The registered queries fit full sizes; tests of them fit small models."""
    from catalog_queries import modelling
    from shelfscope.operators import models

    modelling.EFFORT = models.Effort(trees=20, rounds=5, mlp_iterations=20, forest_depth=8, boost_depth=4)
    modelling.BALANCED_EFFORT = models.Effort(rounds=5, boost_depth=4, boost_rate=0.05)
