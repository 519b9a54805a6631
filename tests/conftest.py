import pytest

from millrace.session import session


@pytest.fixture(scope="session")
def spark():
    settings = {"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"}
    it = session("tests", "local[4]", **settings)
    it.sparkContext.setLogLevel("ERROR")
    yield it
    it.stop()


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF
