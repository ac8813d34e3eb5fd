import pytest

from tillworks.session import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tillworks-tests", "local[4]", **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.python.sql.dataFrameDebugging.enabled": "false",
            "spark.driver.memory": "4g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
            "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
            "spark.driver.extraJavaOptions": "-Dderby.system.home=" + str(
                tmp_path_factory.mktemp("derby")),
        })
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
