import pytest

from rinkline import session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = session.build(
        "rinkline-tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "6g",
            "spark.ui.enabled": "false",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
            "spark.ui.showConsoleProgress": "false",
        },
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    session.clear_staged(s)
    s.stop()
