import pytest

from brightloom.session import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    session = build_session("local[4]", 4, "4g", **{"spark.checkpoint.dir": f"file://{shared}", "spark.sql.warehouse.dir": f"file://{tmp_path_factory.mktemp('warehouse')}"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
