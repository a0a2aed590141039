import pytest

from gaugework.session import ROWS_PER_SLICE, build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", 8)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def sliced(spark):
    """Cuts even small frames into many slices."""
    spark.conf.set(ROWS_PER_SLICE, "100")
    yield spark
    spark.conf.unset(ROWS_PER_SLICE)
