import pytest

from depotlens.session import build_session
from depotlens.sources.star_schema import star_tables


@pytest.fixture(scope="session")
def spark():
    session = build_session("depotlens-tests", "local[8]", {
        "spark.ui.enabled": "false",
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "8g",
        "spark.sql.maxMetadataStringLength": "10000",
    })
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def star(spark, small):
    return star_tables(spark, small)
