import pytest

from asset_atlas.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("asset-atlas-tests", shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
