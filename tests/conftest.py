import pytest

from noticeworks.session import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    return build_session(master="local[4]", shuffle_partitions=4, spark__local__dir=str(tmp_path_factory.mktemp("spark")))
