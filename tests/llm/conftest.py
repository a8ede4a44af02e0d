import pytest


@pytest.fixture(scope="session")
def files(tmp_path_factory):
    return tmp_path_factory.mktemp("llm")
