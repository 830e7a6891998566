import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from quire.session import local

    top = tmp_path_factory.mktemp("spark")
    session = local(4, 4, "3g", spark__sql__warehouse__dir=f"{top}/warehouse", spark__checkpoint__dir=f"{top}/checkpoints")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
