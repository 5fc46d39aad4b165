import pathlib
import sys

import pytest

ROOT = pathlib.Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tools"))

from marketloom.session import build_session  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[8]", 8)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data_path():
    return DATA


@pytest.fixture(scope="session")
def duck(data_path):
    import check

    return check.connect(data_path)
