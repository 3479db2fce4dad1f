import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])

from wardline.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("*", shuffle_partitions=8, app="wardline-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
