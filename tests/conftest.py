import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from siteval.plans.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session("tests", cpus=8, shuffle=4, memory="6g")
    yield s
    s.stop()


@pytest.fixture()
def folder(tmp_path):
    return str(tmp_path)
