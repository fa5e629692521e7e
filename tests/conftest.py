from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from callgauge.operators import ordered  # noqa: E402
from callgauge.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tests")
    yield session
    session.stop()


@pytest.fixture(params=["one block", "many blocks"])
def sizes(request, monkeypatch):
    """Run a test with groups that fit in a block, and with groups cut into small blocks."""
    if request.param == "many blocks":
        monkeypatch.setattr(ordered, "BLOCK_BITS", 2)
    return request.param
