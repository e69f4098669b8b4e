from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from dayloom.session import discard_written, local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "dayloom-tests")
    yield session
    discard_written(session)


@pytest.fixture(scope="session")
def small() -> str:
    return "/root/testdata/sf0.001"
