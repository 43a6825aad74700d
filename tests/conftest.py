import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from oreline.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[4]", "tests", spark__sql__shuffle__partitions="4", spark__driver__memory="3g", spark__sql__adaptive__enabled="true")
    yield s
    s.stop()
