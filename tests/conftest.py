import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tools"))


@pytest.fixture(scope="session")
def spark():
    from barlab.session import local_session

    s = local_session(8, "tests", 4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
