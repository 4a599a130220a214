from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tesserae.session import build

    shared = tmp_path_factory.mktemp("shared")
    session = build("tests", "8", **{"spark.checkpoint.dir": f"file://{shared}", "spark.sql.warehouse.dir": f"file://{shared}/warehouse", "spark.driver.memory": "6g"})
    yield session
    session.stop()
