from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from postflow.session import build_session


def session():
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "6g",
        "spark.sql.streaming.stopTimeout": "60000",
    }
    built = build_session("postflow-tests", f"local[{os.environ.get('TEST_CPUS', '8')}]", **settings)
    built.sparkContext.setLogLevel("ERROR")
    return built


@pytest.fixture(scope="session")
def spark():
    built = session()
    yield built
    built.stop()
