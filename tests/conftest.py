import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])
sys.path.insert(0, ROOT)

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    from quillon.session import session

    own = session(
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g",
            "spark.driver.host": "127.0.0.1", "spark.sql.adaptive.coalescePartitions.enabled": "true",
        },
    )
    own.sparkContext.setLogLevel("ERROR")
    yield own
    own.stop()
