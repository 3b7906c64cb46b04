import os
import sys
import tempfile
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}{os.pathsep}{os.environ.get('PYTHONPATH', '')}"

from quern.session import build  # noqa: E402

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    s = build("tests", f"local[{os.environ.get('TEST_CPUS', '4')}]", **{"spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": tempfile.mkdtemp(), "spark.sql.warehouse.dir": tempfile.mkdtemp()})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
