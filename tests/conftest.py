import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from perkflow.session import build_session
    ckpt = tempfile.mkdtemp(prefix="perkflow-test-ckpt-")
    s = build_session("local[4]", app_name="perkflow-tests", shuffle_partitions=8,
                      extra={"spark.checkpoint.dir": ckpt,
                             "spark.sql.warehouse.dir": os.path.join(ckpt, "warehouse"),
                             "spark.sql.streaming.minBatchesToRetain": "5"})
    yield s
    s.stop()


@pytest.fixture()
def tmp_dir():
    return tempfile.mkdtemp(prefix="perkflow-test-")
