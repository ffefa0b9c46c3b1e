import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tablecheck.session import build_session

    ckpt = tempfile.mkdtemp(prefix="tablecheck-test-ckpt-")
    s = build_session(master="local[4]", shuffle_partitions=4,
                      extra={"spark.checkpoint.dir": ckpt, "spark.sql.warehouse.dir": ckpt + "/warehouse"})
    yield s
    s.stop()


@pytest.fixture()
def tmp_dir(spark):
    from tablecheck.session import scratch_path

    return scratch_path(spark, "test")
