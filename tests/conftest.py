import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from matingstats import get_spark
    s = get_spark("local[4]", app="matingstats-tests", shuffle_partitions=8,
                  checkpoint_dir=tempfile.mkdtemp(prefix="ckpt-", dir="/tmp"))
    yield s
    s.stop()
