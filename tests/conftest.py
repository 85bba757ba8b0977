import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tools"))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from lendscope.session import checkpoint_dir, drop_materialized, get_spark
    s = get_spark(master=os.environ.get("TEST_MASTER", "local[*]"), shuffle_partitions=8)
    checkpoint_dir(s)
    yield s
    drop_materialized(s)      # what this run wrote in the checkpoint folder


@pytest.fixture(scope="session")
def duck():
    from check_oracle import duck_con
    return duck_con(SF_SMALL)
