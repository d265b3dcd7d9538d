import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from promspark.session import build_session, checkpoint_dir
    s = build_session("local[4]", app="promspark-tests", shuffle_partitions=4)
    checkpoint_dir(s, allow_local=True)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def prom(spark):
    from promspark.fixture import load_prom
    return load_prom(spark, SF001).cache()
