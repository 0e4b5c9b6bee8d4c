import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from drawseries.session import get_spark
    ckpt = tempfile.mkdtemp(prefix="drawseries-test-ckpt-")
    s = get_spark("local[4]", shuffle_partitions=4,
                  extra={"spark.checkpoint.dir": ckpt, "spark.driver.memory": "4g"})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck_small():
    from drawseries.plans.check import duck
    return duck(SF_SMALL)
