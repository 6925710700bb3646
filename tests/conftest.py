import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from quire.session import checkpoint_dir, get_spark  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = get_spark("local[4]", app="quire-tests", shuffle_partitions=8,
                  conf={"spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="quire-test-warehouse-")})
    checkpoint_dir(s, fallback=tempfile.mkdtemp(prefix="quire-test-ckpt-"))
    yield s


@pytest.fixture()
def tmp_dir():
    return tempfile.mkdtemp(prefix="quire-test-")
