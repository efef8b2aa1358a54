import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from wattline.session import get_spark

    shared = tempfile.mkdtemp(prefix="wattline-tests-")
    s = get_spark("local[8]", app="wattline-tests", shuffle_partitions=8, extra={"spark.checkpoint.dir": shared})
    yield s


def rows(df, *cols):
    """Collect a small result as sorted tuples (tests only)."""
    cols = cols or tuple(df.columns)
    return sorted(tuple(r[c] for c in cols) for r in df.select(*cols).collect())
