import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from basketlens.session import get_spark

    s = get_spark("local[4]", shuffle_partitions=4, app_name="basketlens-tests")
    yield s
    s.stop()
