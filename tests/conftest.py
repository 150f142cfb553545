import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from lodestream.session import get_spark

    session = get_spark("tests", cores=8, shuffle_partitions=8)
    yield session
    session.stop()
