import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from scorelens.session import clear_scratch, local_session

    s = local_session("*", shuffle_partitions=8, app="scorelens-tests")
    yield s
    clear_scratch(s)
    s.stop()


@pytest.fixture(scope="session")
def sample001(spark):
    from scorelens.sources.tables import sample_view

    return sample_view(spark, SF001).cache()
