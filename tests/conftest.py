import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from causeway.session import local_session
    s = local_session(cores="*", shuffle_partitions=8, app="causeway-tests")
    yield s


@pytest.fixture(scope="session")
def oc_small(spark):
    from causeway.plans.frames import orders_causal
    return orders_causal(spark, SF_SMALL).cache()


@pytest.fixture(scope="session")
def oc_mid(spark):
    from causeway.plans.frames import orders_causal
    return orders_causal(spark, SF_MID).cache()
