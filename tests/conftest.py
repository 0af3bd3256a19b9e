import sys

import pytest
from pyspark import cloudpickle

from trovelight.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", 4, spark__driver__memory="4g")
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    return "/root/testdata/sf0.001"


@pytest.fixture(autouse=True)
def ship_test_module(request):
    """Workers cannot import test modules; send what they define by value."""
    cloudpickle.register_pickle_by_value(sys.modules[request.module.__name__])
    yield
    cloudpickle.unregister_pickle_by_value(sys.modules[request.module.__name__])
