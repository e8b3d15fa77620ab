import pytest
from surfsphere.session import get_spark


@pytest.fixture(scope="session")
def spark():
    s = get_spark("tests", cores=4)
    s.sparkContext.setLogLevel("OFF")
    yield s
