import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SMALL, LARGE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from siltstone.plans.session import local_session
    from siltstone.plans.shipping import ship

    session = local_session(cores=8, memory="4g", app="siltstone-tests", spark__sql__shuffle__partitions="8")
    ship(session)
    yield session
    session.stop()
