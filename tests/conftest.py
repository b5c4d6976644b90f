import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from sparkloom.session import local_session, ship

    session = local_session(cpus=4, memory="4g", shuffle=4)
    session.sparkContext.setLogLevel("ERROR")
    ship(session)
    yield session
    session.stop()
