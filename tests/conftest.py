import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from lectern.session import local_session, share_code

    session = share_code(local_session(4, 4, "4g"))
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
