from __future__ import annotations

import pytest

from sieve.operators.spool import release
from sieve.session import get_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    session = get_session(8, "sieve-tests", **{"spark.checkpoint.dir": str(shared)})
    yield session
    release(session)
    session.stop()
