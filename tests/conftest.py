import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from talkmill.session import local_session
    from talkmill.streaming.jobs import use_state_store

    session = local_session(4, "talkmill-tests", **{"spark.sql.shuffle.partitions": "4"})
    use_state_store(session)
    yield session
    session.stop()
