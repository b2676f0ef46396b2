from __future__ import annotations

import pytest
from helpers import at

from colloquy.schema import CHATS, CLIENTS
from colloquy.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


@pytest.fixture
def chats(spark):
    """Build a chats frame from (id, client_id, created_at, question, answer) rows."""

    def build(rows):
        parsed = [(i, c, at(t) if isinstance(t, str) else t, q, a) for i, c, t, q, a in rows]
        return spark.createDataFrame(parsed, CHATS)

    return build


@pytest.fixture
def clients(spark):
    def build(rows):
        return spark.createDataFrame([(i, n, None) for i, n in rows], CLIENTS)

    return build
