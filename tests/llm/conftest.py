from __future__ import annotations

import pytest

from colloquy.llm.store import ship_package


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship_package(spark)


@pytest.fixture
def documents(spark):
    """A frame of (doc_id, text) rows and columns whose names the operators use inside."""

    def build(rows):
        schema = (
            "doc_id long, text string, lang string, source string, n_chars long, id string, cls string, "
            "hash string, words string, n string, spans string, kept string, version string, row string, _version string, _id string, _numbers string, _row string"
        )
        full = [(i, t, "en", "s", len(t) if t is not None else None, *["x"] * 8, None, *["y"] * 4) for i, t in rows]
        return spark.createDataFrame(full, schema)

    return build
