"""Small helpers that several test modules import."""

from __future__ import annotations

import datetime as dt


def at(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text)


def rows_of(frame, *columns):
    return [tuple(r) for r in (frame.select(*columns) if columns else frame).collect()]
