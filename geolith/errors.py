"""Errors with SQLSTATE codes."""

from __future__ import annotations


class EngineError(Exception):
    """A refusal or failure with its SQLSTATE."""

    def __init__(self, sqlstate: str, message: str):
        super().__init__(f"[{sqlstate}] {message}")
        self.sqlstate, self.message = sqlstate, message
