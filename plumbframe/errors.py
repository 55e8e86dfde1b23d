"""Structured errors. Each has a code, details by name, and a short message without any data."""

from __future__ import annotations

import re

LONGEST = 256


def bounded(message: str) -> str:
    """At most LONGEST characters, without control characters."""
    clean = "".join(c if c.isprintable() else " " for c in message)
    return clean if len(clean) <= LONGEST else clean[: LONGEST - 1] + "…"


class PlumbError(Exception):
    def __init__(self, code: str, message: str, **details: object):
        super().__init__(bounded(message))
        self.code, self.details = code, details

    @property
    def message(self) -> str:
        return str(self)


class SchemaError(PlumbError):
    """A schema that can't be made."""


class FrameError(PlumbError):
    """A query that can't be built."""


class ExecutionError(PlumbError):
    """A query that failed while it ran."""


class StorageError(PlumbError):
    """Rows that don't fit their schema."""


class TableReadError(PlumbError):
    """A read of a table that can't be made."""


class SourceError(PlumbError):
    """A source that can't be opened, read or decoded."""


class SinkError(PlumbError):
    """Rows that can't be written."""


class RuntimeBindingError(PlumbError):
    """Sources that don't fit the query."""


class OptionError(PlumbError):
    """Reader or writer options that contradict each other."""


def translated(error: Exception) -> Exception:
    """The structured error for what Spark raised, or the error itself."""
    seen: BaseException | None = error
    while seen is not None:
        if isinstance(seen, PlumbError):
            return seen
        seen = seen.__cause__
    text = str(error)
    condition = getattr(error, "getCondition", lambda: None)() or ""
    has = lambda *codes: any(c in condition or f"[{c}" in text for c in codes)
    if has("DIVIDE_BY_ZERO"):
        return ExecutionError("DivisionByZero", "an integer was divided by zero")
    if has("ARITHMETIC_OVERFLOW", "CAST_OVERFLOW", "BINARY_ARITHMETIC_OVERFLOW"):
        return ExecutionError("IntegerOverflow", "an integer result doesn't fit its width")
    if has("NOT_NULL_ASSERT_VIOLATION") or "plumbframe:required" in text:
        return StorageError("RequiredColumnContainsNull", "a required column contains null")
    if m := re.search(r"plumbframe:delimited:(\w+):(.*)", text):
        return StorageError(m[1], m[2]) if m[1] == "RequiredColumnContainsNull" else SourceError(m[1], m[2])
    return error
