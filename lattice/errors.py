"""Errors with stable codes and the JSON path of what they are about."""


class LatticeError(Exception):
    code = "backend"

    def __init__(self, message: str, code: str | None = None, path: str | None = None):
        super().__init__(message)
        self.code = code or type(self).code
        self.path = path


class Malformed(LatticeError):
    """The request doesn't have the shape of a query."""

    code = "malformed"


class Invalid(LatticeError):
    """A query that the schema refuses; the code names the reason (UnknownField, ValueTypeMismatch, ...)."""

    code = "validation"


class LimitExceeded(LatticeError):
    code = "limit_exceeded"


class DataError(LatticeError):
    """The data itself can't answer: a cycle in a tree, a repeated key, a cell that is not of its type."""

    code = "data"


class UnknownSource(LatticeError):
    code = "unknown_source"
