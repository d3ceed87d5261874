"""One exception for everything that a query can do wrong."""

from __future__ import annotations

KINDS = (
    "ParserError", "InvalidExpression", "ExpectedEOF", "NullModel", "DivisionByZero", "InvalidOperands", "InvalidOperator",
    "InvalidArguments", "ExpectedSingleValue", "TypeMismatch", "UnknownFunction", "InternalError", "RuntimeError", "DataError",
)


class QueryError(Exception):
    """kind is one of KINDS; offset and size mark the place in the query, -1 and 0 where there is none."""

    def __init__(self, kind: str, message: str, offset: int = -1, size: int = 0) -> None:
        super().__init__(message)
        self.kind, self.message, self.offset, self.size = kind, message, offset, size
