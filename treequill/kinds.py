"""Kinds of values, and what they look like as text."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from .errors import QueryError


@dataclass(frozen=True)
class IRange:
    """Whole numbers from begin to end, both included, in either direction."""

    begin: int
    end: int

    def low(self) -> int:
        return min(self.begin, self.end)

    def high(self) -> int:
        return max(self.begin, self.end)

    def __iter__(self):
        step = 1 if self.end >= self.begin else -1
        return iter(range(self.begin, self.end + step, step))


#: Syntax that Java takes in a pattern and ECMAScript does not.
_JAVA_ONLY = re.compile(r"\(\?[idmsuxU-]|\(\?<[=!]|\\Q|\\E|[*+?}]\+|\\[AZzG]")


@dataclass(frozen=True)
class Regex:
    pattern: str

    def compiled(self) -> re.Pattern:
        try:
            return re.compile(self.pattern)
        except re.error as e:
            raise QueryError("ParserError", f"Invalid regular expression: {e}") from e

    def check(self) -> None:
        if _JAVA_ONLY.search(self.pattern):
            raise QueryError("ParserError", f"Invalid regular expression: {self.pattern}")
        self.compiled()


def kind_of(v: object) -> str:
    """What typeof says."""
    if v is None:
        return "null"
    for kind, cls in (("bool", bool), ("int", int), ("float", float), ("string", str), ("bytes", (bytes, bytearray)), ("model", (dict, list, Multimap)), ("irange", IRange), ("re", Regex)):
        if isinstance(v, cls):
            return kind
    raise TypeError(type(v))


class Multimap(list):
    """An object that may have a name more than once: a list of (name, value)."""


#: Bytes that are printed as an escape of their own.
BYTE_ESCAPES = {34: '\\"', 92: "\\\\", 9: "\\t", 10: "\\n", 13: "\\r"}


def bytes_literal(b: bytes) -> str:
    return 'b"' + "".join(BYTE_ESCAPES.get(c) or (chr(c) if 32 <= c < 127 else f"\\x{c:02X}") for c in b) + '"'


def be_int(b: bytes) -> int | None:
    """Big-endian, signed at 8 bytes; longer only if what follows the first 8 is zero."""
    if len(b) > 8:
        if any(b[8:]):
            return None
        b = b[:8]
    n = int.from_bytes(b, "big")
    return n - (1 << 64) if n >= 1 << 63 else n


def to_json(v: object) -> str:
    def plain(x):
        if isinstance(x, Multimap):
            out: dict = {"_multimap": True}
            for k, y in x:
                out.setdefault(k, []).append(plain(y))
            return out
        if isinstance(x, dict):
            return {k: plain(y) for k, y in x.items()}
        if isinstance(x, list):
            return [plain(y) for y in x]
        if isinstance(x, (bytes, bytearray)):
            return {"_bytes": True, "hex": bytes(x).hex(), "number": be_int(bytes(x))}
        return x

    return json.dumps(plain(v), separators=(",", ":"), sort_keys=True, ensure_ascii=False)


def to_text(v: object) -> str:
    kind = kind_of(v)
    if kind == "null":
        return "null"
    if kind == "bool":
        return "true" if v else "false"
    if kind == "float":
        return f"{v:.6f}"
    if kind == "bytes":
        return bytes_literal(bytes(v))  # type: ignore[arg-type]
    if kind == "model":
        return to_json(v)
    if kind == "irange":
        return f"{v.begin}..{v.end}"  # type: ignore[attr-defined]
    if kind == "re":
        return v.pattern  # type: ignore[attr-defined]
    return str(v)


def truthy(v: object) -> bool:
    return v is not None and v is not False
