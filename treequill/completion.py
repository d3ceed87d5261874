"""Completion of a query at a point, from the schema of the documents."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import ast as a
from .errors import QueryError
from .evaluate import SIGNATURES, Environment
from .parser import Parser, is_symbol, parse

_PLAIN = re.compile(r"[A-Za-z_$][A-Za-z0-9_]*\Z")


@dataclass(frozen=True)
class Candidate:
    """text replaces size characters from offset; kind is field, constant, function or hint."""

    text: str
    kind: str
    offset: int
    size: int
    hint: str = ""


@dataclass(frozen=True)
class Options:
    limit: int = 15
    smart_case: bool = True
    show_wildcard_hints: bool = True
    sort: bool = True


def _children(types: Iterable[T.DataType]) -> list[T.DataType]:
    out: list[T.DataType] = []
    for t in types:
        if isinstance(t, T.StructType):
            out += [f.dataType for f in t.fields]
        elif isinstance(t, T.ArrayType):
            out.append(t.elementType)
    return out


def _below(types: list[T.DataType]) -> list[T.DataType]:
    return types + (_below(_children(types)) if types else [])


def _types(node: a.Node, ctx: list[T.DataType]) -> list[T.DataType]:
    """Types of the values that a path may have."""
    match node:
        case a.Self():
            return ctx
        case a.Field(name):
            return [f.dataType for t in ctx if isinstance(t, T.StructType) for f in t.fields if f.name == name]
        case a.AnyChild():
            return _children(ctx)
        case a.Wildcard():
            return _below(ctx)
        case a.Path(left, right):
            return _types(right, _types(left, ctx))
        case a.Sub(left, _):
            return _types(left, ctx)
        case a.Index(left, a.Const(str() as name)):
            return _types(a.Field(name), _types(left, ctx))
        case a.Index(left, _):
            return _children(_types(left, ctx))
    return []


def schema_of(df: DataFrame, doc: str) -> T.DataType:
    """The type of a document column; of a VARIANT, what all documents have in common."""
    t = df.select(doc).schema[0].dataType
    if isinstance(t, T.VariantType):
        text = df.agg(F.schema_of_variant_agg(doc)).first()[0] or "VOID"
        return T._parse_datatype_string(text.replace("OBJECT<", "STRUCT<"))
    return t


def string_constants(df: DataFrame, doc: str, most: int = 1000) -> list[str]:
    """All-upper-case strings of the documents, at most ``most`` of them: what may be written as symbols."""
    from .plans.session import Session

    session = Session()
    strings = session.compile("**.{typeof _ == 'string'} as string").column(*session._doc(df, doc))
    words = df.select(F.explode(strings).alias("w")).where(F.col("w").rlike(r"\A[A-Z0-9_]*[A-Z][A-Z0-9_]*\z"))
    return [r["w"] for r in words.distinct().orderBy("w").limit(most).collect()]


def complete(query: str, schema: T.DataType, point: int | None = None, constants: Iterable[str] = (), env: Environment | None = None, options: Options | None = None) -> list[Candidate]:
    """Candidates for the word before ``point`` (the end of the query by default)."""
    env, options = env or Environment(), options or Options()
    point = len(query) if point is None else point
    head = query[:point]
    prefix = re.search(r"[A-Za-z_$][A-Za-z0-9_$]*\Z", head)
    word = prefix[0] if prefix else ""
    start = point - len(word)
    before = head[:start].rstrip()
    in_path = before.endswith(".") and not before.endswith("..")
    ctx = _context(before[:-1] if in_path else before, schema, in_path)
    exact = options.smart_case and any(c.isupper() for c in word)
    matches = lambda s: s.startswith(word) if exact else s.lower().startswith(word.lower())
    out: list[Candidate] = []
    names = dict.fromkeys(f.name for t in ctx for f in (t.fields if isinstance(t, T.StructType) else []))
    for name in names:
        if matches(name):
            if _PLAIN.match(name):
                out.append(Candidate(name, "field", start, len(word)))
            else:
                quoted = name.replace("\\", "\\\\").replace('"', '\\"')
                out.append(Candidate(f'["{quoted}"]', "field", start, len(word)))
    if not in_path:
        out += [Candidate(c, "constant", start, len(word)) for c in dict.fromkeys([*constants, *env.constants]) if matches(c)]
        out += [Candidate(f, "function", start, len(word), SIGNATURES.get(f, f)) for f in dict.fromkeys([*SIGNATURES, *env.functions]) if matches(f)]
    if options.sort:
        out.sort(key=lambda c: c.text)
    hints = [Candidate(h, "hint", 0, len(query)) for h in _hints(query)] if options.show_wildcard_hints and not in_path else []
    return [*out[: max(options.limit - len(hints), 0)], *hints][: options.limit]


def _context(before: str, schema: T.DataType, in_path: bool) -> list[T.DataType]:
    """Types that a field at this place is looked up in: the innermost brackets' subject, then the path's left side."""
    subject = [schema]
    openers: list[int] = []
    for i, c in enumerate(before):
        if c in "([{":
            openers.append(i)
        elif c in ")]}" and openers:
            openers.pop()
    for i in openers:
        if before[i] == "{" or (before[i] == "(" and before[:i].rstrip().endswith(".")):
            left = _operand(before[:i].rstrip().rstrip(".") if before[i] == "(" else before[:i].rstrip(". "))
            subject = _type_of(left, subject)
    if not in_path:
        return subject
    inner = before[openers[-1] + 1 :] if openers else before
    return _type_of(_operand(inner), subject)


def _operand(text: str) -> str:
    """The path that ends a text."""
    m = re.search(r"(?:(?:\*\*|\*|[A-Za-z_$][A-Za-z0-9_$]*|\[[^\[\]]*\]|\{[^{}]*\})\.?)+\Z", text.rstrip())
    return m[0].rstrip(".") if m else ""


def _type_of(path: str, subject: list[T.DataType]) -> list[T.DataType]:
    if not path:
        return subject
    try:
        return _types(Parser(path, Environment(), relaxed=True).whole(), subject)
    except QueryError:
        return []


def _hints(query: str) -> list[str]:
    """A lone word may be meant for any depth: as a field, or as a value; so may the left side of a comparison."""
    text = query.strip()
    try:
        tree = parse(text, relaxed=True) if text else None
    except QueryError:
        return []
    if isinstance(tree, a.Field) and tree.name:
        return [f"**.{text}", *([f"** = {text}"] if is_symbol(tree.name) else [])]
    if isinstance(tree, a.Binary) and tree.op in ("==", "!=", "<", "<=", ">", ">=") and isinstance(tree.left, a.Field) and isinstance(tree.right, (a.Const, a.Unary)):
        return [f"**.{text}"]
    return []
