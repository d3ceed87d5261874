"""Query trees."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, fields

from .kinds import to_text


@dataclass(frozen=True)
class Node:
    span: tuple[int, int] = field(default=(0, 0), kw_only=True, compare=False)

    def children(self) -> Iterator[Node]:
        for f in fields(self):
            v = getattr(self, f.name)
            if isinstance(v, Node):
                yield v
            elif isinstance(v, tuple) and f.name == "args":
                yield from v


@dataclass(frozen=True)
class Const(Node):
    value: object


@dataclass(frozen=True)
class MultiConst(Node):
    values: tuple


@dataclass(frozen=True)
class Self(Node):
    pass


@dataclass(frozen=True)
class Field(Node):
    name: str


@dataclass(frozen=True)
class AnyChild(Node):
    pass


@dataclass(frozen=True)
class Wildcard(Node):
    pass


@dataclass(frozen=True)
class Path(Node):
    left: Node
    right: Node


@dataclass(frozen=True)
class Index(Node):
    left: Node
    index: Node


@dataclass(frozen=True)
class Sub(Node):
    left: Node
    predicate: Node


@dataclass(frozen=True)
class Unpack(Node):
    operand: Node


@dataclass(frozen=True)
class Unary(Node):
    op: str
    operand: Node


@dataclass(frozen=True)
class Binary(Node):
    op: str
    left: Node
    right: Node


@dataclass(frozen=True)
class Logic(Node):
    op: str
    left: Node
    right: Node


@dataclass(frozen=True)
class Quantifier(Node):
    op: str
    args: tuple[Node, ...]


@dataclass(frozen=True)
class Call(Node):
    name: str
    args: tuple[Node, ...]


@dataclass(frozen=True)
class WordOp(Node):
    """A custom word operator: one operand, or two."""

    name: str
    args: tuple[Node, ...]


def _quoted(v: object) -> str:
    return f'"{v}"' if isinstance(v, str) else to_text(v)


def to_sexpr(node: Node) -> str:
    s = to_sexpr
    match node:
        case Const(value):
            return _quoted(value)
        case MultiConst(values):
            return "{" + " ".join(map(to_text, values)) + "}"
        case Self():
            return "_"
        case Field(name):
            return name
        case AnyChild():
            return "*"
        case Wildcard():
            return "**"
        case Path(left, right):
            return f"(. {s(left)} {s(right)})"
        case Index(left, index):
            return f"(index {s(left)} {s(index)})"
        case Sub(left, predicate):
            return f"(sub {s(left)} {s(predicate)})"
        case Unpack(operand):
            return f"(... {s(operand)})"
        case Unary(op, operand):
            return f"({op} {s(operand)})"
        case Binary(op, left, right) | Logic(op, left, right):
            return f"({op} {s(left)} {s(right)})"
        case Quantifier(op, args):
            return f"({op} {' '.join(map(s, args))})" if args else f"{op}()"
        case Call(name, args) | WordOp(name, args):
            return "(" + " ".join([name, *map(s, args)]) + ")"
    raise TypeError(node)


def visit(node: Node, enter: Callable[[Node], None]) -> None:
    """Every node, parents first."""
    enter(node)
    for child in node.children():
        visit(child, enter)
