"""Queries over DataFrames of documents: one row is one document."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import ast as a
from ..evaluate import Environment
from ..operators import values as v
from ..operators.lower import Context, Lowering, Stream, context
from ..operators.values import Many, Val
from ..parser import parse

_FLIP = {"<": ">", "<=": ">=", ">": "<", ">=": "<=", "==": "=="}


@dataclass(frozen=True)
class Query:
    text: str
    tree: a.Node
    lowering: Lowering
    warnings: tuple[tuple[str, str], ...] = ()

    def stream(self, column: Column, type_: T.DataType) -> Stream:
        return self.lowering.lower(self.tree, context(column, type_))

    def column(self, column: Column, type_: T.DataType) -> Column:
        """All values of a document, as an array of one Spark type."""
        return self.lowering.many(self.stream(column, type_)).col

    def to_sexpr(self) -> str:
        return a.to_sexpr(self.tree)


@dataclass
class Session:
    """constants are named literals; functions and operators build columns: functions get the lowering and
    their lowered arguments, operators one or two values.  on_error is ``raise`` or ``null``.  hooks are called as (node) before a node
    is lowered and as (node, stream) after it."""

    constants: dict[str, object] = field(default_factory=dict)
    functions: dict[str, Callable] = field(default_factory=dict)
    operators: dict[str, Callable] = field(default_factory=dict)
    on_error: str = "raise"
    max_depth: int = 16
    hooks: tuple[Callable, Callable] | None = None

    def compile(self, query: str, any: bool = False, auto_wildcard: bool = False) -> Query:  # noqa: A002
        def of_data(env, ctx, args):
            from ..evaluate import NotConstant

            raise NotConstant
            yield

        env = Environment(constants=self.constants, functions={n: of_data for n in self.functions}, unfoldable={"trace", *(n.lower() for n in self.functions)}, operators={n: _later for n in self.operators})
        tree = parse(query, env, any=any, auto_wildcard=auto_wildcard)
        return Query(query, tree, Lowering(self.functions, self.operators, self.on_error, self.max_depth, self.hooks), tuple(env.warnings))

    def _doc(self, df: DataFrame, doc: str) -> tuple[Column, T.DataType]:
        return F.col(doc), df.select(doc).schema[0].dataType

    def values(self, df: DataFrame, doc: str, query: str | Query, keys: list[str]) -> DataFrame:
        """(keys, pos, value): one row for each value, as its own Spark type where the query has one kind."""
        q = query if isinstance(query, Query) else self.compile(query)
        s = q.stream(*self._doc(df, doc))
        if isinstance(s, Val):
            return df.select(*keys, F.lit(0).alias("pos"), _plain(s).alias("value"))
        m = s if s.kind not in ("dyn", "null") else Many("plain", s.each(lambda x: _plain(Val(s.kind, x))))
        return df.select(*keys, F.posexplode(m.col).alias("pos", "value"))

    def query(self, df: DataFrame, doc: str, query: str | Query, keys: list[str]) -> DataFrame:
        """(keys, pos, value VARIANT, text): the values of every document in order, and how they print."""
        q = query if isinstance(query, Query) else self.compile(query)
        m = q.lowering.many(q.stream(*self._doc(df, doc)))
        both = m.each(lambda x: F.struct(v.to_variant(Val(m.kind, x, m.typ)).alias("value"), v.to_text(Val(m.kind, x, m.typ), q.lowering.kernels).alias("text")))
        return df.select(*keys, F.posexplode(both).alias("pos", "both")).select(*keys, "pos", "both.value", "both.text")

    def scalar(self, df: DataFrame, doc: str, query: str | Query) -> Column:
        """The value of a query with exactly one, as a column."""
        q = query if isinstance(query, Query) else self.compile(query)
        return _plain(q.lowering.one(q.stream(*self._doc(df, doc)), q.text))

    def filter(self, df: DataFrame, doc: str, query: str | Query) -> DataFrame:
        """Rows whose document has a true value.  Comparisons of a field with a constant reach the scan."""
        q = query if isinstance(query, Query) else self.compile(query)
        for part in self._conjuncts(q.tree, q.lowering, context(*self._doc(df, doc))):
            df = df.where(part)
        return df

    def _conjuncts(self, node: a.Node, low: Lowering, ctx: Context) -> list[Column]:
        if isinstance(node, a.Quantifier) and node.op == "any" and len(node.args) == 1:
            node = node.args[0]
        if isinstance(node, a.Logic) and node.op == "and":
            left = low.lower(node.left, ctx)
            if isinstance(left, Val):
                return [*self._conjuncts(node.left, low, ctx), *self._conjuncts(node.right, low, ctx)]
        if isinstance(node, a.Binary) and node.op in _FLIP and isinstance(node.right, a.Const):
            l, r = low.lower(node.left, ctx), v.literal(node.right.value)
            same = isinstance(l, Val) and (l.kind == r.kind or {l.kind, r.kind} <= {"int", "float"}) and l.kind in ("int", "float", "string", "bool")
            if same and (node.op == "==" or l.kind != "bool"):
                return [{"==": l.col == r.col, "<": l.col < r.col, "<=": l.col <= r.col, ">": l.col > r.col, ">=": l.col >= r.col}[node.op]]  # type: ignore[union-attr]
        return [low.quantifier("any", [low.lower(node, ctx)])]

    def trace(self, df: DataFrame, doc: str, query: str, name: str) -> tuple[DataFrame, object]:
        """The result of ``query()`` and an Observation of its number of values and documents."""
        from pyspark.sql import Observation

        seen = Observation(name)
        m = self.compile(query).column(*self._doc(df, doc))
        return df.observe(seen, F.count("*").alias("calls"), F.sum(F.size(m)).alias("values")), seen


def _later(*operands: object) -> object:
    from ..evaluate import NotConstant

    raise NotConstant


def _plain(x: Val) -> Column:
    """A value as a Spark type of its own; variants for kinds that differ from row to row."""
    if x.kind == "dyn":
        return v.to_variant(x)
    return F.lit(None).cast("string") if x.kind == "null" else x.col
