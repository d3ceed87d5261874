"""Query trees to Spark columns.

Every node becomes a :class:`Val` where it has exactly one value, and a :class:`Many` (an array column)
where it may have several.  Kinds are inferred on the way from the schema of the document, so that a query
over typed columns becomes plain expressions that Spark can prune, push down and compile.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import ast as a
from ..errors import QueryError
from ..functions import builtin
from ..kinds import Regex
from . import values as v
from .values import Kernels, Many, Val

Stream = Val | Many


@dataclass(frozen=True)
class Context:
    """What a field name is looked up in: hidden fields first, then the value's own."""

    value: Val
    extra: dict[str, Val] = field(default_factory=dict)


class Lowering:
    def __init__(self, functions: dict[str, Callable] | None = None, operators: dict[str, Callable] | None = None, on_error: str = "raise", max_depth: int = 16, hooks: tuple[Callable, Callable] | None = None) -> None:
        self.kernels = Kernels(on_error)
        self.functions, self.operators, self.on_error, self.max_depth = functions or {}, operators or {}, on_error, max_depth
        self.hooks = hooks

    # streams

    def many(self, s: Stream) -> Many:
        return v.union([s]) if isinstance(s, Val) else s

    def element(self, m: Many, c: Column) -> Val:
        return Val(m.kind, c, m.typ)

    def over(self, s: Stream, f: Callable[[Val], Stream]) -> Stream:
        """f of every value of s, its results one after the other."""
        if isinstance(s, Val):
            return f(s)
        shape: list[Stream] = []

        def body(x: Column) -> Column:
            out = f(self.element(s, x))
            shape.append(out)
            return out.col

        mapped = F.transform(s.col, body)
        out = shape[0]
        return Many(out.kind, mapped if isinstance(out, Val) else F.flatten(mapped), out.typ)

    def product(self, l: Stream, r: Stream, f: Callable[[Val, Val], Val]) -> Stream:
        return self.over(l, lambda x: self.over(r, lambda y: f(x, y)))

    def where(self, m: Many, keep: Callable[[Val], Column]) -> Many:
        return Many(m.kind, F.filter(m.col, lambda x: keep(self.element(m, x))), m.typ)

    def not_null(self, s: Stream) -> Many:
        return self.where(self.many(s), lambda x: x.col.isNotNull())

    def or_null(self, m: Many) -> Many:
        """One null instead of nothing."""
        one = F.array(F.lit(None).cast(v.sql_type(m.kind, m.typ)))
        return Many(m.kind, v.let(m.col, lambda c: F.when(F.size(c) == 0, one).otherwise(c)), m.typ)

    def only_if(self, condition: Column, m: Many) -> Many:
        return Many(m.kind, F.when(condition, m.col).otherwise(v.empty(m)), m.typ)

    def one(self, s: Stream, what: str) -> Val:
        if isinstance(s, Many):
            raise QueryError("ExpectedSingleValue", f"{what}: expected a single value")
        return s

    # nodes

    def lower(self, node: a.Node, ctx: Context) -> Stream:
        if self.hooks is None:
            return self._lower(node, ctx)
        begin, end = self.hooks
        begin(node)
        out = self._lower(node, ctx)
        end(node, out)
        return out

    def _lower(self, node: a.Node, ctx: Context) -> Stream:
        match node:
            case a.Const(value):
                return v.literal(value)
            case a.MultiConst(values):
                return v.union([v.literal(x) for x in values])
            case a.Self():
                return ctx.value
            case a.Field(name):
                return ctx.extra[name] if name in ctx.extra else v.get_field(ctx.value, name)
            case a.AnyChild():
                children = v.children(ctx.value)
                return v.null() if children is None else self.or_null(children)
            case a.Wildcard():
                if ctx.value.kind not in ("object", "array", "dyn"):
                    return v.null()
                found = self.descend(ctx.value, lambda x: x)
                if ctx.value.kind == "dyn" and found is not None:
                    found = self.only_if(ctx.value.col["k"].isin(6, 7), found)
                return v.null() if found is None else self.or_null(found)
            case a.Path(left, right):
                return self.path(left, right, ctx)
            case a.Index(left, index):
                return self.index(self.lower(left, ctx), self.lower(index, ctx), index)
            case a.Sub(left, predicate):
                return self.sub(self.lower(left, ctx), predicate)
            case a.Unpack(operand):
                return self.over(self.lower(operand, ctx), self.unpack)
            case a.Unary(op, operand):
                return self.over(self.lower(operand, ctx), lambda x: self.kernels.unary(op, x))
            case a.Binary(op, left, right):
                return self.product(self.lower(left, ctx), self.lower(right, ctx), lambda x, y: self.kernels.binary(op, x, y))
            case a.Logic(op, left, right):
                return self.logic(op, self.lower(left, ctx), self.lower(right, ctx))
            case a.Quantifier(op, args):
                return Val("bool", self.quantifier(op, [self.lower(x, ctx) for x in args]))
            case a.Call(name, args):
                return self.call(node, name, args, ctx)
            case a.WordOp(name, args):
                if name not in self.operators:
                    raise QueryError("InvalidOperator", f"Invalid operator '{name}'", *node.span)
                streams = [self.lower(x, ctx) for x in args]
                if len(streams) == 1:
                    return self.over(streams[0], self.operators[name])
                return self.product(streams[0], streams[1], self.operators[name])
        raise TypeError(node)

    def path(self, left: a.Node, right: a.Node, ctx: Context) -> Stream:
        def step(x: Val) -> Stream:
            return self.lower(right, Context(x, ctx.extra if isinstance(left, a.Self) else {}))

        if isinstance(left, a.Wildcard) and ctx.value.kind in ("object", "array", "dyn"):

            def below(x: Val) -> Stream | None:
                r = step(x)
                return None if r.kind == "null" else self.not_null(r)

            found = self.descend(ctx.value, below)
            if found is not None and ctx.value.kind == "dyn":
                found = self.only_if(ctx.value.col["k"].isin(6, 7), found)
            return v.null() if found is None else self.or_null(found)
        l = self.lower(left, ctx)
        if l.kind == "null":
            return v.null()
        if isinstance(l, Val) and l.kind == "dyn" and not isinstance(right, a.Field):  # l made once
            shape: list[Stream] = []

            def once(c: Column) -> Column:
                r = step(Val("dyn", c))
                shape.append(r)
                if isinstance(r, Val):
                    return r.col if r.kind == "null" or isinstance(left, a.Self) else F.when(c.isNotNull(), r.col)
                return self.or_null(self.only_if(c.isNotNull(), self.not_null(r))).col

            col = v.let(l.col, once)
            return type(shape[0])(shape[0].kind, col, shape[0].typ)
        if isinstance(l, Val):
            r = step(l)
            if isinstance(r, Val):
                return r if r.kind == "null" or isinstance(left, a.Self) or self._null_in_null_out(right) else Val(r.kind, F.when(l.col.isNotNull(), r.col), r.typ)
            return self.or_null(self.only_if(l.col.isNotNull(), self.not_null(r)))
        inner = self.not_null(l)
        out = self.over(inner, step)
        if out.kind == "null":
            return v.null()
        return self.or_null(self.not_null(out))

    def _null_in_null_out(self, node: a.Node) -> bool:
        return isinstance(node, a.Field)

    def descend(self, x: Val, f: Callable[[Val], Stream | None], depth: int = 0) -> Many | None:
        """f of x and of all below it, parents first; null values and what is below them are skipped."""
        parts: list[Stream] = []
        own = f(x)
        if own is not None:
            parts.append(own)
        if x.kind == "object":
            for child in sorted(x.typ.fields, key=lambda c: c.name.encode()):  # type: ignore[union-attr]
                below = self.descend(v.val_of(x.col.getField(child.name), child.dataType), f, depth + 1)
                if below is not None:
                    parts.append(below)
        elif x.kind == "dyn":
            return self.descend_variant(x.col["v"] if depth == 0 else v.to_variant(x), f, depth)
        elif x.kind == "array":
            elements = v.children(x)
            shape: list[Many] = []

            def body(c: Column) -> Column:
                out = self.descend(self.element(elements, c), f, depth + 1)  # type: ignore[arg-type]
                if out is None:
                    return F.array()
                shape.append(out)
                return out.col

            mapped = F.flatten(F.transform(elements.col, body))  # type: ignore[union-attr]
            if shape:
                parts.append(Many(shape[0].kind, mapped, shape[0].typ))
        if not parts:
            return None
        return self.only_if(x.col.isNotNull(), v.union(parts)) if x.kind != "null" else None

    def descend_variant(self, x: Column, f: Callable[[Val], Stream | None], depth: int) -> Many | None:
        """descend() over a VARIANT, unrolled to the greatest depth; a deeper document is an error, never cut.

        The lambdas of one level hold only plain functions of their variable, so that the analyser needs one
        pass a level.
        """
        own = f(Val("dyn", v.from_variant(x)))
        if own is None:
            return None
        here = self.many(own)
        below = v.variant_children(x)
        if depth >= self.max_depth:
            wrong = F.raise_error(F.lit(f"Document deeper than {self.max_depth}")).cast(f"array<{v.sql_type(here.kind, here.typ)}>")
            rest = F.when(F.size(below) > 0, wrong).otherwise(v.empty(here))
        else:
            rest = F.flatten(F.transform(below, lambda c: self.descend_variant(c, f, depth + 1).col))  # type: ignore[union-attr]
        return self.only_if(x.isNotNull() & ~F.is_variant_null(x), Many(here.kind, F.concat(here.col, rest), here.typ))

    def tally(self, x: Val, depth: int = 0) -> Column:
        """How many true values x and all below it are; as descend(), without making them."""
        if x.kind == "object":
            here, below = F.lit(1), [self.tally(v.val_of(x.col.getField(c.name), c.dataType), depth + 1) for c in x.typ.fields]  # type: ignore[union-attr]
            return F.when(x.col.isNotNull(), sum(below, here)).otherwise(0)
        if x.kind == "array":
            element = x.typ.elementType  # type: ignore[union-attr]
            one = (lambda c: self.tally_variant(c, depth + 1)) if isinstance(element, T.VariantType) else (lambda c: self.tally(v.val_of(c, element), depth + 1))
            below = F.aggregate(x.col, F.lit(0), lambda n, c: n + one(c))
            return F.when(x.col.isNotNull(), 1 + below).otherwise(0)
        if x.kind == "dyn":
            return v.let(x.col["v"] if depth == 0 else v.to_variant(x), lambda c: self.tally_variant(c, depth))
        return F.when(v.truthy(x), 1).otherwise(0)

    def tally_variant(self, x: Column, depth: int) -> Column:
        return v.tally_variant(x, lambda items: self._tally_all(items, depth + 1), depth < self.max_depth)

    def _tally_all(self, items: Column, depth: int) -> Column:
        if depth > self.max_depth:
            return F.when(F.size(items) > 0, F.raise_error(F.lit(f"Document deeper than {self.max_depth}")).cast("int")).otherwise(0)
        return F.aggregate(items, F.lit(0), lambda n, c: n + self.tally_variant(c, depth))

    def index(self, left: Stream, index: Stream, node: a.Node) -> Stream:
        constant = node.value if isinstance(node, a.Const) else None

        def one(l: Val, i: Val) -> Val:
            if l.kind == "string":
                if i.kind not in ("int", "dyn"):
                    return Val("string", F.when(l.col.isNotNull(), self.kernels.error("A string is subscripted by int", "string")))
                at = i.col if i.kind == "int" else i.col["i"]
                inside = (at >= 0) & (at < F.octet_length(l.col))
                return Val("string", F.when(inside, v.byte_at(l.col, at)))
            if l.kind == "array" and i.kind == "int":
                return v.val_of(F.get(l.col, F.when(i.col >= 0, i.col.cast("int"))), l.typ.elementType)  # type: ignore[union-attr]
            if l.kind == "object" and isinstance(constant, str):
                return v.get_field(l, constant)
            if l.kind == "object" and isinstance(constant, int) and not isinstance(constant, bool):
                fields = sorted(l.typ.fields, key=lambda c: c.name.encode())  # type: ignore[union-attr]
                return v.get_field(l, fields[constant].name) if 0 <= constant < len(fields) else v.null()
            if l.kind in ("object", "array", "dyn"):
                return self._index_dyn(Val("dyn", v.to_dyn(l)), i)
            return v.null()

        if isinstance(left, Val) and isinstance(index, Val):
            return one(left, index)
        if isinstance(left, Val) and left.kind == "object" and isinstance(index, Many) and index.kind == "string":
            left = Val("dyn", v.to_dyn(left))
        if left.kind in ("object", "array", "dyn") and index.kind == "int" and (left.kind == "dyn" or isinstance(left, Many)):
            return self.or_null(self.many(self.over(left, lambda l: self.over(index, lambda i: self._places(l, i)))))
        out = self.product(left, index, one)
        if out.kind == "null":
            return v.null()
        if isinstance(left, Val) and left.kind == "array":  # an element that is null is there; a place outside is not
            kept = F.filter(index.col, lambda i: (i >= 0) & (i < F.size(left.col)))
            picked = F.transform(kept, lambda i: v.val_of(F.get(left.col, i.cast("int")), left.typ.elementType).col)  # type: ignore[union-attr]
            return self.or_null(Many(out.kind, F.coalesce(picked, v.empty(self.many(out))), out.typ))
        return self.or_null(self.not_null(out))

    def _places(self, l: Val, i: Val) -> Many:
        """The i-th child, which may be null, or nothing."""
        children = v.children(l)
        if children is None:
            return Many("dyn", F.array().cast(f"array<{v.DYN}>"))
        picked = F.when(i.col >= 0, F.slice(children.col, i.col.cast("int") + 1, 1)).otherwise(v.empty(children))
        if l.kind == "dyn":
            byte = self._index_dyn(l, i).col
            picked = F.when(l.col["k"] == 4, F.filter(F.array(byte), lambda x: x.isNotNull())).otherwise(picked)
        return Many(children.kind, F.coalesce(picked, v.empty(children)), children.typ)

    def _index_dyn(self, l: Val, i: Val) -> Val:
        place, name = (i.col["i"], i.col["s"]) if i.kind == "dyn" else (i.col if i.kind == "int" else None, i.col if i.kind == "string" else None)
        out = F.lit(None).cast(v.DYN)
        values = v.children(l)
        if place is not None:
            byte = F.when((place >= 0) & (place < F.octet_length(l.col["s"])), v.dyn("string", s=v.byte_at(l.col["s"], place)))
            out = F.when(place.isNotNull(), F.when(l.col["k"] == 4, byte).otherwise(F.get(values.col, F.when(place >= 0, place.cast("int")))))  # type: ignore[union-attr]
        if name is not None:
            quote = F.when(F.instr(name, '"') > 0, F.lit("'")).otherwise(F.lit('"'))
            path = F.concat(F.lit("$["), quote, name, quote, F.lit("]"))
            found = v.from_variant(F.when(l.col["k"] == 6, F.try_variant_get(l.col["v"], path, "variant")))
            out = F.coalesce(out, found)
        return Val("dyn", out)

    def sub(self, left: Stream, predicate: a.Node) -> Stream:
        def test(x: Val) -> Stream:
            return self.lower(predicate, Context(x))

        if left.kind == "null" and isinstance(left, Val):
            left = Val("dyn", v.no_dyn())
        if isinstance(left, Val):
            p = test(left)
            if isinstance(p, Val):
                return Val(left.kind, F.when(v.truthy(p), left.col), left.typ)
        shapes: list[Stream] = []

        def probe(x: Column) -> Column:
            p = test(self.element(self.many(left), x))
            shapes.append(p)
            return v.truthy(p) if isinstance(p, Val) else F.lit(True)

        m = self.many(left)
        single = F.filter(m.col, probe)
        if isinstance(shapes[0], Val):
            return self.or_null(Many(m.kind, single, m.typ))

        def repeated(x: Column) -> Column:
            hits = self.where(self.many(test(self.element(m, x))), v.truthy)
            return F.transform(hits.col, lambda _: x)

        return self.or_null(Many(m.kind, F.flatten(F.transform(m.col, repeated)), m.typ))

    def unpack(self, x: Val) -> Stream:
        if x.kind == "irange":
            return Many("int", F.sequence(x.col["begin"], x.col["end"]))
        if x.kind == "re":
            return v.null()
        if x.kind == "dyn":
            numbers = F.transform(F.sequence(x.col["i"], x.col["j"]), lambda n: v.dyn("int", i=n))
            return Many("dyn", F.when(x.col["k"] == 8, numbers).otherwise(F.array(x.col)))
        return x

    def logic(self, op: str, left: Stream, right: Stream) -> Stream:
        """Values of right for every left that does not decide, else the left value itself."""
        if isinstance(left, Val) and isinstance(right, Val):
            kind, typ = v.common([(left.kind, left.typ), (right.kind, right.typ)])
            goes = v.truthy(left) if op == "and" else ~v.truthy(left)
            if kind in ("object", "array"):
                fill = lambda x: x.col if x.kind == kind else F.lit(None).cast(typ)
                return Val(kind, F.when(goes, fill(right)).otherwise(fill(left)), typ)
            return Val(kind, F.when(goes, v.as_kind(right, kind)).otherwise(v.as_kind(left, kind)), typ)
        kind, typ = v.common([(left.kind, left.typ), (right.kind, right.typ)])
        empty_of = Val(kind, F.lit(None).cast(v.sql_type(kind, typ)), typ)
        cast = lambda s: Many(kind, F.filter(v.union([empty_of, s]).col, lambda x, i: i > 0), typ)  # noqa: E731  to the common kind
        r = cast(right)

        def step(x: Val) -> Many:
            goes = v.truthy(x) if op == "and" else ~v.truthy(x)
            return Many(kind, F.when(goes, r.col).otherwise(F.array(x.col)), typ)

        l = cast(left)
        return self.over(l, step)

    def quantifier(self, op: str, streams: list[Stream]) -> Column:
        def test(s: Stream) -> Column:
            if isinstance(s, Val):
                return v.truthy(s)
            f = F.exists if op == "any" else F.forall
            return f(s.col, lambda x: v.truthy(self.element(s, x)))

        out = F.lit(op != "any")
        for s in streams:
            out = (out | test(s)) if op == "any" else (out & test(s))
        return test(streams[0]) if len(streams) == 1 else out

    def call(self, node: a.Call, name: str, args: tuple[a.Node, ...], ctx: Context) -> Stream:
        own = next((f for k, f in self.functions.items() if k.lower() == name.lower()), None)
        if own is not None:
            return own(self, *[self.lower(x, ctx) for x in args])
        f = builtin.LOWERED.get(name.lower())
        if f is None:
            raise QueryError("UnknownFunction", f"Unknown function '{name}'", *node.span)
        return f(self, args, ctx)

    def pattern(self, node: a.Node) -> None:
        if isinstance(node, a.Const) and isinstance(node.value, Regex):
            node.value.check()


def context(column: Column, type_: T.DataType) -> Context:
    return Context(v.val_of(column, type_))
