"""The built-in functions as Spark columns."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import functions as F

from .. import ast as a
from ..errors import QueryError
from ..evaluate import need
from ..operators import values as v
from ..operators.values import Many, Val

if TYPE_CHECKING:
    from ..operators.lower import Context, Lowering, Stream


def _single(low: Lowering, args: tuple[a.Node, ...], at: int, kind: str | None, name: str, ctx: Context) -> Val:
    value = low.one(low.lower(args[at], ctx), name)
    if kind is None or value.kind == kind:
        return value
    if value.kind == "dyn" and kind in ("int", "string", "bool"):
        slot = {"int": "i", "string": "s", "bool": "b"}[kind]
        wrong = low.kernels.error(f"{name}: argument {at + 1} is not {kind}", v.SQL[kind])
        return Val(kind, F.when(value.col["k"] == v.TAGS[kind], value.col[slot]).otherwise(wrong))
    raise QueryError("TypeMismatch", f"{name}: argument {at + 1} has type {value.kind}", *args[at].span)


def _nothing(low: Lowering, m: Many) -> Many:
    """A function must give something."""
    wrong = low.kernels.error("Function did not call result callback", f"array<{v.sql_type(m.kind, m.typ)}>")
    return low.or_null(Many(m.kind, v.let(m.col, lambda c: F.when(F.size(c) > 0, c).otherwise(F.coalesce(wrong, v.empty(m)))), m.typ))


def count(low: Lowering, args, ctx) -> Stream:
    need(args, 1, None, "count")
    total = F.lit(0).cast("bigint")
    for arg in args:
        if isinstance(arg, a.Wildcard) and low.hooks is None and ctx.value.kind in ("object", "array", "dyn"):
            total = total + low.tally(ctx.value)
            continue
        s = low.lower(arg, ctx)
        total = total + (F.when(v.truthy(s), 1).otherwise(0) if isinstance(s, Val) else F.size(low.where(s, v.truthy).col))
    return Val("int", total.cast("bigint"))


def sum_(low: Lowering, args, ctx) -> Stream:
    need(args, 1, 3, "sum")
    stream = low.many(low.lower(args[0], ctx))
    init = low.one(low.lower(args[2], ctx), "sum") if len(args) > 2 else v.literal(0)
    hidden = lambda x: Val("null", F.lit(None).cast("string")) if x.kind in ("irange", "re") else x

    def body(acc: Val, x: Val, i) -> Val:
        if len(args) == 1:
            added = low.kernels.binary("+", acc, x)
            kind, typ = v.common([(added.kind, added.typ), (x.kind, x.typ)])
            if kind in ("object", "array"):
                return Val("dyn", F.when(acc.col.isNull(), v.to_dyn(x)).otherwise(v.to_dyn(added)))
            return Val(kind, F.when(acc.col.isNull(), v.as_kind(x, kind)).otherwise(v.as_kind(added, kind)), typ)
        from ..operators.lower import Context

        out = low.lower(args[1], Context(x, {"$sum": acc, "$val": hidden(x), "$idx": Val("int", i)}))
        return out if isinstance(out, Val) else Val(out.kind, F.element_at(out.col, -1), out.typ)

    kind = init.kind if init.kind != "null" else "dyn"
    if kind in ("object", "array", "irange", "re"):
        kind = "dyn"
    while True:  # the accumulator's kind must hold what the body makes of it
        blank = Val(kind, F.lit(None).cast(v.sql_type(kind, None)))
        seen: list[str] = []
        F.transform(F.array(F.lit(0)), lambda _: seen.append(body(blank, Val(stream.kind, F.lit(None).cast(v.sql_type(stream.kind, stream.typ)), stream.typ), F.lit(0).cast("bigint")).kind) or F.lit(0))
        made = seen[0]
        if made in (kind, "null") or kind == "dyn":
            break
        kind = "float" if {made, kind} == {"int", "float"} else "dyn"
    pairs = F.transform(stream.col, lambda x, i: F.struct(x.alias("x"), i.cast("bigint").alias("i")))
    step = lambda acc, p: v.as_kind(body(Val(kind, acc), Val(stream.kind, p["x"], stream.typ), p["i"]), kind).cast(v.sql_type(kind, None))
    plain = len(args) == 1
    if plain:
        return Val(kind, F.aggregate(stream.col, v.as_kind(init, kind), lambda acc, x: v.as_kind(body(Val(kind, acc), Val(stream.kind, x, stream.typ), None), kind).cast(v.sql_type(kind, None))))
    return Val(kind, F.aggregate(pairs, v.as_kind(init, kind), step))


def arr(low: Lowering, args, ctx) -> Stream:
    return v.union([low.lower(x, ctx) for x in args]) if args else v.null()


def select(low: Lowering, args, ctx) -> Stream:
    need(args, 2, 3, "select")
    stream = low.many(low.lower(args[0], ctx))
    index = _single(low, args, 1, "int", "select", ctx).col.cast("int")
    n = _single(low, args, 2, "int", "select", ctx).col.cast("int") if len(args) > 2 else F.lit(1)
    size = F.size(stream.col)
    start = F.greatest(index, F.lit(0))
    length = F.when(n <= 0, size).otherwise(n)
    return _nothing(low, Many(stream.kind, F.slice(stream.col, start + 1, length), stream.typ))


def split(low: Lowering, args, ctx) -> Stream:
    need(args, 2, 3, "split")
    s, sep = (_single(low, args, i, "string", "split", ctx).col for i in (0, 1))
    keep = _single(low, args, 2, "bool", "split", ctx).col if len(args) > 2 else F.lit(True)
    quoted = F.concat(F.lit("\\Q"), F.replace(sep, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    parts = F.when(sep == "", F.array(s)).otherwise(F.split(s, quoted, -1))
    parts = F.filter(parts, lambda x: keep | (x != ""))
    return _nothing(low, Many("string", F.when(F.coalesce(s, F.lit("")) == "", F.array().cast("array<string>")).otherwise(parts)))


def keys(low: Lowering, args, ctx) -> Stream:
    need(args, 1, 1, "keys")
    none = F.array().cast("array<string>")

    def of(x: Val) -> Many:
        if x.kind == "object":
            names = sorted((f.name for f in x.typ.fields), key=str.encode)
            return Many("string", F.when(x.col.isNotNull(), F.array(*map(F.lit, names)).cast("array<string>")).otherwise(none))
        if x.kind == "array":
            return Many("string", F.coalesce(F.array_repeat(F.lit(""), F.size(x.col)), none))
        if x.kind == "dyn":
            names = F.map_keys(F.try_variant_get(x.col["v"], "$", "map<string,variant>"))
            blanks = F.array_repeat(F.lit(""), F.size(F.try_variant_get(x.col["v"], "$", "array<variant>")))
            return Many("string", F.coalesce(F.when(x.col["k"] == 6, names), F.when(x.col["k"] == 7, blanks), none))
        return Many("string", none)

    # a wildcard's values are kept apart by type, so that typed documents need no conversion
    if isinstance(args[0], a.Wildcard) and ctx.value.kind in ("object", "array", "dyn"):
        found = low.descend(ctx.value, of)
        return _nothing(low, found if found is not None else Many("string", none))
    return _nothing(low, low.many(low.over(low.lower(args[0], ctx), of)))


def range_(low: Lowering, args, ctx) -> Stream:
    need(args, 2, 2, "range")
    begin, end = (_single(low, args, i, "int", "range", ctx).col for i in (0, 1))
    return Val("irange", F.when(begin.isNotNull() & end.isNotNull(), F.struct(begin.alias("begin"), end.alias("end"))).otherwise(low.kernels.error("range: argument is null", v.SQL["irange"])))


def re_(low: Lowering, args, ctx) -> Stream:
    need(args, 1, 1, "re")

    def of(x: Val) -> Val:
        if x.kind in ("string", "re"):
            return Val("re", x.col)
        if x.kind == "dyn":
            return Val("re", x.col["s"])
        raise QueryError("TypeMismatch", f"re: argument has type {x.kind}", *args[0].span)

    return low.over(low.lower(args[0], ctx), of)


def trace(low: Lowering, args, ctx) -> Stream:
    """The values as they are; Session.trace() observes them."""
    need(args, 1, 3, "trace")
    return low.lower(args[0], ctx)


LOWERED = {"count": count, "sum": sum_, "arr": arr, "select": select, "split": split, "keys": keys, "range": range_, "re": re_, "trace": trace}
