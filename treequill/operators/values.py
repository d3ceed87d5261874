"""Values as Spark columns, and one kernel for each operator.

A :class:`Val` has a kind that is known when the plan is made; its column is NULL for null.  Kind ``dyn``
is a struct tagged with the kind of each row's value, for documents without a schema.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryError
from ..kinds import BYTE_ESCAPES, IRange, Regex

TAGS = {"bool": 1, "int": 2, "float": 3, "string": 4, "bytes": 5, "object": 6, "array": 7, "irange": 8}
NAMES = ("null", "bool", "int", "float", "string", "bytes", "model", "model", "irange")
SQL = {"bool": "boolean", "int": "bigint", "float": "double", "string": "string", "bytes": "binary", "irange": "struct<begin:bigint,end:bigint>", "re": "string", "null": "string"}
DYN = "struct<k:int,b:boolean,i:bigint,j:bigint,f:double,s:string,y:binary,v:variant>"
_SLOT = {"bool": "b", "int": "i", "float": "f", "string": "s", "bytes": "y", "object": "v", "array": "v"}
#: Casts that show whether a VARIANT is an object, or an array, without making variants of what is in it.
_OBJECT, _ARRAY = "struct<_bytes:boolean>", "array<array<boolean>>"
_TYPES = {"b": "boolean", "i": "bigint", "j": "bigint", "f": "double", "s": "string", "y": "binary", "v": "variant"}


@dataclass(frozen=True)
class Val:
    """One value.  typ is the Spark type of an object or array."""

    kind: str
    col: Column
    typ: T.DataType | None = None

    def sql(self) -> str:
        return sql_type(self.kind, self.typ)


@dataclass(frozen=True)
class Many:
    """A stream of values of one kind: an array column, never NULL."""

    kind: str
    col: Column
    typ: T.DataType | None = None

    def each(self, f: Callable[[Column], Column]) -> Column:
        return F.transform(self.col, f)


def sql_type(kind: str, typ: T.DataType | None) -> str:
    return DYN if kind == "dyn" else typ.simpleString() if typ is not None else SQL[kind]



def null() -> Val:
    return Val("null", F.lit(None).cast("string"))


def let(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of c, with c computed once."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def dyn(kind: str, **slots: Column) -> Column:
    return F.struct(F.lit(TAGS[kind]).alias("k"), *[(slots[n] if n in slots else F.lit(None)).cast(t).alias(n) for n, t in _TYPES.items()])


def no_dyn() -> Column:
    return F.lit(None).cast(DYN)


def literal(v: object) -> Val:
    if v is None:
        return null()
    if isinstance(v, IRange):
        return Val("irange", F.struct(F.lit(v.begin).cast("bigint").alias("begin"), F.lit(v.end).cast("bigint").alias("end")))
    if isinstance(v, Regex):
        return Val("re", F.lit(v.pattern))
    for cls, kind in ((bool, "bool"), (int, "int"), (float, "float"), (str, "string"), (bytes, "bytes")):
        if isinstance(v, cls):
            return Val(kind, F.lit(bytearray(v) if cls is bytes else v).cast(SQL[kind]))
    raise TypeError(v)


def kind_of_type(t: T.DataType) -> str:
    if isinstance(t, T.BooleanType):
        return "bool"
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "int"
    if isinstance(t, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "float"
    if isinstance(t, T.BinaryType):
        return "bytes"
    if isinstance(t, T.StructType):
        return "object"
    if isinstance(t, T.ArrayType):
        return "array"
    if isinstance(t, (T.VariantType, T.MapType)):
        return "dyn"
    return "null" if isinstance(t, T.NullType) else "string"


def val_of(c: Column, t: T.DataType) -> Val:
    kind = kind_of_type(t)
    if kind in ("object", "array"):
        return Val(kind, c, t)
    if kind == "dyn":
        return Val("dyn", from_variant(F.to_variant_object(c) if isinstance(t, T.MapType) else c))
    return null() if kind == "null" else Val(kind, c.cast(SQL[kind]))


def many_of(c: Column, t: T.DataType) -> Many:
    """The elements of a non-null array column of element type t."""
    kind = kind_of_type(t)
    if kind in ("object", "array"):
        return Many(kind, c, t)
    if kind == "dyn":
        return Many("dyn", F.transform(c, lambda x: val_of(x, t).col))
    return Many(kind, c.cast(f"array<{SQL[kind]}>"))


def _tagged(x: Column) -> Column:
    """Whether a VARIANT is tagged bytes; a path to a field that is not there takes longer than this cast."""
    return F.coalesce(F.try_variant_get(x, "$", _OBJECT)["_bytes"], F.lit(False))


def _too_long(t: Column) -> Column:
    """Whether the schema of a VARIANT is that of an integer that does not fit in 64 bits."""
    return t.startswith("DECIMAL") & t.rlike(r"^DECIMAL\((19|[23]\d),0\)")


def from_variant(v: Column) -> Column:
    """The tagged value of a VARIANT; JSON null and SQL NULL are NULL, {"_bytes":true,"hex":..} is bytes."""

    def scalar(x: Column) -> Column:
        def of(t: Column) -> Column:
            get = lambda kind: F.try_variant_get(x, "$", kind)
            return (
                F.when(t == "STRING", dyn("string", s=get("string")))
                .when(t == "BIGINT", dyn("int", i=get("bigint")))
                .when(t == "BOOLEAN", dyn("bool", b=get("boolean")))
                .when(t == "DOUBLE", dyn("float", f=get("double")))
                .when(_too_long(t), F.raise_error(F.lit("Integer out of range")).cast(DYN))
                .when(t.startswith("DECIMAL") | (t == "FLOAT"), dyn("float", f=get("double")))
                .when(t == "BINARY", dyn("bytes", y=get("binary")))
                .otherwise(dyn("string", s=get("string")))
            )

        return let(F.schema_of_variant(x), of)

    def model(x: Column) -> Column:
        return F.when(_tagged(x), dyn("bytes", y=F.unhex(F.try_variant_get(x, "$.hex", "string")))).otherwise(dyn("object", v=x))

    def of(x: Column) -> Column:
        return (
            F.when(x.isNull() | F.is_variant_null(x), no_dyn())
            .when(F.try_variant_get(x, "$", _OBJECT).isNotNull(), model(x))
            .when(F.try_variant_get(x, "$", _ARRAY).isNotNull(), dyn("array", v=x))
            .otherwise(scalar(x))
        )

    return let(v, of)


def to_dyn(v: Val) -> Column:
    if v.kind == "dyn":
        return v.col
    if v.kind == "null":
        return no_dyn()
    if v.kind == "re":
        raise QueryError("InvalidOperands", "A regular expression can't be mixed with other values")
    if v.kind == "irange":
        filled = dyn("irange", i=v.col["begin"], j=v.col["end"])
    else:
        filled = dyn(v.kind, **{_SLOT[v.kind]: F.to_variant_object(v.col) if v.kind in ("object", "array") else v.col})
    return F.when(v.col.isNotNull(), filled).otherwise(no_dyn())


def as_kind(v: Val, kind: str) -> Column:
    if v.kind == kind:
        return v.col
    if kind == "dyn":
        return to_dyn(v)
    if v.kind == "null":
        return F.lit(None).cast(SQL[kind])
    return v.col.cast(SQL[kind])


def common(kinds: list[tuple[str, T.DataType | None]]) -> tuple[str, T.DataType | None]:
    """The kind that streams of these kinds are joined in."""
    real = [k for k in dict.fromkeys((k, None if t is None else t.simpleString()) for k, t in kinds) if k[0] != "null"]
    if not real:
        return "null", None
    if len(real) == 1:
        return next((k, t) for k, t in kinds if k == real[0][0])
    return "dyn", None


def union(parts: list[Val | Many]) -> Many:
    """All streams one after the other."""
    kind, typ = common([(p.kind, p.typ) for p in parts])

    def column(p: Val | Many) -> Column:
        if isinstance(p, Val):
            return F.array(as_kind(p, kind) if not (kind in ("object", "array") and p.kind == "null") else F.lit(None).cast(typ))
        if p.kind == kind:
            return p.col
        return p.each(lambda x: as_kind(Val(p.kind, x, p.typ), kind) if not (kind in ("object", "array")) else F.lit(None).cast(typ))

    columns = [column(p) for p in parts]
    return Many(kind, columns[0] if len(columns) == 1 else F.concat(*columns), typ)


def truthy(v: Val) -> Column:
    if v.kind == "null":
        return F.lit(False)
    if v.kind == "bool":
        return F.coalesce(v.col, F.lit(False))
    if v.kind == "dyn":
        return let(v.col, lambda x: x.isNotNull() & ~((x["k"] == 1) & F.coalesce(~x["b"], F.lit(False))))
    return v.col.isNotNull()


def children(v: Val) -> Many | None:
    """Direct children; None where the kind has none.  Field names come in byte order."""
    if v.kind == "object":
        fields = sorted(v.typ.fields, key=lambda f: f.name.encode())  # type: ignore[union-attr]
        if not fields:
            return None
        all_ = union([val_of(v.col.getField(f.name), f.dataType) for f in fields])
        return Many(all_.kind, F.when(v.col.isNotNull(), all_.col).otherwise(empty(all_)), all_.typ)
    if v.kind == "array":
        element = v.typ.elementType  # type: ignore[union-attr]
        inner = many_of(F.coalesce(v.col, F.array().cast(v.typ)), element)
        return inner
    if v.kind == "dyn":
        none = F.array().cast("array<variant>")
        raw = let(
            v.col,
            lambda x: F.coalesce(F.when(x["k"] == 6, F.map_values(F.try_variant_get(x["v"], "$", "map<string,variant>"))), F.when(x["k"] == 7, F.try_variant_get(x["v"], "$", "array<variant>")), none),
        )
        return Many("dyn", F.transform(raw, from_variant))
    return None


def tally_variant(x: Column, below: Callable[[Column], Column], may_hold: bool) -> Column:
    """How many true values a VARIANT and all below it are; below counts in an array of its children, which fails where it may hold none.

    The schema tells the kind, and that an object has nothing but scalars that are true: those are not made.
    """

    def of(t: Column) -> Column:
        other = t.contains("ARRAY<") | (F.locate("OBJECT<", t, 2) > 0)
        for word in ("VOID", "BOOLEAN", "DECIMAL", "VARIANT", "_bytes"):  # in names, too: then the children are looked at
            other = other | t.contains(word)
        return (
            F.when(t.isin("STRING", "BIGINT", "DOUBLE"), 1)
            .when(t.startswith("OBJECT<") & ~other if may_hold else F.lit(False), 1 + F.size(F.try_variant_get(x, "$", f"map<string,{_ARRAY}>")))
            .when(t.startswith("OBJECT<") | t.startswith("ARRAY<"), 1 + below(variant_children(x)))
            .when(t.isNull() | (t == "VOID"), 0)
            .when(t == "BOOLEAN", F.try_variant_get(x, "$", "boolean").cast("int"))
            .when(_too_long(t), F.raise_error(F.lit("Integer out of range")).cast("int"))
            .otherwise(1)
        )

    return let(F.schema_of_variant(x), of)


def variant_children(x: Column) -> Column:
    """Direct children of a VARIANT, as VARIANTs; none of scalars and tagged bytes."""
    items = F.coalesce(F.try_variant_get(x, "$", "array<variant>"), F.map_values(F.try_variant_get(x, "$", "map<string,variant>")), F.array().cast("array<variant>"))
    return F.when(_tagged(x), F.array().cast("array<variant>")).otherwise(items)


def empty(m: Many) -> Column:
    return F.array().cast(f"array<{sql_type(m.kind, m.typ)}>")


def get_field(v: Val, name: str) -> Val:
    if v.kind == "object":
        field = next((f for f in v.typ.fields if f.name == name), None)  # type: ignore[union-attr]
        return val_of(v.col.getField(name), field.dataType) if field is not None else null()
    if v.kind == "dyn":
        quoted = f"$['{name}']" if '"' in name else f'$["{name}"]'
        # a path into anything but an object gives NULL
        return Val("dyn", from_variant(F.try_variant_get(v.col["v"], quoted, "variant")))
    return null()


# -- operators ---------------------------------------------------------------------------------


def be_int(b: Column) -> Column:
    short = F.when(F.octet_length(b) <= 8, b).when(F.ltrim(F.hex(F.substring(b, 9, 1 << 30)), F.lit("0")) == "", F.substring(b, 1, 8))
    return F.when(F.octet_length(b) == 0, F.lit(0).cast("bigint")).otherwise(F.conv(F.hex(short), 16, -10).cast("bigint"))


def utf8(b: Column) -> Column:
    """Bytes as text; what is not UTF-8 becomes U+FFFD."""
    return F.make_valid_utf8(b.cast("string"))


def byte_at(s: Column, at: Column) -> Column:
    """The byte of a text at a place that it has, as text."""
    return utf8(F.substring(F.encode(s, "utf-8"), at.cast("int") + 1, 1))


def bytes_literal(b: Column) -> Column:
    """Bytes as they are printed: b"..", with escapes."""

    def shown(pair: Column) -> Column:
        code = F.conv(pair, 16, 10).cast("int")
        plain = F.when((code >= 32) & (code < 127), F.char(code)).otherwise(F.concat(F.lit("\\x"), pair))
        return F.coalesce(*[F.when(code == c, F.lit(escape)) for c, escape in BYTE_ESCAPES.items()], plain)

    pairs = F.regexp_extract_all(F.hex(b), F.lit("[0-9A-F]{2}"), F.lit(0))
    return F.concat(F.lit('b"'), F.array_join(F.transform(pairs, shown), ""), F.lit('"'))


def full_match(s: Column, pattern: Column) -> Column:
    return F.rlike(s, F.concat(F.lit(r"\A(?:"), pattern, F.lit(r")\z")))


def _num(x: Column) -> Column:
    return x["k"].isin(2, 3)


def _f(x: Column) -> Column:
    return F.when(x["k"] == 2, x["i"].cast("double")).otherwise(x["f"])


_NUMERIC = ("int", "float")


class Kernels:
    """Operators under one error policy: ``raise`` fails the job, ``null`` gives null instead."""

    def __init__(self, on_error: str = "raise") -> None:
        self.on_error = on_error

    def error(self, message: str, type_: str) -> Column:
        return F.raise_error(F.lit(message)).cast(type_) if self.on_error == "raise" else F.lit(None).cast(type_)

    def _bad(self, op: str, kinds: str, guard: Column, type_: str) -> Column:
        return F.when(guard, self.error(f"Invalid operands {kinds} for operator {op}", type_))

    # comparison

    def equal(self, l: Val, r: Val) -> Val:
        for x, y in ((l, r), (r, l)):
            if x.kind == "re":
                if y.kind == "string":
                    return Val("dyn", F.when(y.col.isNull(), no_dyn()).otherwise(F.when(full_match(y.col, x.col), dyn("string", s=y.col)).otherwise(dyn("bool", b=F.lit(False)))))
                if y.kind == "dyn":
                    return Val("dyn", F.when(y.col.isNull(), no_dyn()).when((y.col["k"] == 4) & full_match(y.col["s"], x.col), y.col).otherwise(dyn("bool", b=F.lit(False))))
                return null() if y.kind == "null" else Val("bool", F.when(y.col.isNotNull(), F.lit(False)))
        return Val("bool", self._equal(l, r))

    def _equal(self, l: Val, r: Val) -> Column:
        both_null = l.col.isNull() & r.col.isNull()
        if "dyn" in (l.kind, r.kind):
            return let(F.struct(to_dyn(l).alias("x"), to_dyn(r).alias("y")), lambda p: self._equal_dyn(p["x"], p["y"]))
        if "null" in (l.kind, r.kind):
            return (r if l.kind == "null" else l).col.isNull() if l.kind != r.kind else F.lit(True)
        if l.kind == r.kind and l.kind in ("bool", "int", "float", "string", "bytes", "irange"):
            return l.col.eqNullSafe(r.col)
        for x, y in ((l, r), (r, l)):
            if x.kind in _NUMERIC and y.kind in _NUMERIC:
                return l.col.cast("double").eqNullSafe(r.col.cast("double"))
            if x.kind == "bytes" and y.kind in _NUMERIC:
                return both_null | F.coalesce(be_int(x.col) == y.col, F.lit(False))
            if x.kind == "irange" and y.kind in _NUMERIC:
                return both_null | F.coalesce(y.col.between(F.least(x.col["begin"], x.col["end"]), F.greatest(x.col["begin"], x.col["end"])), F.lit(False))
        return both_null

    def _equal_dyn(self, x: Column, y: Column) -> Column:
        inside = lambda n, r: _f(n).between(F.least(r["i"], r["j"]), F.greatest(r["i"], r["j"]))
        same = F.when(x["k"] == 1, x["b"] == y["b"]).when(x["k"] == 4, x["s"] == y["s"]).when(x["k"] == 5, x["y"] == y["y"]).when(x["k"] == 8, (x["i"] == y["i"]) & (x["j"] == y["j"])).otherwise(False)
        return (
            F.when(x.isNull() | y.isNull(), x.isNull() & y.isNull())
            .when(_num(x) & _num(y), F.when((x["k"] == 2) & (y["k"] == 2), x["i"] == y["i"]).otherwise(_f(x) == _f(y)))
            .when(x["k"] == y["k"], same)
            .when((x["k"] == 8) & _num(y), inside(y, x))
            .when(_num(x) & (y["k"] == 8), inside(x, y))
            .when((x["k"] == 5) & _num(y), F.coalesce(be_int(x["y"]) == _f(y), F.lit(False)))
            .when(_num(x) & (y["k"] == 5), F.coalesce(_f(x) == be_int(y["y"]), F.lit(False)))
            .otherwise(False)
        )

    def unequal(self, l: Val, r: Val) -> Val:
        for x, y in ((l, r), (r, l)):
            if x.kind == "re":
                d = y if y.kind == "dyn" else Val("dyn", to_dyn(y))
                return Val("dyn", F.when(d.col.isNull(), no_dyn()).when(d.col["k"] != 4, dyn("bool", b=F.lit(True))).when(full_match(d.col["s"], x.col), dyn("bool", b=F.lit(False))).otherwise(d.col))
        return Val("bool", ~self._equal(l, r))

    def less(self, l: Val, r: Val, or_equal: bool = False) -> Val:
        op = "<=" if or_equal else "<"
        if {"re", "irange"} & {l.kind, r.kind}:
            return Val("bool", self.error(f"Invalid operands for operator {op}", "boolean"))
        compare = (lambda a, b: a <= b) if or_equal else (lambda a, b: a < b)
        nulls = (lambda a, b: a.isNull() & b.isNull()) if or_equal else (lambda a, b: F.lit(False))
        if "dyn" in (l.kind, r.kind):

            def of(p: Column) -> Column:
                x, y = p["x"], p["y"]
                out = (
                    F.when(x.isNull() | y.isNull(), nulls(x, y))
                    .when((x["k"] == 2) & (y["k"] == 2), compare(x["i"], y["i"]))
                    .when(_num(x) & _num(y), compare(_f(x), _f(y)))
                    .when((x["k"] == 4) & (y["k"] == 4), compare(x["s"], y["s"]))
                    .when((x["k"] == 5) & (y["k"] == 5), compare(x["y"], y["y"]))
                    .when((x["k"] == 5) & _num(y), compare(be_int(x["y"]), _f(y)))
                    .when(_num(x) & (y["k"] == 5), compare(_f(x), be_int(y["y"])))
                )
                return F.coalesce(out, F.lit(False))

            return Val("bool", let(F.struct(to_dyn(l).alias("x"), to_dyn(r).alias("y")), of))
        a, b = l.col, r.col
        if l.kind == "bytes" and r.kind in _NUMERIC:
            a = be_int(a)
        elif r.kind == "bytes" and l.kind in _NUMERIC:
            b = be_int(b)
        elif not (l.kind == r.kind and l.kind in ("int", "float", "string", "bytes")) and not (l.kind in _NUMERIC and r.kind in _NUMERIC):
            return Val("bool", nulls(a, b))
        out = F.coalesce(compare(a, b), F.lit(False))
        return Val("bool", out | nulls(l.col, r.col) if or_equal else out)

    # arithmetic

    def arithmetic(self, op: str, l: Val, r: Val) -> Val:
        if "null" in (l.kind, r.kind) and op != "+":
            return null()
        if op == "+" and (l.kind == "string" or r.kind == "string") and "dyn" not in (l.kind, r.kind):
            if {"object", "array"} & {l.kind, r.kind}:
                return null()
            return Val("string", F.concat(self.as_string(l).col, self.as_string(r).col))
        if "null" in (l.kind, r.kind):
            other = r if l.kind == "null" else l
            if other.kind != "dyn":
                return null()
        if "dyn" in (l.kind, r.kind):
            return Val("dyn", let(F.struct(to_dyn(l).alias("x"), to_dyn(r).alias("y")), lambda p: self._arithmetic_dyn(op, p["x"], p["y"])))
        if l.kind in _NUMERIC and r.kind in _NUMERIC:
            kind = "int" if l.kind == r.kind == "int" else "float"
            if op in ("%", "&", "|", "^", "<<", ">>") and kind == "float":
                return Val("int", self._bad(op, f"{l.kind} and {r.kind}", l.col.isNotNull() & r.col.isNotNull(), "bigint"))
            return Val(kind, self._numbers(op, as_kind(l, kind), as_kind(r, kind), kind))
        if op == "+" and {l.kind, r.kind} <= {"object", "array"}:
            return null()
        return Val("null", self._bad(op, f"{l.kind} and {r.kind}", l.col.isNotNull() & r.col.isNotNull(), "string"))

    def _numbers(self, op: str, a: Column, b: Column, kind: str) -> Column:
        strict = self.on_error == "raise"
        if op in ("+", "-", "*"):
            if strict or kind == "float":
                return {"+": a + b, "-": a - b, "*": a * b}[op]
            return {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](a, b)
        if op in ("/", "%"):
            zero = a.isNotNull() & (b == 0)
            if op == "%":
                value = F.when(b != 0, a % b)
            else:
                value = F.when(b != 0, a / b) if kind == "float" else F.when(b != 0, F.call_function("div", a, F.when(b != 0, b)))
            return F.when(zero, self.error("Division by zero", SQL[kind])).otherwise(value)
        if op in ("<<", ">>"):
            return F.call_function("shiftleft" if op == "<<" else "shiftrightunsigned", a, b.cast("int"))
        return {"&": a.bitwiseAND, "|": a.bitwiseOR, "^": a.bitwiseXOR}[op](b)

    def _arithmetic_dyn(self, op: str, x: Column, y: Column) -> Column:
        ints = (x["k"] == 2) & (y["k"] == 2)
        out = F.when(ints, dyn("int", i=self._numbers(op, x["i"], y["i"], "int")))
        if op in ("+", "-", "*", "/"):
            out = out.when(_num(x) & _num(y), dyn("float", f=self._numbers(op, _f(x), _f(y), "float")))
        model = lambda v: F.coalesce(v["k"].isin(6, 7), F.lit(False))
        if op == "+":
            text = F.coalesce(x["k"] == 4, F.lit(False)) | F.coalesce(y["k"] == 4, F.lit(False))
            out = out.when(text, F.when(model(x) | model(y), no_dyn()).otherwise(dyn("string", s=F.concat(self.as_string(Val("dyn", x)).col, self.as_string(Val("dyn", y)).col))))
            out = out.when(model(x) & model(y), no_dyn())
        return out.when(x.isNull() | y.isNull(), no_dyn()).otherwise(self.error(f"Invalid operands for operator {op}", DYN))

    def binary(self, op: str, l: Val, r: Val) -> Val:
        match op:
            case "==":
                return self.equal(l, r)
            case "!=":
                return self.unequal(l, r)
            case "<" | "<=":
                return self.less(l, r, op == "<=")
            case ">" | ">=":
                return self.less(r, l, op == ">=")
        return self.arithmetic(op, l, r)

    # unary

    def unary(self, op: str, v: Val) -> Val:
        match op:
            case "typeof":
                if v.kind == "dyn":
                    return Val("string", F.get(F.array(*[F.lit(n) for n in NAMES]), F.coalesce(v.col["k"], F.lit(0))))
                name = {"object": "model", "array": "model"}.get(v.kind, v.kind)
                return Val("string", F.when(v.col.isNull(), "null").otherwise(name) if v.kind != "null" else F.lit("null"))
            case "?" | "bool":
                return Val("bool", truthy(v))
            case "not":
                return Val("bool", self.error("Invalid operand for operator not", "boolean") if v.kind in ("irange", "re") else ~truthy(v))
            case "null":
                return null()
            case "int":
                return Val("int", self._dispatch(v, self._int, "bigint", F.lit(0).cast("bigint")))
            case "float":
                return Val("float", self._dispatch(v, self._float, "double", F.lit(0.0)))
            case "string":
                return self.as_string(v)
            case "bytes":
                return Val("bytes", self._dispatch(v, self._bytes, "binary", F.lit(bytearray(b"null"))))
            case "#":
                return Val("int", self._dispatch(v, self._length, "bigint", F.lit(None).cast("bigint")))
            case "-" | "~":
                if v.kind == "dyn":

                    def of(x: Column) -> Column:
                        out = F.when(x.isNull(), no_dyn()).when(x["k"] == 2, dyn("int", i=-x["i"] if op == "-" else F.bitwise_not(x["i"])))
                        if op == "-":
                            out = out.when(x["k"] == 3, dyn("float", f=-x["f"]))
                        return out.otherwise(self.error(f"Invalid operand for operator {op}", DYN))

                    return Val("dyn", let(v.col, of))
                if v.kind == "null" or v.kind == "int" or (v.kind == "float" and op == "-"):
                    return v if v.kind == "null" else Val(v.kind, -v.col if op == "-" else F.bitwise_not(v.col))
                return Val("null", self._bad(op, v.kind, v.col.isNotNull(), "string"))
        raise QueryError("InvalidOperator", f"Invalid operator {op}")

    def as_string(self, v: Val) -> Val:
        return Val("string", self._dispatch(v, self._string, "string", F.lit("null")))

    def _dispatch(self, v: Val, f: Callable[[Val], Column], type_: str, of_null: Column) -> Column:
        if v.kind == "null":
            return of_null
        if v.kind != "dyn":
            return F.when(v.col.isNull(), of_null).otherwise(f(v))

        def of(x: Column) -> Column:
            out = F.when(x.isNull(), of_null)
            for kind, slot in _SLOT.items():
                out = out.when(x["k"] == TAGS[kind], f(Val(kind, x[slot], T.VariantType() if slot == "v" else None)))
            irange = F.struct(x["i"].alias("begin"), x["j"].alias("end"))
            return out.when(x["k"] == 8, f(Val("irange", irange))).otherwise(F.lit(None).cast(type_))

        return let(v.col, of)

    def _int(self, v: Val) -> Column:
        zero = F.lit(0).cast("bigint")
        match v.kind:
            case "bool" | "int":
                return v.col.cast("bigint")
            case "float":
                return F.coalesce(v.col.try_cast("bigint"), zero)
            case "string":
                return F.coalesce(F.regexp_extract(v.col, r"^\s*([+-]?\d+)", 1).try_cast("bigint"), zero)
            case "bytes":
                return F.coalesce(be_int(v.col), zero)
        return zero

    def _float(self, v: Val) -> Column:
        match v.kind:
            case "bool":
                return v.col.cast("int").cast("double")
            case "int" | "float":
                return v.col.cast("double")
            case "string":
                return F.coalesce(F.trim(F.regexp_extract(v.col, r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", 0)).try_cast("double"), F.lit(0.0))
            case "bytes":
                return self.error("Invalid operand bytes for operator float", "double")
        return F.lit(0.0)

    def _string(self, v: Val) -> Column:
        match v.kind:
            case "bool" | "int" | "string" | "re":
                return v.col.cast("string")
            case "float":
                return F.format_string("%.6f", v.col)
            case "bytes":
                return utf8(v.col)
            case "irange":
                return F.concat(v.col["begin"].cast("string"), F.lit(".."), v.col["end"].cast("string"))
        return F.lit("")

    def _bytes(self, v: Val) -> Column:
        match v.kind:
            case "bool":
                return F.when(v.col, F.lit(bytearray(b"\1"))).otherwise(F.lit(bytearray(b"\0")))
            case "int":
                return F.unhex(F.lpad(F.hex(v.col), 16, "0"))
            case "string":
                return v.col.cast("binary")
            case "bytes":
                return v.col
            case "object" | "array":
                return F.lit(bytearray())
        return self.error(f"Invalid operand {v.kind} for operator bytes", "binary")

    def _length(self, v: Val) -> Column:
        match v.kind:
            case "string" | "bytes":
                return F.octet_length(v.col).cast("bigint")
            case "irange":
                return F.abs(v.col["end"] - v.col["begin"])
            case "array" if not isinstance(v.typ, T.VariantType):
                return F.size(v.col).cast("bigint")
            case "object" if not isinstance(v.typ, T.VariantType):
                return F.lit(len(v.typ.fields)).cast("bigint")  # type: ignore[union-attr]
            case "array":
                return F.size(F.try_variant_get(v.col, "$", "array<variant>")).cast("bigint")
            case "object":
                return F.size(F.try_variant_get(v.col, "$", "map<string,variant>")).cast("bigint")
        return self.error(f"Invalid operand {v.kind} for operator #", "bigint")


def to_variant(v: Val) -> Column:
    if v.kind == "null":
        return F.lit(None).cast("variant")
    if v.kind in ("object", "array"):
        return F.to_variant_object(v.col)
    if v.kind == "irange":
        return F.to_variant_object(v.col)
    if v.kind == "dyn":

        def of(x: Column) -> Column:
            out = F.when(x.isNull(), F.lit(None).cast("variant"))
            for kind, slot in _SLOT.items():
                out = out.when(x["k"] == TAGS[kind], x[slot] if slot == "v" else x[slot].cast("variant"))
            return out.otherwise(F.to_variant_object(F.struct(x["i"].alias("begin"), x["j"].alias("end"))))

        return let(v.col, of)
    return v.col.cast("variant")


def to_text(v: Val, kernels: Kernels) -> Column:
    """How a result is printed: models as JSON, null as null."""
    if v.kind in ("object", "array"):
        return F.coalesce(F.to_json(F.to_variant_object(v.col)), F.lit("null"))
    if v.kind == "bytes":
        return F.coalesce(bytes_literal(v.col), F.lit("null"))
    if v.kind == "dyn":
        return let(v.col, lambda x: F.when(x["k"].isin(6, 7), F.to_json(x["v"])).when(x["k"] == 5, bytes_literal(x["y"])).otherwise(kernels.as_string(Val("dyn", x)).col))
    return kernels.as_string(v).col
