"""What a query met in the data: fields that never matched, comparisons that always went one way."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ast as a
from .operators.lower import Context, Lowering, context
from .operators.values import Val
from .plans.session import Session


@dataclass(frozen=True)
class Message:
    text: str
    offset: int
    size: int


@dataclass
class Diagnostics:
    """Counts by node: hits of fields, kinds and outcomes of comparisons.  They add up over documents and runs."""

    counts: dict[str, dict]

    def merge(self, other: Diagnostics) -> Diagnostics:
        out = {k: dict(c) for k, c in self.counts.items()}
        for k, c in other.counts.items():
            mine = out.setdefault(k, {})
            for name, x in c.items():
                mine[name] = mine.get(name, [] if isinstance(x, list) else 0 if isinstance(x, int) else x)
                if isinstance(x, list):
                    mine[name] = sorted({*mine[name], *x})
                elif name in ("hits", "true", "false"):
                    mine[name] += x
                else:
                    mine[name] = x
        return Diagnostics(out)

    def to_json(self) -> str:
        return json.dumps(self.counts, sort_keys=True)

    @staticmethod
    def from_json(text: str) -> Diagnostics:
        return Diagnostics(json.loads(text))

    def messages(self) -> list[Message]:
        out = []
        for c in self.counts.values():
            place = (c["offset"], c["size"])
            if c["what"] == "field":
                if not c["hits"]:
                    out.append(Message(f"No matches for field '{c['name']}'.", *place))
                continue
            left, right = set(c["left"]), set(c["right"])
            same = {"int" if k == "float" else k for k in left} & {"int" if k == "float" else k for k in right}
            if same or not left or not right:
                continue
            one_way = "All values compared to true. " if not c["false"] else "All values compared to false. " if not c["true"] else ""
            out.append(Message(f"{one_way}Left hand types are {', '.join(sorted(left))}, right hand types are {', '.join(sorted(right))}.", *place))
        return out


def diagnose(session: Session, df: DataFrame, doc: str, query: str) -> Diagnostics:
    """One aggregation over all documents, with a few numbers for each field and comparison of the query."""
    q = session.compile(query)
    column, type_ = session._doc(df, doc)
    low = Lowering(session.functions, session.operators, "null", session.max_depth)
    root = context(column, type_)
    wanted: list[Column] = []
    shapes: list[dict] = []

    def kinds(s) -> Column:
        return low.many(low.over(s, lambda x: low.kernels.unary("typeof", x))).col

    def walk(node: a.Node, ctxs: list[tuple[a.Node | None, Context]]) -> None:
        ctx = ctxs[-1][1]
        if isinstance(node, a.Path):
            walk(node.left, ctxs)
            if isinstance(node.right, a.Field):
                found = low.lower(node, ctx)
                shapes.append({"what": "field", "name": node.right.name, "offset": node.right.span[0], "size": node.right.span[1]})
                wanted.append(F.sum(F.size(low.not_null(found).col)).alias(f"n{len(shapes)}"))
            return
        if isinstance(node, a.Field):
            shapes.append({"what": "field", "name": node.name, "offset": node.span[0], "size": node.span[1]})
            wanted.append(F.sum(F.size(low.not_null(low.lower(node, ctx)).col)).alias(f"n{len(shapes)}"))
            return
        if isinstance(node, a.Sub):
            walk(node.left, ctxs)
            return
        if isinstance(node, a.Binary) and node.op in ("==", "!=", "<", "<=", ">", ">="):
            l, r = low.lower(node.left, ctx), low.lower(node.right, ctx)
            result = low.over(low.lower(node, ctx), lambda x: Val("bool", _truth(x)))
            shapes.append({"what": "comparison", "offset": node.span[0], "size": node.span[1]})
            i = len(shapes)
            wanted.extend([
                F.array_distinct(F.flatten(F.collect_set(kinds(l)))).alias(f"l{i}"),
                F.array_distinct(F.flatten(F.collect_set(kinds(r)))).alias(f"r{i}"),
                F.sum(F.size(F.filter(low.many(result).col, lambda x: x))).alias(f"t{i}"),
                F.sum(F.size(F.filter(low.many(result).col, lambda x: ~F.coalesce(x, F.lit(False))))).alias(f"f{i}"),
            ])
        for child in node.children():
            walk(child, ctxs)

    walk(q.tree, [(None, root)])
    counts: dict[str, dict] = {}
    row = df.agg(*wanted).first() if wanted else None
    for i, shape in enumerate(shapes, 1):
        if shape["what"] == "field":
            shape["hits"] = row[f"n{i}"] or 0
        else:
            shape |= {"left": sorted(row[f"l{i}"] or []), "right": sorted(row[f"r{i}"] or []), "true": row[f"t{i}"] or 0, "false": row[f"f{i}"] or 0}
        counts[f"{i}:{shape['what']}:{shape['offset']}"] = shape
    return Diagnostics(counts)


def _truth(x: Val) -> Column:
    from .operators.values import truthy

    return truthy(x)
