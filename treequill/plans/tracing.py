"""What the trace() calls of a query saw: calls, values and the first of them, over all documents."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from .. import ast as a
from ..operators import values as v
from ..operators.lower import Context, Lowering, Many, Stream, context
from ..operators.values import Val
from .session import Session

#: A function of a context, evaluated in all contexts that a node is met in.
Everywhere = Callable[[Callable[[Context], Stream]], Stream]


@dataclass
class Traces:
    """By name: (calls, values), and a table (keys, pos, text) of the first ``limit`` values by keys, or of all."""

    counts: dict[str, tuple[int, int]] = field(default_factory=dict)
    tables: dict[str, DataFrame] = field(default_factory=dict)
    seconds: float = 0.0

    def merge(self, other: Traces) -> Traces:
        """Both together: counts and seconds are added, tables put one after the other."""
        counts, tables = dict(self.counts), dict(self.tables)
        for name, (calls, values) in other.counts.items():
            mine = counts.get(name, (0, 0))
            counts[name] = (mine[0] + calls, mine[1] + values)
            tables[name] = tables[name].union(other.tables[name]) if name in tables else other.tables[name]
        return Traces(counts, tables, self.seconds + other.seconds)


def _calls(low: Lowering, node: a.Node, at: Everywhere) -> list[tuple[a.Call, Everywhere]]:
    found: list[tuple[a.Call, Everywhere]] = []
    if isinstance(node, a.Call) and node.name.lower() == "trace":
        found.append((node, at))
    if isinstance(node, (a.Sub, a.Path)):
        inner = node.predicate if isinstance(node, a.Sub) else node.right
        below: Everywhere = lambda f: at(lambda c: low.over(low.not_null(low.lower(node.left, c)), lambda x: f(Context(x))))
        return [*found, *_calls(low, node.left, at), *_calls(low, inner, below)]
    for child in node.children():
        found += _calls(low, child, at)
    return found


def _texts(low: Lowering, m: Many) -> Column:
    return m.each(lambda x: v.to_text(Val(m.kind, x, m.typ), low.kernels))


def traces(session: Session, df: DataFrame, doc: str, query: str, keys: list[str]) -> Traces:
    """One aggregation for all counts.  Calls on both sides of ``and`` and ``or`` are counted, as columns have no
    short cut.  A limit or name that is not a literal is left out: all values, named by the argument."""
    q = session.compile(query)
    column, type_ = session._doc(df, doc)
    low = q.lowering
    root = context(column, type_)
    out = Traces()
    wanted, names = [], []
    for call, at in _calls(low, q.tree, lambda f: f(root)):
        given = [x.value if isinstance(x, a.Const) else None for x in call.args[1:]]
        limit = given[0] if given and isinstance(given[0], int) else -1
        name = given[1] if len(given) > 1 and isinstance(given[1], str) else a.to_sexpr(call.args[0])
        seen: Many = low.many(at(lambda c, node=call.args[0]: low.many(low.lower(node, c))))
        times = low.many(at(lambda c: Val("int", F.lit(1).cast("bigint"))))
        table = df.select(*keys, F.posexplode(_texts(low, seen)).alias("pos", "text"))
        if limit >= 0:
            table = table.orderBy(*keys, "pos").limit(limit)
        wanted += [F.sum(F.size(times.col)), F.sum(F.size(seen.col))]
        names.append((name, table))
    start = time.monotonic()
    row = df.agg(*wanted).first() if wanted else []
    for i, (name, table) in enumerate(names):
        out = out.merge(Traces({name: (row[2 * i] or 0, row[2 * i + 1] or 0)}, {name: table}))
    out.seconds = time.monotonic() - start
    return out


def collect_within(df: DataFrame, seconds: float) -> list[Row] | None:
    """The rows of ``df``, or None where they are not there in time; Spark then ends the jobs that make them."""
    sc = df.sparkSession.sparkContext
    tag, late = f"treequill-{uuid.uuid4().hex}", threading.Event()

    def stop() -> None:
        late.set()
        sc.cancelJobsWithTag(tag)

    timer = threading.Timer(seconds, stop)
    sc.addJobTag(tag)
    timer.start()
    try:
        rows = df.collect()
        return None if late.is_set() else rows
    except Exception:
        if late.is_set():
            return None
        raise
    finally:
        timer.cancel()
        sc.removeJobTag(tag)
