"""Documents from columns, sizes of fields, traces, time limits and hooks."""

import pytest
from pyspark.sql import functions as F

from treequill.errors import QueryError
from treequill.plans.session import Session
from treequill.plans.tracing import collect_within, traces
from treequill.sources import build


def _json(df, column="x"):
    return [r[0] for r in df.select(F.to_json(F.to_variant_object(column) if not dict(df.dtypes)[column].startswith("variant") else F.col(column))).collect()]


def test_objects_and_arrays_from_columns(spark):
    df = spark.range(1).select(build.new_object(kind=F.lit("ship"), decks=build.new_array(F.lit(3), F.lit(5))).alias("x"))
    assert _json(df) == ['{"decks":[3,5],"kind":"ship"}']
    assert [r["text"] for r in Session().query(df, "x", "sum(decks.*)", []).collect()] == ["8"]
    assert _json(spark.range(1).select(build.new_object().alias("x"))) == ["{}"]


@pytest.mark.parametrize(
    "a,b,both",
    [
        ('{"mast":1}', '{"sail":2,"mast":9}', '{"mast":1,"sail":2}'),
        ("[1,null]", '["b"]', '[1,null,"b"]'),
        ("{}", "{}", "{}"),
        ('{"mast":null}', '{"mast":4}', '{"mast":null}'),
    ],
)
def test_extending_variants(spark, a, b, both):
    df = spark.createDataFrame([(a, b)], "a string, b string").select(F.parse_json("a").alias("x"), F.parse_json("b").alias("y"))
    assert _json(build.extend(df, "x", "y")) == [both]


def test_extending_typed_documents_and_nulls(spark):
    df = spark.sql("SELECT named_struct('a', 1, 'b', 'q') x, named_struct('b', 'z', 'c', 2.5D) y, array(1, 2) l, CAST(NULL AS array<int>) m, parse_json('[1]') v, CAST(NULL AS variant) w")
    assert _json(build.extend(df, "x", "y")) == ['{"a":1,"b":"q","c":2.5}']
    assert _json(build.extend(df, "l", "m"), "l") == ["[1,2]"]
    assert _json(build.extend(df, "v", "w"), "v") == ["[1]"]
    with pytest.raises(QueryError):
        build.extend(df, "x", "l")
    wrong = df.withColumn("w", F.parse_json(F.lit('{"a":1}')))
    with pytest.raises(Exception, match="two objects or two arrays"):
        build.extend(wrong, "v", "w").collect()


def test_sizes_by_field(spark):
    df = spark.createDataFrame([("ab", 12), (None, 345)], "s string, n int").select(F.struct("s", "n").alias("x"))
    want = {("s", 1, 4), ("n", 2, 5)}
    assert {tuple(r) for r in build.size_statistics(df, "x").collect()} == want
    assert {tuple(r) for r in build.size_statistics(df.select(F.to_variant_object("x").alias("x")), "x").collect()} == want
    assert build.size_statistics(df.limit(0), "x").where("values > 0").count() == 0


@pytest.fixture(scope="module")
def pools(spark):
    return spark.createDataFrame([(i, [i, i + 10]) for i in range(3)], "root_id long, n array<long>").select("root_id", F.struct("n").alias("doc"))


def test_traces_of_the_whole_document(pools):
    seen = traces(Session(), pools, "doc", "trace(n.*, 4, 'items') and trace(n.*)", ["root_id"])
    assert seen.counts["items"] == (3, 6)
    assert [r["text"] for r in seen.tables["items"].collect()] == ["0", "10", "1", "11"]
    other = next(n for n in seen.counts if n != "items")
    assert seen.tables[other].count() == 6 and seen.seconds > 0


def test_traces_inside_sub_queries_and_merged(pools):
    seen = traces(Session(), pools, "doc", "n.*{trace(_, -1, 'inner') > 5}", ["root_id"])
    assert seen.counts == {"inner": (6, 6)}
    both = seen.merge(traces(Session(), pools.where("root_id = 0"), "doc", "n.*{trace(_, -1, 'inner') > 5}", ["root_id"]))
    assert both.counts == {"inner": (8, 8)} and both.tables["inner"].count() == 8
    assert traces(Session(), pools, "doc", "n.*", ["root_id"]).counts == {}
    assert traces(Session(), pools.limit(0), "doc", "trace(n.*, 1, 'none')", ["root_id"]).counts == {"none": (0, 0)}


def test_a_late_query_ends(spark):
    assert collect_within(spark.range(3), 60) == spark.range(3).collect()
    slow = spark.range(4).join(spark.range(200_000).withColumnRenamed("id", "b"), F.expr("id + b * b % 7 < -1 OR length(repeat(cast(b AS string), 20000)) < 0"))
    assert collect_within(slow, 0.5) is None


def test_hooks_see_every_node(pools):
    seen = []
    session = Session(hooks=(lambda node: seen.append(("begin", type(node).__name__)), lambda node, stream: seen.append(("end", type(node).__name__))))
    session.values(pools, "doc", "n.* > 3", ["root_id"])
    assert seen[0] == ("begin", "Binary") and seen[-1] == ("end", "Binary") and ("end", "AnyChild") in seen
    assert sum(k == "begin" for k, _ in seen) == sum(k == "end" for k, _ in seen)
