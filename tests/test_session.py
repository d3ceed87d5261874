"""Sessions, sources, diagnostics, completion, streaming."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treequill import completion
from treequill.diagnostics import Diagnostics, diagnose
from treequill.errors import QueryError
from treequill.plans.session import Session
from treequill.sources import documents as d
from treequill.streaming import parsed

DOC = {"field": "CONSTANT_1", "n": 3, "sub": {"child": 1}, "list": [1, 2, 3]}


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "t")
    rows = [(i, json.dumps(DOC | {"n": i})) for i in range(4)]
    spark.createDataFrame(rows, "root_id long, j string").select("root_id", F.from_json("j", "field string, n long, sub struct<child: long>, list array<long>").alias("doc")).write.parquet(path)
    return spark.read.parquet(path)


def test_query_rows(docs):
    rows = Session().query(docs, "doc", "list.*{_ > 1}", ["root_id"]).orderBy("root_id", "pos").collect()
    assert [(r["root_id"], r["pos"], r["text"]) for r in rows[:3]] == [(0, 0, "2"), (0, 1, "3"), (1, 0, "2")]


def test_filter_reaches_the_scan(docs, capsys):
    kept = Session().filter(docs, "doc", "n > 1 and field == 'CONSTANT_1' and any(list.* == 2)")
    assert {r["root_id"] for r in kept.collect()} == {2, 3}
    kept.select("root_id").explain()
    plan = capsys.readouterr().out
    assert "GreaterThan(doc.n,1)" in plan and "EqualTo(doc.field,CONSTANT_1)" in plan and "sub" not in plan.split("ReadSchema")[1]


def test_errors_and_constants(spark, docs):
    assert [r["value"] for r in Session(on_error="null").values(docs, "doc", "10 / n", ["root_id"]).orderBy("root_id").collect()] == [None, 10, 5, 3]
    with pytest.raises(Exception, match="Division by zero"):
        Session().values(docs, "doc", "10 / n", ["root_id"]).collect()
    assert Session(constants={"limit": 2}).filter(docs, "doc", "n == Limit").count() == 1
    with pytest.raises(QueryError):
        Session().compile("a +")


def test_user_functions_and_operators(docs):
    from treequill.operators.values import Val

    session = Session(functions={"double": lambda low, x: low.over(x, lambda v: low.kernels.binary("+", v, v))}, operators={"plus": lambda l, r: Val("int", l.col + r.col)})
    assert [r["value"] for r in session.values(docs, "doc", "double(n) plus 1", ["root_id"]).orderBy("root_id").collect()] == [1, 3, 5, 7]


def test_diagnostics(docs):
    found = diagnose(Session(), docs, "doc", "**.nothing > 0 or field > 123")
    messages = [m.text for m in found.messages()]
    assert any("No matches for field 'nothing'" in m for m in messages)
    assert any("All values compared to false. Left hand types are string, right hand types are int." in m for m in messages)
    again = Diagnostics.from_json(found.to_json())
    assert [m.text for m in again.messages()] == messages
    assert [m.text for m in found.merge(again).messages()] == messages


_LONG, _TEXT = T.LongType(), T.StringType()
SCHEMA = T.StructType([T.StructField(n, t) for n, t in (("f", _LONG), ("fi", _LONG), ("field", _TEXT), ("other", _TEXT), ("constant", _LONG), ("__long__name__", _TEXT), ("this needs escaping", _LONG), ("sub", T.StructType([T.StructField("child", _LONG)])))])


@pytest.mark.parametrize(
    "query,point,text",
    [
        ("((oth", None, "other"), ("__", None, "__long__name__"), ("this", None, '["this needs escaping"]'), ("oth > 123", 3, "other"), ("sub.", None, "child"), ("1 > C", None, "CONSTANT_1"), ("cou", None, "count"), ("(field + oth)", 12, "other"),
        ("sub.ch > 123", 6, "child"), ("_{field + oth", None, "other"), ("CONS", None, "CONSTANT_1"), ("true and f", None, "field"), ("f or false", 1, "field"), ("A_CONST", None, "** = A_CONST"), ("field", None, "**.field"), ("count < 10", None, "**.count < 10"), ('name != "Mull"', None, '**.name != "Mull"'),
    ],
)
def test_completion(query, point, text):
    assert text in [c.text for c in completion.complete(query, SCHEMA, point, constants=["CONSTANT_1", "CONSTANT_2"])]


def test_completion_of_data(docs):
    assert completion.string_constants(docs, "doc") == ["CONSTANT_1"]
    assert len(completion.complete("", SCHEMA, options=completion.Options(limit=3))) <= 3


def test_json_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"x": 1}, {"x": {"_bytes": true, "hex": "00ff"}}]')
    one = d.read_json(spark, str(tmp_path / "a.json"))
    assert one.count() == 1
    items = d.read_json(spark, str(tmp_path / "a.json"), explode_top_level=True)
    assert [r["text"] for r in Session(max_depth=3).query(items, "doc", "typeof x", ["root_id"]).orderBy("root_id").collect()] == ["int", "bytes"]
    d.write_jsonl(items, str(tmp_path / "out"))
    assert d.read_json(spark, str(tmp_path / "out"), lines=True).count() == 2
    d.write_pool(items, str(tmp_path / "pool"))
    assert d.append(d.read_pool(spark, str(tmp_path / "pool")), one).count() == 3
    bad = spark.createDataFrame([('{"a":1}',), ('{"a":',), ('{"a":1,"a":2}',), ("18446744073709551615",)], "j string")
    assert d.validate(bad, "j").count() == 3
    assert d.decode('{"_multimap": true, "a": [1, 2]}') == [("a", 1), ("a", 2)]
    with pytest.raises(QueryError):
        d.decode('{"_bytes": true, "hex": "0"}')


def test_streaming(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text('{"v": 1}\n{"v": 2}\n{broken\n')
    stream = parsed(spark.readStream.schema("value string").text(str(tmp_path / "in")), "value")
    out = Session(max_depth=3).values(stream, "doc", "v + 1", [])
    run = out.selectExpr("cast(value as string) value").writeStream.format("memory").queryName("treequill_stream").trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert sorted(r["value"] for r in spark.table("treequill_stream").collect() if r["value"]) == ["2", "3"]
