"""Spark columns give what the evaluator gives, over typed and over dynamic documents."""

import json

import pytest
from pyspark.sql import functions as F

from treequill.evaluate import Environment, results
from treequill.kinds import to_text
from treequill.operators.values import Val
from treequill.operators.values import to_text as column_text
from treequill.parser import parse
from treequill.plans.session import Session
from treequill.sources.documents import decode

from .test_language import GARDEN, RESULTS

#: A parcel service: one table of typed documents, with nulls, empty lists and words that are not ASCII.
PARCELS = [
    {"id": 1, "to": "Zoë", "kg": 2.5, "paid": True, "stops": [{"at": "A", "km": 10}, {"at": "B", "km": 25}], "size": {"w": 3, "h": 4}},
    {"id": 2, "to": "", "kg": None, "paid": False, "stops": [], "size": None},
    {"id": -7, "to": "a/b/c", "kg": -0.5, "paid": None, "stops": [{"at": None, "km": 1}], "size": {"w": None, "h": 9}},
]
TYPE = "struct<id:bigint,to:string,kg:double,paid:boolean,stops:array<struct<at:string,km:bigint>>,size:struct<w:bigint,h:bigint>>"
#: Values of several kinds under one name.
MIXED = [{"v": 1, "w": 0.5}, {"v": "one"}, {"v": True, "w": [1, "x", {"y": 2.5}]}, {"v": None, "w": {"y": 3}}, {"v": 2.0}]

TYPED = [
    "id", "to", "stops.*.km", "sum(stops.*.km)", "stops[0].at", "stops[5]", "size.w * size.h", "size.*", "**.km", "count(**)", "to[1]", "#to", "to + '!'", "split(to + '/', '/')", "typeof kg", "kg as int", "kg as string", "id as bytes", "to as bytes", "id as bytes as string",
    "id >> 60", "id & 255", "id << 3", "~id", "id % 3", "id / 2", "-id", "id < kg", "id == 2.0", "paid or to", "paid and id", "not paid", "paid?", "stops.*{km > 5}.at", "any(stops.*.km > 20)", "each(stops.*.km > 5)", "keys(_)", "size{w}.h", "to = re'[a-c/]+'", "to != re'Z.*'",
    "range(id, 3)...", "id = range(0, 9)", "arr(id, to)", "select(stops.*.km, 0, 1)", "sum(stops.*.km, $sum + $val * $idx, id)", "stops", "size", "missing", "kg + null", "null + to", "stops.*.at == 'B'", "count(stops.*)", "to < 'b'", "to as int", "paid as int", "kg?",
]
DYNAMIC = ["*.v", "*.w", "*.v == 1", "*.v != 1", "*.v < 2", "typeof *.v", "*.w.y", "**.y", "count(**)", "any(*.v == 'one')", "*.v as string", "*.v as float", "*.v and 1", "*.w or 'none'", "*{v}.w", "*[0]", "*.w[1]", "arr(*.v, 'z')", "sum(*.w{typeof _ == 'float'})", "keys(*)"]


def expected(query, doc):
    env = Environment()
    return [to_text(x) for x in results(parse(query, env), doc, env)]


def texts(m, query):
    return m.each(lambda x: column_text(Val(m.kind, x, m.typ), query.lowering.kernels))


def columns(df, queries, session):
    out = []
    for i, text in enumerate(queries):
        query = session.compile(text)
        m = query.lowering.many(query.stream(*session._doc(df, "doc")))
        out.append(texts(m, query).alias(f"q{i}"))
    return out


def got(spark, tmp_path, documents, queries, column, at_once=6):
    """Texts by document and query, read from a written table so that nothing is folded when the plan is made."""
    path = str(tmp_path / "t")
    spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(documents)], "i int, text string").select("i", column(F.col("text")).alias("doc")).write.parquet(path)
    df, session = spark.read.parquet(path), Session(max_depth=5)
    rows = [[] for _ in documents]
    for i in range(0, len(queries), at_once):
        for r in df.select("i", *columns(df, queries[i : i + at_once], session)).collect():
            rows[r["i"]] += list(r)[1:]
    return rows


def compare(spark, tmp_path, documents, queries, column):
    found = got(spark, tmp_path, documents, queries, column)
    assert not [(q, d, f, expected(q, d)) for d, row in zip(documents, found) for q, f in zip(queries, row) if f != expected(q, d)]


def test_typed_documents(spark, tmp_path):
    compare(spark, tmp_path, PARCELS, TYPED, lambda c: F.from_json(c, TYPE))


@pytest.mark.parametrize("rules", [("paths", "children", "subscripts", "filters"), ("descent", "logic", "several values"), ("comparison", "kinds", "functions")])
def test_every_rule_of_the_language_over_a_typed_document(spark, tmp_path, rules):
    # a STRUCT has every field in every element, so only its count of keys may differ
    queries = [q for rule in rules for q, _ in RESULTS[rule] if q != "count(keys(**))"]
    text = json.dumps(GARDEN)
    compare(spark, tmp_path, [GARDEN], queries, lambda c: F.from_json(c, F.schema_of_json(F.lit(text))))


def test_mixed_kinds(spark, tmp_path):
    compare(spark, tmp_path, [MIXED], DYNAMIC, F.parse_json)


#: Of the typed queries, those that are run over variants, too: such plans take seconds to make.
ALSO_DYNAMIC = ["stops.*.km", "to[1]", "id as bytes", "id >> 60", "size.w * size.h", "paid or to", "to = re'[a-c/]+'", "split(_.to + '/', '/')", "keys(_)", "#to", "kg as string"]


def test_typed_documents_as_variants(spark, tmp_path):
    compare(spark, tmp_path, PARCELS, ALSO_DYNAMIC, F.parse_json)


def test_overflow_is_an_error_or_null(spark):
    df = spark.createDataFrame([(2**63 - 1,)], "big long").select(F.struct("big").alias("doc"))
    with pytest.raises(Exception, match="overflow|out of range|OVERFLOW"):
        Session().query(df, "doc", "big + 1", []).collect()
    assert [r["text"] for r in Session(on_error="null").query(df, "doc", "big + 1", []).collect()] == ["null"]


#: Documents whose values are counted by their schema, or are not: nulls, false, empty ones, tagged bytes, names like types.
COUNTED = ['{"a": 1, "b": "x", "c": 2.5}', '{"a": null, "b": false, "c": true}', '{"VOID": 1, "_bytes": false, "x": 1.25}', '[{"a": {"_bytes": true, "hex": "00"}}, [], {}, [null, false, [1]]]', '{"l": [{"n": 1, "s": "false"}, {"n": 2.5e300}, 7], "o": {"p": {"q": null}}}', "[]", "{}", "3", "false", "null", '"t"', '{"_bytes": true, "hex": "00ff"}']


def test_all_values_are_counted_without_making_them(spark, tmp_path):
    df = spark.createDataFrame(list(enumerate(COUNTED)), "i int, text string")
    df.select("i", F.parse_json("text").alias("doc")).write.parquet(str(tmp_path / "t"))
    out = Session(max_depth=4).values(spark.read.parquet(str(tmp_path / "t")), "doc", "count(**)", ["i"])
    assert [str(r["value"]) for r in out.orderBy("i").collect()] == [expected("count(**)", decode(t))[0] for t in COUNTED]
    assert out._jdf.queryExecution().analyzed().toString().count("struct(k,") < 20  # of the root only
    typed = df.select("i", F.struct("i", "text", F.array(F.struct(F.lit(False).alias("no"), F.lit("t").alias("t"))).alias("l")).alias("doc"))
    out = Session().values(typed, "doc", "count(**)", ["i"])
    assert {r["value"] for r in out.collect()} == {6} and "struct(k," not in out._jdf.queryExecution().analyzed().toString()


@pytest.mark.parametrize("text,match", [('{"a": [[[[1]]]]}', "deeper"), ('{"a": {"b": {"c": {"d": 1}}}}', "deeper"), ('{"a": 1, "b": 12345678901234567890}', "out of range")])
def test_counting_fails_on_what_it_can_not_count(spark, tmp_path, text, match):
    spark.createDataFrame([(text,)], "text string").select(F.parse_json("text").alias("doc")).write.parquet(str(tmp_path / "t"))
    with pytest.raises(Exception, match=match):
        Session(max_depth=3).values(spark.read.parquet(str(tmp_path / "t")), "doc", "count(**)", []).collect()


def test_a_value_on_the_way_is_made_once(spark):
    df = spark.createDataFrame([('{"a": [{"b": 2}, {"b": 3}], "c": 1}',)], "text string").select(F.parse_json("text").alias("doc"))
    out = Session(max_depth=4).values(df, "doc", "sum(a.*.(b * b))", [])
    assert [str(r["value"]) for r in out.collect()] == ["13"]
    assert out._jdf.queryExecution().analyzed().toString().count('$["a"]') == 1
