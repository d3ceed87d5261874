"""The queries over the test tables, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.values import Val, literal
from ..sources import documents as d
from ..sources.build import extend, new_object, size_statistics
from .session import Session

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_LINES = "SELECT l_orderkey AS root_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice) - 1 AS BIGINT) AS place, * FROM lineitem"


def _rounded(df: DataFrame, digits: int | None, as_: str | None) -> DataFrame:
    value = F.col("value")
    if as_ is not None:
        value = F.variant_get(value, "$", as_) if dict(df.dtypes)["value"] == "variant" else value.cast(as_)
    if digits is not None:
        value = F.round(value, digits)
    return df.select(F.col("root_id").cast("bigint").alias("root_id"), F.col("pos").cast("bigint").alias("pos"), value.alias("value"))


def _add(name: str, docs: Callable, query: str, sql: str, digits: int | None = None, as_: str | None = None, view: Callable | None = None, **options) -> None:
    """Registers a query of one value or more for each document, typed, and its SQL (root_id, pos, value).

    options are those of the session.
    """

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        source = docs(spark, sf_dir)
        session = Session(**({"max_depth": 4} if view else {}), **options)  # these documents are three levels deep
        return _rounded(session.values(view(source) if view else source, "doc", query, ["root_id"]), digits, as_)

    QUERIES[name], ORACLES[name] = run, sql


def _order(name: str, query: str, value: str, **kw) -> None:
    _add(name, d.order_heads, query, f"SELECT o_orderkey AS root_id, CAST(0 AS BIGINT) AS pos, {value} AS value FROM orders", **kw)


def _lines(name: str, query: str, value: str, where: str = "TRUE", **kw) -> None:
    at = "place" if where == "TRUE" else "CAST(row_number() OVER (PARTITION BY root_id ORDER BY place) - 1 AS BIGINT)"
    sql = f"WITH l AS ({_LINES}), found AS (SELECT root_id, {at} AS pos, {value} AS value FROM l WHERE {where}) SELECT root_id, pos, value FROM found"
    if where != "TRUE":  # a document without values gives one null
        sql += f" UNION ALL SELECT DISTINCT l_orderkey, CAST(0 AS BIGINT), NULL FROM lineitem WHERE l_orderkey NOT IN (SELECT root_id FROM l WHERE {where})"
    _add(name, d.orders, query, sql, **kw)


def _fold(name: str, query: str, value: str, **kw) -> None:
    _add(name, d.orders, query, f"WITH l AS ({_LINES}) SELECT root_id, CAST(0 AS BIGINT) AS pos, {value} AS value FROM l GROUP BY root_id", **kw)


# navigation
_order("p1_field", "priority", "o_orderpriority")
_order("p1_missing_field", "nothing as string", "'null'")
_order("p2_self", "_.status", "o_orderstatus")
_add("p3_path_nested", d.events, "props.k", "SELECT event_id AS root_id, CAST(0 AS BIGINT) AS pos, CAST(json_extract(props, '$.k') AS BIGINT) AS value FROM events", as_="bigint")
_lines("p4_any_child", "line.*.qty", "l_quantity")
_add("p5_wildcard_count", d.orders, "count(**)", "SELECT l_orderkey AS root_id, CAST(0 AS BIGINT) AS pos, 7 + 8 * count(*) AS value FROM lineitem GROUP BY l_orderkey")
_add("p5_wildcard_count_dynamic", d.orders, "count(**)", "SELECT l_orderkey AS root_id, CAST(0 AS BIGINT) AS pos, 7 + 8 * count(*) AS value FROM lineitem GROUP BY l_orderkey", view=d.dynamic)
_add(
    "p5_wildcard_field", d.regions, "**.bal",
    "SELECT CAST(n_regionkey AS BIGINT) AS root_id, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name, c_custkey) - 1 AS BIGINT) AS pos, c_acctbal AS value FROM customer JOIN nation ON c_nationkey = n_nationkey",
)
_add("p6_subscript", d.vectors, "embedding[0]", "SELECT vec_id AS root_id, CAST(0 AS BIGINT) AS pos, round(CAST(embedding[1] AS DOUBLE), 6) AS value FROM embeddings", digits=6)
_lines("p6_subscript_many", "line[arr(0,1)].qty", "l_quantity", "place < 2")
_order("p7_prefix_subscript", "['priority']", "o_orderpriority")
_order("p8_string_index", "status[0]", "substr(o_orderstatus, 1, 1)")
_add("p9_range_unpack", d.regions, "range(1,5)...", "SELECT CAST(r_regionkey AS BIGINT) AS root_id, CAST(i - 1 AS BIGINT) AS pos, CAST(i AS BIGINT) AS value FROM (SELECT r_regionkey, unnest(range(1, 6)) AS i FROM region)")
_order("p10_symbol", "status == F", "o_orderstatus = 'F'")
_order("p13_constant_stream", "count(arr(1, 2, null))", "CAST(2 AS BIGINT)")
_order("p14_group", "(orderkey + custkey) * 2", "(o_orderkey + o_custkey) * 2")

# predicates
_lines("f1_subquery", "line.*{qty > 45}.partkey", "l_partkey", "l_quantity > 45")
_add("f1_duplicates", d.orders, "count(line{*.qty > 45})", "SELECT l_orderkey AS root_id, CAST(0 AS BIGINT) AS pos, count(*) FILTER (l_quantity > 45) AS value FROM lineitem GROUP BY l_orderkey")
_fold("f2_prefix_subquery", "count(line.*.{qty > 45})", "count(*) FILTER (l_quantity > 45)")
_fold("f3_any", "any(line.*.qty > 49)", "bool_or(l_quantity > 49)")
_fold("f4_each", "each(line.*.disc < 0.1)", "bool_and(l_discount < 0.1)")
_order("f5_and_value", "(status == 'F' and total) as string", "CASE WHEN o_orderstatus = 'F' THEN printf('%.6f', o_totalprice) ELSE 'false' END")
_order("f6_or_value", "missing or priority", "o_orderpriority")

# comparison
_order("c1_equal_mixed", "total == 'x'", "FALSE")
_order("c2_unequal_mixed", "total != 'x'", "TRUE")
_order("c3_less", "total < 1000.0", "o_totalprice < 1000.0")
_order("c4_at_most", "total <= 1000", "o_totalprice <= 1000")
_order("c5_greater", "total >= 1000", "o_totalprice >= 1000")
_add("c6_irange", d.events, "props.k = range(10,20)", "SELECT event_id AS root_id, CAST(0 AS BIGINT) AS pos, coalesce(CAST(json_extract(props, '$.k') AS BIGINT) BETWEEN 10 AND 20, FALSE) AS value FROM events")
_order("c7_regex", "(priority = re'[12]-.*') as string", "CASE WHEN regexp_full_match(o_orderpriority, '[12]-.*') THEN o_orderpriority ELSE 'false' END")

# arithmetic
_lines("m1_add", "line.*.(qty + n)", "l_quantity + l_linenumber")
_lines("m2_subtract", "line.*.(partkey - n)", "CAST(l_partkey - l_linenumber AS BIGINT)")
_lines("m3_multiply", "line.*.(price * (1 - disc))", "round(l_extendedprice * (1 - l_discount), 4)", digits=4)
_order("m4_divide", "orderkey / 7", "o_orderkey // 7")
_order("m5_remainder", "orderkey % 7", "o_orderkey % 7")
_order("m6_negate", "-orderkey", "-o_orderkey")
_order("m7_invert", "~orderkey", "-o_orderkey - 1")
_order("m8_bits", "(orderkey & 255) | 256", "(o_orderkey & 255) | 256")
_order("m9_shift_left", "orderkey << 3", "o_orderkey * 8")
_order("m10_shift_right", "orderkey >> 3", "o_orderkey >> 3")

# strings, types, casts
_order("t1_concat", "status + '-' + priority", "o_orderstatus || '-' || o_orderpriority")
_order("t2_concat_model", "typeof (status + _)", "'null'")
_order("t3_length", "#priority", "CAST(strlen(o_orderpriority) AS BIGINT)")
_fold("t3_length_of_array", "#line", "count(*)")
_order("t4_typeof", "typeof total + typeof status + typeof orderkey + typeof _ + typeof missing", "'floatstringintmodelnull'")
_order("t5_bool", "total?", "TRUE")
_order("t6_int", "total as int", "CAST(trunc(o_totalprice) AS BIGINT)")
_order("t7_float", "orderkey as float", "CAST(o_orderkey AS DOUBLE)")
_order("t8_string", "(orderkey as string) + '/' + (total as string)", "CAST(o_orderkey AS VARCHAR) || '/' || printf('%.6f', o_totalprice)")
_order("t9_bytes", "(orderkey as bytes) == orderkey", "TRUE")
_order("t10_null", "typeof (total as null)", "'null'")
_order("t11_not", "not (total > 100000)", "NOT (o_totalprice > 100000)")

# functions
_fold("a1_count", "count(line.*{flag=='R'})", "count(*) FILTER (l_returnflag = 'R')")
_fold("a2_sum", "sum(line.*.qty)", "round(sum(l_quantity), 4)", digits=4)
_fold("a2_sum_init", "sum(line.*.qty, $sum + $val, 100)", "round(sum(l_quantity) + 100, 4)", digits=4)
_fold("a2_idx", "sum(line.*, $sum + $idx)", "CAST(sum(place) AS BIGINT)")
_add("a3_arr", d.order_heads, "arr(custkey, orderkey)", "SELECT o_orderkey AS root_id, CAST(0 AS BIGINT) AS pos, o_custkey AS value FROM orders UNION ALL SELECT o_orderkey, 1, o_orderkey FROM orders")
_lines("a4_select", "select(line.*.qty, 0, 2)", "l_quantity", "place < 2")
_add("a5_split", d.order_heads, "split(priority, '-')", "SELECT root_id, CAST(i - 1 AS BIGINT) AS pos, parts[i] AS value FROM (SELECT o_orderkey AS root_id, string_split(o_orderpriority, '-') AS parts, unnest(range(1, len(string_split(o_orderpriority, '-')) + 1)) AS i FROM orders)")
_add("a6_keys", d.order_heads, "keys(_)", "SELECT o_orderkey AS root_id, CAST(pos AS BIGINT) AS pos, value FROM orders, (VALUES (0, 'custkey'), (1, 'orderkey'), (2, 'priority'), (3, 'status'), (4, 'total')) AS v(pos, value)")
_order("a7_range", "range(1, 9) as string", "'1..9'")
_order("a8_re", "(status = re('[FO]')) as string", "CASE WHEN o_orderstatus IN ('F', 'O') THEN o_orderstatus ELSE 'false' END")
_order("a9_trace", "trace(total)", "o_totalprice")
_add("u2_product", d.regions, "arr(1,2,3) == arr(1,2,3)", "SELECT CAST(r_regionkey AS BIGINT) AS root_id, CAST(3 * (a - 1) + b - 1 AS BIGINT) AS pos, a = b AS value FROM region, (VALUES (1), (2), (3)) AS x(a), (VALUES (1), (2), (3)) AS y(b)")
_add("primes", d.regions, "count(range(1,1000)...{count((_ % range(1,_)...) == 0) == 2})", "SELECT CAST(r_regionkey AS BIGINT) AS root_id, CAST(0 AS BIGINT) AS pos, CAST(168 AS BIGINT) AS value FROM region")
_fold("flagship_order_value", "sum(line.*.(price * qty))", "round(sum(l_extendedprice * l_quantity), 2)", digits=2)
_fold("flagship_order_value_dynamic", "sum(line.*.(price * qty))", "round(sum(l_extendedprice * l_quantity), 2)", digits=2, as_="double", view=d.dynamic)

# streams, constants and literals
_add("u1_order", d.orders, "arr(line.*.partkey, line.*.n)", f"WITH l AS ({_LINES}), k AS (SELECT l_orderkey AS key, count(*) AS n FROM lineitem GROUP BY l_orderkey) SELECT root_id, place AS pos, CAST(l_partkey AS BIGINT) AS value FROM l UNION ALL SELECT root_id, place + n, CAST(l_linenumber AS BIGINT) FROM l JOIN k ON root_id = key")
_order("u4_truthiness", "count(arr(total > 100000, custkey == 1, orderkey, 0, '', 0.0, null))", "CAST(4 AS BIGINT) + (o_totalprice > 100000)::INT + (o_custkey = 1)::INT")
_fold("u3_null_if_empty", "count(arr(line.*{qty > 49}.n as string))", "greatest(count(*) FILTER (l_quantity > 49), 1)")
_fold("u5_cardinality", "count(total, line.*, line.*{qty > 25}.n)", "1 + count(*) + count(*) FILTER (l_quantity > 25)")
_order("p11_constant", "total > Limit", "o_totalprice > 100000.0", constants={"limit": 100000.0})
_order("p12_literals", "(1 as string) + (2.5 as string) + 'x' + (true as string) + status + (0x1f as string)", "'12.500000xtrue' || o_orderstatus || '31'")
_order("p13_constants_with_values", "sum(arr(1, 2, custkey))", "3 + o_custkey")
_lines("p14_group_in_path", "line.*.(qty * n)", "l_quantity * l_linenumber")
_order("p8_string_index_utf8", "('é' + status)[2]", "o_orderstatus")

# comparisons, arithmetic, casts of values that differ by document
_order("c1_equal_kinds", "count(arr(orderkey == custkey, orderkey == total, status == 'F', status == custkey))", "CAST((o_orderkey = o_custkey)::INT + (o_orderkey = o_totalprice)::INT + (o_orderstatus = 'F')::INT AS BIGINT)")
_order("c2_unequal", "orderkey % 7 != custkey % 7", "o_orderkey % 7 <> o_custkey % 7")
_order("c3_less_text", "status < 'O'", "o_orderstatus < 'O'")
_order("c3_less_bytes", "(status as bytes) < b'O'", "o_orderstatus < 'O'")
_order("m4_divide_negative", "(-orderkey) / 7", "-(o_orderkey // 7)")
_order("m5_remainder_negative", "(-orderkey) % 7", "-(o_orderkey % 7)")
_order("m10_shift_right_negative", "(-1 - orderkey) >> 1", "CAST(9223372036854775807 - o_orderkey // 2 AS BIGINT)")
_order("t2_concat_model_and_text", "((status + _) as string) + status", "'null' || o_orderstatus")
_order("t5_bool_of_values", "(total > 100000)?", "o_totalprice > 100000")
_order("t6_int_of_text", "priority as int", "CAST(substr(o_orderpriority, 1, 1) AS BIGINT)")
_order("t7_float_of_text", "priority as float", "CAST(substr(o_orderpriority, 1, 1) AS DOUBLE)")
_order("t9_bytes_of_text", "(status as bytes) as string", "o_orderstatus")
_order("t10_null_and_text", "((total as null) as string) + status", "'null' || o_orderstatus")
_order("t12_big_endian", "((status + '0') as bytes) as int", "CAST(ascii(o_orderstatus) * 256 + 48 AS BIGINT)")
_fold("t14_word_operator", "total beyond 100000.0", "any_value(l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 100000.0))", operators={"beyond": lambda l, r: Val("bool", l.col > r.col)})
_order("x1_user_function", "half(orderkey)", "o_orderkey // 2", functions={"half": lambda low, x: low.over(x, lambda v: low.kernels.binary("/", v, literal(2)))})
_order("a7_range_of_values", "range(1, custkey) as string", "'1..' || o_custkey")
_fold("a10_all", "all(line.*.disc < 0.1)", "bool_and(l_discount < 0.1)")
_fold("g1_nothing_is_null", "select(line.*.n, 3)", "max(l_linenumber) FILTER (place = 3)", on_error="null")
_order("g1_keys_of_scalar_is_null", "typeof keys(total) + status", "'null' || o_orderstatus", on_error="null")


def any_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = Session().filter(d.orders(spark, sf_dir), "doc", "total > 100000.0 and any(line.*.flag == 'R')")
    return kept.select("root_id")


def auto_wildcard(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = Session().compile("'BUILDING'", any=True, auto_wildcard=True)
    return d.regions(spark, sf_dir).select("root_id", Session().scalar(d.regions(spark, sf_dir), "doc", q).alias("value"))


QUERIES["f7_any_filter"] = any_filter
ORACLES["f7_any_filter"] = "SELECT o_orderkey AS root_id FROM orders WHERE o_totalprice > 100000.0 AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')"
QUERIES["f8_auto_wildcard"] = auto_wildcard
ORACLES["f8_auto_wildcard"] = "SELECT CAST(n_regionkey AS BIGINT) AS root_id, bool_or(c_mktsegment = 'BUILDING') AS value FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_regionkey"


def _order_text(query: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Session().query(d.order_heads(spark, sf_dir), "doc", query, ["root_id"]).select("root_id", "text")

    return run


def extended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects built from columns, one extended by the other; a field of both keeps its first value."""
    docs = d.order_heads(spark, sf_dir)
    both = docs.select("root_id", new_object(key=F.col("doc.orderkey"), at=F.col("doc.status")).alias("doc"), new_object(at=F.lit("x"), by=F.col("doc.custkey")).alias("more"))
    return Session().values(extend(both, "doc", "more"), "doc", "at + '/' + (by as string)", ["root_id"]).select("root_id", "value")


def event_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.events(spark, sf_dir).select("root_id", d.encoded(F.col("doc.props")).alias("text"))


def field_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return size_statistics(d.order_heads(spark, sf_dir), "doc").where("field IN ('orderkey', 'custkey', 'status', 'priority')")


QUERIES["t13_bytes_text"] = _order_text("(status + '\\n') as bytes")
ORACLES["t13_bytes_text"] = "SELECT o_orderkey AS root_id, 'b\"' || o_orderstatus || '\\n\"' AS text FROM orders"
QUERIES["t13_bytes_text_hex"] = _order_text("((orderkey & 15) | 16) as bytes")
ORACLES["t13_bytes_text_hex"] = "SELECT o_orderkey AS root_id, 'b\"' || repeat('\\x00', 7) || printf('\\x%02X', (o_orderkey & 15) | 16) || '\"' AS text FROM orders"
QUERIES["io13_text"] = _order_text("total")
ORACLES["io13_text"] = "SELECT o_orderkey AS root_id, printf('%.6f', o_totalprice) AS text FROM orders"
QUERIES["io4_json"] = event_texts
ORACLES["io4_json"] = "SELECT event_id AS root_id, CAST(json(props) AS VARCHAR) AS text FROM events"
QUERIES["io7_io8_extend"] = extended
ORACLES["io7_io8_extend"] = "SELECT o_orderkey AS root_id, o_orderstatus || '/' || o_custkey AS value FROM orders"
QUERIES["io11_sizes"] = field_sizes
ORACLES["io11_sizes"] = "SELECT field, count(*) AS \"values\", CAST(sum(strlen(t)) AS BIGINT) AS bytes FROM (SELECT unnest(['orderkey', 'custkey', 'status', 'priority']) AS field, unnest([CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR), '\"' || o_orderstatus || '\"', '\"' || o_orderpriority || '\"']) AS t FROM orders) GROUP BY field"
