"""Documents made from columns: objects, arrays, their extension, and how much room their fields take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryError


def new_object(**fields: Column) -> Column:
    """An object with these fields; without any, an empty VARIANT object."""
    if not fields:
        return F.parse_json(F.lit("{}"))
    return F.struct(*[c.alias(name) for name, c in fields.items()])


def new_array(*items: Column) -> Column:
    """An array of items of one type; cast items of several kinds to VARIANT."""
    return F.array(*items)


def _members(c: Column) -> Column:
    return F.coalesce(F.try_variant_get(c, "$", "map<string,variant>"), F.create_map().cast("map<string,variant>"))


def _extend(a: Column, a_type: T.DataType, b: Column, b_type: T.DataType) -> Column:
    if isinstance(a_type, T.ArrayType) and isinstance(b_type, T.ArrayType):
        return F.concat(F.coalesce(a, F.array().cast(a_type)), F.coalesce(b, F.array().cast(b_type)))
    if isinstance(a_type, T.StructType) and isinstance(b_type, T.StructType):
        mine = {f.name for f in a_type.fields}
        rest = [f.name for f in b_type.fields if f.name not in mine]
        return F.struct(*[a.getField(f.name).alias(f.name) for f in a_type.fields], *[b.getField(n).alias(n) for n in rest])
    if isinstance(a_type, T.VariantType) and isinstance(b_type, T.VariantType):
        items = F.try_variant_get(a, "$", "array<variant>")
        more = F.try_variant_get(b, "$", "array<variant>")
        have = _members(a)
        new = F.map_filter(_members(b), lambda k, _: ~F.map_contains_key(have, k))
        objects = F.schema_of_variant(a).startswith("OBJECT") & F.schema_of_variant(b).startswith("OBJECT")
        arrays = items.isNotNull() & more.isNotNull()
        wrong = F.raise_error(F.lit("extend: two objects or two arrays are wanted")).cast("variant")
        return (
            F.when(a.isNull(), b).when(b.isNull(), a)
            .when(arrays, F.to_variant_object(F.concat(items, more)))
            .when(objects, F.to_variant_object(F.map_concat(have, new)))
            .otherwise(wrong)
        )
    raise QueryError("TypeMismatch", f"extend: {a_type.simpleString()} with {b_type.simpleString()}")


def extend(df: DataFrame, doc: str, other: str) -> DataFrame:
    """df with the members of ``other`` after those of ``doc``, both columns of one kind.

    A field that both have keeps the value in ``doc``, the one that a lookup by name finds.  A null adds nothing.
    """
    kind = {f.name: f.dataType for f in df.select(doc, other).schema.fields}
    return df.withColumn(doc, _extend(F.col(doc), kind[doc], F.col(other), kind[other]))


def size_statistics(df: DataFrame, doc: str) -> DataFrame:
    """(field, values, bytes) of the top-level fields of all documents: how many are not null, and their JSON's bytes."""
    type_ = df.select(doc).schema[0].dataType
    if isinstance(type_, T.StructType):
        names = [f.name for f in type_.fields]
        # one pass, a partial sum for each field and task
        text = lambda n: F.to_json(F.struct(F.col(doc).getField(n).alias("x")))
        present = lambda n: F.col(doc).getField(n).isNotNull()
        each = [F.struct(F.lit(n).alias("field"), F.count(F.when(present(n), 1)).alias("values"), F.coalesce(F.sum(F.when(present(n), F.octet_length(text(n)) - len('{"x":}'))), F.lit(0)).alias("bytes")) for n in names]
        if not each:
            return df.sparkSession.createDataFrame([], "field string, values long, bytes long")
        return df.agg(F.array(*each).alias("all")).select(F.inline("all"))
    members = df.select(F.explode(F.try_variant_get(doc, "$", "map<string,variant>")).alias("field", "value"))
    known = members.where(~F.is_variant_null("value"))
    return known.groupBy("field").agg(F.count("*").alias("values"), F.sum(F.octet_length(F.to_json("value")).cast("long")).alias("bytes"))
