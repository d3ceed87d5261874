"""Queries over streams of documents.  Every query works row by row, so none needs state or watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.session import Session


def parsed(stream: DataFrame, text: str, *keys: str) -> DataFrame:
    """A stream of JSON texts as documents; malformed texts are null documents."""
    return stream.select(*keys, F.try_parse_json(text).alias("doc"))


def query(session: Session, stream: DataFrame, doc: str, text: str, keys: list[str]) -> DataFrame:
    return session.query(stream, doc, text, keys)


def matching(session: Session, stream: DataFrame, doc: str, text: str) -> DataFrame:
    return session.filter(stream, doc, text)
