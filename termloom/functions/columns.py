"""Helpers for column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once: without this every mention of value in a long chain would be expanded anew."""
    return F.element_at(F.transform(F.array(value), body), 1)


def json_merge(left: Column, right: Column) -> Column:
    """Two JSON objects of one level as one, text values; a key of both has right's value. Null is an empty object."""
    pairs = lambda c: F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>"))
    return F.to_json(F.map_zip_with(pairs(left), pairs(right), lambda k, x, y: F.coalesce(y, x)))
