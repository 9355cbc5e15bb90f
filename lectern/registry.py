"""Queries by name, with the SQL that checks them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


#: Values are cut to a decimal before they are rounded, on both sides: engines sum doubles in other orders, and means of
#: few six-digit scores often lie just between two rounded values.
_DECIMAL = "decimal(38,12)"


def rounded(value: Column | str, digits: int = 6) -> Column:
    return F.round((F.col(value) if isinstance(value, str) else value).cast("double").cast(_DECIMAL), digits).cast("double")


def exact(sql: str) -> str:
    """The same for every ``round(value, digits)`` of a checking SQL."""
    out, at = [], 0
    for m in re.finditer(r"\bround\(", sql):
        if m.start() < at:  # inside another one
            continue
        depth, i = 1, m.end()
        comma = i
        while depth:
            c = sql[i]
            depth += (c == "(") - (c == ")")
            if c == "," and depth == 1:
                comma = i
            i += 1
        out += [sql[at : m.end()], "(", exact(sql[m.end() : comma]), f")::DOUBLE::{_DECIMAL}", sql[comma:i], "::DOUBLE"]
        at = i
    return "".join([*out, sql[at:]])


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")
        QUERIES[name] = f
        if sql:
            ORACLES[name] = exact(sql)
        return f

    return add
