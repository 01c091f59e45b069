"""The query surface: MATCH (n) WHERE n.key OP value [RETURN ...], and single conditions, as Columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import Graph

#: What a number may begin with: the rest of the text is ignored. Fixed value: the grammar of decimal numbers.
NUMBER = r"^[ \t\n\x0B\f\r]*([+-]?(?:[0-9]+\.?[0-9]*(?:[eE][+-]?[0-9]+)?|\.[0-9]+(?:[eE][+-]?[0-9]+)?|[iI][nN][fF](?:[iI][nN][iI][tT][yY])?|[nN][aA][nN]))"


class QuerySyntaxError(ValueError):
    pass


def number(text: Column) -> Column:
    """The number that the text begins with, null if it begins with none."""
    found = F.lower(F.regexp_extract(text, NUMBER, 1))
    return F.when(F.regexp_like(found, F.lit("^[+-]?[0-9.]")), found.try_cast("double")).when(found.startswith("-i"), F.lit(float("-inf"))).when(found.contains("inf"), F.lit(float("inf"))).when(found.contains("nan"), F.lit(float("nan")))


def parse_number(text: str) -> float | None:
    m = re.match(NUMBER, text)
    return float(m[1]) if m else None


def compile_predicate(condition: str, op: str, value: str, missing_as_empty: bool = True) -> Column:
    """The condition as a Column over `properties`: = and == compare texts, > and < the numbers they begin with.

    The key is what follows the first dot, or all of it. Without a number on either side > and < are false, and so is
    a comparison with NaN. missing_as_empty lets a missing property equal the empty text.
    """
    key = condition.partition(".")[2] if "." in condition else condition
    p = F.coalesce(F.try_element_at("properties", F.lit(key)), F.lit(""))
    if op in ("=", "=="):
        return p == value if missing_as_empty else (p != "") & (p == value)
    if op not in (">", "<"):
        raise QuerySyntaxError(f"unknown operator {op!r}")
    limit = parse_number(value)
    if limit is None or limit != limit:
        return F.lit(False)
    n = number(p)
    # Spark orders NaN above all numbers.
    return F.coalesce(~F.isnan(n) & (n > limit if op == ">" else n < limit), F.lit(False))


def match(graph: Graph, query: str, strict: bool = True) -> DataFrame:
    """(id) of the vertices that the query names. Words are separated by white space; what follows the value is ignored.

    A query of another form raises QuerySyntaxError, or matches nothing if not strict; so does an unknown operator.
    """
    vertices = graph.vertices if "properties" in graph.vertices.columns else graph.vertices.withColumn("properties", F.lit(None).cast("map<string,string>"))
    words = query.split()
    try:
        if len(words) < 6 or words[0] != "MATCH" or words[2] != "WHERE":
            raise QuerySyntaxError("expected MATCH (n) WHERE n.key OP value")
        if "." not in words[3]:
            raise QuerySyntaxError("expected n.key")
        return vertices.where(compile_predicate(words[3], words[4], words[5], missing_as_empty=False)).select("id")
    except QuerySyntaxError:
        if strict:
            raise
        return vertices.where(F.lit(False)).select("id")


execute_cypher = match
