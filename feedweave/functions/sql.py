"""Column expressions as functions of SQL: what is a rule in Python is one there too, without Python."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession

#: Text in quotes, or an operator written like a function; Spark knows these by their quoted names.
_OPERATOR = re.compile(r"'(?:[^'\\]|\\.)*'|`[^`]*`|(?<![\w`])(<=>|[<>!=]=|[-+*/%&|^~!<>=]|and|or|not|in)(?=\()", re.S | re.I)


def sql_of(column: Column) -> str:
    """The text of a column that only functions and names make up."""
    return _OPERATOR.sub(lambda m: f"`{m[1]}`" if m[1] else m[0], column._jc.toString())


def create_function(spark: SparkSession, name: str, parameters: str, body: Column, returns: str) -> None:
    """A temporary function whose parameters the body has as columns."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {returns} RETURN {sql_of(body)}")


def create_table_function(spark: SparkSession, name: str, parameters: str, columns: list[tuple[str, str]], body: str) -> None:
    """A temporary table function of a query over its parameters."""
    shape = ", ".join(f"`{n}` {kind}" for n, kind in columns)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE ({shape}) RETURN {body}")
