"""The functions under their names in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from feedweave.functions import dates, html, urls, values
from feedweave.functions.sql import create_function
from feedweave.sources import encoding, formats

#: Functions that run in Python.
FUNCTIONS = {
    "sanitize_html": html.sanitize_html,
    "strip_tags": html.strip_tags,
    "decode_entities": html.decode_entities,
    "detect_encoding": encoding.detect_encoding,
    "to_utf8": encoding.to_utf8,
    "detect_format": formats.detect_format,
}
#: Functions that are expressions: parameters, result and the rule.
EXPRESSIONS: dict[str, tuple[str, str, Callable[..., Column]]] = {
    "parse_date": ("value STRING", "TIMESTAMP", dates.parse_date),
    "parse_person": ("value STRING", values.PERSON, values.parse_person),
    "flat_person": (f"person {values.PERSON}", "STRING", values.flat_person),
    "parse_explicit": ("value STRING", "BOOLEAN", values.parse_explicit),
    "text_type": ("kind STRING", "STRING", values.text_type),
    "mime_type": ("kind STRING", "STRING", values.mime_type),
    "format_duration": ("seconds BIGINT", "STRING", values.format_duration),
    "is_valid_version": ("version STRING", "BOOLEAN", values.is_valid_version),
    "normalize_version": ("version STRING", "STRING", values.normalize_version),
    "update_period": ("value STRING", "STRING", values.update_period),
    "namespace_prefix": ("uri STRING", "STRING", values.namespace_prefix),
    "namespace_uri": ("prefix STRING", "STRING", values.namespace_uri),
    "truncate_text": ("value STRING, most INT", "STRING", values.truncate),
    "content_type_charset": ("header STRING", "STRING", values.content_type_charset),
    "resolve_url": ("href STRING, base STRING", "STRING", urls.resolve_url),
    "resolve_safe": ("href STRING, base STRING", "STRING", urls.resolve_safe),
    "is_safe_url": ("url STRING", "BOOLEAN", urls.is_safe_url),
}


def register(spark: SparkSession) -> list[str]:
    """Make the functions usable in SQL; returns their names.

    Most are functions of SQL itself, whose bodies become part of a query's plan.
    """
    for name, function in FUNCTIONS.items():
        spark.udf.register(name, function)
    for name, (parameters, returns, rule) in EXPRESSIONS.items():
        # a struct's fields have no commas before a space
        arguments = [F.col(p.split(" ", 1)[0]) for p in parameters.split(", ")]
        create_function(spark, name, parameters, rule(*arguments), returns)
    return [*FUNCTIONS, *EXPRESSIONS]
