"""The format of documents, without parsing them whole."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from feedweave.sources.lexer import version_of


@F.pandas_udf(StringType())
def detect_format(content: pd.Series) -> pd.Series:
    """The version of a binary document, the empty text if it is no known feed."""
    return pd.Series([None if c is None else version_of(c) for c in content], dtype=object)
