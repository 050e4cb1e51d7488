"""Character encodings of documents."""

from __future__ import annotations

import codecs
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Byte order marks, and labels that the web reads as another encoding.
MARKS = ((b"\xef\xbb\xbf", "utf-8"), (b"\xfe\xff", "utf-16be"), (b"\xff\xfe", "utf-16le"))
AS_WINDOWS_1252 = frozenset("iso-8859-1 iso8859-1 latin1 latin-1 l1 us-ascii ascii cp1252 x-cp1252 windows-1252".split())
#: Bytes that the web's windows-1252 maps to control characters.
UTF_NAMES = {"utf-8": "utf-8", "utf-16": "utf-16le", "utf-16-le": "utf-16le", "utf-16-be": "utf-16be"}
CONTROLS = {b: chr(b) for b in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}

_LABEL = re.compile(rb"""encoding\s*=\s*["']([^"']{1,64})["']""")
codecs.register_error("feedweave-controls", lambda e: (CONTROLS.get(e.object[e.start], "�"), e.start + 1))


def normalize(label: str) -> str | None:
    """The name that stands for a label, null if it is not known."""
    low = label.strip().lower()
    if low in AS_WINDOWS_1252:
        return "windows-1252"
    try:
        codec = codecs.lookup(low)
    except LookupError:
        return None
    if codec.name.startswith("utf-32") or not getattr(codec, "_is_text_encoding", True):
        return None
    return UTF_NAMES.get(codec.name, low)


def detect(data: bytes, hint: str | None = None) -> str:
    """The encoding by byte order mark, then ``hint``, then a declaration; else UTF-8."""
    for mark, name in MARKS:
        if data.startswith(mark):
            return name
    if hint and (name := normalize(hint)):
        return name
    found = _LABEL.search(data[:512])
    return (found and normalize(found[1].decode("latin-1"))) or "utf-8"


def decode(data: bytes) -> tuple[str, str]:
    """The text of a document, and the encoding it is read in.

    Bytes that the declared encoding does not have make the whole document
    UTF-8, with replacement characters where it is not.
    """
    name = detect(data)
    for mark, _ in MARKS:
        if data.startswith(mark):
            data = data[len(mark) :]
            break
    try:
        if name == "windows-1252":
            return data.decode("cp1252", "feedweave-controls"), name
        return data.decode(name), name
    except (UnicodeDecodeError, LookupError):
        return data.decode("utf-8", "replace"), "utf-8"


@F.pandas_udf(StringType())
def detect_encoding(content: pd.Series) -> pd.Series:
    """The encoding of binary documents."""
    return pd.Series([None if c is None else detect(c) for c in content], dtype=object)


@F.pandas_udf(StringType())
def to_utf8(content: pd.Series) -> pd.Series:
    """Binary documents as text."""
    return pd.Series([None if c is None else decode(c)[0] for c in content], dtype=object)
