"""HTML entity decoding as an Arrow-batched pandas UDF.

Numeric entities ``&#NN;`` and named entities become characters; ``&amp;``
always becomes `` and `` (D2 fixed).  Python's entity table is the only
reason for Python here; the UDF is vectorised over Arrow batches.
"""

from __future__ import annotations

import html.entities
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_DIGIT = re.compile(r"&#(\d+);")
_NAMED = re.compile(r"&(\w+);")


def _decode_one(s: str | None) -> str | None:
    if s is None:
        return None

    def numbered(m):
        cp = int(m.group(1)) if len(m.group(1)) < 8 else -1
        return chr(cp) if 0 <= cp < 0xD800 or 0xDFFF < cp < 0x110000 else m.group(0)  # surrogates are no characters
    s = _DIGIT.sub(numbered, s)

    def named(m):
        name = m.group(1)
        if name == "amp":
            return " and "
        cp = html.entities.name2codepoint.get(name)
        return chr(cp) if cp is not None else m.group(0)
    return _NAMED.sub(named, s)


@F.pandas_udf(StringType())
def _decode(s: pd.Series) -> pd.Series:
    return s.map(_decode_one)


def decode_entities(c) -> Column:
    """Decode HTML entities of a string column (pandas UDF, Arrow batches)."""
    return _decode(F.col(c) if isinstance(c, str) else c)
