"""JSON read strictly."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def strict_json(text: Column, schema: T.DataType) -> Column:
    """``text`` parsed when it is exactly one JSON value, else null. It is parsed
    as the only member of a list, so that single quotes and anything after the
    value are errors instead of being read or ignored."""
    listed = F.from_json(F.concat(F.lit("["), text, F.lit("]")), T.ArrayType(schema), {"allowSingleQuotes": "false"})
    return F.when(F.size(listed) == 1, F.get(listed, F.lit(0)))
