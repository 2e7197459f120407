"""Keep an operator's own columns apart from whatever columns its input has."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pick(docs: DataFrame, *names: str, types: dict[str, str] | None = None) -> DataFrame:
    """Only the named columns, cast where asked; a missing one is null.

    Input tables may carry extra columns of any name; operators work on this
    projection, so nothing can clash.
    """
    types = {"doc_id": "bigint", "text": "string"} | (types or {})
    have = {f.lower() for f in docs.columns}
    return docs.select(*[
        (F.col(f"`{n}`") if n.lower() in have else F.lit(None)).cast(types.get(n, "string")).alias(n) for n in names
    ])
