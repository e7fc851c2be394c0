"""Row helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def settle(df: DataFrame, *names: str) -> DataFrame:
    """Evaluate columns here, once.

    A later filter or join key on a column would otherwise be pushed down with its whole
    definition; for a long chain of definitions, each naming the one before several times,
    that grows without bound. A generator of one row is a barrier to that and stays narrow.
    """
    kept = [c for c in df.columns if c not in names]
    return df.select(*kept, F.inline(F.array(F.struct(*names))))
