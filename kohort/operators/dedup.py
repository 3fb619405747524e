"""keep the first row (in file order) per key; all NULL keys collapse to one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, key: str | list[str], order: str = "row_id", where: Column | None = None) -> DataFrame:
    """First row per ``key`` by ``order``, whose values must be unique.

    The survivors are found over (key, order) alone: a hash aggregate of a minimum
    that combines map-side, so a hot key (one NULL key may hold a third of the rows)
    leaves each map task as one row. The wide rows are then semi-joined by ``order``.
    ``where`` drops wide rows before that shuffle; it does not change who is first.
    """
    keys = [key] if isinstance(key, str) else list(key)
    first = df.groupBy(*keys).agg(F.min(order).alias("_first")).select("_first")
    wide = df if where is None else df.where(where)
    return wide.join(first, F.col(order) == F.col("_first"), "left_semi")
