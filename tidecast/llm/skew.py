"""Joins on keys of which a few may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it has more than one in SHARE of all rows; there are fewer than SHARE of them, whatever the data.
SHARE = 1000


def attach(big: DataFrame, small: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """Inner join of ``big`` with ``small``, which has one row a key and, in ``count``, how many rows of ``big`` have it; ``total``: all rows of ``big``.

    Rows of hot keys stay where they are and meet a broadcast of at most SHARE rows; the others are shuffled, a key having at most one in
    SHARE of the rows.  Both tables are read twice, so they should be written ones.
    """
    hot = F.col(count) * SHARE > total
    few = F.broadcast(small.where(hot))
    return (big.join(few, keys).unionByName(
        big.join(F.broadcast(small.where(hot).select(*keys)), keys, "left_anti").join(small.where(~hot), keys)))
