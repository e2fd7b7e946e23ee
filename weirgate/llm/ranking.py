"""The first k rows of each group, without all rows of a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts of a group that are cut to k rows each before the parts meet.
PARTS = 64


def first_k(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, salt: Column, rank: str = "rank") -> DataFrame:
    """rows with `rank` (an int from 1) of k or less, by order within keys.

    Tasks cut their rows of a group to k before they are shuffled, then PARTS parts of each group by salt do, so the last
    window sees PARTS * k rows of a group at most.
    """
    part = rows.withColumn("rank_part", F.pmod(F.xxhash64(salt), F.lit(PARTS)))
    for by in ([*keys, "rank_part"], list(keys)):
        part = part.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(rank) <= k)
    return part.drop("rank_part")
