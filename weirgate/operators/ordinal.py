"""Global order without a single-task window: dense ordinals and running values over range partitions."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirgate.materialize import written


def with_before(rows: DataFrame, before: list[tuple[int, int]], out: str) -> DataFrame:
    """Adds `out` by the row's `part`: a small table of one row per partition, so it may be broadcast."""
    table = rows.sparkSession.createDataFrame(before, f"part int, {out} long")
    return rows.join(F.broadcast(table), "part")


def ranged(df: DataFrame, order: Sequence[Column], name: str = "ordinal") -> DataFrame:
    """df as a table with `part` and `place`: the number of a row's range partition and its place in it, from 0."""
    sorted_rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    fixed = written(sorted_rows, name)
    part = F.shiftright("_id", 33).cast("int")
    return fixed.withColumn("part", part).withColumn("place", F.col("_id") - F.shiftleft(part.cast("long"), 33)).drop("_id")


@dataclass(frozen=True)
class Staged:
    """A table in one order, of which ranges of places are read from their own files."""

    rows: DataFrame
    #: The place of each partition's first row, and its number.
    firsts: list[int]
    parts: list[int]
    count: int

    def _id(self, at: int) -> int:
        i = bisect_right(self.firsts, at) - 1
        return (self.parts[i] << 33) + at - self.firsts[i]

    def between(self, a: int, b: int) -> DataFrame:
        """Rows from place a up to, and without, place b. The predicate is on a column whose files hold ranges of it, so Parquet skips the others."""
        a, b = max(a, 0), min(b, self.count)
        if a >= b:
            return self.rows.drop("_id").limit(0)
        return self.rows.filter(F.col("_id").between(self._id(a), self._id(b - 1))).drop("_id")

    def placed(self, a: int, b: int) -> DataFrame:
        """The same, not empty, with `nth`: the row's place, counted from a."""
        a, b = max(a, 0), min(b, self.count)
        here = range(bisect_right(self.firsts, a) - 1, bisect_right(self.firsts, b - 1))
        part = F.shiftright("_id", 33).cast("int")
        first = F.element_at(F.create_map(*[F.lit(x) for i in here for x in (self.parts[i], self.firsts[i] - a)]), part)
        rows = self.rows.filter(F.col("_id").between(self._id(a), self._id(b - 1)))
        return rows.withColumn("nth", first.cast("long") + F.col("_id") - F.shiftleft(part.cast("long"), 33)).drop("_id")


def staged(df: DataFrame, order: Sequence[Column], most: int, name: str = "staged") -> Staged:
    """df in range partitions sorted by `order`, in files of at most `most` rows. Ranges are sampled first, so a plan that must be read once is to be written before."""
    rows = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()), name, most=most)
    found = sorted((r["part"], r["n"]) for r in rows.groupBy(F.shiftright("_id", 33).cast("int").alias("part")).agg(F.count("*").alias("n")).collect())
    firsts, at = [], 0
    for _, n in found:
        firsts.append(at)
        at += n
    return Staged(rows, firsts, [p for p, _ in found], at)


def with_ordinal(df: DataFrame, order: Sequence[Column], out: str = "sequence_order", start: int = 0, keep: bool = False) -> DataFrame:
    """Adds start, start + 1, ... in the order given; with keep, also `part`, as running() needs it.

    Rows go to range partitions, sorted within; the table is written once, as sampled ranges differ from run to
    run. A partition's first ordinal is the number of rows before it: one count per partition on the driver.
    """
    fixed = ranged(df, order)
    before, at = [], start
    for r in sorted(fixed.groupBy("part").agg(F.count("*").alias("n")).collect(), key=lambda r: r["part"]):
        before.append((r["part"], at))
        at += r["n"]
    numbered = with_before(fixed, before, "_before").withColumn(out, (F.col("_before") + F.col("place")).cast("long"))
    return numbered.drop("_before", "place", *([] if keep else ["part"]))


def lagged(rows: DataFrame, value: str, order: str, out: str) -> DataFrame:
    """Adds the value of the row before, null on the first; rows have `part`. The last value of each partition goes to the driver."""
    last = sorted((r["part"], r["v"]) for r in rows.groupBy("part").agg(F.max_by(value, order).alias("v")).collect())
    kind = rows.schema[value].dataType
    before = rows.sparkSession.createDataFrame([(p, last[i - 1][1] if i else None) for i, (p, _) in enumerate(last)], f"part int, _last {kind.simpleString()}")
    here = Window.partitionBy("part").orderBy(order)
    return rows.join(F.broadcast(before), "part").withColumn(out, F.when(F.row_number().over(here) == 1, F.col("_last")).otherwise(F.lag(value).over(here))).drop("_last")


def running(rows: DataFrame, value: str, order: str, out: str, most: bool = False) -> DataFrame:
    """Adds the sum, or the maximum, of a long column of all rows up to this one; rows have `part`. One total per partition goes to the driver."""
    combine = F.max if most else F.sum
    before, at = [], 0 if not most else -1
    for r in sorted(rows.groupBy("part").agg(combine(value).alias("t")).collect(), key=lambda r: r["part"]):
        before.append((r["part"], at))
        at = at if r["t"] is None else max(at, r["t"]) if most else at + r["t"]
    local = combine(value).over(Window.partitionBy("part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    joined = with_before(rows, before, "_before").withColumn("_local", F.coalesce(local, F.lit(-1 if most else 0)))
    return joined.withColumn(out, (F.greatest("_before", "_local") if most else F.col("_before") + F.col("_local")).cast("long")).drop("_before", "_local")
