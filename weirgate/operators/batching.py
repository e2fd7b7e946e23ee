"""Request batches: neighbours of one partition, filled up to a number of items and of bytes, in order.

Rows are sorted once, into range partitions, and gone through there in Arrow; what a partition needs to know of those
before it is a few numbers for each of them, on the driver. An island is a stretch of neighbours whose partition
columns are equal, and may span any number of range partitions, as a batch may.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirgate.materialize import written
from weirgate.operators.ordinal import with_before

#: What a batch is made of besides its records: brackets around them, and a comma between two.
ENVELOPE, SEPARATOR = 2, 1
#: Stands for a limit where there is none.
NO_LIMIT = 1 << 60
#: What a pass adds: the row's partition and place in it; islands that began in it so far, and the row's place in its island; sums of items, and of bytes with a separator each, up to the row.
_ADDED = {"part": T.IntegerType(), "o": T.LongType(), "islands": T.LongType(), "pos": T.LongType(), "later": T.LongType(), "items_sum": T.LongType(), "bytes_sum": T.LongType()}


def _pass(batches: Iterator[pa.RecordBatch], max_rows: int, weighted: bool) -> Iterator[pa.RecordBatch]:
    """Adds _ADDED to the sorted rows of a range partition. later: batches of max_rows rows before and of the row, counted from the first island that begins inside."""
    part = TaskContext.get().partitionId()
    at, last, islands, pos, later, items_sum, bytes_sum = 0, None, 0, -1, -1, 0, 0
    for batch in batches:
        n, keys = batch.num_rows, batch.column("island_key")
        if not n:
            continue
        begins = pc.not_equal(keys, pa.concat_arrays([pa.array([last], keys.type), keys.slice(0, n - 1)])).fill_null(False).to_numpy(zero_copy_only=False)
        nth = np.arange(n)
        start = np.maximum.accumulate(np.where(begins, nth, -1))
        own = np.where(start < 0, pos + 1 + nth, nth - start)
        island = islands + np.cumsum(begins)
        cuts = later + np.cumsum((island > 0) & (own % max_rows == 0))
        sums = []
        if weighted:
            items, size = (batch.column(c).fill_null(-1).to_numpy(zero_copy_only=False) for c in ("item_count", "byte_count"))
            wrong = np.flatnonzero((items < 0) | (items > max_rows))
            if len(wrong):
                raise ValueError(f"a record of {batch.column('item_count')[int(wrong[0])].as_py()} items does not fit requests of {max_rows}")
            sums = [items_sum + np.cumsum(items), bytes_sum + np.cumsum(size + SEPARATOR)]
            items_sum, bytes_sum = int(sums[0][-1]), int(sums[1][-1])
        added = [np.full(n, part, dtype=np.int32), at + nth, island, own, cuts, *(sums or [np.zeros(n, dtype=np.int64)] * 2)]
        yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, added)], names=[*batch.schema.names, *_ADDED])
        at, last, islands, pos, later = at + n, keys[n - 1].as_py(), int(island[-1]), int(own[-1]), int(cuts[-1])


def _ranges(rows: DataFrame, order: str, partition: Sequence[str], max_rows: int = 1, weighted: bool = False) -> tuple[DataFrame, list[dict]]:
    """rows, read and sorted once, as a table with island_key and _ADDED; and a row for each range partition, in order.

    Those have the partition's rows (n), its first rows that belong to one island (lead), the islands that begin after them, its first
    and last key, the last row's columns, and whether its first row goes on with the island before it (goes_on).
    """
    keyed = rows.withColumn("island_key", F.to_json(F.struct(*partition), {"ignoreNullFields": "false"}))
    schema = T.StructType([*keyed.schema.fields, *(T.StructField(c, t) for c, t in _ADDED.items())])
    fixed = written(keyed.repartitionByRange(order).sortWithinPartitions(order).mapInArrow(lambda b: _pass(b, max_rows, weighted), schema), "ranges")
    end = F.max(F.struct("o", "islands", "pos", "later", "items_sum", "bytes_sum", "island_key", *(("item_count", "byte_count") if weighted else ())))
    found = fixed.groupBy("part").agg(F.count("*").alias("n"), F.count_if(F.col("islands") == 0).alias("lead"), F.min_by("island_key", "o").alias("first_key"), end.alias("end"))
    parts = sorted(({**r.asDict(), **r["end"].asDict()} for r in found.collect()), key=lambda r: r["part"])
    for before, r in zip([None, *parts], parts, strict=False):
        r["goes_on"] = before is not None and before["island_key"] == r["first_key"]
    return fixed, parts


def with_islands(rows: DataFrame, order: str, partition: Sequence[str]) -> DataFrame:
    """island: 0, 1, ... for each stretch of neighbours whose partition columns are equal."""
    fixed, parts = _ranges(rows, order, partition)
    before, at = [], -1
    for r in parts:
        at += not r["goes_on"]
        before.append((r["part"], at))
        at += r["islands"]
    return with_before(fixed, before, "_before").withColumn("island", F.col("_before") + F.col("islands")).drop("_before", "island_key", *_ADDED)


def unit_batches(rows: DataFrame, order: str, partition: Sequence[str], max_rows: int) -> DataFrame:
    """batch_index of records of one item each: islands cut every max_rows rows. One sort and one pass; a partition needs the place in its island, and the batch, where it begins."""
    fixed, parts = _ranges(rows, order, partition, max_rows)
    # Of each partition: rows of its first island before it, and the first batches of that island and of the next one.
    before, carried, island_batch, next_batch = [], 0, 0, 0
    for r in parts:
        if not r["goes_on"]:
            carried, island_batch = 0, next_batch
        inside = island_batch - (-(carried + r["lead"]) // max_rows)
        before.append((r["part"], carried, island_batch, inside))
        if r["islands"]:
            carried, island_batch, next_batch = r["pos"] + 1, inside + r["later"] - r["pos"] // max_rows, inside + r["later"] + 1
        else:
            carried, next_batch = carried + r["n"], inside
    table = fixed.sparkSession.createDataFrame(before, "part int, carried long, island_batch long, inside long")
    lead = F.col("island_batch") + F.floor((F.col("carried") + F.col("pos")) / max_rows)
    index = F.when(F.col("islands") == 0, lead).otherwise(F.col("inside") + F.col("later")).cast("long")
    return fixed.join(F.broadcast(table), "part").withColumn("batch_index", index).drop("carried", "island_batch", "inside", "island_key", *_ADDED)


# Batches by weight. A batch that begins at a row ends before the first one that is too much for it: a search in the sums of items and bytes. So
# every row has a next cut; which rows are cuts is what the first one reaches.


def next_cuts(island: np.ndarray, items: np.ndarray, size: np.ndarray, items_before: np.ndarray, size_before: np.ndarray, max_rows: int, max_bytes: int | None) -> np.ndarray:
    """For each place of items_before and size_before (sums before the row) the place where a batch that begins there ends. A record that is too much alone stands alone."""
    own = np.arange(len(items_before))
    most = NO_LIMIT if max_bytes is None else max_bytes - ENVELOPE + SEPARATOR
    ends = [np.searchsorted(items, items_before + max_rows, side="right"), np.searchsorted(size, size_before + most, side="right"), np.searchsorted(island, island[: len(own)], side="right")]
    return np.maximum(np.minimum.reduce(ends), own + 1)


def cuts_from(first: int, following: np.ndarray) -> np.ndarray:
    """Which places are cuts, from the first one on."""
    out, at = np.zeros(len(following), dtype=bool), first
    while at < len(following):
        out[at] = True
        at = int(following[at])
    return out


def _by_part(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, pa.Table]]:
    """The rows of each value of an ordered column, together: those of one range partition."""
    held, at = [], None
    for batch in batches:
        values = batch.column(key).to_numpy()
        edges = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)] if len(values) else [0]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            if held and values[lo] != at:
                yield at, pa.Table.from_batches(held)
                held = []
            at = int(values[lo])
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield at, pa.Table.from_batches(held)


_SUMS = ("island", "items", "size", "items_before", "size_before")
_DEALT = "at int, own boolean, early boolean, g long, island long, items long, size long, items_before long, size_before long"


def _deal(batches: Iterator[pa.RecordBatch], parts: dict[str, np.ndarray], max_rows: int, max_bytes: int | None) -> Iterator[pa.RecordBatch]:
    """Each row to its own partition and to those before it that have a batch which may reach it; `early` on rows that a batch from before may hold."""
    most = NO_LIMIT if max_bytes is None else max_bytes - ENVELOPE + SEPARATOR
    for batch in batches:
        column = {c: batch.column(c).to_numpy() for c in ("part", "o", "islands", "items_sum", "bytes_sum", "item_count", "byte_count")}
        k = np.searchsorted(parts["part"], column["part"])
        g, island = parts["g"][k] + column["o"], parts["island"][k] + column["islands"]
        items, size = parts["items"][k] + column["items_sum"], parts["size"][k] + column["bytes_sum"]
        values = [g, island, items, size, items - column["item_count"], size - column["byte_count"] - SEPARATOR]
        # The last row of a partition begins the batch that reaches furthest.
        low = np.maximum.reduce([np.searchsorted(parts["end_items"], items - max_rows), np.searchsorted(parts["end_size"], size - most), np.searchsorted(parts["end_island"], island)])
        copies = np.maximum(k - low, 0)
        row = np.repeat(np.arange(len(k)), copies)
        to = low[row] + np.arange(len(row)) - np.repeat(np.cumsum(copies) - copies, copies)
        both = np.concatenate([np.arange(len(k)), row])
        own = np.arange(len(both)) < len(k)
        columns = [np.concatenate([k, to]).astype(np.int32), own, (copies > 0)[both], *(v[both] for v in values)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["at", "own", "early", "g", *_SUMS])


def _exits(batches: Iterator[pa.RecordBatch], max_rows: int, max_bytes: int | None) -> Iterator[pa.RecordBatch]:
    """entry, exit: of each row at which a batch from before may end, the first cut after this partition that it leads to, by doubling of pointers."""
    for _, rows in _by_part(batches, "at"):
        column = {c: rows.column(c).to_numpy() for c in ("own", "early", "g", *_SUMS)}
        n = int(column["own"].sum())
        following = next_cuts(*(column[c] for c in _SUMS[:3]), *(column[c][:n] for c in _SUMS[3:]), max_rows, max_bytes)
        while (inside := following < n).any():
            following = np.where(inside, following[np.minimum(following, n - 1)], following)
        entries = np.arange(min(n, int(column["early"][:n].sum()) + 1))
        g = np.append(column["g"], column["g"][-1] + 1)
        yield pa.RecordBatch.from_arrays([pa.array(g[entries]), pa.array(g[following[entries]])], names=["entry", "exit"])


def _reached(exits: DataFrame, n_parts: int) -> list[int]:
    """The entries that the first row leads to, one a partition at most: in each round the known ones jump, and jumps double."""
    spark = exits.sparkSession
    reached, jumps = spark.createDataFrame([(0,)], "entry long"), written(exits, "jumps")
    for turn in range((n_parts - 1).bit_length()):
        reached = written(reached.union(reached.join(jumps, "entry").select("exit")).distinct(), "reached")
        if turn + 1 < (n_parts - 1).bit_length():
            jumps = written(jumps.join(jumps.select(F.col("entry").alias("exit"), F.col("exit").alias("beyond")), "exit").select("entry", F.col("beyond").alias("exit")), "jumps")
    return sorted(r["entry"] for r in reached.collect())


def _own_cuts(rows: pa.Table, max_rows: int, max_bytes: int | None) -> np.ndarray:
    """next_cuts among the rows of one partition."""
    island, items, size, item_count, byte_count = (rows.column(c).to_numpy() for c in ("islands", "items_sum", "bytes_sum", "item_count", "byte_count"))
    return next_cuts(island, items, size, items - item_count, size - byte_count - SEPARATOR, max_rows, max_bytes)


def _cut(batches: Iterator[pa.RecordBatch], entries: dict[int, int], max_rows: int, max_bytes: int | None) -> Iterator[pa.RecordBatch]:
    """Adds nth: cuts of the partition up to the row."""
    for part, rows in _by_part(batches, "part"):
        nth = np.cumsum(cuts_from(entries.get(part, rows.num_rows), _own_cuts(rows, max_rows, max_bytes)))
        yield from rows.append_column("nth", pa.array(nth)).to_batches()


def weighted_batches(rows: DataFrame, order: str, partition: Sequence[str], max_rows: int, max_bytes: int | None = None) -> DataFrame:
    """batch_index of records of item_count items and byte_count bytes, in bodies of at most max_bytes with their brackets and commas.

    Where a batch ends depends on where it began, so cuts follow one from the other. Each range partition finds, for the rows at which
    a batch from before may end, the first cut beyond it; doubling these jumps tells in a logarithm of rounds where each partition is
    entered; then each marks its own cuts. A partition gets the rows after it that a batch of its own may reach, so an island, or a third
    of all rows in one, is no single task's. A count that is null, negative or over max_rows is an error.
    """
    fixed, parts = _ranges(rows.withColumns({c: F.col(c).cast("long") for c in ("item_count", "byte_count")}), order, partition, max_rows, True)
    if not parts:
        return fixed.withColumn("batch_index", F.lit(0).cast("long")).drop("island_key", *_ADDED)
    known: dict[str, list[int]] = {c: [] for c in ("part", "g", "island", "items", "size", "end_items", "end_size", "end_island")}
    g, island, items, size = 0, -1, 0, 0
    for r in parts:
        island += not r["goes_on"]
        ends = (items + r["items_sum"] - r["item_count"], size + r["bytes_sum"] - r["byte_count"] - SEPARATOR, island + r["islands"])
        for c, v in zip(known, (r["part"], g, island, items, size, *ends), strict=True):
            known[c].append(v)
        g, island, items, size = g + r["n"], island + r["islands"], items + r["items_sum"], size + r["bytes_sum"]
    table = {c: np.array(v, dtype=np.int64) for c, v in known.items()}
    entries = [0]
    if len(parts) > 1:
        slim = fixed.select("part", "o", "islands", "items_sum", "bytes_sum", "item_count", "byte_count").mapInArrow(lambda b: _deal(b, table, max_rows, max_bytes), _DEALT)
        dealt = slim.repartition("at").sortWithinPartitions("at", "g")
        entries = _reached(dealt.mapInArrow(lambda b: _exits(b, max_rows, max_bytes), "entry long, exit long"), len(parts))
    own = np.searchsorted(table["g"], entries, side="right") - 1
    first = {int(table["part"][k]): e - int(table["g"][k]) for k, e in zip(own.tolist(), entries, strict=True) if e < g}
    schema = T.StructType([*fixed.schema.fields, T.StructField("nth", T.LongType())])
    cut = written(fixed.repartition("part").sortWithinPartitions("part", "o").mapInArrow(lambda b: _cut(b, first, max_rows, max_bytes), schema), "cut")
    before, at = [], -1
    for r in sorted(cut.groupBy("part").agg(F.max("nth").alias("n")).collect(), key=lambda r: r["part"]):
        before.append((r["part"], at))
        at += r["n"]
    return with_before(cut, before, "_before").withColumn("batch_index", F.col("_before") + F.col("nth")).drop("_before", "nth", "island_key", *_ADDED)


def _page(batches: Iterator[pa.RecordBatch], max_rows: int, max_bytes: int | None) -> Iterator[pa.RecordBatch]:
    held = [b for b in _pass(batches, max_rows, True)]
    if held:
        for _, rows in _by_part(iter(held), "part"):
            index = np.cumsum(cuts_from(0, _own_cuts(rows, max_rows, max_bytes))) - 1
            yield from rows.drop_columns(["island_key", *_ADDED]).append_column("batch_index", pa.array(index)).to_batches()


def _pages(batches: Iterator[pa.RecordBatch], max_rows: int, max_bytes: int | None) -> Iterator[pa.RecordBatch]:
    for _, rows in _by_part(batches, "page"):
        yield from _page(iter(rows.to_batches()), max_rows, max_bytes)


def page_batches(page: DataFrame, order: str, partition: Sequence[str], max_rows: int, max_bytes: int | None = None, many: bool = False) -> DataFrame:
    """batch_index of a bounded page's records, of item_count items and byte_count bytes each: one pass over the page in one task. many: the rows of several pages, by `page`, each for itself."""
    plain = page.withColumns({c: F.col(c).cast("long") for c in ("item_count", "byte_count")})
    schema = T.StructType([*plain.schema.fields, T.StructField("batch_index", T.LongType())])
    keyed = plain.withColumn("island_key", F.to_json(F.struct(*partition), {"ignoreNullFields": "false"}))
    if many:
        return keyed.repartition("page").sortWithinPartitions("page", order).mapInArrow(lambda b: _pages(b, max_rows, max_bytes), schema)
    return keyed.repartition(1).sortWithinPartitions(order).mapInArrow(lambda b: _page(b, max_rows, max_bytes), schema)


def batches(rows: DataFrame, order: str = "sequence_order", items: Column | None = None) -> DataFrame:
    """One row per batch: what it holds and its range."""
    n = F.lit(1) if items is None else items
    return rows.groupBy("batch_index").agg(
        F.count("*").alias("row_count"), F.sum(n).cast("long").alias("item_count"), F.min("kind").alias("operation"), F.min(order).alias("first_order"), F.max(order).alias("last_order"),
    )


def record_identity() -> Column:
    """The first of work id, identity and key that is there."""
    return F.coalesce("work_id", "key_json")


def bodies(rows: DataFrame, record: Column, order: str = "sequence_order") -> DataFrame:
    """A JSON body per batch: its records in order. A batch is bounded by the request limits."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), record.alias("r"))))
    return rows.groupBy("batch_index").agg(F.concat(F.lit("["), F.array_join(F.transform(listed, lambda x: x["r"]), ","), F.lit("]")).alias("body"))


def fingerprints(rows: DataFrame, order: str = "sequence_order", *more: Column, by: Sequence[str] = ("batch_index",)) -> DataFrame:
    """Per batch, or value of `by`, the sha256 of its records (kind, key, identifiers, payload, in order) and of its targets, and more aggregates. A batch is bounded by the request limits."""
    record = F.concat_ws("|", "kind", "key_json", F.coalesce("identifiers_json", F.lit("null")), F.coalesce("payload_json", F.lit("null")))
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.sha2(record, 256).alias("r"))))
    return rows.groupBy(*by).agg(
        F.sha2(F.array_join(F.transform(listed, lambda x: x["r"]), ","), 256).alias("payload_fingerprint"),
        F.sha2(F.array_join(F.array_sort(F.collect_set(F.coalesce("target_json", F.lit("null")))), ","), 256).alias("request_fingerprint"),
        *more,
    )
