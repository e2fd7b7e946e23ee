"""Operator 12: hard negatives of anchors by a full sort of each anchor's scores.

A row's score is the integer inner product of its components, floor(256 * x), with the anchor's. Rows are packed into
blocks, and so are anchors; every block of rows meets every block of anchors once for the positives and once for the
negatives. Of a pair of blocks, all scores are sorted for each anchor by score and id. The first pass reads each anchor's
first POSITIVES rows of its own label; the second finds each positive's upper limit by binary search and reads the first
NEGATIVES rows of other labels from there, down to the lower limit. What the blocks give is cut to the first rows of
each anchor, and of each positive, over all blocks. A task holds one block of rows and one of anchors.

Rows without a label, a vector or a finite value in each place take no part. Rows that are equal in id, label and vector are one
row; rows that share an id alone are rows of their own, and of two with equal scores the smaller hash of label and vector
comes first. A null id is no anchor and comes after all other ids. Vectors of different lengths are compared as if the
shorter one had zeros; an empty vector has score 0 with all. Scores are 64-bit integers; products beyond that
wrap around, and components beyond it are the largest there is. Ties: the smaller id. An empty table gives no rows. Other
columns of the table are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirgate.llm.ranking import first_k
from weirgate.llm.shared import map_arrow, stage

SCALE = 256
ANCHOR_STEP, LABEL_STEP, LABELS = 50, 7, 10
POSITIVES, NEGATIVES = 5, 3
#: A negative's score in hundredths of the positive's: at least, at most.
LOWER, UPPER = 50, 95
#: Components of a block of anchors and, at most and at least, of one of rows.
ANCHOR_CELLS, MOST_CELLS, LEAST_CELLS = 1 << 16, 1 << 21, 1 << 17
#: Scores that are made and sorted at once.
SCORES_AT_ONCE = 1 << 21
#: 64-bit sums are exact in double precision up to here.
EXACT = 1 << 53

_BLOCK = "block int, size int, width int, ids binary, no_id binary, labels binary, keys binary, cells binary, limits binary"


def integer_rows(rows: DataFrame, relabel: bool = True) -> DataFrame:
    """vec_id, label, cells (array of long) and key, a hash of the last two, of the rows that take part."""
    x = F.col("embedding")
    kept = rows.select("vec_id", "label", x).filter(F.col("label").isNotNull() & x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf"))))
    label = F.when(F.col("vec_id") % LABEL_STEP == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label")) if relabel else F.col("label")
    cells = F.transform(x, lambda v: F.floor(F.lit(SCALE) * v.cast("double")).cast("long"))
    out = kept.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), cells.alias("cells")).distinct()
    return out.withColumn("key", F.xxhash64("label", "cells"))


@dataclass
class Block:
    """Rows in the order of their ids, null ids last, then of their keys."""

    ids: np.ndarray
    no_id: np.ndarray
    labels: np.ndarray
    keys: np.ndarray
    cells: np.ndarray
    limits: np.ndarray

    @classmethod
    def read(cls, batch: pa.RecordBatch, i: int) -> Block:
        n, width = batch.column("size")[i].as_py(), batch.column("width")[i].as_py()
        raw = lambda c, kind: np.frombuffer(batch.column(c)[i].as_buffer(), dtype=kind)
        cells = batch.column("cells")[i].as_buffer()
        kind = f"i{cells.size // (n * width)}" if n * width else "i8"
        return cls(raw("ids", "i8"), raw("no_id", "?"), raw("labels", "i8"), raw("keys", "i8"), np.frombuffer(cells, dtype=kind).reshape(n, width), raw("limits", "i8").reshape(n, -1))


def _pack(table: pa.Table, most: int) -> Iterator[pa.RecordBatch]:
    """Rows of one block as one row, its cells in the smallest integers that hold them."""
    column = lambda c: table.column(c).combine_chunks()
    ids, labels, keys = (column(c).fill_null(0).to_numpy(zero_copy_only=False) for c in ("vec_id", "label", "key"))
    no_id = np.asarray(column("vec_id").is_null())
    order = np.lexsort((keys, ids, no_id))
    lists = column("cells")
    size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    width = int(size.max(initial=0))
    cells = np.zeros((len(ids), width), dtype=np.int64)
    at = np.repeat(np.arange(len(ids)), size)
    cells[at, np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)] = lists.flatten().to_numpy(zero_copy_only=False)
    for kind in ("i1", "i2", "i4"):
        if cells.size and np.iinfo(kind).min <= cells.min() and cells.max() <= np.iinfo(kind).max:
            cells = cells.astype(kind)
            break
    # Scores of an anchor's positives, in order; where it has fewer, the rest is marked by the list's own length.
    limits = np.zeros((len(ids), most + 1), dtype=np.int64)
    if most:
        for i, scores in enumerate(column("positives").to_pylist()):
            limits[i, : len(scores)], limits[i, most] = scores, len(scores)
    values = [table.column("block")[0].as_py(), len(ids), width, *(x[order].tobytes() for x in (ids, no_id, labels, keys, cells, limits))]
    schema = pa.schema([("block", pa.int32()), ("size", pa.int32()), ("width", pa.int32()), *((c, pa.binary()) for c in ("ids", "no_id", "labels", "keys", "cells", "limits"))])
    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, schema.types, strict=True)], schema=schema)


def blocks(rows: DataFrame, cells: int, spread: int = 1, most: int = 0) -> DataFrame:
    """rows as packed blocks of about `cells` components, or of less where that gives fewer than `spread` blocks; rows of like lengths share one. Blocks are numbered from 0."""
    length = F.length(F.bin(F.size("cells")))
    found = {r["length"]: r["n"] for r in rows.groupBy(length.alias("length")).agg(F.count("*").alias("n")).collect()}
    total = sum(n << k for k, n in found.items())
    each = max(min(cells, LEAST_CELLS), min(cells, total // spread))
    first, at, n_at = 0, F.lit(0), F.lit(1)
    for k, n in sorted(found.items()):
        own = -(-(n << k) // each)
        at, n_at = F.when(length == k, first).otherwise(at), F.when(length == k, own).otherwise(n_at)
        first += own
    block = (at + F.pmod(F.xxhash64("vec_id", "key"), n_at)).cast("int")
    return rows.withColumn("block", block).groupBy("block").applyInArrow(lambda t: pa.Table.from_batches(_pack(t, most)), _BLOCK)


def scores_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of a with those of b as 64-bit integers; by the processor's double precision where that is exact."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    largest = [max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0 for x in (a, b)]
    if largest[0] * largest[1] * max(1, width) < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def full_order(scores: np.ndarray) -> np.ndarray:
    """Of each row of scores the places by score, highest first, then by place: blocks lie in the order of their ids."""
    n = scores.shape[1]
    bits = max(1, (n - 1).bit_length())
    if not scores.size or max(abs(int(scores.min())), abs(int(scores.max()))) < 1 << (62 - bits):
        # One integer for score and place sorts several times as fast as two keys do.
        return np.sort((-scores << bits) | np.arange(n), axis=1) & ((1 << bits) - 1)
    return np.stack([np.lexsort((np.arange(n), ~row)) for row in scores])


def _anchors_at_once(anchors: Block, rows: Block) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The place of an anchor in its block, its scores with all rows, and their order."""
    step = max(1, SCORES_AT_ONCE // max(1, len(rows.ids)))
    for lo in range(0, len(anchors.ids), step):
        scores = scores_of(anchors.cells[lo : lo + step], rows.cells)
        for i, (own, order) in enumerate(zip(scores, full_order(scores), strict=True)):
            yield lo + i, own, order


def positives_of(anchors: Block, rows: Block, most: int) -> Iterator[tuple[int, int, int, int]]:
    """(anchor's place, row's place, score, 0) of the first rows of the anchor's label in a block, the anchor itself left out."""
    for i, scores, order in _anchors_at_once(anchors, rows):
        fits = (rows.labels == anchors.labels[i]) & ~((rows.ids == anchors.ids[i]) & ~rows.no_id & (rows.keys == anchors.keys[i]))
        found = order[fits[order]][:most]
        yield from ((i, j, s, 0) for j, s in zip(found.tolist(), scores[found].tolist(), strict=True))


def negatives_of(anchors: Block, rows: Block, most: int) -> Iterator[tuple[int, int, int, int]]:
    """(anchor's place, row's place, score, number of the positive) of the first rows of other labels between each positive's limits."""
    for i, scores, order in _anchors_at_once(anchors, rows):
        sorted_scores = scores[order]
        others = np.flatnonzero(rows.labels[order] != anchors.labels[i])
        down = ~sorted_scores  # ascending
        for nth, p in enumerate(anchors.limits[i, : anchors.limits[i, -1]].tolist()):
            least, largest = -(-LOWER * p // 100), UPPER * p // 100
            start = np.searchsorted(down, ~np.int64(largest))
            found = others[np.searchsorted(others, start) :][:most]
            found = found[sorted_scores[found] >= least]
            yield from ((i, j, s, nth) for j, s in zip(order[found].tolist(), sorted_scores[found].tolist(), strict=True))


_FOUND = "anchor_id long, anchor_key long, nth int, id long, key long, score long"


def _meet(batches: Iterator[pa.RecordBatch], reader, most: int) -> Iterator[pa.RecordBatch]:
    """Rows come by block of rows: first that block, then all blocks of anchors. The block of rows is kept, anchors pass by."""
    rows = None
    for batch in batches:
        passes = batch.column("passes").to_pylist()
        for n, anchor in enumerate(passes):
            if not anchor:
                rows = Block.read(batch, n)
                continue
            anchors = Block.read(batch, n)
            found = np.array(list(reader(anchors, rows, most)), dtype=np.int64).reshape(-1, 4)
            i, j = found[:, 0], found[:, 1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchors.ids[i]), pa.array(anchors.keys[i]), pa.array(found[:, 3].astype(np.int32)), pa.array(rows.ids[j], mask=rows.no_id[j]), pa.array(rows.keys[j]), pa.array(found[:, 2])],
                names=["anchor_id", "anchor_key", "nth", "id", "key", "score"],
            )


def meet(rows: DataFrame, n_rows: int, anchors: DataFrame, reader, most: int) -> DataFrame:
    """Every block of rows with every block of anchors; a block of anchors is copied to each of the n_rows blocks of rows."""
    copies = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(max(0, n_rows - 1)))).alias("at"), F.lit(True).alias("passes"), "*")
    both = rows.select(F.col("block").alias("at"), F.lit(False).alias("passes"), "*").unionByName(copies)
    # Ranges of block numbers: as many of them in each task as in another.
    dealt = both.repartitionByRange(max(1, n_rows), "at").sortWithinPartitions("at", "passes", "block")
    return map_arrow(dealt, lambda b: _meet(b, reader, most), _FOUND)


def mine(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """rows: as integer_rows gives them. anchor_id, positive_id, rank, negative_id, positive_score, negative_score, by rank from 1."""
    rows = stage(rows, "negatives-rows")
    spark = rows.sparkSession
    packed = stage(blocks(rows, MOST_CELLS, 2 * spark.sparkContext.defaultParallelism), "negatives-blocks")
    n_blocks = packed.count()
    chosen = rows.filter(is_anchor & F.col("vec_id").isNotNull())
    anchors = stage(blocks(chosen, ANCHOR_CELLS), "negatives-anchors")
    order = [F.desc("score"), F.asc_nulls_last("id"), F.asc("key")]
    found = first_k(meet(packed, n_blocks, anchors, positives_of, positives), ["anchor_id", "anchor_key"], order, positives, F.struct("id", "key"))
    best = stage(found.select("anchor_id", "anchor_key", (F.col("rank") - 1).alias("nth"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "negatives-positives")

    scores = best.groupBy("anchor_id", "anchor_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "positive_score"))), lambda x: x["positive_score"]).alias("positives"))
    with_limits = chosen.join(scores, (F.col("vec_id") == F.col("anchor_id")) & (F.col("key") == F.col("anchor_key"))).select("vec_id", "label", "cells", "key", "positives")
    again = stage(blocks(with_limits, ANCHOR_CELLS, most=positives), "negatives-limits")
    found = first_k(meet(packed, n_blocks, again, negatives_of, negatives), ["anchor_id", "anchor_key", "nth"], order, negatives, F.struct("id", "key"))
    return found.join(best, ["anchor_id", "anchor_key", "nth"]).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def query(spark, sf_dir: str) -> DataFrame:
    return mine(integer_rows(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), F.col("vec_id") % ANCHOR_STEP == 0)


ORACLE_SQL = f"""
WITH e AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % {LABEL_STEP} = 0 THEN (label + 1) % {LABELS} ELSE label END AS label, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::double))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS id, list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]))::bigint AS score
  FROM e a JOIN e b ON a.vec_id % {ANCHOR_STEP} = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {POSITIVES})
SELECT p.anchor_id, p.id AS positive_id, (row_number() OVER w)::int AS rank, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND {LOWER} * p.score <= 100 * s.score AND 100 * s.score <= {UPPER} * p.score
WINDOW w AS (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) QUALIFY row_number() OVER w <= {NEGATIVES}
"""
