"""Operator 4: SimHash near-duplicates by anchor-point covering.

Fingerprints of whole texts link at MOST_BITS differing bits or fewer. The 64 bits are cut into three
blocks, so linked fingerprints differ by at most one bit in one of them. In each block the anchors are a
covering code of radius 1: the perfect (15, 11) Hamming code on the low 15 bits, every value of the rest.
A fingerprint lives at its nearest anchor, and visits every anchor within radius 1 + 1 at which a partner
can live. Per anchor, visitors are compared with residents on all 64 bits.

Exact copies meet as one distinct fingerprint before anything is replicated. A cell gives a spanning
forest of its links, never all pairs. Anchors with over CELL residents are cut into cells of residents x
visitors, so no task holds a whole hot anchor. Links become components by contraction rounds.

Nulls: a null text has no words and fingerprint zero, as an empty one; a null doc_id never is the
smallest unless all of its component are null. Repeated rows stay, each with its component; of those that
keep_one would keep, one stays. An empty table gives an empty result. A very long text is one row of Arrow, read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirgate.llm.arrow_text import SPACED, slices, split_words
from weirgate.llm.components import components
from weirgate.llm.shared import join_hot, map_arrow, packed, stage

SHINGLE = 4
SEED = 42
MOST_BITS = 4
#: First bit and width of each block.
BLOCKS = ((0, 22), (22, 21), (43, 21))
CELL = 4096
#: Below so many hot anchors, their list is broadcast; above, it is joined.
FEW_HOT = 1000
PAIRS_AT_ONCE = 1 << 21


def fingerprints_of(column: pa.Array) -> np.ndarray:
    """The fingerprints of a null-free large_string array."""
    words = split_words(column, SPACED)
    size = words.end - words.start
    out = np.zeros(len(column), dtype=np.uint64)
    if not len(size):
        return out
    # The words again, each followed by one space.
    at = np.concatenate([[0], np.cumsum(size + 1)])
    joined = np.full(int(at[-1]), 32, dtype=np.uint8)
    inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    joined[np.repeat(at[:-1], size) + inside] = words.low[np.repeat(words.start, size) + inside]
    joined = joined.tobytes()

    n = np.diff(words.first)
    shingles = np.where(n >= SHINGLE, n - SHINGLE + 1, (n > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(n)), shingles)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(shingles) - shingles, shingles)
    a = words.first[:-1][doc] + nth
    b = a + np.minimum(n[doc], SHINGLE) - 1
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[s:e], SEED) for s, e in zip(at[a].tolist(), (at[b] + size[b]).tolist(), strict=True)), dtype=np.uint64, count=len(doc))

    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    some = np.flatnonzero(shingles)
    counts = np.add.reduceat(bits, (np.cumsum(shingles) - shingles)[some], axis=0, dtype=np.int32)
    out[some] = np.packbits(counts * 2 > shingles[some][:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = np.concatenate([fingerprints_of(part) for _, part in slices(batch.column("text"))] or [np.zeros(0, dtype=np.uint64)])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row_key"), pa.array(fp.view(np.int64))], names=["doc_id", "row_key", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, row_key (a hash of the text), fp: one row per document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", F.xxhash64("text").alias("row_key"), F.col("text").cast("string").alias("text")), _fingerprint, f"doc_id {kind}, row_key long, fp long")


@lru_cache(1)
def _code() -> tuple[np.ndarray, np.ndarray]:
    """For each 15-bit value: its nearest codeword; and for each syndrome, what to flip to reach the codewords at distance 2 (0: none)."""
    value = np.arange(1 << 15)
    syndrome = np.zeros(1 << 15, dtype=np.int64)
    for j in range(15):
        syndrome ^= np.where(value >> j & 1, j + 1, 0)
    fix = np.concatenate([[0], 1 << np.arange(15)])
    flips = np.zeros((16, 7), dtype=np.int64)
    for s in range(1, 16):
        flips[s] = [1 << (i - 1) | 1 << ((i ^ s) - 1) for i in range(1, 16) if i < i ^ s and i ^ s <= 15]
    return value ^ fix[syndrome], flips[syndrome]


def anchors(fp: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """The anchor at which each fingerprint lives; and rows of (index, anchor) that it visits, its own included."""
    first, width = BLOCKS[block]
    part = (fp >> np.uint64(first)).astype(np.int64) & ((1 << width) - 1)
    nearest, flips = _code()
    low, rest = part & 0x7FFF, part & ~0x7FFF
    home = nearest[low] | rest
    visit = [home] + [home ^ (1 << j) for j in range(15, width)]
    index = [np.arange(len(fp))] * len(visit)
    far = flips[low]
    for j in range(7):
        to = np.flatnonzero(far[:, j])
        visit.append((low[to] ^ far[to, j]) | rest[to])
        index.append(to)
    tag = np.int64(block) << np.int64(40)
    return home | tag, np.stack([np.concatenate(index), np.concatenate(visit) | tag])


def _homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([anchors(fp, b)[0] for b in range(len(BLOCKS))]))], names=["anchor"])


def _replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        for b in range(len(BLOCKS)):
            home, (index, visit) = anchors(fp, b)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([home, visit])), pa.array(np.repeat([0, 1], [len(home), len(visit)])), pa.array(np.concatenate([fp, fp[index]]).view(np.int64))],
                names=["anchor", "visits", "fp"],
            )


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star around the smallest node of each component, in place of the edges a-b."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    ia, ib = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[ia], label[ib])
        new = label.copy()
        for x in (ia, ib, label[ia], label[ib]):
            np.minimum.at(new, x, low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    own = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[label[own]], nodes[own]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come ordered by cell, residents first. Residents of the cell at hand are kept, visitors pass by."""
    none = np.zeros(0, dtype=np.uint64)
    kept_cell, kept = None, none
    for batch in batches:
        cell = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("anchor", "i", "j")])
        visits = batch.column("visits").to_numpy(zero_copy_only=False).astype(bool)
        fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        if not len(fp):
            continue
        if kept_cell is not None:  # the residents of a cell that goes on
            cell = np.concatenate([np.repeat(kept_cell[:, None], len(kept), axis=1), cell], axis=1)
            visits, fp = np.concatenate([np.zeros(len(kept), dtype=bool), visits]), np.concatenate([kept, fp])
        new = np.concatenate([[True], (cell[:, 1:] != cell[:, :-1]).any(axis=0)])
        start = np.flatnonzero(new)
        which = np.cumsum(new) - 1
        residents = np.add.reduceat(~visits, start, dtype=np.int64)
        kept_cell, kept = cell[:, start[-1]], fp[start[-1] :][~visits[start[-1] :]]
        guest = np.flatnonzero(visits)
        pairs = residents[which[guest]]
        ends = np.cumsum(pairs)
        lo = 0
        while lo < len(guest):
            base = ends[lo] - pairs[lo]
            hi = max(lo + 1, int(np.searchsorted(ends, base + PAIRS_AT_ONCE, side="right")))
            g, n = guest[lo:hi], pairs[lo:hi]
            y = np.repeat(fp[g], n)
            x = fp[np.repeat(start[which[g]], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)]
            hit = (x < y) & (np.bitwise_count(x ^ y) <= MOST_BITS)
            lo = hi
            if hit.any():
                a, b = forest(x[hit], y[hit])
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])


def edges(distinct: DataFrame) -> DataFrame:
    """distinct: fp, each once. Returns a, b: for each cell a spanning forest of the fingerprints that link in it."""
    hot = map_arrow(distinct.select("fp"), _homes, "anchor long").groupBy("anchor").count().filter(F.col("count") > CELL)
    hot = stage(hot.select(F.col("anchor").alias("hot_anchor"), F.ceil(F.col("count") / CELL).cast("int").alias("cells")), "simhash-hot")
    hot = F.broadcast(hot) if hot.count() <= FEW_HOT else hot
    copies = map_arrow(distinct.select("fp"), _replicate, "anchor long, visits long, fp long").join(hot, F.col("anchor") == F.col("hot_anchor"), "left")
    cells = F.coalesce("cells", F.lit(1))
    own = F.pmod(F.xxhash64("fp"), cells).cast("int")
    copies = copies.select("anchor", "visits", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), cells - 1)).alias("other"))
    resident = F.col("visits") == 0
    copies = copies.select("anchor", F.when(resident, F.col("own")).otherwise(F.col("other")).alias("i"), F.when(resident, F.col("other")).otherwise(F.col("own")).alias("j"), "visits", "fp")
    return map_arrow(copies.repartition("anchor", "i", "j").sortWithinPartitions("anchor", "i", "j", "visits"), _compare, "a long, b long")


def link(fps: DataFrame) -> DataFrame:
    """fps: doc_id, fp. Returns fp, n_docs, component_id, component_key for each distinct fingerprint; the key, one fingerprint of the component, is unique to it."""
    distinct = stage(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n_docs")), "simhash-distinct")
    roots = components(edges(distinct))
    linked = distinct.join(roots.withColumnRenamed("node", "fp"), "fp")
    least = linked.groupBy("root").agg(F.min("least").alias("linked_id"))
    linked = linked.join(least, "root").select("fp", "root", "linked_id")
    return distinct.join(linked, "fp", "left").select("fp", "n_docs", F.coalesce("linked_id", "least").alias("component_id"), F.coalesce("root", "fp").alias("component_key"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, row_key, fp, component_id, component_key: one row per document."""
    fps = stage(fingerprints(docs), "simhash")
    return join_hot(fps, stage(link(fps), "simhash-links"), "fp", "n_docs", F.struct("doc_id", "row_key")).select("doc_id", "row_key", "fp", "component_id", "component_key")


def keep_least(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The documents of which each has the smallest id of its component_key in found, of equal ids the smallest row_key, of equal texts under one id the smallest hash of the row."""
    found = found.withColumn("found_id", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key"))
    stays = found.groupBy("component_key").agg(F.min("found_id").alias("s")).select(F.col("s.doc_id").alias("stay_id"), F.col("s.row_key").alias("stay_key"))
    kept = packed(docs).join(stays.distinct(), F.col("doc_id").eqNullSafe(F.col("stay_id")) & (F.col("row_key") == F.col("stay_key")), "left_semi")
    least = kept.groupBy("doc_id", "row_key").agg(F.min_by("packed", F.xxhash64("packed")).alias("packed"))
    return least.select("packed.*")


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents of which each is the one that stays of its component."""
    return keep_least(docs, near_duplicates(docs))


def query(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
