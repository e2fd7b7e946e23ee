"""Operator 11: texts whose sets of shingles have a Jaccard similarity of a bound or more, by size-banded tiles.

Sets are put in one order of all shingles: first those whose hash bucket is rare in all documents, then by hash. Two sets that
link share one of the first n - ceil(bound * n) + 1 shingles of each, so those are a set's tiles. A tile also has a
band of sizes, from one power of two to the next; a set so near to the next band that it may link there visits that tile
as well. What a common passage shares is late in the order, so it seldom makes a tile.

Equal sets meet as one node before anything is replicated. Tiles of one row go at once, by counts made before the shuffle. Then
each tile's nodes are compared with one of them, and again with the one that meets most others, which links large groups of near
copies by as many pairs as they have nodes; where a tile still has nodes of different components, all of its nodes are
compared with each other inside of a task. Tiles of over CELL nodes, or CELL_BYTES of sets, are cut into cells of residents by visitors.
No pair is made that hashed bitmaps rule out: bits that differ are shingles of one set alone, so half of both sizes less the
differing bits bounds the overlap from above. Pairs left are decided by the exact intersection of their sorted arrays: those
of tiles of HOT nodes at most after a shuffle, so at most HOT / 2 a node and tile leave the task; to larger tiles the
sets themselves come, which are compared in the task, and what leaves it is a forest of links, fewer than it has nodes.

Words are lower-cased (A-Z) runs of `[^\\x20\\x09-\\x0D]`; fewer than the words of a shingle are one shingle; no words, or a null text, give
an empty set, which links with nothing. Shingles and sets are compared by 64-bit hashes. A null doc_id is never the smallest
unless all of its component are null. Repeated rows stay, each with its component. Very long texts are read whole, in a row of
Arrow each. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirgate.llm.arrow_text import SPACED, gram_hashes, mix, slices, split_words
from weirgate.llm.components import components
from weirgate.llm.shared import SPACED_WORD, UPPER, join_hot, map_arrow, stage
from weirgate.materialize import scratch

#: Buckets by which common shingles are told from rare ones: their counts are broadcast, 0.5 MB.
BUCKETS = 1 << 16
#: Bits of a bitmap for each shingle, at least; the least and greatest width of one. Wider ones are folded when two are compared, and all of a cell first to COARSE bits.
BITS, LEAST_WIDTH, MOST_WIDTH, COARSE = 4, 64, 1 << 17, 512
CELL, CELL_BYTES = 2048, 64 << 20
#: Nodes of a tile beyond which its links are decided in its task; bits of a bitmap for each shingle there.
HOT, HOT_BITS = 64, 16
STARS = 2
PAIRS_AT_ONCE = 1 << 16


@dataclass(frozen=True)
class Rule:
    """Shingles of `words` words; sets link at `hundredths` / 100 of their union or more."""

    words: int = 4
    hundredths: int = 85

    def sets(self, column: pa.Array) -> list[np.ndarray]:
        """The distinct shingle hashes of each text of a null-free large_string array, ascending."""
        words = split_words(column, SPACED)
        h, n = words.hashes(), np.diff(words.first)
        grams = gram_hashes(h, self.words)
        short = {k: gram_hashes(h, k) for k in set(n[(n > 0) & (n < self.words)].tolist())}
        out = []
        for a, k in zip(words.first[:-1].tolist(), n.tolist(), strict=True):
            out.append(np.unique(grams[a : a + k - self.words + 1]) if k >= self.words else short[k][a : a + 1] if k else h[:0])
        return out

    def similar(self, both, a, b):
        """Whether an overlap of two sizes is enough; for numbers or arrays."""
        return 100 * both >= self.hundredths * (a + b - both)

    def first_shingles(self, n: int) -> int:
        """So many shingles of a set of n, in the common order, must hold one of any set it links with."""
        return n - -(-self.hundredths * n // 100) + 1


def node_of(h: np.ndarray) -> int:
    """A hash of a whole set, as a signed 64-bit integer; 0 for the empty one."""
    if not len(h):
        return 0
    sums = np.add.reduce(mix(np.stack([h, h ^ np.uint64(0xD6E8FEB86659FD93)])), axis=1)
    return int(mix(sums[:1] + sums[1:] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(len(h))).view(np.int64)[0])


def bitmap_of(h: np.ndarray, bits_each: int = BITS) -> bytes:
    """Bits of the shingles' hashes, as many as the set's size asks for."""
    width = min(MOST_WIDTH, max(LEAST_WIDTH, 1 << (bits_each * len(h) - 1).bit_length()))
    bits = np.zeros(width, dtype=np.uint8)
    bits[(h >> np.uint64(8)).astype(np.int64) & (width - 1)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def _sign(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    """A row for each slice with lists of its documents, and at a task's end one with how many of its shingles fell into each bucket."""
    lists = lambda v, kind: pa.array([v], pa.list_(kind))
    names = ["doc_id", "row_key", "node", "size", "bitmap", "held", "count"]
    total, kind = np.zeros(BUCKETS, dtype=np.int64), None
    for batch in batches:
        kind = batch.schema.field("doc_id").type
        for lo, part in slices(batch.column("text")):
            sets = rule.sets(part)
            total += np.bincount((np.concatenate(sets) >> np.uint64(48)).astype(np.int64), minlength=BUCKETS)
            own = [pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), batch.column(c).slice(lo, len(part))) for c in names[:2]]
            yield pa.RecordBatch.from_arrays([*own, lists([node_of(h) for h in sets], pa.int64()), lists([len(h) for h in sets], pa.int64()), lists([bitmap_of(h) for h in sets], pa.binary()), lists([], pa.int32()), lists([], pa.int64())], names=names)
    held = np.flatnonzero(total)
    if len(held):
        yield pa.RecordBatch.from_arrays([lists([], kind), *(lists([], k) for k in (pa.int64(), pa.int64(), pa.int64(), pa.binary())), lists(held, pa.int32()), lists(total[held], pa.int64())], names=names)


def _postings(batches: Iterator[pa.RecordBatch], rule: Rule, sent) -> Iterator[pa.RecordBatch]:
    """tile, node for each set's first shingles in the common order; a task gives those of equal sets once."""
    common, seen = sent.value, set()
    for batch in batches:
        for _, part in slices(batch.column("text")):
            tiles, nodes = [], []
            for h in rule.sets(part):
                node, n = node_of(h), len(h)
                if not n or node in seen:
                    continue
                seen.add(node)
                k = rule.first_shingles(n)
                rank = common[(h >> np.uint64(48)).astype(np.int64)]
                # The k first by bucket's rank, then by hash: h is ascending, so a stable sort keeps that order.
                most = np.partition(rank, k - 1)[k - 1]
                first = np.concatenate([h[rank < most], h[rank == most]])[:k]
                band = n.bit_length()
                for b in (band, band + 1) if 100 * n >= rule.hundredths << band else (band,):
                    tiles.append(mix(first + np.uint64(b)))
                    nodes.append(np.full(len(first), node))
            if tiles:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tiles).view(np.int64)), pa.array(np.concatenate(nodes))], names=["tile", "node"])


def _most_overlap(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """An upper bound of the overlap of each row of bitmaps with one of the same width."""
    return (size_a + size_b - np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)) // 2


def _folded(maps: list[bytes], width: int) -> np.ndarray:
    """Bitmaps as rows of 64-bit words, of `width` bits each, which none is narrower than."""
    out = np.zeros((len(maps), width // 64), dtype=np.uint64)
    for n in {len(m) for m in maps}:
        own = [i for i, m in enumerate(maps) if len(m) == n]
        words = np.frombuffer(b"".join(maps[i] for i in own), dtype=np.uint64).reshape(len(own), -1, width // 64)
        out[own] = np.bitwise_or.reduce(words, axis=1)
    return out


def _maybe(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    """Those of the pairs that sizes and bitmaps do not rule out."""
    for batch in batches:
        size = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("size_a", "size_b")]
        maps = [batch.column(c).to_pylist() for c in ("map_a", "map_b")]
        width = np.array([8 * min(len(x), len(y)) for x, y in zip(*maps, strict=True)], dtype=np.int64)
        hit = np.zeros(len(width), dtype=bool)
        for w in np.unique(width).tolist():
            own = np.flatnonzero(width == w)
            a, b = (_folded([m[i] for i in own.tolist()], w) for m in maps)
            x, y = size[0][own], size[1][own]
            hit[own] = rule.similar(np.minimum(np.minimum(x, y), _most_overlap(a, b, x, y)), x, y)
        yield batch.select(["a", "b"]).filter(pa.array(hit))


@dataclass
class _Group:
    """Nodes of a cell; sets are there in tiles whose links are decided in their task."""

    node: np.ndarray
    label: np.ndarray
    size: np.ndarray
    maps: list[bytes]
    sets: list[np.ndarray] | None = None


def _group(rows: pa.RecordBatch) -> _Group:
    node, label, size = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("node", "label", "size"))
    if "set" not in rows.schema.names:
        return _Group(node, label, size.astype(np.int64), rows.column("bitmap").to_pylist())
    sets = [np.frombuffer(x, dtype=np.uint64) for x in rows.column("set").to_pylist()]
    return _Group(node, label, size.astype(np.int64), [bitmap_of(h, HOT_BITS) for h in sets], sets)


def _tile_pairs(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    """Rows come by cell, residents first. Residents are kept, visitors pass by; where cell i is j, residents meet each other. Pairs of different labels that sizes and bitmaps let pass; with sets, a forest of those that link."""
    cell, kept, forest = None, [], _Forest(rule)
    for batch in batches:
        at = list(zip(*(batch.column(c).to_pylist() for c in ("tile", "i", "j")), strict=True))
        visits = batch.column("visits").to_pylist()
        out, lo = [], 0
        while lo < len(at):
            hi = lo
            while hi < len(at) and at[hi] == at[lo]:
                hi += 1
            if at[lo] != cell:
                out += _among(cell, kept, rule, forest)
                cell, kept, forest = at[lo], [], _Forest(rule)
            cut = lo
            while cut < hi and not visits[cut]:
                cut += 1
            if cut > lo:
                kept.append(_group(batch.slice(lo, cut - lo)))
            if cut < hi and kept:
                kept = [_together(kept)]
                out += _cell(kept[0], _group(batch.slice(cut, hi - cut)), rule, forest)
            lo = hi
        yield from _pairs(out)
    yield from _pairs(_among(cell, kept, rule, forest))


class _Forest:
    """The labels of a cell, joined by the links that were found in it."""

    def __init__(self, rule: Rule) -> None:
        self.rule, self.above = rule, {}

    def top(self, label: int) -> int:
        while (up := self.above.get(label, label)) != label:
            self.above[label] = self.above.get(up, up)
            label = up
        return label

    def labels(self, of: np.ndarray) -> np.ndarray:
        return np.array([self.top(x) for x in of.tolist()], dtype=of.dtype) if self.above else of

    def linked(self, visitors: _Group, residents: _Group, v: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of the pairs that link and whose labels no link before has joined."""
        hit = np.zeros(len(v), dtype=bool)
        for n, (i, j) in enumerate(zip(v.tolist(), r.tolist(), strict=True)):
            a, b = self.top(int(visitors.label[i])), self.top(int(residents.label[j]))
            if a != b and _overlaps(visitors.sets[i], residents.sets[j], self.rule):
                self.above[a], hit[n] = b, True
        return v[hit], r[hit]


def _overlaps(x: np.ndarray, y: np.ndarray, rule: Rule) -> bool:
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    return bool(rule.similar(int((y[at] == x).sum()), len(x), len(y)))


def _pairs(found: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    if found:
        x, y = (np.concatenate(side) for side in zip(*found, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])


def _together(groups: list[_Group]) -> _Group:
    flat = [np.concatenate([getattr(g, c) for g in groups]) for c in ("node", "label", "size")]
    return _Group(*flat, [m for g in groups for m in g.maps], None if groups[0].sets is None else [h for g in groups for h in g.sets])


def _among(cell: tuple | None, kept: list[_Group], rule: Rule, forest: _Forest) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs among the residents of a cell that has no other visitors."""
    if cell is None or cell[1] != cell[2] or not kept:
        return []
    own = _together(kept)
    if own.sets is not None:
        return list(_cell(own, own, rule, forest))
    return [(x[x < y], y[x < y]) for x, y in _cell(own, own, rule, forest)]


def _cell(residents: _Group, visitors: _Group, rule: Rule, forest: _Forest) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    width = 8 * min(len(m) for m in (*residents.maps, *visitors.maps))
    mine, theirs = _folded(residents.maps, width), _folded(visitors.maps, width)
    coarse = min(width, COARSE)
    mine_first, theirs_first = _folded(residents.maps, coarse), _folded(visitors.maps, coarse)
    step = max(1, PAIRS_AT_ONCE // len(mine))
    own_label = forest.labels(residents.label)
    for lo in range(0, len(theirs), step):
        label, size = forest.labels(visitors.label[lo : lo + step])[:, None], visitors.size[lo : lo + step, None]
        small, large = np.minimum(size, residents.size), np.maximum(size, residents.size)
        v, r = np.nonzero((label != own_label) & (100 * small >= rule.hundredths * large))
        for a, b in ((theirs_first, mine_first), (theirs, mine)):
            x, y = size[v, 0], residents.size[r]
            hit = rule.similar(np.minimum(np.minimum(x, y), _most_overlap(a[lo + v], b[r], x, y)), x, y)
            v, r = v[hit], r[hit]
        v = lo + v
        if residents.sets is not None:
            v, r = forest.linked(visitors, residents, v, r)
            own_label = forest.labels(residents.label) if len(v) else own_label
        yield visitors.node[v], residents.node[r]


def _exact(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hit = np.zeros(batch.num_rows, dtype=bool)
        for i, (x, y) in enumerate(zip(batch.column("set_a"), batch.column("set_b"), strict=True)):
            hit[i] = _overlaps(*(np.frombuffer(s.as_buffer(), dtype=np.uint64) for s in (x, y)), rule)
        yield batch.select(["a", "b"]).filter(pa.array(hit))


def _whole_sets(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, part in slices(batch.column("text")):
            yield pa.RecordBatch.from_arrays([batch.column("node").slice(lo, len(part)), pa.array([h.tobytes() for h in rule.sets(part)], pa.binary())], names=["node", "set"])


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("row_key"), F.col("text").cast("string").alias("text"))


def _own_key() -> Column:
    """A row's key that its copies do not share, unless they have its id too."""
    return F.xxhash64("doc_id", "row_key")


def signatures(docs: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """doc_id, row_key (a hash of the text), node, size, bitmap: one row per document; and bucket, n over all documents."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id array<{kind}>, row_key array<long>, node array<long>, size array<long>, bitmap array<binary>, held array<int>, count array<long>"
    signed = stage(map_arrow(_texts(docs), lambda b: _sign(b, rule), schema), "jaccard-signed")
    rows = signed.select(F.explode(F.arrays_zip("doc_id", "row_key", "node", "size", "bitmap")).alias("x")).select("x.*")
    return rows, signed.select(F.explode(F.arrays_zip("held", "count")).alias("x")).groupBy(F.col("x.held").alias("bucket")).agg(F.sum("x.count").alias("n"))


class _Links:
    """Pairs that were decided, and the links among them."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, rule: Rule) -> None:
        self.docs, self.nodes, self.rule = docs, nodes, rule
        self.tested: DataFrame | None = None
        self.found: DataFrame | None = None

    def decide(self, pairs: DataFrame) -> bool:
        """Pairs that may link, each decided once; whether there were any new ones."""
        pairs = pairs.distinct()
        pairs = stage(pairs if self.tested is None else pairs.join(self.tested, ["a", "b"], "left_anti"), "jaccard-pairs")
        if pairs.isEmpty():
            return False
        self.tested = pairs if self.tested is None else self.tested.unionByName(pairs)
        rule = self.rule
        sets = self.sets(pairs.select(F.explode(F.array("a", "b")).alias("node")))
        a, b = (sets.select(F.col("node").alias(c), F.col("set").alias(f"set_{c}")) for c in ("a", "b"))
        self.add(map_arrow(pairs.join(a, "a").join(b, "b").select("a", "b", "set_a", "set_b"), lambda x: _exact(x, rule), "a long, b long"))
        return True

    def sets(self, nodes: DataFrame) -> DataFrame:
        """node, set for each of the nodes, from a text that has it."""
        wanted = nodes.distinct().join(self.nodes.select("node", "own_key"), "node")
        texts = _texts(self.docs).withColumn("own_key", _own_key()).join(wanted, "own_key").select("node", "text")
        rule = self.rule
        return stage(map_arrow(texts, lambda b: _whole_sets(b, rule), "node long, set binary").dropDuplicates(["node"]), "jaccard-sets")

    def add(self, links: DataFrame) -> None:
        found = stage(links, "jaccard-links")
        self.found = found if self.found is None else self.found.unionByName(found)


def _open(members: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """tile, node, label of all members; and tile, size of the tiles of three nodes or more whose labels differ. Of tiles of the same nodes (by 128 bits of hashes, least and greatest) one is enough."""
    labelled = stage(members.select("tile", "node").join(roots, "node", "left").select("tile", "node", F.coalesce("root", "node").alias("label")), "jaccard-labelled")
    same = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"h{i}") for i in range(2)] + [F.min("node").alias("first"), F.max("node").alias("last")]
    tiles = labelled.groupBy("tile").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.count("*").alias("size"), *same).filter("least < most and size > 2")
    return labelled, stage(tiles.groupBy("h0", "h1", "first", "last", "size").agg(F.min("tile").alias("tile")).select("tile", "size"), "jaccard-open")


def _in_cells(members: DataFrame, tiles: DataFrame, nodes: DataFrame, rule: Rule) -> DataFrame:
    """a, b: what _tile_pairs finds in the tiles. nodes: node, size, and bitmap or set."""
    rows = members.join(tiles.select("tile", "cells"), "tile").join(nodes, "node")
    own, other = F.pmod(F.xxhash64("node"), F.col("cells")).cast("int"), F.col("other")
    held = ["node", "label", *(c for c in nodes.columns if c != "node")]
    rows = rows.select("tile", *held, own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("other"))
    cells = rows.select("tile", F.least("own", other).alias("i"), F.greatest("own", other).alias("j"), (F.col("own") > other).alias("visits"), *held)
    return map_arrow(cells.repartition("tile", "i", "j").sortWithinPartitions("tile", "i", "j", "visits"), lambda x: _tile_pairs(x, rule), "a long, b long")


def link(docs: DataFrame, rule: Rule = Rule(), stars: int = STARS, likely: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """The signatures of docs, and node, root for each node that has links. stars: rounds in which the nodes of a tile are compared with one of them, before all are with all. likely: pairs a < b of nodes, found in another way from the signatures, that are decided first."""
    signed, buckets = signatures(docs, rule)
    with scratch(docs.sparkSession):
        return signed, stage(_roots(docs, signed, buckets, rule, stars, likely), "jaccard-roots", outer=True)


def _roots(docs: DataFrame, signed: DataFrame, buckets: DataFrame, rule: Rule, stars: int, likely: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    """node, root for each node that has links; its tables are scratch."""
    nodes = stage(signed.filter("size > 0").groupBy("node").agg(F.min(F.struct(_own_key().alias("own_key"), "size", "bitmap")).alias("x")).select("node", "x.*"), "jaccard-nodes")
    counts = buckets.toArrow()  # BUCKETS rows at most
    common = np.zeros(BUCKETS, dtype=np.int64)
    common[counts.column("bucket").to_numpy()] = counts.column("n").to_numpy()
    sent = docs.sparkSession.sparkContext.broadcast(common)
    # Postings are the largest of the tables, so they go first.
    with scratch(docs.sparkSession):
        postings = stage(map_arrow(_texts(docs).select("text"), lambda b: _postings(b, rule, sent), "tile long, node long"), "jaccard-postings")
        # Most tiles have one row. Of those left, some have one node: equal sets from several tasks.
        several = postings.groupBy("tile").agg(F.count("*").alias("n")).filter("n > 1").select("tile")
        shared = stage(postings.join(several, "tile").distinct(), "jaccard-shared")
        tiles = shared.groupBy("tile").agg(F.min("node").alias("centre"), F.max("node").alias("last")).filter("centre < last").select("tile", "centre")
        members = stage(shared.join(tiles, "tile"), "jaccard-members", outer=True)

    links = _Links(docs, nodes, rule)
    if likely is not None:
        links.decide(likely(signed))
    mapped = lambda c: nodes.select(F.col("node").alias(c), F.col("size").alias(f"size_{c}"), F.col("bitmap").alias(f"map_{c}"))
    pairs = members.filter("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    links.decide(map_arrow(pairs.join(mapped("a"), "a").join(mapped("b"), "b"), lambda x: _maybe(x, rule), "a long, b long"))
    roots = components(links.found) if links.found is not None else members.select("node", F.col("node").alias("root")).limit(0)
    labelled, open_tiles = _open(members, roots)
    for _ in range(1, stars):
        # Tiles of two nodes are done with. Of others, the node that meets most is likely the text that the rest was made from.
        at = labelled.join(open_tiles, "tile")
        at = at.select("tile", "node", "label").join(at.groupBy("node").agg(F.sum("size").alias("met")), "node")
        centres = at.groupBy("tile").agg(F.max(F.struct("met", "node", "label")).alias("c")).select("tile", F.col("c.node").alias("centre"), F.col("c.label").alias("centre_label"))
        pairs = labelled.join(centres, "tile").filter("label <> centre_label").select(F.least("centre", "node").alias("a"), F.greatest("centre", "node").alias("b")).distinct()
        if links.decide(map_arrow(pairs.join(mapped("a"), "a").join(mapped("b"), "b"), lambda x: _maybe(x, rule), "a long, b long")):
            roots = components(links.found)
            labelled, open_tiles = _open(members, roots)
    # What hot tiles link joins labels first, so that small ones have less left to compare.
    hot = stage(open_tiles.filter(F.col("size") > HOT).select("tile"), "jaccard-hot")
    if not hot.isEmpty():
        at = stage(labelled.join(hot, "tile"), "jaccard-hot-members")
        sized = at.join(nodes.select("node", "size"), "node").groupBy("tile").agg(F.count("*").alias("n"), F.sum("size").alias("shingles"))
        cells = sized.select("tile", F.greatest(F.ceil(F.col("n") / CELL), F.ceil(F.col("shingles") * 8 / CELL_BYTES)).cast("int").alias("cells"))
        links.add(_in_cells(at, cells, links.sets(at.select("node")).withColumn("size", (F.octet_length("set") / 8).cast("long")), rule))
        roots = components(links.found)
        labelled, open_tiles = _open(members.join(hot, "tile", "left_anti"), roots)
    cells = open_tiles.select("tile", F.ceil(F.col("size") / CELL).cast("int").alias("cells"))
    pairs = _in_cells(labelled, cells, nodes.select("node", "size", "bitmap"), rule)
    return components(links.found) if links.decide(pairs) else roots


def near_duplicates(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """doc_id, row_key, size, component_id, component_key: one row per document; the key is unique to a component and null for an empty set."""
    signed, roots = link(docs, rule)
    sets = signed.groupBy("node").agg(F.min("doc_id").alias("least"), F.max("size").alias("size"), F.count("*").alias("n_docs"))
    sets = stage(sets.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "jaccard-sets")
    least = sets.groupBy("root").agg(F.min("least").alias("component_id"))
    table = sets.join(least, "root").select("node", "n_docs", "root", "component_id")
    rows = join_hot(signed.select("doc_id", "row_key", "node", "size"), stage(table, "jaccard-components"), "node", "n_docs", F.struct("doc_id", "row_key"))
    some = F.col("size") > 0
    return rows.select("doc_id", "row_key", "size", F.when(some, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.when(some, F.col("root")).alias("component_key"))


def query(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.col("size").alias("n_shingles"), "component_id")


#: Pairs by the shingles that two rows share, then all rows that each can reach.
ORACLE_SQL = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS row_no, doc_id, coalesce(regexp_extract_all(translate(text, '{UPPER}', '{UPPER.lower()}'), '{SPACED_WORD}'), []) AS w FROM documents),
s AS (SELECT DISTINCT row_no, w[i : i + 3] AS g FROM (SELECT row_no, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT row_no, count(*) AS size FROM s GROUP BY 1),
p AS (SELECT a.row_no AS a, b.row_no AS b, count(*) AS n FROM s a JOIN s b ON a.g = b.g AND a.row_no <> b.row_no GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.row_no = a JOIN n y ON y.row_no = b WHERE 100 * p.n >= 85 * (x.size + y.size - p.n)),
r AS (SELECT row_no, row_no AS at FROM d UNION SELECT r.row_no, e.b FROM r JOIN e ON e.a = r.at)
SELECT d.doc_id, coalesce(any_value(n.size), 0)::bigint AS n_shingles, min(o.doc_id) AS component_id
FROM d JOIN r USING (row_no) JOIN d o ON o.row_no = r.at LEFT JOIN n ON n.row_no = d.row_no GROUP BY d.row_no, d.doc_id
"""
