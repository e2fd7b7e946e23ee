"""Operator 13: ranked lexical search as a blocked sparse matrix product.

Items are rows of one sparse matrix, documents columns of the other: an item's entry is its term's multiplicity (1 at most
in the query), a document's the term's impact, all 64-bit integers. Texts become postings of the items' terms once, as a table with a row for each slice of texts, together with the counts of
which N, L and every df are sums. Then slices are joined to blocks of about POSTINGS postings; the rows of a
block's matrix that an item's terms name are merged into the item's row of scores (Gustavson's row-wise product), and the
first k documents of each item leave the block. What a task has seen as an item's k-th best score keeps
lower ones from leaving later blocks. The last cut is made over all tasks.

Items go to the tasks in blocks of about ITEM_BYTES, some 10,000 items of 40 terms, so each broadcast is bounded by that, or by one
item's own terms. Each block of items reads the texts anew; beside the block's products with all documents
that is little. Terms are compared as text, not by hashes.

Nulls: a null text has no terms; a document with a null id ranks after all others of its score; items with a null
id are one item. Rows of one item_id are one item with the terms of all. Repeated rows of documents are documents of their own and
take a rank each. Items without a scoring document, and empty tables, give no rows. Very long texts are read whole, in a slice of
their own. Other columns of the tables are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirgate.llm.arrow_text import ALNUM, slices, split_words
from weirgate.llm.ranking import first_k
from weirgate.llm.shared import ALNUM_WORD, UPPER, map_arrow, stage

TOP = 50
#: The contract's constants: of the weight, of the impact, and of the length of a document against the mean.
WEIGHT, IMPACT, STEEP, FLAT, MEAN = 1000, 1_000_000_000, 1000, 20, 50
#: Bytes of a block of items: 16 for each of its entries, and the entry's term.
ITEM_BYTES = 1 << 24
#: Postings of a block of documents; scores and products that are held at once.
POSTINGS, SCORES_AT_ONCE, PRODUCTS_AT_ONCE = 1 << 21, 1 << 21, 1 << 21
SLICE = 1 << 20


def terms_of(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The terms of a null-free large_string array, as one array; document d has those of first[d]:first[d + 1]."""
    words = split_words(column, ALNUM)
    size = words.end - words.start
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    letters = words.low[ALNUM[words.low]]
    return pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(letters)]), words.first


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, part in slices(batch.column("text")):
            terms, first = terms_of(part)
            row = np.repeat(np.arange(len(part)), np.diff(first)) + lo
            yield pa.RecordBatch.from_arrays([batch.column("item_id").take(pa.array(row)), terms.cast(pa.string())], names=["item_id", "term"])


def _postings(batches: Iterator[pa.RecordBatch], vocabulary) -> Iterator[pa.RecordBatch]:
    """A row for each slice: ids, numbers of terms, postings (document of the slice, term, count) by document and term, and the slice's own counts."""
    known = pa.array(vocabulary.value, pa.large_string())
    for batch in batches:
        for lo, part in slices(batch.column("text"), SLICE):
            terms, first = terms_of(part)
            n = np.diff(first)
            found = pc.index_in(terms, known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            doc = np.repeat(np.arange(len(part)), n)
            pair, count = np.unique(doc[found >= 0] * len(known) + found[found >= 0], return_counts=True)
            doc, term = np.divmod(pair, max(1, len(known)))
            held, df = np.unique(term, return_counts=True)
            lists = lambda values, kind: pa.array([values], pa.list_(kind))
            ids = batch.column("doc_id").slice(lo, len(part))
            yield pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), lists(n, pa.int64()), lists(doc, pa.int32()), lists(term, pa.int32()), lists(count, pa.int32()), lists(held, pa.int32()), lists(df, pa.int64()), pa.array([int((n > 0).sum())]), pa.array([int(n.sum())])],
                names=["ids", "lengths", "doc", "term", "count", "held", "df", "some", "total"],
            )


def postings(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    schema = f"ids array<{kind}>, lengths array<long>, doc array<int>, term array<int>, count array<int>, held array<int>, df array<long>, some long, total long"
    return map_arrow(docs.select("doc_id", F.col("text").cast("string").alias("text")), lambda b: _postings(b, sent), schema)


def product(item_first: np.ndarray, item_term: np.ndarray, item_times: np.ndarray, term_first: np.ndarray, docs: np.ndarray, impacts: np.ndarray, n_docs: int) -> np.ndarray:
    """Rows of scores: item i has the terms item_term[item_first[i]:item_first[i + 1]], term t the documents docs[term_first[t]:term_first[t + 1]] with their impacts."""
    out = np.zeros((len(item_first) - 1) * n_docs, dtype=np.int64)
    row = np.repeat(np.arange(len(item_first) - 1), np.diff(item_first))
    size = np.diff(term_first)[item_term]
    ends = np.cumsum(size)
    lo = 0
    while lo < len(item_term):
        base = ends[lo] - size[lo]
        hi = max(lo + 1, int(np.searchsorted(ends, base + PRODUCTS_AT_ONCE, side="right")))
        n = size[lo:hi]
        at = np.repeat(term_first[item_term[lo:hi]] - (ends[lo:hi] - n - base), n) + np.arange(int(n.sum()))
        np.add.at(out, np.repeat(row[lo:hi] * n_docs, n) + docs[at], impacts[at] * np.repeat(item_times[lo:hi], n))
        lo = hi
    return out.reshape(-1, n_docs)


class _Blocks:
    """Joins slices to blocks and gives each item's first k documents of a block."""

    def __init__(self, item_ids: pa.Array, first: np.ndarray, term: np.ndarray, times: np.ndarray, weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> None:
        self.item_ids, self.first, self.term, self.times = item_ids, first, term, times
        self.weights, self.n_docs, self.n_terms, self.k = weights, n_docs, n_terms, k
        self.least = np.zeros(len(self.first) - 1, dtype=np.int64)
        self.parts, self.size = [], 0

    def add(self, batch: pa.RecordBatch, i: int) -> pa.RecordBatch | None:
        column = lambda c: batch.column(c)[i].values
        values = [column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("lengths", "doc", "term", "count")]
        self.parts.append((column("ids"), *values))
        self.size += len(values[1]) + len(values[0])
        return self.flush() if self.size >= POSTINGS else None

    def flush(self) -> pa.RecordBatch | None:
        if not self.parts:
            return None
        ids = pa.concat_arrays([p[0] for p in self.parts])
        start = np.cumsum([0, *(len(p[0]) for p in self.parts)])
        lengths, term, count = (np.concatenate([p[k] for p in self.parts]) for k in (1, 3, 4))
        doc = np.concatenate([p[2] + s for p, s in zip(self.parts, start, strict=False)])
        self.parts, self.size = [], 0
        # Documents in the order of their ids, so that a lower place breaks ties.
        by_id = pc.sort_indices(ids, null_placement="at_end").to_numpy()
        place = np.empty(len(ids), dtype=np.int64)
        place[by_id] = np.arange(len(ids))
        rest = 100 - MEAN + MEAN * lengths[doc] * self.n_docs // self.n_terms
        impact = self.weights[term] * (IMPACT * count // (STEEP * count + FLAT * rest))
        order = np.argsort(term, kind="stable")
        term_first = np.searchsorted(term[order], np.arange(len(self.weights) + 1))
        return self.best(ids, by_id, term_first, place[doc[order]], impact[order])

    def best(self, ids: pa.Array, by_id: np.ndarray, term_first: np.ndarray, docs: np.ndarray, impacts: np.ndarray) -> pa.RecordBatch:
        items, places, values = [], [], []
        step = max(1, SCORES_AT_ONCE // len(ids))
        for lo in range(0, len(self.first) - 1, step):
            first = self.first[lo : lo + step + 1]
            scores = product(first - first[0], self.term[first[0] : first[-1]], self.times[first[0] : first[-1]], term_first, docs, impacts, len(ids))
            for i, row in enumerate(scores, lo):
                found = np.flatnonzero((row > 0) & (row >= self.least[i]))
                found = found[np.lexsort((found, -row[found]))][: self.k]
                if len(found) == self.k:
                    self.least[i] = row[found[-1]]
                items.append(np.full(len(found), i))
                places.append(found)
                values.append(row[found])
        items, places, values = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (items, places, values))
        return pa.RecordBatch.from_arrays([self.item_ids.take(pa.array(items)), ids.take(pa.array(by_id[places])), pa.array(values)], names=["item_id", "doc_id", "score"])


def _search(batches: Iterator[pa.RecordBatch], sent, n_docs: int, n_terms: int, k: int) -> Iterator[pa.RecordBatch]:
    blocks = _Blocks(*sent.value, n_docs, n_terms, k)
    for batch in batches:
        for i in range(batch.num_rows):
            if (found := blocks.add(batch, i)) is not None:
                yield found
    if (found := blocks.flush()) is not None:
        yield found


def weight(n_docs: int, df: int) -> int:
    """A term's weight by the number of documents that hold it; below zero for a term of over half of them."""
    return math.floor(WEIGHT * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _matrix(counted: pa.Table) -> tuple[pa.Array, list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Ids, vocabulary and the rows of the items' matrix."""
    ids = counted.column("item_id").combine_chunks().dictionary_encode(null_encoding="encode")
    terms = counted.column("term").combine_chunks().dictionary_encode()
    item, term = (x.indices.to_numpy(zero_copy_only=False).astype(np.int64) for x in (ids, terms))
    order = np.lexsort((term, item))
    first = np.searchsorted(item[order], np.arange(len(ids.dictionary) + 1))
    return ids.dictionary, terms.dictionary.to_pylist(), first, term[order], counted.column("times").to_numpy()[order]


def search(docs: DataFrame, items: DataFrame, k: int = TOP, repeats: bool = False) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: each item's k first documents with a score above 0. With repeats, a term counts as often as the item has it."""
    spark = docs.sparkSession
    kinds = {"item": items.schema["item_id"].dataType.simpleString(), "doc": docs.schema["doc_id"].dataType.simpleString()}
    read = map_arrow(items.select("item_id", F.col("text").cast("string").alias("text")), _item_terms, f"item_id {kinds['item']}, term string")
    counted = stage(read.groupBy("item_id", "term").agg((F.count("*") if repeats else F.max(F.lit(1))).cast("long").alias("times")), "search-terms")
    n_blocks = max(1, -(-(counted.agg(F.sum(F.octet_length("term") + 16)).first()[0] or 0) // ITEM_BYTES))
    found = []
    for block in range(n_blocks):
        ids, vocabulary, *matrix = _matrix(counted.filter(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == block).toArrow())
        parts = stage(postings(docs, vocabulary), "search-postings")
        sums = parts.agg(F.sum("some").alias("n"), F.sum("total").alias("l")).first()
        n_docs, n_terms = sums["n"] or 0, sums["l"] or 0
        df = parts.select(F.explode(F.arrays_zip("held", "df")).alias("x")).groupBy("x.held").agg(F.sum("x.df").alias("df")).toArrow()
        weights = np.zeros(len(vocabulary), dtype=np.int64)
        weights[df.column("held").to_numpy()] = [weight(n_docs, n) for n in df.column("df").to_pylist()]
        sent = spark.sparkContext.broadcast((ids, *matrix, weights))
        found.append(map_arrow(parts, lambda b, sent=sent, n=n_docs, t=n_terms: _search(b, sent, n, t, k), f"item_id {kinds['item']}, doc_id {kinds['doc']}, score long"))
    ranked = first_k(reduce(DataFrame.union, found), ["item_id"], [F.desc("score"), F.asc_nulls_last("doc_id")], k, F.col("doc_id"))
    return ranked.select("item_id", "rank", "doc_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return search(docs, benchmark)


_TERMS = f"coalesce(regexp_extract_all(translate(text, '{UPPER}', '{UPPER.lower()}'), '{ALNUM_WORD}'), [])"
ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row_no, doc_id, {_TERMS} AS w FROM documents),
g AS (SELECT count(*) AS n, sum(len(w))::bigint AS l FROM d WHERE len(w) > 0),
i AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
p AS (SELECT row_no, doc_id, n, term, count(*) AS tf FROM (SELECT row_no, doc_id, len(w) AS n, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY ALL),
f AS (SELECT term, floor({WEIGHT} * ln((2 * any_value(g.n) + 2) / (2 * count(*) + 1)))::bigint AS weight FROM p, g GROUP BY term),
s AS (SELECT item_id, row_no, doc_id, sum(weight * (({IMPACT} * tf) // ({STEEP} * tf + {FLAT} * (100 - {MEAN} + ({MEAN} * p.n * g.n) // g.l))))::bigint AS score
  FROM i JOIN p USING (term) JOIN f USING (term), g GROUP BY ALL)
SELECT item_id, (row_number() OVER w)::int AS rank, doc_id, score FROM s WHERE score > 0 WINDOW w AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER w <= {TOP}
"""
