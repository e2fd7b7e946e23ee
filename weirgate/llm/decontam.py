"""Operator 3: benchmark decontamination by winnowing.

A window is SPAN consecutive words of an item; an item of fewer words is one window. Fingerprints are the
minimum GRAM-word hashes of each run of SPAN - GRAM + 1 grams, so every shared span of SPAN words holds a
fingerprint that both sides select. Items of fewer words are fingerprinted by all of their grams of
their own length, which documents then show at every place, so nothing is missed.

Documents drop fingerprints that a Bloom filter of the benchmark's fingerprints lacks; its false positives are
removed by the join that follows. The filter has FILTER_SHARE bits or more for each benchmark window, up to
2 ** MOST_BITS bits; a benchmark with more windows than that serves goes in blocks of windows, each with a filter and
a pass over the documents of its own, so filters never fill up. Each fingerprint left is extended to the windows
around it, which join the benchmark's windows, word for word. A window that very many documents hold is a
skewed join key, which adaptive execution splits; one that very many items hold gives each document that has it
all of their ids, as the result needs them.

Nulls: a null text has no words; a null item_id counts as the empty text in items_sha256. Repeated rows of either table are rows of
their own in the result or one item id. Empty tables give no rows or no hits. Very long texts are read whole, in a row of Arrow each.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirgate.llm.arrow_text import ALNUM, Words, gram_hashes, mix, slices, split_words
from weirgate.llm.shared import ALNUM_WORD, map_arrow, packed, stage

SPAN = 10
GRAM = 5
FILTER_SHARE, FILTER_HASHES = 16, 3
#: The filter has 2 ** 16 bits at least and 2 ** 25 (4 MB) at most.
LEAST_BITS, MOST_BITS = 16, 25


def _in_doc(words: Words, k: int) -> np.ndarray:
    """Which places i have their k words in one document."""
    n = len(words.start) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=bool)
    doc = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    return doc[:n] == doc[k - 1 :]


def winnow(words: Words, hashes: np.ndarray, span: int = SPAN, gram: int = GRAM) -> np.ndarray:
    """Places of the selected grams: the rightmost minimum of every run of span - gram + 1 grams of a document."""
    grams = gram_hashes(hashes, gram)
    run = span - gram + 1
    whole = _in_doc(words, span)
    n = len(whole)
    if not n:
        return np.zeros(0, dtype=np.int64)
    best, at = grams[:n].copy(), np.arange(n)
    for j in range(1, run):
        better = grams[j : j + n] <= best
        best[better] = grams[j : j + n][better]
        at[better] = np.flatnonzero(better) + j
    return np.unique(at[whole])


def _positions(h: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """Places of each fingerprint in a filter of 2 ** bits bits."""
    step = mix(h ^ np.uint64(0x5851F42D4C957F2D)) | np.uint64(1)
    for i in range(FILTER_HASHES):
        yield ((h + np.uint64(i) * step) >> np.uint64(64 - bits)).astype(np.int64)


def _window_text(words: Words, raw: bytes, a: int, b: int) -> bytes:
    return b" ".join(raw[s:e] for s, e in zip(words.start[a:b].tolist(), words.end[a:b].tolist(), strict=True))


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of the items, and the fingerprints of each: filled in by _filter for its grams."""
    for batch in batches:
        ids = batch.column("item_id")
        for lo, part in slices(batch.column("text")):
            words = split_words(part, ALNUM)
            raw = words.low.tobytes()
            rows, windows, sizes = [], [], []
            for d, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)):
                n = min(SPAN, b - a)
                for i in range(a, b - n + 1) if n else ():
                    rows.append(lo + d)
                    windows.append(_window_text(words, raw, i, i + n))
                    sizes.append(n)
            if rows:
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), pa.array(windows, pa.binary()).cast(pa.string()), pa.array(sizes, pa.int64())], names=["item_id", "window", "size"])


def _bits(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Filter words (word, mask) of the fingerprints of a batch of distinct windows; grams of short windows are the whole of them."""
    for batch in batches:
        bits = np.zeros(1 << width, dtype=bool)
        sizes = batch.column("size").to_numpy(zero_copy_only=False)
        lengths = {n for n in sizes.tolist() if n < SPAN}
        for lo, part in slices(batch.column("window")):
            words = split_words(part, ALNUM)
            hashes = words.hashes()
            own = sizes[lo : lo + len(part)]
            for n in [*sorted(lengths), SPAN]:
                gram = gram_hashes(hashes, n if n < SPAN else GRAM)
                at = words.first[:-1][own == n] if n < SPAN else winnow(words, hashes)
                for p in _positions(gram[at], width):
                    bits[p] = True
        packed = np.packbits(bits, bitorder="little").view(np.int64)
        some = np.flatnonzero(packed)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(packed[some])], names=["word", "mask"])


def benchmark_filter(windows: DataFrame) -> tuple[np.ndarray, list[int]]:
    """The Bloom filter of distinct windows and the lengths of the short ones (under SPAN). The driver gets the filter's words, 4 MB of masks at most."""
    n = windows.count()
    width = min(MOST_BITS, max(LEAST_BITS, (n * FILTER_SHARE - 1).bit_length()))
    words = map_arrow(windows.select("window", "size"), lambda b: _bits(b, width), "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    packed = np.zeros((1 << width) // 64, dtype=np.int64)
    packed[words.column("word").to_numpy()] = words.column("mask").to_numpy()
    lengths = [r["size"] for r in windows.filter(F.col("size") < SPAN).select("size").distinct().collect()]
    return packed, sorted(lengths)


def _counts(batches: Iterator[pa.RecordBatch], found, lengths: list[int]) -> Iterator[pa.RecordBatch]:
    """One row per window of a document that may be a benchmark's: row_key, place, window; and per document its number of words (place -1)."""
    packed = found.value.view(np.uint64)
    width = (len(packed) * 64).bit_length() - 1

    def held(h: np.ndarray) -> np.ndarray:
        ok = np.ones(len(h), dtype=bool)
        for p in _positions(h, width):
            ok &= (packed[p >> 6] >> (p & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
        return ok

    for batch in batches:
        ids, keys = batch.column("doc_id"), batch.column("row_key")
        for lo, part in slices(batch.column("text")):
            words = split_words(part, ALNUM)
            raw = words.low.tobytes()
            hashes = words.hashes()
            doc = np.repeat(np.arange(len(part)), np.diff(words.first))
            n_doc = np.diff(words.first)
            rows, place, text = [np.arange(len(part))], [np.full(len(part), -1)], [""] * len(part)
            spans = []
            at = winnow(words, hashes)
            at = at[held(gram_hashes(hashes, GRAM)[at])]
            starts = np.unique((at[:, None] - np.arange(SPAN - GRAM + 1)).ravel())
            starts = starts[starts >= 0]
            spans.append((SPAN, starts[starts < max(0, len(hashes) - SPAN + 1)]))
            spans += [(n, np.flatnonzero(held(gram_hashes(hashes, n)))) for n in lengths]
            for n, starts in spans:
                starts = starts[_in_doc(words, n)[starts]] if len(starts) else starts
                rows.append(doc[starts])
                place.append(starts - words.first[:-1][doc[starts]])
                text += [_window_text(words, raw, a, a + n).decode() for a in starts.tolist()]
            rows, place = np.concatenate(rows), np.concatenate(place)
            take = pa.array(rows + lo)
            yield pa.RecordBatch.from_arrays([ids.take(take), keys.take(take), pa.array(n_doc[rows]), pa.array(place), pa.array(text, pa.string())], names=["doc_id", "row_key", "n_words", "place", "window"])


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, row_key, n_words, n_hit, n_items, items_sha256, contaminated: one row per distinct (doc_id, text), with `copies` of it."""
    spark = docs.sparkSession
    windows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("string").alias("text"))
    windows = stage(map_arrow(windows, _item_windows, "item_id string, window string, size long").distinct(), "bench-windows")
    known = stage(windows.select("window", "size").distinct(), "bench-distinct")
    blocks = max(1, -(-known.count() * FILTER_SHARE // (1 << MOST_BITS)))

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.xxhash64("text").alias("row_key"), F.col("text").cast("string").alias("text"))
    shown = []
    for block in range(blocks):
        packed, lengths = benchmark_filter(known.filter(F.pmod(F.xxhash64("window"), F.lit(blocks)) == block))
        found = spark.sparkContext.broadcast(packed)
        shown.append(stage(map_arrow(rows, lambda b, found=found, lengths=lengths: _counts(b, found, lengths), f"doc_id {kind}, row_key long, n_words long, place long, window string"), "bench-shown"))
    base = shown[0].filter("place < 0").groupBy("doc_id", "row_key", "n_words").agg(F.count("*").alias("copies"))

    # Windows that the benchmark has, each once; then the items of those, for each document that holds them.
    hits = reduce(DataFrame.union, shown).filter("place >= 0").select("doc_id", "row_key", "place", "window").distinct()
    hits = stage(hits.join(known, "window"), "bench-hits")
    items = hits.select("doc_id", "row_key", "window").distinct().join(windows.select("window", "item_id"), "window")
    items = items.select("doc_id", "row_key", "item_id").distinct().groupBy("doc_id", "row_key").agg(F.array_sort(F.collect_list("item_id")).alias("items"))
    words = hits.select("doc_id", "row_key", F.explode(F.sequence(F.col("place"), F.col("place") + F.col("size") - 1)).alias("word")).distinct().groupBy("doc_id", "row_key").agg(F.count("*").alias("n_hit"))
    found_rows = items.join(words, on=items.doc_id.eqNullSafe(words.doc_id) & (items.row_key == words.row_key)).select(items.doc_id.alias("hit_id"), items.row_key.alias("hit_key"), "items", "n_hit")
    joined = base.join(found_rows, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("row_key") == F.col("hit_key")), "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return joined.select(
        "doc_id", "row_key", "n_words", "copies",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a benchmark window."""
    bad = contamination(docs, benchmark).filter("contaminated").select(F.col("doc_id").alias("bad_id"), F.col("row_key").alias("bad_key"))
    return packed(docs).join(bad, F.col("doc_id").eqNullSafe(F.col("bad_id")) & (F.col("row_key") == F.col("bad_key")), "left_anti").select("packed.*")


def query(spark, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    found = contamination(docs, benchmark)
    return found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


#: Words by the contract; a window is the JSON text of its words.
ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS row_no, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{ALNUM_WORD}'), []) AS w FROM documents),
b AS (SELECT coalesce(item_id::varchar, '') AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{ALNUM_WORD}') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least({SPAN}, len(w)) AS size, w[i : i + least({SPAN}, len(w)) - 1] AS win FROM (SELECT item_id, w, unnest(range(1, greatest(0, len(w) - least({SPAN}, len(w)) + 1) + 1)) AS i FROM b WHERE len(w) > 0)),
k AS (SELECT DISTINCT size, win FROM bw),
p AS (SELECT row_no, w, unnest(range(1, len(w) + 1)) AS i FROM d),
h AS (SELECT p.row_no, p.i, k.size, k.win FROM (SELECT DISTINCT size FROM k) s JOIN p ON p.i + s.size - 1 <= len(p.w) JOIN k ON k.size = s.size AND k.win = p.w[p.i : p.i + s.size - 1]),
n AS (SELECT row_no, count(DISTINCT j) AS n_hit FROM (SELECT row_no, unnest(range(i, i + size)) AS j FROM h) GROUP BY 1),
t AS (SELECT row_no, list_sort(list(DISTINCT item_id)) AS items FROM (SELECT DISTINCT row_no, win FROM h) x JOIN bw ON bw.win = x.win GROUP BY 1)
SELECT d.doc_id, len(d.w)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit, coalesce(len(items), 0)::bigint AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN n ON n.row_no = d.row_no LEFT JOIN t ON t.row_no = d.row_no
"""
