"""Operator 2: language identification with bit-sliced Bloom filters of n-grams.

Learned: for each language its TOP most frequent character n-grams of each order, less those that are far
more frequent in another language. They fill one bit-sliced Bloom filter: row p of the slice matrix holds
one bit per language, so ANDing the rows of an n-gram's hashes gives all languages that contain it. A text
is decided by its per-language counts, less the false positives that each language's filter expects.

The classifier is fitted on a sample: PER_LANGUAGE labelled documents of each language in expectation,
chosen by a hash of the id. Prediction reads whole texts, nothing else, and shuffles nothing. The filter
has SLOTS rows whatever the corpus.

Nulls: a null text, or one without a letter, is `und` with score 0; a null lang is not learned from; a null
doc_id is held out only if crc32 of the empty text says so. Repeated rows each give a row. With no
labelled rows every prediction is `und`. Of languages that tie the first in code point order is predicted. An empty
table gives an empty result. A very long text is read whole, as one row of Arrow; extra columns are passed over.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weirgate.llm.arrow_text import mix, slices
from weirgate.llm.shared import bucket_of, map_arrow

FOLDS = 5
ORDERS = (3, 4)
PER_LANGUAGE = 2000
TOP = 4096
#: An n-gram is a language's only if it is there at least this share as frequent as in any other.
SHARE = 0.2
SLOTS_BITS = 17
HASHES = 3
#: A text is rejected if less than this share of its n-grams is in its own language's filter.
KNOWN = 0.05
_BASE = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(1)
def _lower() -> np.ndarray:
    """Lower case of each letter, a space for every other code point."""
    out = np.full(0x110000, 32, dtype=np.uint32)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def letters(part: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The words of each text, lower-cased, with one space around each, as code points; and where texts begin."""
    raw = b"".join(b" " + x + b" " for x in part.cast(pa.large_binary()).to_pylist())
    points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    points = _lower()[points]
    size = np.array([len(x) + 2 for x in part.to_pylist()], dtype=np.int64)
    first = np.concatenate([[0], np.cumsum(size)])
    keep = np.ones(len(points), dtype=bool)
    keep[1:] = (points[1:] != 32) | (points[:-1] != 32)
    keep[first[:-1]] = True
    return points[keep], np.concatenate([[0], np.cumsum(keep)])[first]


def grams(points: np.ndarray, first: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each n-gram, and its text's number."""
    n = len(points) - order + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.flatnonzero(doc[:n] == doc[order - 1 :])
    wide = points.astype(np.uint64)
    h = np.full(len(at), np.uint64(order))
    for i in range(order):
        h = h * _BASE + wide[at + i]
    return mix(h), doc[at]


def _slots(h: np.ndarray) -> Iterator[np.ndarray]:
    mask = np.uint64((1 << SLOTS_BITS) - 1)
    for i in range(HASHES):
        yield ((h >> np.uint64(i * SLOTS_BITS)) & mask).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), dtype=object)
        for lo, part in slices(batch.column("text")):
            points, first = letters(part)
            own = langs[lo : lo + len(part)]
            for order in ORDERS:
                h, doc = grams(points, first, order)
                for lang in sorted(set(own)):
                    found, n = np.unique(h[own[doc] == lang], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(found), pa.string()), pa.array(np.full(len(found), order)), pa.array(found.view(np.int64)), pa.array(n)], names=["lang", "order", "gram", "n"]
                    )


class Filter:
    """The slice matrix: slots x words of 64 languages each."""

    def __init__(self, langs: list[str], grams_of: list[np.ndarray]) -> None:
        self.langs = langs
        self.slots = np.zeros((1 << SLOTS_BITS, max(1, -(-len(langs) // 64))), dtype=np.uint64)
        self.false = np.zeros(len(langs))
        for i, h in enumerate(grams_of):
            bit = np.uint64(1) << np.uint64(i % 64)
            for p in _slots(h):
                self.slots[p, i // 64] |= bit
            self.false[i] = ((self.slots[:, i // 64] & bit) != 0).mean() ** HASHES

    def languages(self, h: np.ndarray) -> np.ndarray:
        """All languages that contain each n-gram, as bits."""
        out = None
        for p in _slots(h):
            out = self.slots[p] if out is None else out & self.slots[p]
        return out


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Filter:
    """docs: doc_id, text, lang; documents of fold 0 and those without lang are left out."""
    labelled = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (bucket_of(F.col("doc_id"), FOLDS) != 0))
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not counts:
        return Filter([], [])
    rate = F.create_map([F.lit(x) for lang, n in counts.items() for x in (lang, per_language / n)])
    sample = labelled.filter(F.pmod(F.xxhash64(F.lit("language sample"), "doc_id"), F.lit(1 << 30)) < rate[F.col("lang")] * (1 << 30))
    n = map_arrow(sample, _count, "lang string, order long, gram long, n long").groupBy("lang", "order", "gram").agg(F.sum("n").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("lang", "order"))
    most = F.max("share").over(Window.partitionBy("order", "gram"))
    rank = F.row_number().over(Window.partitionBy("lang", "order").orderBy(F.desc("n"), "gram"))
    top = n.withColumn("share", share).withColumn("most", most).filter(F.col("share") >= SHARE * F.col("most")).withColumn("rank", rank).filter(F.col("rank") <= TOP)
    langs = sorted(counts)
    found: dict[str, list[int]] = {lang: [] for lang in langs}
    for r in top.select("lang", "gram").collect():
        found[r["lang"]].append(r["gram"])
    return Filter(langs, [np.array(found[lang], dtype=np.int64).view(np.uint64) for lang in langs])


def decide(model: Filter, part: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and share of n-grams that the language knows, of each text of a null-free array."""
    points, first = letters(part)
    docs, langs = len(part), len(model.langs)
    hits, total = np.zeros((langs, docs)), np.zeros(docs)
    for order in ORDERS:
        h, doc = grams(points, first, order)
        if not len(h):
            continue
        total += np.bincount(doc, minlength=docs)
        masks = model.languages(h)
        for i in range(langs):
            hits[i] += np.bincount(doc, weights=(masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1), minlength=docs)
    lettered = total > 0
    if not langs:
        return ["und"] * docs, np.zeros(docs), np.zeros(docs)
    sure = np.maximum(0, (hits - total * model.false[:, None]) / (1 - model.false[:, None]))
    best = sure.argmax(axis=0)
    top = sure[best, np.arange(docs)]
    score = np.where(lettered, top / np.maximum(sure.sum(axis=0), 1e-9), 0.0)
    known = np.where(lettered, top / np.maximum(total, 1), 0.0)
    return [model.langs[b] if ok else "und" for b, ok in zip(best.tolist(), lettered.tolist(), strict=True)], np.minimum(score, 1.0), known


def _predict(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    model = shared.value
    for batch in batches:
        for lo, part in slices(batch.column("text")):
            lang, score, known = decide(model, part)
            rest = [batch.column(i).slice(lo, len(part)) for i in range(batch.num_columns) if batch.schema.names[i] != "text"]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(lang, pa.string()), pa.array(score), pa.array(known)], names=[*[c for c in batch.schema.names if c != "text"], "lang_pred", "score", "known"])


def identify(docs: DataFrame, model: Filter) -> DataFrame:
    """doc_id, held_out, lang_pred, score, known: one row per document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", (bucket_of(F.col("doc_id"), FOLDS) == 0).alias("held_out"), F.col("text").cast("string").alias("text"))
    return map_arrow(rows, lambda b: _predict(b, shared), f"doc_id {kind}, held_out boolean, lang_pred string, score double, known double")


def _accept(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    model = shared.value
    for batch in batches:
        for lo, part in slices(batch.column("text")):
            lang, _, known = decide(model, part)
            yield batch.slice(lo, len(part)).filter(pa.array([x != "und" and k >= KNOWN for x, k in zip(lang, known.tolist(), strict=True)]))


def keep_identified(docs: DataFrame, model: Filter) -> DataFrame:
    """The documents whose language is one of the learned ones: not `und`, and at least KNOWN of their n-grams known."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return map_arrow(docs, lambda b: _accept(b, shared), docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, learn(docs))
