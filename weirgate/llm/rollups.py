"""Operator 6: token counts as delta-maintained rollups.

A batch is a set of signed rows: +1 inserts a document's count, -1 takes one back, and a revised count is
one of each. A batch is summed by (source, lang, version) before the shuffle, written to a folder of its own, and
then renamed to its id, which never overwrites: of a retry, or of two drivers that commit one batch at once, the
first counts and the others change nothing. What broke off before its renaming is not read. Totals add up
the committed batches, and compact() folds them into one, keeping the ids it has folded.

The query counts by two versions of tokens: words between white space, and the subwords of a public
byte-level vocabulary, by which what is not English is counted anew.

Nulls: a null text has no tokens; null source and lang are keys of their own; a null sign or count adds
nothing. Repeated rows count each time. Groups whose documents and tokens are all taken back vanish from
the totals. Empty tables give empty batches, which are committed all the same.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weirgate import files
from weirgate.llm.arrow_text import slices
from weirgate.llm.shared import SPACED_WORD, join_hot, map_arrow, shared_dir, stage
from weirgate.llm.vocabulary import VOCABULARY, encoder

KEYS = ("source", "lang", "version")
SCHEMA = "source string, lang string, version string, docs long, tokens long"


def spaced(text: Column) -> Column:
    """Tokenizer version spaced-1: runs of anything but white space."""
    return F.coalesce(F.regexp_count(text, F.lit(SPACED_WORD)), F.lit(0)).cast("long")


def _subwords(batches: Iterator[pa.RecordBatch], vocabulary: str) -> Iterator[pa.RecordBatch]:
    encode = encoder(vocabulary).encode_ordinary
    for batch in batches:
        at = batch.schema.get_field_index("text")
        n = [len(encode(t)) for _, part in slices(batch.column(at)) for t in part.to_pylist()]
        yield pa.RecordBatch.from_arrays([*[c for i, c in enumerate(batch.columns) if i != at], pa.array(n, pa.int64())], names=[*[c for c in batch.schema.names if c != "text"], "tokens"])


def subword_counts(docs: DataFrame, keep: list[str], vocabulary: str = VOCABULARY) -> DataFrame:
    """`keep` columns and the number of byte-level BPE tokens of each whole text."""
    rows = docs.select(*keep, F.col("text").cast("string").alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    return map_arrow(rows, lambda b: _subwords(b, vocabulary), f"{schema}, tokens long")


class Rollup:
    """Additive totals in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def committed(self) -> list[str]:
        """Ids of the batches, folded ones included."""
        parts = self._parts()
        folded = [x for p in parts if p.startswith("fold-") for x in self._folded(p)]
        return sorted({*folded, *(p.removeprefix("batch-") for p in parts if p.startswith("batch-"))})

    def _folded(self, fold: str) -> list[str]:
        """Ids of a fold: one file, as long as there are batches."""
        return [r["value"] for r in self.spark.read.text(f"{self.folder}/{fold}/ids").collect()]

    def _parts(self) -> list[str]:
        """Folders to add up: the last fold and the batches outside it."""
        names = files.names(self.spark, self.folder)
        folds = [n for n in names if n.startswith("fold-")]
        gone = set(self._folded(folds[-1])) if folds else set()
        return [*folds[-1:], *(n for n in names if n.startswith("batch-") and n.removeprefix("batch-") not in gone)]

    def commit(self, batch: str, deltas: DataFrame) -> bool:
        """deltas: source, lang, version, sign, tokens. False if the batch was committed before."""
        if batch in self.committed():
            return False
        sign = F.coalesce("sign", F.lit(0)).cast("long")
        summed = deltas.groupBy(*[F.col(k).cast("string").alias(k) for k in KEYS]).agg(F.sum(sign).alias("docs"), F.sum(sign * F.coalesce("tokens", F.lit(0)).cast("long")).alias("tokens"))
        draft = f"{self.folder}/.draft-{uuid.uuid4().hex}"
        summed.write.parquet(f"{draft}/sums")
        if files.moved(self.spark, draft, f"{self.folder}/batch-{batch}"):
            return True
        files.removed(self.spark, draft)
        return False

    def totals(self) -> DataFrame:
        parts = self._parts()
        if not parts:
            return self.spark.createDataFrame([], SCHEMA)
        all_rows = self.spark.read.schema(SCHEMA).parquet(*[f"{self.folder}/{p}/sums" for p in parts])
        return all_rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).filter("docs <> 0 or tokens <> 0")

    def compact(self) -> None:
        """Fold the batches so far into one folder, with the list of their ids. Folds are numbered by what they hold, so a later one has more."""
        ids = self.committed()
        if not any(p.startswith("batch-") for p in self._parts()):
            return
        draft = f"{self.folder}/.draft-{uuid.uuid4().hex}"
        self.totals().write.parquet(f"{draft}/sums")
        self.spark.createDataFrame([(x,) for x in ids], "value string").coalesce(1).write.text(f"{draft}/ids")
        if not files.moved(self.spark, draft, f"{self.folder}/fold-{len(ids):012d}"):
            files.removed(self.spark, draft)


def signed(counts: DataFrame, sign: int, version: str, tokens: str) -> DataFrame:
    return counts.select("source", "lang", F.lit(version).alias("version"), F.lit(sign).alias("sign"), F.col(tokens).alias("tokens"))


def query(spark, sf_dir: str) -> DataFrame:
    """All documents come in; exact copies but the one of the smallest id go; what is not English is counted anew in subwords; the first batch is sent twice."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counts = stage(docs.select("doc_id", F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.md5("text").alias("digest"), spaced(F.col("text")).alias("spaced")), "counts")
    first = stage(counts.filter("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n_docs")), "counts-first")
    copy = join_hot(counts, first, "digest", "n_docs", F.col("doc_id")).withColumn("copy", F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False)))
    rollup = Rollup(spark, f"{shared_dir(spark)}/rollup-{uuid.uuid4().hex}")
    rollup.commit("load", signed(counts, 1, "spaced-1", "spaced"))
    rollup.commit("copies", signed(copy.filter("copy"), -1, "spaced-1", "spaced"))
    # Copies have one number of subwords, which is counted for the rows that stay alone.
    other = F.coalesce(F.col("lang") != "en", F.lit(False))
    stays = docs.select("doc_id", "source", "lang", "text", F.md5("text").alias("digest")).filter(other)
    stays = join_hot(stays, first, "digest", "n_docs", F.col("doc_id")).filter(~F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False)))
    old = copy.filter(~F.col("copy") & other).unionByName(counts.filter(F.col("digest").isNull() & other).withColumns({"first_id": F.lit(None), "copy": F.lit(False)}))
    new = subword_counts(stays, ["source", "lang"])
    none = signed(counts.filter(F.col("digest").isNull() & other), 1, "subwords-50k", "spaced")
    rollup.commit("revise", signed(old, -1, "spaced-1", "spaced").unionByName(signed(new, 1, "subwords-50k", "tokens")).unionByName(none))
    rollup.commit("load", signed(counts, 1, "spaced-1", "spaced"))
    return rollup.totals()


def words_query(spark, sf_dir: str) -> DataFrame:
    """The totals of the same batches by words alone, which SQL can express."""
    return query(spark, sf_dir).filter("version = 'spaced-1'")


WORDS_SQL = r"""
WITH counted AS (
    SELECT source, lang, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS n,
        coalesce(text IS NOT NULL AND doc_id > min(doc_id) OVER (PARTITION BY text), false) AS copy
    FROM documents
)
SELECT source, lang, 'spaced-1' AS version, count(*) AS docs, CAST(sum(n) AS BIGINT) AS tokens
FROM counted WHERE NOT copy AND NOT coalesce(lang <> 'en', false)
GROUP BY source, lang
"""
