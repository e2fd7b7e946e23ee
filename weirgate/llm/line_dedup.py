"""Operator 8: repeated runs of lines, by a suffix array over line ids and distributed prefix doubling.

A document is the sequence of its lines that hold a word; lines that occur once part it into segments. Lines get ranks in the
order of their ids, then runs of 2, 4, 8 ... lines from every place, or of fewer up to the segment's end, get the rank of
their pair of half runs: prefix doubling, one range-partitioned sort of the distinct pairs a round. Rounds end when no run
within its segment is shared, so that the last ranks are the order of all suffixes. Each suffix's longest common prefix with the one before
it in that order is found from the longest runs to the shortest: where both have one of equal rank, the prefix grows by
it. A run counts if it holds MIN_WORDS words; suffixes whose common prefixes hold the shortest run that counts form
an interval. All but its first place, by doc_id and line, are later copies. What later copies cover is
deleted; overlapping copies together make up the maximal repeated runs.

Only DataFrame functions. No window spans more than one document; counts and minima combine before the
shuffle; hot lines meet only in joins, which adaptive execution splits.

Nulls: a null text has no lines and stays null. Null ids come last, so their copies are the later ones.
Repeated rows are copies of each other: one stays as it is. Lines that hold no word neither count nor part a
run; they stay. Empty tables give empty results. Of rows with one id and text the one whose whole row has the least
hash is the first. A very long text is one row; its lines are exploded, so its runs spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirgate.llm.shared import SPACED_WORD, packed, stage
from weirgate.materialize import scratch
from weirgate.operators.ordinal import lagged, running, with_ordinal

MIN_WORDS = 25


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _worded(text: Column) -> Column:
    """Lines that hold a word, as (line, number of the line)."""
    return F.filter(F.transform(_lines(text), lambda x, i: F.struct(x.alias("line"), i.alias("line_no"))), lambda s: s["line"].rlike(SPACED_WORD))


def ranked(keys: DataFrame, name: str) -> DataFrame:
    """keys with `rank`, a long in the order of all of keys' columns. The ids of sorted range partitions keep that order."""
    columns = keys.columns
    return stage(keys.repartitionByRange(*columns).sortWithinPartitions(*columns).withColumn("rank", F.monotonically_increasing_id()), name)


def repeated_lines(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Places of lines that occur more than once: doc, idx, line_no, words, r0; and doc's doc_id and row_key."""
    placed = docs.select("doc_id", F.xxhash64("text").alias("row_key"), F.posexplode(_worded(F.col("text").cast("string"))).alias("idx", "l"))
    line = F.col("l.line")
    placed = placed.select("doc_id", "row_key", "idx", "l.line_no", F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2"), F.regexp_count(line, F.lit(SPACED_WORD)).alias("words"))
    placed = stage(placed, "lines")
    ids = ranked(placed.groupBy("h1", "h2").count().filter("count > 1").select("h1", "h2"), "line-ids")
    kept = stage(placed.join(ids.withColumnRenamed("rank", "r0"), ["h1", "h2"]).select(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key", "idx", "line_no", "words", "r0").distinct(), "lines-repeated")
    order = ranked(kept.select("no_id", "doc_id", "row_key").distinct(), "line-docs").withColumnRenamed("rank", "doc")
    numbered = order.select("doc", F.col("doc_id").alias("of_id"), F.col("row_key").alias("of_key"))
    places = kept.join(numbered, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("row_key") == F.col("of_key"))).select("doc", "idx", "line_no", "words", "r0")
    return places, order.select("doc", "doc_id", "row_key")


def shortest_runs(places: DataFrame, min_words: int) -> DataFrame:
    """Adds size: the fewest lines from a place, all repeated ones, that hold min_words words; null if there are none."""
    by_line = Window.partitionBy("doc").orderBy("idx")
    before = F.coalesce(F.sum("words").over(by_line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ahead = Window.partitionBy("doc").orderBy("before").rangeBetween(0, min_words - 1)
    run = F.struct(F.count("*").over(ahead).alias("n"), F.max("idx").over(ahead).alias("last"), F.max(F.col("before") + F.col("words")).over(ahead).alias("upto"))
    found = places.withColumn("before", before).withColumn("run", run)
    whole = (F.col("run.upto") - F.col("before") >= min_words) & (F.col("run.last") - F.col("idx") + 1 == F.col("run.n"))
    return found.withColumn("size", F.when(whole, F.col("run.n").cast("int"))).drop("before", "run")


def doubled(ranks: DataFrame, level: int) -> DataFrame:
    """doc, idx, rank, whole of the runs of 2 ** (level + 1) lines from each place, of those of half as many; whole: the segment has so many."""
    reach = 1 << level
    by_line = Window.partitionBy("doc").orderBy("idx")
    on = lambda n, c: F.when(F.lead("idx", n).over(by_line) == F.col("idx") + n, F.lead(c, n).over(by_line))
    paired = ranks.select("doc", "idx", F.col("rank").alias("a"), F.coalesce(on(reach, "rank"), F.lit(-1)).alias("b"), on(2 * reach - 1, "idx").isNotNull().alias("whole"))
    paired = stage(paired, "lines-paired")
    pairs = ranked(paired.select("a", "b").distinct(), f"line-runs-{level}")
    return stage(paired.join(pairs, ["a", "b"]).select("doc", "idx", "rank", "whole"), "lines-doubled")


def suffix_ranks(places: DataFrame) -> list[DataFrame]:
    """Ranks by level, 2 ** level lines each; the last are the order of the suffixes, equal ones together."""
    levels = [places.select("doc", "idx", F.col("r0").alias("rank"), F.lit(True).alias("whole"))]
    while not levels[-1].filter("whole").groupBy("rank").count().filter("count > 1").isEmpty():
        levels.append(doubled(levels[-1], len(levels) - 1))
    return levels


def common_prefixes(places: DataFrame) -> DataFrame:
    """places in the order of their suffixes, with `at` from 0, its `part`, and lcp: the lines of the longest common prefix with the suffix before; null on the first, and for places without a size."""
    levels = suffix_ranks(places)
    ordered = places.join(levels[-1].select("doc", "idx", "rank"), ["doc", "idx"]).select("doc", "idx", "size", "rank")
    ordered = with_ordinal(ordered, [F.col(c) for c in ("rank", "doc", "idx")], "at", keep=True).withColumn("here", F.struct("doc", "idx"))
    ordered = stage(lagged(ordered, "here", "at", "above").drop("here", "rank"), "line-suffixes")
    pairs = ordered.filter("size is not null and above is not null").select("at", "doc", "idx", F.col("above.doc").alias("doc_2"), F.col("above.idx").alias("idx_2"), F.lit(0).alias("lcp"))
    for level in reversed(range(len(levels))):
        runs = levels[level].filter("whole")
        first, second = (runs.select(F.col("doc").alias(f"d{i}"), F.col("idx").alias(f"i{i}"), F.col("rank").alias(f"k{i}")) for i in (1, 2))
        met = pairs.join(first, (F.col("doc") == F.col("d1")) & (F.col("idx") + F.col("lcp") == F.col("i1")), "left")
        met = met.join(second, (F.col("doc_2") == F.col("d2")) & (F.col("idx_2") + F.col("lcp") == F.col("i2")), "left")
        longer = F.col("lcp") + F.when(F.col("k1") == F.col("k2"), 1 << level).otherwise(0)
        pairs = stage(met.select("at", "doc", "idx", "doc_2", "idx_2", longer.alias("lcp")), "line-prefixes")
    return ordered.drop("above").join(pairs.select("at", "lcp"), "at", "left")


def later_copies(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, row_key, lines: the numbers of the lines of each document that a later copy covers. A table; those on the way go."""
    with scratch(docs.sparkSession):
        return stage(_later_copies(docs, min_words), "line-later", outer=True)


def _later_copies(docs: DataFrame, min_words: int) -> DataFrame:
    places, order = repeated_lines(docs)
    places = stage(shortest_runs(places, min_words), "lines-sized")
    # An interval begins where the common prefix does not hold the shortest run that counts.
    begins = F.when(F.coalesce(F.col("lcp") >= F.col("size"), F.lit(False)), F.lit(None)).otherwise(F.col("at"))
    found = stage(common_prefixes(places).withColumn("begins", begins), "line-intervals")
    runs = stage(running(found, "begins", "at", "interval", most=True).filter("size is not null").select("doc", "idx", "size", "interval"), "line-runs")
    first = runs.groupBy(F.col("interval").alias("of")).agg(F.min(F.struct("doc", "idx")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    # A table, so that the join reads two plain shuffles, whose hot keys adaptive execution can split.
    first = stage(first, "line-firsts")
    later = runs.join(first, F.col("interval") == F.col("of")).filter(F.struct("doc", "idx") != F.col("first"))
    covered = later.select("doc", F.explode(F.sequence(F.col("idx"), F.col("idx") + F.col("size") - 1)).alias("idx")).distinct()
    covered = covered.join(places.select("doc", "idx", "line_no"), ["doc", "idx"]).groupBy("doc").agg(F.collect_list("line_no").alias("lines"))
    return covered.join(order, "doc").select("doc_id", "row_key", "lines")


def _deduped(docs: DataFrame, min_words: int) -> DataFrame:
    """packed, kept (the text with the lines that stay), before and deleted: one row per document."""
    # A null id is a key like any other inside of a struct. Window and join have the same keys, so texts are shuffled once.
    key = F.struct("doc_id").alias("key")
    copies = later_copies(docs, min_words).select(key, "row_key", F.col("lines").alias("copy_lines"))
    # Of rows that are wholly equal in id and text, all but one lose every run that counts.
    nth = F.row_number().over(Window.partitionBy("key", "row_key").orderBy(F.xxhash64("packed")))
    joined = packed(docs).select(key, "row_key", "packed").withColumn("nth", nth).join(copies, ["key", "row_key"], "left")
    text = F.col("packed.text").cast("string")
    worded = F.transform(_worded(text), lambda s: s["line_no"])
    again = (F.col("nth") > 1) & (F.regexp_count(text, F.lit(SPACED_WORD)) >= min_words)
    none = F.array().cast("array<int>")
    gone = F.when(text.isNull(), none).when(again, worded).otherwise(F.coalesce("copy_lines", none))
    stay = F.array_except(F.sequence(F.lit(0), F.size(_lines(text)) - 1), F.col("gone"))
    left = F.when(F.size("gone") == 0, text).otherwise(F.array_join(F.transform(stay, lambda i: F.get(F.col("lines"), i)), "\n"))
    joined = joined.withColumn("gone", gone).withColumn("lines", _lines(text))
    return joined.select("packed", left.alias("kept"), F.coalesce(F.size(worded), F.lit(0)).alias("before"), F.size("gone").alias("deleted"))


def _unpacked(docs: DataFrame) -> list[Column]:
    return [F.col("kept").alias(c) if c == "text" else F.col("packed").getField(c).alias(c) for c in docs.columns]


def dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs' columns with the lines that stay in `text`, and lines_before, lines_deleted, which take the place of columns of those names; rows that stay as they are included."""
    plain = docs.drop("lines_before", "lines_deleted")
    return _deduped(plain, min_words).select(*_unpacked(plain), F.col("before").alias("lines_before"), F.col("deleted").alias("lines_deleted"))


def keep_new(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents without later copies of runs; one that loses its last line goes."""
    return _deduped(docs, min_words).filter("deleted = 0 or deleted < before").select(*_unpacked(docs))


def query(spark, sf_dir: str) -> DataFrame:
    found = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", F.col("lines_before").cast("long").alias("n_lines"), F.col("lines_deleted").cast("long").alias("n_deleted"), F.sha2("text", 256).alias("kept_sha256"))


ORACLE_SQL = rf"""
WITH d AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS all_lines,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{SPACED_WORD}')) AS worded
  FROM documents),
l AS (
  SELECT doc_id, i, len(regexp_extract_all(worded[i], '{SPACED_WORD}')) AS words
  FROM (SELECT doc_id, worded, unnest(range(1, len(worded) + 1)) AS i FROM d)),
c AS (SELECT doc_id, i, sum(words) OVER (PARTITION BY doc_id ORDER BY i) AS upto, sum(words) OVER (PARTITION BY doc_id ORDER BY i) - words + {MIN_WORDS} AS need FROM l),
e AS (SELECT a.doc_id, a.i, b.i AS last FROM c a ASOF JOIN c b ON a.doc_id = b.doc_id AND a.need <= b.upto),
k AS (SELECT e.doc_id, e.i, e.last, sha256(array_to_string(d.worded[e.i:e.last], chr(10))) AS run FROM e JOIN d ON e.doc_id = d.doc_id),
n AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, i) AS nth FROM k),
g AS (SELECT DISTINCT doc_id, unnest(range(i, last + 1)) AS i FROM n WHERE nth > 1),
w AS (SELECT doc_id, j, row_number() OVER (PARTITION BY doc_id ORDER BY j) AS i
      FROM (SELECT doc_id, all_lines, unnest(range(1, len(all_lines) + 1)) AS j FROM d) WHERE regexp_matches(all_lines[j], '{SPACED_WORD}')),
x AS (SELECT w.doc_id, list(w.j) AS gone FROM g JOIN w ON g.doc_id = w.doc_id AND g.i = w.i GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(len(worded), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(x.gone), 0) AS BIGINT) AS n_deleted,
       sha256(CASE WHEN x.gone IS NULL THEN text ELSE array_to_string(list_transform(list_filter(range(1, len(all_lines) + 1), lambda j: NOT list_contains(x.gone, j)), lambda j: all_lines[j]), chr(10)) END) AS kept_sha256
FROM d LEFT JOIN x ON d.doc_id = x.doc_id
"""
