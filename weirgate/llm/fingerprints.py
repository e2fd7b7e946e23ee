"""Operator 1: document fingerprints by winnowing, with DataFrame functions alone.

A text's words (runs of anything but white space) give GRAM-word hashes at every place. Of every RUN
neighbouring hashes the smallest is kept, the rightmost of equal ones, with its place. So two texts that
share GRAM + RUN - 1 words in a row share a kept hash. A text of fewer words than GRAM is one gram.

The order of hashes is that of their upper 32 bits. Everything is arrays inside a row, so a text is never
exploded or shuffled for its fingerprint. Neighbours in descending doc_id order come from one shuffle of the
texts: a sort of (doc_id, hash of the text) alone gives the keys that begin each of at most CUTS buckets,
of BUCKET documents or more (fewer where ids are so long that the keys would exceed CUT_BYTES); each bucket is sorted, and its first document is handed to the bucket above it.

Any orderable doc_id that JSON can carry will do: numbers, text, dates. Nulls: a null text counts as an empty
one, with an empty fingerprint; null ids come last. Rows of one id, or of none, are ordered by a hash of their
texts, so they spread over buckets like others; only rows of equal id and text share one. A table of one row is
its own next document; an empty one gives no rows. A very long text is one row: its arrays of words are held at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirgate.llm.shared import stage

GRAM = 3
RUN = 4
BUCKET = 64
CUTS, WIDE = 1 << 16, 16
#: The bytes that all keys of buckets may have in the plan; with long ids there are fewer, larger buckets.
CUT_BYTES = 1 << 24
#: Places are below this; hash and place fit a long.
PLACES = 1 << 31


def _from(array: Column | str, by: int) -> Column:
    """array without its first `by` elements."""
    array = F.col(array) if isinstance(array, str) else array
    return F.slice(array, F.lit(1 + by), F.greatest(F.lit(0), F.size(array) - by))


def with_marks(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds `out`: array of (hash, place) kept of column `text`, by place."""
    w, h, g, v, m = (f"{out}_{x}" for x in "whgvm")
    words = F.filter(F.split(F.col(text), r"[\x20\x09-\x0D]+"), lambda x: x != "")
    df = df.withColumn(w, words).withColumn(h, F.transform(w, lambda x: F.xxhash64(x)))
    # Hashes of GRAM words, folded from the left; the places at the end that have fewer words are cut off.
    grams = F.col(h)
    for by in range(1, GRAM):
        grams = F.zip_with(_from(grams, 0) if by > 1 else grams, _from(h, by), lambda x, y: F.xxhash64(x, y))
    short = F.when(F.size(h) == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.xxhash64(F.array_join(w, " "))))
    df = df.withColumn(g, F.when(F.size(h) < GRAM, short).otherwise(F.slice(grams, F.lit(1), F.greatest(F.lit(0), F.size(h) - (GRAM - 1)))))
    # The smaller value is the smaller hash, or of equal hashes the later place.
    df = df.withColumn(v, F.transform(g, lambda x, i: F.shiftright(x, 32) * F.lit(PLACES) - i))
    least, width = F.col(v), 1
    while width < RUN:
        by = min(width, RUN - width)
        least = F.zip_with(least, _from(least, by), lambda x, y: F.least(x, y))
        df = df.withColumn(f"{m}{width}", least)
        least, width = F.col(f"{m}{width}"), width + by
    kept = F.when(F.size(v) == 0, F.col(v)).when(F.size(v) < RUN, F.array(F.array_min(v))).otherwise(F.array_distinct(F.slice(least, F.lit(1), F.greatest(F.lit(0), F.size(v) - (RUN - 1)))))
    df = df.withColumn(f"{out}_k", kept)
    place = lambda x: F.pmod(-x, F.lit(PLACES)).cast("int")
    df = df.withColumn(out, F.transform(f"{out}_k", lambda x: F.struct(F.get(F.col(g), place(x)).alias("hash"), place(x).alias("place"))))
    return df.drop(*[c for c in df.columns if c.startswith(f"{out}_")])


def digest(marks: str) -> Column:
    """A short name of a fingerprint: the number of marks and a hash of them all, places included."""
    return F.concat(F.size(marks).cast("string"), F.lit(":"), F.lower(F.lpad(F.hex(F.xxhash64(marks)), 16, "0")), F.lower(F.lpad(F.hex(F.xxhash64(F.lit(1), F.col(marks))), 16, "0")))


def likeness(a: str, b: str) -> Column:
    """Jaccard similarity of two arrays of distinct hashes; 1 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / (F.size(a) + F.size(b) - both))


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs' columns and `marks`."""
    return with_marks(docs, "text", "marks")


def with_hashes(docs: DataFrame) -> DataFrame:
    return fingerprints(docs).withColumn("hashes", F.array_distinct("marks.hash"))


def _cuts(docs: DataFrame) -> list[str]:
    """The first key (none, doc_id, row_key) of each bucket in ascending order, as JSON; one row each, CUTS at most, and CUT_BYTES in all or one cut."""
    keys = docs.select(F.col("doc_id").isNotNull().alias("some"), "doc_id", "row_key")
    placed = stage(keys.repartitionByRange(*keys.columns).sortWithinPartitions(*keys.columns).withColumn("at", F.monotonically_increasing_id()), "fingerprint-keys")
    part = F.shiftright("at", 33)
    json = F.to_json(F.struct("some", "doc_id", "row_key"), {"ignoreNullFields": "false"})
    found = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.max(F.octet_length(json)).alias("longest")).collect()
    counts = sorted((r["part"], r["n"]) for r in found)
    most = max(1, min(CUTS, CUT_BYTES // max((r["longest"] for r in found), default=1)))
    each = max(BUCKET, -(-sum(n for _, n in counts) // most))
    before, wanted = 0, []
    for p, n in counts:
        wanted.append((p, -before % each))
        before += n
    if not wanted:
        return []
    # In each partition every each-th row from its own first on, so that all partitions together are cut evenly.
    first = placed.sparkSession.createDataFrame(wanted, "part long, first long")
    cut = placed.withColumn("part", part).withColumn("nth", F.col("at") - F.shiftleft(part, 33)).join(F.broadcast(first), "part").filter((F.col("nth") >= F.col("first")) & ((F.col("nth") - F.col("first")) % each == 0))
    return [r["cut"] for r in cut.groupBy("some", "doc_id", "row_key").agg(F.min("at").alias("at")).orderBy("at").select(json.alias("cut")).collect()]


def _with_bucket(docs: DataFrame, cuts: list[str]) -> DataFrame:
    """Adds bucket, the number of the last cut that is not greater than a row's key, found as in a tree of WIDE branches: among every so many cuts, then among those between two of these, and so on."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    key = F.struct(F.col("doc_id").isNotNull().alias("some"), F.col("doc_id"), F.col("row_key"))
    docs = docs.withColumn("bucket", F.lit(0))
    step = 1
    while step * WIDE < len(cuts):
        step *= WIDE
    while step:
        lists = [cuts[i : i + step * WIDE : step] for i in range(0, len(cuts), step * WIDE)]
        branches = F.from_json(F.lit(f"[{','.join('[' + ','.join(x) + ']' for x in lists)}]"), f"array<array<struct<some:boolean,doc_id:{kind},row_key:bigint>>>")
        docs = docs.withColumn("bucket", F.col("bucket") * WIDE + F.size(F.filter(F.get(branches, F.col("bucket")), lambda c: c <= key)) - 1)
        step //= WIDE
    return docs


def with_next(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text without nulls. Adds marks, next_text and next_hashes, of the next document by descending doc_id; after the last comes the first."""
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("row_key"))
    cuts = _cuts(docs)
    dealt = _with_bucket(docs, cuts).repartition("bucket")
    order = Window.partitionBy("bucket").orderBy(F.desc_nulls_last("doc_id"), F.desc("row_key"))
    first = with_hashes(dealt.withColumn("nth", F.row_number().over(order)).filter("nth = 1"))
    above = F.when(F.col("bucket") == len(cuts) - 1, 0).otherwise(F.col("bucket") + 1)
    first = first.select(above.alias("of"), F.col("text").alias("first_text"), F.col("hashes").alias("first_hashes"))
    rows = with_hashes(dealt).withColumn("lead_text", F.lead("text").over(order)).withColumn("lead_hashes", F.lead("hashes").over(order))
    rows = rows.join(first, (F.col("bucket") == F.col("of")) & F.col("lead_text").isNull(), "left")
    return rows.select("doc_id", "text", "marks", "hashes", F.coalesce("lead_text", "first_text").alias("next_text"), F.coalesce("lead_hashes", "first_hashes").alias("next_hashes"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    rows = with_next(docs).withColumn("edited", F.concat(F.expr("substring(text, 1, char_length(text) - floor(char_length(text) / 2))"), F.substring(F.col("next_text"), F.lit(1), half)))
    rows = with_marks(rows, "edited", "edited_marks").withColumn("edited_hashes", F.array_distinct("edited_marks.hash"))
    return rows.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        digest("marks").alias("fingerprint"),
        digest("edited_marks").alias("edited_fingerprint"),
        likeness("hashes", "edited_hashes").alias("near_edited"),
        likeness("hashes", "next_hashes").alias("near_next"),
        F.size("marks").alias("n_marks"),
    )
