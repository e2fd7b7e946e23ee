"""What the operators share: the shared folder, joins on hot keys, and small column helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirgate.materialize import shared_dir, written

#: The words of two of the contracts, as Java and Python regular expressions.
SPACED_WORD = r"[^\x20\x09-\x0D]+"
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Text that goes to a Python worker at once; Spark's own limit of 64 MB a batch is held several times over, in the JVM and in Python.
BATCH_BYTES = "2m"
_BATCH_KEY, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"

#: Rows of a partition of few().
ROWS_EACH = 1 << 16

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


#: A key is hot if it has over HOT_ROWS rows and over one in HOT_KEYS of all rows: so there are HOT_KEYS hot keys at most.
HOT_ROWS, HOT_KEYS = 256, 1000


def stage(df: DataFrame, name: str, outer: bool = False) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage, survives lost executors. outer: it outlives the scratch() at hand."""
    return written(df, name, outer=outer)


def few(df: DataFrame, rows: int) -> DataFrame:
    """df, of about so many rows, in partitions of about ROWS_EACH, but one for each core: a small table is no pile of files, however many partitions a shuffle has."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS_EACH)))


def join_hot(rows: DataFrame, table: DataFrame, key: str, n: str, salt: Column) -> DataFrame:
    """rows joined with table, which has each key once and n, the number of rows of it; n is left out.

    The rows of a hot key are dealt by salt to cells of about HOT_ROWS rows, with a copy of the table's row in each. The
    list of hot keys is broadcast: by its definition it has HOT_KEYS rows at most.
    """
    total = table.agg(F.sum(n).alias("n")).first()["n"] or 0
    each = max(HOT_ROWS, total // HOT_KEYS)
    cells = F.when(F.col(n) > each, F.ceil(F.col(n) / each)).otherwise(1).cast("int")
    hot = table.filter(F.col(n) > each).select(F.col(key).alias("hot_key"), cells.alias("hot_cells"))
    dealt = rows.join(F.broadcast(hot), F.col(key) == F.col("hot_key"), "left").withColumn("hot_cell", F.pmod(F.xxhash64(salt), F.coalesce("hot_cells", F.lit(1))).cast("int")).drop("hot_key", "hot_cells")
    copies = table.withColumn("hot_cell", F.explode(F.sequence(F.lit(0), cells - 1))).drop(n)
    return dealt.join(copies, [key, "hot_cell"]).drop("hot_cell")


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, a row_key (hash of the text) and `packed`, all columns of docs: names that docs may have can't clash with others."""
    return docs.select("doc_id", F.xxhash64("text").alias("row_key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("packed"))


def map_arrow(df: DataFrame, function, schema) -> DataFrame:
    """mapInArrow over batches of BATCH_BYTES, unless the session sets a limit of its own."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH_KEY, _BATCH_DEFAULT) == _BATCH_DEFAULT:
        conf.set(_BATCH_KEY, BATCH_BYTES)
    return df.mapInArrow(function, schema)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone."""
    return F.translate(text, UPPER, UPPER.lower())


def bucket_of(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus
