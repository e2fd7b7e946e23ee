"""A sink of CSV files, a folder per operation, and a manifest that makes the whole count."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirgate import files as shared
from weirgate.decisions import Counts
from weirgate.destinations import Destination, Surface
from weirgate.materialize import written

OPERATIONS = ("upsert", "remove", "import")
COLUMNS = ("work_id", "collect_id", "sequence_order", "key_json", "target_json", "identifiers_json", "payload_json")
#: Rows of a delivery.
MOST_ROWS = 10_000


def deliver(rows: DataFrame, folder: str, columns: Sequence[str] = COLUMNS, max_rows: int | None = MOST_ROWS) -> DataFrame:
    """Write reconciled rows (with `operation`) below folder/rows/operation=<name> and a manifest of a row per operation.

    All is written beside the folder and then renamed into place, so a delivery is there whole or not at all; one
    that is there already is an error. The rows are read once. Files are written by the tasks that hold the
    rows, each sorted by its place in the order of work; null and empty text differ (an empty text is quoted).
    """
    folder, spark = folder.rstrip("/"), rows.sparkSession
    fixed = written(rows.select("operation", *columns), "csv")
    seen = fixed.agg(F.count("*").alias("n"), F.count_if(~F.coalesce(F.col("operation").isin(*OPERATIONS), F.lit(False))).alias("bad")).first()
    if seen["bad"]:
        raise ValueError(f"{seen['bad']} rows have no operation of {OPERATIONS}")
    if max_rows is not None and seen["n"] > max_rows:
        raise ValueError(f"a delivery of {seen['n']} rows is over {max_rows}")
    draft = f"{folder}-{uuid.uuid4().hex}"
    out = fixed.sortWithinPartitions("operation", "collect_id", "sequence_order")
    out.write.partitionBy("operation").option("header", True).option("emptyValue", '""').option("escape", '"').csv(f"{draft}/rows")
    at = F.struct("collect_id", "sequence_order")
    manifest = fixed.groupBy("operation").agg(F.count("*").alias("row_count"), F.min(at).alias("first"), F.max(at).alias("last"))
    manifest.coalesce(1).write.json(f"{draft}/manifest")
    if not shared.moved(spark, draft, folder):
        shared.removed(spark, draft)
        raise FileExistsError(folder)
    return spark.read.schema(manifest.schema).json(f"{folder}/manifest")


def delivered(spark, folder: str, columns: Sequence[str] = COLUMNS) -> DataFrame:
    """The rows of a delivery, or of all whose folders a pattern names, as text, with `operation`."""
    schema = ", ".join(f"{c} {'long' if c == 'sequence_order' else 'string'}" for c in columns)
    # The operation is read from the file's place: folders of several deliveries have no common root to find partitions below.
    rows = spark.read.schema(schema).option("header", True).option("escape", '"').option("recursiveFileLookup", True).csv(f"{folder.rstrip('/')}/rows")
    return rows.withColumn("operation", F.regexp_extract(F.col("_metadata.file_path"), "/operation=([^/]+)/[^/]+$", 1))


def destination(folder: str, name: str = "files") -> Destination:
    """A destination that writes each batch as a delivery below a folder. A batch that is there already was delivered."""

    def submit(rows: DataFrame, batch: dict) -> Counts:
        n = batch["row_count"]
        try:
            deliver(rows, f"{folder.rstrip('/')}/{batch['batch_id']}")
        except FileExistsError:
            pass
        return Counts(n, confirmed=n)

    return Destination(name, [Surface("state", max_rows=MOST_ROWS, partition=("family",)), Surface("event", family="event", operations=(), target_mode="unsupported", max_rows=MOST_ROWS)], submit)
