"""A result kept as Parquet with a manifest that says what it must be when it is read again."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirgate import files
from weirgate.declarations import digest


class ArtifactError(ValueError):
    """An artifact that is not what its manifest says."""


def fingerprint(df: DataFrame) -> str:
    """Of a schema: names, types and whether they may be null."""
    return digest([(f.name, f.dataType.simpleString()) for f in df.schema])


def _content(df: DataFrame) -> dict:
    """Rows and a hash of them that does not depend on their order: one small aggregate."""
    row = F.xxhash64(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}))
    found = df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(row.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("sum"), F.coalesce(F.bit_xor(row), F.lit(0)).alias("xor")).first()
    return {"rows": found["rows"], "content": digest([found["sum"], found["xor"]])}


def kept(df: DataFrame, folder: str) -> dict:
    """Write df to a folder that is not there yet, whole or not at all; its manifest."""
    spark, draft = df.sparkSession, f"{folder.rstrip('/')}-{uuid.uuid4().hex}"
    df.write.parquet(f"{draft}/rows")
    manifest = {"schema": fingerprint(df), **_content(spark.read.schema(df.schema).parquet(f"{draft}/rows"))}
    files.published(spark, f"{draft}/manifest.json", json.dumps(manifest, sort_keys=True))
    if not files.moved(spark, draft, folder.rstrip("/")):
        files.removed(spark, draft)
        raise FileExistsError(folder)
    return manifest


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of an artifact after its schema, number of rows and content are checked."""
    wanted = json.loads(files.text_of(spark, f"{folder.rstrip('/')}/manifest.json"))
    df = spark.read.parquet(f"{folder.rstrip('/')}/rows")
    found = {"schema": fingerprint(df), **_content(df)}
    wrong = [k for k in wanted if found[k] != wanted[k]]
    if wrong:
        raise ArtifactError(f"{folder} differs from its manifest in {wrong}")
    return df
