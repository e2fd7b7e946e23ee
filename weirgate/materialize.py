"""Tables written to the folder that driver and executors share, to fix a result that is used more than once."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from weirgate import files

#: Of each scratch() that is open, the tables that go at its end.
_tables: ContextVar[tuple[list[str], ...]] = ContextVar("tables", default=())


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where none is set, a folder of this machine, which only a session without a cluster may use."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        place = tempfile.mkdtemp(prefix="weirgate-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def written(df: DataFrame, name: str, keep: bool = False, by: str | Sequence[str] | None = None, most: int = 0, outer: bool = False) -> DataFrame:
    """df as a table, in a folder for each value of `by`, or of each of its columns inside of those of the one before, in files of at most `most` rows if given. Inside of scratch() it is removed at the end, unless it is to be kept; with outer, at the end of the scratch() around that one, if any."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    writer = df.write.option("maxRecordsPerFile", most)
    (writer.partitionBy(by if isinstance(by, str) else list(by)) if by else writer).parquet(path)
    if not keep and len(_tables.get()) > outer:
        _tables.get()[-1 - outer].append(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def bucketed(df: DataFrame, path: str, n: int, key: str) -> None:
    """df as Parquet at a path, in n buckets by a column."""
    name = f"weirgate_{uuid.uuid4().hex}"
    df.repartition(n, key).write.bucketBy(n, key).sortBy(key).format("parquet").option("path", path).saveAsTable(name)
    df.sparkSession.sql(f"DROP TABLE {name}")  # of a table at a path, its files stay


def read_bucketed(spark: SparkSession, path: str, schema: StructType, n: int, key: str) -> DataFrame:
    """What bucketed() wrote: joins and groups by the column need no shuffle of it, where the other side has as many buckets."""
    name = f"weirgate_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    place = path.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {n} BUCKETS LOCATION '{place}'")
    try:
        return spark.table(name)
    finally:
        spark.sql(f"DROP TABLE {name}")


def written_bucketed(df: DataFrame, name: str, n: int, key: str) -> DataFrame:
    """df as a table in n buckets; inside of scratch() it is removed at the end."""
    path, schema = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}", df.schema
    bucketed(df, path, n, key)
    if _tables.get():
        _tables.get()[-1].append(path)
    return read_bucketed(df.sparkSession, path, schema, n, key)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are written inside go at the end. What is to be used later must be written with keep or outer, or elsewhere."""
    token = _tables.set((*_tables.get(), []))
    try:
        yield
    finally:
        paths = _tables.get()[-1]
        _tables.reset(token)
        for path in paths:
            files.removed(spark, path)
