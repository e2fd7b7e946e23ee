"""Canonical JSON text, identities and fingerprints as column expressions.

Objects have their fields in the order of their names and keep null fields. Dates, timestamps, decimals and
items of identifier lists are JSON strings. Objects are put inside others as text, so their own text stays.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirgate.declarations import DeclarationError, Event, Identifier, State, StaticTarget

KEEP_NULLS = {"ignoreNullFields": "false"}
AS_TEXT = (T.DateType, T.TimestampType, T.TimestampNTZType, T.DecimalType, T.DayTimeIntervalType)
NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)


def value(df: DataFrame, name: str) -> Column:
    """A column as it goes into JSON; nested and binary ones have no place there."""
    found = {f.name: f.dataType for f in df.schema}
    if name not in found:
        raise DeclarationError(f"no column {name!r} among {sorted(found)}")
    kind = found[name]
    if isinstance(kind, AS_TEXT):
        return F.col(f"`{name}`").cast("string")
    if isinstance(kind, (T.StringType, T.BooleanType, T.NullType, *NUMBERS)):
        return F.col(f"`{name}`")
    raise DeclarationError(f"column {name!r} of type {kind.simpleString()} must be made JSON text in the source")


def json_object(df: DataFrame, fields: Mapping[str, str]) -> Column:
    if not fields:
        return F.lit("{}")
    return F.to_json(F.struct(*[value(df, c).alias(k) for k, c in sorted(fields.items())]), KEEP_NULLS)


def pruned(df: DataFrame, column: str) -> Column:
    """JSON of a struct column without its nulls, however deep: null fields, null items of lists, and fields that are then empty structs."""

    def kept(c: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StructType):
            inner = [kept(c.getField(f.name), f.dataType).alias(f.name) for f in kind]
            return F.when(_some(c, kind), F.struct(*inner))
        if isinstance(kind, T.ArrayType):
            return F.filter(F.transform(c, lambda x: kept(x, kind.elementType)), lambda x: x.isNotNull())
        return c

    def _some(c: Column, kind: T.DataType) -> Column:
        """Whether a value holds anything that is not null."""
        if isinstance(kind, T.StructType):
            out = F.lit(False)
            for f in kind:
                out = out | F.coalesce(_some(c.getField(f.name), f.dataType), F.lit(False))
            return out
        return c.isNotNull()

    return F.coalesce(F.to_json(kept(F.col(column), df.schema[column].dataType)), F.lit("{}"))


def json_string(text: Column) -> Column:
    """A JSON string, or null for a null."""
    whole = F.to_json(F.struct(text.alias("v")), KEEP_NULLS)
    return F.substring(whole, F.lit(6), F.length(whole) - 6)


def _typed(kind: str) -> Callable[[Column], Column]:
    return lambda x: F.to_json(F.struct(F.lit(kind).alias("type"), x.alias("value")), KEEP_NULLS)


def identifiers(df: DataFrame, wanted: Sequence[Identifier]) -> Column:
    """A flat array in the order declared: an object per scalar, null or not; of lists one per item, sorted."""
    parts = []
    for i in wanted:
        if i.value is not None:
            parts.append(F.array(F.to_json(F.struct(F.lit(i.type).alias("type"), value(df, i.value).alias("value")), KEEP_NULLS)))
        else:
            if not isinstance(df.schema[i.values].dataType, T.ArrayType):
                raise DeclarationError(f"identifier values {i.values!r} must be a list column")
            items = F.array_sort(F.coalesce(F.col(f"`{i.values}`").cast("array<string>"), F.array().cast("array<string>")))
            parts.append(F.transform(items, _typed(i.type)))
    if not parts:
        return F.lit("[]")
    return F.concat(F.lit("["), F.array_join(F.concat(*parts), ","), F.lit("]"))


def sha256(*parts: Column | str) -> Column:
    return F.sha2(F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]), 256)


def target_json(df: DataFrame, target: str | StaticTarget | None) -> Column:
    """SQL null without a target; a target column that is null is {"value":null}."""
    if target is None:
        return F.lit(None).cast("string")
    if isinstance(target, StaticTarget):
        return F.to_json(F.struct(F.lit(target.value).alias("value")))
    return json_object(df, {"value": target})


def or_null(text: Column) -> Column:
    return F.coalesce(text, F.lit("null"))


def project_state(df: DataFrame, state: State) -> DataFrame:
    """key_json, target_json, identifiers_json, payload_json, identity_json, fingerprint."""
    rows = df.select(
        json_object(df, state.key).alias("key_json"),
        target_json(df, state.target).alias("target_json"),
        identifiers(df, state.identifiers).alias("identifiers_json"),
        json_object(df, state.payload).alias("payload_json"),
    )
    key, target = F.col("key_json"), or_null(F.col("target_json"))
    return rows.select(
        "*",
        F.concat(F.lit('{"key":'), key, F.lit(',"target":'), target, F.lit("}")).alias("identity_json"),
        sha256('{"identifiers":', F.col("identifiers_json"), ',"key":', key, ',"payload":', F.col("payload_json"), ',"target":', target, "}").alias("fingerprint"),
    )


def project_event(df: DataFrame, event: Event) -> DataFrame:
    """Cursor and primary key in their own types, and the canonical columns; the fingerprint is that of the identity."""
    check = event.source.checkpoint
    rows = df.select(
        F.col(f"`{check.cursor}`").alias("cursor"),
        F.col(f"`{check.primary_key}`").alias("primary_key"),
        F.col(f"`{event.occurred_at}`").cast("string").alias("occurred_at"),
        json_object(df, event.key).alias("key_json"),
        identifiers(df, event.identifiers).alias("identifiers_json"),
        json_object(df, event.payload).alias("payload_json"),
    )
    identity = F.concat(F.lit('{"key":'), F.col("key_json"), F.lit(',"occurred_at":'), or_null(json_string(F.col("occurred_at"))), F.lit("}"))
    return rows.withColumn("identity_json", identity).withColumn("fingerprint", F.sha2("identity_json", 256))
