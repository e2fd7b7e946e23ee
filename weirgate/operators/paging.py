"""Bounded pages of work: pending work by whole collects, current state by identity, events by keyset."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirgate.sources.keyset import CurrentPosition, EventPosition, Position, WorkPosition, after, between

POSITION = ["collect_id", "sequence_order"]


class PageError(ValueError):
    """A page that is not what its plan promised."""


@dataclass(frozen=True)
class Page:
    rows: DataFrame
    #: Where to go on; None where the page ends with a whole collect, or with all there is.
    cursor: Position | None = None


def in_order(work: DataFrame) -> DataFrame:
    return work.orderBy("collect_id", "sequence_order", "work_id")


def pending(work: DataFrame, position: WorkPosition | None, through_collect: str | None = None) -> DataFrame:
    rows = work if position is None else work.filter(after(POSITION, [position.collect_id, position.sequence_order]))
    return rows if through_collect is None else rows.filter(F.col("collect_id") <= through_collect)


def whole_collect_page(rows: DataFrame, max_rows: int) -> DataFrame:
    """The first max_rows rows, less a last collect that goes on after them if others come before it.

    One bounded top-k; windows see max_rows + 1 rows at most.
    """
    if max_rows < 1:
        raise ValueError("max_rows must be positive")
    most = in_order(rows).limit(max_rows + 1)
    every = Window.orderBy("collect_id", "sequence_order", "work_id")
    ranked = most.withColumn("nth", F.row_number().over(every)).withColumn("cut", F.max(F.when(F.col("nth") == max_rows + 1, F.col("collect_id"))).over(Window.partitionBy()))
    kept = ranked.filter(F.col("nth") <= max_rows).withColumn("whole", F.coalesce(F.col("collect_id") != F.col("cut"), F.lit(True)))
    kept = kept.withColumn("any_whole", F.max("whole").over(Window.partitionBy()))
    return kept.filter("whole or not any_whole").select(*rows.columns)


def pending_page(work: DataFrame, position: WorkPosition | None, max_rows: int, through_collect: str | None = None) -> Page:
    """A page of pending work and, if it ends inside the first pending collect, the cursor to go on with."""
    rows = pending(work, position, through_collect)
    page = whole_collect_page(rows, max_rows)
    last = page.agg(F.max(F.struct(*POSITION)).alias("m")).first()["m"]
    if last is None:
        return Page(page)
    more = rows.filter((F.col("collect_id") == last[0]) & (F.col("sequence_order") > last[1])).limit(1).count()
    return Page(page, WorkPosition(last[0], last[1]) if more else None)


def page_after_cursor(work: DataFrame, cursor: WorkPosition, max_rows: int) -> DataFrame:
    """The next rows of the cursor's own collect."""
    return in_order(work.filter((F.col("collect_id") == cursor.collect_id) & (F.col("sequence_order") > cursor.sequence_order))).limit(max_rows)


def replay(work: DataFrame, first: WorkPosition, last: WorkPosition) -> DataFrame:
    """Exactly the rows of a batch's range."""
    return work.filter(between(POSITION, list(first.key), list(last.key)))


def current_page(current: DataFrame, after_identity: str | None, max_rows: int, collect_id: str) -> DataFrame:
    """Upserts of the current state after an identity; sequence_order counts from 0 on each page."""
    rows = current if after_identity is None else current.filter(F.col("identity_json") > after_identity)
    page = rows.orderBy("identity_json").limit(max_rows)
    return page.select(
        F.concat(F.lit("state-current:"), "identity_json").alias("work_id"), F.lit(collect_id).alias("collect_id"),
        (F.row_number().over(Window.orderBy("identity_json")) - 1).cast("long").alias("sequence_order"), F.lit("state").alias("family"), F.lit("upsert").alias("kind"),
        "declaration_name", "declaration_version_id", "key_json", "target_json", "identifiers_json", "payload_json",
    )


def event_page(window: DataFrame, collect_id: str, declaration_name: str, declaration_version_id: str, lower: EventPosition | None, max_rows: int) -> DataFrame:
    """Imports of an event window (as project_event gives it) in keyset order, cursor and primary key as text."""
    order = [F.col("cursor").asc_nulls_last(), F.col("primary_key").asc_nulls_last(), F.col("identity_json").asc_nulls_last()]
    page = window.orderBy(*order).limit(max_rows)
    low = (None, None) if lower is None else (lower.cursor, lower.primary_key)
    text = lambda x: F.lit(None).cast("string") if x is None else F.lit(x).cast("string")
    return page.select(*_imports(F.lit(collect_id), F.row_number().over(Window.orderBy(*order)) - 1, declaration_name, declaration_version_id, text(low[0]), text(low[1])))


def _imports(collect_id: Column, place: Column, declaration_name: str, declaration_version_id: str, lower_cursor: Column, lower_primary_key: Column) -> list[Column]:
    return [
        F.sha2(F.concat(F.lit("event|import|"), collect_id, F.lit("|"), "identity_json", F.lit("|"), "fingerprint"), 256).alias("work_id"), collect_id.alias("collect_id"),
        place.cast("long").alias("sequence_order"), F.lit("event").alias("family"), F.lit("import").alias("kind"),
        F.lit(declaration_name).alias("declaration_name"), F.lit(declaration_version_id).alias("declaration_version_id"), "key_json", F.lit(None).cast("string").alias("target_json"), "identifiers_json", "payload_json",
        "occurred_at", F.col("cursor").cast("string").alias("event_cursor"), F.col("primary_key").cast("string").alias("event_primary_key"), lower_cursor.alias("lower_cursor"), lower_primary_key.alias("lower_primary_key"),
    ]


def event_pages(rows: DataFrame, collect_id: str, declaration_name: str, declaration_version_id: str, lower: EventPosition | None, max_rows: int, count: int) -> DataFrame:
    """Pages of event_stage() at once, with `page`: rows are projected and have `nth`, their place; count: of these and all that follow. Windows see a page and the row before it."""
    end = F.col("nth") % max_rows == max_rows - 1
    own = (F.col("nth") / max_rows).cast("int")
    dealt = rows.withColumn("own", own).withColumn("page", F.explode(F.when(end, F.array("own", F.col("own") + 1)).otherwise(F.array("own"))))
    before = Window.partitionBy("page").orderBy("nth")
    low = (None, None) if lower is None else (str(lower.cursor), str(lower.primary_key))
    bounds = {f"low_{c}": F.coalesce(F.lag(F.col(c).cast("string")).over(before), F.lit(x).cast("string")) for c, x in zip(("cursor", "primary_key"), low, strict=True)}
    pages = dealt.withColumns(bounds).filter("own = page")
    made = pages.select("page", *_imports(F.lit(collect_id), F.col("nth") % max_rows, declaration_name, declaration_version_id, F.col("low_cursor"), F.col("low_primary_key")))
    return made.withColumn("more", (F.col("page").cast("long") + 1) * max_rows < count)


def replayed_pages(rows: DataFrame, ranges: DataFrame, declaration_name: str, declaration_version_id: str, max_rows: int) -> DataFrame:
    """Pages of event_page() at once, with `page`: ranges has page, collect_id, and the texts lower and upper cursor and primary key of each, which don't overlap."""
    order = [F.col(c).asc_nulls_last() for c in ("cursor", "primary_key", "identity_json")]
    ranked = in_ranges(rows, ranges).withColumn("nth", F.row_number().over(Window.partitionBy("page").orderBy(*order)) - 1).filter(F.col("nth") < max_rows)
    return ranked.select("page", *_imports(F.col("collect_id"), F.col("nth"), declaration_name, declaration_version_id, F.col("lower_cursor"), F.col("lower_primary_key")))


def in_ranges(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """Rows, by cursor and primary key, with the columns of the range (lower, upper] that they lie in; a lower bound may be null. ranges are few."""
    kinds = {"cursor": rows.schema["cursor"].dataType, "primary_key": rows.schema["primary_key"].dataType}
    typed = ranges.withColumns({f"{b}_{c}_": F.col(f"{b}_{c}").cast(kind) for b in ("lower", "upper") for c, kind in kinds.items()})
    c, p = F.col("cursor"), F.col("primary_key")
    after_low = F.col("lower_cursor").isNull() | (c > F.col("lower_cursor_")) | ((c == F.col("lower_cursor_")) & (p > F.col("lower_primary_key_")))
    to_high = (c < F.col("upper_cursor_")) | ((c == F.col("upper_cursor_")) & (p <= F.col("upper_primary_key_")))
    return rows.join(F.broadcast(typed), after_low & to_high).drop(*[f"{b}_{c}_" for b in ("lower", "upper") for c in kinds])


def event_stage(window: DataFrame, collect_id: str, declaration_name: str, declaration_version_id: str, lower: EventPosition | None, max_rows: int) -> DataFrame:
    """A page of imports with each record's own lower bound, and `more`: whether the window goes on after the page.

    window: a projected window of at most max_rows + 1 rows; the last one of those only tells that there is more.
    """
    page = event_page(window, collect_id, declaration_name, declaration_version_id, lower, max_rows + 1)
    more = F.max((F.col("sequence_order") >= max_rows)).over(Window.partitionBy())
    return lower_bounds(page, lower).withColumn("more", more).filter(F.col("sequence_order") < max_rows)


def _bounds(kinds: tuple[str, ...]) -> list[Column]:
    at = F.struct(*POSITION)
    return [
        F.count("*").alias("row_count"), F.count_if(~F.coalesce(F.col("kind").isin(*kinds), F.lit(False))).alias("strange"), F.size(F.collect_set(at)).alias("places"), F.count_if(F.col("kind") == "remove").alias("removes"),
        F.count_if(F.col("work_id").isNull() | F.col("key_json").isNull()).alias("empty"), F.min(at).alias("first"), F.max(at).alias("last"), F.size(F.collect_set("collect_id")).alias("collects"),
    ]


def checked(rows: DataFrame, max_rows: int, kinds: tuple[str, ...], *more: Column) -> dict:
    """Bounds, and more aggregates, of a staged page after its checks: not over max_rows, known kinds only, dense places in each collect, no place twice."""
    return _checked(rows.agg(*_bounds(kinds), *more).first().asDict(), max_rows, kinds)


def checked_pages(rows: DataFrame, max_rows: int, kinds: tuple[str, ...], *more: Column) -> list[dict]:
    """The same of pages, in their order."""
    found = rows.groupBy("page").agg(*_bounds(kinds), *more).collect()
    return [_checked(r.asDict(), max_rows, kinds) for r in sorted(found, key=lambda r: r["page"])]


def _checked(found: dict, max_rows: int, kinds: tuple[str, ...]) -> dict:
    if found["row_count"] > max_rows:
        raise PageError(f"a page of {found['row_count']} rows is over {max_rows}")
    if found["strange"]:
        raise PageError(f"{found['strange']} rows of a page are not of {kinds}")
    if found["empty"]:
        raise PageError(f"{found['empty']} rows of a page lack their work id or key")
    if found["places"] != found["row_count"]:
        raise PageError("two rows of a page have one place")
    if found["collects"] == 1 and found["last"][1] - found["first"][1] + 1 != found["row_count"]:
        raise PageError("places of a page are not dense")
    return found


def current_stage(current: DataFrame, after_identity: str | None, max_rows: int, collect_id: str) -> Page:
    """A page of the current state, with a cursor if there is more."""
    page = current_page(current, after_identity, max_rows + 1, collect_id)
    rows = page.filter(F.col("sequence_order") < max_rows)
    last = page.agg(F.max(F.when(F.col("sequence_order") == max_rows - 1, F.col("work_id"))).alias("last"), F.count("*").alias("n")).first()
    return Page(rows, CurrentPosition(last["last"].removeprefix("state-current:")) if last["n"] > max_rows else None)


def lower_bounds(page: DataFrame, lower: EventPosition | None) -> DataFrame:
    """Each record of a page with the position before it as its lower bound."""
    every = Window.orderBy("sequence_order")
    low = (None, None) if lower is None else (str(lower.cursor), str(lower.primary_key))
    return page.withColumns({f"lower_{c}": F.coalesce(F.lag(f"event_{c}").over(every), F.lit(x).cast("string")) for c, x in zip(("cursor", "primary_key"), low, strict=True)})


def placed(rows: DataFrame) -> DataFrame:
    """A bounded page with `place`, 0, 1, ... over all of its collects."""
    return rows.withColumn("place", (F.row_number().over(Window.orderBy(*POSITION)) - 1).cast("long"))


def before_collect(rows: DataFrame, collect_id: str) -> DataFrame:
    """The rows of a page that belong to earlier collects."""
    return rows.filter(F.col("collect_id") < collect_id)


def edges(rows: DataFrame) -> DataFrame:
    """First and last position of a range, as one row."""
    at = F.struct(*POSITION)
    found = rows.agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n"))
    return found.select(*[F.col(f"{e}.{c}").alias(f"{e}_{c}") for e in ("first", "last") for c in POSITION], F.col("n").alias("row_count"))

