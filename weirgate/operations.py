"""Operations on the runtime's tables: look, dismiss, skip, reset, delete and clean up."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirgate import decisions
from weirgate.declarations import digest
from weirgate.operators import ledger, paging
from weirgate.sources import keyset
from weirgate.sources.keyset import Position, WorkPosition
from weirgate.store import NOW, TABLES, Changes, Store

#: No place of a collect is beyond this.
_LAST = (1 << 63) - 1
#: Scopes that an inspection lists.
MOST_SCOPES = 20


def counts(store: Store) -> dict[str, int]:
    return {t: store.read(t).count() for t in TABLES}


def inspect_declaration(store: Store, name: str) -> dict:
    """Bounds of a declaration's work, its versions, its current rows and the first scopes that take it."""
    own = F.col("declaration_name") == name
    bounds = ledger.work_bounds(store.read("ordered_work").filter(own)).first().asDict()
    current = store.read("state_current").filter(own).agg(F.count("*").alias("n"), F.max("collect_id").alias("c")).first()
    scopes = store.read("destination_progress").filter(own).select(*ledger.SCOPE).distinct().orderBy(*ledger.SCOPE).limit(MOST_SCOPES).collect()
    versions = store.read("declarations").filter(own).orderBy("first_seen_at").select("declaration_version_id").collect()
    return bounds | {"current_count": current["n"], "current_collect_id": current["c"], "scopes": [tuple(s) for s in scopes], "versions": [v[0] for v in versions]}


def inspect_scope(store: Store, scope: Sequence[str], n: int = 10) -> dict:
    """Positions of a scope, its batches by status, and the last reports of its sync."""
    own = ledger.in_scope(scope)
    positions = {r["mode"]: r["position_json"] for r in store.read("destination_progress").filter(own).collect()}
    found = [r.asDict() for r in ledger.status_counts(store.read("destination_batches").filter(own)).orderBy("status", "completion_state").collect()]
    reports = [r.asDict() for r in ledger.ranked_reports(store.read("sync_reports").filter(F.col("sync_name") == scope[0]), n).collect()]
    return {"position_json": positions, "batches": found, "reports": reports}


def inspect_collect(store: Store, collect_id: str) -> dict[str, int]:
    """Rows of a collect in the work and the current state, and batches whose range reaches into it."""
    out = {t: store.read(t).filter(F.col("collect_id") == collect_id).count() for t in ("ordered_work", "state_current")}
    return out | {"destination_batches": ledger.overlapping(store.read("destination_batches"), collect_id, collect_id).count()}


def inspect_targets(store: Store) -> list[dict]:
    return [r.asDict() for r in store.read("target_registry").groupBy("source").agg(F.count("*").alias("n")).orderBy("source").collect()]


def inspect_run(store: Store, run_id: str) -> dict[str, int]:
    return {t: store.read(t).filter(F.col("run_id") == run_id).count() for t in ("runs", "sync_reports", "destination_batches")}


def run_evidence(store: Store, run_id: str) -> dict | None:
    """What the reports of a run's syncs come to."""
    found = ledger.run_totals(store.read("sync_reports", run_id)).first()
    return found.asDict() if found else None


def batches(store: Store, scope: Sequence[str], batch_id: str | None = None) -> DataFrame:
    """The batches of a scope, or the one of an id, in the order of their ranges."""
    own = store.read("destination_batches").filter(ledger.in_scope(scope))
    return (own if batch_id is None else own.filter(F.col("batch_id") == batch_id)).orderBy("first_collect_id", "first_order", "batch_index", "batch_id")


def dismiss_unresolved(store: Store, scope: Sequence[str]) -> int:
    """Open batches of a scope become skipped; their number."""
    own = F.coalesce(ledger.in_scope(scope), F.lit(False))

    def change(c: Changes) -> int:
        n = 0
        for page in [r[0] for r in c.read("destination_batches").filter(own & (F.col("completion_state") == "unresolved")).select("page_id").distinct().collect()]:
            rows = c.read("destination_batches", page)
            n += rows.filter(own & (F.col("completion_state") == "unresolved")).count()
            c.replace("destination_batches", ledger.dismissed(rows, own), page)
        return n

    return store.commit(change)


def _moved_on(c: Changes, scope: Sequence[str], mode: str, new: Position) -> None:
    found = c.read("destination_progress", digest(scope)).filter(F.col("mode") == mode).first()
    old = keyset.restored(found["position_json"]) if found and found["position_json"] else None
    values = dict(zip(ledger.SCOPE, scope, strict=True)) | {"mode": mode, "position_json": keyset.stored(decisions.advanced(old, new)), "updated_at": NOW}
    c.put("destination_progress", [values], ["mode"], digest(scope))


def skip_batch(store: Store, scope: Sequence[str], batch_id: str) -> None:
    """A batch of the ledger counts as skipped, and progress goes to the end of its range: one change."""
    found = batches(store, scope, batch_id).first()
    if found is None:
        raise ValueError(f"no batch {batch_id} in this scope")

    def change(c: Changes) -> None:
        c.rewrite("destination_batches", lambda rows: ledger.dismissed(rows, F.col("batch_id") == batch_id), [found["page_id"]])
        _moved_on(c, scope, found["mode"], keyset.restored(found["upper_json"]))

    store.commit(change)


def skip_range(store: Store, scope: Sequence[str], first: WorkPosition, last: WorkPosition) -> int:
    """A range of kept state work is never sent to a scope: a skipped batch of it enters the ledger, and progress goes to its end. The number of rows."""
    found = paging.edges(store.work(scope[4], first.key, last.key)).first()
    if not found["row_count"]:
        raise ValueError("the range holds no work")
    upper = WorkPosition(found["last_collect_id"], found["last_sequence_order"])
    values = dict(zip(ledger.SCOPE, scope, strict=True)) | {"mode": "ordered_work", "page_id": "skip", "batch_index": 0, "row_count": found["row_count"], "item_count": found["row_count"], "payload_fingerprint": "skip", "request_fingerprint": "skip"}
    values |= {"first_collect_id": found["first_collect_id"], "first_order": found["first_sequence_order"], "last_collect_id": upper.collect_id, "last_order": upper.sequence_order, "upper_json": keyset.stored(upper)}
    values |= {"status": "skipped", "completion_state": "resolved", "retry_eligible": False, "attempt_count": 0}
    named = store.rows("destination_batches", [values]).withColumn("batch_id", ledger.batch_id()).first().asDict()

    def change(c: Changes) -> None:
        c.put("destination_batches", [named | {"created_at": NOW}], ["batch_id"], "skip")
        _moved_on(c, scope, "ordered_work", upper)

    store.commit(change)
    return found["row_count"]


def reset_scope(store: Store, scope: Sequence[str]) -> int:
    """Progress, cursors and batches of a scope go."""
    own = ledger.in_scope(scope)
    return store.commit(lambda c: sum(c.delete(t, own) for t in ("destination_progress", "cursors", "destination_batches")))


def reset(store: Store) -> None:
    store.commit(lambda c: [c.drop(table) for table in TABLES])


def _held(store: Store, name: str | None, first: str, last: str) -> bool:
    """Whether open batches reach into a range of collects; one without a range reaches everywhere."""
    open_ = store.read("destination_batches").filter("completion_state = 'unresolved'")
    open_ = open_ if name is None else open_.filter(F.col("declaration_name") == name)
    wide = open_.withColumns({"first_collect_id": F.coalesce("first_collect_id", F.lit("")), "last_collect_id": F.coalesce("last_collect_id", F.lit(last))})
    return not ledger.overlapping(wide, first, last).isEmpty()


def delete_collect(store: Store, collect_id: str, force: bool = False) -> int:
    """A collect's work goes. While open batches or current rows hang on it, only by force."""
    held = _held(store, None, collect_id, collect_id) or not store.read("state_current").filter(F.col("collect_id") == collect_id).isEmpty()
    if held and not force:
        raise ValueError(f"collect {collect_id} is still in use")
    names = sorted({d for d, x in store.collects() if x.collect_id == collect_id})
    return store.commit(lambda c: sum(c.cut(d, (collect_id, 0), (collect_id, _LAST)) for d in names))


def delete_range(store: Store, name: str, first: WorkPosition, last: WorkPosition, force: bool = False) -> int:
    """Work from first to last goes. While open batches reach into it, only by force."""
    if _held(store, name, first.collect_id, last.collect_id) and not force:
        raise ValueError("the range is still in use")
    return store.commit(lambda c: c.cut(name, first.key, last.key))


def delete_work(store: Store, name: str, force: bool = False) -> int:
    """All work of a declaration goes, sent or not; by force alone."""
    if not force:
        raise ValueError("work that may not have been sent goes by force alone")
    return store.commit(lambda c: c.cut(name))


def rebaseline(store: Store, name: str) -> int:
    """The current state of a declaration goes: its next collect upserts all."""
    return store.delete("state_current", F.col("declaration_name") == name)


def reset_targets(store: Store, binding: str | None = None) -> int:
    return store.delete("target_registry", F.lit(True) if binding is None else F.col("binding_name") == binding)


def delete_run(store: Store, run_id: str) -> int:
    own = F.col("run_id") == run_id
    return store.commit(lambda c: c.delete("sync_reports", own) + c.delete("runs", own))


def cleanup_evidence(store: Store, cutoff: datetime) -> int:
    """Reports and closed batches as old as the cutoff go, but for those of runs that still run. Open batches stay: they hold work."""
    runs = store.read("runs")

    def expired(rows: DataFrame) -> DataFrame:
        split = ledger.cleanup_split(rows, runs, cutoff)
        open_ = F.coalesce(F.col("completion_state") != "resolved", F.lit(True)) if "completion_state" in rows.columns else F.lit(False)
        return split.withColumn("expired", F.col("expired") & ~open_)

    def change(c: Changes) -> int:
        gone = 0
        for table in ("sync_reports", "destination_batches"):
            n = expired(c.read(table)).filter("expired").count()
            if n:
                c.rewrite(table, lambda rows: expired(rows).filter("not expired").drop("expired"))
            gone += n
        return gone

    return store.commit(change)


def cleanup_cursors(store: Store, cutoff: datetime) -> int:
    """Cursors as old as the cutoff go."""
    return store.delete("cursors", F.col("created_at") <= F.lit(cutoff))


def cleanup_work(store: Store, name: str, cutoff: datetime, through: str | None = None, dry_run: bool = False) -> int:
    """Work up to the watermark that all consumers have passed, no younger than the cutoff, goes; the number of rows.

    What may go is found from the index of the log, which has a row for each collect. Collects go whole, so of folders
    only one that also holds younger collects is read and written anew.
    """
    held = [c for _, c in store.collects(name)]
    if not held:
        return 0
    rows = [{"declaration_name": name, "collect_id": c.collect_id, "sequence_order": c.last, "created_at": datetime.fromtimestamp(c.newest / 1e6, timezone.utc)} for c in held]
    work = store.rows("ordered_work", rows)
    own = F.col("declaration_name") == name
    at = store.read("destination_progress").filter(own & (F.col("mode") == "ordered_work")).select("declaration_name", F.get_json_object("position_json", "$.collect_id").alias("collect_id"), F.get_json_object("position_json", "$.sequence_order").cast("long").alias("sequence_order"))
    passed = ledger.completed_collects(at, work).select("declaration_name", F.col("completed").alias("collect_id"))
    mark = ledger.retention_watermark(passed, store.read("destination_batches"), work).first()
    age = ledger.age_boundary(work, cutoff).first()["collect_id"]
    bounds = [mark["watermark"] if mark else None, age, *([through] if through else [])]
    if None in bounds:
        return 0
    if dry_run:
        return sum(c.rows for c in held if c.collect_id <= min(bounds))
    return store.commit(lambda c: c.cut(name, None, (min(bounds), _LAST)))
