"""Events as a stream of files: each micro-batch is delivered in keyset order, and our own progress decides. run_sync() goes through a runner and its store, run() through a progress of the caller's.

The stream's checkpoint only says which files were read. What was delivered is the committed position: rows
at or before it are passed over, so a batch that is sent again after a lost driver delivers nothing twice. As
in the batch scan, a row that arrives late, at or before the committed position, is never seen.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirgate.decisions import advanced
from weirgate.declarations import Event, Sync
from weirgate.functions import canonical
from weirgate.runner import Report, Runner
from weirgate.sources import keyset
from weirgate.sources.keyset import EventPosition

Deliver = Callable[[DataFrame], None]


class Progress:
    """The committed position of one scope; load and save may go to any store."""

    def __init__(self, load: Callable[[], str | None], save: Callable[[str], None]) -> None:
        self.load, self.save = load, save

    def position(self) -> EventPosition | None:
        text = self.load()
        return None if text is None else keyset.restored(text)

    def advance(self, new: EventPosition) -> None:
        self.save(keyset.stored(advanced(self.position(), new)))


def deliver_batch(rows: DataFrame, event: Event, progress: Progress, deliver: Deliver) -> int:
    """Deliver what lies after the committed position, then commit; returns the number of rows."""
    check, at = event.source.checkpoint, progress.position()
    kind = rows.schema[check.cursor].dataType
    low = None if at is None else [F.lit(at.cursor).cast(kind), at.primary_key]
    window = keyset.window(rows, check.cursor, check.primary_key, low)
    last = keyset.upper_bound(window, check.cursor, check.primary_key).first()
    if last is None:
        return 0
    projected = canonical.project_event(window, event)
    n = projected.count()
    deliver(projected)
    progress.advance(EventPosition(last["cursor"] if isinstance(last["cursor"], (int, float, str, bool)) else str(last["cursor"]), last["primary_key"]))
    return n


def run_sync(stream: DataFrame, runner: Runner, sync: Sync, checkpoint: str) -> list[Report]:
    """Run an event sync on each micro-batch of what is there now, through the runner's ledger and its progress; then stop. The reports of the runs.

    A batch that the stream gives again, as after a lost driver, is known by the ledger: what was sent of it is passed over. The sync's failure
    mode holds: a run that stops ends the stream, before the micro-batch counts as read.
    """
    reports: list[Report] = []

    def deliver(rows: DataFrame, _: int) -> None:
        reports.append(runner.run(sync, rows))
        if reports[-1].stopped:
            raise RuntimeError(f"{sync.name} stopped: {reports[-1].reason}")

    query = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(deliver).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return reports


def run(stream: DataFrame, event: Event, progress: Progress, deliver: Deliver, checkpoint: str) -> None:
    """Deliver all that is there now, batch by batch, and stop."""
    query = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(lambda rows, _: deliver_batch(rows, event, progress, deliver) and None).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
