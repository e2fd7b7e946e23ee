"""Destinations without a partner, for trials: one that keeps what it gets, and answers as it is told."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from weirgate.decisions import Response
from weirgate.destinations import Destination, Surface


@dataclass
class Memory:
    """Keeps the rows of its batches on the driver; a batch is bounded by the surface."""

    status: int = 200
    rows: list[dict] = field(default_factory=list)
    batches: list[dict] = field(default_factory=list)

    def submit(self, rows: DataFrame, batch: dict) -> Response:
        if 200 <= self.status < 300:
            self.rows += [r.asDict() for r in rows.collect()]
            self.batches.append(batch)
        return Response(self.status)


def destination(kept: Memory, name: str = "memory", max_rows: int = 1_000) -> Destination:
    return Destination(name, [Surface("state", max_rows=max_rows), Surface("event", family="event", operations=(), target_mode="unsupported", max_rows=max_rows)], kept.submit)
