"""The ledger of destination batches: reads, reruns, retention and clean-up as plans over its tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class LedgerError(ValueError):
    """A row of the ledger that breaks a rule."""


SCOPE = ("sync_name", "destination_name", "surface", "family", "declaration_name")
RESOLVED = ("accepted", "succeeded", "skipped")


#: What the id of a batch is made of: events by the range of their source alone, states also by the work and what was made of it.
EVENT_IDENTITY = (*SCOPE, "batch_index", "lower_json", "upper_json")
STATE_IDENTITY = (*EVENT_IDENTITY, "first_collect_id", "first_order", "last_collect_id", "last_order", "page_id", "payload_fingerprint", "request_fingerprint")


def batch_id() -> Column:
    """An id that a replan of the same range gives again, and no other range does."""
    text = lambda names: F.to_json(F.struct(*sorted(names)), {"ignoreNullFields": "false"})
    return F.sha2(F.when(F.col("family") == "event", text(EVENT_IDENTITY)).otherwise(text(STATE_IDENTITY)), 256)


#: Outcome of a batch that a replan of it keeps.
OUTCOME = ("status", "completion_state", "retry_eligible", "attempt_count", "attempt_id", "job_json", "error", "run_id", "created_at", "first_submitted_at", "updated_at")


def kept_outcome() -> dict[str, Column]:
    """Assignments for an upsert of planned batches: what is stored of an outcome stays."""
    return {c: F.col(f"old.{c}") for c in OUTCOME}


def sweep(ledger: DataFrame, limit: int) -> DataFrame:
    """The batches to try again, with those of the same version and page beside them: `again` tells which; ordered by range."""
    again = F.coalesce((F.col("completion_state") == "unresolved") & (F.coalesce(F.col("status") == "pending", F.lit(False)) | is_retryable(limit)), F.lit(False))
    page = Window.partitionBy(*SCOPE, "declaration_version_id", "page_id")
    marked = ledger.withColumn("again", again).withColumn("any_again", F.max("again").over(page))
    return marked.filter("any_again").drop("any_again")


def outcomes(batches: DataFrame, order: str = "batch_index") -> DataFrame:
    """status and retry_eligible of batches in order from the outcome of their page: confirmed, accepted, terminal, retryable and before_acceptance, dealt in this order.

    A batch has the first status of which a whole batch's rows are left; what is left goes on to the next batch. The page is
    bounded by its request limits, so its batches are one list.
    """
    names = ("confirmed", "accepted", "terminal", "retryable", "before_acceptance")
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), "batch_id", "row_count")))
    pages = batches.groupBy("page_id").agg(listed.alias("items"), F.array(*[F.max(n).cast("long") for n in names]).alias("left"))

    def deal(state: Column, item: Column) -> Column:
        fits = F.transform(state["left"], lambda have: have >= item["row_count"])
        pick = F.array_position(fits, True).cast("int") - 1
        left = F.transform(state["left"], lambda have, i: F.when(i == pick, have - item["row_count"]).otherwise(have))
        return F.struct(left.alias("left"), F.concat(state["out"], F.array(F.struct(item["batch_id"].alias("batch_id"), pick.alias("pick")))).alias("out"))

    first = F.struct(F.col("left"), F.array().cast("array<struct<batch_id:string,pick:int>>").alias("out"))
    dealt = pages.select("page_id", F.explode(F.aggregate("items", first, deal, lambda s: s["out"])).alias("x")).select("page_id", "x.batch_id", "x.pick")
    status = F.when(F.col("pick") < 0, "pending").otherwise(F.element_at(F.array(*map(F.lit, ("succeeded", "accepted", "failed", "failed", "failed"))), F.greatest(F.col("pick"), F.lit(0)) + 1))
    return dealt.select("page_id", "batch_id", status.alias("status"), (F.col("pick") == 3).alias("retry_eligible"))


def in_scope(scope: Sequence[str]) -> Column:
    out = F.lit(True)
    for c, v in zip(SCOPE, scope, strict=True):
        out = out & (F.col(c) == v)
    return out


def is_resolved() -> Column:
    return F.coalesce(F.col("status").isin(*RESOLVED) & (F.col("completion_state") == "resolved"), F.lit(False))


def is_retryable(limit: int) -> Column:
    """Failed, eligible and below the limit of attempts."""
    return F.coalesce((F.col("status") == "failed") & F.col("retry_eligible") & (F.col("attempt_count") < limit), F.lit(False))


def retry_candidates(ledger: DataFrame, limit: int) -> DataFrame:
    """Unresolved and pending, or failed and to be tried again; pending ones whatever their attempts."""
    return ledger.filter((F.col("completion_state") == "unresolved") & (F.coalesce(F.col("status") == "pending", F.lit(False)) | is_retryable(limit)))


def open_jobs(ledger: DataFrame) -> DataFrame:
    """Batches that a partner took and has not told the end of."""
    return ledger.filter((F.col("completion_state") == "unresolved") & (F.col("status") == "accepted") & F.col("job_json").isNotNull())


def rerun_plan(ledger: DataFrame, limit: int, page: Sequence[str] = ("page_id",)) -> DataFrame:
    """action per batch: skip, submit, or block; of a page with a blocked batch none is submitted."""
    plain = F.when(is_resolved(), "skip").when(is_retryable(limit) | F.coalesce((F.col("attempt_count") == 0) & (F.col("status") == "pending"), F.lit(False)), "submit").otherwise("block")
    blocked = F.max((F.col("plain") == "block").cast("int")).over(Window.partitionBy(*page))
    return ledger.withColumn("plain", plain).withColumn("action", F.when((F.col("plain") == "submit") & (blocked == 1), "hold").otherwise(F.col("plain"))).drop("plain")


def status_counts(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("status", "completion_state").agg(F.count("*").alias("n"))


def overlapping(ledger: DataFrame, first: str, last: str) -> DataFrame:
    """Batches whose collects reach into [first, last]."""
    return ledger.filter((F.col("first_collect_id") <= last) & (F.col("last_collect_id") >= first))


def dismissed(ledger: DataFrame, which: Column | None = None) -> DataFrame:
    """Unresolved batches, or which of them, become skipped; the rest stays."""
    open_ = F.coalesce((F.col("completion_state") == "unresolved") & (F.lit(True) if which is None else which), F.lit(False))
    return ledger.withColumn("status", F.when(open_, "skipped").otherwise(F.col("status"))).withColumn("completion_state", F.when(open_, "resolved").otherwise(F.col("completion_state")))


def work_bounds(work: DataFrame, *by: str) -> DataFrame:
    """Rows, collects and times that work spans, as one row or one for each value of `by`."""
    return work.groupBy(*by).agg(
        F.count("*").alias("row_count"), F.min("collect_id").alias("first_collect_id"), F.max("collect_id").alias("last_collect_id"), F.min("created_at").alias("first_created_at"), F.max("created_at").alias("last_created_at"),
    )


def violations(ledger: DataFrame) -> DataFrame:
    """batch_id and `broken`, the rules that a batch's row breaks; rows that keep all rules are left out."""
    return ledger.withColumn("broken", _broken(ledger.sparkSession._jvm)).filter(F.size("broken") > 0)


@lru_cache(maxsize=4)
def _broken(jvm) -> Column:
    """Made once for a session's JVM: the ledger is written often."""
    status, closed, tries = F.col("status"), F.col("completion_state") == "resolved", F.coalesce("attempt_count", F.lit(0))
    rules = {
        "status": ~F.coalesce(status.isin("pending", "failed", *RESOLVED), F.lit(False)),
        "resolved_without_outcome": closed & status.isin("pending", "failed"),
        "unresolved_success": ~closed & (status == "succeeded"),
        "failed_without_attempt": (status == "failed") & (tries == 0),
        "retry_of_a_closed_batch": closed & F.col("retry_eligible"),
        "negative": (tries < 0) | (F.col("row_count") < 0),
        "reversed_range": (F.col("first_collect_id") > F.col("last_collect_id")) | ((F.col("first_collect_id") == F.col("last_collect_id")) & (F.col("first_order") > F.col("last_order"))),
    }
    return F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]))


def collects(work: DataFrame) -> DataFrame:
    """declaration_name, collect_id, row_count, end (its last place), previous (the collect before it of that declaration)."""
    found = work.groupBy("declaration_name", "collect_id").agg(F.count("*").alias("row_count"), F.max("sequence_order").alias("end"))
    return found.withColumn("previous", F.lag("collect_id").over(Window.partitionBy("declaration_name").orderBy("collect_id")))


def oldest_unresolved(ledger: DataFrame) -> DataFrame:
    """Per declaration the first collect that an open batch reaches into."""
    return ledger.filter(F.col("completion_state") == "unresolved").groupBy("declaration_name").agg(F.min("first_collect_id").alias("first_collect_id"))


def current_summary(current: DataFrame) -> DataFrame:
    """Per declaration the rows of its current state and the collect they come from."""
    return current.groupBy("declaration_name").agg(F.count("*").alias("row_count"), F.max("collect_id").alias("collect_id"))


def run_totals(reports: DataFrame) -> DataFrame:
    """Evidence of each run: sums over its reports, and whether all went well."""
    names = ("attempted", "confirmed", "accepted", "terminal", "retryable", "before_acceptance")
    return reports.groupBy("run_id").agg(F.count("*").alias("syncs"), *[F.sum(n).alias(n) for n in names], F.bool_and(F.col("status") == "succeeded").alias("all_succeeded"))


def completed_collects(progress: DataFrame, work: DataFrame) -> DataFrame:
    """progress (declaration_name, collect_id, sequence_order) with `completed`: the last collect whose rows have all been passed; null if there is none.

    The collect at hand counts if no row of it comes after the position; if not, the one before it does.
    """
    ends = collects(work).select(F.col("declaration_name").alias("d"), F.col("collect_id").alias("c"), "end", "previous")
    earlier = progress.join(ends, (F.col("declaration_name") == F.col("d")) & (F.col("collect_id") == F.col("c")), "left")
    # A collect of which no work is left is passed as it is.
    done = F.when(F.col("collect_id").isNull(), None).when(F.col("end").isNull() | (F.col("sequence_order") >= F.col("end")), F.col("collect_id")).otherwise(F.col("previous"))
    return earlier.withColumn("completed", done).select(*progress.columns, "completed")


def age_boundary(work: DataFrame, cutoff) -> DataFrame:
    """The greatest collect of which every row is as old as the cutoff."""
    old = work.groupBy("collect_id").agg(F.max("created_at").alias("newest")).filter(F.col("newest") <= F.lit(cutoff))
    return old.agg(F.max("collect_id").alias("collect_id"))


def retention_watermark(progress: DataFrame, ledger: DataFrame, work: DataFrame) -> DataFrame:
    """Per declaration: the collect that every consumer has passed, stepped back before the oldest open batch.

    progress has the collect that each consumer has wholly passed. One without, and an open batch without a
    range, hold everything.
    """
    passed = progress.groupBy("declaration_name").agg(F.min("collect_id").alias("passed"), F.max(F.col("collect_id").isNull().cast("int")).alias("waiting")).filter("waiting = 0")
    open_ = ledger.filter(F.col("completion_state") == "unresolved").select("declaration_name", "first_collect_id")
    open_ = open_.withColumn("first_collect_id", F.coalesce("first_collect_id", F.lit("")))
    blocker = passed.join(open_, "declaration_name").filter(F.col("first_collect_id") <= F.col("passed")).groupBy("declaration_name").agg(F.min("first_collect_id").alias("blocker"))
    limits = passed.join(blocker, "declaration_name", "left")
    collects = work.select("declaration_name", F.col("collect_id").alias("at")).distinct()
    before = limits.filter("blocker is not null").join(collects, "declaration_name").filter(F.col("at") < F.col("blocker")).groupBy("declaration_name").agg(F.max("at").alias("before"))
    return limits.join(before, "declaration_name", "left").select("declaration_name", F.when(F.col("blocker").isNull(), F.col("passed")).otherwise(F.col("before")).alias("watermark"))


def cleanup_split(rows: DataFrame, runs: DataFrame, cutoff) -> DataFrame:
    """Rows with `expired`: as old as the cutoff and of no run that is still running."""
    running = runs.filter(F.col("status") == "running").select(F.col("run_id").alias("running_id")).distinct()
    marked = rows.join(running, F.col("run_id") == F.col("running_id"), "left")
    return marked.withColumn("expired", F.coalesce((F.col("created_at") <= F.lit(cutoff)) & F.col("running_id").isNull(), F.lit(False))).drop("running_id")


def last_attempts(reports: DataFrame) -> DataFrame:
    """The number of the last attempt of each sync, from attempt ids that end in :attempt-N."""
    n = F.regexp_extract("attempt_id", r":attempt-(\d+)$", 1)
    return reports.filter(n != "").groupBy("sync_name").agg(F.max(n.cast("long")).alias("attempt"))


def ranked_reports(reports: DataFrame, n: int = 10) -> DataFrame:
    return reports.orderBy(F.desc("created_at"), "report_id").limit(n)
