"""Queries of the runtime: ledger, replay and targets on derived tables, and whole runs of syncs into a store of their own."""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirgate.decisions import Counts, Job
from weirgate.declarations import Checkpoint, Event, Identifier, Source, State, Sync
from weirgate.destinations import Destination, Registry, Surface
from weirgate.functions import canonical, identifiers, redaction, templates
from weirgate.materialize import shared_dir
from weirgate.operators import batching, ledger, paging, targets
from weirgate.plans import inputs
from weirgate.plans.inputs import COLLECT, VERSION, table
from weirgate.runner import Runner
from weirgate.sinks import files
from weirgate.sources import artifacts, keyset
from weirgate.sources.keyset import EventPosition
from weirgate.store import Store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
query = inputs.adder(QUERIES, ORACLE_SQL)

# Ledger.

RANGED = f"WITH b AS ({inputs.RANGED.sql})"
RETRY = "coalesce(status = 'failed' AND retry_eligible AND attempt_count < 3, false)"


def _object(names: tuple[str, ...]) -> str:
    return f"json_object({', '.join(f"'{n}', {n}" for n in sorted(names))})::varchar"


@query(f"{RANGED} SELECT order_key, sha256(CASE WHEN family = 'event' THEN {_object(ledger.EVENT_IDENTITY)} ELSE {_object(ledger.STATE_IDENTITY)} END) AS batch_id FROM b")
def ledger_batch_ids(spark, sf_dir):
    """Ids of batches: of events by their source's range, of states by work and content too."""
    return inputs.RANGED.df(spark, sf_dir).select("order_key", ledger.batch_id().alias("batch_id"))


@query(
    f"""{RANGED}, m AS (SELECT *, completion_state = 'unresolved' AND (status = 'pending' OR {RETRY}) AS again FROM b),
p AS (SELECT *, bool_or(again) OVER (PARTITION BY sync_name, destination_name, surface, family, declaration_name, declaration_version_id, page_id) AS any_again FROM m)
SELECT order_key, again, attempt_count FROM p WHERE any_again"""
)
def retry_sweep(spark, sf_dir):
    """Batches to try again with those of their page beside them."""
    return ledger.sweep(inputs.RANGED.df(spark, sf_dir), 3).select("order_key", "again", "attempt_count")


COMPLETED = f"""WITH w AS ({inputs.WORK_LOG.sql}), p AS ({inputs.INSIDE.sql}),
ends AS (SELECT declaration_name, collect_id, max(sequence_order) AS fin, lag(collect_id) OVER (PARTITION BY declaration_name ORDER BY collect_id) AS previous FROM w GROUP BY 1, 2),
done AS (SELECT p.*, CASE WHEN p.collect_id IS NULL THEN NULL WHEN fin IS NULL OR sequence_order >= fin THEN p.collect_id ELSE previous END AS completed
 FROM p LEFT JOIN ends ON ends.declaration_name = p.declaration_name AND ends.collect_id = p.collect_id)"""


@query(f"{COMPLETED} SELECT declaration_name, collect_id, sequence_order, completed FROM done")
def completed_collects(spark, sf_dir):
    """The collect that each consumer has wholly passed."""
    return ledger.completed_collects(inputs.INSIDE.df(spark, sf_dir), inputs.WORK_LOG.df(spark, sf_dir))


@query(
    f"""{COMPLETED}, b AS (SELECT concat('decl_', (o_orderkey % 4)::varchar) AS declaration_name, CASE WHEN o_orderkey % 4 = 2 THEN '018f-2' END AS first_collect_id FROM orders WHERE o_orderkey % 4 IN (1, 2)),
passed AS (SELECT declaration_name, min(completed) AS passed FROM done GROUP BY 1 HAVING count(*) = count(completed)),
blocker AS (SELECT passed.declaration_name, min(coalesce(first_collect_id, '')) AS blocker FROM passed JOIN b ON b.declaration_name = passed.declaration_name AND coalesce(first_collect_id, '') <= passed GROUP BY 1)
SELECT passed.declaration_name, CASE WHEN blocker IS NULL THEN passed ELSE (SELECT max(collect_id) FROM w WHERE w.declaration_name = passed.declaration_name AND w.collect_id < blocker) END AS watermark
FROM passed LEFT JOIN blocker ON blocker.declaration_name = passed.declaration_name"""
)
def completed_watermark(spark, sf_dir):
    """What may be cleaned up: only whole collects that all have passed, before any open batch; one without a range holds all."""
    work = inputs.WORK_LOG.df(spark, sf_dir)
    done = ledger.completed_collects(inputs.INSIDE.df(spark, sf_dir), work).select("declaration_name", F.col("completed").alias("collect_id"))
    key = F.col("o_orderkey") % 4
    open_ = table(spark, sf_dir, "orders").filter(key.isin(1, 2)).select(F.concat(F.lit("decl_"), key.cast("string")).alias("declaration_name"), F.when(key == 2, "018f-2").alias("first_collect_id"), F.lit("unresolved").alias("completion_state"))
    return ledger.retention_watermark(done, open_, work)


@query(f"WITH w AS ({inputs.WORK_LOG.sql}) SELECT declaration_name, collect_id, count(*)::bigint AS row_count, max(sequence_order) AS \"end\", lag(collect_id) OVER (PARTITION BY declaration_name ORDER BY collect_id) AS previous FROM w GROUP BY 1, 2")
def work_collects(spark, sf_dir):
    return ledger.collects(inputs.WORK_LOG.df(spark, sf_dir))


@query(f"{RANGED} SELECT declaration_name, min(first_collect_id) AS first_collect_id FROM b WHERE completion_state = 'unresolved' GROUP BY 1")
def oldest_unresolved(spark, sf_dir):
    return ledger.oldest_unresolved(inputs.RANGED.df(spark, sf_dir))


@query(f"WITH w AS ({inputs.WORK_LOG.sql}) SELECT declaration_name, count(*)::bigint AS row_count, max(collect_id) AS collect_id FROM w GROUP BY 1")
def state_current_collects(spark, sf_dir):
    return ledger.current_summary(inputs.WORK_LOG.df(spark, sf_dir))


@query(
    f"""WITH RECURSIVE b AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY batch_index) AS nth FROM ({inputs.ANSWERED.sql})),
d(page_id, nth, batch_id, pick, l0, l1, l2, l3, l4) AS (
 SELECT DISTINCT page_id, 0::bigint, ''::varchar, -2, confirmed, accepted, terminal, retryable, before_acceptance FROM b
 UNION ALL
 SELECT page_id, nth, batch_id, pick, l0 - CASE WHEN pick = 0 THEN n ELSE 0 END, l1 - CASE WHEN pick = 1 THEN n ELSE 0 END, l2 - CASE WHEN pick = 2 THEN n ELSE 0 END, l3 - CASE WHEN pick = 3 THEN n ELSE 0 END, l4 - CASE WHEN pick = 4 THEN n ELSE 0 END
 FROM (SELECT d.page_id, b.nth, b.batch_id, b.row_count AS n, l0, l1, l2, l3, l4, CASE WHEN l0 >= b.row_count THEN 0 WHEN l1 >= b.row_count THEN 1 WHEN l2 >= b.row_count THEN 2 WHEN l3 >= b.row_count THEN 3 WHEN l4 >= b.row_count THEN 4 ELSE -1 END AS pick
  FROM d JOIN b ON b.page_id = d.page_id AND b.nth = d.nth + 1))
SELECT page_id, batch_id, CASE pick WHEN -1 THEN 'pending' WHEN 0 THEN 'succeeded' WHEN 1 THEN 'accepted' ELSE 'failed' END AS status, pick = 3 AS retry_eligible FROM d WHERE nth > 0"""
)
def ledger_outcomes(spark, sf_dir):
    """Statuses of batches from the counts of their page, dealt in order."""
    return ledger.outcomes(inputs.ANSWERED.df(spark, sf_dir))


@query(f"WITH r AS ({inputs.RUN_REPORTS.sql}) SELECT run_id, count(*)::bigint AS syncs, sum(attempted)::bigint AS attempted, sum(confirmed)::bigint AS confirmed, sum(accepted)::bigint AS accepted, sum(terminal)::bigint AS terminal, sum(retryable)::bigint AS retryable, sum(before_acceptance)::bigint AS before_acceptance, bool_and(status = 'succeeded') AS all_succeeded FROM r GROUP BY 1")
def run_totals(spark, sf_dir):
    return ledger.run_totals(inputs.RUN_REPORTS.df(spark, sf_dir))


# Requests.


@query(
    f"""WITH RECURSIVE w AS ({inputs.WORK_LOG.sql}), p AS (SELECT work_id, kind, strlen(concat(key_json, target_json))::bigint AS n, row_number() OVER (ORDER BY sequence_order) AS nth FROM w WHERE collect_id = '018f-1'),
f(nth, work_id, kind, size, batch_index) AS (
 SELECT nth, work_id, kind, 2 + n, 0::bigint FROM p WHERE nth = 1
 UNION ALL
 SELECT p.nth, p.work_id, p.kind, CASE WHEN p.kind <> f.kind OR f.size + 1 + p.n > 120 THEN 2 + p.n ELSE f.size + 1 + p.n END, f.batch_index + CASE WHEN p.kind <> f.kind OR f.size + 1 + p.n > 120 THEN 1 ELSE 0 END
 FROM f JOIN p ON p.nth = f.nth + 1)
SELECT work_id, batch_index FROM f"""
)
def request_byte_split(spark, sf_dir):
    """Bodies of at most 120 bytes, with their brackets and commas; a record over that stands alone."""
    page = inputs.WORK_LOG.df(spark, sf_dir).filter("collect_id = '018f-1'")
    page = page.withColumn("item_count", F.lit(1)).withColumn("byte_count", F.octet_length(F.concat("key_json", "target_json")))
    return batching.weighted_batches(page, "sequence_order", ["kind"], 1000, 120).select("work_id", "batch_index")


ALL_ISLANDS = f"""WITH w AS ({inputs.WORK_LOG.sql}), p AS (SELECT *, coalesce(lag(kind) OVER o <> kind OR lag(collect_id) OVER o <> collect_id, false)::int AS brk FROM w WINDOW o AS (ORDER BY collect_id, sequence_order)),
i AS (SELECT *, sum(brk) OVER (ORDER BY collect_id, sequence_order) AS island FROM p), k AS (SELECT *, (row_number() OVER (PARTITION BY island ORDER BY sequence_order) - 1) // 2 AS part FROM i)"""


@query(f"{ALL_ISLANDS} SELECT work_id, CAST(dense_rank() OVER (ORDER BY island, part) - 1 AS BIGINT) AS batch_index FROM k")
def request_batches_of_all(spark, sf_dir):
    """All collects at once, two records a request, never over the end of a collect: no window spans more than a range partition."""
    work = inputs.WORK_LOG.df(spark, sf_dir).withColumn("at", F.struct("collect_id", "sequence_order"))
    return batching.unit_batches(work, "at", ["kind", "collect_id"], 2).select("work_id", "batch_index")


@query(f"{ALL_ISLANDS} SELECT work_id, CAST(dense_rank() OVER (ORDER BY island, part) - 1 AS BIGINT) AS batch_index FROM k")
def request_weighted_fill_of_all(spark, sf_dir):
    """The same by weight, each record five of ten: cuts follow one from the other over all range partitions."""
    work = inputs.WORK_LOG.df(spark, sf_dir).withColumns({"at": F.struct("collect_id", "sequence_order"), "item_count": F.lit(5), "byte_count": F.length("key_json")})
    return batching.weighted_batches(work, "at", ["kind", "collect_id"], 10).select("work_id", "batch_index")


def _filled(size: str, most: int) -> str:
    """Rows w with work_id, kind, collect_id and nth, filled up to `most` bytes one after the other."""
    return f"""p AS (SELECT *, strlen({size})::bigint AS n, row_number() OVER (ORDER BY collect_id, sequence_order) AS nth FROM w),
f(nth, work_id, kind, collect_id, size, batch_index) AS (
 SELECT nth, work_id, kind, collect_id, 2 + n, 0::bigint FROM p WHERE nth = 1
 UNION ALL
 SELECT p.nth, p.work_id, p.kind, p.collect_id, CASE WHEN p.kind <> f.kind OR p.collect_id <> f.collect_id OR f.size + 1 + p.n > {most} THEN 2 + p.n ELSE f.size + 1 + p.n END, f.batch_index + CASE WHEN p.kind <> f.kind OR p.collect_id <> f.collect_id OR f.size + 1 + p.n > {most} THEN 1 ELSE 0 END
 FROM f JOIN p ON p.nth = f.nth + 1)"""


@query(f"WITH RECURSIVE w AS ({inputs.WORK_LOG.sql}), {_filled('concat(key_json, target_json)', 120)} SELECT work_id, batch_index FROM f")
def request_byte_split_of_all(spark, sf_dir):
    """All collects at once in bodies of at most 120 bytes, none over the end of a collect."""
    work = inputs.WORK_LOG.df(spark, sf_dir).withColumns({"at": F.struct("collect_id", "sequence_order"), "item_count": F.lit(1), "byte_count": F.octet_length(F.concat("key_json", "target_json"))})
    return batching.weighted_batches(work, "at", ["kind", "collect_id"], 1000, 120).select("work_id", "batch_index")


RECORD = """concat('{"operation":"', kind, '","key":', key_json, ',"target":', target_json, '}')"""


@query(f"WITH RECURSIVE w AS ({inputs.WORK_LOG.sql}), {_filled(RECORD, 400)} SELECT f.batch_index, concat('[', string_agg({RECORD.replace('kind', 'p.kind')}, ',' ORDER BY p.nth), ']') AS body, strlen(body)::bigint AS byte_count FROM f JOIN p ON p.nth = f.nth GROUP BY 1")
def request_bodies_of_all(spark, sf_dir):
    """Rendered bodies of all collects, of 400 bytes at most with all they hold; none names a secret."""
    work = inputs.WORK_LOG.df(spark, sf_dir).withColumns({"at": F.struct("collect_id", "sequence_order"), "item_count": F.lit(1), "operation": F.col("kind")})
    work = work.withColumn("record_json", redaction.without_secrets(Destination("partner", [Surface("rows")], _takes_all).record(work)))
    filled = batching.weighted_batches(work.withColumn("byte_count", F.octet_length("record_json")), "at", ["kind", "collect_id"], 1000, 400)
    return batching.bodies(filled, F.col("record_json"), "at").withColumn("byte_count", F.octet_length("body").cast("long"))


TEMPLATE = "/customers/{{key.customer}}/lists/{{target.value}}?v={{declaration_name}}"


@query(f"WITH w AS ({inputs.WORK_LOG.sql}) SELECT work_id, concat('/customers/', json_extract_string(key_json, '$.customer'), '/lists/', json_extract_string(target_json, '$.value'), '?v=', declaration_name) AS path FROM w")
def request_templates(spark, sf_dir):
    """A template of a request's path, filled from each record."""
    path = templates.expanded(TEMPLATE, {"key": F.col("key_json"), "target": F.col("target_json"), "declaration_name": F.col("declaration_name")})
    return inputs.WORK_LOG.df(spark, sf_dir).select("work_id", path.alias("path"))


@query("SELECT doc_id, coalesce(" + " OR ".join(f"regexp_matches(text, '{p.replace(chr(39), chr(39) * 2)}')" for p, _ in redaction.RULES) + ", false) AS secret FROM documents")
def request_secrets(spark, sf_dir):
    """Texts that name a secret with its value, and so must not go into a request."""
    return table(spark, sf_dir, "documents").select("doc_id", redaction.holds_secret(F.col("text")).alias("secret"))


BROKEN = """list_filter([CASE WHEN status = 'failed' AND attempt_count = 0 THEN 'failed_without_attempt' END, CASE WHEN completion_state = 'resolved' AND coalesce(retry_eligible, false) THEN 'retry_of_a_closed_batch' END], lambda x: x IS NOT NULL)"""


@query(f"{RANGED} SELECT order_key, array_to_string({BROKEN}, ',') AS broken FROM b WHERE len({BROKEN}) > 0")
def ledger_violations(spark, sf_dir):
    """Rows of the ledger that can't be, and the rules they break."""
    return ledger.violations(inputs.RANGED.df(spark, sf_dir)).select("order_key", F.concat_ws(",", "broken").alias("broken"))


@query(f"WITH w AS ({inputs.WORK_LOG.sql}) SELECT work_id, collect_id FROM w WHERE collect_id < '018f-3'")
def work_before_collect(spark, sf_dir):
    return paging.before_collect(inputs.WORK_LOG.df(spark, sf_dir), "018f-3").select("work_id", "collect_id")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus IS NOT NULL")
def source_artifact(spark, sf_dir):
    """A source's rows kept with a manifest, checked and read again."""
    folder = f"{shared_dir(spark)}/artifact-{uuid.uuid4().hex}"
    artifacts.kept(table(spark, sf_dir, "orders").filter("o_orderstatus is not null").select("o_orderkey", "o_custkey", "o_totalprice"), folder)
    return artifacts.read(spark, folder)


# Targets.


@query(
    f"""WITH m AS ({inputs.MAPPINGS.sql}), r AS ({inputs.REGISTERED.sql}), t AS (SELECT DISTINCT trim(c_mktsegment) AS logical_target FROM customer),
best AS (SELECT logical_target, max_by(remote_id, CASE WHEN surface IS NULL THEN 0 ELSE 1 END) AS remote_id FROM m WHERE surface IS NULL OR surface = 'rows' GROUP BY 1)
SELECT t.logical_target, coalesce(best.remote_id, r.remote_id) AS remote_id, CASE WHEN best.remote_id IS NOT NULL THEN 'mapping' WHEN r.remote_id IS NOT NULL THEN 'registry' ELSE 'missing' END AS source
FROM t LEFT JOIN best ON best.logical_target = t.logical_target LEFT JOIN r ON r.logical_target = t.logical_target AND r.surface = 'rows'"""
)
def target_resolution(spark, sf_dir):
    """Distinct targets of the work: a mapping of the surface, one of none, the registry, or missing."""
    return targets.resolved(targets.logical(inputs.WORK_LOG.df(spark, sf_dir)), inputs.MAPPINGS.df(spark, sf_dir), inputs.REGISTERED.df(spark, sf_dir), "rows")


# Values.


@query(f"WITH c AS ({inputs.CONTACTS.sql}) SELECT id, CASE WHEN trim(event) <> '' THEN sha256(lower(trim(event))) END AS given_name, CASE WHEN trim(madid) <> '' THEN trim(madid) END AS postal_code, CASE WHEN trim(status) <> '' THEN trim(status) END AS region FROM c")
def address_fields(spark, sf_dir):
    c = inputs.CONTACTS.df(spark, sf_dir)
    return c.select("id", identifiers.address(given_name=F.col("event"), postal_code=F.col("madid"), region=F.col("status")).alias("a")).select("id", "a.*")


@query(f"WITH c AS ({inputs.CONTACTS.sql}) SELECT id, json_merge_patch('{{}}', json_object('event', trim(event), 'profile', CASE WHEN phone IS NULL AND status IS NULL THEN NULL ELSE json_object('phone', trim(phone), 'status', trim(status)) END))::varchar AS body FROM c")
def null_pruning(spark, sf_dir):
    """Bodies without nulls, and without objects that hold nothing else."""
    c = inputs.CONTACTS.df(spark, sf_dir).select("id", F.struct(F.trim("event").alias("event"), F.struct(F.trim("phone").alias("phone"), F.trim("status").alias("status")).alias("profile")).alias("body"))
    return c.select("id", canonical.pruned(c, "body").alias("body"))


# Events.

EVENTS = Event("events", Source("events", "SELECT * FROM events", Checkpoint("ts", "event_id", "string", "integer")), key={"event": "event_id"}, occurred_at="ts", identifiers=[Identifier("user", value="user_id")], payload={"kind": "event_type"})
LOW = "2024-01-05 00:00:00"
AFTER = f"(ts > TIMESTAMP '{LOW}' OR (ts = TIMESTAMP '{LOW}' AND event_id > 10))"


@query(
    f"""WITH e AS (SELECT ts::varchar AS c, event_id::varchar AS p, row_number() OVER (ORDER BY ts, event_id) - 1 AS n FROM events WHERE {AFTER})
SELECT n::bigint AS sequence_order, c AS event_cursor, p AS event_primary_key, coalesce(lag(c) OVER (ORDER BY n), '{LOW}') AS lower_cursor, coalesce(lag(p) OVER (ORDER BY n), '10') AS lower_primary_key, (SELECT count(*) > 250 FROM e) AS more FROM e WHERE n < 250"""
)
def event_stage_page(spark, sf_dir):
    """A page of 250 events after a position, with each one's lower bound, and whether more follow."""
    low = EventPosition(LOW, 10)
    rows = table(spark, sf_dir, "events")
    window = keyset.window(rows, "ts", "event_id", [F.lit(LOW).cast("timestamp_ntz"), 10], None, 251)
    page = paging.event_stage(canonical.project_event(window, EVENTS), COLLECT, "events", VERSION, low, 250)
    return page.select("sequence_order", "event_cursor", "event_primary_key", "lower_cursor", "lower_primary_key", "more")


@query(f"WITH e AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS n FROM events WHERE {AFTER}) SELECT count(*)::bigint AS row_count, min(event_id)::bigint AS least, max(event_id)::bigint AS most FROM e WHERE n <= 250")
def event_replay_count(spark, sf_dir):
    """The range of a page, read again from its source, gives the page's rows and no others."""
    last = event_stage_page(spark, sf_dir).agg(F.max_by(F.struct("event_cursor", "event_primary_key"), "sequence_order").alias("m")).first()["m"]
    rows = keyset.window(table(spark, sf_dir, "events"), "ts", "event_id", [F.lit(LOW).cast("timestamp_ntz"), 10], [F.lit(last[0]).cast("timestamp_ntz"), int(last[1])])
    return rows.agg(F.count("*").alias("row_count"), F.min("event_id").cast("long").alias("least"), F.max("event_id").cast("long").alias("most"))


# Whole runs, each in a store of its own.

CUSTOMERS = State("customers", Source("customers", "SELECT * FROM customer"), key={"customer": "c_custkey"}, target="c_mktsegment", identifiers=[Identifier("name", value="c_name")], payload={"nation": "c_nationkey", "balance": "c_acctbal"})
SYNC = Sync("sync", CUSTOMERS, "partner", "rows")


def _runner(spark: SparkSession, submit: Callable, max_rows: int = 500, poll: Callable | None = None, **options) -> Runner:
    surfaces = [Surface("rows", max_rows=max_rows), Surface("events", family="event", operations=(), target_mode="unsupported", max_rows=max_rows)]
    return Runner(spark, Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"), Registry(Destination("partner", surfaces, submit, poll=poll)), sleep=lambda s: None, **options)


def _takes_all(rows: DataFrame, batch: dict) -> Counts:
    return Counts(batch["row_count"], confirmed=batch["row_count"])


PAIR = f"""WITH prev AS ({inputs.PREVIOUS.sql}), s AS (SELECT c_custkey AS k, c_mktsegment AS t, c_name, c_nationkey, c_acctbal FROM customer), c AS (SELECT c_custkey AS k, c_mktsegment AS t, c_name, c_nationkey, c_acctbal FROM prev),
work AS (SELECT 'remove' AS kind, c.k, c.t FROM c LEFT JOIN s ON s.k = c.k AND s.t = c.t WHERE s.k IS NULL
 UNION ALL SELECT 'upsert', s.k, s.t FROM s LEFT JOIN c ON s.k = c.k AND s.t = c.t WHERE c.k IS NULL OR (s.c_name, s.c_nationkey, s.c_acctbal) IS DISTINCT FROM (c.c_name, c.c_nationkey, c.c_acctbal))"""


@query(f"{PAIR} SELECT kind, concat('{{\"customer\":', k::varchar, '}}') AS key_json, concat('{{\"value\":\"', t, '\"}}') AS target_json FROM work")
def run_of_a_state(spark, sf_dir):
    """Two runs of a sync; the work that the second one collected and delivered."""
    runner = _runner(spark, _takes_all)
    runner.run(SYNC, inputs.PREVIOUS.df(spark, sf_dir))
    last = runner.run(SYNC, table(spark, sf_dir, "customer")).collected.collect_id
    done = runner.position(SYNC)
    work = runner.store.read("ordered_work").filter((F.col("collect_id") == last) & ((F.col("collect_id") < done.collect_id) | (F.col("sequence_order") <= done.sequence_order)))
    return work.select("kind", "key_json", "target_json")


@query("WITH e AS (SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS n, event_id FROM events WHERE ts IS NOT NULL) SELECT (n // 2000)::bigint AS page, count(*)::bigint AS row_count, arg_max(event_id, n)::varchar AS last_primary_key FROM e GROUP BY 1")
def run_of_events(spark, sf_dir):
    """A run of an event sync in pages of 2,000: the ledger's batches by page."""
    runner = _runner(spark, _takes_all, max_rows=2_000, page_rows=2_000)
    runner.run(Sync("sync", EVENTS, "partner", "events"), table(spark, sf_dir, "events"))
    found = runner.store.read("destination_batches").select("row_count", F.get_json_object("upper_json", "$.cursor").alias("c"), F.get_json_object("upper_json", "$.primary_key").alias("last_primary_key"))
    rank = F.row_number().over(inputs.by_position("c", F.col("last_primary_key").cast("long"))) - 1
    return found.select(rank.cast("long").alias("page"), "row_count", "last_primary_key")


@query("WITH n AS (SELECT count(*) AS n FROM customer), b AS (SELECT unnest(range((SELECT (n + 499) // 500 FROM n))) AS i) SELECT least(500, n - 500 * i)::bigint AS row_count, CASE WHEN i % 2 = 0 THEN 2 ELSE 1 END::bigint AS attempt_count, 'succeeded' AS status, 'resolved' AS completion_state FROM b, n")
def run_with_a_retry_sweep(spark, sf_dir):
    """Every other batch fails for now; the next run sends those again. The ledger after it."""
    failed: set[str] = set()

    def submit(rows: DataFrame, batch: dict) -> Counts:
        n = batch["row_count"]
        if batch["batch_index"] % 2 == 0 and batch["batch_id"] not in failed:
            failed.add(batch["batch_id"])
            return Counts(n, retryable=n)
        return Counts(n, confirmed=n)

    runner = _runner(spark, submit, attempts=1)
    state = State("customers", CUSTOMERS.source, key={"customer": "c_custkey"}, payload={"nation": "c_nationkey"})
    for _ in range(2):
        runner.run(Sync("sync", state, "partner", "rows"), table(spark, sf_dir, "customer"))
    return runner.store.read("destination_batches").select("row_count", "attempt_count", "status", "completion_state")


@query("""WITH n AS (SELECT 'customers' AS sync_name, count(*) AS n FROM customer UNION ALL SELECT 'suppliers', count(*) FROM supplier)
SELECT sync_name, least(500, n - 500 * i)::bigint AS row_count, 1::bigint AS attempt_count, 'succeeded' AS status, 1::bigint AS sent FROM (SELECT *, unnest(range((n + 499) // 500)) AS i FROM n)""")
def run_of_two_writers(spark, sf_dir):
    """Two syncs of one store at once, each with a state of its own: no outcome is lost and no batch is sent twice."""
    sent: list[str] = []

    def submit(rows: DataFrame, batch: dict) -> Counts:
        sent.append(batch["batch_id"])
        return Counts(batch["row_count"], confirmed=batch["row_count"])

    runner = _runner(spark, submit)
    suppliers = State("suppliers", Source("suppliers", "SELECT * FROM supplier"), key={"supplier": "s_suppkey"}, payload={"nation": "s_nationkey"})
    customers = State("customers", CUSTOMERS.source, key={"customer": "c_custkey"}, payload={"nation": "c_nationkey"})
    with ThreadPoolExecutor(2) as pool:
        runs = [pool.submit(runner.run, Sync(made.name, made, "partner", "rows"), table(spark, sf_dir, of)) for made, of in ((customers, "customer"), (suppliers, "supplier"))]
        for run in runs:
            run.result()
    times = spark.createDataFrame([(b, sent.count(b)) for b in sorted(set(sent))], "batch_id string, sent long")
    return runner.store.read("destination_batches").join(times, "batch_id", "left").select("sync_name", "row_count", "attempt_count", "status", "sent")


@query("WITH n AS (SELECT count(*) AS n FROM customer) SELECT least(500, n - 500 * i)::bigint AS row_count, 1::bigint AS attempt_count, CASE WHEN i = 1 THEN 'failed' ELSE 'succeeded' END AS status, CASE WHEN i = 1 THEN 'unresolved' ELSE 'resolved' END AS completion_state, 2::bigint AS polls FROM (SELECT n, unnest(range((n + 499) // 500)) AS i FROM n)")
def run_with_deferred_outcomes(spark, sf_dir):
    """The partner takes each batch as a job; the next run finds the jobs still running, the one after that finds them ended, the second of them badly."""
    polls: dict[str, int] = {}

    def poll(handle: str) -> str:
        polls[handle] = polls.get(handle, 0) + 1
        return "running" if polls[handle] == 1 else "failed" if handle.endswith("-1") else "done"

    # By its place among all jobs: a batch_index counts from 0 on each page.
    nth = itertools.count()
    runner = _runner(spark, lambda rows, batch: Job(f"{batch['batch_id']}-{next(nth)}"), poll=poll, attempts=1)
    state = State("customers", CUSTOMERS.source, key={"customer": "c_custkey"}, payload={"nation": "c_nationkey"})
    for _ in range(3):
        runner.run(Sync("sync", state, "partner", "rows"), table(spark, sf_dir, "customer"))
    times = spark.createDataFrame([(h.rpartition("-")[0], n) for h, n in polls.items()], "batch_id string, polls long")
    return runner.store.read("destination_batches").join(times, "batch_id", "left").select("row_count", "attempt_count", "status", "completion_state", "polls")


@query("""WITH e AS (SELECT (row_number() OVER (ORDER BY ts, event_id) - 1) // 500 AS b, event_id FROM events WHERE ts IS NOT NULL),
g AS (SELECT b, count(*)::bigint AS row_count, bool_or(event_id % 4001 = 0) AS changed FROM e GROUP BY 1)
SELECT b::bigint AS batch, row_count, CASE WHEN changed THEN 'failed' ELSE 'succeeded' END AS status, CASE WHEN changed THEN 1 ELSE 2 END::bigint AS attempt_count, CASE WHEN changed THEN 'the range of the batch gives other records' END AS error FROM g""")
def run_with_a_changed_range(spark, sf_dir):
    """Batches of events fail for now; before the next run a few events change. Its sweep sends the batches that are still what they were, and leaves the others open."""
    failing = [True]
    runner = _runner(spark, lambda rows, batch: Counts(batch["row_count"], **{"retryable" if failing[0] else "confirmed": batch["row_count"]}), attempts=1, page_rows=2_000)
    sync = Sync("sync", EVENTS, "partner", "events")
    rows = table(spark, sf_dir, "events")
    runner.run(sync, rows)
    failing[0] = False
    runner.run(sync, rows.withColumn("event_type", F.when(F.col("event_id") % 4001 == 0, "changed").otherwise(F.col("event_type"))))
    found = runner.store.read("destination_batches").withColumns({c: F.get_json_object("upper_json", f"$.{c}") for c in ("cursor", "primary_key")})
    nth = F.row_number().over(inputs.by_position("cursor", F.col("primary_key").cast("long"))) - 1
    return found.select(nth.cast("long").alias("batch"), "row_count", "status", "attempt_count", "error")


@query(f"{PAIR} SELECT kind AS operation, concat('{{\"customer\":', k::varchar, '}}') AS key_json FROM work")
def run_to_files(spark, sf_dir):
    """The same change set, delivered as CSV files and read back."""
    folder = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    runner = Runner(spark, Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"), Registry(files.destination(folder)))
    runner.collect(CUSTOMERS, inputs.PREVIOUS.df(spark, sf_dir))
    sync = Sync("sync", CUSTOMERS, "files", "state")
    report = runner.run(sync, table(spark, sf_dir, "customer"))
    found = files.delivered(spark, f"{folder}/*")
    return found.filter(F.col("collect_id") == report.collected.collect_id).select("operation", "key_json")
