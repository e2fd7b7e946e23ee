"""Every query on the provided tables, with its oracle in DuckDB SQL."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirgate import decisions
from weirgate.declarations import Checkpoint, Event, Identifier, Source, State, StaticTarget
from weirgate.functions import canonical, identifiers, redaction
from weirgate.operators import batching, diff, ledger, ordinal, paging, reconcile, upsert
from weirgate.plans import inputs
from weirgate.plans.inputs import COLLECT, VERSION, table
from weirgate.sources import keyset, sql
from weirgate.sources.keyset import EventPosition, WorkPosition

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
query = inputs.adder(QUERIES, ORACLE_SQL)

CUSTOMERS = State(
    "customers", Source("customers", "SELECT * FROM customer"), key={"customer": "c_custkey"}, target="c_mktsegment", identifiers=[Identifier("name", value="c_name")], payload={"nation": "c_nationkey", "balance": "c_acctbal"}
)
EVENTS = Event(
    "events", Source("events", "SELECT * FROM events", Checkpoint("ts", "event_id", "string", "integer")), key={"event": "event_id"}, occurred_at="ts", identifiers=[Identifier("user", value="user_id")], payload={"kind": "event_type"}
)
LOW, HIGH = datetime.datetime(2024, 1, 5), datetime.datetime(2024, 1, 20)


def _projection(base: str) -> str:
    return f"""SELECT *, concat('{{"key":', key_json, ',"target":', target_json, '}}') AS identity_json,
  sha256(concat('{{"identifiers":', identifiers_json, ',"key":', key_json, ',"payload":', payload_json, ',"target":', target_json, '}}')) AS fingerprint
 FROM (SELECT json_object('customer', c_custkey)::varchar AS key_json, json_object('value', c_mktsegment)::varchar AS target_json,
  concat('[', json_object('type', 'name', 'value', c_name)::varchar, ']') AS identifiers_json, json_object('balance', c_acctbal, 'nation', c_nationkey)::varchar AS payload_json FROM {base})"""


BOTH = f"WITH prev AS ({inputs.PREVIOUS.sql}), s AS ({_projection('customer')}), c AS ({_projection('prev')})"


def _customers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return canonical.project_state(table(spark, sf_dir, "customer"), CUSTOMERS), canonical.project_state(inputs.PREVIOUS.df(spark, sf_dir), CUSTOMERS)


# State: projection, difference, current state.


@query(f"{_projection('customer')}")
def state_projection(spark, sf_dir):
    return _customers(spark, sf_dir)[0]


@query(
    """SELECT json_object('customer', c_custkey)::varchar AS key_json, json_object('value', 'newsletter')::varchar AS target_json,
 concat('[', array_to_string(list_concat([json_object('type', 'name', 'value', c_name)::varchar], list_transform(list_sort(coalesce(ids, [])), lambda x: json_object('type', 'order', 'value', x)::varchar)), ','), ']') AS identifiers_json
 FROM customer LEFT JOIN (SELECT o_custkey, list(DISTINCT o_orderstatus) AS ids FROM orders GROUP BY 1) ON c_custkey = o_custkey"""
)
def state_list_identifiers(spark, sf_dir):
    lists = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderstatus").alias("ids"))
    rows = table(spark, sf_dir, "customer").join(lists, F.col("c_custkey") == F.col("o_custkey"), "left")
    state = State("lists", CUSTOMERS.source, key={"customer": "c_custkey"}, target=StaticTarget("newsletter"), identifiers=[Identifier("name", value="c_name"), Identifier("order", values="ids")])
    return canonical.project_state(rows, state).select("key_json", "target_json", "identifiers_json")


@query(
    f"""{BOTH},
removes AS (SELECT 'remove' AS kind, c.*, row_number() OVER (ORDER BY c.target_json, c.identity_json) - 1 AS sequence_order FROM c LEFT JOIN s ON s.identity_json = c.identity_json WHERE s.identity_json IS NULL),
upserts AS (SELECT 'upsert' AS kind, s.*, (SELECT count(*) FROM removes) + row_number() OVER (ORDER BY s.target_json, s.identity_json) - 1 AS sequence_order
 FROM s LEFT JOIN c ON s.identity_json = c.identity_json WHERE c.identity_json IS NULL OR c.fingerprint <> s.fingerprint)
SELECT sha256(concat('state|', kind, '|{COLLECT}|', identity_json, '|', fingerprint)) AS work_id, '{COLLECT}' AS collect_id, CAST(sequence_order AS BIGINT) AS sequence_order, 'state' AS family, kind,
 'customers' AS declaration_name, 'v1' AS declaration_version_id, key_json, target_json, identifiers_json, payload_json FROM (SELECT * FROM removes UNION ALL SELECT * FROM upserts)"""
)
def state_diff_work(spark, sf_dir):
    """Removes, then upserts, densely ordered: one full outer join and a range-partitioned ordinal."""
    return diff.ordered_work(*_customers(spark, sf_dir), COLLECT, "customers", VERSION)


@query(f"{BOTH} SELECT c.identity_json, c.payload_json FROM c LEFT JOIN s ON s.identity_json = c.identity_json WHERE s.identity_json IS NULL")
def state_removed(spark, sf_dir):
    return diff.removed(*_customers(spark, sf_dir)).select("identity_json", "payload_json")


@query(f"{BOTH} SELECT s.identity_json, s.fingerprint FROM s LEFT JOIN c ON s.identity_json = c.identity_json WHERE c.identity_json IS NULL OR c.fingerprint <> s.fingerprint")
def state_new_or_changed(spark, sf_dir):
    return diff.new_or_changed(*_customers(spark, sf_dir)).select("identity_json", "fingerprint")


@query(
    f"""{BOTH} SELECT 'customers' AS declaration_name, 'customers' AS source_name, identity_json, 'v1' AS declaration_version_id, key_json, target_json, identifiers_json, payload_json, fingerprint, '{COLLECT}' AS collect_id FROM s
UNION ALL SELECT 'others', 'customers', identity_json, 'v0', key_json, target_json, identifiers_json, payload_json, fingerprint, 'before' FROM c"""
)
def state_current_replace(spark, sf_dir):
    """The rows of one declaration give way to its snapshot; those of others stay."""
    now, before = _customers(spark, sf_dir)
    empty = now.limit(0)
    current = diff.replaced_current(diff.replaced_current(diff.replaced_current(_stored(empty), before, "others", "customers", "before", "v0"), before, "customers", "customers", "before", "v0"), now, "customers", "customers", COLLECT, VERSION)
    return current


def _stored(rows: DataFrame) -> DataFrame:
    return rows.select(
        F.lit("").alias("declaration_name"), F.lit("").alias("source_name"), "identity_json", F.lit("").alias("declaration_version_id"), "key_json", "target_json", "identifiers_json", "payload_json", "fingerprint", F.lit("").alias("collect_id")
    )


@query("SELECT concat('{\"order\":', l_orderkey::varchar, '}') AS identity_json, count(*)::bigint AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def duplicate_identity(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(canonical.json_object(table(spark, sf_dir, "lineitem"), {"order": "l_orderkey"}).alias("identity_json"))
    return diff.duplicates(rows)


@query("SELECT event_id, ts, CAST(row_number() OVER (ORDER BY ts, event_id) - 1 AS BIGINT) AS sequence_order FROM events")
def dense_ordinal(spark, sf_dir):
    """The place of each event in time, without a single-task window."""
    return ordinal.with_ordinal(table(spark, sf_dir, "events").select("event_id", "ts"), [F.col("ts").asc_nulls_last(), F.col("event_id").asc_nulls_last()])


@query(f"{BOTH} SELECT count(*)::bigint AS n, count(DISTINCT target_json)::bigint AS targets, min(identity_json) AS first_identity, max(identity_json) AS last_identity FROM s")
def state_current_summary(spark, sf_dir):
    return _customers(spark, sf_dir)[0].agg(F.count("*").alias("n"), F.countDistinct("target_json").alias("targets"), F.min("identity_json").alias("first_identity"), F.max("identity_json").alias("last_identity"))


# Pages of ordered work.

WORK = f"WITH w AS ({inputs.WORK_LOG.sql})"


@query(f"{WORK}, f AS (SELECT *, row_number() OVER (ORDER BY collect_id, sequence_order) AS nth FROM w WHERE collect_id > '018f-0' OR (collect_id = '018f-0' AND sequence_order > 20)) SELECT work_id, collect_id, sequence_order FROM f WHERE nth <= 500 AND (collect_id < (SELECT collect_id FROM f WHERE nth = 501) OR NOT EXISTS (SELECT 1 FROM f WHERE nth <= 500 AND collect_id < (SELECT collect_id FROM f WHERE nth = 501)))")
def pending_page(spark, sf_dir):
    """Pending work after a position, cut back to whole collects."""
    return paging.pending_page(inputs.WORK_LOG.df(spark, sf_dir), WorkPosition("018f-0", 20), 500).rows.select("work_id", "collect_id", "sequence_order")


@query(f"{WORK} SELECT work_id, collect_id, sequence_order FROM w WHERE collect_id = '018f-2' AND sequence_order > 10 ORDER BY sequence_order LIMIT 50")
def pending_page_after_cursor(spark, sf_dir):
    return paging.page_after_cursor(inputs.WORK_LOG.df(spark, sf_dir), WorkPosition("018f-2", 10), 50).select("work_id", "collect_id", "sequence_order")


@query(f"{WORK} SELECT work_id, collect_id, sequence_order FROM w WHERE (collect_id > '018f-1' OR (collect_id = '018f-1' AND sequence_order >= 12)) AND (collect_id < '018f-3' OR (collect_id = '018f-3' AND sequence_order <= 7))")
def work_range_replay(spark, sf_dir):
    return paging.replay(inputs.WORK_LOG.df(spark, sf_dir), WorkPosition("018f-1", 12), WorkPosition("018f-3", 7)).select("work_id", "collect_id", "sequence_order")


@query(f"{WORK}, r AS (SELECT collect_id, sequence_order FROM w WHERE (collect_id > '018f-1' OR (collect_id = '018f-1' AND sequence_order >= 12)) AND (collect_id < '018f-3' OR (collect_id = '018f-3' AND sequence_order <= 7))) SELECT (SELECT collect_id FROM r ORDER BY 1, sequence_order LIMIT 1) AS first_collect_id, (SELECT sequence_order FROM r ORDER BY collect_id, 1 LIMIT 1) AS first_sequence_order, (SELECT collect_id FROM r ORDER BY 1 DESC, sequence_order DESC LIMIT 1) AS last_collect_id, (SELECT sequence_order FROM r ORDER BY collect_id DESC, 1 DESC LIMIT 1) AS last_sequence_order, (SELECT count(*) FROM r)::bigint AS row_count")
def work_range_edges(spark, sf_dir):
    return paging.edges(paging.replay(inputs.WORK_LOG.df(spark, sf_dir), WorkPosition("018f-1", 12), WorkPosition("018f-3", 7)))


@query(f"{BOTH} SELECT concat('state-current:', identity_json) AS work_id, '{COLLECT}' AS collect_id, CAST(row_number() OVER (ORDER BY identity_json) - 1 AS BIGINT) AS sequence_order, 'state' AS family, 'upsert' AS kind, 'customers' AS declaration_name, 'v1' AS declaration_version_id, key_json, target_json, identifiers_json, payload_json FROM (SELECT * FROM s WHERE identity_json > '{{\"key\":{{\"customer\":5' ORDER BY identity_json LIMIT 100)")
def resend_all_page(spark, sf_dir):
    now, _ = _customers(spark, sf_dir)
    current = diff.replaced_current(_stored(now.limit(0)), now, "customers", "customers", COLLECT, VERSION)
    return paging.current_page(current, '{"key":{"customer":5', 100, COLLECT)


@query(f"{WORK} SELECT declaration_name, count(*)::bigint AS row_count, min(collect_id) AS first_collect_id, max(collect_id) AS last_collect_id, min(created_at) AS first_created_at, max(created_at) AS last_created_at FROM w GROUP BY 1")
def work_bounds(spark, sf_dir):
    return ledger.work_bounds(inputs.WORK_LOG.df(spark, sf_dir), "declaration_name")


# Events.

EVENT_ROWS = """SELECT ts AS cursor, event_id AS primary_key, ts::varchar AS occurred_at, json_object('event', event_id)::varchar AS key_json, concat('[', json_object('type', 'user', 'value', user_id)::varchar, ']') AS identifiers_json,
 json_object('kind', event_type)::varchar AS payload_json, concat('{"key":', json_object('event', event_id)::varchar, ',"occurred_at":"', ts::varchar, '"}') AS identity_json FROM events"""
IN_WINDOW = f"((ts > TIMESTAMP '{LOW}') OR (ts = TIMESTAMP '{LOW}' AND event_id > 10)) AND ((ts < TIMESTAMP '{HIGH}') OR (ts = TIMESTAMP '{HIGH}' AND event_id <= 99))"


def _window(spark, sf_dir, limit=None):
    return keyset.window(table(spark, sf_dir, "events"), "ts", "event_id", [LOW, 10], [HIGH, 99], limit)


@query(f"SELECT *, sha256(identity_json) AS fingerprint FROM ({EVENT_ROWS})")
def event_projection(spark, sf_dir):
    return canonical.project_event(table(spark, sf_dir, "events"), EVENTS)


@query(f"SELECT * FROM events WHERE {IN_WINDOW}")
def event_window(spark, sf_dir):
    """(after, through] by (ts, event_id); the predicate goes down to the Parquet scan."""
    return _window(spark, sf_dir)


@query("SELECT user_id, event_id FROM events WHERE user_id > 20 OR (user_id = 20 AND event_id > 500) ORDER BY user_id, event_id LIMIT 300")
def event_window_ties(spark, sf_dir):
    """A cursor with many rows of one value: the primary key decides."""
    return keyset.window(table(spark, sf_dir, "events"), "user_id", "event_id", [20, 500], None, 300).select("user_id", "event_id")


@query(f"SELECT max(ts) AS cursor, max_by(event_id, (ts, event_id)) AS primary_key FROM events WHERE {IN_WINDOW}")
def event_upper_bound(spark, sf_dir):
    return keyset.upper_bound(_window(spark, sf_dir), "ts", "event_id")


EVENT_PAGE = f"""WITH e AS (SELECT * FROM ({EVENT_ROWS}) WHERE {IN_WINDOW.replace("ts", "cursor").replace("event_id", "primary_key")} ORDER BY cursor, primary_key LIMIT 400)
SELECT sha256(concat('event|import|{COLLECT}|', identity_json, '|', sha256(identity_json))) AS work_id, CAST(row_number() OVER (ORDER BY cursor, primary_key) - 1 AS BIGINT) AS sequence_order, key_json, payload_json, cursor::varchar AS event_cursor, primary_key::varchar AS event_primary_key"""


def _event_page(spark, sf_dir):
    projected = canonical.project_event(_window(spark, sf_dir), EVENTS)
    return paging.event_page(projected, COLLECT, "events", VERSION, EventPosition(str(LOW), 10), 400)


@query(f"{EVENT_PAGE}, '{LOW}' AS lower_cursor, '10' AS lower_primary_key FROM e")
def event_page(spark, sf_dir):
    return _event_page(spark, sf_dir).select("work_id", "sequence_order", "key_json", "payload_json", "event_cursor", "event_primary_key", "lower_cursor", "lower_primary_key")


@query(f"SELECT work_id, sequence_order, coalesce(lag(event_cursor) OVER (ORDER BY sequence_order), '{LOW}') AS lower_cursor, coalesce(lag(event_primary_key) OVER (ORDER BY sequence_order), '10') AS lower_primary_key FROM ({EVENT_PAGE} FROM e)")
def event_lower_bounds(spark, sf_dir):
    """Each import's range begins where the one before it ends."""
    return paging.lower_bounds(_event_page(spark, sf_dir), EventPosition(str(LOW), 10)).select("work_id", "sequence_order", "lower_cursor", "lower_primary_key")


@query(f"SELECT event_id, ts FROM events WHERE {IN_WINDOW} AND ts >= TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-01-12'")
def event_replay_range(spark, sf_dir):
    low, high = datetime.datetime(2024, 1, 10), datetime.datetime(2024, 1, 12)
    return keyset.window(_window(spark, sf_dir), "ts", "event_id", [low, -1], [high, 1 << 60]).select("event_id", "ts")


# Sources.


@query("SELECT c_custkey, c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0")
def snapshot_scan(spark, sf_dir):
    """An author's query as it is."""
    return sql.snapshot(spark, " SELECT c_custkey, c_name, n_name FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey WHERE c_acctbal > 0 ; ", customer=table(spark, sf_dir, "customer"), nation=table(spark, sf_dir, "nation"))


@query("SELECT o_orderkey, o_totalprice, concat(strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S'), 'Z') AS o_orderdate FROM orders")
def source_values(spark, sf_dir):
    """Source values as JSON can carry them."""
    return sql.normalized(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderdate"))


@query(f"{WORK} SELECT work_id, json_extract_string(key_json, '$.customer') AS customer, json_extract_string(target_json, '$.value') AS target FROM w")
def json_extract(spark, sf_dir):
    return inputs.WORK_LOG.df(spark, sf_dir).select("work_id", F.get_json_object("key_json", "$.customer").alias("customer"), F.get_json_object("target_json", "$.value").alias("target"))


# Reconcile.


@query(f"{WORK} SELECT work_id, kind AS operation FROM w WHERE kind = 'upsert'")
def reconcile_upserts_only(spark, sf_dir):
    return reconcile.reconciled_state(inputs.WORK_LOG.df(spark, sf_dir), ["upsert"]).select("work_id", "operation")


@query(f"{WORK} SELECT count(*)::bigint AS row_count, count(*) FILTER (kind = 'upsert')::bigint AS upsert_count, count(*) FILTER (kind = 'remove')::bigint AS remove_count, 0::bigint AS import_count, count(*) FILTER (kind = 'remove')::bigint AS suppressed_count FROM w")
def reconcile_counts(spark, sf_dir):
    return reconcile.counts(inputs.WORK_LOG.df(spark, sf_dir), ["upsert"])


@query(f"{WORK} SELECT work_id, collect_id, sequence_order FROM w WHERE kind = 'remove' ORDER BY collect_id, sequence_order LIMIT 5")
def reconcile_left_out_sample(spark, sf_dir):
    return reconcile.left_out_sample(inputs.WORK_LOG.df(spark, sf_dir)).select("work_id", "collect_id", "sequence_order")


# Request batches.


def _page(spark, sf_dir):
    return inputs.WORK_LOG.df(spark, sf_dir).filter("collect_id = '018f-1'")


ISLANDS = f"""{WORK}, p AS (SELECT *, coalesce(lag(kind) OVER (ORDER BY sequence_order) <> kind, false)::int AS brk FROM w WHERE collect_id = '018f-1'),
i AS (SELECT *, sum(brk) OVER (ORDER BY sequence_order) AS island FROM p), k AS (SELECT *, (row_number() OVER (PARTITION BY island ORDER BY sequence_order) - 1) // 2 AS part FROM i),
b AS (SELECT *, CAST(dense_rank() OVER (ORDER BY island, part) - 1 AS BIGINT) AS batch_index FROM k)"""


@query(f"{ISLANDS} SELECT work_id, batch_index FROM b")
def request_islands(spark, sf_dir):
    """Neighbours of one operation, two records a request."""
    return batching.unit_batches(_page(spark, sf_dir), "sequence_order", ["kind"], 2).select("work_id", "batch_index")


@query(f"{ISLANDS} SELECT batch_index, count(*)::bigint AS row_count, count(*)::bigint AS item_count, min(kind) AS operation, min(sequence_order) AS first_order, max(sequence_order) AS last_order FROM b GROUP BY 1")
def request_batches(spark, sf_dir):
    return batching.batches(batching.unit_batches(_page(spark, sf_dir), "sequence_order", ["kind"], 2))


@query(f"{ISLANDS} SELECT batch_index, concat('[', string_agg(key_json, ',' ORDER BY sequence_order), ']') AS body FROM b GROUP BY 1")
def request_bodies(spark, sf_dir):
    return batching.bodies(batching.unit_batches(_page(spark, sf_dir), "sequence_order", ["kind"], 2), F.col("key_json"))


@query(f"{ISLANDS} SELECT work_id, batch_index FROM b")
def request_weighted_fill(spark, sf_dir):
    """The same batches by items: each record counts five of ten."""
    page = _page(spark, sf_dir).withColumn("item_count", F.lit(5).cast("long")).withColumn("byte_count", F.length("key_json").cast("long"))
    return batching.weighted_batches(page, "sequence_order", ["kind"], 10).select("work_id", "batch_index")


# Partner identifiers.

CONTACTS = f"WITH c AS ({inputs.CONTACTS.sql})"
CANONICAL = "CASE WHEN split_part(e, '@', 2) IN ('gmail.com', 'googlemail.com') THEN concat(replace(split_part(e, '@', 1), '.', ''), '@', split_part(e, '@', 2)) ELSE e END"


@query(f"{CONTACTS} SELECT id, {CANONICAL} AS email FROM (SELECT id, lower(regexp_replace(email, '\\s', '', 'g')) AS e FROM c)")
def email_canonical(spark, sf_dir):
    return inputs.CONTACTS.df(spark, sf_dir).select("id", identifiers.email(F.col("email")).alias("email"))


@query(f"{CONTACTS} SELECT id, sha256({CANONICAL}) AS email, CASE WHEN regexp_full_match(trim(phone), '[0-9a-fA-F]{{64}}') THEN lower(trim(phone)) ELSE sha256(trim(phone)) END AS phone, trim(madid) AS madid, sha256(lower(trim(email))) AS name FROM (SELECT *, lower(regexp_replace(email, '\\s', '', 'g')) AS e FROM c)")
def hashed_identifiers(spark, sf_dir):
    c = inputs.CONTACTS.df(spark, sf_dir)
    return c.select("id", identifiers.hashed_email(F.col("email")).alias("email"), identifiers.hashed(F.col("phone")).alias("phone"), identifiers.stripped(F.col("madid")).alias("madid"), identifiers.hashed_name(F.col("email")).alias("name"))


@query(f"{CONTACTS} SELECT id, CASE WHEN upper(trim(status)) IN ('GRANTED', 'DENIED') THEN upper(trim(status)) END AS status FROM c")
def consent_status(spark, sf_dir):
    return inputs.CONTACTS.df(spark, sf_dir).select("id", identifiers.consent(F.col("status")).alias("status"))


@query(f"{CONTACTS} SELECT id, CASE WHEN id % 3 = 2 THEN NULL ELSE CAST(epoch(substr(at_text, 1, 19)::timestamp) - CASE WHEN id % 3 = 1 THEN 7200 ELSE 0 END AS BIGINT) END AS seconds FROM c")
def event_epoch_seconds(spark, sf_dir):
    return inputs.CONTACTS.df(spark, sf_dir).select("id", identifiers.epoch_seconds(F.col("at_text")).alias("seconds"))


@query(f"{CONTACTS} SELECT id, CASE trim(event) WHEN 'Purchase' THEN 'px-1' WHEN 'Lead' THEN 'px-2' ELSE 'px-0' END AS route FROM c")
def event_routes(spark, sf_dir):
    return inputs.CONTACTS.df(spark, sf_dir).select("id", identifiers.routed(F.col("event"), {"Purchase": "px-1", "Lead": " px-2 "}, "px-0").alias("route"))


def _identified(spark, sf_dir):
    c = inputs.CONTACTS.df(spark, sf_dir)
    wanted = [Identifier("email", value="email"), Identifier("phone_e164", value="phone"), Identifier("mobile_advertising_id", value="madid")]
    return c.select("id", identifiers.parsed(canonical.identifiers(c, wanted)).alias("ids"))


HAS = "(email IS NOT NULL)::int AS e, (phone IS NOT NULL)::int AS p, (trim(madid) <> '')::int AS m"


@query(f"{CONTACTS} SELECT id, CASE WHEN e + p + m = 0 THEN 0 ELSE 1 END::bigint AS audience_items, CASE WHEN e + p + m = 0 THEN 0 ELSE 1 END::bigint AS preferred_items, CASE WHEN e = 1 THEN 'email' WHEN p = 1 THEN 'phone_e164' WHEN m = 1 THEN 'mobile_advertising_id' END AS preferred_type FROM (SELECT id, {HAS} FROM c)")
def item_counts(spark, sf_dir):
    ids = F.col("ids")
    return _identified(spark, sf_dir).select("id", identifiers.audience_items(ids, identifiers.PREFERRED).alias("audience_items"), identifiers.preferred_items(ids).alias("preferred_items"), identifiers.preferred_type(ids).alias("preferred_type"))


@query("SELECT o_custkey AS id, count(*)::bigint AS values_given, CASE WHEN count(*) = 1 THEN 1 ELSE count(*) END::bigint AS audience_items FROM orders GROUP BY 1")
def item_counts_of_lists(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.collect_list(F.col("o_orderkey").cast("string")).alias("orders"), F.count("*").alias("values_given"))
    ids = identifiers.parsed(canonical.identifiers(rows, [Identifier("order", values="orders")]))
    return rows.select("id", "values_given", identifiers.audience_items(ids, ["order"]).alias("audience_items"))


@query("SELECT DISTINCT trim(c_mktsegment) AS target FROM customer WHERE trim(c_mktsegment) <> ''")
def distinct_targets(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(identifiers.normalized_targets(F.concat(F.lit(" "), "c_mktsegment")).alias("target")).filter("target is not null").distinct()


# Ledger.

BATCHES = f"WITH b AS ({inputs.LEDGER.sql})"
RETRY = "status = 'failed' AND coalesce(retry_eligible, false) AND attempt_count < 3"


@query(f"{BATCHES} SELECT batch_id, status, attempt_count FROM b WHERE completion_state = 'unresolved' AND (status = 'pending' OR ({RETRY}))")
def retry_candidates(spark, sf_dir):
    return ledger.retry_candidates(inputs.LEDGER.df(spark, sf_dir), 3).select("batch_id", "status", "attempt_count")


@query(f"{BATCHES} SELECT status, completion_state, count(*)::bigint AS n FROM b GROUP BY 1, 2")
def batch_status_counts(spark, sf_dir):
    return ledger.status_counts(inputs.LEDGER.df(spark, sf_dir))


@query(
    f"""{BATCHES}, p AS (SELECT *, CASE WHEN status IN ('accepted', 'succeeded', 'skipped') AND completion_state = 'resolved' THEN 'skip' WHEN ({RETRY}) OR (attempt_count = 0 AND status = 'pending') THEN 'submit' ELSE 'block' END AS plain FROM b)
SELECT batch_id, CASE WHEN plain = 'submit' AND max((plain = 'block')::int) OVER (PARTITION BY page_id) = 1 THEN 'hold' ELSE plain END AS action FROM p"""
)
def rerun_plan(spark, sf_dir):
    return ledger.rerun_plan(inputs.LEDGER.df(spark, sf_dir), 3).select("batch_id", "action")


@query(f"{BATCHES} SELECT batch_id FROM b WHERE first_collect_id <= '018f-0040' AND last_collect_id >= '018f-0038'")
def overlapping_batches(spark, sf_dir):
    return ledger.overlapping(inputs.LEDGER.df(spark, sf_dir), "018f-0038", "018f-0040").select("batch_id")


@query(f"{BATCHES} SELECT batch_id, CASE WHEN completion_state = 'unresolved' THEN 'skipped' ELSE status END AS status, 'resolved' AS completion_state FROM b")
def dismiss_unresolved(spark, sf_dir):
    return ledger.dismissed(inputs.LEDGER.df(spark, sf_dir)).select("batch_id", "status", "completion_state")


@query(
    f"""WITH p AS ({inputs.PROGRESS.sql}), b AS ({inputs.LEDGER.sql}), w AS ({inputs.COLLECTS.sql}),
passed AS (SELECT declaration_name, min(collect_id) AS passed FROM p GROUP BY 1 HAVING count(*) = count(collect_id)),
blocker AS (SELECT passed.declaration_name, min(first_collect_id) AS blocker FROM passed JOIN b ON b.declaration_name = passed.declaration_name AND completion_state = 'unresolved' AND first_collect_id <= passed GROUP BY 1)
SELECT passed.declaration_name, CASE WHEN blocker IS NULL THEN passed ELSE (SELECT max(collect_id) FROM w WHERE w.declaration_name = passed.declaration_name AND w.collect_id < blocker.blocker) END AS watermark FROM passed LEFT JOIN blocker ON blocker.declaration_name = passed.declaration_name"""
)
def retention_watermark(spark, sf_dir):
    return ledger.retention_watermark(inputs.PROGRESS.df(spark, sf_dir), inputs.LEDGER.df(spark, sf_dir), inputs.COLLECTS.df(spark, sf_dir))


@query(f"{WORK} SELECT max(collect_id) AS collect_id FROM (SELECT collect_id FROM w GROUP BY 1 HAVING max(created_at) <= DATE '2024-10-27')")
def age_boundary(spark, sf_dir):
    return ledger.age_boundary(inputs.WORK_LOG.df(spark, sf_dir), datetime.date(2024, 10, 27))


@query(f"WITH b AS ({inputs.LEDGER.sql}), r AS ({inputs.RUNS.sql}) SELECT batch_id, (created_at <= DATE '1996-06-30' AND run_id NOT IN (SELECT run_id FROM r WHERE status = 'running')) AS expired FROM b")
def cleanup_expired(spark, sf_dir):
    return ledger.cleanup_split(inputs.LEDGER.df(spark, sf_dir), inputs.RUNS.df(spark, sf_dir), datetime.date(1996, 6, 30)).select("batch_id", "expired")


@query(f"WITH r AS ({inputs.REPORTS.sql}) SELECT sync_name, max(CAST(regexp_extract(attempt_id, ':attempt-(\\d+)$', 1) AS BIGINT)) AS attempt FROM r WHERE regexp_extract(attempt_id, ':attempt-(\\d+)$', 1) <> '' GROUP BY 1")
def last_attempts(spark, sf_dir):
    return ledger.last_attempts(inputs.REPORTS.df(spark, sf_dir))


@query(f"WITH r AS ({inputs.REPORTS.sql}) SELECT report_id, created_at FROM r ORDER BY created_at DESC, report_id LIMIT 10")
def recent_reports(spark, sf_dir):
    return ledger.ranked_reports(inputs.REPORTS.df(spark, sf_dir)).select("report_id", "created_at")


@query(f"{BATCHES} SELECT DISTINCT sync_name, declaration_name FROM b ORDER BY 1, 2 LIMIT 20")
def known_scopes(spark, sf_dir):
    return inputs.LEDGER.df(spark, sf_dir).select("sync_name", "declaration_name").distinct().orderBy("sync_name", "declaration_name").limit(20)


# Changes to keyed tables.


@query(f"WITH n AS ({inputs.PREVIOUS.sql}) SELECT coalesce(n.c_custkey, o.c_custkey) AS c_custkey, CASE WHEN n.c_custkey IS NOT NULL AND o.c_custkey IS NOT NULL THEN coalesce(o.c_mktsegment, n.c_mktsegment) ELSE coalesce(n.c_mktsegment, o.c_mktsegment) END AS c_mktsegment, coalesce(n.c_nationkey, o.c_nationkey) AS c_nationkey FROM customer o FULL JOIN n ON n.c_custkey = o.c_custkey")
def upsert_by_key(spark, sf_dir):
    """Rows go in by key; the segment once set stays."""
    names = ["c_custkey", "c_mktsegment", "c_nationkey"]
    target, source = table(spark, sf_dir, "customer").select(*names), inputs.PREVIOUS.df(spark, sf_dir).select(*names)
    return upsert.upserted(target, source, ["c_custkey"], {"c_mktsegment": F.coalesce("old.c_mktsegment", "new.c_mktsegment")})


@query(f"WITH n AS ({inputs.PREVIOUS.sql}) SELECT o.c_custkey, CASE WHEN n.c_custkey IS NULL THEN o.c_nationkey ELSE n.c_nationkey END AS c_nationkey, o.c_name FROM customer o LEFT JOIN n ON n.c_custkey = o.c_custkey")
def update_by_key(spark, sf_dir):
    names = ["c_custkey", "c_nationkey", "c_name"]
    return upsert.updated(table(spark, sf_dir, "customer").select(*names), inputs.PREVIOUS.df(spark, sf_dir).select("c_custkey", "c_nationkey"), ["c_custkey"])


@query(f"{BATCHES} SELECT batch_id FROM b WHERE NOT coalesce(retry_eligible, false)")
def delete_where(spark, sf_dir):
    return upsert.deleted(inputs.LEDGER.df(spark, sf_dir), F.col("retry_eligible")).select("batch_id")


# Responses and redaction.


@query(
    f"""WITH s AS ({inputs.STATUSES.sql}), o AS (SELECT *, CASE WHEN status = 202 THEN 'accepted' WHEN status IN (200, 201, 204) THEN 'confirmed' WHEN status IN (401, 403, 422) THEN 'pre_acceptance_failure' WHEN status IN (408, 409, 425, 429, 500, 502, 503, 504) THEN 'retryable_failure' WHEN status BETWEEN 400 AND 499 THEN 'terminal_record_failure' ELSE 'pre_acceptance_failure' END AS outcome FROM s)
SELECT event_id, outcome, CASE WHEN outcome = 'pre_acceptance_failure' THEN CASE WHEN status IN (401, 403) THEN 'auth' WHEN status = 422 THEN 'schema' ELSE 'submission' END END AS category FROM o"""
)
def http_outcomes(spark, sf_dir):
    return inputs.STATUSES.df(spark, sf_dir).select("event_id", decisions.outcome(F.col("status")).alias("outcome"), decisions.category(F.col("status")).alias("category"))


def _redaction_sql(text: str) -> str:
    import re

    for pattern, instead in redaction.RULES:
        escaped = pattern.replace("'", "''")
        text = f"regexp_replace({text}, '{escaped}', '{re.sub(r'[$]([0-9])', r'\\\1', instead)}', 'g')"
    return text


@query(f"SELECT doc_id, CASE WHEN length(t) > 160 THEN concat(substring(t, 1, 160), '...') ELSE t END AS text, length(t)::bigint AS whole_length FROM (SELECT doc_id, {_redaction_sql('text')} AS t FROM documents)")
def text_redaction(spark, sf_dir):
    whole = table(spark, sf_dir, "documents").select("doc_id", redaction.redacted(F.col("text"), None).alias("t"))
    most = redaction.MOST_TEXT
    return whole.select("doc_id", F.when(F.length("t") > most, F.concat(F.substring("t", 1, most), F.lit("..."))).otherwise(F.col("t")).alias("text"), F.length("t").cast("long").alias("whole_length"))


from weirgate.plans import runtime  # noqa: E402

QUERIES |= runtime.QUERIES
ORACLE_SQL |= runtime.ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES"]
