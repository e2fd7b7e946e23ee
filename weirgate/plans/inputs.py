"""Tables that the queries read besides the provided ones, derived from those by expressions that both engines read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, WindowSpec

COLLECT = "018f3c00-0000-7000-8000-000000000001"
VERSION = "v1"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def adder(queries: dict, oracles: dict):
    """A decorator that enters a query under its name, with its oracle if it has one."""

    def query(oracle: str | None = None):
        def add(f):
            queries[f.__name__] = f
            if oracle:
                oracles[f.__name__] = oracle
            return f

        return add

    return query


class Derived:
    """Columns by name and expression over one provided table."""

    def __init__(self, base: str, where: str | None = None, **columns: str) -> None:
        self.base, self.where, self.columns = base, where, columns

    def df(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, self.base)
        rows = rows.filter(self.where) if self.where else rows
        return rows.selectExpr(*[f"{e} AS {c}" for c, e in self.columns.items()])

    @property
    def sql(self) -> str:
        return f"SELECT {', '.join(f'{e} AS {c}' for c, e in self.columns.items())} FROM {self.base}" + (f" WHERE {self.where}" if self.where else "")


#: What the customers were before: some missing, some in another segment or nation, the last five under other keys.
PREVIOUS = Derived(
    "customer",
    "c_custkey % 10 <> 3",
    c_custkey="CASE WHEN c_custkey % 150 > 144 THEN c_custkey + 1000000 ELSE c_custkey END",
    c_name="c_name",
    c_nationkey="CASE WHEN c_custkey % 11 = 0 THEN c_nationkey + 100 ELSE c_nationkey END",
    c_acctbal="c_acctbal",
    c_mktsegment="CASE WHEN c_custkey % 7 = 0 THEN 'OLD' ELSE c_mktsegment END",
)

WORK_LOG = Derived(
    "customer",
    work_id="concat('w-', cast(c_custkey AS string))",
    collect_id="concat('018f-', cast(c_nationkey % 5 AS string))",
    sequence_order="cast(row_number() OVER (PARTITION BY c_nationkey % 5 ORDER BY c_custkey) - 1 AS bigint)",
    family="'state'",
    kind="CASE WHEN c_custkey % 4 = 0 THEN 'remove' ELSE 'upsert' END",
    declaration_name="concat('decl_', cast(c_nationkey % 4 AS string))",
    declaration_version_id="'v1'",
    key_json="concat('{\"customer\":', cast(c_custkey AS string), '}')",
    target_json="concat('{\"value\":\"', c_mktsegment, '\"}')",
    identifiers_json="'[]'",
    payload_json="'{}'",
    created_at="date '2024-01-01' + cast(c_custkey % 300 AS int)",
)

LEDGER = Derived(
    "orders",
    batch_id="concat('b-', cast(o_orderkey AS string))",
    sync_name="concat('sync_', cast(o_custkey % 3 AS string))",
    declaration_name="concat('decl_', cast(o_custkey % 4 AS string))",
    page_id="concat('page-', cast(o_orderkey % 500 AS string))",
    status="CASE o_orderkey % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'failed' WHEN 2 THEN 'succeeded' WHEN 3 THEN 'accepted' ELSE 'skipped' END",
    completion_state="CASE WHEN o_orderkey % 5 IN (0, 1) OR o_orderkey % 1009 = 3 THEN 'unresolved' ELSE 'resolved' END",
    retry_eligible="CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderkey % 3 <> 1 END",
    attempt_count="cast(o_orderkey % 6 AS bigint)",
    first_collect_id="concat('018f-', lpad(cast(o_orderkey % 97 AS string), 4, '0'))",
    last_collect_id="concat('018f-', lpad(cast(o_orderkey % 97 + o_custkey % 3 AS string), 4, '0'))",
    created_at="cast(o_orderdate AS date)",
    run_id="concat('run-', cast(o_orderkey % 40 AS string))",
)

RUNS = Derived("nation", run_id="concat('run-', cast(n_nationkey AS string))", status="CASE WHEN n_nationkey % 3 = 0 THEN 'running' ELSE 'completed' END")

PROGRESS = Derived(
    "nation",
    sync_name="concat('sync_', cast(n_nationkey AS string))",
    declaration_name="concat('decl_', cast(n_nationkey % 5 AS string))",
    collect_id="CASE WHEN n_nationkey = 4 THEN NULL ELSE concat('018f-', lpad(cast(n_nationkey + 20 AS string), 4, '0')) END",
)

COLLECTS = Derived("orders", declaration_name="concat('decl_', cast(o_custkey % 4 AS string))", collect_id="concat('018f-', lpad(cast(o_orderkey % 97 AS string), 4, '0'))")

REPORTS = Derived(
    "orders",
    report_id="concat('r-', cast(o_orderkey AS string))",
    sync_name="concat('sync_', cast(o_custkey % 50 AS string))",
    attempt_id="concat('runner:sync_', cast(o_custkey % 50 AS string), CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE concat(':attempt-', cast(o_orderkey % 1000 AS string)) END)",
    created_at="cast(o_orderdate AS date)",
)

CONTACTS = Derived(
    "customer",
    id="c_custkey",
    email="CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE concat(CASE WHEN c_custkey % 3 = 0 THEN '  ' ELSE '' END, replace(c_name, '#', '.'), CASE c_custkey % 4 WHEN 0 THEN '@GMail.com ' WHEN 1 THEN ' @googlemail.com' ELSE '@Example.com' END) END",
    phone="CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 6 = 0 THEN 'ABCDEF0123456789abcdef0123456789ABCDEF0123456789abcdef0123456789' ELSE concat(' +1555', lpad(cast(c_custkey AS string), 7, '0')) END",
    madid="CASE WHEN c_custkey % 7 = 0 THEN concat('AA-', cast(c_custkey AS string), ' ') ELSE ' ' END",
    status="CASE c_custkey % 4 WHEN 0 THEN ' granted' WHEN 1 THEN 'Denied ' WHEN 2 THEN 'unknown' ELSE NULL END",
    at_text="concat('2024-03-', lpad(cast(c_custkey % 28 + 1 AS string), 2, '0'), 'T10:20:30', CASE c_custkey % 3 WHEN 0 THEN 'Z' WHEN 1 THEN '+02:00' ELSE '' END)",
    event="CASE c_custkey % 4 WHEN 0 THEN 'Purchase' WHEN 1 THEN ' Lead ' WHEN 2 THEN 'View' ELSE NULL END",
)

STATUSES = Derived("events", event_id="event_id", status="cast(CASE event_id % 12 WHEN 0 THEN 200 WHEN 1 THEN 202 WHEN 2 THEN 401 WHEN 3 THEN 422 WHEN 4 THEN 429 WHEN 5 THEN 503 WHEN 6 THEN 404 WHEN 7 THEN 302 WHEN 8 THEN 599 WHEN 9 THEN 204 WHEN 10 THEN 409 ELSE 403 END AS int)")

#: Batches with their whole identity; every third is of events.
RANGED = Derived(
    "orders",
    order_key="o_orderkey",
    sync_name="concat('sync_', cast(o_custkey % 3 AS string))",
    destination_name="'partner'",
    surface="'rows'",
    family="CASE WHEN o_orderkey % 3 = 0 THEN 'event' ELSE 'state' END",
    declaration_name="concat('decl_', cast(o_custkey % 4 AS string))",
    declaration_version_id="concat('v', cast(o_orderkey % 2 AS string))",
    page_id="concat('page-', cast(o_orderkey % 500 AS string))",
    batch_index="cast(o_orderkey % 7 AS bigint)",
    row_count="cast(1 + o_orderkey % 5 AS bigint)",
    first_collect_id="concat('018f-', lpad(cast(o_orderkey % 97 AS string), 4, '0'))",
    first_order="cast(o_orderkey % 11 AS bigint)",
    last_collect_id="concat('018f-', lpad(cast(o_orderkey % 97 + o_custkey % 3 AS string), 4, '0'))",
    last_order="cast(o_orderkey % 11 + 4 AS bigint)",
    lower_json="CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE concat('[', cast(o_orderkey AS string), ']') END",
    upper_json="concat('[', cast(o_orderkey + 3 AS string), ']')",
    payload_fingerprint="concat('p', cast(o_custkey AS string))",
    request_fingerprint="concat('r', cast(o_custkey % 9 AS string))",
    status="CASE o_orderkey % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'failed' WHEN 2 THEN 'succeeded' WHEN 3 THEN 'accepted' ELSE 'skipped' END",
    completion_state="CASE WHEN o_orderkey % 5 IN (0, 1) THEN 'unresolved' ELSE 'resolved' END",
    retry_eligible="CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderkey % 3 <> 1 END",
    attempt_count="cast(o_orderkey % 6 AS bigint)",
)

#: Where consumers are inside of collects.
INSIDE = Derived("nation", declaration_name="concat('decl_', cast(n_nationkey % 4 AS string))", collect_id="CASE WHEN n_nationkey = 23 THEN NULL ELSE concat('018f-', cast(n_nationkey % 3 + 1 AS string)) END", sequence_order="cast(n_nationkey * n_nationkey * 1000 AS bigint)")

#: Batches of pages with the outcome of each page in counts.
ANSWERED = Derived(
    "orders",
    batch_id="concat('b-', cast(o_orderkey AS string))",
    page_id="concat('page-', cast(o_orderkey - o_orderkey % 8 AS string))",
    batch_index="cast(o_orderkey % 8 AS bigint)",
    row_count="cast(1 + o_orderkey % 3 AS bigint)",
    confirmed="cast((o_orderkey - o_orderkey % 8) % 7 AS bigint)",
    accepted="cast((o_orderkey - o_orderkey % 8) % 3 AS bigint)",
    terminal="cast((o_orderkey - o_orderkey % 8) % 5 AS bigint)",
    retryable="cast((o_orderkey - o_orderkey % 8) % 4 AS bigint)",
    before_acceptance="cast((o_orderkey - o_orderkey % 8) % 6 AS bigint)",
)

RUN_REPORTS = Derived("orders", run_id="concat('run-', cast(o_custkey % 40 AS string))", status="CASE o_orderkey % 3 WHEN 0 THEN 'succeeded' WHEN 1 THEN 'stopped' ELSE 'failed' END", attempted="cast(o_orderkey % 100 AS bigint)", confirmed="cast(o_orderkey % 50 AS bigint)", accepted="cast(o_orderkey % 20 AS bigint)", terminal="cast(o_orderkey % 3 AS bigint)", retryable="cast(o_orderkey % 4 AS bigint)", before_acceptance="cast(o_orderkey % 2 AS bigint)")

MAPPINGS = Derived("customer", "c_custkey <= 3", surface="CASE WHEN c_custkey = 1 THEN 'rows' WHEN c_custkey = 2 THEN 'other' END", logical_target="CASE WHEN c_custkey = 2 THEN 'MACHINERY' ELSE 'BUILDING' END", remote_id="concat('m-', cast(c_custkey AS string))")
REGISTERED = Derived("customer", "c_custkey <= 2", surface="'rows'", logical_target="CASE WHEN c_custkey = 1 THEN 'AUTOMOBILE' ELSE 'BUILDING' END", remote_id="concat('r-', cast(c_custkey AS string))")


def by_position(*columns) -> WindowSpec:
    """The order of a few rows of a ledger."""
    return Window.orderBy(*columns)
