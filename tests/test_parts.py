import datetime

import pytest
from pyspark.sql import functions as F

from weirgate import decisions
from weirgate.decisions import Counts
from weirgate.declarations import Checkpoint, DeclarationError, Event, Identifier, Source, State, Sync
from weirgate.destinations import Destination, Needs, Registry, Surface, first_of, from_environment, from_mapping, from_toml, issues
from weirgate.functions import canonical, identifiers, redaction, templates
from weirgate.operators import batching, ledger, ordinal, targets, upsert
from weirgate.sources import artifacts, keyset, sql
from weirgate.sources.keyset import CurrentPosition, EventPosition, Range, WorkPosition


def test_positions():
    a, b = EventPosition(9, "x"), EventPosition(10, "a")
    assert keyset.compare(a, b) == -1 and keyset.compare(b, b) == 0
    assert keyset.compare(EventPosition(None, 1), EventPosition(False, 1)) == -1
    assert keyset.restored(keyset.stored(b)) == b
    with pytest.raises(ValueError):
        keyset.compare(a, CurrentPosition("x"))
    with pytest.raises(ValueError):
        keyset.kind_of(float("nan"))
    with pytest.raises(ValueError):
        Range(b, b, b, b)
    assert decisions.advanced(WorkPosition("c", 4), WorkPosition("c", 2)) == WorkPosition("c", 4)
    assert keyset.parsed("7", "integer") == 7 and keyset.parsed(None, "number") is None


def test_window_skips_nulls_and_compares_numbers_as_numbers(spark):
    df = spark.createDataFrame([(9, 1), (10, 1), (10, 2), (None, 3), (11, None)], "c long, p long")
    got = [tuple(r) for r in keyset.window(df, "c", "p", [9, 1], [10, 9], 5).collect()]
    assert got == [(10, 1), (10, 2)]


def test_source_values(spark):
    df = spark.sql("select timestamp_ntz'2024-01-02 03:04:05.500' as A, decimal(1.50) as b, date'2024-01-02' as c, timestamp_ntz'2024-01-02 03:04:00' as d")
    assert tuple(sql.normalized(df).first()) == ("2024-01-02T03:04:05.5Z", "2", "2024-01-02", "2024-01-02T03:04:00Z")
    with pytest.raises(DeclarationError):
        sql.normalized(spark.sql("select 1 as a, 2 as A"))
    with pytest.raises(DeclarationError):
        sql.normalized(spark.sql("select map(1, 2) as m"))
    with pytest.raises(Exception, match="not finite"):
        sql.normalized(spark.sql("select double('NaN') as x")).collect()


def test_ordinal_of_few_and_no_rows(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,)], "x string")
    assert [tuple(r) for r in ordinal.with_ordinal(df, [F.col("x").asc_nulls_last()], "n", 5).orderBy("n").collect()] == [("a", 5), ("b", 6), (None, 7)]
    assert ordinal.with_ordinal(df.limit(0), [F.col("x").asc_nulls_last()]).count() == 0


def test_batches(spark):
    df = spark.createDataFrame([(i, "w", k, n, b) for i, (k, n, b) in enumerate([("u", 1, 9), ("u", 2, 9), ("u", 1, 50), ("r", 1, 1), ("u", 3, 1)])], "sequence_order long, work_id string, kind string, item_count long, byte_count long")
    got = [r.batch_index for r in batching.weighted_batches(df, "sequence_order", ["kind"], 3, 21).orderBy("sequence_order").collect()]
    assert got == [0, 0, 1, 2, 3]
    assert [r.batch_index for r in batching.unit_batches(df, "sequence_order", ["kind"], 2).orderBy("sequence_order").collect()] == [0, 0, 1, 2, 3]
    with pytest.raises(Exception, match="does not fit"):
        batching.weighted_batches(df, "sequence_order", ["kind"], 2).collect()


def test_identifiers(spark):
    df = spark.createDataFrame([(" A.b c@GMAIL.com ", "X" * 3), (None, "AB" * 32)], "e string, p string")
    got = df.select(identifiers.email(F.col("e")), identifiers.hashed(F.col("p"))).collect()
    assert got[0][0] == "abc@gmail.com" and got[1] == (None, "ab" * 32)


def test_redaction(spark):
    text = "see https://me:pw@host/x password = abc, Authorization: Bearer x.y"
    want = "see https://[redacted]@host/x password=[redacted], Authorization=[redacted]"
    assert spark.createDataFrame([(text,)], "t string").select(redaction.redacted(F.col("t"))).first()[0] == want
    assert redaction.redacted_record({"note": text, "email": "x", "n": 1, "token_fingerprint": "f"}) == {"note": want, "email": "[redacted]", "n": 1, "token_fingerprint": "f"}


def test_ledger_null_flags(spark):
    df = spark.createDataFrame([("a", "failed", "unresolved", None, 0), ("b", "pending", "unresolved", None, 9), ("c", "failed", "unresolved", True, 3)], "batch_id string, status string, completion_state string, retry_eligible boolean, attempt_count long")
    assert [r.batch_id for r in ledger.retry_candidates(df, 3).collect()] == ["b"]


def test_upsert_and_delete(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k long, v string")
    assert sorted(map(tuple, upsert.upserted(old, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(map(tuple, upsert.updated(old, new, ["k"]).collect())) == [(1, "a"), (2, "c")]
    with pytest.raises(ValueError):
        upsert.deleted(old, None)


def test_decisions():
    assert not decisions.may_go_on("stop_on_any", Counts(3, retryable=1))
    assert decisions.may_go_on("stop_on_terminal", Counts(3, retryable=1))
    assert not decisions.may_go_on("stop_on_terminal", Counts(3, terminal=1))
    assert decisions.may_go_on("continue_on_any", Counts(3, terminal=3))
    with pytest.raises(ValueError):
        Counts(1, terminal=2)
    now = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
    assert decisions.retry_after_seconds("Mon, 01 Jan 2024 00:00:05 GMT", now) == 5
    assert decisions.retry_after_seconds("7") == 7 and decisions.retry_after_seconds("soon") is None
    assert decisions.retry_delays(5) == [0.25, 0.5, 1.0, 2.0]
    assert decisions.batch_status([2, 1], Counts(3, confirmed=2, before_acceptance=1)) == [("succeeded", False), ("failed", False)]


def test_outcomes_of_responses():
    of = lambda status, rows=2: decisions.counts_of(decisions.Response(status), rows)
    assert of(200).confirmed == 2 and of(202).accepted == 2 and of(404).terminal == 2 and of(503).retryable == 2
    assert of(401).before_acceptance_terminal == 2 and of(302).before_acceptance == 2 and of(302).before_acceptance_terminal == 0
    assert [decisions.delivery_outcome("accepted", c) for c in (of(200), of(202), of(404), Counts(), Counts(2, confirmed=1, terminal=1))] == ["succeeded", "accepted", "failed", "pending", "partial"]
    assert decisions.short("token=abc " + "x" * 300) == "token=[redacted] " + "x" * 239 + "..."


def test_retries_at_once():
    waits, answers = [], [decisions.Response(503, 2.0), decisions.Response(500), decisions.Response(200)]
    counts, tries = decisions.submitted(lambda: answers.pop(0), 3, attempts=3, sleep=waits.append, jitter=lambda: 0)
    assert (counts.confirmed, tries, waits) == (3, 3, [2.0, 0.5])
    for answer in (decisions.Response(503, 6.0), Counts(3, retryable=2, confirmed=1), decisions.Response(404)):
        assert decisions.submitted(lambda answer=answer: answer, 3, sleep=waits.append)[1] == 1
    assert decisions.submitted(lambda: decisions.Response(503, 5.0), 3, attempts=9, sleep=waits.append)[1] == 3
    states = ["running", "Running", "done"]
    assert decisions.polled(lambda: states.pop(0), [1, 1, 1], sleep=waits.append) == "confirmed"
    assert decisions.polled(lambda: "queued", [1], sleep=waits.append) == "accepted" and decisions.poll_state("Failed") == "terminal_record_failure"


def test_positions_wait_for_the_ledger():
    row = lambda upper, status, again=False: {"upper_json": upper, "status": status, "completion_state": "resolved", "retry_eligible": again}
    good = [row("a", "succeeded"), row("b", "succeeded")]
    may = decisions.may_commit_ledger
    assert may("stop_on_any", 2, good, "b") and not may("stop_on_any", 3, good, "b") and not may("stop_on_any", 2, good, "c")
    again = [row("a", "failed", True), row("b", "succeeded")]
    assert may("stop_on_terminal", 2, again, "b") and not may("stop_on_any", 2, again, "b")
    assert not may("continue_on_any", 2, [row("a", "pending"), row("b", "succeeded")], "b")


def test_surfaces_say_what_they_take():
    source = Source("s", "select 1")
    state = State("st", source, key={"k": "k"}, identifiers=[Identifier("email", value="e")], target="t")
    event = Event("ev", Source("s", "select 1", Checkpoint("c", "p")), key={"k": "k"}, occurred_at="c")
    codes = lambda surface, sync=Sync("x", state, "d", "s"): [c for c, _ in issues(sync, surface)]
    assert codes(Surface("s")) == [] and codes(Surface("s", family="event")) == ["family_mismatch"]
    assert codes(Surface("s", target_mode="unsupported", operations=("upsert",))) == ["target_unsupported", "unsupported_operation"]
    assert codes(Surface("s", key_fields=["z"], payload_fields=["y"], identifier_types=["phone"])) == ["missing_key_fields", "missing_payload_fields", "unsupported_identifier_type"]
    assert codes(Surface("s", needs=[Needs(["phone", "madid"]), Needs(["email", "phone"], "all_of")])) == ["missing_any_identifier_type", "missing_all_identifier_types"]
    assert codes(Surface("s", target_mode="required"), Sync("x", State("st", source, key={"k": "k"}), "d", "s")) == ["target_required"]
    assert codes(Surface("s", family="event"), Sync("x", event, "d", "s")) == []
    for wrong in ({"family": "event", "target_mode": "required"}, {"delivery": "maybe"}, {"max_rows": 0}):
        with pytest.raises(DeclarationError):
            Surface("s", **wrong)


def test_registry_and_configuration(monkeypatch):
    one = Destination("one", [Surface("s")], None, aliases=("uno",))
    registry = Registry(one)
    assert registry.resolve("uno") is one
    for bad in (lambda: registry.register(Destination("uno", [], None)), lambda: registry.resolve("two"), lambda: one.surface("t")):
        with pytest.raises(DeclarationError):
            bad()
    monkeypatch.setenv("APP_KEY", "env")
    found = first_of(from_environment("app"), from_toml("[a]\nkey = 'toml'\nother = 1", "a"), from_mapping({"last": 2}))
    assert (found("key"), found("other"), found("last"), found("none")) == ("env", 1, 2, None)


def test_targets_of_a_dry_run():
    plan = [{"logical_target": n, "remote_id": i, "source": s} for n, i, s in (("a", "1", "mapping"), ("b", None, "missing"))]
    client = type("C", (), {"find": lambda self, n: None, "create": lambda self, n: "new"})()
    assert targets.resolve(plan).status == "failed" and targets.resolve(plan).missing == ["b"]
    dry, real = targets.resolve(plan, client, dry_run=True), targets.resolve(plan, client)
    assert (dry.status, dry.registered, dry.found["b"]) == ("planned", [], (None, "managed_planned_create"))
    assert (real.status, real.registered) == ("resolved", [("b", "new", "managed_created")])


def test_records_and_errors_are_redacted():
    record = {"a": {"email": ["x@y", "z"], "note": "password=abc"}, "list": list(range(9)), "token_fingerprint": "f"}
    assert redaction.redacted_record(record, samples=2) == {"a.email.0": "[redacted]", "a.email.1": "[redacted]", "a.note": "password=[redacted]", "list.0": 0, "list.1": 1, "token_fingerprint": "f", "a.email.#": 2, "list.#": 9}
    assert redaction.partner_errors([{"code": 1, "message": "api_key: k"}] * 9, samples=1) == {"count": 9, "sample": [{"code": 1, "message": "api_key=[redacted]"}]}


def test_nulls_leave_nested_bodies(spark):
    df = spark.sql("select named_struct('a', cast(null as string), 'b', named_struct('c', cast(null as int)), 'd', array(named_struct('e', 1, 'f', null), null, named_struct('e', null, 'f', null)), 'g', 2) as body")
    assert df.select(canonical.pruned(df, "body")).first()[0] == '{"d":[{"e":1}],"g":2}'
    none = df.select(F.struct(F.lit(None).cast("int").alias("x")).alias("body"))
    assert none.select(canonical.pruned(none, "body")).first()[0] == "{}"


def test_batches_over_many_partitions(spark):
    """Islands, cuts and fills that cross range partitions, against a plain loop."""
    import random

    rng = random.Random(3)
    rows = [(i * 3, rng.choice("aaaab"), rng.randint(0, 4), rng.randint(1, 30)) for i in range(400)]
    shuffled = rows[:]
    rng.shuffle(shuffled)
    df = spark.createDataFrame(shuffled, "sequence_order long, kind string, item_count long, byte_count long")
    islands, units, fills = [], [], []
    island = unit = fill = nth = items = size = -1
    for i, (_, kind, n, b) in enumerate(rows):
        new = i == 0 or rows[i - 1][1] != kind
        island, nth = island + new, 0 if new else nth + 1
        unit += new or nth % 3 == 0
        if new or items + n > 6 or size + 1 + b > 60:
            fill, items, size = fill + 1, n, 2 + b
        else:
            items, size = items + n, size + 1 + b
        islands.append(island), units.append(unit), fills.append(fill)
    got = lambda out, c: [r[c] for r in out.orderBy("sequence_order").collect()]
    assert got(batching.with_islands(df, "sequence_order", ["kind"]), "island") == islands
    assert got(batching.unit_batches(df, "sequence_order", ["kind"], 3), "batch_index") == units
    assert got(batching.weighted_batches(df, "sequence_order", ["kind"], 6, 60), "batch_index") == fills
    assert got(batching.page_batches(df, "sequence_order", ["kind"], 6, 60), "batch_index") == fills


def test_artifacts_are_checked(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k long, v string")
    place = str(tmp_path / "a")
    assert artifacts.kept(df, place)["rows"] == 2 and sorted(map(tuple, artifacts.read(spark, place).collect())) == [(1, "a"), (2, None)]
    with pytest.raises(FileExistsError):
        artifacts.kept(df, place)
    df.limit(1).write.mode("append").parquet(f"{place}/rows")
    with pytest.raises(artifacts.ArtifactError, match="rows"):
        artifacts.read(spark, place)


def test_templates_and_secrets(spark):
    df = spark.createDataFrame([('{"a":{"b":1}}', "x"), ('{"a":{}}', "api_key=1")], "j string, t string")
    path = templates.expanded("/{{ j.a.b }}/{{t}}", {"j": F.col("j"), "t": F.col("t")})
    assert df.filter("t = 'x'").select(path).first()[0] == "/1/x"
    with pytest.raises(Exception, match="nothing at"):
        df.select(path).collect()
    for bad in ("{{other}}", "{{j..a}}"):
        with pytest.raises(DeclarationError):
            templates.expanded(bad, {"j": F.col("j")})
    assert [r[0] for r in df.select(redaction.holds_secret(F.col("t"))).collect()] == [False, True]
    with pytest.raises(Exception, match="credentials"):
        df.select(redaction.without_secrets(F.col("t"))).collect()


def test_sources_have_their_columns(spark):
    state = State("s", Source("s", "select 1 as k, 2 as v"), key={"k": "k"}, payload={"v": "v"})
    assert sql.prepared(spark, state).count() == 1 and sql.needed(state) == ["k", "v"]
    for query in ("select 1 as k", "select 1 as k, 2 as v, 3 as V"):
        with pytest.raises(DeclarationError):
            sql.prepared(spark, State("s", Source("s", query), key={"k": "k"}, payload={"v": "v"}))
    parts = [spark.range(2), spark.range(1)]
    assert sql.union(parts).count() == 3
    with pytest.raises(DeclarationError):
        sql.union([parts[0], spark.sql("select 'a' as id")])
