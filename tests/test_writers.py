"""Several writers of one store, its log and its size; pages, sweeps and attempts of the runner."""

import datetime
import json
import os
import threading
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from tests.test_runner import EVENTS, STATE, SYNC, Partner, buys, flat, ledger, retryable, rows, small_plans, table  # noqa: F401
from weirgate import files, operations, store as stores
from weirgate.declarations import DeclarationError, Event, Source, State, Sync
from weirgate.decisions import Counts, Job
from weirgate.destinations import Destination, Registry, Surface, from_mapping
from weirgate.materialize import written
from weirgate.operators import batching, diff, ordinal, paging
from weirgate.operators.diff import DuplicateIdentity
from weirgate.operators.ledger import LedgerError
from weirgate.runner import Fenced, Runner, _Send
from weirgate.sources.keyset import WorkPosition
from weirgate.store import Conflict, Store
from weirgate.streaming import events


@pytest.fixture
def partner():
    return Partner()


@pytest.fixture
def runner(spark, tmp_path, partner):
    surfaces = [Surface("rows", max_rows=2), Surface("events", family="event", max_rows=2, target_mode="unsupported")]
    return Runner(spark, Store(spark, str(tmp_path / "store")), Registry(Destination("partner", surfaces, partner)), page_rows=100, attempts=1, sleep=lambda s: None)


def run_row(store, i, status="done"):
    return store.rows("runs", [{"run_id": i, "status": status}])


# Changes of several writers.


def test_changes_of_other_parts_are_kept(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    with store.changes() as c:
        store.append("runs", run_row(store, "1"), "1")
        c.append("runs", run_row(store, "2"), "2")
    assert sorted(r.run_id for r in store.read("runs").collect()) == ["1", "2"] and store.head()[0] == 2
    with pytest.raises(Conflict), store.changes() as c:
        c.read("runs")
        store.append("runs", run_row(store, "3"), "3")
        c.append("runs", run_row(store, "4"), "4")
    assert sorted(r.run_id for r in store.read("runs").collect()) == ["1", "2", "3"]


def test_one_of_several_writers_takes_a_name(spark, tmp_path):
    """Of writers at once one alone is told that its file or folder got the name, and that is what lies there, without a file of checksums that may be another's."""
    (tmp_path / "heads").mkdir()
    together = threading.Barrier(8)

    def file(i, k):
        together.wait()
        return files.published(spark, f"{tmp_path}/heads/{i}.json", str(k) * 600 * (k + 1))

    def folder(i, k):
        together.wait()
        return files.moved(spark, f"{tmp_path}/.{i}-{k}", f"{tmp_path}/{i}")

    with ThreadPoolExecutor(8) as pool:
        for i in range(40):
            for k in range(8):
                (tmp_path / f".{i}-{k}").mkdir()
                (tmp_path / f".{i}-{k}" / str(k)).touch()
            won = [k for k, first in enumerate(pool.map(lambda k, i=i: file(i, k), range(8))) if first]
            assert [int(files.text_of(spark, f"{tmp_path}/heads/{i}.json")[0])] == won
            won = [k for k, first in enumerate(pool.map(lambda k, i=i: folder(i, k), range(8))) if first]
            assert [int(p.name) for p in (tmp_path / str(i)).iterdir()] == won
    assert sorted(p.name for p in (tmp_path / "heads").iterdir()) == sorted(f"{i}.json" for i in range(40))


def test_a_commit_is_made_again_after_another(spark, tmp_path):
    store, turns = Store(spark, str(tmp_path)), []

    def change(c):
        turns.append(1)
        n = c.read("runs", "x").count()
        if len(turns) == 1:
            store.append("runs", run_row(store, "1"), "x")
        c.append("runs", run_row(store, str(n + 1)), "x")

    store.commit(change)
    assert len(turns) == 2 and sorted(r.run_id for r in store.read("runs").collect()) == ["1", "2"]


def test_another_writer_while_outcomes_are_written(spark, runner, partner, monkeypatch):
    """What was sent is in the ledger, and goes once."""
    store, once = runner.store, []
    plain = Store._publish

    def publish(self, made):
        if ("destination_batches" in {t for t, _ in made.changed}) and len(once) < 2:
            once.append(1)
            with Store.changes(Store(spark, store.folder)) as other:
                other.append("cursors", store.rows("cursors", [{"cursor_id": str(len(once))}]), str(len(once)))
        return plain(self, made)

    monkeypatch.setattr(Store, "_publish", publish)
    out = runner.run(SYNC, table(spark, rows(3)))
    assert len(once) == 2 and out.status == "succeeded" and len(flat(partner)) == 3
    assert {b.status for b in ledger(runner)} == {"succeeded"} and {b.attempt_count for b in ledger(runner)} == {1}
    runner.run(SYNC, table(spark, rows(3)))
    assert len(flat(partner)) == 3 and store.read("cursors").count() == 2


def test_two_syncs_at_once(spark, tmp_path):
    """Two runners of one store, at the same time."""
    partners, errors = [Partner(), Partner()], []
    store = Store(spark, str(tmp_path))

    def run(i):
        try:
            made = State(f"s{i}", Source(f"s{i}", "select 1"), key={"customer": "id"}, payload={"plan": "plan"})
            to = Registry(Destination("partner", [Surface("rows", max_rows=2)], partners[i]))
            for n in (3, 5):
                Runner(spark, Store(spark, store.folder), to, attempts=1).run(Sync(f"s{i}", made, "partner", "rows"), table(spark, rows(n)))
        except Exception as e:  # shown by the assertion
            errors.append(e)

    threads = [threading.Thread(target=run, args=(i,)) for i in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors
    for p in partners:
        assert sorted(k for _, k in flat(p)) == [f'{{"customer":"{i}"}}' for i in range(5)]
    found = store.read("destination_batches").collect()
    assert len(found) == 6 and {(b.status, b.attempt_count) for b in found} == {("succeeded", 1)} and store.read("sync_reports").count() == 4


def test_collects_of_one_state_at_once(spark, runner, monkeypatch):
    """The second one finds its changes again from what the first left."""
    runner.collect(STATE, table(spark, rows(2)))
    plain, once = Runner._collected, []

    def collected(self, state, snapshot):
        if not once:
            once.append(1)
            before = self.store.last
            seen = before()
            monkeypatch.setattr(self.store, "last", lambda: seen)
            Runner(spark, Store(spark, self.store.folder), self.registry).collect(STATE, table(spark, rows(3)))
            monkeypatch.setattr(self.store, "last", lambda: seen if not once.append(1) and len(once) == 2 else before())
        return plain(self, state, snapshot)

    monkeypatch.setattr(Runner, "_collected", collected)
    found = runner.collect(STATE, table(spark, rows(4)))
    assert found.upserts == 1 and runner.store.read("state_current").count() == 4
    work = runner.store.read("ordered_work").orderBy("collect_id", "sequence_order").collect()
    assert [w.key_json for w in work] == [f'{{"customer":"{i}"}}' for i in range(4)]


# Attempts.


def test_a_stale_attempt_changes_nothing(spark, runner, partner):
    """While a run waits for an answer, another run of the same sync begins."""

    def slow(n):
        runner._begin(SYNC, "other")
        return Counts(n, confirmed=n)

    partner.answers = [slow]
    with pytest.raises(Fenced):
        runner.run(SYNC, table(spark, rows(1)))
    assert runner.position(SYNC) is None and [b.status for b in ledger(runner)] == ["pending"]
    held = runner.store.read("attempts").collect()
    assert [(a.epoch, a.run_id, a.status) for a in held] == [(2, "other", "begun")]


def test_attempts_tell_what_was_decided(spark, runner, partner):
    runner.run(SYNC, table(spark, rows(3)))
    a = runner.store.read("attempts").first()
    assert (a.epoch, a.attempt_id, a.status) == (1, "runner:s:attempt-1", "succeeded")
    assert json.loads(a.decision_json)["commit"] is True and json.loads(a.decision_json)["position"]["sequence_order"] == 2
    assert all(b.first_submitted_at is not None for b in ledger(runner))


def test_rows_that_break_a_rule_do_not_enter_the_ledger(spark, runner):
    def change(c):
        from weirgate.runner import _Send

        _Send.ledgered(type("S", (), {"store": runner.store})(), c, [{"batch_id": "b", "page_id": "p", "status": "failed", "completion_state": "unresolved", "attempt_count": 0}], "p")

    with pytest.raises(LedgerError):
        runner.store.commit(change)
    assert runner.store.read("destination_batches").count() == 0


# Sweeps.


def test_a_failed_resend_of_other_records_stays_open(spark, runner, partner):
    runner.page_rows = 2
    runner.run(SYNC, table(spark, rows(3)))
    partner.sent.clear()
    partner.answers = [retryable, retryable]
    runner.run(SYNC, table(spark, rows(3)), resend_all=True)
    partner.sent.clear()
    changed = [("0", "0@", "free", "a"), ("1", "1@", "pro", "a"), ("2", "2@", "free", "a")]
    runner.collect(STATE, table(spark, changed))
    out = runner.run(SYNC, table(spark, changed))
    assert flat(partner) == [("upsert", '{"customer":"2"}'), ("upsert", '{"customer":"1"}')] and out.swept == 1
    held = [b for b in ledger(runner) if b.completion_state == "unresolved"]
    assert [(b.attempt_count, b.error) for b in held] == [(1, "the range of the batch gives other records")]


def test_pages_of_events_are_sent_again_together(spark, runner, partner, monkeypatch):
    """One table for the pages of a sweep, oldest first; batches whose range gives other rows or records stay open."""
    runner.page_rows, partner.answers = 3, [retryable] * 8
    made = [(i, 1 + i) for i in range(12)]
    assert runner.run(EVENTS, buys(spark, *made)).pages == 4
    partner.sent.clear()
    calls, plain = [], _Send.batched
    monkeypatch.setattr(_Send, "batched", lambda *a, **b: calls.append(1) or plain(*a, **b))
    other = buys(spark, *[x for x in made if x[0] != 5], (20, 25)).withColumn("n", F.when(F.col("id") == 8, 5).otherwise(F.col("n")))
    out = runner.run(EVENTS, other)
    assert len(calls) == 2 and out.swept == 6
    assert [k for _, k in flat(partner)] == [f'{{"buy":{i}}}' for i in (0, 1, 2, 3, 4, 6, 7, 9, 10, 11, 20)]
    held = {json.loads(b.upper_json)["primary_key"]: (b.attempt_count, b.error) for b in ledger(runner) if b.completion_state == "unresolved"}
    assert held == {5: (1, "the range of the batch gives 0 rows, not 1"), 8: (1, "the range of the batch gives other records")}
    assert {b.attempt_count for b in ledger(runner) if b.completion_state == "resolved"} == {1, 2}


def test_resends_have_pages_of_their_own(spark, runner):
    runner.run(SYNC, table(spark, rows(1)))
    for _ in range(2):
        runner.run(SYNC, table(spark, rows(1)), resend_all=True)
    parts = runner.store.head()[1]["destination_batches"]
    assert len(parts) == 3 and {b.batch_index for b in ledger(runner)} == {0}


# Outcomes that come later.


def test_jobs_end_in_later_runs(spark, tmp_path):
    partner, states = Partner(), {}
    to = Destination("partner", [Surface("rows", max_rows=2)], partner, poll=lambda h: states.get(h, "running"))
    runner = Runner(spark, Store(spark, str(tmp_path)), Registry(to), attempts=1, sleep=lambda s: None)
    partner.answers = [Job("a"), Job("b")]
    out = runner.run(SYNC, table(spark, rows(3)))
    assert out.stopped and runner.position(SYNC) is None and [(b.status, b.completion_state) for b in ledger(runner)] == [("accepted", "unresolved")] * 2
    for ended, left in ({"a": "Done"}, 1), ({"b": "completed"}, 0):
        states |= ended
        runner.run(SYNC, table(spark, rows(3)))
        assert sum(b.completion_state == "unresolved" for b in ledger(runner)) == left and len(partner.sent) == 2
    assert runner.position(SYNC).sequence_order == 2 and {b.attempt_count for b in ledger(runner)} == {1}
    partner.answers = [Job("c")]
    runner.run(SYNC, table(spark, rows(4)))
    states["c"] = "error"
    assert runner.run(SYNC, table(spark, rows(4))).stopped and ledger(runner)[-1].status == "failed" and len(partner.sent) == 3


def test_jobs_of_a_collect_of_several_pages_run_side_by_side(spark, tmp_path):
    """All of a collect is sent though jobs of its first page are open; nothing is committed before they end, and a job that fails stops there."""
    partner, states = Partner(), {}
    partner.answers = [Job(str(i)) for i in range(4)]
    to = Destination("partner", [Surface("rows", max_rows=2)], partner, poll=lambda h: states.get(h, "running"))
    runner = Runner(spark, Store(spark, str(tmp_path)), Registry(to), page_rows=2, attempts=1, sleep=lambda s: None)
    out = runner.run(SYNC, table(spark, rows(5)))
    assert out.stopped and out.pages == 3 and [len(x) for x in partner.sent] == [2, 2, 1] and runner.position(SYNC) is None
    assert [(b.status, b.completion_state) for b in ledger(runner)] == [("accepted", "unresolved")] * 3
    states |= {"1": "done", "2": "done"}
    assert runner.run(SYNC, table(spark, rows(5))).stopped and runner.position(SYNC) is None and len(partner.sent) == 3
    states |= {"0": "done"}
    # A later collect is not sent before the one that waits is through.
    out = runner.run(SYNC, table(spark, rows(6)))
    assert runner.position(SYNC).collect_id < out.collected.collect_id and len(partner.sent) == 4 and partner.sent[3] == [("upsert", '{"customer":"5"}')]
    states |= {"3": "failed"}
    assert runner.run(SYNC, table(spark, rows(6))).stopped and ledger(runner)[-1].status == "failed" and len(partner.sent) == 4


def test_asking_may_fail(spark, tmp_path):
    def poll(handle):
        raise OSError("no way")

    partner = Partner()
    partner.answers = [Job("a")]
    runner = Runner(spark, Store(spark, str(tmp_path)), Registry(Destination("partner", [Surface("rows", max_rows=2)], partner, poll=poll)), attempts=1)
    for _ in range(2):
        runner.run(SYNC, table(spark, rows(1)))
    held = ledger(runner)[0]
    assert (held.status, held.completion_state, held.error) == ("accepted", "unresolved", "OSError: no way") and len(partner.sent) == 1


# Streams.


def test_a_stream_that_is_lost_between_sending_and_committing(spark, runner, partner, tmp_path, monkeypatch):
    """Neither loses nor repeats a batch, even where more events have come in the meantime and the stream's own checkpoint is gone."""
    place = str(tmp_path / "in")

    def add(*made):
        buys(spark, *made).coalesce(1).write.mode("append").parquet(place)

    def stream(checkpoint):
        return events.run_sync(spark.readStream.schema("id long, at timestamp, n int").parquet(place), runner, EVENTS, str(tmp_path / checkpoint))

    add((1, 1), (2, 2), (3, 3))
    plain = Runner.advance

    def lost(*_):
        raise SystemError("the driver is gone")

    monkeypatch.setattr(Runner, "advance", lost)
    with pytest.raises(Exception, match="the driver is gone"):
        stream("a")
    assert [k for _, k in flat(partner)] == [f'{{"buy":{i}}}' for i in (1, 2, 3)] and runner.position(EVENTS, "event") is None
    monkeypatch.setattr(Runner, "advance", plain)
    add((4, 4), (5, 5))
    stream("b")
    assert [k for _, k in flat(partner)] == [f'{{"buy":{i}}}' for i in (1, 2, 3, 4, 5)]
    assert runner.position(EVENTS, "event").primary_key == 5 and all(b.completion_state == "resolved" for b in ledger(runner))
    add((6, 6))
    assert len(stream("b")) == 1 and flat(partner)[-1] == ("import", '{"buy":6}') and len(flat(partner)) == 6


# Bodies.


def test_no_credentials_are_sent(spark, runner, partner):
    with pytest.raises(Exception, match="holds credentials"):
        runner.run(SYNC, table(spark, [("1", "@", "api_key=abcdef123", "a")]))
    assert not partner.sent and runner.store.read("destination_batches").count() == 0


@pytest.mark.parametrize("around", [("[", "]"), ('{"customers":[', '],"é":1}')])
def test_no_body_is_over_the_limit(spark, tmp_path, around):
    bodies = []

    def submit(got, batch):
        bodies.append(to.rendered(got))
        return Counts(batch["row_count"], confirmed=batch["row_count"])

    to = Destination("partner", [Surface("rows", max_rows=9, max_bytes=300)], submit, body=around)
    Runner(spark, Store(spark, str(tmp_path)), Registry(to)).run(SYNC, table(spark, [(str(i), "é" * (i % 5), "free", "a") for i in range(12)]))
    sizes = [len(b.encode()) for b in bodies]
    assert len(sizes) > 4 and max(sizes) <= 300 and sorted(sizes)[len(sizes) // 2] > 150
    records = [r for b in map(json.loads, bodies) for r in (b if isinstance(b, list) else b["customers"])]
    assert [r["key"] for r in records] == [{"customer": str(i)} for i in sorted(range(12), key=str)] and {r["operation"] for r in records} == {"upsert"}


# Pages.


def counted(spark, df):
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    return df.mapInArrow(seen, df.schema), read


def test_pages_of_events_read_the_source_once(spark, runner, partner):
    made, read = counted(spark, buys(spark, *[(i, 1 + i % 20) for i in range(12)]).repartition(3))
    runner.page_rows = 2
    out = runner.run(EVENTS, made)
    assert out.pages == 6 and read.value == 12
    assert flat(partner) == sorted(flat(partner), key=lambda x: int(x[1][7:-1]))


def test_pages_of_events_are_planned_together(spark, runner, partner, monkeypatch):
    """One table for all pages, and few changes of the store; positions, pages and batches are those of pages one by one."""
    runner.page_rows, calls = 3, []
    plain = _Send.batched
    monkeypatch.setattr(_Send, "batched", lambda *a, **b: calls.append(1) or plain(*a, **b))
    made = [(i, 1 + i // 4) for i in range(20)]
    heads = runner.store.last().n
    out = runner.run(EVENTS, buys(spark, *made))
    assert out.pages == 7 and len(calls) == 1 and runner.store.last().n - heads < 3 * out.pages
    assert [k for _, k in flat(partner)] == [f'{{"buy":{i}}}' for i in range(20)] and [len(x) for x in partner.sent] == [2, 1] * 6 + [2]
    found = sorted(ledger(runner), key=lambda b: json.loads(b.upper_json)["primary_key"])
    assert [b.lower_json for b in found] == [None, *(b.upper_json for b in found[:-1])] and runner.position(EVENTS, "event").primary_key == 19
    assert [(b.batch_index, b.row_count, b.first_order, b.last_order) for b in found[2:4]] == [(0, 2, 0, 1), (1, 1, 2, 2)] and {b.status for b in found} == {"succeeded"}
    by_one = Runner(spark, Store(spark, runner.store.folder + "-one"), runner.registry, page_rows=3, attempts=1)
    monkeypatch.setattr("weirgate.runner.MOST_PAGES", 1)
    by_one.run(EVENTS, buys(spark, *made))
    names = ("batch_id", "page_id", "payload_fingerprint", "request_fingerprint", "lower_json", "upper_json")
    assert {tuple(b[c] for c in names) for b in ledger(by_one)} == {tuple(b[c] for c in names) for b in found}


def test_a_page_that_stops_leaves_no_trace_of_later_ones(spark, runner, partner):
    runner.page_rows, partner.answers = 2, [None, lambda n: Counts(n, terminal=n)]
    partner.answers[0] = lambda n: Counts(n, confirmed=n)
    out = runner.run(EVENTS, buys(spark, *[(i, 1 + i) for i in range(8)]))
    assert out.stopped and out.pages == 2 and runner.position(EVENTS, "event").primary_key == 1
    assert sorted(b.status for b in ledger(runner)) == ["failed", "succeeded"]


def test_one_of_the_pages_that_share_a_part_is_changed(spark, runner, partner):
    runner.page_rows, partner.answers = 2, [retryable] * 3
    runner.run(EVENTS, buys(spark, *[(i, 1 + i) for i in range(6)]))
    assert len(runner.store.head()[1]["destination_batches"]) == 1
    made = sorted(ledger(runner), key=lambda b: b.upper_json)
    operations.skip_batch(runner.store, EVENTS.scope, made[1].batch_id)
    assert [b.status for b in sorted(ledger(runner), key=lambda b: b.upper_json)] == ["failed", "skipped", "failed"]
    assert [runner.store.read("destination_batches", b.page_id).count() for b in made] == [1, 1, 1]
    assert runner.run(EVENTS, buys(spark, *[(i, 1 + i) for i in range(6)])).swept == 2 and len(ledger(runner)) == 3


def test_pages_before_a_bad_one_are_sent(spark, runner, partner):
    runner.page_rows = 2
    twice = Sync("e", Event("buys", EVENTS.declaration.source, key={"n": "n"}, occurred_at="at"), "partner", "events")
    with pytest.raises(DuplicateIdentity):
        runner.run(twice, buys(spark, (1, 1), (2, 2), (3, 3), (4, 3), (5, 5)))
    assert len(flat(partner)) == 2 and runner.position(twice, "event").primary_key == 2


def test_a_run_that_is_lost_after_several_pages(spark, runner, partner, monkeypatch):
    """Of pages that were delivered together none is sent again, though later events lie among them."""
    runner.page_rows = 2
    made = [(i, 2 * i) for i in range(1, 7)]
    monkeypatch.setattr(Runner, "advance", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError, match="lost"):
        runner.run(EVENTS, buys(spark, *made))
    monkeypatch.undo()
    assert len(flat(partner)) == 6
    runner.run(EVENTS, buys(spark, *made, (9, 3), (10, 20)))
    assert [k for _, k in flat(partner)][6:] == ['{"buy":10}'] and runner.position(EVENTS, "event").primary_key == 10


def test_pages_of_work_open_the_folders_that_hold_them(spark, runner, partner):
    for n in (3, 5, 9):
        runner.collect(STATE, table(spark, rows(n)))
    name, first = STATE.name, [c.collect_id for _, c in runner.store.collects(STATE.name)]
    assert [c.rows for _, c in runner.store.collects(name)] == [3, 2, 4]
    every = set(runner.store.read("ordered_work").inputFiles())
    one = set(runner.store.work(name, (first[1], 0), (first[1], 9)).inputFiles())
    assert one < every and len(one) < len(every) and runner.store.work(name, (first[1], 0), (first[1], 9)).count() == 2
    runner.page_rows = 4
    out = runner.run(SYNC, table(spark, rows(9)))
    assert out.pages == 3 and len(flat(partner)) == 9 and runner.position(SYNC) == WorkPosition(first[2], 3)


def test_pages_of_pending_work_by_cursors(spark, runner, partner):
    runner.collect(STATE, table(spark, rows(5)))
    runner.collect(STATE, table(spark, rows(7)))
    places = lambda page: sorted((r.key_json for r in page.collect()))
    page, token = runner.pending(SYNC, most=2)
    assert len(places(page)) == 2 and token
    page, again = runner.pending(SYNC, token, 2)
    assert places(page) == ['{"customer":"2"}', '{"customer":"3"}'] and again
    page, end = runner.pending(SYNC, again, 2)
    assert places(page) == ['{"customer":"4"}'] and end is None
    second = runner.store.collects(STATE.name)[1][1].collect_id
    with pytest.raises(paging.PageError, match="first collect"):
        runner.issue(SYNC, WorkPosition(second, 0))
    assert not partner.sent and runner.position(SYNC) is None
    out = runner.run_many([SYNC], {STATE.name: table(spark, rows(7))})
    assert operations.run_evidence(runner.store, out.run_id)["confirmed"] == 7 and runner.pending(SYNC) == (None, None)


def test_pages_of_a_collect_with_gaps(spark, runner, partner):
    at = runner.collect(STATE, table(spark, rows(7))).collect_id
    assert operations.delete_range(runner.store, STATE.name, WorkPosition(at, 2), WorkPosition(at, 3)) == 2
    page = runner.store.work(STATE.name)
    assert sorted(r.sequence_order for r in page.collect()) == [0, 1, 4, 5, 6]
    with pytest.raises(paging.PageError):  # its places are not dense, and nobody may think that they are
        runner.run(SYNC, table(spark, rows(7)))


def test_ranges_of_a_staged_table(spark):
    df = spark.range(50).select((F.col("id") * 7 % 50).alias("x")).repartition(4)
    made, read = counted(spark, df)
    staged = ordinal.staged(written(made, "x"), [F.col("x")], 6)
    assert staged.count == 50 and read.value == 50
    for a, b in ((0, 6), (6, 12), (3, 40), (48, 60), (60, 70)):
        assert sorted(r.x for r in staged.between(a, b).collect()) == list(range(a, min(b, 50)))
    assert read.value == 50 and len(staged.rows.inputFiles()) >= 8


# The current state.


def test_only_the_snapshot_is_shuffled(spark, runner):
    """State and snapshot lie in the same buckets: neither the check of duplicates, nor the difference, nor the next state moves a row."""
    runner.collect(STATE, table(spark, rows(6)))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        snapshot = runner._projected(STATE, table(spark, rows(5)))
        held, n = runner.store.state(runner.store.last(), stores.part_of(STATE.name, STATE.source.name))
        changes = diff.changes(snapshot, held)
        plans = [df._jdf.queryExecution().executedPlan().toString() for df in (changes, diff.duplicates(snapshot))]
        assert n == 2 and not any("Exchange" in p for p in plans) and "SortMergeJoin" in plans[0]
        assert [(r.kind, r.key_json) for r in changes.collect()] == [("remove", '{"customer":"5"}')]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_state_is_kept_in_more_buckets_as_the_session_asks(spark, runner):
    runner.collect(STATE, table(spark, rows(6)))
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    try:
        assert runner.collect(STATE, table(spark, rows(7))).upserts == 1
        assert runner.store.state(runner.store.last(), stores.part_of(STATE.name, STATE.source.name))[1] == 5
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
    assert runner.collect(STATE, table(spark, rows(7))).upserts == 0


# What a destination may say.


def test_records_of_one_subtype_share_a_request(spark, tmp_path, partner):
    to = Destination("partner", [Surface("rows", max_rows=9)], partner, subtype=lambda page: F.get_json_object("payload_json", "$.plan"))
    Runner(spark, Store(spark, str(tmp_path)), Registry(to)).run(SYNC, table(spark, [("1", "@", "a", "t"), ("2", "@", "a", "t"), ("3", "@", "b", "t")]))
    assert [len(x) for x in partner.sent] == [2, 1]


def test_records_of_one_path_share_a_request(spark, tmp_path):
    paths = []

    def submit(got, batch):
        paths.append([(r.request_path, r.key_json) for r in got.collect()])
        return Counts(batch["row_count"], confirmed=batch["row_count"])

    to = Registry(Destination("partner", [Surface("rows", max_rows=9)], submit, path="/lists/{{target.value}}/{{operation}}"))
    Runner(spark, Store(spark, str(tmp_path)), to).run(SYNC, table(spark, [("1", "@", "a", "t"), ("2", "@", "a", "t"), ("3", "@", "b", "u")]))
    assert [{p for p, _ in x} for x in paths] == [{"/lists/t/upsert"}, {"/lists/u/upsert"}] and sum(map(len, paths)) == 3


def made_destination(url, token=None):
    return Destination("made", [Surface("rows")], lambda got, batch: Counts(batch["row_count"], confirmed=batch["row_count"]), config={"url": url, "token": token})


def test_destinations_are_loaded_by_reference():
    registry = Registry()
    values = from_mapping({"eu_url": "https://eu", "us_url": "https://us", "us_token": "t"})
    reference = "tests.test_writers:made_destination"
    for name in ("eu", "us"):
        registry.load(reference, name, values, ["url"], ["token"])
    assert registry.resolve("eu").config == {"url": "https://eu", "token": None} and registry.resolve("us").config["token"] == "t"
    for bad in ((reference, "eu", values, ["url"]), (reference, "asia", values, ["url"]), ("tests.test_writers:nothing", "x", values), ("tests.nowhere:f", "x", values), ("plain", "x", values), ("builtins:dict", "x", values)):
        with pytest.raises(DeclarationError):
            registry.load(*bad)


def test_what_was_delivered_before_is_evidence(spark, runner, partner, monkeypatch):
    monkeypatch.setattr(Runner, "advance", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError, match="lost"):
        runner.run(SYNC, table(spark, rows(3)))
    monkeypatch.undo()
    out = runner.run(SYNC, table(spark, rows(3)))
    assert len(flat(partner)) == 3 and out.skipped == 2 and out.counts.confirmed == 3 and out.status == "succeeded"


# The log.


def test_clean_up_leaves_other_folders_alone(spark, runner, partner):
    other = State("others", Source("others", "select 1"), key={"customer": "id"})
    runner.collect(other, table(spark, rows(3)))
    held = set(runner.store.read("ordered_work", "others").inputFiles())
    runner.run(SYNC, table(spark, rows(2)))
    runner.run(SYNC, table(spark, rows(4)))
    last = runner.store.collects(STATE.name)[-1][1]
    young = set(runner.store.work(STATE.name, (last.collect_id, 0)).inputFiles())
    first = runner.store.collects(STATE.name)[0][1].collect_id
    later = datetime.datetime.now() + datetime.timedelta(days=1)
    assert operations.cleanup_work(runner.store, STATE.name, later, through=first) == 2
    assert set(runner.store.read("ordered_work", "others").inputFiles()) == held
    assert set(runner.store.read("ordered_work", STATE.name).inputFiles()) == young
    assert [c.rows for _, c in runner.store.collects()] == [2, 3]


def test_small_collects_share_folders(spark, runner, monkeypatch):
    monkeypatch.setattr(stores, "MOST_PARTS", 3)
    for n in range(1, 7):
        runner.collect(STATE, table(spark, rows(n)))
    assert len(runner.store.head()[1]["ordered_work"][STATE.name]) <= 3
    held = runner.store.collects(STATE.name)
    assert [c.rows for _, c in held] == [1] * 6 and runner.store.read("ordered_work").count() == 6
    middle = held[2][1].collect_id
    assert operations.delete_collect(runner.store, middle, force=True) == 1
    assert [c.collect_id for _, c in runner.store.collects(STATE.name)] == [c.collect_id for _, c in held if c.collect_id != middle]


# The size of the store.


def test_heads_and_folders_stay_bounded(spark, tmp_path, monkeypatch):
    """Batches of many pages, one after the other: heads and folders come to a size and stay there."""
    monkeypatch.setattr(stores, "MOST_PARTS", 8)
    monkeypatch.setattr(stores, "KEPT_HEADS", 4)
    monkeypatch.setattr(stores, "MOST_FOLDERS", 2)
    store, sizes = Store(spark, str(tmp_path), kept_seconds=0), []
    put = lambda i, status: store.put("destination_batches", [{"batch_id": f"b{i}", "page_id": f"p{i}", "status": status}], ["batch_id"], f"p{i}")
    for i in range(80):
        put(i, "pending")
        heads = sorted(os.listdir(tmp_path / "heads"))
        sizes.append(((tmp_path / "heads" / heads[-1]).stat().st_size, len(os.listdir(tmp_path / "destination_batches")), len(heads)))
    early, late = (tuple(map(max, zip(*part, strict=True))) for part in (sizes[16:48], sizes[48:]))
    assert all(b <= 1.1 * a for a, b in zip(early, late, strict=True)), (early, late)
    assert store.read("destination_batches").count() == 80
    # A part that was packed is written anew, and covers what the pack has of it, until it is packed again.
    put(3, "succeeded")
    assert store.read("destination_batches", "p3").first().status == "succeeded" and store.read("destination_batches").count() == 80
    for i in range(100, 110):
        put(i, "pending")
    assert store.read("destination_batches", "p3").first().status == "succeeded" and store.read("destination_batches").count() == 90
    assert store.delete("destination_batches", F.col("status") == "pending") == 89


# Request batches.


def test_an_island_over_many_tasks(spark):
    """One island of all rows, filled in range partitions, as one after the other would fill it."""
    made = [(i, "upsert", (i * 7) % 4, (i * 13) % 29) for i in range(700)]
    df = spark.createDataFrame(made, "at long, kind string, item_count long, byte_count long").repartition(5)
    got = sorted((r.at, r.batch_index) for r in batching.weighted_batches(df, "at", ["kind"], 11, 90).collect())
    batch, items, size, want = -1, 0, 0, []
    for at, _, n, b in made:
        wider = size + 1 + b
        if batch < 0 or items + n > 11 or wider > 90:
            batch, items, wider = batch + 1, 0, 2 + b
        items, size = items + n, wider
        want.append((at, batch))
    assert got == want
