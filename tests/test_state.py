import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weirgate.declarations import DeclarationError, Identifier, Source, State, StaticTarget
from weirgate.functions import canonical
from weirgate.operators import diff, paging
from weirgate.sources.keyset import WorkPosition

SOURCE = Source("customers", "select 1")
STATE = State("customers", SOURCE, key={"customer": "id"}, target="audience", identifiers=[Identifier("email", value="email")], payload={"plan": "plan"})
COLUMNS = "id string, email string, plan string, audience string"


def project(spark, rows, state=STATE):
    return canonical.project_state(spark.createDataFrame(rows, COLUMNS), state)


def work(spark, new, old):
    return diff.ordered_work(project(spark, new), project(spark, old), "c", "customers", "v").orderBy("sequence_order").collect()


def test_changed_new_and_missing(spark):
    old = [("1", "one@", "pro", "a"), ("2", "two@", "free", "a")]
    first = work(spark, old, [])
    assert [(r.kind, r.sequence_order) for r in first] == [("upsert", 0), ("upsert", 1)]
    second = work(spark, [("1", "one@", "enterprise", "a"), ("3", "three@", "pro", "a")], old)
    assert [(r.kind, r.key_json, r.payload_json) for r in second] == [("remove", '{"customer":"2"}', '{"plan":"free"}'), ("upsert", '{"customer":"1"}', '{"plan":"enterprise"}'), ("upsert", '{"customer":"3"}', '{"plan":"pro"}')]
    assert [r.sequence_order for r in second] == [0, 1, 2]
    assert work(spark, old, old) == []


def test_nulls_quotes_and_targets(spark):
    r = project(spark, [("1", None, 'say "hi"\né', None)]).first()
    assert r.target_json == '{"value":null}'
    assert r.identifiers_json == '[{"type":"email","value":null}]'
    assert r.payload_json == '{"plan":"say \\"hi\\"\\né"}'
    assert r.identity_json == '{"key":{"customer":"1"},"target":{"value":null}}'
    bare = project(spark, [("1", "e", "p", "a")], State("s", SOURCE, key={"customer": "id"})).first()
    assert bare.target_json is None and bare.identity_json == '{"key":{"customer":"1"},"target":null}' and bare.fingerprint
    static = project(spark, [("1", "e", "p", "a")], State("s", SOURCE, key={"customer": "id"}, target=StaticTarget("news"))).first()
    assert static.target_json == '{"value":"news"}'


def test_list_identifiers(spark):
    df = spark.createDataFrame([("1", ["b@", "a@", "a@"]), ("2", []), ("3", None)], "id string, emails array<string>")
    state = State("s", SOURCE, key={"c": "id"}, identifiers=[Identifier("email", values="emails")])
    found = [r.identifiers_json for r in canonical.project_state(df, state).orderBy("key_json").collect()]
    assert found == ['[{"type":"email","value":"a@"},{"type":"email","value":"a@"},{"type":"email","value":"b@"}]', "[]", "[]"]


def test_declarations_are_checked():
    with pytest.raises(DeclarationError):
        Identifier("email", value="a", values="b")
    with pytest.raises(DeclarationError):
        State("s", SOURCE, key={})
    with pytest.raises(DeclarationError):
        State("s", SOURCE, key={"k": "no column; drop"})
    assert Source("s", "  select 1 ;\n").query == "select 1"


def test_nested_columns_are_refused(spark):
    df = spark.sql("select named_struct('a', 1) as id")
    with pytest.raises(DeclarationError):
        canonical.project_state(df, State("s", SOURCE, key={"c": "id"}))


def test_duplicates_are_refused(spark):
    with pytest.raises(diff.DuplicateIdentity):
        diff.reject_duplicates(project(spark, [("1", "a", "p", "t"), ("1", "b", "p", "t")]))
    diff.reject_duplicates(project(spark, [("1", "a", "p", "t"), ("1", "a", "p", "u")]))


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 10_000))
def test_work_turns_the_old_state_into_the_new(spark, seed):
    rng = random.Random(seed)
    rows = lambda: [(str(i), "e", rng.choice("xy"), rng.choice("ab")) for i in range(20) if rng.random() < 0.7]
    old, new = rows(), rows()
    log = work(spark, new, old)
    assert [r.sequence_order for r in log] == list(range(len(log)))
    kinds = [r.kind for r in log]
    assert kinds == sorted(kinds, key=["remove", "upsert"].index)
    have = {(i, a): p for i, _, p, a in old}
    for r in log:
        at = (r.key_json.split('"')[3], r.target_json.split('"')[3])
        have.pop(at, None) if r.kind == "remove" else have.update({at: r.payload_json.split('"')[3]})
    assert have == {(i, a): p for i, _, p, a in new}


@pytest.mark.parametrize("most", [1, 2, 3, 7, 100])
def test_pages_make_up_the_log(spark, most):
    rows = [(f"w{c}{i}", f"c{c}", i) for c, n in enumerate([3, 1, 5]) for i in range(n)]
    log = spark.createDataFrame(rows, "work_id string, collect_id string, sequence_order long")
    seen, position = [], None
    for _ in range(20):
        page = paging.pending_page(log, position, most)
        got = [tuple(r) for r in paging.in_order(page.rows).collect()]
        while page.cursor is not None and got:
            more = [tuple(r) for r in paging.page_after_cursor(log, WorkPosition(got[-1][1], got[-1][2]), most).collect()]
            if not more:
                break
            got += more
        if not got:
            break
        seen += got
        position = WorkPosition(seen[-1][1], seen[-1][2])
    assert seen == rows
    assert log.filter(F.col("sequence_order") < 0).count() == 0
