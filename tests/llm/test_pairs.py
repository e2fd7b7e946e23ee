"""Fingerprints, near copies, leaks and repeated lines against brute force."""

import hashlib
import itertools
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import brute
from weirgate import materialize
from weirgate.llm import components, decontam, fingerprints, line_dedup, near_copies, simhash

SEEDS = (1, 2)


def frame(spark, rows, clash=False):
    df = spark.createDataFrame(rows, brute.SCHEMA)
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(brute.CLASHING)]) if clash else df


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Folders with documents and benchmark tables, by seed."""
    out = {}
    for seed in SEEDS:
        folder = str(tmp_path_factory.mktemp(f"t{seed}"))
        docs = brute.rows(seed)
        words = brute.alnum(next(t for _, t, *_ in docs if t and len(brute.alnum(t)) > 60))
        items = [(1, " ".join(words[5:19])), (2, " ".join(words[40:43])), (3, "no such words here at all but these ten and more"), (None, " ".join(words[20:31]).upper()), (4, None), (5, "!!"), (1, " ".join(words[5:19]))]
        frame(spark, docs, clash=True).repartition(3).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        out[seed] = (folder, docs, items)
    return out


@pytest.fixture(scope="module")
def nothing(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("none"))
    spark.createDataFrame([], brute.SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


@pytest.mark.parametrize("module", [fingerprints, simhash, decontam, line_dedup])
def test_empty_tables(spark, nothing, module):
    assert module.query(spark, nothing).count() == 0


@pytest.mark.parametrize("seed", SEEDS)
def test_fingerprints(spark, tables, seed):
    folder, docs, _ = tables[seed]
    got = {r.doc_id: r for r in fingerprints.query(spark, folder).collect()}
    order = sorted((i, t or "") for i, t, *_ in docs)[::-1]
    assert len(got) == len(order)
    names = {}
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        hashes = lambda x: {h for h, _ in brute.marks(x)}
        r = got[i]
        assert (r.n_chars, r.edited_sha256, r.n_marks) == (len(t), hashlib.sha256(edited.encode()).hexdigest(), len(brute.marks(t)))
        assert r.near_edited == pytest.approx(brute.jaccard(hashes(t), hashes(edited)))
        assert r.near_next == pytest.approx(brute.jaccard(hashes(t), hashes(after)))
        assert names.setdefault(t, r.fingerprint) == r.fingerprint
        assert (r.fingerprint == r.edited_fingerprint) == (brute.marks(t) == brute.marks(edited))


def test_marks_are_those_of_winnowing(spark):
    texts = [t for _, t, *_ in brute.rows(3)]
    got = fingerprints.fingerprints(frame(spark, brute.rows(3))).select("text", "marks").collect()
    assert len(got) == len(texts)
    for r in got:
        assert {(m.hash, m.place) for m in r.marks or []} == brute.marks(r.text)


def test_a_shared_passage_shares_a_mark(spark):
    shared = "some six words that both hold"
    rows = [(1, f"a b c d {shared} x y z", "en", "s", 0), (2, f"other {shared}", "en", "s", 0)]
    a, b = ({m.hash for m in r.marks} for r in fingerprints.fingerprints(frame(spark, rows)).collect())
    assert a & b


def test_one_row_is_its_own_next(spark, tmp_path):
    frame(spark, [(7, "ab cd", "en", "s", 5)]).write.parquet(f"{tmp_path}/documents.parquet")
    r = fingerprints.query(spark, str(tmp_path)).first()
    assert r.edited_sha256 == hashlib.sha256(b"ab ab").hexdigest() and r.near_next == 1.0


@pytest.mark.parametrize("kind, ids", [("long", [1 << 60]), ("long", [2**62 + i for i in range(5)]), ("long", [-(2**63), 2**63 - 1, 0, None]), ("string", ["b", "a", None, "ä"]), ("int", [5] * 200), ("int", [None] * 200), ("date", ["2024-01-02", "2023-01-01"])])
def test_any_ids_have_neighbours(spark, tmp_path, kind, ids):
    """Ids near the ends of long, of other types, all equal or all null: each text's next is the one before it in (id, hash of the text)."""
    rows = [(i, f"t{k} u v w x y") for k, i in enumerate(ids)]
    df = spark.createDataFrame(rows, f"doc_id {'string' if kind == 'date' else kind}, text string").withColumn("doc_id", F.col("doc_id").cast(kind))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    order = df.orderBy(F.desc_nulls_last("doc_id"), F.desc(F.xxhash64("text"))).collect()
    want = []
    for k, r in enumerate(order):
        after = order[(k + 1) % len(order)].text
        want.append(hashlib.sha256((r.text[: len(r.text) - len(r.text) // 2] + after[: len(r.text) // 2]).encode()).hexdigest())
    assert sorted(r.edited_sha256 for r in fingerprints.query(spark, str(tmp_path)).collect()) == sorted(want)


def test_null_and_repeated_ids_have_fingerprints(spark, tmp_path):
    rows = [(None, "a b c", None, None, None), (1, "d e f", None, None, None), (1, "d e f", None, None, None), (None, None, None, None, None)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    assert fingerprints.query(spark, str(tmp_path)).count() == 4
    assert simhash.query(spark, str(tmp_path)).count() == 4


@pytest.mark.parametrize("seed", SEEDS)
def test_simhash(spark, tables, seed):
    folder, docs, _ = tables[seed]
    fp = {i: brute.simhash(t) for i, t, *_ in docs}
    want = brute.roots(fp, [(a, b) for a, b in itertools.combinations(fp, 2) if (fp[a] ^ fp[b]).bit_count() <= simhash.MOST_BITS])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.query(spark, folder).collect()}
    assert got == {i: (f"{fp[i]:016x}", want[i]) for i in fp}


@pytest.mark.parametrize("cell", [4096, 3])
def test_links_of_close_fingerprints(spark, monkeypatch, cell):
    """Fingerprints on every side of the blocks' edges, in chains; with small cells too, so that hot anchors are cut."""
    import random

    monkeypatch.setattr(simhash, "CELL", cell)
    rng = random.Random(cell)
    fps = [rng.getrandbits(64) for _ in range(20)] + [0, (1 << 64) - 1]
    for _ in range(300):
        x = rng.choice(fps)
        for bit in rng.sample(range(64), rng.randint(0, 6)):
            x ^= 1 << bit
        fps.append(x)
    ids = dict(enumerate(fps))
    want = brute.roots(ids, [(a, b) for a, b in itertools.combinations(ids, 2) if (ids[a] ^ ids[b]).bit_count() <= 4])
    signed = [(i, x - (1 << 64) if x >> 63 else x) for i, x in ids.items()]
    df = spark.createDataFrame(signed, "doc_id long, fp long")
    got = {r.doc_id: r.component_id for r in df.join(simhash.link(df), "fp").collect()}
    assert got == want


def test_one_of_each_group_stays(spark):
    docs = brute.rows(4)
    fp = {i: brute.simhash(t) for i, t, *_ in docs}
    want = brute.roots(fp, [(a, b) for a, b in itertools.combinations(fp, 2) if (fp[a] ^ fp[b]).bit_count() <= 4])
    df = frame(spark, docs + docs[:5], clash=True)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))
    assert {tuple(r) for r in kept.collect()} <= {tuple(r) for r in df.collect()}


def test_components_without_an_id_of_their_own(spark):
    """Unlike texts under null ids or one id are groups of their own; copies under null ids are one."""
    a, b, c, d, e = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcde")
    df = spark.createDataFrame([(None, a), (None, b), (None, b), (7, c), (7, d), (8, e), (9, e)], "doc_id long, text string")
    assert sorted((r.text[0], r.doc_id) for r in simhash.keep_one(df).collect()) == [("a", None), ("b", None), ("c", 7), ("d", 7), ("e", 8)]


@pytest.mark.parametrize("stars", [1, 2])
def test_near_copies_by_shingles(spark, monkeypatch, stars):
    """Copies with a word changed here and there, in chains too, whose fingerprints mostly differ by more than 4 bits."""
    import random

    monkeypatch.setattr(near_copies, "STARS", stars)
    rng = random.Random(stars)
    texts = [" ".join(f"w{rng.randrange(3000)}" for _ in range(rng.randint(60, 200))) for _ in range(12)] + ["a b c", "A  b c", "a b d", "", " "]
    for _ in range(90):
        words = rng.choice([t for t in texts if len(t) > 99]).split()
        for at in rng.sample(range(len(words)), rng.randint(1, 5)):
            words[at] = f"x{rng.randrange(99)}"
        texts.append(" ".join(words))
    docs = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    grams = {}
    for i, t in enumerate(texts):
        words = brute.spaced(brute.lower(t))
        grams[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    pairs = [(a, b) for a, b in itertools.combinations(grams, 2) if brute.jaccard(grams[a], grams[b]) >= 0.8 and bool(grams[a]) == bool(grams[b])]
    fp = {i: brute.simhash(t) for i, t in enumerate(texts)}
    assert sum((fp[a] ^ fp[b]).bit_count() > 4 for a, b in pairs) > len(pairs) // 2
    df = frame(spark, docs, clash=True)
    kept = corpus_pipeline.near_copies(spark, df, "")
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(brute.roots(grams, pairs).values()))


def test_near_copies_without_an_id(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    df = spark.createDataFrame([(None, a), (None, b), (None, b + " z"), (7, c), (7, d), (None, None), (3, "")], "doc_id long, text string")
    assert sorted(((r.text or "-")[0], r.doc_id) for r in near_copies.keep_one(df).collect()) == [("-", 3), ("a", None), ("b", None), ("c", 7), ("d", 7)]


def test_components_of_a_path_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({got[i] for i in range(41)}) == 1 and len({got[i] for i in range(100, 160)}) == 1 and got[0] != got[100]


def test_components_of_a_long_path_take_few_rounds(spark, monkeypatch):
    rounds, plain = [], components.stage
    monkeypatch.setattr(components, "stage", lambda df, name: rounds.append(name) or plain(df, name))
    n = 1000
    got = components.components(spark.range(n).selectExpr("id as a", "id + 1 as b"))
    assert got.select("root").distinct().count() == 1 and got.count() == n + 1
    assert rounds.count("labels") < 20


def test_blocks_of_the_benchmark(spark, tables, monkeypatch):
    """A benchmark of more windows than a filter serves: several passes, the same result."""
    folder, _, _ = tables[1]
    want = sorted(map(tuple, decontam.query(spark, folder).collect()))
    monkeypatch.setattr(decontam, "MOST_BITS", 6)
    monkeypatch.setattr(decontam, "LEAST_BITS", 6)
    assert sorted(map(tuple, decontam.query(spark, folder).collect())) == want


def test_decontamination_is_its_oracle(spark):
    import duckdb

    data = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    assert sorted(map(tuple, decontam.query(spark, data).collect())) == sorted(db.execute(decontam.ORACLE_SQL).fetchall())


@pytest.mark.parametrize("seed", SEEDS)
def test_decontamination(spark, tables, seed):
    folder, docs, items = tables[seed]
    items = [("" if i is None else i, t) for i, t in items]
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontam.query(spark, folder).collect()}
    for i, t, *_ in docs:
        n, hit, found = brute.contamination(t, items)
        assert got[i] == (n, hit, len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), hit > 0), t
    assert any(x[1] for x in got.values())


def test_contaminated_documents_go(spark, tables):
    folder, docs, items = tables[1]
    df = frame(spark, docs, clash=True)
    kept = decontam.drop_contaminated(df, spark.read.parquet(f"{folder}/benchmark.parquet"))
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, t, *_ in docs if not brute.contamination(t, items)[1])


@pytest.mark.parametrize("seed", [*SEEDS, 5])
@pytest.mark.parametrize("least", [1, 25, 60])
def test_line_dedup(spark, seed, least):
    docs = brute.rows(seed)
    want = brute.line_dedup([(i, t) for i, t, *_ in docs], least)
    got = {r.doc_id: r for r in line_dedup.dedup(frame(spark, docs), least).collect()}
    for i, t, *_ in docs:
        kept = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in set(want[i]))
        assert (got[i].text, got[i].lines_deleted) == (kept, len(want[i]))


def test_line_dedup_of_repeated_rows_and_clashing_names(spark):
    text = "\n".join(f"line {i} has some words of its own" for i in range(6))
    df = frame(spark, [(1, text, "en", "s", 0), (1, text, "en", "s", 0), (None, text, "en", "s", 0), (2, "short", "en", "s", 0), (2, "short", "en", "s", 0), (3, None, None, None, None)], clash=True)
    kept = line_dedup.keep_new(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect() if r.text) == [(1, text), (2, "short"), (2, "short")]


def test_common_prefixes_of_suffixes(spark):
    """Every suffix in order, and its whole common prefix with the one before, to the end of its segment."""
    rng = random.Random(6)
    lines = {d: [(i, rng.choice([3, 5, 5, 5, 8])) for i in range(40) if i % 13] for d in range(6)}
    lines[6] = list(lines[2])
    rows = [(d, i, r, 1) for d, of in lines.items() for i, r in of]
    got = line_dedup.common_prefixes(spark.createDataFrame(rows, "doc long, idx int, r0 long, size int").repartition(3)).collect()

    def suffix(d, i):
        of = dict(lines[d])
        out = []
        while i in of:
            out.append(of[i])
            i += 1
        return out

    want = sorted((suffix(d, i), d, i) for d, i, *_ in rows)
    got = sorted(got, key=lambda r: r.at)
    assert [(r.doc, r.idx) for r in got] == [(d, i) for _, d, i in want]
    for (x, *_), (y, *_), r in zip(want[:-1], want[1:], got[1:], strict=True):
        n = next((k for k, (a, b) in enumerate(zip(x, y)) if a != b), min(len(x), len(y)))
        assert r.lcp == n


def test_components_of_hubs_take_a_round_and_few_files(spark, tmp_path, monkeypatch):
    """Leaves of a hub are one label after one round; a small table is not spread over all of a shuffle's partitions, and only the last one stays."""
    from pathlib import Path

    monkeypatch.setattr(materialize, "shared_dir", lambda _: str(tmp_path))
    rounds, plain = [], components.stage
    monkeypatch.setattr(components, "stage", lambda df, name: rounds.append((name, plain(df, name))) or rounds[-1][1])
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    for k, v in zip(old, ("40", "false"), strict=True):
        spark.conf.set(k, v)
    try:
        edges = spark.range(2000).selectExpr("id % 3 - 3 as a", "id as b")
        got = components.components(edges)
        assert got.select("root").distinct().count() == 3 and got.count() == 2003
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert [name for name, _ in rounds].count("labels") == 1
    assert max(len(df.inputFiles()) for name, df in rounds if name in ("labels", "roots")) <= spark.sparkContext.defaultParallelism
    assert len(list(Path(tmp_path).iterdir())) == 1


def test_tables_on_the_way_go(spark, tmp_path, monkeypatch):
    """What a stage of the pipeline leaves is what its result is read from."""
    from pathlib import Path

    text = "\n".join(" ".join(f"w{i}x{j}" for j in range(10)) for i in range(6))
    df = spark.createDataFrame([(1, text, 5), (2, text + "\nmore of it", 5), (3, "a b c d e f g", 7)], "doc_id long, text string, n_chars int")
    monkeypatch.setattr(materialize, "shared_dir", lambda _: str(tmp_path))
    left = lambda: sorted(p.name.rsplit("-", 1)[0] for p in Path(tmp_path).iterdir())
    lines = line_dedup.keep_new(df)
    assert left() == ["line-later"]
    assert lines.count() == 3
    one = near_copies.keep_one(df)
    assert left() == ["jaccard-roots", "jaccard-signed", "line-later"]
    assert sorted(r.doc_id for r in one.collect()) == [1, 3]
