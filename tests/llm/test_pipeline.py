"""Each stage of the pipeline against its own input, as run() chains them."""

import itertools

import pytest

import corpus_pipeline
from tests.llm import brute
from weirgate.llm import langid, line_dedup, mixing

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows before and after each stage."""
    docs, out = spark.read.parquet(f"{DATA}/documents.parquet"), []
    columns = docs.columns
    for i, (name, function) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(i))
        function(spark, docs, DATA).write.parquet(path)
        after = spark.read.parquet(path)
        if name != "mixing":
            assert after.columns == columns
        out.append((docs.collect(), after.collect()))
        docs = after
    return dict(zip([n for n, _ in corpus_pipeline.STAGES], out, strict=True))


def ids(rows):
    return sorted(r.doc_id for r in rows)


def test_order_of_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "line dedup", "near copies", "decontamination", "mixing"]


def test_language(spark, stages):
    before, after = stages["language"]
    assert {tuple(r) for r in after} <= {tuple(r) for r in before}
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    found = langid.identify(docs, langid.learn(docs)).collect()
    assert ids(after) == sorted(r.doc_id for r in found if r.lang_pred != "und" and r.known >= langid.KNOWN)


def test_lines(stages):
    before, after = stages["line dedup"]
    gone = brute.line_dedup([(r.doc_id, r.text) for r in before], line_dedup.MIN_WORDS)
    want = {}
    for r in before:
        lines = r.text.split("\n")
        left = [x for i, x in enumerate(lines) if i not in set(gone[r.doc_id])]
        if not gone[r.doc_id] or any(brute.spaced(x) for x in left):
            want[r.doc_id] = "\n".join(left)
    assert {r.doc_id: r.text for r in after} == want
    assert all(r.n_chars == len(r.text) for r in after)


def test_near_copies(stages):
    before, after = stages["near copies"]
    grams = {}
    for r in before:
        words = brute.spaced(brute.lower(r.text))
        grams[r.doc_id] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    alike = lambda a, b: len(a) >= 0.8 * len(b) and len(b) >= 0.8 * len(a) and brute.jaccard(a, b) >= 0.8
    roots = brute.roots(grams, [(a, b) for a, b in itertools.combinations(grams, 2) if alike(grams[a], grams[b])])
    assert ids(after) == sorted(set(roots.values()))


def test_leaks(spark, stages):
    before, after = stages["decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    assert ids(after) == sorted(r.doc_id for r in before if not brute.contamination(r.text, items)[1])


def test_mix(stages):
    before, after = stages["mixing"]
    sizes = {}
    for r in before:
        sizes[r.source] = sizes.get(r.source, 0) + len(brute.spaced(r.text))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    goal = dict(zip(order, mixing.targets([sizes[s] for s in order]), strict=True))
    for s in order:
        assert sum(r.mix_words for r in after if r.source == s) == round(goal[s])
    whole = {r.doc_id: r.text for r in before}
    assert all(brute.spaced(r.text) == brute.spaced(whole[r.doc_id])[: r.mix_words] for r in after)


def test_awkward_tables_go_through_all_stages(spark, tmp_path):
    """Nulls in any column, empty texts, repeated rows, clashing names; and an empty table."""
    from pyspark.sql import functions as F

    rows = brute.rows(1) + brute.rows(1)[:9] + [(None, "some words of no document", None, None, None), (None, None, None, None, None), (5, "", "en", "a", 0)]
    docs = spark.createDataFrame(rows, brute.SCHEMA).select("*", *[F.lit(i).alias(c) for i, c in enumerate(brute.CLASHING)])
    for name, table in (("full", docs), ("empty", docs.limit(0))):
        folder = str(tmp_path / name)
        table.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, "no such words here at all but these ten and more"), (None, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        out = corpus_pipeline.run(spark, folder)
        assert set(docs.columns) <= set(out.columns) and (out.count() > 0) == (name == "full")
