"""A text of over 2 MB, with a planted passage and a planted run of lines, through every operator on documents."""

import hashlib
import math
import random

import pytest

from tests.llm import brute
from weirgate.llm import arrow_text, attention_lm, decontam, fingerprints, langid, licenses, line_dedup, mixing, rollups, simhash

PASSAGE = "one planted passage of the benchmark that has twelve words in all"
RUN = "\n".join(f"line {i} of a run that is there twice and has some words" for i in range(6))


@pytest.fixture(scope="module")
def long_docs():
    rng = random.Random(12)
    words = [f"w{rng.randrange(40_000)}" for _ in range(380_000)]
    lines = [" ".join(words[i : i + 12]) for i in range(0, len(words), 12)]
    text = "\n".join([*lines[:15_000], PASSAGE, RUN, *lines[15_000:], RUN, "all rights reserved"])
    assert len(text.encode()) > arrow_text.POWERS
    short = [(i, " ".join(f"w{rng.randrange(40_000)}" for _ in range(30)), "en", "s", 1) for i in range(1, 30)]
    return [(0, text, "en", "long", len(text)), *short]


@pytest.fixture(scope="module")
def folder(spark, long_docs, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("long"))
    spark.createDataFrame(long_docs, brute.SCHEMA).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(7, PASSAGE)], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return out


def row(df):
    return df.filter("doc_id = 0").first()


def test_fingerprints(spark, folder, long_docs):
    text, last = long_docs[0][1], max(long_docs)[1]
    r = row(fingerprints.query(spark, folder))
    half = len(text) // 2
    assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256((text[: len(text) - half] + last[:half]).encode()).hexdigest() and 0.45 < r.near_edited < 0.55


def test_languages(spark, folder):
    assert row(langid.query(spark, folder)).lang_pred == "en"


def test_leaks(spark, folder):
    r = row(decontam.query(spark, folder))
    assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(brute.alnum(row(spark.read.parquet(f"{folder}/documents.parquet")).text)), 12, 1, True)


def test_simhash(spark, folder, long_docs):
    assert row(simhash.query(spark, folder)).fingerprint == f"{brute.simhash(long_docs[0][1]):016x}"


def test_scores(spark, folder, long_docs, monkeypatch):
    for name in ("STEPS", "WARM", "SHARD_STEPS"):
        monkeypatch.setattr(attention_lm, name, 4)
    r = row(attention_lm.query(spark, folder))
    assert r.n_tokens == len(brute.spaced(long_docs[0][1])) + 1 and math.isfinite(r.score) and r.score < 0


def test_counts(spark, folder, long_docs):
    got = {(r.source, r.lang, r.version): [r.docs, r.tokens] for r in rollups.query(spark, folder).collect()}
    assert got == {(s, "en", "spaced-1"): [n, sum(len(brute.spaced(t)) for _, t, _, x, _ in long_docs if x == s)] for s, n in (("long", 1), ("s", 29))}


def test_lines(spark, folder, long_docs):
    gone = brute.line_dedup([(i, t) for i, t, *_ in long_docs], line_dedup.MIN_WORDS)
    kept = row(line_dedup.keep_new(spark.read.parquet(f"{folder}/documents.parquet"))).text
    lines = long_docs[0][1].split("\n")
    assert kept == "\n".join(x for i, x in enumerate(lines) if i not in set(gone[0])) and kept.count(RUN) == 1


def test_licences(spark, folder, long_docs):
    r = row(licenses.query(spark, folder))
    assert (r.n_words, r.n_base, r.base_labels) == (len(brute.alnum(long_docs[0][1])), 1, "reserved")


def test_mix(spark, folder, long_docs):
    r = row(mixing.query(spark, folder))
    assert r.size == len(brute.spaced(long_docs[0][1])) and 0 < r.taken <= 2 * r.size
