"""Language, scores, counts, archives, licences and mixing."""

import base64
import gzip
import hashlib
import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm import brute
from weirgate.llm import arrow_text, attention_lm, fingerprints, langid, licenses, line_dedup, mixing, rollups, warc

DATA = "/root/testdata/sf0.001"
MORE = "/root/testdata/sf0.01"
PAGES = "page_id long, url string, html string"


def frame(spark, rows, clash=False):
    df = spark.createDataFrame(rows, brute.SCHEMA)
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(brute.CLASHING)]) if clash else df


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("tables"))
    frame(spark, brute.rows(1), clash=True).repartition(3).write.parquet(f"{out}/documents.parquet")
    return out


@pytest.fixture(scope="module")
def nothing(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("none"))
    spark.createDataFrame([], brute.SCHEMA).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([], PAGES).write.parquet(f"{out}/pages.parquet")
    return out


@pytest.mark.parametrize("module", [langid, attention_lm, rollups, warc, licenses, mixing])
def test_empty_tables(spark, nothing, module):
    assert module.query(spark, nothing).count() == 0


# Language.


def test_language_of_held_out_documents(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{MORE}/documents.parquet").collect()}
    got = langid.query(spark, MORE).collect()
    assert len(got) == len(truth)
    held = [r for r in got if r.held_out and r.lang_pred != "und"]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)


def test_language_looks_at_the_text_alone(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = langid.learn(docs)
    plain = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs, model).collect()}
    other = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None).cast("string")).withColumn("doc_id", F.col("doc_id") + 1_000_000)
    assert {r.doc_id - 1_000_000: (r.lang_pred, r.score) for r in langid.identify(other, model).collect()} == plain


def test_language_of_odd_texts(spark, folder):
    got = {r.doc_id: r for r in langid.query(spark, folder).collect()}
    for i, t, *_ in brute.rows(1):
        assert (got[i].lang_pred == "und") == (not any(c.isalpha() for c in t or ""))
    unlabelled = [(i, t, None, s, n) for i, t, _, s, n in brute.rows(1)]
    df = frame(spark, unlabelled)
    assert {r.lang_pred for r in langid.identify(df, langid.learn(df)).collect()} == {"und"}


def test_languages_by_brute_force(spark):
    """Per-language counts of the filter's hits, less what false positives would give; of equal languages the first in order."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = langid.learn(docs)
    texts = [r.text for r in docs.limit(40).collect()] + ["", "123", "É", "a b", None]
    got = langid.identify(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), model).collect()
    mask = (1 << langid.SLOTS_BITS) - 1
    for r in got:
        grams = brute.letter_grams(texts[r.doc_id] or "", langid.ORDERS)
        sure = []
        for n, lang in enumerate(model.langs):
            hits = sum(all(int(model.slots[h >> (k * langid.SLOTS_BITS) & mask, 0]) >> n & 1 for k in range(langid.HASHES)) for h in grams)
            sure.append(max(0, (hits - len(grams) * model.false[n]) / (1 - model.false[n])))
        lettered = any(c.isalpha() for c in texts[r.doc_id] or "")
        assert r.lang_pred == (model.langs[sure.index(max(sure))] if lettered else "und")
        assert r.score == pytest.approx(max(sure) / max(sum(sure), 1e-9) if lettered else 0)


def test_a_tie_goes_to_the_first_language():
    h = np.arange(1, 500, dtype=np.uint64)
    model = langid.Filter(["a", "b"], [h, h])
    assert langid.decide(model, pa.array(["some text"], pa.large_string()))[0] == ["a"]


def test_bit_sliced_filter_gives_all_languages():
    a, b = np.arange(1, 3000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), np.arange(2000, 5000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    model = langid.Filter(["a", "b"], [a, b])
    bits = model.languages(np.concatenate([a, b]))[:, 0]
    assert (bits[: len(a)] & np.uint64(1)).all() and (bits[len(a) :] & np.uint64(2)).all()
    assert (bits[: len(a) - 1000] & np.uint64(2)).mean() < 0.05


# Language-model scores.


def test_base_scores_and_counts(spark, folder):
    docs = brute.rows(1)
    tokens = {i: [*brute.spaced(brute.lower(t)), None] for i, t, *_ in docs}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    counts = Counter(x for i, ws in tokens.items() if not held[i] for x in ws)
    total, distinct = sum(counts.values()), len(counts)
    got = {r.doc_id: r for r in attention_lm.query(spark, folder).collect()}
    assert set(got) == set(tokens)
    for i, ws in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws), sum(counts[w] > 0 for w in ws), total)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in ws))
        assert r.score < 0 and math.isfinite(r.score)


def test_scores_by_brute_force(spark, monkeypatch, model):
    """Each word's product over its ids, mixed with its share of the training tokens."""
    docs = [(i, t, "en", "s", 0) for i, t, *_ in brute.rows(1) if i % 7 == 0 or not t] + [(900, "w " * 50 + "ä the end", "en", "s", 0)]
    monkeypatch.setattr(attention_lm, "learn", lambda *_: model)
    tokens = {i: brute.spaced(brute.lower(t)) for i, t, *_ in docs}
    counts = Counter(x for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2 for x in [*ws, None])
    total = sum(counts.values())
    for r in attention_lm.score(frame(spark, docs)).collect():
        ids, first = attention_lm.subwords([w.encode() for w in tokens[r.doc_id]], attention_lm.VOCABULARY)
        ids = np.concatenate([ids, [attention_lm.END]]).astype(int)
        one = brute.next_log10(model, ids, attention_lm.CONTEXT, attention_lm.STEP, attention_lm.GROUPS, attention_lm.SIDE)
        want, ends = 0.0, [*first.tolist(), len(ids)]
        for w, a, b in zip([*tokens[r.doc_id], None], ends[:-1], ends[1:], strict=True):
            want += math.log10(attention_lm.SHARE * counts[w] / total + (1 - attention_lm.SHARE) * 10 ** sum(one[a:b]))
        assert r.score == pytest.approx(want, rel=1e-3, abs=1e-3)


def test_averaged_shards(spark, monkeypatch):
    """More shards than one: weights are averaged, texts without ids are dealt one by one, and the model is one of all."""
    monkeypatch.setattr(attention_lm, "SHARD_WORDS", 300)
    for name, n in (("WARM", 20), ("SHARD_STEPS", 20)):
        monkeypatch.setattr(attention_lm, name, n)
    texts = spark.createDataFrame([(brute.lower(t),) for _, t, *_ in brute.rows(2)], "text string").repartition(3)
    model = attention_lm.learn(texts, 1500)
    ids = np.array([5, attention_lm.END])
    assert np.isfinite(model.log10(ids, np.array([0, 2]))).all() and set(model.w) == set(attention_lm.fit(["a b"], steps=1).w)


def test_all_training_texts_are_learned_from(spark, monkeypatch):
    """In shards or not: each text's ids are counted, and each window is learned from once in all rounds; in a lone shard once at least."""
    texts = [brute.lower(t) for _, t, *_ in brute.rows(2) if t]
    column = pa.array(texts, pa.large_string())
    ids, first, n = attention_lm.ids_of(column, attention_lm.VOCABULARY)
    assert n == sum(len(brute.spaced(t)) for t in texts)
    parts = list(attention_lm._shards(iter([pa.RecordBatch.from_arrays([column], names=["text"])]), attention_lm.VOCABULARY, 300))
    assert b"".join(p.column("ids")[0].as_py() for p in parts) == ids.astype(np.uint16).tobytes()
    seen, plain = [], attention_lm.windows

    def watched(model, *args):
        seen.append(len(args[0]))
        return {k: np.zeros_like(x) for k, x in model.w.items()}, 0.0

    monkeypatch.setattr(attention_lm.Attention, "gradients", watched)
    monkeypatch.setattr(attention_lm, "BATCH", 1)
    model = attention_lm.untrained(np.bincount(ids, minlength=attention_lm.SUBWORDS + 1).astype(float))
    whole = len(plain(model.class_of[ids], first)[0])
    for turn in range(3):
        model.train(ids, first, 1, part=(turn, 3))
    assert len(seen) == whole
    model.train(ids, first, 1)
    assert len(seen) == 2 * whole
    counted = {}
    # A corpus of many times the words of a shard, of which a share of 1/32 was learned from before.
    monkeypatch.setattr(attention_lm, "SHARD_WORDS", n // 40)
    with pytest.raises(Found):
        monkeypatch.setattr(attention_lm, "untrained", found_counts(counted))
        attention_lm.learn(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3), 40 * n)
    assert np.array_equal(counted["n"], np.bincount(ids, minlength=attention_lm.SUBWORDS + 1))


class Found(Exception):
    pass


def found_counts(into):
    def untrained(counts):
        into["n"] = counts.copy()
        raise Found

    return untrained


def test_held_out_texts_score_above_the_base(spark):
    got = [r for r in attention_lm.query(spark, MORE).collect() if r.held_out]
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


@pytest.fixture(scope="module")
def model():
    return attention_lm.fit([brute.lower(t) for _, t, *_ in brute.rows(2) if t], steps=30)


def test_probabilities_of_all_ids_sum_to_one(model):
    ids = np.array([5, 9, attention_lm.END, 3])
    whole = []
    for i in range(0, attention_lm.SUBWORDS + 1, 13):
        whole.append(model.log10(np.array([*ids[:2], i]), np.array([0, 3]))[2])
    some = 10.0 ** np.array(whole)
    every = np.concatenate([model.log10(np.concatenate([[5, 9, i] for i in part]), np.arange(0, 3 * len(part) + 1, 3))[2::3] for part in np.array_split(np.arange(attention_lm.SUBWORDS + 1), 40)])
    assert (10.0**every).sum() == pytest.approx(1, abs=1e-3)
    assert np.allclose(some, 10.0 ** every[::13], rtol=1e-3)


def test_words_are_cut_in_lots(monkeypatch):
    """Few calls of the encoder for many words, with the ids of each word alone, whatever white space beside ASCII's stands in one."""
    plain, calls = attention_lm.encoder(attention_lm.VOCABULARY), []

    class Counted:
        def encode_ordinary(self, text):
            calls.append(text)
            return plain.encode_ordinary(text)

    monkeypatch.setattr(attention_lm, "encoder", lambda _: Counted())
    words = [w.encode() for _, t, *_ in brute.rows(2) if t for w in brute.spaced(t) if not any(c.isspace() for c in w)]
    words += [b"it's", b"12ab!?", "\u00e9\u0301".encode(), b"'s", b"\x00"]
    for some, most in ((words, 1 + len(words) // attention_lm.LOT), ([], 0), ([*words[:50], "a\u00a0".encode(), "\u3000b".encode(), b"\x1c", b"c"], 54)):
        calls.clear()
        ids, first = attention_lm.subwords(some, attention_lm.VOCABULARY)
        assert len(calls) <= most and len(first) == len(some) + 1
        assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)] == [plain.encode_ordinary(" " + w.decode()) for w in some]


def test_each_word_is_cut_once_and_each_text_split_once(monkeypatch, model):
    """In all slices of a task, for shards as for scores; and a part of a shard's windows is made without the others."""
    texts = [brute.lower(t) for _, t, *_ in brute.rows(2) if t]
    column, distinct = pa.array(texts, pa.large_string()), {w for t in texts for w in brute.spaced(t)}
    monkeypatch.setattr(attention_lm, "SLICE", 4096)
    cut, split = [], []
    plain, plain_split, plain_windows = attention_lm.subwords, attention_lm.split_words, attention_lm.windows
    monkeypatch.setattr(attention_lm, "subwords", lambda words, vocabulary: (cut.extend(words), plain(words, vocabulary))[1])
    monkeypatch.setattr(attention_lm, "split_words", lambda column, table: (split.append(len(column)), plain_split(column, table))[1])
    batches = [pa.RecordBatch.from_arrays([x], names=["text"]) for x in (column, column)]
    (shard,) = attention_lm._shards(iter(batches), attention_lm.VOCABULARY, float("inf"))
    assert sorted(cut) == sorted(w.encode() for w in distinct)
    ids, first, _ = attention_lm.ids_of(column, attention_lm.VOCABULARY)
    assert shard.column("ids")[0].as_py() == np.tile(ids, 2).astype(np.uint16).tobytes()
    docs = pa.table({"doc_id": pa.array(range(len(texts))), "held_out": pa.array([False] * len(texts)), "text": column})
    none = pa.table({"word": pa.array([], pa.int64()), "c": pa.array([], pa.int64())})
    cut.clear(), split.clear()
    got = attention_lm._score(docs, none, model, 0, 0, attention_lm.VOCABULARY)
    assert sorted(cut) == sorted(w.encode() for w in distinct) and sum(split) == len(texts)
    assert np.allclose(got.column("score").to_numpy(), np.add.reduceat(model.log10(ids, first), first[:-1]), rtol=1e-4)
    # What is forgotten is cut again, with the same ids.
    monkeypatch.setattr(attention_lm, "KEPT_WORDS", 5)
    (again,) = attention_lm._shards(iter(batches), attention_lm.VOCABULARY, float("inf"))
    assert again.equals(shard)
    made = []
    monkeypatch.setattr(attention_lm, "windows", lambda *args: (made.append(plain_windows(*args)), made[-1])[1])
    whole = len(plain_windows(model.class_of[ids], first)[0])
    for turn in range(2):
        attention_lm.untrained(np.ones(attention_lm.SUBWORDS + 1)).train(ids, first, 1, part=(turn, 2))
    assert sum(len(x[0]) for x in made) == whole


def test_windows_score_each_id_once_whatever_stands_beside(model):
    rng = np.random.default_rng(1)
    sizes = [1, 15, 16, 17, 32, 33, 200]
    first = np.concatenate([[0], np.cumsum(sizes)])
    ids = rng.integers(0, attention_lm.SUBWORDS, first[-1])
    _, _, _, counts, place = attention_lm.windows(model.class_of[ids], first)
    assert sorted(place[counts].tolist()) == list(range(len(ids)))
    together = model.log10(ids, first)
    for a, b in zip(first[:-1], first[1:], strict=True):
        assert np.allclose(together[a:b], model.log10(ids[a:b], np.array([0, b - a])), atol=1e-4)


def test_later_ids_do_not_change_earlier_scores(model):
    a = np.array([5, 9, 11, 12, 13])
    b = np.array([5, 9, 11, 40, 41])
    x, y = (model.log10(v, np.array([0, 5])) for v in (a, b))
    assert np.allclose(x[:3], y[:3], atol=1e-5)


def test_gradients(model):
    rng = np.random.default_rng(2)
    ids = rng.integers(0, attention_lm.SUBWORDS, 90)
    seen, hidden, wanted, counts, _ = attention_lm.windows(model.class_of[ids], np.array([0, 90]))
    wide = attention_lm.Attention({k: v.astype(np.float64) for k, v in model.w.items()}, model.class_of, model.tail)
    g, _ = wide.gradients(seen, hidden, wanted, counts)
    for k in wide.w:
        at = tuple(rng.integers(0, n) for n in wide.w[k].shape) if k != "E" else (int(seen[0, -1]), 3)
        kept = wide.w[k][at]
        losses = []
        for step in (1e-4, -1e-4):
            wide.w[k][at] = kept + step
            losses.append(wide.gradients(seen, hidden, wanted, counts)[1])
        wide.w[k][at] = kept
        assert (losses[0] - losses[1]) / 2e-4 == pytest.approx(g[k][at], rel=0.02, abs=1e-4), k


# Token counts.


def test_rollup_by_brute_force(spark, folder):
    import public_tokenizers
    import tiktoken

    with open(rollups.VOCABULARY, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    encode = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    first, want = {}, defaultdict(lambda: [0, 0])
    for i, t, *_ in sorted(brute.rows(1), key=lambda d: d[0]):
        if t is not None:
            first.setdefault(t, i)
    for i, t, lang, source, _ in brute.rows(1):
        if t is None or first[t] == i:
            other = lang is not None and lang != "en"
            key = (source, lang, "subwords-50k" if other else "spaced-1")
            want[key][0] += 1
            want[key][1] += len(encode(t or "")) if other else len(brute.spaced(t))
    got = {(r.source, r.lang, r.version): [r.docs, r.tokens] for r in rollups.query(spark, folder).collect()}
    assert got == dict(want)


def test_batches_count_once_and_fold(spark, tmp_path):
    rollup = rollups.Rollup(spark, str(tmp_path / "r"))
    delta = lambda rows: spark.createDataFrame(rows, "source string, lang string, version string, sign int, tokens long")
    assert rollup.totals().count() == 0
    assert rollup.commit("1", delta([("a", "en", "v", 1, 5), ("a", "en", "v", 1, 7), (None, None, "v", 1, 2), ("a", "en", "v", None, 9)]))
    assert not rollup.commit("1", delta([("a", "en", "v", 1, 500)]))
    assert rollup.commit("2", delta([("a", "en", "v", -1, 5), ("a", "en", "w", 1, 4), (None, None, "v", -1, 2)]))
    want = [("a", "en", "v", 1, 7), ("a", "en", "w", 1, 4)]
    assert sorted(map(tuple, rollup.totals().collect())) == want
    rollup.compact()
    assert not rollup.commit("2", delta([("a", "en", "v", 1, 1)]))
    assert sorted(map(tuple, rollup.totals().collect())) == want
    assert rollup.commit("3", delta([])) and rollup.committed() == ["1", "2", "3"]
    rollup.compact()
    assert sorted(map(tuple, rollup.totals().collect())) == want


def test_broken_and_racing_batches(spark, tmp_path, monkeypatch):
    """A write that broke off is not read; of two drivers that commit one batch at once the first counts."""
    place = str(tmp_path / "r")
    rollup, other = rollups.Rollup(spark, place), rollups.Rollup(spark, place)
    delta = lambda n: spark.createDataFrame([("a", "en", "v", 1, n)], "source string, lang string, version string, sign int, tokens long")
    delta(3).write.parquet(f"{place}/.draft-x/sums")
    assert rollup.totals().count() == 0 and rollup.commit("1", delta(5))
    monkeypatch.setattr(other, "committed", lambda: [])
    assert not other.commit("1", delta(7))
    assert [r.tokens for r in rollup.totals().collect()] == [5] and not list((tmp_path / "r").glob(".draft-*-*"))


def test_subword_counts(spark):
    got = rollups.subword_counts(frame(spark, [(1, "the end of it", "en", "a", 0), (2, None, "en", "a", 0), (3, "<|endoftext|>", "en", "a", 0)]), ["doc_id"]).collect()
    counts = {r.doc_id: r.tokens for r in got}
    assert counts[1] == 4 and counts[2] == 0 and counts[3] > 1


# Archives.

ROWS = [(1, "http://a", "same"), (2, "http://b", "same"), (3, None, None), (4, "http://c", ""), (5, "http://d", "WARC/1.1\r\n\r\n\r\nä"), (6, "http://e\r\nx: y", "one"), (7, "http://f", "\r\n\r\n")]


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_archives_come_back_whole(spark, tmp_path):
    spark.createDataFrame(ROWS, PAGES).withColumn("digest", F.lit("x")).withColumn("block", F.lit(1)).write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r for r in warc.query(spark, str(tmp_path)).collect()}
    best = {}
    for i, _, html in ROWS:
        best[html or ""] = max(i, best.get(html or "", 0))
    assert len(got) == len(ROWS)
    for i, _, html in ROWS:
        b = best[html or ""]
        assert tuple(got[i])[1:] == (len((html or "").encode()), digest(html), "response" if i == b else "revisit", None if i == b else b)


def test_null_and_repeated_pages(spark, tmp_path):
    rows = [(None, "http://a", "same"), (1, "http://b", "same"), (1, "http://b", "same"), (None, None, "other")]
    spark.createDataFrame(rows, PAGES).write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(((r.page_id, r.record_type, r.refers_to) for r in warc.query(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted([(None, "revisit", 1), (1, "response", None), (1, "response", None), (None, "response", None)], key=str)


def archive(spark):
    """The records as plain WARC."""
    return b"".join(r.record.encode() for r in warc.records(spark.createDataFrame(ROWS, PAGES)).collect())


def written(spark, rows, tmp_path, file_bytes=warc.FILE_BYTES):
    place = str(tmp_path / f"w{len(list(tmp_path.iterdir()))}")
    warc.write(spark.createDataFrame(rows, PAGES).coalesce(1), place, file_bytes)
    return [p.read_bytes() for p in sorted(type(tmp_path)(place).glob("part-*")) if p.stat().st_size]


def test_written_files_are_gzip_members(spark, tmp_path):
    files = written(spark, ROWS, tmp_path, 700)
    assert len(files) > 1 and b"".join(sorted(gzip.decompress(f) for f in files)).count(b"WARC/1.1\r\nWARC-Type") == len(ROWS)
    assert sum(len(cover(f)[0]) for f in files) == len(ROWS) and not any(cover(f)[1] for f in files)


def test_one_damaged_byte_costs_one_record(spark, tmp_path):
    data = b"".join(written(spark, ROWS, tmp_path))
    records = cover(data)[0]
    for r in records[:3]:
        at = (r.start + r.end) // 2
        kept, gaps = cover(data[:at] + bytes([data[at] ^ 0xFF]) + data[at + 1 :])
        assert len(kept) == len(records) - 1 and [(g.start, g.end) for g in gaps] == [(r.start, r.end)]


def test_a_record_over_16_mb():
    """The last byte of its member's length is not zero, so an empty member stands behind it."""
    big = b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: 17000000\r\n\r\n" + b"x" * 17_000_000 + b"\r\n\r\n"
    data = warc.member(big)
    assert data.endswith(warc.NOTHING) and data.endswith(b"\0") and gzip.decompress(data) == big
    kept, gaps = cover(data + warc.member(big[:0] + b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: 1\r\n\r\nx\r\n\r\n"))
    assert [len(r.block) for r in kept] == [17_000_000, 1] and not gaps


def test_reading_takes_time_in_proportion():
    import random
    import time

    rng = random.Random(1)
    body = bytes(rng.randrange(256) for _ in range(5000))
    one = warc.member(b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: 5000\r\n\r\n" + body + b"\r\n\r\n")
    took = []
    for n in (500, 4000):
        best = 9e9
        for _ in range(3):
            began = time.perf_counter()
            assert sum(1 for _ in warc.salvage(one * n)) == n
            best = min(best, time.perf_counter() - began)
        took.append(best)
    assert took[1] < 20 * took[0]


def cover(data):
    found = list(warc.salvage(data))
    at = 0
    for x in found:
        assert x.start == at
        at = x.end
    assert at == len(data)
    return [x for x in found if isinstance(x, warc.Record)], [x for x in found if isinstance(x, warc.Gap)]


def test_salvage_of_damaged_archives(spark):
    data = archive(spark)
    records, gaps = cover(data)
    assert len(records) == len(ROWS) and not gaps
    third = records[2]
    for damaged in (
        data[: third.start] + b"junk" + data[third.start + 4 :],
        data[: third.start] + data[third.start + 7 :],
        data[: third.end - 4] + b"xxxx" + data[third.end :],
        data[: third.start] + b"\x1f\x8b\x08 not gzip \x00" + data[third.end :],
    ):
        kept, gaps = cover(damaged)
        assert len(gaps) == 1 and gaps[0].reason and [r.headers["warc-record-id"] for r in kept] == [r.headers["warc-record-id"] for r in records if r is not third]
    kept, gaps = cover(data[: records[-1].end - 9])
    assert len(kept) == len(records) - 1 and len(gaps) == 1
    changed = next(r for r in records if r.block.endswith(b"one"))
    kept, gaps = cover(data[: changed.end - 7] + b"two" + data[changed.end - 4 :])
    assert gaps[0].reason == "payload digest differs" and len(kept) == len(records) - 1


def test_salvage_of_gzip_members(spark):
    data = archive(spark)
    members = [gzip.compress(data[r.start : r.end]) for r in cover(data)[0]]
    kept, gaps = cover(b"".join(members))
    assert len(kept) == len(members) and not gaps
    members[1] = members[1][:20] + bytes([members[1][20] ^ 0xFF]) + members[1][21:]
    kept, gaps = cover(b"".join(members))
    assert len(kept) == len(members) - 1 and len(gaps) == 1 and gaps[0].end - gaps[0].start == len(members[1])


def test_gaps_are_logged(spark, tmp_path):
    data = archive(spark)
    place = tmp_path / "x"
    place.mkdir()
    (place / "a.warc").write_bytes(b"garbage" + data)
    (place / "empty.warc").write_bytes(b"")
    got = warc.read(spark, str(place)).collect()
    assert [(r.start, r.end) for r in got if r.gap] == [(0, 7)] and sum(not r.gap for r in got) == len(ROWS)


def test_archives_are_their_oracle(spark):
    db = duckdb.connect()
    db.execute(f"create view pages as select * from '{DATA}/pages.parquet'")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(map(tuple, warc.query(spark, DATA).select(*columns).collect())) == sorted(db.execute(warc.ORACLE_SQL).df()[columns].astype(object).where(lambda x: x.notna(), None).itertuples(index=False, name=None))


# Licences.


def base_of(text):
    words = brute.alnum(text)
    places, labels = [], set()
    for phrase, label in licenses.BASE:
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), labels


NOTICES = [
    ("All Rights Reserved. all rights reserved", {"reserved"}),
    ("x CC-BY y cc by", {"cc-by"}),
    ("this file: Licensed under the GNU General Public License, version 3 or later", {"gpl", "gpl-3.0"}),
    ("Licensed under the Apache License, Version 2.0 (the License)", {"apache-2.0"}),
    ("foo bar released under the MIT License. baz", {"mit"}),
    ("we went to the public library under the old general store", set()),
    ("licence to kill, version 2", set()),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the", {"mit"}),
]


def test_licences(spark, folder, tmp_path):
    docs = brute.rows(1) + [(1000 + i, t, "en", "s", 0) for i, (t, _) in enumerate(NOTICES)] + [(2000, "general public license " * 3000, "en", "s", 0)]
    frame(spark, docs, clash=True).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in licenses.query(spark, str(tmp_path)).collect()}
    for i, t, *_ in docs:
        n, base, low, high, labels = base_of(t)
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (n, base, low, high, ",".join(sorted(labels)))
        assert labels <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
    for i, (t, labels) in enumerate(NOTICES):
        assert got[1000 + i].labels == ",".join(sorted(labels)), t


def test_labels_by_brute_force(spark):
    docs = [(i, t) for i, t, *_ in brute.rows(1)] + [(1000 + i, t) for i, (t, _) in enumerate(NOTICES)]
    docs += [(2000 + i, f"x {t} y") for i, (_, t, _) in enumerate(licenses.TEMPLATES)] + [(3000 + i, " ".join(w if k % 4 else "other" for k, w in enumerate(t.split()))) for i, (_, t, _) in enumerate(licenses.TEMPLATES)]
    want = brute.licence_labels(docs, licenses.TEMPLATES, licenses.BASE, licenses.RARE, licenses.WEIGHT, licenses.COVER)
    got = {r.doc_id: r.labels for r in licenses.scan(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    assert got == {i: ",".join(sorted(x)) for i, x in want.items()}


@pytest.mark.parametrize("between", ["", " the old word of " * 4000])
def test_licences_of_several_notices(spark, between):
    """Each notice is found in front of, behind and far from any other."""
    texts = [(a + between + " " + b, la, lb) for (la, a, _), (lb, b, _) in itertools.permutations(licenses.TEMPLATES, 2)]
    docs = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(texts)] + [(1000 + i, t) for i, (_, t, _) in enumerate(licenses.TEMPLATES)], "doc_id long, text string").repartition(4)
    got = {r.doc_id: set(r.labels.split(",")) for r in licenses.scan(docs).collect()}
    assert not [(t[:60], a, b) for i, (t, a, b) in enumerate(texts) if not {a, b} <= got[i]]


def _labels(spark, of: list[str], **by) -> list[set[str]]:
    docs = spark.createDataFrame(list(enumerate(of)), "doc_id long, text string").repartition(3)
    return [set(r.labels.split(",")) for r in licenses.scan(docs, **by).orderBy("doc_id").collect()]


def test_full_licence_texts(spark):
    """Each whole text is found, alone, within other words and beside others; its words alone, or fewer of its passages, are not."""
    texts = [(label, " ".join(licenses.words_of(t))) for label, t, _ in licenses.TEXTS]
    whole = [t for _, t in texts]
    among = ["lorem ipsum " * 5000 + "Copyright (c) 2020 Somebody\n" + t.upper() + "\n" + "dolor sit " * 3000 for t in whole]
    beside = [a + " and " + b for a, b in itertools.permutations(whole, 2)]
    out = _labels(spark, whole + among + beside)
    assert all(label in out[i] and label in out[len(texts) + i] for i, (label, _) in enumerate(texts))
    assert all({a, b} <= out[2 * len(texts) + i] for i, (a, b) in enumerate(itertools.permutations([label for label, _ in texts], 2)))
    assert [sum(label in x for label, _ in texts) for x in out[: len(texts)]] == [1] * len(texts)
    shuffled = [" ".join(sorted(t.split())) for t in whole]
    halves = [" ".join(t.split()[: len(t.split()) // 2]) for t in whole]
    spread = [" filler words of another kind ".join([*(" ".join(t.split()[k : k + 16]) + " other" * len(t.split()) for k in range(0, len(t.split()), 16))]) for t in whole]
    for x in _labels(spark, shuffled + halves + spread):
        assert not x & ({label for label, _ in texts} - {t[0] for t in licenses.TEMPLATES})


def test_full_licence_texts_that_were_changed(spark):
    """Another holder and a few changed words leave the label; without its phrase a text has none."""
    label, text, _ = licenses.TEXTS[1]
    changed = text.replace("the copyright holder nor", "Example Incorporated nor").replace("THE COPYRIGHT HOLDER OR", "THE REGENTS OF THE UNIVERSITY OR")
    lost = text.replace("endorse or promote", "advertise or sell")
    assert changed != text and lost != text
    got = _labels(spark, [changed, lost])
    assert label in got[0] and label not in got[1] and "bsd" in got[1]


def test_a_long_text_of_ones_own(spark):
    """A text of many thousand words as a template, one word in forty changed in the document; its first half alone is none."""
    rng = random.Random(5)
    words = [f"w{rng.randrange(900)}" for _ in range(12000)]
    document = [w if k % 40 else "other" for k, w in enumerate(words)]
    mine = (("mine", " ".join(words), (" ".join(words[1:5]),)),)
    got = _labels(spark, ["x " * 999 + " ".join(document), " ".join(words[:6000]), " ".join(reversed(words)), "", None], texts=mine)
    assert [("mine" in x) for x in got] == [True, False, False, False, False]
    with pytest.raises(ValueError):
        licenses.scan(spark.createDataFrame([(1, "x")], "doc_id long, text string"), texts=(("mine", "a b", ("a c",)),))


# Mixing.


def test_targets():
    assert mixing.targets([]) == [] and mixing.targets([0, 0]) == [0, 0]
    assert mixing.targets([100]) == [150]
    assert mixing.targets([100, 100, 100]) == pytest.approx([200, 500 / 3, 250 / 3])
    sizes = [10, 1000, 3, 0, 500]
    out = mixing.targets(sizes)
    assert sum(out) == pytest.approx(1.5 * sum(sizes)) and all(t <= 2 * s for t, s in zip(out, sizes, strict=True))


def test_mixing(spark, folder):
    docs = brute.rows(1)
    sizes = {i: len(brute.spaced(t)) for i, t, *_ in docs}
    by_source = defaultdict(int)
    for i, _, _, source, _ in docs:
        by_source[source] += sizes[i]
    order = sorted(by_source, key=lambda s: (s is None, [ord(c) for c in s or ""]))
    goal = dict(zip(order, mixing.targets([by_source[s] for s in order]), strict=True))
    first, again = ({r.doc_id: r for r in mixing.query(spark, folder).collect()} for _ in range(2))
    assert first == again and set(first) == set(sizes)
    taken = defaultdict(int)
    for i, _, _, source, _ in docs:
        r = first[i]
        assert (r.size, r.source_size, r.target) == (sizes[i], by_source[source], pytest.approx(goal[source]))
        assert 0 <= r.taken <= 2 * r.size
        taken[source] += r.taken
    assert all(taken[s] == round(goal[s]) for s in goal)


def test_the_mix_holds_what_was_taken(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    taken = {r.doc_id: r.taken for r in mixing.query(spark, folder).collect()}
    out = mixing.mix(docs)
    assert out.columns[: len(docs.columns)] == docs.columns
    words = defaultdict(int)
    for r in out.collect():
        assert len(brute.spaced(r.text)) == r.mix_words and 0 <= r.mix_shard < mixing.SHARDS
        words[r.doc_id] += r.mix_words
    assert words == {i: n for i, n in taken.items() if n}


def test_taken_by_brute_force(spark, folder, monkeypatch):
    """Blocks by Spark's hash of the id, in permuted order; the rest goes word by word through them."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    fold = lambda *v: signed(__import__("functools").reduce(lambda seed, x: xxhash.xxh64_intdigest(x, seed), v, 42))
    long_, int_ = (lambda x: int(x).to_bytes(8, "little", signed=True)), (lambda x: int(x).to_bytes(4, "little", signed=True))
    docs = brute.rows(1)
    sizes = {i: len(brute.spaced(t)) for i, t, *_ in docs}
    by_source = defaultdict(list)
    for i, _, _, source, _ in docs:
        key = fold(int_(mixing.SEED), long_(i))
        block = key % mixing.BLOCKS
        by_source[source].append((fold(int_(mixing.SEED + 1), long_(block)), block, fold(int_(mixing.SEED + 3), long_(key)), i))
    order = sorted(by_source, key=lambda s: (s is None, s or ""))
    goal = mixing.targets([sum(sizes[x[-1]] for x in by_source[s]) for s in order])
    want = {}
    for s, t in zip(order, goal, strict=True):
        total = sum(sizes[x[-1]] for x in by_source[s])
        passes, rest = divmod(round(t), total) if total else (0, 0)
        for *_, i in sorted(by_source[s]):
            want[i] = passes * sizes[i] + min(rest, sizes[i])
            rest -= min(rest, sizes[i])
    assert {r.doc_id: r.taken for r in mixing.query(spark, folder).collect()} == want


def test_a_cut_text_keeps_its_lines(spark):
    text = "  one two\n\nthree\tfour five"
    docs = frame(spark, [(1, text, "en", "a", 0), (2, "x " * 40, "en", "a", 0), (3, None, "en", None, 0)]).withColumn("mix_words", F.lit("mine")).withColumn("kept_text", F.lit(1))
    got = [r for r in mixing.mix(docs).collect() if r.doc_id == 1]
    assert got and all(text.startswith(r.text) and len(brute.spaced(r.text)) == r.mix_words for r in got)


def test_mix_of_repeated_rows_and_no_ids(spark):
    rows = [(None, "a b c", "en", "s", 0), (None, "d e", "en", "s", 0), (1, "f g", "en", "s", 0), (1, "f g", "en", "s", 0), (1, "h i j k", "en", "s", 0)]
    first, again = (sorted(map(str, mixing.deal(frame(spark, rows)).select("doc_id", "size", "taken").collect())) for _ in range(2))
    assert first == again and len(first) == 5


def test_splitting_tree_keeps_quotas():
    out = mixing.split_quotas([1000, 7, 0, 250], 16, 3)
    assert out.sum(axis=0).tolist() == [1000, 7, 0, 250]
    assert out.sum(axis=1).max() - out.sum(axis=1).min() <= 5
    assert (out == mixing.split_quotas([1000, 7, 0, 250], 16, 3)).all()


def test_the_tree_as_a_table(spark):
    """The table holds what the tree on one machine gives; quotas of many sources and shards are exact, and shards are of one size."""
    sources = [None, "b", "a", "é", "z"]
    quotas = {s: n for s, n in zip(sources, [70, 1000, 7, 0, 250], strict=True)}
    order = [s for s in sorted(quotas, key=mixing.by_code_point) if quotas[s]]
    table = spark.createDataFrame(list(quotas.items()), "source string, n long")
    for shards in (1, 2, 3, 16, 37):
        got = {(r.source, r.shard): r.n for r in mixing.shard_quotas(table, shards, 3).collect()}
        # Steps leave out sources without blocks, which changes no draw of the root.
        assert all(sum(n for (s, _), n in got.items() if s == x) == quotas[x] for x in order) and min(got.values()) > 0
        sizes = [sum(n for (_, shard), n in got.items() if shard == k) for k in range(shards)]
        assert max(sizes) - min(sizes) <= 6
        assert got == {(r.source, r.shard): r.n for r in mixing.shard_quotas(table.repartition(5), shards, 3).collect()}
    assert mixing.shard_quotas(table.limit(0), 16, 3).count() == 0
    wide = spark.range(10_000).select(F.col("id").cast("string").alias("source"), (F.col("id") % 40 + 1).alias("n"))
    out = mixing.shard_quotas(wide, 10_000, 1)
    assert out.groupBy("source").agg(F.sum("n").alias("got")).join(wide, "source").filter("got <> n").count() == 0
    ends = out.groupBy("shard").agg(F.sum("n").alias("got")).agg(F.min("got"), F.max("got"), F.count("*")).first()
    assert ends[1] - ends[0] <= 15 and ends[2] == 10_000


def test_a_draw_of_more_blocks_than_numpy_takes(monkeypatch):
    have = np.array([5 * 10**9, 3, 10**9, 0], dtype=np.int64)
    left = mixing.drawn_left(have, 3 * 10**9 + 1, np.random.default_rng(1))
    assert left.sum() == 3 * 10**9 + 1 and (left >= 0).all() and (left <= have).all() and abs(left[2] - 5 * 10**8) < 10**6
    monkeypatch.setattr(mixing, "MOST_DRAWN", 10)
    out = mixing.split_quotas([1000, 7, 0, 250], 16, 3)
    assert out.sum(axis=0).tolist() == [1000, 7, 0, 250] and out.sum(axis=1).max() - out.sum(axis=1).min() <= 5


def test_line_dedup_shuffles_texts_once(spark):
    """Also where the copies found are no small table; null ids find their copies as others do."""
    run = "\n".join(" ".join(f"w{i}x{j}" for j in range(9)) for i in range(4))
    docs = spark.createDataFrame([(1, run), (None, run + "\nz"), (None, run + "\ny"), (3, "a"), (3, run), (3, run), (4, None), (None, None)], "doc_id long, text string")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        for k, v in zip(kept, ("-1", "false"), strict=True):
            spark.conf.set(k, v)
        found = line_dedup.dedup(docs)
        plan = spark._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
        got = sorted(((r.doc_id, r.text, r.lines_deleted) for r in found.collect()), key=repr)
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert sum(part.split(" ", 1)[1].startswith("Exchange") and "packed#" in part for part in plan.split("\n(") if " " in part) == 1
    assert got == sorted([(1, run, 0), (None, "z", 4), (None, "y", 4), (3, "a", 0), (3, "", 4), (3, "", 4), (4, None, 0), (None, None, 0)], key=repr)


def test_line_dedup_is_its_oracle(spark):
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{DATA}/documents.parquet'")
    assert sorted(map(tuple, line_dedup.query(spark, DATA).collect())) == sorted(db.execute(line_dedup.ORACLE_SQL).fetchall())


def test_word_rollups_are_their_oracle(spark, tmp_path):
    db = duckdb.connect()
    frame(spark, brute.rows(4, 150), clash=True).write.parquet(f"{tmp_path}/documents.parquet")
    for folder in (DATA, tmp_path):
        db.execute(f"create or replace view documents as select * from read_parquet('{folder}/documents.parquet{'' if folder == DATA else '/*.parquet'}')")
        got = [tuple(r) for r in rollups.words_query(spark, str(folder)).select("source", "lang", "version", "docs", "tokens").collect()]
        assert got and sorted(got, key=repr) == sorted(db.execute(rollups.WORDS_SQL).fetchall(), key=repr)


@pytest.mark.parametrize("most", [1, 3000, 1 << 24])
def test_neighbours_by_long_ids(spark, monkeypatch, most):
    """Ids of thousands of letters make fewer buckets, one at the least, and the same neighbours."""
    monkeypatch.setattr(fingerprints, "CUT_BYTES", most)
    monkeypatch.setattr(fingerprints, "BUCKET", 4)
    ids = [f"{i:03d}" + "x" * 900 for i in range(60)]
    docs = spark.createDataFrame([(x, f"text of {x[:3]} a b c d e f") for x in ids], "doc_id string, text string").repartition(5)
    assert len(fingerprints._cuts(docs.select("doc_id", "text", F.xxhash64("text").alias("row_key")))) <= max(1, min(15, most // len(ids[0])))
    got = {r.doc_id: r.next_text for r in fingerprints.with_next(docs).collect()}
    assert got == {x: f"text of {ids[i - 1][:3]} a b c d e f" for i, x in enumerate(ids)}


def test_native_plans_hold_no_python(spark):
    for query in (fingerprints.query, line_dedup.query):
        plan = query(spark, DATA)._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_hashes_of_words_by_either_way(monkeypatch):
    words = arrow_text.split_words(pa.array(["Ab cd ä", "", "ab x", "é" * 90 + " zz"], pa.large_string()), arrow_text.SPACED)
    plain = words.hashes()
    monkeypatch.setattr(arrow_text, "POWERS", 3)
    assert (words.hashes() == plain).all() and plain[0] == plain[3] and len(set(plain.tolist())) == len(plain) - 1


def test_long_words_of_one_sum_have_hashes_of_their_own():
    """A Thue-Morse word and its complement are equal as sums of powers modulo 2 ** 64."""
    word = "".join("ab"[i.bit_count() % 2] for i in range(1024))
    words = arrow_text.split_words(pa.array([f"{word} {word.translate({97: 98, 98: 97})} x"], pa.large_string()), arrow_text.SPACED)
    assert len(set(words.hashes().tolist())) == 3


def test_arrow_slices_keep_all_rows():
    column = pa.array(["a" * 300_000, None, "", "b", "c" * 10])
    got = [x for _, part in arrow_text.slices(column) for x in part.to_pylist()]
    assert got == ["a" * 300_000, "", "", "b", "c" * 10]
