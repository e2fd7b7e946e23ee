"""Operators 11 to 13 against brute force: awkward tables, ties, repeated rows, hot groups, long texts and empty tables."""

import itertools
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from weirgate.llm import hard_negatives, jaccard, lexical, near_copies, ranking


def frame(spark, rows, clash=True):
    df = spark.createDataFrame(rows, brute.SCHEMA)
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(brute.CLASHING)]) if clash else df


def shingles(text, k):
    words = brute.spaced(brute.lower(text))
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def linked(docs, k=4, least=85):
    """n_shingles and component of each row; rows are told apart by their place."""
    sets = [shingles(t, k) for _, t, *_ in docs]
    pairs = [(a, b) for a, b in itertools.combinations(range(len(docs)), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])]
    roots = brute.roots(range(len(docs)), pairs)
    ids = defaultdict(list)
    for i, r in roots.items():
        ids[r].append(docs[i][0])
    first = {r: min((x for x in found if x is not None), default=None) for r, found in ids.items()}
    return Counter((docs[i][0], len(sets[i]), first[roots[i]]) for i in range(len(docs)))


def found(df):
    return Counter((r.doc_id, r.n_shingles, r.component_id) for r in df.collect())


@pytest.fixture
def folder(spark, tmp_path):
    def written(docs, items=()):
        frame(spark, docs).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
        table = spark.createDataFrame(list(items), "item_id long, text string")
        table.select("*", F.lit(1).alias("score"), F.lit("x").alias("doc_id")).write.parquet(f"{tmp_path}/benchmark.parquet")
        return str(tmp_path)

    return written


# Operator 11.


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_join(spark, folder, seed):
    docs = brute.rows(seed, 80)
    docs += docs[:9] + [(None, docs[20][1], None, None, None), (None, "words of no id", None, None, None), (None, None, None, None, None)]
    assert found(jaccard.query(spark, folder(docs))) == linked(docs)


def test_jaccard_join_of_nothing(spark, folder):
    assert jaccard.query(spark, folder([])).count() == 0


def varied(rng, base, changes):
    words = base.split()
    for at in rng.sample(range(len(words)), changes):
        words[at] = f"x{rng.randrange(999)}"
    return " ".join(words)


@pytest.mark.parametrize("cell", [3, 2048])
def test_jaccard_join_of_hot_groups(spark, folder, monkeypatch, cell):
    """Near copies of two texts, from those that link to those that just don't, in tiles cut into cells; one passage in all documents; sizes on both sides of a band's edge."""
    monkeypatch.setattr(jaccard, "CELL", cell)
    rng = random.Random(cell)
    word = lambda: f"w{rng.randrange(5000)}"
    passage = " ".join(word() for _ in range(30))
    bases = [" ".join(word() for _ in range(n)) for n in (66, 130)]
    texts = [f"{varied(rng, rng.choice(bases), rng.randint(0, 6))} {passage}" for _ in range(50)]
    texts += [f"{' '.join(word() for _ in range(40))} {passage}" for _ in range(20)]
    texts += [" ".join(bases[0].split()[:n]) for n in (58, 60, 62, 64, 66)] + [bases[0]] * 7
    docs = [(i * 7 % 101 + 101 * (i // 101), t, "en", "s", len(t)) for i, t in enumerate(texts)]
    got = found(jaccard.query(spark, folder(docs)))
    assert got == linked(docs) and 5 < len({c for _, _, c in got}) < len(docs)


def test_hot_tiles_give_a_forest_of_links(spark, monkeypatch):
    """Groups of texts that all link, in tiles that neither star has joined: fewer pairs than nodes leave each cell, and nothing is lost."""
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(9000)}"
    base = " ".join(word() for _ in range(200))
    docs = [(i, varied(rng, base, n), "en", "s", 1) for i, n in enumerate([1] * 30 + [12] * 30)]
    sets = jaccard.Rule().sets(pa.array([t for _, t, *_ in docs], pa.large_string()))
    held = [jaccard.node_of(h) for h in sets]
    rows = [pa.array([1] * 60), pa.array([0] * 60), pa.array([0] * 60), pa.array([False] * 60), pa.array(held), pa.array(held), pa.array([h.tobytes() for h in sets], pa.binary()), pa.array([len(h) for h in sets])]
    batch = pa.RecordBatch.from_arrays(rows, names=["tile", "i", "j", "visits", "node", "label", "set", "size"])
    got = sum(b.num_rows for b in jaccard._tile_pairs(iter([batch]), jaccard.Rule()))
    assert got == 60 - len({c for *_, c in linked(docs)})
    for cell, most in ((5, 64 << 20), (2048, 30_000)):
        for name, n in (("HOT", 3), ("CELL", cell), ("CELL_BYTES", most)):
            monkeypatch.setattr(jaccard, name, n)
        assert found(jaccard.near_duplicates(frame(spark, docs)).withColumnRenamed("size", "n_shingles")) == linked(docs)


@pytest.mark.parametrize("cell", [3, 2048])
def test_jaccard_join_of_hot_tiles_beside_small_ones(spark, folder, monkeypatch, cell):
    monkeypatch.setattr(jaccard, "HOT", 6)
    test_jaccard_join_of_hot_groups(spark, folder, monkeypatch, cell)


def test_jaccard_links_that_no_first_star_finds(spark, folder):
    """Texts that share tiles with one that links to none of them: without a link among the first pairs the rest is still compared."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(9000)}"
    base = " ".join(word() for _ in range(90))
    docs = [(i, varied(rng, base, n), "en", "s", 1) for i, n in enumerate([9, 9, 8, 7, 1, 1, 0])]
    for stars in (1, 2):
        signed, roots = jaccard.link(frame(spark, docs), jaccard.Rule(), stars)
        components = signed.join(roots, "node", "left").select("doc_id", F.coalesce("root", "node").alias("c")).collect()
        want = {frozenset(d for d, _, c in linked(docs) if c == k) for k in {c for *_, c in linked(docs)}}
        assert {frozenset(r.doc_id for r in components if r.c == k) for k in {r.c for r in components}} == want


def test_bounds_of_bitmaps_hold(spark):
    rng = np.random.default_rng(3)
    for n, m in ((3, 3), (70, 66), (400, 380), (5000, 4800)):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: m - n // 9], rng.integers(0, 1 << 63, n // 9, dtype=np.uint64)]))
        maps = [jaccard.bitmap_of(x) for x in (a, b)]
        for width in (64, 8 * min(map(len, maps))):
            x, y = (jaccard._folded([m], width) for m in maps)
            assert jaccard._most_overlap(x, y, np.array([len(a)]), np.array([len(b)]))[0] >= len(np.intersect1d(a, b))


def test_near_copies_hold_for_long_texts_and_repeats(spark):
    """A text over 2 MB with a copy that differs in a word, repeated rows, and one id with two texts."""
    rng = random.Random(8)
    long = " ".join(f"w{rng.randrange(10**9)}" for _ in range(240_000))
    assert len(long) > 2 << 20
    docs = [(1, long, "en", "s", 1), (2, long.replace(" ", " new ", 1), "en", "s", 1), (3, "a b c d e f", "en", "s", 1), (3, "a b c d e f", "en", "s", 1), (3, "g h i j k l", "en", "s", 1), (4, "", None, None, None), (5, None, None, None, None)]
    kept = near_copies.keep_one(frame(spark, docs)).collect()
    assert sorted((r.doc_id, (r.text or "")[:3]) for r in kept) == [(1, long[:3]), (3, "a b"), (3, "g h"), (4, "")]
    assert found(jaccard.near_duplicates(frame(spark, docs)).withColumnRenamed("size", "n_shingles")) == linked(docs)


# Operator 12.

VECTORS = "vec_id long, embedding array<float>, label int"


def test_near_copies_come_through_fingerprints_first(spark, monkeypatch):
    """Texts whose fingerprints operator 4 links are the first pairs that are decided; those that are not similar enough still part."""
    rng = random.Random(3)
    base = " ".join(f"w{rng.randrange(9000)}" for _ in range(3000))
    alike = [base, varied(rng, base, 1), varied(rng, base, 2), varied(rng, base, 60)]
    other = [" ".join(f"v{rng.randrange(9000)}" for _ in range(50)) for _ in range(3)]
    docs = [(i, t, "en", "s", 1) for i, t in enumerate([*alike, *other, base.upper()])]
    decided, plain = [], jaccard._Links.decide

    def decide(self, pairs):
        decided.append({(r.a, r.b) for r in pairs.collect()})
        return plain(self, pairs)

    monkeypatch.setattr(jaccard._Links, "decide", decide)
    kept = near_copies.keep_one(frame(spark, docs)).collect()
    rule = jaccard.Rule(5, 80)
    nodes = [jaccard.node_of(h) for h in rule.sets(pa.array([brute.lower(t) for _, t, *_ in docs], pa.large_string()))]
    marks = [brute.simhash(t) for _, t, *_ in docs]
    close = {tuple(sorted((nodes[i], nodes[j]))) for i in range(len(docs)) for j in range(i) if (marks[i] ^ marks[j]).bit_count() <= 4 and nodes[i] != nodes[j]}
    assert close and decided[0] and decided[0] <= close and {n for p in decided[0] for n in p} == {n for p in close for n in p}
    assert sorted(r.doc_id for r in kept) == [0, 4, 5, 6]


def mined(rows, step=50, k=5, most=3):
    """Rows of (id, label, vector), each once."""
    kept = []
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if i is not None and i % 7 == 0 else label
        row = (i, label, tuple(math.floor(256 * float(np.float32(x))) for x in v))
        if row not in kept:
            kept.append(row)
    out = Counter()
    for a in kept:
        if a[0] is None or a[0] % step:
            continue
        ranked = sorted(((-sum(x * y for x, y in zip(a[2], b[2], strict=False)), b[0] is None, b[0] or 0, b) for b in kept if b is not a), key=lambda x: x[:3])
        same = [(b, -s) for s, _, _, b in ranked if b[1] == a[1]][:k]
        for p, score in same:
            fits = [(b, -s) for s, _, _, b in ranked if b[1] != a[1] and 50 * score <= -100 * s <= 95 * score][:most]
            for rank, (b, s) in enumerate(fits, 1):
                out[a[0], p[0], rank, b[0], score, s] += 1
    return out


def vectors(seed, n, width=6):
    rng = random.Random(seed)
    return [(i * 10, [rng.choice([0.0, 0.25, 0.5, -0.25, rng.gauss(0.3, 0.3)]) for _ in range(width)], rng.randrange(3)) for i in range(n)]


def hard(spark, tmp_path, rows):
    table = spark.createDataFrame(rows, VECTORS).select("*", *[F.lit(i).alias(c) for i, c in enumerate(("block", "cells", "rank", "score", "at", "anchor_id", "positives"))])
    table.repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    return Counter(tuple(r) for r in hard_negatives.query(spark, str(tmp_path)).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.mark.parametrize("blocks", [(1 << 16, 1 << 21, 1 << 17), (16, 64, 64)])
def test_hard_negatives(spark, tmp_path, monkeypatch, blocks):
    """Many equal scores; blocks of all rows, and of a few."""
    for name, value in zip(("ANCHOR_CELLS", "MOST_CELLS", "LEAST_CELLS"), blocks, strict=True):
        monkeypatch.setattr(hard_negatives, name, value)
    rows = vectors(4, 90)
    assert (got := hard(spark, tmp_path, rows)) == mined(rows) and len(got) > 60


def test_hard_negatives_of_awkward_rows(spark, tmp_path):
    rows = vectors(6, 40) + [(50, None, 1), (100, [0.5] * 6, None), (150, [0.5, None, 0.1, 0.0, 0.0, 0.0], 1), (200, [float("nan")] * 6, 1), (250, [float("inf")] * 6, 1), (300, [], 1), (350, [0.5, 0.5], 2), (None, [0.5] * 6, 1), (None, [0.4] * 6, 2)]
    rows += rows[:5] * 2 + [(0, [0.3] * 6, 2), (-50, [0.2] * 7, 1)]
    assert (got := hard(spark, tmp_path, rows)) == mined(rows) and len(got) > 20


def test_hard_negatives_of_nothing(spark, tmp_path):
    assert not hard(spark, tmp_path, [])


def test_scores_are_exact_beyond_doubles():
    a, b = np.array([[1 << 31, 3], [-(1 << 31), 5]]), np.array([[1 << 31, 7], [(1 << 31) - 1, -9]])
    assert hard_negatives.scores_of(a, b).tolist() == [[sum(int(x) * int(y) for x, y in zip(r, s, strict=True)) for s in b] for r in a]
    for scores in (np.array([[5, 9, 5, 9, -3]]), np.array([[1 << 61, -(1 << 61), 1 << 61, 0]])):
        want = [sorted(range(scores.shape[1]), key=lambda j: (-int(scores[0, j]), j))]
        assert hard_negatives.full_order(scores).tolist() == want


# Operator 13.


def ranked(docs, items, k=50, repeats=False):
    terms = [brute.alnum(t) for _, t, *_ in docs]
    n, total = sum(1 for t in terms if t), sum(map(len, terms))
    counts = [Counter(t) for t in terms]
    df = Counter(t for c in counts for t in c)
    wanted = defaultdict(Counter)
    for item, text in items:
        wanted[item].update(brute.alnum(text))
    out = Counter()
    for item, own in wanted.items():
        scores = []
        for (i, *_), t, c in zip(docs, terms, counts, strict=True):
            score = 0
            for term, times in own.items():
                if tf := c.get(term, 0):
                    w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[term] + 1)))
                    score += (times if repeats else 1) * w * (1_000_000_000 * tf // (1000 * tf + 20 * (100 - 50 + 50 * len(t) * n // total)))
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        for rank, (s, _, _, i) in enumerate(sorted(scores, key=lambda x: x[:3])[:k], 1):
            out[item, rank, i, -s] += 1
    return out


def searched(df):
    return Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect())


@pytest.mark.parametrize("small", [False, True])
def test_lexical_search(spark, folder, monkeypatch, small):
    """With small limits: a block of documents for each slice, and one item a block."""
    if small:
        monkeypatch.setattr(lexical, "ITEM_BYTES", 64)
        monkeypatch.setattr(lexical, "TOP", 3)
    docs = brute.rows(3, 90)
    docs += docs[:30] * 3 + [(None, docs[20][1], None, None, None)]
    texts = [t for _, t, *_ in docs if t and len(brute.alnum(t)) > 20]
    items = [(i, " ".join(brute.alnum(texts[i])[2:9])) for i in range(5)] + [(1, texts[6][:80]), (7, None), (8, "!!"), (None, texts[1][:60].upper()), (9, "thesewordsare nowhere"), (1, "one one ONE")]
    got = searched(lexical.search(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"), 3 if small else 50))
    assert got == ranked(docs, items, 3 if small else 50) and len(got) > 15
    if not small:
        assert got == searched(lexical.query(spark, folder(docs, items)))


def test_lexical_search_counts_repeats(spark):
    docs, items = brute.rows(5, 40), [(1, "one one one an"), (2, brute.rows(5, 40)[10][1])]
    got = searched(lexical.search(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"), 5, repeats=True))
    assert got == ranked(docs, items, 5, repeats=True)


def test_lexical_search_of_nothing(spark, folder):
    assert lexical.query(spark, folder([], [(1, "a b")])).count() == 0
    assert lexical.search(frame(spark, brute.rows(1)), spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_lexical_search_in_long_texts_and_text_ids(spark):
    long = " ".join(f"w{i % 50_000}" for i in range(400_000))
    assert len(long) > 2 << 20
    docs = [("b", "w1 w2 w3"), ("a", long), ("c", "w49999 W1"), ("d", "")]
    df = spark.createDataFrame(docs, "doc_id string, text string")
    got = lexical.search(df, spark.createDataFrame([("q", "w1 w49999 other")], "item_id string, text string")).collect()
    want = [(r, i, s) for (_, r, i, s) in sorted(ranked_by_text(docs, [("q", "w1 w49999 other")]))]
    assert sorted((r["rank"], r.doc_id, r.score) for r in got) == want


def ranked_by_text(docs, items):
    """ranked(), for ids that are texts."""
    order = {i: k for k, i in enumerate(sorted(i for i, _ in docs))}
    names = {k: i for i, k in order.items()}
    return [(item, rank, names[i], s) for item, rank, i, s in ranked([(order[i], t) for i, t in docs], items)]


def test_products_by_rows_merged():
    rng = np.random.default_rng(1)
    items, terms, docs = rng.integers(0, 3, (5, 9)), rng.integers(-4, 5, (9, 7)), 7
    first = np.concatenate([[0], np.cumsum((items > 0).sum(axis=1))])
    row, term = np.nonzero(items)
    at, doc = np.nonzero(terms)
    got = lexical.product(first, term, items[row, term], np.searchsorted(at, np.arange(10)), doc, terms[at, doc], docs)
    assert (got == items @ terms).all()


def test_first_rows_of_each_group(spark):
    rng = random.Random(2)
    rows = [(rng.choice("aab"), rng.randrange(9), i) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, s long, i long")
    got = sorted((r.g, r["rank"], r.s, r.i) for r in ranking.first_k(df, ["g"], [F.desc("s"), F.asc("i")], 7, F.col("i")).collect())
    want = [(g, k, s, i) for g in "ab" for k, (_, s, i) in enumerate(sorted((-s, s, i) for x, s, i in rows if x == g)[:7], 1)]
    assert got == sorted(want)
