"""Operator 10: mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every source is cut into permuted blocks by a hash of the document id: BLOCKS of them, or more where a block would
have over BLOCK_DOCS documents of all sources together or where there are more shards. A source's target becomes
a whole number of passes over it and a rest; the rest takes blocks in permuted order, the block at the
edge document by document, and the document at the edge word by word, so the words taken equal the
rounded target. The drawn blocks of all sources are then dealt to the output shards, of about SHARD_WORDS words
each: a tree halves the shards again and again, and at each node one multivariate hypergeometric draw says how
many of each source's blocks go left. Quotas are exact, blocks of different shards are disjoint, and each shard is
ordered by a seeded hash.

The tree is a table of (shards from, to, source, blocks), grown in two steps: one task takes the root down to nodes of
about the square root of all shards, then a task for each of these takes it down to the shards. A task holds a number for each source,
and gives one row for each source and shard with blocks, so never more than there are blocks.

What reaches the driver is one row per source. Documents are dealt by (source, block), never by source alone, so a
hot source is spread over all of its blocks.

Nulls: a null text has size 0; a null source is a source of its own, last in order; documents without an id are
dealt and ordered by a hash of their texts. Repeated rows are documents of their own; of those with one id and
text it doesn't matter which is first. Sources of size 0 have target 0. An empty table gives an empty result. A
very long text is one document: only the one at a source's edge is cut.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirgate.llm.shared import SPACED_WORD, stage

BLOCKS, BLOCK_DOCS = 1024, 1 << 16
SHARDS, SHARD_WORDS = 16, 1 << 27
#: The most blocks a source may have.
FINEST = 1 << 20
#: The most blocks that one draw is made from; numpy refuses 10 ** 9.
MOST_DRAWN = 1 << 29
SEED = 20
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACED_WORD)), F.lit(0)).cast("long")


def targets(sizes: Sequence[int], weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> list[float]:
    """Words per source: share x all sizes dealt by weight, none above most x its size, the excess dealt again."""
    out = [0.0] * len(sizes)
    weight = [float(weights[i % len(weights)]) for i in range(len(sizes))]
    free = {i for i, n in enumerate(sizes) if n > 0}
    left = share * sum(sizes)
    while free:
        total = sum(weight[i] for i in free)
        over = {i for i in free if left * weight[i] / total > most * sizes[i]}
        if not over:
            for i in free:
                out[i] = left * weight[i] / total
            break
        for i in over:
            out[i] = float(most * sizes[i])
            left -= out[i]
        free -= over
    return out


def drawn_left(have: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """How many of each source's blocks are among n drawn of all. Where all are more than MOST_DRAWN, they are cut into strata of fewer, and each gives its share of n."""
    strata = -(-int(have.sum()) // MOST_DRAWN)
    if strata <= 1:
        return rng.multivariate_hypergeometric(have, n, method="marginals")
    out, taken, seen = np.zeros_like(have), 0, 0
    for i in range(strata):
        part = have * (i + 1) // strata - have * i // strata
        seen += int(part.sum())
        upto = n * seen // int(have.sum())
        out += rng.multivariate_hypergeometric(part, upto - taken, method="marginals")
        taken = upto
    return out


def split_node(lo: int, hi: int, have: np.ndarray, width: int, seed: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """The nodes of at most `width` shards below the node of shards lo to hi, with the blocks of each source, by recursive hypergeometric draws."""
    if hi - lo <= width:
        yield lo, hi, have
        return
    mid = (lo + hi) // 2
    left = drawn_left(have, int(have.sum()) * (mid - lo) // (hi - lo), np.random.default_rng([seed, lo, hi]))
    yield from split_node(lo, mid, left, width, seed)
    yield from split_node(mid, hi, have - left, width, seed)


def split_quotas(quotas: Sequence[int], shards: int, seed: int) -> np.ndarray:
    """shards x sources: how many blocks of each source each shard gets."""
    return np.array([have for _, _, have in split_node(0, shards, np.asarray(quotas, dtype=np.int64), 1, seed)])


def _grown(width: int, seed: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    def grown(key, rows):
        rows = rows.assign(at=[by_code_point(s) for s in rows["source"]]).sort_values("at", ignore_index=True)
        parts = []
        for lo, hi, have in split_node(int(key[0]), int(key[1]), rows["n"].to_numpy(), width, seed):
            some = np.flatnonzero(have)
            parts.append(pd.DataFrame({"lo": lo, "hi": hi, "source": rows["source"].to_numpy()[some], "n": have[some]}))
        return pd.concat(parts, ignore_index=True)

    return grown


def shard_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """quotas: source, n. Returns source, shard, n: the blocks of each source that each shard gets, where there are any."""
    tree = quotas.filter("n > 0").select(F.lit(0).alias("lo"), F.lit(shards).alias("hi"), "source", F.col("n").cast("long").alias("n"))
    for width in (1 << (shards.bit_length() // 2), 1):
        tree = tree.groupBy("lo", "hi").applyInPandas(_grown(width, seed), "lo int, hi int, source string, n long")
    return tree.select("source", F.col("lo").alias("shard"), "n")


PLAN = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("source_size", T.LongType()),
        T.StructField("target", T.DoubleType()),
        T.StructField("passes", T.LongType()),
        T.StructField("rest", T.LongType()),
    ]
)


def by_code_point(source: str | None) -> tuple[bool, str]:
    return source is None, source or ""


def deal(docs: DataFrame, keep: Sequence[str] = (), shards: int | None = None, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, draws (copy, words, shard), and `keep`. Without a number of shards it comes from the size."""
    spark = docs.sparkSession
    kept = [F.col(f"`{c}`").alias(f"kept_{c}") for c in keep]
    text_key = F.xxhash64("text")
    key = F.xxhash64(F.lit(seed), F.col("doc_id"), F.when(F.col("doc_id").isNull(), text_key))
    sized = docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), key.alias("key"), text_key.alias("text_key"), *kept)
    # Sums by the finest blocks there may be; blocks are these, taken together.
    fine = stage(sized.groupBy("source", F.pmod("key", F.lit(FINEST)).alias("fine")).agg(F.sum("size").alias("block_size"), F.count("*").alias("docs")), "mix-fine")
    whole = fine.agg(F.sum("docs").alias("docs"), F.sum("block_size").alias("words")).first()
    shards = shards or max(SHARDS, -(-int((whole["words"] or 0) * SHARE) // SHARD_WORDS))
    wanted = max(BLOCKS, 4 * shards, -(-(whole["docs"] or 0) // BLOCK_DOCS))
    blocks_of = min(FINEST, 1 << (wanted - 1).bit_length())
    sized = sized.withColumn("block", F.pmod("key", F.lit(blocks_of)))
    counted = fine.groupBy("source", F.pmod("fine", F.lit(blocks_of)).alias("block")).agg(F.sum("block_size").alias("block_size"))

    totals = sorted(counted.groupBy("source").agg(F.sum("block_size").alias("n")).collect(), key=lambda r: by_code_point(r[0]))
    goal = targets([r["n"] for r in totals])
    plan = []
    for r, t in zip(totals, goal, strict=True):
        passes, rest = divmod(round(t), r["n"]) if r["n"] else (0, 0)
        plan.append((r["source"], r["n"], t, passes, rest))
    plans = spark.createDataFrame(plan, PLAN)

    # Blocks in permuted order; FINEST rows a source at most.
    mixed = F.xxhash64(F.lit(seed + 1), F.col("block"))
    upto = Window.partitionBy("source").orderBy(mixed, "block").rowsBetween(Window.unboundedPreceding, 0)
    blocks = (
        counted.join(plans.withColumnRenamed("source", "plan_source"), F.col("source").eqNullSafe(F.col("plan_source")))
        .withColumn("before", F.sum("block_size").over(upto) - F.col("block_size"))
        .withColumn("block_rest", F.greatest(F.lit(0), F.least(F.col("block_size"), F.col("rest") - F.col("before"))).cast("long"))
        .withColumn("units", F.when(F.col("block_size") == 0, 0).otherwise(F.col("passes") + (F.col("block_rest") > 0).cast("long")))
        .drop("plan_source", "before", "rest")
    )
    blocks = stage(blocks, "mix-plan")

    places = stage(shard_quotas(blocks.groupBy("source").agg(F.sum("units").alias("n")), shards, seed), "mix-tree")
    before = F.sum("n").over(Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    places = places.withColumn("low", before).select(F.col("source").alias("shard_source"), "shard", F.explode(F.sequence(F.col("low") + 1, F.col("low") + F.col("n"))).alias("at"))
    drawn = Window.partitionBy("source").orderBy(F.xxhash64(F.lit(seed + 2), F.col("unit"), F.col("block")), "unit", "block")
    unit_shards = (
        blocks.filter("units > 0")
        .select("source", "block", F.explode(F.sequence(F.lit(1), F.col("units"))).alias("unit"))
        .withColumn("place", F.row_number().over(drawn))
        .join(places, F.col("source").eqNullSafe(F.col("shard_source")) & (F.col("place") == F.col("at")))
        .groupBy("source", "block")
        .agg(F.map_from_entries(F.collect_list(F.struct("unit", "shard"))).alias("shard_of"))
    )
    blocks = blocks.join(unit_shards.select(F.col("source").alias("s"), F.col("block").alias("b"), "shard_of"), F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")), "left").drop("s", "b")
    blocks = blocks.select(F.col("source").alias("s"), F.col("block").alias("b"), "source_size", "target", "passes", "block_rest", "shard_of")

    inner = Window.partitionBy("source", "block").orderBy(F.xxhash64(F.lit(seed + 3), F.col("key")), "doc_id", "text_key").rowsBetween(Window.unboundedPreceding, 0)
    rest = F.greatest(F.lit(0), F.least(F.col("size"), F.col("block_rest") - F.col("before"))).cast("long")
    whole = F.transform(F.sequence(F.lit(1), F.col("passes")), lambda u: F.struct(u.alias("copy"), F.col("size").alias("words"), F.col("shard_of")[u].alias("shard")))
    part = F.struct((F.col("passes") + 1).alias("copy"), F.col("rest").alias("words"), F.col("shard_of")[F.col("passes") + 1].alias("shard"))
    empty = F.array().cast("array<struct<copy:bigint,words:bigint,shard:int>>")
    return (
        sized.join(blocks, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
        .withColumn("before", F.sum("size").over(inner) - F.col("size"))
        .withColumn("rest", rest)
        .withColumn("taken", F.col("passes") * F.col("size") + F.col("rest"))
        .withColumn(
            "draws",
            F.concat(
                F.when((F.col("passes") > 0) & (F.col("size") > 0), whole).otherwise(empty),
                F.when(F.col("rest") > 0, F.array(part)).otherwise(empty),
            ),
        )
        .select("doc_id", "key", "size", "source_size", "target", "taken", "draws", *[F.col(f"`kept_{c}`") for c in keep])
    )


def mix(docs: DataFrame, shards: int | None = None, seed: int = SEED) -> DataFrame:
    """The mix itself: a row per copy drawn, with docs' columns, mix_copy, mix_words, mix_shard and mix_order; columns of docs that have these names give way to them.

    A copy that only a part of is taken, at most one a source, has its text up to its mix_words-th word, as it stands in the text.
    """
    names = [c for c in docs.columns if c not in ("mix_copy", "mix_words", "mix_shard", "mix_order")]
    dealt = deal(docs, names, shards, seed).select(F.explode("draws").alias("the_draw"), F.col("key").alias("the_key"), F.col("size").alias("the_size"), F.struct(*[F.col(f"`kept_{c}`").alias(c) for c in names]).alias("packed"))
    whole, n = F.col("packed.text"), F.col("the_draw.words").cast("int")
    first = lambda array: F.slice(array, F.lit(1), n)
    cut = F.array_join(F.zip_with(first(F.split(whole, SPACED_WORD)), first(F.regexp_extract_all(whole, F.lit(SPACED_WORD), F.lit(0))), lambda gap, word: F.concat(gap, word)), "")
    text = F.when(F.col("the_draw.words") < F.col("the_size"), cut).otherwise(whole)
    return dealt.select(
        *[text.alias(c) if c == "text" else F.col("packed").getField(c).alias(c) for c in names],
        F.col("the_draw.copy").alias("mix_copy"),
        F.col("the_draw.words").alias("mix_words"),
        F.col("the_draw.shard").alias("mix_shard"),
        F.xxhash64(F.lit(seed + 4), F.col("the_draw.shard"), F.col("the_draw.copy"), F.col("the_key")).alias("mix_order"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return deal(docs).select("doc_id", "size", "source_size", "target", "taken", F.transform("draws", lambda d: d["shard"]).alias("shards"))
