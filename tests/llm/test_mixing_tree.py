"""The splitting tree: quotas add up at every node, follow their law, and no copy of a block is in two shards."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.llm import mixing

COUNTS = {"a": 40, "b": 13, None: 7, "empty": 0}


def drawn(spark, shards, seed, counts=COUNTS):
    df = spark.createDataFrame(list(counts.items()), "source string, n long")
    found = defaultdict(dict)
    for r in mixing.quotas(df, shards, seed).collect():
        found[r.shard][r.source] = r.n
    return found


@pytest.mark.parametrize("shards", [1, 2, 3, 5, 8])
def test_quotas_add_up(spark, shards):
    total = sum(COUNTS.values())
    found = drawn(spark, shards, 4)
    assert sorted(found) == list(range(shards))
    for source, n in COUNTS.items():
        assert sum(own[source] for own in found.values()) == n
        assert all(own[source] >= 0 for own in found.values())

    def check(low, high, held):
        """A node's left half has its share of the node's units, and its right half the others."""
        own = sum(sum(found[s].values()) for s in range(low, high))
        assert own == held
        if high - low > 1:
            middle = (low + high) // 2
            left = held * (middle - low) // (high - low)
            check(low, middle, left)
            check(middle, high, held - left)

    check(0, shards, total)
    assert drawn(spark, shards, 4) == found


def test_quotas_follow_the_hypergeometric_law(spark):
    """Mean and variance of every source's number in each half, over many seeds."""
    seeds, total, draws = 600, sum(COUNTS.values()), 30
    held = F.array(*(F.struct(F.lit(s).cast("string").alias("source"), F.lit(n).cast("bigint").alias("n")) for s, n in COUNTS.items()))
    taken = mixing._drawn(held, F.lit(total).cast("bigint"), F.lit(draws).cast("bigint"), F.xxhash64("id"))
    x = np.array([r.taken for r in spark.range(seeds).select(taken.alias("taken")).collect()])
    assert (x.sum(axis=1) == draws).all()
    for i, n in enumerate(COUNTS.values()):
        mean = draws * n / total
        variance = draws * (n / total) * (1 - n / total) * (total - draws) / (total - 1)
        assert abs(x[:, i].mean() - mean) <= 4 * (variance / seeds) ** 0.5 + 1e-9
        assert variance == 0 or abs(x[:, i].var() / variance - 1) < 5 * (2 / seeds) ** 0.5
    # Two sources take from each other.
    covariance = -draws * (40 / total) * (13 / total) * (total - draws) / (total - 1)
    assert abs(np.cov(x[:, 0], x[:, 1])[0, 1] / covariance - 1) < 0.35


def test_units_go_by_quotas_and_once(spark):
    units = spark.range(57).select(
        F.when(F.col("id") % 3 > 0, F.concat(F.lit("s"), F.col("id") % 2)).alias("source"), F.col("id").alias("block"), F.lit(1).alias("copy")
    )
    units = units.unionByName(units.withColumn("copy", F.lit(2)))
    rows = mixing._split(units, 5, 9).collect()
    assert Counter((r.source, r.block, r.copy) for r in rows) == Counter((r.source, r.block, r.copy) for r in units.collect())
    counts = units.groupBy("source").agg(F.count("*").alias("n"))
    want = {(r.source, r.shard): r.n for r in mixing.quotas(counts, 5, 9).collect()}
    got = Counter((r.source, r.shard) for r in rows)
    assert all(got[key] == n for key, n in want.items()) and sum(got.values()) == sum(want.values())
    other = {(r.source, r.block, r.copy): r.shard for r in mixing._split(units, 5, 10).collect()}
    assert sum(other[r.source, r.block, r.copy] != r.shard for r in rows) > 40


def test_blocks_of_a_mix_are_dealt_once(spark):
    docs = spark.range(900).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.array_repeat(F.lit("w"), 5)).alias("text"), (F.col("id") % 4).cast("string").alias("source"))
    rows = mixing.mix(docs, shards=4).collect()
    # All documents of a block, and they alone, go to the same shards.
    blocks = defaultdict(set)
    for r in mixing.plan(docs.select("source", F.lit(5).cast("long").alias("size"), F.xxhash64("doc_id", F.lit(1)).alias("draw")), shards=4).collect():
        blocks[r.source].add((r.block, tuple(r.shards)))
    for source, own in blocks.items():
        assert len({block for block, _ in own}) == len(own)
    shares = Counter(s for r in rows for s in r.shards)
    assert len(shares) == 4 and max(shares.values()) < 1.5 * min(shares.values())
