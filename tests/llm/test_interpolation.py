"""Scores of deleted interpolation against counting by hand."""

from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidegauge.llm import common, interpolation
from test_llm import importable, words  # noqa: F401


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_by_hand(spark, monkeypatch, order):
    """Each probability from plain counters and the learned weights; those of all words after a context add up to one."""
    rng = np.random.default_rng(order)
    rows = [(i, " ".join(rng.choice(list("aabcdeF"), rng.integers(0, 12)))) for i in range(120)] + [(200, None), (None, "a b"), (5, "a c a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    learned = []
    fit = interpolation.fit_weights
    monkeypatch.setattr(interpolation, "fit_weights", lambda *a: learned.append(fit(*a)) or learned[-1])
    monkeypatch.setattr(interpolation, "BLOCK_BYTES", 200)
    monkeypatch.setattr(interpolation, "RANGE_TOKENS", 50)
    got = interpolation.score(docs, common.outside_fold(1), common.in_fold(2, folds=7), order).collect()
    assert len(learned) == order and len(got) == len(rows)

    def tokens(text):
        return ["<"] * (order - 1) + [*words(text), ">"]

    known = {r.doc_id for r in docs.where(common.outside_fold(1)).collect()}
    texts = [tokens(t) for d, t in rows if d in known and d is not None]
    followed, context = Counter(), Counter()
    for text in texts:
        for i in range(order - 1, len(text)):
            for size in range(1, order + 1):
                followed[tuple(text[i - size + 1 : i + 1])] += 1
                context[tuple(text[i - size + 1 : i])] += 1
    vocabulary = {gram[0] for gram in followed if len(gram) == 1}
    after = defaultdict(int)
    for gram, n in followed.items():
        after[gram[:-1]] += n
    assert after == context

    def probability(history, word):
        p = 1 / (len(vocabulary) + 1)
        for size in range(1, order + 1):
            before = tuple(history[len(history) - size + 1 :]) if size > 1 else ()
            n = context[before]
            weights = learned[size - 1]
            a = weights[min(n.bit_length(), len(weights) - 1)]
            p = a * (followed[*before, word] / n if n else 0) + (1 - a) * p
        return p

    for text in texts[:20]:
        for i in range(order - 1, len(text)):
            # The unknown word has the share that is left.
            total = sum(probability(text[:i], w) for w in [*vocabulary, "unknown"])
            assert total == pytest.approx(1, abs=1e-9)
    want = sorted((d is None, d or 0, round(sum(np.log10(probability(s[:i], s[i])) for i in range(order - 1, len(s))), 8)) for d, s in ((d, tokens(t)) for d, t in rows))
    assert sorted((r.doc_id is None, r.doc_id or 0, round(r.score, 8)) for r in got) == want


def test_packed_numbers():
    rng = np.random.default_rng(0)
    for most in (1, 255, 256, 70_000, 1 << 33):
        values = rng.integers(0, most, 100, endpoint=True)
        data = interpolation.packed(values)
        assert interpolation.unpacked(data, 100).tolist() == values.tolist()
        assert len(data) == 100 * next(w for w in (1, 2, 4, 8) if values.max() < 1 << 8 * w)
    assert len(interpolation.unpacked(b"", 0)) == 0


def test_a_row_group_holds_one_block(spark):
    """Also where texts compress to next to nothing, as writers and readers hold a whole row group."""
    text = F.repeat(F.concat(F.lit("some words of "), F.col("id").cast("string"), F.lit("\t")), 100_000)
    docs = spark.range(30, numPartitions=1).select("id", text.alias("text"), F.lit(interpolation.COUNTED).alias("role"))
    blocks = interpolation._pack(docs)
    groups = [file.metadata.row_group(i) for file in map(pq.ParquetFile, blocks.inputFiles()) for i in range(file.metadata.num_row_groups)]
    assert len(groups) == blocks.count() >= 10
    assert max(g.total_byte_size for g in groups) <= 1.1 * interpolation.BLOCK_BYTES
    assert blocks.agg(F.sum("learned")).first()[0] == 30 * (4 * 100_000 + 1)
