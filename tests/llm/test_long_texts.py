"""Texts of any length are measured alike."""

import random

import pytest
from pyspark.sql import functions as F

from test_llm import importable, odd, table  # noqa: F401
from tidegauge.llm import host_rules

NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@pytest.mark.parametrize("piece", [1, 7, 1 << 16])
def test_by_rows_or_by_arrays(spark, odd, monkeypatch, piece):
    draw = random.Random(4)
    pool = ["a", "b", "été", "日本", "#x", "&", "  ", "\n", "\n", "\t", "\x0b", "long" * 9, "\x85", "$"]
    rows = [(100 + i, "".join(draw.choice(pool) + draw.choice(["", " "]) for _ in range(draw.randint(0, 80))), "s") for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").unionByName(odd.select("doc_id", "text", "source"))
    arrays = sorted(map(str, host_rules.judge(docs, F.col("source")).select("doc_id", "source", *NAMES).collect()))
    monkeypatch.setattr(host_rules, "LONG_BYTES", 5)
    monkeypatch.setattr(host_rules, "PIECE_CHARACTERS", piece)
    assert sorted(map(str, host_rules.judge(docs, F.col("source")).select("doc_id", "source", *NAMES).collect())) == arrays
