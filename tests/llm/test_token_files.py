"""The layout of token files: encodings, row groups, page indexes, and what a selective read touches."""

import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from plans import executed, scan_metrics
from test_llm import importable, table  # noqa: F401
from tidegauge.llm import tokens


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tokens") / "t")
    docs = table(spark, "documents", "sf0.01")
    more = docs.crossJoin(spark.range(12).toDF("k")).select((F.col("doc_id") * 12 + F.col("k")).alias("doc_id"), F.concat("text", F.lit(" "), "k").alias("text"))
    tokens.write_tokens(more, path, public_tokenizers.path("word_bpe_49k.json"))
    return path


def files(spark, path):
    return [f.removeprefix("file://") for f in spark.read.parquet(path).inputFiles()]


def test_encodings_and_indexes(spark, written):
    for file in files(spark, written):
        meta = pq.ParquetFile(file).metadata
        for g in range(meta.num_row_groups):
            group = meta.row_group(g)
            assert group.total_byte_size <= 33 << 20
            columns = {group.column(i).path_in_schema: group.column(i) for i in range(group.num_columns)}
            assert any("DICTIONARY" in e for e in columns["ids.list.element"].encodings)
            for plain in ("doc_id", "place"):
                assert not any("DICTIONARY" in e for e in columns[plain].encodings)
            for column in columns.values():
                assert column.has_offset_index and column.compression == "ZSTD"
            assert columns["doc_id"].has_column_index and columns["doc_id"].statistics.has_min_max


def test_files_follow_each_other(spark, written):
    spans = []
    for file in files(spark, written):
        meta = pq.ParquetFile(file).metadata
        ids = [meta.row_group(g).column(0).statistics for g in range(meta.num_row_groups)]
        spans.append((min(s.min for s in ids), max(s.max for s in ids)))
    spans.sort()
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def test_a_lookup_reads_a_page(spark, written):
    table_ = tokens.read_tokens(spark, written)
    total = table_.count()
    wanted = table_.where("doc_id = 4321")
    assert wanted.count() == 1
    # Pages hold at most 1,000 rows, so a lookup by id takes no more than one or two of them.
    assert scan_metrics(wanted.select("doc_id", "ids"))["numOutputRows"] <= 2000 < total
    some = table_.where("doc_id between 100 and 160").select("doc_id", "place")
    assert some.count() == 61 and scan_metrics(some)["numOutputRows"] <= 3000


def test_metadata_is_read_without_ids(spark, written):
    df = tokens.read_tokens(spark, written).select("doc_id", "place")
    assert "ids" not in executed(df).split("ReadSchema: ")[1].split("\n")[0]
    assert df.count() == 12_000
