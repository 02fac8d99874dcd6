"""Benchmark decontamination over a positional inverted index.

The index holds, per block of documents and term, the ascending positions of
the term's occurrences. A phrase is found from its rarest term: that term's
postings, moved back by its offset in the phrase, are the candidate starts;
each further term, in order of rising frequency, keeps those starts at which
it occurs too. Blocks are searched apart from each other, on the executors.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import carried, hash_rows, separator_table, small_batches, staged, utf8_rows

# Words are runs of digits, a-z and whatever lies beyond ASCII.
WORD_TABLE = separator_table(bytes(b for b in range(128) if not chr(b).isalnum()), lower=True)
# Text per block. Larger blocks hold fewer postings lists, smaller ones need less memory.
BLOCK_BYTES = 8 << 20

INDEX_SCHEMA = "block long, term long, n int, positions array<int>, doc_ids array<long>, sizes array<int>"
_ARROW_SCHEMA = pa.schema(
    [
        ("block", pa.int64()),
        ("term", pa.int64()),
        ("n", pa.int32()),
        ("positions", pa.list_(pa.int32())),
        ("doc_ids", pa.list_(pa.int64())),
        ("sizes", pa.list_(pa.int32())),
    ]
)


def _index_block(block: int, ids: list, rows: list[bytes]) -> Iterator[pa.RecordBatch]:
    """One row that lists the documents, then one per term. A gap of one position parts documents."""
    terms, begins = hash_rows(rows)
    sizes = np.diff(begins)
    positions = (np.arange(len(terms)) + np.repeat(np.arange(len(rows)), sizes)).astype(np.int32)
    none = [None]
    yield pa.RecordBatch.from_arrays(
        [pa.array([block]), pa.array(none, pa.int64()), pa.array(none, pa.int32()), pa.array(none, pa.list_(pa.int32())),
         pa.array([ids], pa.list_(pa.int64())), pa.array([sizes.astype(np.int32)], pa.list_(pa.int32()))],
        schema=_ARROW_SCHEMA,
    )
    if not len(terms):
        return
    order = np.argsort(terms, kind="stable")
    ordered = terms[order].view(np.int64)
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    offsets = np.append(first, len(ordered)).astype(np.int32)
    n = len(first)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, block)), pa.array(ordered[first]), pa.array(np.diff(offsets)),
         pa.ListArray.from_arrays(pa.array(offsets), pa.array(positions[order])),
         pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int32()))],
        schema=_ARROW_SCHEMA,
    )


def build_index(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The positional index of whole texts, as a written table.

    NULL texts have no words. Documents keep their row even then, so that the
    index also says how many words each has. Repeated ids stay apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        ids, rows, size = [], [], 0
        for batch in small_batches(batches, 1):
            for own, row in zip(batch.column(0).to_pylist(), utf8_rows(batch.column(1))):
                if rows and size + len(row) > BLOCK_BYTES:
                    yield from _index_block(block, ids, rows)
                    block, ids, rows, size = block + 1, [], [], 0
                ids.append(own)
                rows.append(row.translate(WORD_TABLE))
                size += len(row)
        if rows:
            yield from _index_block(block, ids, rows)

    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    # Ascending positions take little room as differences.
    options = {
        "compression": "zstd",
        "parquet.writer.version": "PARQUET_2_0",
        "parquet.enable.dictionary#positions.list.element": "false",
        "parquet.enable.dictionary#term": "false",
    }
    return staged(given.mapInArrow(run, INDEX_SCHEMA), "index", **options)


def phrases(items: DataFrame, width: int = 13, text: str = "text", item_id: str = "item_id") -> DataFrame:
    """(item_id, terms): each run of ``width`` words of each item, or all its words if there are fewer.

    Items without words have none; those without an id share the NULL id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, runs = [], []
            for own, row in zip(batch.column(0).to_pylist(), utf8_rows(batch.column(1))):
                terms, _ = hash_rows([row.translate(WORD_TABLE)])
                terms = terms.view(np.int64)
                for i in range(max(1, len(terms) - width + 1) if len(terms) else 0):
                    ids.append(own)
                    runs.append(terms[i : i + width])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(runs, pa.list_(pa.int64()))], ["item_id", "terms"]
            )

    given = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text"))
    return given.mapInArrow(run, "item_id long, terms array<long>").distinct()


def intersect(
    postings: dict[int, np.ndarray], ordered: Sequence[tuple[int, int]], owner: np.ndarray, slop: int = 0
) -> np.ndarray:
    """The matches of a phrase: per match the position of every (term, offset) of ``ordered``, in that order.

    The first of ``ordered`` is the anchor, so that a match is counted once for
    it. A further term matches at the occurrence nearest to its place as seen
    from the anchor, the earlier of two equally near, if that is at most
    ``slop`` words off and in the anchor's document; ``owner`` names the
    document of each position.
    """
    term, offset = ordered[0]
    anchors = postings[term].astype(np.int64)
    matches = anchors[:, None]
    for term, other in ordered[1:]:
        if not len(matches):
            break
        held, wanted = postings[term], matches[:, 0] - offset + other
        at = np.searchsorted(held, wanted)
        before, after = held[np.maximum(at - 1, 0)], held[np.minimum(at, len(held) - 1)]
        if slop:
            document = owner[matches[:, 0]]
            far = np.iinfo(np.int64).max
            off_before, off_after = (
                np.where(owner[near] == document, np.abs(near - wanted), far) for near in (before, after)
            )
            nearest = np.where(off_before <= off_after, before, after)
            close = np.minimum(off_before, off_after) <= slop
        else:
            nearest, close = after, after == wanted
        matches = np.concatenate([matches, nearest[:, None].astype(np.int64)], axis=1)[close]
    return matches


def _runs(marks: np.ndarray) -> list[tuple[int, int]]:
    """Start and end of each run of true values."""
    change = np.diff(np.concatenate([[0], marks.astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(change == 1).tolist(), np.flatnonzero(change == -1).tolist()))


_MATCHES = pa.schema(
    [
        ("block", pa.int64()),
        ("place", pa.int32()),
        ("n_hit", pa.int64()),
        ("spans", pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32())]))),
    ]
)
_MATCHES_SCHEMA = "block long, place int, n_hit long, spans array<struct<item_id: long, start: int, end: int>>"


def _search_block(index: pa.Table, wanted: pa.Table, slop: int) -> pa.Table:
    """Search one block for its candidate phrases: per document with a match, the words hit and the spans per item."""
    listed = [row for row in index.column("sizes").to_pylist() if row is not None]
    if not listed or not wanted.num_rows:
        return _MATCHES.empty_table()
    sizes = np.array(listed[0], np.int64)
    base = np.concatenate([[0], np.cumsum(sizes + 1)])
    owner = np.repeat(np.arange(len(sizes)), sizes + 1)
    postings = {
        term: held.values.to_numpy()
        for term, held in zip(index.column("term").to_pylist(), index.column("positions").combine_chunks())
        if term is not None
    }
    by_item: dict[int | None, list[np.ndarray]] = {}
    terms, places = (wanted.column(c).combine_chunks() for c in ("terms", "places"))
    items, at = wanted.column("item_id").to_pylist(), terms.offsets.to_numpy().astype(np.int64)
    terms, places, at = terms.flatten().to_numpy(), places.flatten().to_numpy(), at - at[0]
    # Most candidates fail here: a phrase needs all its terms to be in the block.
    present = np.isin(terms, np.fromiter(postings, np.int64, len(postings)))
    whole = np.logical_and.reduceat(present, at[:-1])
    for i in np.flatnonzero(whole).tolist():
        own = slice(at[i], at[i + 1])
        matches = intersect(postings, list(zip(terms[own].tolist(), places[own].tolist())), owner, slop)
        if len(matches):
            by_item.setdefault(items[i], []).append(matches.ravel())
    if not by_item:
        return _MATCHES.empty_table()
    hit, spans = np.zeros(len(owner), bool), {}
    for item, found in sorted(by_item.items(), key=lambda kept: (kept[0] is not None, kept[0])):
        marks = np.zeros(len(owner), bool)
        marks[np.concatenate(found)] = True
        hit |= marks
        for start, end in _runs(marks):
            place = int(owner[start])
            spans.setdefault(place, []).append({"item_id": item, "start": start - int(base[place]), "end": end - int(base[place])})
    counts = np.add.reduceat(hit.astype(np.int64), base[:-1])
    block, places = index.column("block")[0].as_py(), sorted(spans)
    columns = [[block] * len(places), places, counts[places].tolist(), [spans[p] for p in places]]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, _MATCHES)], schema=_MATCHES)


def search(index: DataFrame, wanted: DataFrame, slop: int = 0) -> DataFrame:
    """One row per document of the index: (doc_id, n_words, n_hit, spans).

    ``wanted`` holds phrases as from ``phrases``. ``spans`` lists, per item,
    the runs of words that its phrases matched, as word numbers from 0, the end
    not included. ``n_hit`` counts the words matched by any item. With
    ``slop`` 0 only exact phrases count; else each word may be that far off its
    place as seen from the phrase's rarest word, in either direction.
    """
    wanted = staged(wanted, "phrases")
    terms = staged(wanted.select(F.explode("terms").alias("term")).distinct(), "terms")
    held = index.where("term is not null").join(terms, "term", "left_semi")
    # From files, as the join below can then be split where many phrases share a term.
    frequency = staged(held.groupBy("term").agg(F.sum("n").alias("frequency")), "frequency")
    each = wanted.withColumn("phrase", F.xxhash64("item_id", "terms")).select(
        "phrase", "item_id", F.size("terms").alias("width"), F.posexplode("terms").alias("place", "term")
    )
    # A phrase with a term that occurs nowhere cannot match.
    ranked = (
        each.join(frequency, "term")
        .groupBy("phrase", "item_id", "width")
        .agg(F.sort_array(F.collect_list(F.struct("frequency", "term", "place"))).alias("ordered"))
        .where(F.size("ordered") == F.col("width"))
        .select(
            "item_id", F.col("ordered")[0]["term"].alias("term"), F.col("ordered")["term"].alias("terms"), F.col("ordered")["place"].alias("places")
        )
    )
    ranked = staged(ranked, "ranked")
    candidates = index.where("term is not null").select("term", "block").join(ranked, "term")
    # A name of its own: the other side of the cogroup comes from the same table.
    candidates = candidates.select(F.col("block").alias("in_block"), "item_id", "terms", "places")
    blocks = candidates.select("in_block").distinct()
    needed = held.select("block", "term", "positions", "sizes").unionByName(
        index.where("term is null").select("block", "term", "positions", "sizes")
    )
    needed = needed.join(blocks, needed["block"] == blocks["in_block"], "left_semi")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return _search_block(left, right, slop)

    found = needed.groupBy("block").cogroup(candidates.groupBy("in_block")).applyInArrow(run, _MATCHES_SCHEMA)
    listed = index.where("term is null").select("block", F.posexplode(F.arrays_zip("doc_ids", "sizes")).alias("place", "doc"))
    return listed.join(found, ["block", "place"], "left").select(
        F.col("doc.doc_ids").alias("doc_id"),
        F.col("doc.sizes").cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        "spans",
    )


def contaminated(n_hit: Column, n_words: Column) -> Column:
    """A twentieth of the words or more lie in benchmark passages."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def contamination(
    docs: DataFrame,
    items: DataFrame,
    width: int = 13,
    text: str = "text",
    doc_id: str = "doc_id",
    item_text: str = "text",
    item_id: str = "item_id",
    slop: int = 0,
) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans.

    A NULL or empty text has no words and is clean. Every row of ``docs`` comes
    back once, repeated and NULL ids included. Items that repeat an id count as
    one. The words of items without an id are hit like any others; such items
    are neither counted nor listed. ``slop`` is that of ``search``.
    """
    found = search(build_index(docs, text, doc_id), phrases(items, width, item_text, item_id), slop)
    named = F.array_compact(F.col("spans")["item_id"].cast("array<string>"))
    matched = F.array_sort(F.coalesce(F.array_distinct(named), F.array().cast("array<string>")))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size(matched).cast("long").alias("n_items"),
        F.sha2(F.array_join(matched, ","), 256).alias("items_sha256"),
        contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
        "spans",
    )


def clean(docs: DataFrame, items: DataFrame, width: int = 13, slop: int = 0) -> DataFrame:
    """``docs`` (with doc_id and text) without the contaminated ones. Rows with equal id and text share their fate."""
    key = F.xxhash64("doc_id", "text")
    verdicts = contamination(docs.select("text", key.alias("key")), items, width, doc_id="key", slop=slop)
    dirty = verdicts.where("contaminated").select(F.col("doc_id").alias("key")).distinct()
    own = docs.select(carried(docs.columns).alias("own"), key.alias("key")).join(dirty, "key", "left_anti")
    return own.select(*(F.col("own")[c].alias(c) for c in docs.columns))
