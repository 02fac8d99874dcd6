"""Near duplicates by SimHash, found through popcounts of fingerprint segments.

Each distinct fingerprint is cut into 32 segments of two bits and embedded as
the vector of its segments' bit counts. The Manhattan distance of two vectors
is never above the Hamming distance of the fingerprints, so only pairs within
that distance need checking. The range join runs on a grid: of the two halves
of the vector one lies within half the distance, and two half vectors at that
distance share a lattice point half-way. Each fingerprint is therefore dealt to
the lattice points around both of its halves. Fingerprints at one point are
compared exactly, and of those linked only a spanning forest is returned. A
point that draws many fingerprints is split by runs of bits, one of which two
fingerprints within the distance share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType
from pyspark.sql.window import Window

from tidegauge.llm.common import carried, mix64, small_batches, staged, utf8_rows

SEED = 42
# Fingerprints compared at one lattice point as they are; points with more are split.
CROWD = 1 << 15
# A node of more edges than this, and than a share of all, has its smallest neighbour looked up.
CENTRE_EDGES, MOST_CENTRES = 1_000, 10_000
_ODD = np.uint64(0x5555555555555555)


def shingle_hashes(text: bytes, width: int) -> list[int]:
    """XXH64 of each run of ``width`` words, lower-cased and joined by blanks; of all words if there are fewer."""
    words = text.lower().split()
    if not words:
        return []
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return [digest(joined, SEED)]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - width + 1]
    return [digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[width - 1 :].tolist())]


def fingerprint(hashes: list[int]) -> int:
    """The bits set in more than half of the hashes; no hashes give zero."""
    counts, values = np.zeros(64, np.int64), np.array(hashes, np.uint64)
    for at in range(0, len(values), 1 << 16):
        part = values[at : at + (1 << 16)].astype("<u8")
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(counts * 2 > len(values)).tolist())


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 4) -> DataFrame:
    """(doc_id, tag, code): a hash of each whole text, and its SimHash as a signed 64-bit number.

    NULL, empty and blank texts have code 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 2):
            rows = utf8_rows(batch.column(2))
            codes = np.zeros(len(rows), np.uint64)
            for i, row in enumerate(rows):
                codes[i] = fingerprint(shingle_hashes(row, width))
            own = pa.array(codes.view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], own], ["doc_id", "tag", "code"])

    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("tag"), F.col(text).alias("text"))
    return given.mapInArrow(run, "doc_id long, tag long, code long")


def segment_counts(codes: np.ndarray) -> np.ndarray:
    """The bit counts, 0 to 2, of the 32 two-bit segments, each kept in its segment's place."""
    return codes - ((codes >> np.uint64(1)) & _ODD)


def _lattice_keys(codes: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(key, row) arrays: the lattice points within ``radius`` (0 or 1) of each half vector."""
    counts = segment_counts(codes)
    for half in range(2):
        point = (counts >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)
        tag = np.uint64(half) << np.uint64(32)
        rows = np.arange(len(codes))
        yield mix64(point | tag), rows
        if not radius:
            continue
        for i in range(16):
            step = np.uint64(1) << np.uint64(2 * i)
            value = (point >> np.uint64(2 * i)) & np.uint64(3)
            up, down = value < 2, value > 0
            yield mix64((point[up] + step) | tag), rows[up]
            yield mix64((point[down] - step) | tag), rows[down]


def _shared_runs(keys: np.ndarray, codes: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(key, code) arrays: each key split by each of ``distance`` + 1 runs of bits.

    Fingerprints that differ in ``distance`` bits at most agree in one of the runs.
    """
    bounds = [64 * i // (distance + 1) for i in range(distance + 2)]
    for i, (low, high) in enumerate(zip(bounds, bounds[1:])):
        run = (codes >> np.uint64(low)) << np.uint64(64 - high + low)
        # The number added to the key tells the runs apart.
        yield mix64(mix64(keys + np.uint64(i + 1)) ^ run), codes


def _forest(codes: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest over the links among ``codes`` (all different)."""
    left = np.arange(len(codes))
    edges: list[tuple[int, int]] = []
    queue: list[int] = []
    # Breadth first: every code is compared once with those not reached before.
    while len(left):
        if not queue:
            queue, left = [int(left[0])], left[1:]
        at = queue.pop()
        near = np.bitwise_count(codes[left] ^ codes[at]) <= distance
        if near.any():
            reached = left[near].tolist()
            edges += [(at, other) for other in reached]
            queue += reached
            left = left[~near]
    return edges


def _linked(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Links among sorted (key, code) rows with equal keys; a key's rows may span batches."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    pending: list[np.ndarray] = []
    pending_key = None

    def flush(codes: np.ndarray) -> list[tuple[int, int]]:
        codes = np.unique(codes)
        return [(int(codes[i]), int(codes[j])) for i, j in _forest(codes, distance)] if len(codes) > 1 else []

    def out(found: list[tuple[int, int]]) -> pa.RecordBatch:
        pairs = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=schema)

    for batch in batches:
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        codes = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
        if not len(keys):
            continue
        begins = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        ends = np.concatenate([begins[1:], [len(keys)]])
        found: list[tuple[int, int]] = []
        if pending and keys[0] != pending_key:
            found += flush(np.concatenate(pending))
            pending = []
        first_done = 0
        if pending and len(begins) > 1:
            found += flush(np.concatenate([*pending, codes[: ends[0]]]))
            pending, first_done = [], 1
        several = np.flatnonzero(ends - begins > 1)
        for i in several[(several >= first_done) & (several < len(begins) - 1)].tolist():
            found += flush(codes[begins[i] : ends[i]])
        pending.append(codes[begins[-1] :].copy())
        pending_key = keys[-1]
        if found:
            yield out(found)
    if pending:
        found = flush(np.concatenate(pending))
        if found:
            yield out(found)


def links(codes: DataFrame, distance: int = 4, crowd: int = CROWD) -> DataFrame:
    """(a, b): links that join the same fingerprints as all pairs within ``distance`` do.

    ``codes`` holds distinct fingerprints. Every pair within the distance is
    compared, but of the links met at one lattice point only a spanning forest
    comes back, so a dense group gives rows in proportion to its size.
    Distances up to 5 are found. Points with more than ``crowd`` fingerprints
    are split, which finds the same links.
    """
    if not 0 <= distance <= 5:
        raise ValueError("distance must be between 0 and 5")
    # One half is within distance // 2, up to 2, and meets half-way at 1.
    radius = 1 if distance >= 2 else 0

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for keys, rows in _lattice_keys(own, radius):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.view(np.int64)), pa.array(own[rows].view(np.int64))], ["key", "code"]
                )

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crowded = batch.column(2).to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(~crowded)).select(["key", "code"])
            hot = batch.filter(pa.array(crowded))
            keys, own = (hot.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in range(2))
            for parts, rows in _shared_runs(keys, own, distance):
                yield pa.RecordBatch.from_arrays([pa.array(parts.view(np.int64)), pa.array(rows.view(np.int64))], ["key", "code"])

    dealt = codes.select("code").mapInArrow(deal, "key long, code long")
    # At most one row for ``crowd`` dealt ones; Spark broadcasts it or not by its size.
    crowds = dealt.groupBy("key").count().where(F.col("count") > crowd).select("key", F.lit(True).alias("crowded"))
    marked = dealt.join(staged(crowds, "crowds"), "key", "left").select("key", "code", F.coalesce("crowded", F.lit(False)).alias("crowded"))
    met = marked.mapInArrow(split, "key long, code long").repartition("key").sortWithinPartitions("key")
    return met.mapInArrow(lambda batches: _linked(batches, distance), "a long, b long")


def _with_smallest(edges: DataFrame, most: int) -> DataFrame:
    """Rows (a, b) with the ``smallest`` b of each a, from at most ``most`` rows.

    Nodes of many edges have it looked up in a table of at most
    ``MOST_CENTRES`` rows, so their rows stay where they are; the rows of any other node meet in one task.
    """
    limit = max(CENTRE_EDGES, most // MOST_CENTRES)
    centres = edges.groupBy("a").agg(F.min("b").alias("of_centre"), F.count("*").alias("n")).where(F.col("n") > limit)
    centres = centres.select(F.col("a").alias("centre"), "of_centre")
    marked = edges.join(F.broadcast(centres), F.col("a") == F.col("centre"), "left")
    crowded = marked.where("centre is not null").select("a", "b", F.col("of_centre").alias("smallest"))
    smallest = F.min("b").over(Window.partitionBy("a"))
    return marked.where("centre is null").select("a", "b", smallest.alias("smallest")).unionByName(crowded)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable from each node that has an edge.

    Alternating large-star and small-star steps, each one shuffle of the edges
    and one written table; rounds grow with the logarithm of the component size.
    """

    def state(table: DataFrame) -> tuple:
        hashed = F.xxhash64("a", "b").cast("decimal(38,0)")
        return tuple(table.agg(F.count("*"), F.sum(hashed)).first())

    edges = staged(edges.distinct(), "edges")
    before = state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Large star: larger neighbours hang on the smallest of the neighbourhood.
        large = _with_smallest(both, 2 * before[0]).withColumn("m", F.least("smallest", "a")).where("b > a")
        large = large.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: smaller neighbours and the node itself hang on the smallest.
        pairs = F.array(F.struct(F.col("a").alias("a"), F.col("smallest").alias("m")), F.struct(F.col("b").alias("a"), F.col("smallest").alias("m")))
        small = _with_smallest(large, 2 * before[0]).select(F.explode(pairs).alias("e"))
        edges = staged(small.select("e.a", F.col("e.m").alias("b")).where("a > b").distinct(), "edges")
        after = state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 4, distance: int = 4
) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    ``component_id`` is the smallest doc_id reachable over links. Repeated rows
    come back as often as they are given. Texts without words share fingerprint
    zero. A NULL doc_id is linked like any other and is never the smallest; a
    component of NULL ids alone has a NULL component_id. Columns of ``docs``
    other than the two named are not looked at.
    """
    codes = staged(fingerprints(docs, text, doc_id, width), "fingerprints")
    grouped = _roots(codes, distance)
    # Read from files, both sides of the joins can be split where a component or a code holds many rows.
    grouped = staged(grouped, "grouped")
    smallest = staged(grouped.groupBy("root").agg(F.min("first").alias("component_id")), "smallest")
    of_code = grouped.join(smallest, "root").select("code", "component_id")
    return codes.join(of_code, "code").select(
        "doc_id", F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"), "component_id"
    )


def _roots(codes: DataFrame, distance: int) -> DataFrame:
    """Per distinct code: code, the root of its component, and the first of its rows by id and text."""
    distinct = codes.groupBy("code").agg(F.min("doc_id").alias("first"), F.min(F.struct("doc_id", "tag")).alias("row"))
    # An edge points at codes, whose order says nothing about doc_ids.
    roots = components(links(distinct.select("code"), distance))
    return distinct.join(roots, distinct["code"] == roots["node"], "left").select(
        "code", F.coalesce("root", "code").alias("root"), "first", "row"
    )


def keep_one(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 4, distance: int = 4
) -> DataFrame:
    """``docs`` with one row of each component left: that of the smallest doc_id.

    Of rows repeating that id the first by a hash of the text stays, then of all
    columns; where one id has texts in several components, each keeps its own.
    Rows with a NULL id rank behind all ids: one of them stays only where its component has no id.
    """
    rows = docs.select(
        carried(docs.columns).alias("own"),
        F.col(doc_id).cast("long").alias("id"),
        F.col(text).alias("text"),
        # Maps have no hash; rows that differ in them alone are as good as equal.
        F.xxhash64(*(F.col("`" + f.name.replace("`", "``") + "`") for f in docs.schema if _hashable(f.dataType))).alias("hash"),
    )
    given, unnamed = rows.where("id is not null"), rows.where("id is null")
    searched = given.select("id", "text")
    has_unnamed = not unnamed.isEmpty()
    if has_unnamed:
        last = F.lit((1 << 63) - 1) - F.monotonically_increasing_id()
        unnamed = staged(unnamed.withColumn("id", last), "unnamed")
        searched = searched.unionByName(unnamed.select("id", "text"))
    grouped = _roots(staged(fingerprints(searched, "text", "id", width), "fingerprints"), distance)
    kept = grouped.groupBy("root").agg(F.min("row").alias("row")).select(
        F.col("row.doc_id").alias("id"), F.col("row.tag").alias("tag")
    )
    stay = given.withColumn("tag", F.xxhash64("text")).join(kept, ["id", "tag"], "left_semi")
    # Of rows with the same id and text one is kept wherever they meet, before or after they are moved.
    stay = stay.groupBy("id", "tag").agg(F.min_by("own", "hash").alias("own")).select("own")
    if has_unnamed:
        stay = stay.unionByName(unnamed.join(kept, "id", "left_semi").select("own"))
    return stay.select(*(F.col("own")[c].alias(c) for c in docs.columns))


def _hashable(type_: DataType) -> bool:
    return "map<" not in type_.simpleString() and "variant" not in type_.simpleString()
