"""What each filter removes under every order of a set of filters.

Whether a document fails a filter does not depend on the filters before it, so
everything an order can show follows from the number of documents of each
pattern of failures. Per part these counts form a tensor with one axis of
length two per filter. A step of an order contracts every axis with one of three
vectors: pass, fail, or all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegauge.llm.common import hash_words, small_batches, utf8_rows

FEWEST_WORDS = 200
CAPITALS, SIGNS = bytes(range(65, 91)), b"#$%&*|"
# Words of a text up to this size are compared themselves, those of longer ones by 64-bit hashes.
LONG_BYTES = 4 << 20

SHORT, POOR, LOUD, SIGNED, COPIED = 1, 2, 4, 8, 16
NAMES = "ABCDE"

PASS, FAIL, ALL = (1, 0), (0, 1), (1, 1)
# Parts handled at once in a task.
PARTS_AT_ONCE = 64


def _word_counts(text: bytes) -> tuple[int, int]:
    if len(text) > LONG_BYTES:
        hashes = hash_words(text.translate(_BLANKED))[2]
        return len(hashes), len(np.unique(hashes))
    words = text.split()
    return len(words), len(set(words))


_BLANKED = bytes(32 if b in b"\t\n\x0b\x0c\r" else b for b in range(256))


def _failures(text: bytes, characters: int) -> int:
    words, different = _word_counts(text)
    found = SHORT if words < FEWEST_WORDS else 0
    found |= POOR if 100 * different < 50 * words else 0
    found |= LOUD if 100 * (len(text) - len(text.translate(None, CAPITALS))) > 3 * characters else 0
    return found | (SIGNED if len(text.translate(None, SIGNS)) < len(text) else 0)


def text_failures(docs: DataFrame, part: Column, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, part, digest, fails): the SHA-256 of each text and which of the four filters on a text alone it fails.

    A NULL text is empty; a NULL part is the empty string.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 2):
            lengths = pc.fill_null(pc.utf8_length(batch.column(2)), 0).to_pylist()
            texts = utf8_rows(batch.column(2))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()),
                 pa.array([_failures(t, n) for t, n in zip(texts, lengths)], pa.int32())],
                ["doc_id", "part", "digest", "fails"],
            )

    given = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(part.cast("string"), F.lit("")).alias("part"), F.col(text).alias("text")
    )
    return given.mapInArrow(run, "doc_id long, part string, digest binary, fails int")


def patterns(failures: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, pattern, n, good, toxic) from rows of ``text_failures`` and labels (doc_id, quality, toxic).

    ``pattern`` adds to ``fails`` the bit of a text that equals the text of any
    smaller doc_id. A NULL doc_id is neither smaller nor larger than any and has
    no label. A document is good, or toxic, if any label of its id says so.
    Repeated rows count as often as they come.

    No row of a group of copies meets the others: copies fail the same filters,
    so per text and part it is enough to know how many there are, and how many
    of these bear the smallest id.
    """
    # Rows without an id are spread by their text, since no label can match them.
    spread = F.when(F.col("doc_id").isNull(), F.xxhash64("digest")).otherwise(F.lit(0).cast("long"))
    rows = failures.groupBy("doc_id", "part", "digest", "fails").agg(F.count("*").alias("n")).withColumn("spread", spread)
    of_id = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.bool_or(F.col("quality") == 1).alias("is_good"), F.bool_or(F.col("toxic") == 1).alias("is_toxic")
    )
    rows = rows.join(of_id.withColumn("spread", F.lit(0).cast("long")), ["doc_id", "spread"], "left")
    rows = rows.select(
        "doc_id", "part", "digest", "fails", "n",
        F.when(F.col("is_good"), F.col("n")).otherwise(0).alias("good"),
        F.when(F.col("is_toxic"), F.col("n")).otherwise(0).alias("toxic"),
    )
    measures = ("n", "good", "toxic")
    known = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", *measures))
    texts = rows.groupBy("digest", "part", "fails").agg(
        *(F.sum(m).alias(m) for m in measures),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("nameless"),
        F.min(known).alias("first"),
    )
    # One row per part the text occurs in.
    texts = texts.withColumn("smallest", F.min("first.doc_id").over(Window.partitionBy("digest")))
    is_first = F.coalesce(F.col("first.doc_id") == F.col("smallest"), F.lit(False))
    stay = {m: F.when(is_first, F.col(f"first.{m}")).otherwise(0) for m in measures}
    stay["n"] = stay["n"] + F.col("nameless")
    both = F.array(
        F.struct(F.col("fails").alias("pattern"), *(stay[m].alias(m) for m in measures)),
        F.struct(
            F.col("fails").bitwiseOR(COPIED).alias("pattern"), *((F.col(m) - stay[m]).alias(m) for m in measures)
        ),
    )
    return texts.select("part", F.inline(both)).groupBy("part", "pattern").agg(*(F.sum(m).alias(m) for m in measures))


def contract(tensors: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Per leading index of ``tensors`` and row of ``chosen``, the count of the patterns chosen.

    ``tensors`` has two leading axes and one of length two per filter;
    ``chosen`` holds, per row and filter, one of ``PASS``, ``FAIL`` and ``ALL``.
    """
    axes = "abcdefgh"[: chosen.shape[1]]
    terms = ",".join(f"s{axis}" for axis in axes)
    vectors = (np.ascontiguousarray(chosen[:, i]) for i in range(len(axes)))
    return np.einsum(f"yz{axes},{terms}->yzs", tensors, *vectors, optimize="greedy")


def _views(names: str) -> tuple[list[tuple[str, int, int]], dict[str, np.ndarray]]:
    """The (order, step, filter) of each result row, and what is chosen along each axis for each kind of count."""
    steps = [("".join(names[i] for i in order), k + 1, order[k], order[:k]) for order in permutations(range(len(names))) for k in range(len(names))]
    chosen = {kind: np.full((len(steps), len(names), 2), ALL, np.int64) for kind in ("kept", "removed", "failing", "unique")}
    for row, (_, _, own, before) in enumerate(steps):
        for kind in ("kept", "removed"):
            chosen[kind][row, list(before)] = PASS
        chosen["kept"][row, own] = PASS
        chosen["unique"][row] = PASS
        for kind in ("removed", "failing", "unique"):
            chosen[kind][row, own] = FAIL
    return [step[:3] for step in steps], chosen


def audit(counted: DataFrame, names: str = NAMES) -> DataFrame:
    """One row per part, order of the filters and step, from rows (part, pattern, n, good, toxic).

    Bit i of ``pattern`` is set where the filter ``names[i]`` fails; a pattern
    may come in several rows. Columns: part, filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley. Every order and step of each part has its
    row, zeros included; without parts there is none. The rows of a part stem
    from at most two to the number of filters counts, which one task holds.
    """
    size = len(names)
    measures = ("n", "good", "toxic")
    cells = counted.groupBy("part", "pattern").agg(*(F.sum(m).cast("long").alias(m) for m in measures))
    of_part = cells.groupBy("part").agg(F.collect_list(F.struct("pattern", *measures)).alias("cells"))
    results = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    ddl = "part string, filter_order string, step int, " + ", ".join(f"{name} long" for name in results)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps, chosen = _views(names)
        own = np.array([step[2] for step in steps])
        orders, places = pa.array([s[0] for s in steps]), pa.array([s[1] for s in steps], pa.int32())
        for whole in batches:
            for start in range(0, whole.num_rows, PARTS_AT_ONCE):
                batch = whole.slice(start, PARTS_AT_ONCE)
                flat = np.zeros((3, batch.num_rows, 1 << size), np.int64)
                for i, part in enumerate(batch.column(1).to_pylist()):
                    for cell in part:
                        flat[:, i, cell["pattern"]] = [cell[m] for m in measures]
                # The first axis after a reshape is that of the highest bit.
                tensors = flat.reshape(3, batch.num_rows, *[2] * size).transpose(0, 1, *range(size + 1, 1, -1))
                removed, good_lost, toxic_lost = contract(tensors, chosen["removed"])
                kept, failing, unique = (contract(tensors[:1], chosen[kind])[0] for kind in ("kept", "failing", "unique"))
                of_filter = np.stack([removed[:, own == f].sum(axis=1) for f in range(size)], axis=1)
                values = (kept, removed, failing - removed, unique, good_lost, toxic_lost, of_filter[:, own])
                for i in range(batch.num_rows):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([batch.column(0)[i].as_py()] * len(steps), pa.string()), orders, places,
                         *(pa.array(v[i], pa.int64()) for v in values)],
                        ["part", "filter_order", "step", *results],
                    )

    return of_part.mapInArrow(run, ddl)


def audit_documents(
    docs: DataFrame, labels: DataFrame, part: Column | None = None, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """``audit`` of five filters over whole texts, per ``part`` (the column lang by default).

    A: under 200 words. B: fewer different words than half of all. C: more than
    3 capitals A-Z per 100 characters. D: any of ``#$%&*|``. E: the text of a
    smaller doc_id. NULL texts are empty, NULL parts the empty string; other
    columns have no influence. Without documents there is no row.
    """
    return audit(patterns(text_failures(docs, F.col("lang") if part is None else part, text, doc_id), labels))
