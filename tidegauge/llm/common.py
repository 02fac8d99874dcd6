"""What several operators share: folds, staged tables, vectorised words and their hashes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidegauge.sources import scratch

# The separators of ``[^\x20\x09-\x0D]+``, also those of bytes.split().
SPACES = bytes([9, 10, 11, 12, 13, 32])
# Bytes handled at once: a few numpy arrays of eight bytes each per byte of text.
CHUNK_BYTES = 1 << 20


def fold(doc_id: str = "doc_id", folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``; NULL for a NULL id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds


def in_fold(remainder: int, doc_id: str = "doc_id", folds: int = 5) -> Column:
    """Whether the id falls in the fold. A NULL id is in no fold."""
    return F.coalesce(fold(doc_id, folds) == remainder, F.lit(False))


def outside_fold(remainder: int, doc_id: str = "doc_id", folds: int = 5) -> Column:
    """Whether the id falls in another fold. A NULL id is in no fold."""
    return F.coalesce(fold(doc_id, folds) != remainder, F.lit(False))


def staged(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` written to a fresh shared folder and read back, which cuts its lineage."""
    path = scratch(df.sparkSession).path(name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_fields(schema: StructType, ddl: str) -> StructType:
    """A schema with more fields at its end."""
    return StructType([*schema.fields, *StructType.fromDDL(ddl).fields])


def carried(columns: Sequence[str]) -> Column:
    """Columns of the caller as one struct, so that no name used beside them can clash with theirs."""
    named = [F.col("`" + c.replace("`", "``") + "`").alias(c) for c in columns]
    return F.struct(*named) if named else F.struct(F.lit(0).alias("none"))


def sent_if_small(table: DataFrame, most_rows: int = 100_000) -> DataFrame:
    """A written copy of a narrow table, marked to be sent to all tasks if it has at most ``most_rows`` rows, else left to Spark."""
    table = staged(table, "small")
    return F.broadcast(table) if table.count() <= most_rows else table


def smallest_draws(rows: DataFrame, label: str, key: Sequence[str], per_class: int) -> DataFrame:
    """Of each value of ``label`` the ``per_class`` rows, at most, with the smallest draws, which are hashes of ``key``."""
    # Some more than wanted, of which the window below keeps the wanted number: it sees no more rows than these.
    drawn = per_class + 8 * per_class**0.5 + 16
    place = F.pmod(F.xxhash64(*key, F.lit("draw")), F.lit(1 << 40)) / float(1 << 40)
    sizes = rows.groupBy(label).agg(F.count("*").alias("in_class"))
    # Sent to the rows, so that those of a frequent label do not all go to one task.
    near = rows.join(sent_if_small(sizes), label).withColumn("place", place).where(F.col("place") * F.col("in_class") < drawn)
    rank = F.row_number().over(Window.partitionBy(label).orderBy("place", *key))
    return near.withColumn("rank", rank).where(F.col("rank") <= per_class).select(*rows.columns)


def sample_contents(df: DataFrame, label: str, content: str, per_class: int) -> DataFrame:
    """(label, content, key): at most ``per_class`` different contents of each value of ``label``, one row of each.

    Copies count once, however many there are, so the number of rows is
    bounded by ``per_class`` times the number of labels. Of more contents
    those with the smallest hashes are taken. ``key`` is the content's hash;
    contents of equal hash count as copies. Rows where either is NULL have no part.
    """
    given = df.where(F.col(label).isNotNull() & F.col(content).isNotNull()).select(
        F.col(label).alias("label"), F.col(content).alias("content"), F.xxhash64(content, F.lit("sample")).alias("key")
    )
    keys = staged(given.select("label", "key").distinct(), "contents")
    chosen = smallest_draws(keys, "label", ["key"], per_class).select("label", "key")
    return given.join(sent_if_small(chosen), ["label", "key"]).dropDuplicates(["label", "key"]).select("label", "content", "key")


def utf8_rows(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """Texts as UTF-8 bytes; NULL is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [b"" if v is None else v for v in column.cast(pa.large_binary()).to_pylist()]


def small_batches(batches: Iterable[pa.RecordBatch], column: int, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most about ``limit`` bytes of text, or of one longer row.

    What a task holds besides the batch Spark hands over then stays small.
    """
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        upto = np.cumsum(lengths.astype(np.int64))
        start = 0
        while start < batch.num_rows:
            done = upto[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(upto, done + limit, side="right")))
            yield batch.slice(start, end - start)
            start = end


def by_bytes(rows: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive rows of at most ``limit`` bytes together, or of one longer row."""
    start = size = 0
    for i, row in enumerate(rows):
        if i > start and size + len(row) > limit:
            yield start, i
            start, size = i, 0
        size += len(row)
    if start < len(rows):
        yield start, len(rows)


def separator_table(separators: bytes, lower: bool) -> bytes:
    """A table for bytes.translate: separators become blanks and, with ``lower``, A-Z a-z."""
    table = bytearray(bytes(range(256)).lower() if lower else range(256))
    for byte in separators:
        table[byte] = 32
    return bytes(table)


SPACED_LOWER = separator_table(SPACES, lower=True)

_random = np.random.Generator(np.random.PCG64(20240101))
_BYTE_VALUES = _random.integers(0, 1 << 64, 256, dtype=np.uint64)
_BASE = np.uint64(_random.integers(0, 1 << 63, dtype=np.uint64) * np.uint64(2) + np.uint64(1))


def _powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), _BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS = _powers(256)


def mix64(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers so that all bits depend on all bits."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of bytes other than the blank."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = data != 32
    change = np.diff(inside)
    return np.flatnonzero(change == 1), np.flatnonzero(change == -1)


def _segments(data: bytes, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Cut a long text at blanks so that each part has about ``limit`` bytes."""
    at = 0
    while at < len(data):
        end = len(data) if len(data) - at <= limit else data.find(b" ", at + limit)
        end = len(data) if end < 0 else end
        yield at, end
        at = end


def hash_words(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and 64-bit hash of each blank-separated word.

    The hash is a polynomial in an odd random base over random byte values,
    scrambled at the end: one pass of array operations, no Python object per word.
    """
    found = []
    for at, end in _segments(text):
        data = np.frombuffer(text, np.uint8, end - at, at)
        starts, ends = word_bounds(data)
        if not len(starts):
            continue
        lengths = ends - starts
        first = np.cumsum(lengths) - lengths
        place = np.arange(lengths.sum()) - np.repeat(first, lengths)
        powers = _POWERS if lengths.max() <= len(_POWERS) else _powers(int(lengths.max()))
        terms = _BYTE_VALUES[data[data != 32]] * powers[place]
        found.append((starts + at, ends + at, mix64(np.add.reduceat(terms, first))))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64)
    return tuple(np.concatenate(parts) for parts in zip(*found))


def prefix_hashes(text: bytes, starts: np.ndarray, ends: np.ndarray, lengths: tuple[int, ...]) -> list[np.ndarray]:
    """Per length, the hash of each word's first bytes (of the whole word if shorter)."""
    data = np.frombuffer(text, np.uint8)
    total, out = np.zeros(len(starts), np.uint64), []
    for i in range(max(lengths)):
        here = starts + i < ends
        terms = _BYTE_VALUES[data[np.minimum(starts + i, len(data) - 1)]] * _POWERS[i]
        total = total + np.where(here, terms, np.uint64(0))
        if i + 1 in lengths:
            out.append(mix64(total + np.uint64(i + 1)))
    return out


def hash_rows(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The word hashes of many rows, one after the other, and where each row's begin.

    The second array has one entry more than there are rows.
    """
    starts, _, hashes = hash_words(b" ".join(rows))
    lengths = np.fromiter((len(r) + 1 for r in rows), np.int64, len(rows))
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    return hashes, np.searchsorted(starts, offsets)
