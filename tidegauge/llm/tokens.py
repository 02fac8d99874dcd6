"""Token ids as Parquet list columns, in document order.

A token table has one row per document: doc_id, its place (file, then row),
and the ids as a list. Files follow each other in ascending doc_id order, row
groups and pages are kept small and carry indexes, so a reader can fetch the ids
of a few documents, or ids and lengths of none, without reading the rest.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from tidegauge.llm.common import small_batches

TOKEN_SCHEMA = "doc_id long, file int, place long, ids array<int>"
# Row groups of 32 MiB; pages of 64 KiB are what a lookup by doc_id reads.
WRITE_OPTIONS = {
    "compression": "zstd",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(64 << 10),
    "parquet.page.row.count.limit": "1000",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#place": "false",
}

# Words and pieces of words remembered per worker process, about 200 bytes each.
CACHE_WORDS, CACHE_LENGTH = 400_000, 64

# The pieces a text is cut into, as the tokenizer's own pattern has them, for characters up to U+017F.
_LETTERS = "a-zA-ZªµºÀ-ÖØ-öø-ſ"
_DIGITS = "0-9²³¹¼½¾"
_BLANKS = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0"
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|[^{_BLANKS}{_LETTERS}{_DIGITS}]+")
_WIDE = re.compile("[^\\x00-\\u017f]")
# Characters beyond the patterns above, and those that Python takes for blanks and the tokenizer does not.
_OTHER = re.compile("[^\\x00-\\x1b\\x20-\\u017f]")
_SPLIT = re.compile("[\\t\\n\\x0b\\x0c\\r ]+")


def _byte_characters() -> list[str]:
    """How byte-level vocabularies write each byte: printable ones as themselves, the rest from U+0100 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class _Words(dict):
    """Packed ids by word or piece; one not seen before is encoded, and remembered while there is room."""

    def __init__(self, encode: Callable[[str], bytes]) -> None:
        super().__init__()
        self._encode = encode

    def __missing__(self, word: str) -> bytes:
        packed = self._encode(word)
        self.remember(word, packed)
        return packed

    def remember(self, word: str, packed: bytes) -> None:
        if len(self) < CACHE_WORDS and len(word) <= CACHE_LENGTH:
            self[word] = packed


class WordEncoder:
    """Encodes texts by words, remembering frequent ones; the ids are those of encoding the whole text.

    Valid for tokenizers that lower-case, cut at white space and never join
    across it, such as ``word_bpe_49k``. A word of characters up to U+017F,
    where lower-casing and normal forms are plain, goes to the vocabulary's
    merges piece by piece. Any other word, and any text that may hold a special
    token, goes through the whole tokenizer.
    """

    def __init__(self, path: str) -> None:
        self._tokenizer = Tokenizer.from_file(path)
        self._model = self._tokenizer.model
        self._characters = _byte_characters()
        self._special = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        # A piece alone is a word of one piece, so words and pieces share their place.
        self._words = _Words(self._narrow)

    @staticmethod
    def _packed(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def _piece(self, piece: str) -> bytes:
        written = piece if piece.isascii() and piece.isprintable() else "".join(self._characters[b] for b in piece.encode())
        return self._packed([t.id for t in self._model.tokenize(written)])

    def _whole(self, text: str) -> bytes:
        return self._packed(self._tokenizer.encode(text, add_special_tokens=False).ids)

    def _narrow(self, text: str) -> bytes:
        """Of a text in lower case without wide characters."""
        pieces = [text] if text.isascii() and text.isalpha() else _PIECES.findall(text)
        return self._piece(pieces[0]) if len(pieces) == 1 else b"".join([self._words[p] for p in pieces])

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        if any(s in text for s in self._special):
            return self._whole(text)
        if not _OTHER.search(text):
            # No piece reaches over a blank, so a text is its words, of which most were seen before.
            return b"".join(map(self._words.__getitem__, text.lower().split()))
        parts = []
        for word in _SPLIT.split(text):
            if not _WIDE.search(word):
                parts.append(self._words[word.lower()])
            else:
                # A key that no piece has, as pieces hold no blanks.
                key = f" {word}"
                if not (packed := self._words.get(key)):
                    packed = self._whole(word)
                    self._words.remember(key, packed)
                parts.append(packed)
        return b"".join(parts)


@lru_cache(maxsize=1)
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, text: str = "text", doc_id: str = "doc_id"
) -> None:
    """Encode whole texts and write them in ascending doc_id order.

    Each document's ids end with ``end_id``; a NULL or empty text has that id
    alone. Rows with a NULL doc_id come first; rows that repeat an id follow
    each other in an order given by their text. Other columns are not kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = _encoder(tokenizer).encode, np.array([end_id], "<u4").tobytes()
        for batch in small_batches(batches, 1):
            packed = [encode(t or "") + end for t in batch.column(1).to_pylist()]
            lengths = np.fromiter((len(p) // 4 for p in packed), np.int64, len(packed))
            offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
            ids = np.frombuffer(b"".join(packed), "<i4")
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["doc_id", "ids"])

    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    order = [F.col("doc_id"), F.xxhash64("text")]
    ordered = given.repartitionByRange(*order).sortWithinPartitions(*order)
    encoded = ordered.mapInArrow(run, "doc_id long, ids array<int>")
    placed = encoded.select(
        "doc_id", F.spark_partition_id().alias("file"), F.monotonically_increasing_id().alias("place"), "ids"
    )
    placed.write.options(**WRITE_OPTIONS).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The token table. Filters on doc_id and the choice of columns reach the files."""
    return spark.read.schema(TOKEN_SCHEMA).parquet(path)


def offsets(tokens: DataFrame) -> DataFrame:
    """Per document: doc_id, start, n_tokens, ids_crc32, read from a token table.

    ``start`` counts the ids of all documents before it. Sums run within each
    file; the files' own sums, one row per file, are added up apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            ids, at = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4"), lists.offsets.to_numpy()
            at = at - at[0]
            sums = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(np.diff(at).astype(np.int64)), pa.array(sums, pa.int64())],
                ["doc_id", "file", "place", "n_tokens", "ids_crc32"],
            )

    each = tokens.mapInArrow(run, "doc_id long, file int, place long, n_tokens long, ids_crc32 long")
    upto = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    of_file = tokens.groupBy("file").agg(F.sum(F.size("ids")).alias("n"))
    before = of_file.select(F.col("file").alias("_file"), F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("_before"))
    within = Window.partitionBy("file").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    summed = each.withColumn("_within", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    return summed.join(before, summed["file"] == before["_file"]).select(
        "doc_id", (F.col("_before") + F.col("_within")).cast("long").alias("start"), "n_tokens", "ids_crc32"
    )
