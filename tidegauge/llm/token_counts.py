"""Token counts without merging what is one token anyway.

Byte-level vocabularies cut a text into pieces and merge each piece alone, so a
piece counts the same wherever it stands. For every string of the vocabulary it
is proved beforehand, by encoding it alone, whether it comes out as one token.
Pieces among the proved ones count one; only the rest are merged.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from tidegauge.llm.common import carried, small_batches, utf8_rows, with_fields

LIMIT = 512
# Merged pieces remembered per worker process, and the longest of them; others are merged again.
CACHE_PIECES, CACHE_LENGTH = 200_000, 64
# Characters handled at once, if the text has a place to be cut.
CHUNK = 1 << 20
_CUT = re.compile(r"(?<=[0-9A-Za-z.,;:!?]) ")
_PLANE = 1 << 16


@dataclass(frozen=True)
class Shortcut:
    """What was proved of a vocabulary: the strings that are one token, and the patterns of its pieces in ASCII and below U+10000."""

    path: str
    whole: frozenset[str]
    plain: str
    pattern: str
    special: tuple[str, ...]


def _as_class(points: np.ndarray) -> str:
    """Sorted code points as the inside of a character class."""
    breaks = np.flatnonzero(np.diff(points) > 1)
    firsts = points[np.concatenate([[0], breaks + 1])] if len(points) else []
    lasts = points[np.concatenate([breaks, [len(points) - 1]])] if len(points) else []
    return "".join(f"\\u{a:04x}" if a == b else f"\\u{a:04x}-\\u{b:04x}" for a, b in zip(firsts, lasts))


def _joins(pre: pre_tokenizers.PreTokenizer, lead: str, points: list[int]) -> np.ndarray:
    """Which of the characters stay in one piece with the last character of ``lead``."""
    probe = "".join(f"{lead}{chr(p)}" for p in points)
    starts = np.fromiter((span[0] for _, span in pre.pre_tokenize_str(probe)), np.int64)
    begins = np.zeros(len(probe) + 1, bool)
    begins[starts] = True
    step = len(lead) + 1
    return ~begins[len(lead) : len(probe) : step]


def _pieces_pattern(pre: pre_tokenizers.PreTokenizer, below: int) -> str:
    """The pieces of a byte-level tokenizer, with its own classes of characters: each one ``below`` is put to it.

    Letters go on after a letter, digits after a digit, signs after a sign; what goes on after none is blank.
    """
    points = [p for p in range(below) if not 0xD800 <= p < 0xE000]
    at = np.array(points)
    letter, digit, sign = (_joins(pre, lead, points) for lead in ("1a", "a1", "a!"))
    letters, digits = _as_class(at[letter]), _as_class(at[digit])
    blanks = _as_class(at[~(letter | digit | sign)])
    return (
        f" ?[{letters}]+| ?[{digits}]+|'(?:[sdmt]|ll|re|ve)| ?[^{blanks}{letters}{digits}]+"
        f"|[{blanks}]+(?![^{blanks}])|[{blanks}]+"
    )


def prove(path: str) -> Shortcut:
    """Find the strings of a byte-level vocabulary that encode alone as one token; done once, outside of tasks.

    A string that is one token is also one piece, since tokens never reach over
    pieces. Vocabularies of other kinds raise ValueError.
    """
    tokenizer = Tokenizer.from_file(path)
    level = tokenizer.pre_tokenizer
    if not isinstance(level, pre_tokenizers.ByteLevel) or level.add_prefix_space or not level.use_regex or tokenizer.normalizer:
        raise ValueError(f"{path} is no plain byte-level vocabulary")
    tokenizer.no_truncation()
    tokenizer.no_padding()
    special = tuple(sorted((t.content for t in tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True))
    own = [(i, tokenizer.decode([i], skip_special_tokens=False)) for i in tokenizer.get_vocab(with_added_tokens=False).values()]
    own = [(i, text) for i, text in own if text and "�" not in text and not any(s in text for s in special)]
    encoded = tokenizer.encode_batch([text for _, text in own], add_special_tokens=False)
    whole = frozenset(text for (i, text), e in zip(own, encoded) if e.ids == [i])
    return Shortcut(path, whole, _pieces_pattern(level, 1 << 7), _pieces_pattern(level, _PLANE), special)


class _Costs(dict):
    """Tokens per piece: one for the proved pieces; others are merged, and remembered while there is room."""

    def __init__(self, whole: frozenset[str], merger: Tokenizer) -> None:
        super().__init__(dict.fromkeys(whole, 1))
        self._merger, self._most = merger, len(whole) + CACHE_PIECES

    def __missing__(self, piece: str) -> int:
        n = len(self._merger.encode(piece, add_special_tokens=False).ids)
        if len(piece) <= CACHE_LENGTH and len(self) < self._most:
            self[piece] = n
        return n


class TokenCounter:
    """Counts the tokens of whole texts."""

    def __init__(self, shortcut: Shortcut) -> None:
        merger = Tokenizer.from_file(shortcut.path)
        merger.no_truncation()
        merger.no_padding()
        self._level = merger.pre_tokenizer
        # Pieces are cut already.
        merger.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self._costs = _Costs(shortcut.whole, merger)
        self._plain, self._pieces = re.compile(shortcut.plain), re.compile(shortcut.pattern)
        self._special = re.compile("|".join(map(re.escape, shortcut.special))) if shortcut.special else None
        self._high = re.compile("[\U00010000-\U0010ffff]")

    def count(self, text: str) -> int:
        """The tokens of a text, of which each special string is one."""
        if self._special is None or not self._special.search(text):
            return self._count(text)
        between = self._special.split(text)
        return len(between) - 1 + sum(map(self._count, between))

    def _count(self, text: str) -> int:
        # A blank after a character that is none always begins a piece, so a text may be cut there.
        total = at = 0
        while len(text) - at > CHUNK:
            cut = _CUT.search(text, at + CHUNK)
            if cut is None:
                break
            total += self._run(text[at : cut.start()])
            at = cut.start()
        return total + self._run(text[at:] if at else text)

    def _run(self, text: str) -> int:
        cost = self._costs.__getitem__
        if not text.isascii() and self._high.search(text):
            return sum(cost(text[a:b]) for _, (a, b) in self._level.pre_tokenize_str(text))
        pieces = self._plain if text.isascii() else self._pieces
        if len(text) > 2 * CHUNK:
            return sum(cost(m.group()) for m in pieces.finditer(text))
        return sum(map(cost, pieces.findall(text)))


@lru_cache(maxsize=1)
def _counter(shortcut: Shortcut) -> TokenCounter:
    return TokenCounter(shortcut)


def count_tokens(
    docs: DataFrame, shortcut: Shortcut, limit: int = LIMIT, keep: list[str] | None = None, text: str = "text"
) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all by default) with n_bytes, n_tokens and over_limit.

    ``n_bytes`` counts the UTF-8 of the whole text, ``over_limit`` tells more
    than ``limit`` tokens. NULL and empty texts have none of either. Every row
    comes back once; kept columns of the names added are replaced.
    """
    added = ("n_bytes", "n_tokens", "over_limit")
    keep = [c for c in (docs.columns if keep is None else keep) if c not in added]
    # Bounded by the vocabulary.
    shared = docs.sparkSession.sparkContext.broadcast(shortcut)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(shared.value)
        for batch in small_batches(batches, 1):
            rows = utf8_rows(batch.column(1))
            tokens = np.fromiter((counter.count(r.decode("utf-8", "replace")) for r in rows), np.int64, len(rows))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(r) for r in rows], pa.int64()), pa.array(tokens), pa.array(tokens > limit)],
                ["row", *added],
            )

    given = docs.select(carried(keep).alias("row"), F.col(text).cast("string").alias("text"))
    schema = with_fields(given.select("row").schema, "n_bytes long, n_tokens long, over_limit boolean")
    counted = given.mapInArrow(run, schema)
    return counted.select(*(F.col("row")[c].alias(c) for c in keep), *added)
