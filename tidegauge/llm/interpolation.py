"""Language-model scores by deleted interpolation.

    P_k(w | context) = a * count(context w) / count(context) + (1 - a) * P_(k-1)(w | shorter context)

down to equal shares for all known words and one unknown. The weight ``a``
depends on the order and on how often the context was seen, in powers of two.
Part of the learning texts is held out of the counts; on it the weights are
learned by expectation-maximisation, and then its counts are added.

Counting without moving a row per word: texts are packed in blocks of a few
megabytes. A block asks once for each different n-gram in it, as sorted 64-bit
hashes, cut into ranges of the hash. All questions about a range meet in one
task, which adds up their counts and answers in the same order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import SPACED_LOWER, hash_rows, mix64, small_batches, staged, utf8_rows

BEGIN, END = np.uint64(0x42454749), np.uint64(0x454E44)
_STEP = np.uint64(0x9E3779B97F4A7C15)

# Roles of a text: counted, held out of the counts at first, not learned from.
COUNTED, HELD, UNSEEN = 0, 1, 2

BLOCK_BYTES = 4 << 20
# A row group per block: writers and readers hold a whole one, and Parquet looks at its size, as compressed, only every hundred rows.
_BLOCK_FILES = {"compression": "zstd", "parquet.block.row.count.limit": "1"}
# About so many words' n-grams meet in one task.
RANGE_TOKENS = 500_000
# Steps per power of two in which likelihood ratios are tallied for the weights.
RATIO_STEPS = 8
_ZERO = -(1 << 20)

_BLOCKS = "block long, held boolean, learned long, tokens long, doc_ids array<long>, roles array<int>, texts binary"
_QUESTIONS = "part int, size int, block long, held boolean, keys binary, counts binary"
_ANSWERS = "part int, size int, block long, held boolean, vocabulary long, counted binary, everything binary"


_TYPES = {
    "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(),
    "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()),
}


def _arrow_schema(ddl: str) -> pa.Schema:
    return pa.schema([(name, _TYPES[kind]) for name, kind in (column.split() for column in ddl.split(", "))])


_BLOCKS_ARROW, _QUESTIONS_ARROW, _ANSWERS_ARROW = (_arrow_schema(s) for s in (_BLOCKS, _QUESTIONS, _ANSWERS))


def packed(values: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as the largest needs, all first bytes, then all second ones, and so on.

    Bytes of like weight are alike, so they compress well where the numbers themselves do not.
    """
    most = int(values.max(initial=0))
    width = next(w for w in (1, 2, 4, 8) if most < 1 << 8 * w)
    return np.ascontiguousarray(values.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T).tobytes()


def unpacked(data: bytes, n: int) -> np.ndarray:
    """The ``n`` numbers of ``packed``, in the narrowest type that holds them."""
    if not n:
        return np.zeros(0, np.uint8)
    width = len(data) // n
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, n).T).view(f"<u{width}").ravel()


def _pack(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text, role) as blocks of texts in lower case, one per line. Held-out texts have blocks of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        open_: dict[bool, list] = {False: [], True: []}
        size = {False: 0, True: 0}

        def close(held: bool) -> pa.RecordBatch:
            nonlocal block
            ids, roles, texts, tokens = zip(*open_[held])
            block += 1
            learned = sum(t for t, r in zip(tokens, roles) if r != UNSEEN)
            values = [block, held, learned, sum(tokens), list(ids), list(roles), b"\n".join(texts)]
            open_[held], size[held] = [], 0
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, _BLOCKS_ARROW)], schema=_BLOCKS_ARROW)

        for batch in small_batches(batches, 1):
            texts = [t.translate(SPACED_LOWER) for t in utf8_rows(batch.column(1))]
            _, begins = hash_rows(texts)
            counts = (np.diff(begins) + 1).tolist()
            for own, text, role, n in zip(batch.column(0).to_pylist(), texts, batch.column(2).to_pylist(), counts):
                held = role == HELD
                if open_[held] and size[held] + len(text) > BLOCK_BYTES:
                    yield close(held)
                open_[held].append((own, role, text, n))
                size[held] += len(text)
        for held in (False, True):
            if open_[held]:
                yield close(held)

    return staged(docs.mapInArrow(run, _BLOCKS), "blocks", **_BLOCK_FILES)


@dataclass
class Grams:
    """The n-grams of a block: per size its sorted different hashes, and which of them ends at each position."""

    real: np.ndarray  # positions that are words or text ends, not padding
    doc: np.ndarray  # document of each position
    keys: dict[int, np.ndarray] = field(default_factory=dict)
    at: dict[int, np.ndarray] = field(default_factory=dict)


def _grams(texts: bytes, documents: int, order: int) -> Grams:
    """Each text is led by ``order`` - 1 begin marks and closed by an end mark.

    Only the n-grams that end in a token or right before a text's first one
    are there: a context is seen as often as a token follows it.
    """
    hashes, begins = hash_rows(texts.split(b"\n") if documents > 1 else [texts])
    lengths, lead = np.diff(begins), order - 1
    total = lengths + 1 + lead
    first = np.cumsum(total) - total
    tokens = np.full(int(total.sum()), BEGIN, np.uint64)
    tokens[np.arange(len(hashes)) + np.repeat(first + lead - begins[:-1], lengths)] = hashes
    tokens[first + total - 1] = END
    doc = np.repeat(np.arange(documents), total)
    within = np.arange(len(tokens)) - np.repeat(first, total)
    out = Grams(within >= lead, doc)
    gram = mix64(tokens)
    for size in range(1, order + 1):
        if size > 1:
            gram = np.concatenate([gram[:1], mix64(gram[:-1] * _STEP + tokens[1:])])
        valid = within >= max(size, lead) - 1
        out.keys[size], inverse = np.unique(gram[valid], return_inverse=True)
        out.at[size] = np.full(len(tokens), -1, np.int32)
        out.at[size][valid] = inverse.ravel()
    return out


def _ranges(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each hash range begins in sorted keys; one entry more than there are ranges."""
    bounds = np.array([-(-(i << 64) // parts) for i in range(1, parts)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, bounds), [len(keys)]])


def _ask(blocks: DataFrame, order: int, parts: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                block, held, _, _, _, roles, texts = (batch.column(i)[row].as_py() for i in range(7))
                grams = _grams(texts, len(roles), order)
                learned = np.array([r != UNSEEN for r in roles])[grams.doc]
                for size, keys in grams.keys.items():
                    at = grams.at[size]
                    counts = np.bincount(at[learned & (at >= 0)], minlength=len(keys))
                    cut = _ranges(keys, parts)
                    some = np.flatnonzero(np.diff(cut))
                    n = len(some)
                    pieces = [slice(cut[p], cut[p + 1]) for p in some]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(some, pa.int32()), pa.array([size] * n, pa.int32()), pa.array([block] * n, pa.int64()),
                         pa.array([held] * n, pa.bool_()), pa.array([_key_bytes(keys[p]) for p in pieces], pa.binary()),
                         pa.array([packed(counts[p]) for p in pieces], pa.binary())],
                        schema=_QUESTIONS_ARROW,
                    )

    return blocks.mapInArrow(run, _QUESTIONS)


def _key_bytes(keys: np.ndarray) -> bytes:
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _answer(asked: pa.Table) -> pa.Table:
    """Add up the counts of one hash range and give every block the sums for its own n-grams.

    A block of held-out texts is told the sums without and with such texts, any
    other only the latter.
    """
    held = asked.column("held").to_pylist()
    told = [k.as_buffer() for chunk in asked.column("keys").chunks for k in chunk]
    lengths = [len(k) // 8 for k in told]
    keys = np.empty(sum(lengths), np.uint64)
    counts = [np.zeros(len(keys), np.uint32), np.zeros(len(keys), np.uint32)]
    start = 0
    for own, n, is_held, c in zip(told, lengths, held, (c for chunk in asked.column("counts").chunks for c in chunk)):
        keys[start : start + n] = np.ascontiguousarray(np.frombuffer(own, np.uint8).reshape(8, n).T).view("<u8").ravel()
        counts[is_held][start : start + n] = unpacked(c.as_buffer(), n)
        start += n
    unique, at = np.unique(keys, return_inverse=True)
    del keys, told
    at = at.ravel()
    counted, extra = (np.bincount(at, c, len(unique)).astype(np.int64) for c in counts)
    del counts
    everything = counted + extra
    vocabulary = 0
    if asked.column("size")[0].as_py() == 1:
        begin = mix64(np.array([BEGIN]))[0]
        vocabulary = int(((everything > 0) & (unique != begin)).sum())
    del unique, extra
    start, answers = 0, ([], [])
    for n, is_held in zip(lengths, held):
        own = at[start : start + n]
        answers[0].append(packed(counted[own]) if is_held else b"")
        answers[1].append(packed(everything[own]))
        start += n
    return pa.table(
        [*(asked.column(c) for c in ("part", "size", "block", "held")), pa.array([vocabulary] + [0] * (len(held) - 1), pa.int64()),
         *(pa.array(a, pa.binary()) for a in answers)],
        schema=_ANSWERS_ARROW,
    )


@dataclass(frozen=True)
class Model:
    """Totals, and per order the weight of its estimate by context-frequency bucket."""

    order: int
    tokens: int
    vocabulary: int
    weights: dict[int, np.ndarray] = field(default_factory=dict)

    def weight(self, size: int, bucket: np.ndarray) -> np.ndarray:
        known = self.weights[size]
        return known[np.minimum(bucket, len(known) - 1)]


def _bucket(count: np.ndarray) -> np.ndarray:
    """0 for a context never seen, else one more than the whole part of its count's binary logarithm."""
    return np.frexp(count.astype(np.float64))[1]


def _estimates(grams: Grams, counts: dict[int, np.ndarray], size: int, tokens: int) -> tuple[np.ndarray, np.ndarray]:
    """Per word of the block: the maximum-likelihood estimate of this order, and the bucket of its context."""
    real = np.flatnonzero(grams.real)
    own = counts[size][grams.at[size][real]]
    if size == 1:
        context = np.full(len(real), tokens, np.int64)
    else:
        context = counts[size - 1][grams.at[size - 1][real - 1]]
    return own / np.maximum(context, 1), _bucket(context)


def _probability(grams: Grams, counts: dict[int, np.ndarray], model: Model, upto: int) -> np.ndarray:
    p = np.full(int(grams.real.sum()), 1.0 / (model.vocabulary + 1))
    for size in range(1, upto + 1):
        estimate, bucket = _estimates(grams, counts, size, model.tokens)
        a = model.weight(size, bucket)
        p = a * estimate + (1 - a) * p
    return p


def _told(answers: pa.Table, grams: Grams, column: str, parts: int) -> dict[int, np.ndarray]:
    """Counts per size, in the order of the block's keys."""
    rows = sorted(zip(*(answers.column(c).to_pylist() for c in ("size", "part", column))), key=lambda row: row[:2])
    out = {}
    for size, keys in grams.keys.items():
        lengths = np.diff(_ranges(keys, parts))
        out[size] = np.concatenate([unpacked(data, lengths[part]) for own, part, data in rows if own == size] or [np.zeros(0)]).astype(np.int64)
    return out


def fit_weights(tally: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Per bucket the weight that makes held-out words likeliest, by expectation-maximisation.

    Rows of ``tally``: bucket, step of the ratio of the estimate to the lower
    order's probability (``_ZERO`` for an estimate of zero), words. A bucket
    without words takes the weight of the next lower one.
    """
    if not len(tally):
        return np.zeros(1)
    weights = np.zeros(int(tally[:, 0].max()) + 1)
    for bucket in range(len(weights)):
        own = tally[tally[:, 0] == bucket]
        if not len(own):
            weights[bucket] = weights[bucket - 1] if bucket else 0.0
            continue
        ratio = np.where(own[:, 1] <= _ZERO, 0.0, np.exp2(own[:, 1] / RATIO_STEPS))
        a = 0.5
        for _ in range(rounds):
            a = float((own[:, 2] * (a * ratio / (a * ratio + 1 - a))).sum() / own[:, 2].sum())
            a = min(max(a, 1e-9), 1 - 1e-6)
        weights[bucket] = a if bucket else 0.0
    return weights


def _learn(blocks: DataFrame, answers: DataFrame, model: Model, size: int, parts: int) -> np.ndarray:
    """The weights of one order from the held-out blocks, given those of the lower orders."""
    schema = pa.schema([("bucket", pa.int32()), ("step", pa.int32()), ("n", pa.int64())])

    def run(own: pa.Table, told: pa.Table) -> pa.Table:
        if not own.num_rows:
            return schema.empty_table()
        grams = _grams(own.column("texts")[0].as_py(), len(own.column("roles")[0]), model.order)
        counts = _told(told, grams, "counted", parts)
        lower = _probability(grams, counts, model, size - 1)
        estimate, bucket = _estimates(grams, counts, size, model.tokens)
        step = np.full(len(lower), _ZERO, np.int64)
        seen = estimate > 0
        step[seen] = np.rint(np.log2(estimate[seen] / lower[seen]) * RATIO_STEPS)
        pairs, n = np.unique(np.stack([bucket, step], axis=1), axis=0, return_counts=True)
        return pa.table([pa.array(pairs[:, 0], pa.int32()), pa.array(pairs[:, 1], pa.int32()), pa.array(n, pa.int64())], schema=schema)

    told = answers.where("held").select(F.col("block").alias("of"), "size", "part", "counted")
    tallied = (
        blocks.where("held").groupBy("block").cogroup(told.groupBy("of")).applyInArrow(run, "bucket int, step int, n long")
        .groupBy("bucket", "step").agg(F.sum("n").alias("n"))
    )
    # Buckets times steps of a logarithm: as many rows whatever the corpus.
    rows = [tuple(row) for row in tallied.collect()]
    return fit_weights(np.array(sorted(rows), np.float64).reshape(-1, 3))


def score(
    docs: DataFrame, learn: Column, hold: Column, order: int = 2, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """Per document: doc_id, n_tokens, n_known, train_tokens, base_score, score.

    ``learn`` says which rows to learn from, ``hold`` which of those to learn
    the mixture weights on; NULL means no. Words are lower-cased (A-Z) and one
    end mark closes each text. NULL and empty texts consist of the end mark.
    ``base_score`` is that of single words with half a count added to each and
    to one unknown word. Every row comes back once, repeated and NULL ids included.
    """
    role = F.when(~F.coalesce(learn, F.lit(False)), UNSEEN).when(F.coalesce(hold, F.lit(False)), HELD).otherwise(COUNTED)
    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), role.alias("role"))
    blocks = _pack(given)
    learned, counted, everything = blocks.agg(
        F.sum("learned"), F.sum(F.when(~F.col("held"), F.col("learned"))), F.sum("tokens")
    ).first()
    learned, counted = learned or 0, counted or 0
    parts = max(1, -(-(everything or 0) // RANGE_TOKENS))

    answers = _ask(blocks, order, parts).groupBy("part", "size").applyInArrow(_answer, _ANSWERS)
    answers = staged(answers, "answers", compression="zstd")
    vocabulary = answers.agg(F.sum("vocabulary")).first()[0] or 0

    weights: dict[int, np.ndarray] = {}
    for size in range(1, order + 1):
        weights[size] = _learn(blocks, answers, Model(order, counted, vocabulary, weights), size, parts)
    model = Model(order, learned, vocabulary, weights)

    names = ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    kinds = [pa.int64()] * 4 + [pa.float64()] * 2
    schema = pa.schema(list(zip(names, kinds)))

    def run(own: pa.Table, told: pa.Table) -> pa.Table:
        if not own.num_rows:
            return schema.empty_table()
        ids = own.column("doc_ids")[0].as_py()
        grams = _grams(own.column("texts")[0].as_py(), len(ids), order)
        counts = _told(told, grams, "everything", parts)
        doc = grams.doc[grams.real]
        count = counts[1][grams.at[1][grams.real]]
        base = np.log10((count + 0.5) / (learned + 0.5 * (vocabulary + 1)))
        own_score = np.log10(_probability(grams, counts, model, order))
        n = len(ids)
        columns = [
            ids, np.bincount(doc, minlength=n), np.bincount(doc, count > 0, n).astype(np.int64), np.full(n, learned),
            np.bincount(doc, base, n), np.bincount(doc, own_score, n),
        ]
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    told = answers.select(F.col("block").alias("of"), "size", "part", "everything")
    return (
        blocks.groupBy("block").cogroup(told.groupBy("of"))
        .applyInArrow(run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    )
