"""Toxic spans by a linear-chain conditional random field, and document scores from them.

The labels are of documents. A small set of word and prefix features that
together explain the toxic documents of the sample, and that clean documents
lack, marks the toxic tokens to learn from. The field has two states; its
forward-backward marginals say how likely each token is toxic. A document's
score follows from its most suspicious token, calibrated on the sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import (
    carried,
    hash_words,
    prefix_hashes,
    sent_if_small,
    separator_table,
    small_batches,
    smallest_draws,
    staged,
    utf8_rows,
    with_fields,
)

# Tokens are runs of digits, letters and whatever lies beyond ASCII, in lower case.
TOKEN_TABLE = separator_table(bytes(b for b in range(128) if not chr(b).isalnum()), lower=True)
PREFIXES = (4, 5, 6)
FEATURE_BITS = 20
KINDS = 1 + len(PREFIXES)
# Texts above this size are not learned from unless ``fit`` is told otherwise; they are scored like all others.
MOST_LEARNED_BYTES = 200_000
# Tokens on either side of a marked one that the field learns from.
CONTEXT = 10
_CLIP = 25.0
_MOST_ODDS = 1e12
# Tokens of a long text that are walked one after the other; runs advance side by side.
RUN_TOKENS = 512


@dataclass
class Tokens:
    """Tokens of several texts, one after the other; ``begins`` has one entry more than there are texts."""

    features: np.ndarray  # a row of KINDS feature numbers per token
    begins: np.ndarray
    starts: np.ndarray  # byte offsets in the joined texts
    ends: np.ndarray
    offsets: np.ndarray  # where each text starts in the joined texts


def tokens_of(rows: list[bytes]) -> Tokens:
    text = b" ".join(row.translate(TOKEN_TABLE) for row in rows)
    offsets = np.concatenate([[0], np.cumsum(np.fromiter((len(r) + 1 for r in rows), np.int64, len(rows)))])
    starts, ends, words = hash_words(text)
    hashes = [words, *prefix_hashes(text, starts, ends, PREFIXES)] if len(words) else [words] * KINDS
    features = np.stack([(h >> np.uint64(64 - FEATURE_BITS)).astype(np.int32) for h in hashes], axis=1)
    return Tokens(features, np.searchsorted(starts, offsets), starts, ends, offsets)


@dataclass
class Field:
    """State 1 is toxic. ``transition[i, j]`` and ``start`` are factors, emissions the odds of state 1."""

    weights: np.ndarray
    bias: float
    start: float
    transition: np.ndarray
    slope: float = 1.0
    intercept: float = 0.0

    def emission(self, features: np.ndarray) -> np.ndarray:
        return np.exp(np.clip(self.weights[features].sum(axis=1) + self.bias, -_CLIP, _CLIP).astype(np.float64))

    def document_score(self, most: np.ndarray) -> np.ndarray:
        odds = np.log(np.clip(most, 1e-9, 1 - 1e-9)) - np.log1p(-np.clip(most, 1e-9, 1 - 1e-9))
        return 1 / (1 + np.exp(-np.clip(self.slope * odds + self.intercept, -_CLIP, _CLIP)))


def _chain(emission: np.ndarray, first: np.ndarray, lengths: np.ndarray, coming: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """Per token what comes in from the token before it, for texts that begin at ``first``.

    ``coming`` is that of each text's first token. The odds after a token are
    what comes in times its emission; all texts advance together, one token a step, the longest first.
    """
    out = np.ones(len(emission))
    order = np.argsort(-lengths, kind="stable")
    first, lengths, r = first[order], lengths[order], coming[order]
    # How many texts have a token at step t.
    active = len(lengths) - np.searchsorted(lengths[::-1], np.arange(1, (lengths[0] if len(lengths) else 0) + 1))
    (t00, t01), (t10, t11) = transition
    for t, n in enumerate(active):
        at = first[:n] + t
        r = r[:n] if t == 0 else np.minimum((t01 + t11 * r[:n]) / (t00 + t10 * r[:n]), _MOST_ODDS)
        out[at] = r
        r = np.minimum(r * emission[at], _MOST_ODDS)
    return out


def _through(emission: np.ndarray, first: np.ndarray, lengths: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """Per run of tokens the matrix that takes the odds before it to those after it, up to a factor."""
    product = np.tile(np.eye(2), (len(first), 1, 1))
    for t in range(int(lengths.max(initial=0))):
        some = np.flatnonzero(lengths > t)
        e = emission[first[some] + t]
        # Odds r become e (t01 + t11 r) / (t00 + t10 r).
        step = np.empty((len(some), 2, 2))
        step[:, 0, 0], step[:, 0, 1] = e * transition[1, 1], e * transition[0, 1]
        step[:, 1, 0], step[:, 1, 1] = transition[1, 0], transition[0, 0]
        moved = step @ product[some]
        product[some] = moved / moved.max(axis=(1, 2), keepdims=True)
    return product


def _coming(emission: np.ndarray, begins: np.ndarray, start: float, transition: np.ndarray) -> np.ndarray:
    """``_chain`` for whole texts, the long ones cut into runs.

    The matrices of a text's runs, multiplied in order, say what comes in at
    each run; the runs then advance side by side. So the number of steps does not grow with
    the longest text but with its number of runs, and with the length of a run.
    """
    lengths = np.diff(begins)
    texts = np.flatnonzero(lengths)
    runs = -(-lengths[texts] // RUN_TOKENS)
    of_text = np.repeat(np.arange(len(texts)), runs)
    place = np.arange(len(of_text)) - np.repeat(np.cumsum(runs) - runs, runs)
    first = begins[:-1][texts][of_text] + place * RUN_TOKENS
    size = np.minimum(RUN_TOKENS, begins[1:][texts][of_text] - first)
    coming = np.full(len(first), start)
    inner = np.flatnonzero(place > 0)
    if len(inner):
        leading = inner - 1  # all runs but each text's last
        through = np.tile(np.eye(2), (len(first), 1, 1))
        later = leading[place[leading] > 0]
        through[later] = _through(emission, first[later], size[later], transition)
        opening = np.flatnonzero((place == 0) & (runs[of_text] > 1))
        ahead = np.ones(len(first))
        # The first run's own odds at its end; the start stands for what comes in there.
        cut = np.concatenate([np.arange(first[i], first[i] + size[i]) for i in opening])
        at = np.concatenate([[0], np.cumsum(size[opening])[:-1]]).astype(np.int64)
        inside = _chain(emission[cut], at, size[opening], np.full(len(opening), start), transition)
        end = at + size[opening] - 1
        ahead[opening] = np.minimum(inside[end] * emission[cut][end], _MOST_ODDS)
        (t00, t01), (t10, t11) = transition
        for k in range(1, int(place.max()) + 1):
            now = np.flatnonzero(place == k)
            r = ahead[now - 1]
            coming[now] = np.minimum((t01 + t11 * r) / (t00 + t10 * r), _MOST_ODDS)
            m = through[now]
            ahead[now] = np.minimum((m[:, 0, 0] * r + m[:, 0, 1]) / (m[:, 1, 0] * r + m[:, 1, 1]), _MOST_ODDS)
    return _chain(emission, first, size, coming, transition)


def forward_backward(emission: np.ndarray, begins: np.ndarray, field: Field) -> tuple[np.ndarray, np.ndarray]:
    """Per token the odds of state 1 given the tokens before and itself, and given those after."""
    forward = np.minimum(emission * _coming(emission, begins, field.start, field.transition), _MOST_ODDS)
    # Read from the end, with transitions the other way, the chain is one of the same kind.
    back = len(emission) - begins[::-1]
    return forward, _coming(emission[::-1], back, 1.0, field.transition.T)[::-1]


def marginals(emission: np.ndarray, begins: np.ndarray, field: Field) -> np.ndarray:
    forward, backward = forward_backward(emission, begins, field)
    odds = forward * backward
    return odds / (1 + odds)


def maxima(values: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The largest value of each text; 0 for a text without tokens."""
    out = np.zeros(len(begins) - 1)
    some = np.flatnonzero(np.diff(begins))
    if len(some):
        out[some] = np.maximum.reduceat(values, begins[:-1][some])
    return out


def telling_features(features: np.ndarray, begins: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Features that clean texts hardly have, chosen greedily until they cover the toxic texts.

    Each step takes the feature found in most toxic texts not yet covered.
    What is common to a few copies of one text therefore never gets ahead of
    what many different toxic texts share. Features that many toxic texts and
    next to no clean ones have are added even where others cover those texts.
    """
    doc = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
    size = 1 << FEATURE_BITS
    pairs = np.unique(np.concatenate([doc * np.int64(size) + features[:, k] for k in range(features.shape[1])]))
    doc, feature = pairs // size, pairs % size
    in_toxic = np.bincount(feature[toxic[doc]], minlength=size)
    in_clean = np.bincount(feature[~toxic[doc]], minlength=size)
    least = max(3, int(0.004 * toxic.sum()))
    telling = (in_toxic >= least) & (in_clean <= 0.002 * (~toxic).sum())
    use = telling[feature] & toxic[doc]
    doc, feature = doc[use], feature[use]
    chosen = np.flatnonzero((in_toxic >= max(20, 0.02 * toxic.sum())) & (in_clean * 50 <= in_toxic)).tolist()
    while len(feature):
        gain = np.bincount(feature)
        best = int(gain.argmax())
        if gain[best] < least:
            break
        chosen.append(best)
        left = ~np.isin(doc, doc[feature == best])
        doc, feature = doc[left], feature[left]
    return np.array(chosen, np.int64)


def _windows(marked: np.ndarray, begins: np.ndarray, rng: np.random.Generator, per_text: int = 2) -> list[tuple[int, int]]:
    """Ranges of tokens to learn from: around marked tokens, and anywhere in each text."""
    found = []
    for start, end in zip(begins[:-1].tolist(), begins[1:].tolist()):
        if end == start:
            continue
        own = np.flatnonzero(marked[start:end]) + start
        spots = rng.permutation(own)[:per_text].tolist() + rng.integers(start, end, per_text).tolist()
        found += [(max(start, s - CONTEXT), min(end, s + CONTEXT + 1)) for s in spots]
    return found


def fit_field(features: np.ndarray, begins: np.ndarray, states: np.ndarray, rounds: int = 60, rate: float = 0.5) -> Field:
    """Maximum likelihood with a quadratic penalty, by gradient steps scaled per weight."""
    size = 1 << FEATURE_BITS
    # Start where marked tokens are rare and spans short.
    emit, trans, start = np.zeros(size), np.log(np.array([[0.95, 0.05], [0.6, 0.4]])), np.log(0.05)
    bias = -1.0
    squares = [np.full(size, 1e-6), np.full((2, 2), 1e-6), 1e-6, 1e-6]
    n = max(1, len(states))
    same = np.ones(len(states), bool)
    same[begins[1:][begins[1:] > 0] - 1] = False
    at = np.flatnonzero(same)
    opening = begins[:-1][np.diff(begins) > 0]
    for _ in range(rounds):
        field = Field(emit, bias, float(np.exp(start)), np.exp(trans))
        emission = field.emission(features)
        forward, backward = forward_backward(emission, begins, field)
        p = forward * backward / (1 + forward * backward)
        miss = p - states
        g_emit = sum(np.bincount(features[:, k], miss, size) for k in range(features.shape[1])) / n + 1e-6 * emit
        x = emission[at + 1] * backward[at + 1]
        joint = np.stack([np.ones(len(at)), x, forward[at], forward[at] * x]) * field.transition.reshape(4, 1)
        joint /= joint.sum(axis=0)
        seen = np.bincount((2 * states[at] + states[at + 1]).astype(np.int64), minlength=4)
        g_trans = (joint.sum(axis=1) - seen).reshape(2, 2) / n
        grads = [g_emit, g_trans, miss[opening].sum() / n, miss.sum() / n]
        squares = [s + g * g for s, g in zip(squares, grads)]
        steps = [rate * g / np.sqrt(s) for s, g in zip(squares, grads)]
        emit, trans, start, bias = emit - steps[0], trans - steps[1], start - steps[2], bias - steps[3]
    return Field(emit.astype(np.float32), float(bias), float(np.exp(start)), np.exp(trans))


def calibrate(field: Field, most: np.ndarray, toxic: np.ndarray, prior: float) -> Field:
    """Slope and intercept of the document score by logistic regression, for the given share of toxic texts."""
    clipped = np.clip(most, 1e-9, 1 - 1e-9)
    x = np.stack([np.log(clipped) - np.log1p(-clipped), np.ones(len(most))], axis=1)
    share = max(toxic.mean(), 1e-9)
    weight = np.where(toxic, prior / share, (1 - prior) / max(1 - share, 1e-9))
    beta = np.array([0.5, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -_CLIP, _CLIP)))
        gradient = x.T @ (weight * (p - toxic)) + 0.1 * beta
        step = np.linalg.solve((x.T * (weight * p * (1 - p) + 1e-6)) @ x + 0.1 * np.eye(2), gradient)
        beta = beta - np.clip(step, -1, 1)
    return Field(field.weights, field.bias, field.start, field.transition, float(max(beta[0], 1e-3)), float(beta[1]))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    label: str = "toxic",
    per_class: int = 800,
    most_bytes: int = MOST_LEARNED_BYTES,
) -> Field:
    """Learn from ``labels`` (doc_id, label 0 or 1) and the texts of those ids.

    The field sees at most ``per_class`` documents of each label, picked by a
    hash of id and text among those with a text of at most ``most_bytes``: the
    bounds of the operator, and of what is learned from alone. Rows that repeat an id and a text count once. NULL ids and labels are
    passed over; of labels that contradict each other the higher counts.
    Without a toxic or without a clean text of that size every score is the share of toxic labels.
    """
    known = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull())
    known = known.groupBy(F.col(doc_id).cast("long").alias("id")).agg((F.max(label) > 0).cast("int").alias("toxic"))
    known = staged(known, "labels")
    short = docs.where(F.octet_length(F.col(text)) <= most_bytes)
    short = short.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("hash"))
    # Rows that repeat an id and a text count once.
    contents = staged(short.select("id", "hash").join(known, "id").distinct(), "contents")
    sample = smallest_draws(contents, "toxic", ["id", "hash"], per_class)
    shares = dict(known.groupBy("toxic").count().collect())
    prior = shares.get(1, 0) / max(1, sum(shares.values()))

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 2):
            rows = utf8_rows(batch.column(2))
            found = tokens_of(rows)
            parts = [found.features[a:b].ravel() for a, b in zip(found.begins[:-1], found.begins[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(parts, pa.list_(pa.int32()))], ["doc_id", "toxic", "features"]
            )

    # At most ``per_class`` rows of each label.
    given = short.join(sent_if_small(sample), ["id", "hash"]).dropDuplicates(["id", "hash"]).orderBy("id", "hash").select("id", "toxic", "text")
    got = given.mapInArrow(featurise, "doc_id long, toxic int, features array<int>").toArrow()
    lists = got.column("features").combine_chunks()
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    toxic = got.column("toxic").to_numpy() > 0
    blank = Field(np.zeros(1 << FEATURE_BITS, np.float32), -_CLIP, 1e-9, np.ones((2, 2)))
    if not toxic.any() or toxic.all():
        p = min(max(prior, 1e-9), 1 - 1e-9)
        return Field(blank.weights, blank.bias, blank.start, blank.transition, 0.0, float(np.log(p / (1 - p))))
    features = lists.flatten().to_numpy().reshape(-1, KINDS)
    begins = np.concatenate([[0], np.cumsum([len(x) // KINDS for x in lists])])
    chosen = telling_features(features, begins, toxic)
    is_telling = np.zeros(1 << FEATURE_BITS, bool)
    is_telling[chosen] = True
    marked = is_telling[features].any(axis=1) & np.repeat(toxic, np.diff(begins))
    windows = _windows(marked, begins, np.random.Generator(np.random.PCG64(7)))
    at = np.concatenate([np.arange(a, b) for a, b in windows])
    upto = np.concatenate([[0], np.cumsum([b - a for a, b in windows])])
    field = fit_field(features[at], upto, marked[at].astype(np.float64))
    most = maxima(marginals(field.emission(features), begins, field), begins)
    return calibrate(field, most, toxic, prior)


def score(
    docs: DataFrame, field: Field, keep: list[str] | None = None, text: str = "text", span_at: float = 0.5
) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all by default) with ``score``, ``predicted`` and ``spans``.

    ``spans`` lists the toxic stretches as offsets in characters, the end not
    included: neighbouring tokens whose marginal is at least ``span_at``. NULL
    and empty texts have no span and the score of a text without any sign.
    """
    added = ("score", "predicted", "spans")
    keep = [c for c in (docs.columns if keep is None else keep) if c not in added]
    shared = docs.sparkSession.sparkContext.broadcast(field)
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in small_batches(batches, 1, 6 << 20):
            rows = utf8_rows(batch.column(1))
            found = tokens_of(rows)
            p = marginals(own.emission(found.features), found.begins, own)
            scores = own.document_score(maxima(p, found.begins))
            spans: list[list] = [[] for _ in rows]
            hot = np.flatnonzero(p >= span_at)
            for i in np.unique(np.searchsorted(found.begins, hot, side="right") - 1).tolist():
                spans[i] = _spans(found, p, i, rows[i], span_at)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32)), pa.array(spans, span_type)],
                ["row", *added],
            )

    given = docs.select(carried(keep).alias("row"), F.col(text).alias("text"))
    schema = with_fields(given.select("row").schema, "score double, predicted int, spans array<struct<start: long, end: long>>")
    scored = given.mapInArrow(run, schema)
    return scored.select(*(F.col("row")[c].alias(c) for c in keep), *added)


def _spans(found: Tokens, p: np.ndarray, text: int, row: bytes, span_at: float) -> list[dict[str, int]]:
    """The spans of one text, from byte offsets to characters."""
    at = np.arange(found.begins[text], found.begins[text + 1])
    hot = np.diff(np.concatenate([[0], (p[at] >= span_at).astype(np.int8), [0]]))
    characters = np.cumsum((np.frombuffer(row, np.uint8) & 0xC0) != 0x80)
    out = []
    for first, last in zip(at[np.flatnonzero(hot[:-1] == 1)], at[np.flatnonzero(hot[1:] == -1)]):
        start, end = (int(x) - int(found.offsets[text]) for x in (found.starts[first], found.ends[last]))
        out.append({"start": int(characters[start]) - 1, "end": int(characters[end - 1])})
    return out
