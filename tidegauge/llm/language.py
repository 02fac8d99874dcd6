"""Language identification in two steps: the family first, then the language within it.

Texts are seen as relative frequencies of letter trigrams. A linear support
vector machine per family (one against the rest) picks the family; within a
family one machine per pair of languages votes. The machines are fitted on a
bounded sample of labelled rows; every text is scored whole.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import carried, mix64, sample_contents, small_batches, utf8_rows, with_fields

UNKNOWN = "und"

# Language families of two-letter codes. Any other code is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "fy", "lb", "yi"),
    "romance": ("fr", "es", "pt", "it", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "mk", "sr", "hr", "bs", "sl"),
    "baltic": ("lt", "lv"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "ky", "uz", "tk"),
    "indic": ("hi", "ur", "bn", "mr", "gu", "pa", "ne"),
    "semitic": ("ar", "he", "mt", "am"),
    "sinitic": ("zh", "yue"),
    "malayic": ("id", "ms"),
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}


def family_of(language: str) -> str:
    """The family of a tag such as ``pt`` or ``pt-BR``; a code in no family and its regions form one of their own."""
    code = re.split("[-_]", language, maxsplit=1)[0].lower()
    return FAMILY_OF.get(code, code)


DIMENSION_BITS = 12
DIMENSIONS = 1 << DIMENSION_BITS
# A short text is judged by few trigrams, so each sampled text also teaches through short runs of its words.
RUNS, RUN_WORDS = 1, 8


_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: bytes) -> bool:
    decoded = text.decode("utf-8", "replace")
    return bool(_LETTER.search(decoded)) and any(map(str.isalpha, decoded))


@lru_cache(maxsize=1)
def _blanks() -> np.ndarray:
    """Per character below U+10000 whether it separates words: what is neither a letter nor a mark that belongs to one."""
    return np.array([not (unicodedata.category(chr(p))[0] in "LM") for p in range(1 << 16)])


def trigrams(text: bytes) -> np.ndarray:
    """The hashed letter trigrams of a text in lower case; what is no letter separates words as one blank."""
    if text.isascii():
        codes = np.frombuffer(b" " + text.lower() + b" ", np.uint8).astype(np.uint64)
    else:
        folded = f" {text.decode('utf-8', 'replace').lower()} "
        codes = np.frombuffer(folded.encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
    blank = _blanks()[np.minimum(codes, (1 << 16) - 1)] & (codes < 1 << 16)
    codes = np.where(blank, 0, codes)[~(blank & np.concatenate([[False], blank[:-1]]))]
    if len(codes) < 3:
        return np.zeros(0, np.int64)
    joined = (codes[:-2] << np.uint64(42)) | (codes[1:-1] << np.uint64(21)) | codes[2:]
    return (mix64(joined) >> np.uint64(64 - DIMENSION_BITS)).astype(np.int64)


@dataclass(frozen=True)
class Machine:
    """One linear machine: positive for the first group of languages, negative for the second."""

    weights: np.ndarray
    bias: float


@dataclass(frozen=True)
class LanguageModel:
    """``families`` maps a family to its languages; machines are keyed by family or by a pair of languages."""

    families: dict[str, list[str]]
    by_family: dict[str, Machine]
    by_pair: dict[tuple[str, str], Machine]

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        machines = [*self.by_family.values(), *self.by_pair.values()]
        if not machines:
            return np.zeros((DIMENSIONS, 0), np.float32), np.zeros(0, np.float32)
        return (
            np.stack([m.weights for m in machines], axis=1).astype(np.float32),
            np.array([m.bias for m in machines], np.float32),
        )

    def decide(self, margins: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Languages and scores from a row of margins per text."""
        n, names = len(margins), list(self.families)
        if not names:
            return [UNKNOWN] * n, np.zeros(n)
        of_family = margins[:, : len(self.by_family)] if self.by_family else np.zeros((n, 1))
        family = of_family.argmax(axis=1)
        score = _sigmoid(of_family.max(axis=1)) if self.by_family else np.ones(n)
        languages = np.empty(n, object)
        pair_at = {pair: len(self.by_family) + i for i, pair in enumerate(self.by_pair)}
        for i, name in enumerate(names):
            rows, members = np.flatnonzero(family == i), self.families[name]
            votes = np.zeros((len(rows), len(members)))
            certain = np.zeros((len(rows), len(members)))
            for a, b in itertools.combinations(range(len(members)), 2):
                p = _sigmoid(margins[rows, pair_at[members[a], members[b]]])
                votes[:, a] += p > 0.5
                votes[:, b] += p <= 0.5
                certain[:, a] += p
                certain[:, b] += 1 - p
            # Equal votes go to the more certain one.
            best = (votes + certain / (2 * len(members))).argmax(axis=1)
            languages[rows] = np.array(members, object)[best]
            if len(members) > 1:
                score[rows] *= certain[np.arange(len(rows)), best] / (len(members) - 1)
        return languages.tolist(), score


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(4.0 * x.astype(np.float64), -30, 30)))


@dataclass(frozen=True)
class Bags:
    """Texts as sparse rows of trigrams, one after the other; ``begins`` has one entry more than there are rows."""

    grams: np.ndarray
    values: np.ndarray
    begins: np.ndarray


def fit_machine(bags: Bags, rows: np.ndarray, positive: np.ndarray, cost: float = 10.0, passes: int = 30) -> Machine:
    """A linear machine with squared hinge loss, by dual coordinate descent with the weights kept up to date.

    Besides the bags it holds one number per row and the weights, but no product of rows with rows.
    """
    y = np.where(positive, 1.0, -1.0)
    # The smaller side weighs as much as the larger one.
    share = np.where(positive, positive.mean(), 1 - positive.mean())
    diagonal = share / (cost * 0.5)
    starts, ends = bags.begins[rows].tolist(), bags.begins[rows + 1].tolist()
    norms = np.array([1.0 + np.square(bags.values[a:b], dtype=np.float64).sum() for a, b in zip(starts, ends)])
    alpha, weights, bias = np.zeros(len(y)), np.zeros(DIMENSIONS), 0.0
    order = np.random.Generator(np.random.PCG64(1))
    for _ in range(passes):
        moved = 0.0
        for i in order.permutation(len(y)).tolist():
            grams, values = bags.grams[starts[i] : ends[i]], bags.values[starts[i] : ends[i]]
            gradient = y[i] * (values @ weights[grams] + bias) - 1 + diagonal[i] * alpha[i]
            new = max(0.0, alpha[i] - gradient / (norms[i] + diagonal[i]))
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                # A row lists each trigram once.
                weights[grams] += step * values
                bias += step
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return Machine(weights, float(bias))


def sampled_bags(docs: DataFrame, text: str, lang: str, per_language: int) -> tuple[np.ndarray, Bags]:
    """The language of each row, and the rows: the trigrams of sampled texts and of short runs of their words."""

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 2):
            found = []
            for language, key, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8_rows(batch.column(2))):
                words = row.split()
                at = np.random.Generator(np.random.PCG64(len(row))).integers(0, max(1, len(words) - RUN_WORDS), RUNS)
                for k, part in enumerate((row, *(b" ".join(words[i : i + RUN_WORDS]) for i in at))):
                    grams, counts = np.unique(trigrams(part), return_counts=True)
                    if has_letter(part) and len(grams):
                        found.append((language, key, k, grams.astype(np.int16), (counts / counts.sum()).astype(np.float32)))
            types = (pa.string(), pa.int64(), pa.int32(), pa.list_(pa.int16()), pa.list_(pa.float32()))
            columns = zip(*found) if found else [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], _BAG_COLUMNS)

    sample = sample_contents(docs, lang, text, per_language).select(F.col("label").cast("string"), "key", "content")
    got = sample.mapInArrow(featurise, _BAG_SCHEMA).toArrow()
    # The order in which rows arrive is free; the fit must not depend on it.
    got = got.sort_by([(c, "ascending") for c in _BAG_COLUMNS[:3]])
    sizes = pc.list_value_length(got.column("grams")).to_numpy().astype(np.int64)
    grams, values = (pc.list_flatten(got.column(c)).to_numpy() for c in _BAG_COLUMNS[3:])
    given = np.array(got.column("lang").to_pylist(), object)
    return given, Bags(grams, values, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64))


_BAG_COLUMNS = ["lang", "key", "part", "grams", "shares"]
_BAG_SCHEMA = "lang string, key long, part int, grams array<short>, shares array<float>"


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", per_language: int = 300) -> LanguageModel:
    """Learn from the rows of ``docs`` that have a text with letters and a language.

    The machines see ``per_language`` different texts of each language, picked by
    a hash of the text: the one bound of the operator. Copies of a text count once.
    There may be any number of languages: the sample grows in proportion to
    it, and each machine is fitted in a Spark task of its own.
    """
    given, bags = sampled_bags(docs, text, lang, per_language)
    # Rare trigrams tell as much as frequent ones once divided by their spread.
    means = np.bincount(bags.grams, bags.values, DIMENSIONS) / max(1, len(given))
    scale = 1 / np.sqrt(means + 1e-5)
    bags = Bags(bags.grams, bags.values * scale.astype(np.float32)[bags.grams], bags.begins)
    languages, numbers = np.unique(given.astype(str), return_inverse=True)
    languages = languages.tolist()
    families: dict[str, list[str]] = {}
    for language in languages:
        families.setdefault(family_of(language), []).append(language)

    # What is positive and what negative for each machine; None is the rest.
    number_of = {language: i for i, language in enumerate(languages)}
    sides: dict[str | tuple[str, str], tuple[list[int], list[int] | None]] = {}
    if len(families) > 1:
        sides = {f: ([number_of[m] for m in members], None) for f, members in families.items()}
    for members in families.values():
        sides |= {(a, b): ([number_of[a]], [number_of[b]]) for a, b in itertools.combinations(members, 2)}
    machines = dict(zip(sides, _fit_machines(docs, bags, numbers, list(sides.values()), scale)))
    return LanguageModel(
        families,
        {k: m for k, m in machines.items() if isinstance(k, str)},
        {k: m for k, m in machines.items() if not isinstance(k, str)},
    )


def _fit_machines(docs: DataFrame, bags: Bags, numbers: np.ndarray, sides: list[tuple], scale: np.ndarray) -> list[Machine]:
    """One task per machine; the sample goes to the executors once."""
    if not sides:
        return []
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((bags, numbers, sides, scale))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bags, numbers, sides, scale = shared.value
        for batch in batches:
            for k in batch.column(0).to_pylist():
                positive, negative = sides[k]
                is_positive = np.isin(numbers, positive)
                rows = np.arange(len(numbers)) if negative is None else np.flatnonzero(is_positive | np.isin(numbers, negative))
                found = fit_machine(bags, rows, is_positive[rows])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k], pa.int64()), pa.array([found.weights * scale], pa.list_(pa.float64())), pa.array([found.bias])],
                    ["machine", "weights", "bias"],
                )

    tasks = spark.range(0, len(sides), 1, len(sides))
    got = tasks.mapInArrow(run, "machine long, weights array<double>, bias double").toArrow().sort_by("machine")
    shared.destroy()
    weights = pc.list_flatten(got.column("weights")).to_numpy().reshape(-1, DIMENSIONS)
    return [Machine(w, b) for w, b in zip(weights, got.column("bias").to_pylist())]


def predict(docs: DataFrame, model: LanguageModel, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """The columns ``keep`` of ``docs`` (all by default) with ``lang_pred`` and ``score``.

    A NULL text, or one without a letter, is ``und`` with score 0, as is every
    text if nothing was learned. Existing columns of the two names are replaced.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    shared = docs.sparkSession.sparkContext.broadcast((model, *model.table()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, weights, bias = shared.value
        for batch in small_batches(batches, 1):
            rows = utf8_rows(batch.column(1))
            margins = np.tile(bias, (len(rows), 1))
            for i, row in enumerate(rows):
                grams = trigrams(row)
                if len(grams):
                    # By different trigrams, so that neither a long text nor many machines take more memory.
                    shares = np.bincount(grams, minlength=DIMENSIONS) / len(grams)
                    margins[i] += shares.astype(np.float32) @ weights
            languages, score = known.decide(margins)
            lettered = np.array([has_letter(row) for row in rows], bool)
            languages = [name if ok else UNKNOWN for name, ok in zip(languages, lettered)]
            score = np.where(np.array(languages, object) == UNKNOWN, 0.0, score)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(languages, pa.string()), pa.array(score, pa.float64())],
                ["row", "lang_pred", "score"],
            )

    given = docs.select(carried(keep).alias("row"), F.col(text).alias("text"))
    schema = with_fields(given.select("row").schema, "lang_pred string, score double")
    judged = given.mapInArrow(run, schema)
    return judged.select(*(F.col("row")[c].alias(c) for c in keep), "lang_pred", "score")


def rejected(lang_pred: Column) -> Column:
    """Whether a document has no language: no text, or no letter in it."""
    return lang_pred == UNKNOWN


def lettered(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` with a letter in their text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1):
            yield batch.select(["row"]).filter(pa.array([has_letter(row) for row in utf8_rows(batch.column(1))], pa.bool_()))

    given = docs.select(carried(docs.columns).alias("row"), F.col(text).alias("text"))
    kept = given.mapInArrow(run, given.select("row").schema)
    return kept.select(*(F.col("row")[c].alias(c) for c in docs.columns))


def accept(
    docs: DataFrame,
    model: LanguageModel,
    wanted: Sequence[str] | None = None,
    least_score: float = 0.0,
    text: str = "text",
    lang: str = "lang",
) -> DataFrame:
    """The rows of ``docs`` in one of the ``wanted`` languages (all learned ones by default).

    Rows without a letter go, and so do those judged with a score below
    ``least_score``. Where ``lang`` is NULL the language found takes its place.
    If the model learned no language nothing is known against a text, and every one with a letter stays.
    """
    if not model.families:
        return lettered(docs, text)
    given = docs.select(carried(docs.columns).alias("own"), F.col(text).alias("text"))
    judged = predict(given, model, ["own"])
    stays = ~rejected(F.col("lang_pred")) & (F.col("score") >= least_score)
    if wanted is not None:
        stays &= F.col("lang_pred").isin(list(wanted))
    filled = {lang: F.coalesce(F.col("own")[lang], F.col("lang_pred").cast(docs.schema[lang].dataType))}
    return judged.where(stays).select(*((filled[c] if c in filled else F.col("own")[c]).alias(c) for c in docs.columns))
