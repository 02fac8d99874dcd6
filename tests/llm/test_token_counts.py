"""Token counts against the library on whole texts."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidegauge.llm import queries, token_counts
from conftest import DATA
from test_llm import importable, none, odd, table  # noqa: F401

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def shortcut():
    return token_counts.prove(PATH)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def length(library, text):
    return len(library.encode(text or "", add_special_tokens=False).ids)


def test_proof(shortcut, library):
    """All proved strings are one token alone, and hardly any other string of the vocabulary that is text is."""
    assert all(len(e.ids) == 1 for e in library.encode_batch(sorted(shortcut.whole), add_special_tokens=False))
    rest = [t for t in map(library.decode, ([i] for i in range(50256))) if "�" not in t and t not in shortcut.whole]
    assert all(len(e.ids) != 1 for e in library.encode_batch(rest, add_special_tokens=False))
    assert len(shortcut.whole) > 45_000


def test_every_character_is_cut_as_the_library_cuts(shortcut, library):
    """Each character below U+10000, and some above, between letters, digits, signs and blanks."""
    counter = token_counts.TokenCounter(shortcut)
    points = [*range(0xD800), *range(0xE000, 0x10000), *range(0x10000, 0x110000, 4097)]
    for at in range(0, len(points), 4000):
        some = [chr(p) for p in points[at : at + 4000]]
        text = "".join(f"a{c}1{c}!{c} {c}\n{c}{c}b" for c in some)
        assert counter.count(text) == length(library, text)


def test_random_texts(shortcut, library):
    pool = ["a", "B", "é", "1", "²", "٣", " ", "  ", "\n", "\t", "\xa0", "\x1c", "\x85", "'s", "'ll", "'", "!", "日", "😀", "𝒜", "́",
            "<|endoftext|>", "<|endo", "�", "​", "　", "\x00", "अ", "्"]
    counter, draw = token_counts.TokenCounter(shortcut), random.Random(5)
    for _ in range(20_000):
        text = "".join(draw.choice(pool) for _ in range(draw.randint(0, 14)))
        assert counter.count(text) == length(library, text), text


def test_long_texts_are_cut_where_nothing_changes(shortcut, library, monkeypatch):
    monkeypatch.setattr(token_counts, "CHUNK", 16)
    counter, draw = token_counts.TokenCounter(shortcut), random.Random(6)
    pool = ["word", " ", "  ", "\n", "I'll", "12", "...", "日本", "x" * 40, "!", " \n ", "😀", "<|endoftext|>"]
    for _ in range(2_000):
        text = "".join(draw.choice(pool) for _ in range(draw.randint(0, 60)))
        assert counter.count(text) == length(library, text), text


def test_count_tokens(spark, shortcut, library, odd, none):
    clashing = odd.withColumns({"n_tokens": F.lit("x"), "row": F.lit("r"), "text_": F.lit(1), "m": F.create_map(F.lit("a"), F.lit(1))})
    got = token_counts.count_tokens(clashing, shortcut, limit=10)
    assert got.columns == [*(c for c in clashing.columns if c != "n_tokens"), "n_bytes", "n_tokens", "over_limit"]
    rows = got.collect()
    assert sorted((r.doc_id or -1, r.text or "") for r in rows) == sorted((r.doc_id or -1, r.text or "") for r in odd.collect())
    for r in rows:
        n = length(library, r.text)
        assert (r.n_bytes, r.n_tokens, r.over_limit, r.row) == (len((r.text or "").encode()), n, n > 10, "r")
    assert token_counts.count_tokens(none, shortcut).count() == 0


def test_query(spark, library):
    texts = {r.doc_id: r.text for r in table(spark, "documents", "sf0.01").collect()}
    df = queries.op12_token_counts(spark, str(DATA / "sf0.01"))
    assert df.dtypes == [("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_tokens", "bigint"), ("over_limit", "boolean")]
    got = {r.doc_id: tuple(r)[1:] for r in df.collect()}
    assert got == {i: (len(t.encode()), length(library, t), length(library, t) > 512) for i, t in texts.items()}


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        token_counts.prove(public_tokenizers.path("word_bpe_49k.json"))
