"""Operators leave the caller's other columns as they are, whatever these are called, maps included."""

import itertools
import re
from pathlib import Path

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidegauge.llm import common, decontaminate, filter_audit, host_rules, html_blocks, language, mixing, simhash, token_counts, toxicity
from test_llm import importable  # noqa: F401

LLM = Path(common.__file__).parent
# Every name that any operator gives a column, and more of the kind.
NAMES = sorted(
    {name for path in LLM.glob("*.py") for name in re.findall(r"""(?:alias|withColumn)\(["'](\w+)["']""", path.read_text())}
    | set("need extra passes shard shards own row text_ key id tag hash hot first smallest draw block size_ place _at _source _size _more _key _id _tag _row _words _text _host".split())
)


@pytest.fixture(scope="module")
def documents(spark):
    prose = "the quick brown fox jumps over the lazy dog and runs far away from here today"
    rows = [(i, f"{prose} {i % 7} " * (1 + i % 3), ("en", "fr", None)[i % 3], ("a", "b", None)[i % 3]) for i in range(60)]
    rows += [(None, None, None, None), (3, "", "en", "a"), (5, "$$ ###", "en", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    taken = {"doc_id", "text", "lang", "source"}
    more = {name: F.lit(f"mine {i}") for i, name in enumerate(NAMES) if name not in taken}
    return docs.withColumns({**more, "a map": F.create_map(F.lit("k"), F.col("doc_id")), "nested": F.struct(F.array("text").alias("t"))})


def unchanged(result, given, but=()):
    """Every row of the result is one of the given ones in all columns that the operator does not fill itself."""
    columns = [c for c in given.columns if c in result.columns and c not in but]
    assert len(columns) > len(NAMES) - 20
    assert result.select(columns).schema.simpleString() == given.select(columns).schema.simpleString()
    quoted = [F.col(f"`{c}`") for c in columns]
    known = {str(r) for r in given.select(quoted).collect()}
    rows = result.select(quoted).collect()
    assert {str(r) for r in rows} <= known
    return len(rows)


def test_language(documents):
    model = language.fit(documents)
    assert unchanged(language.predict(documents, model), documents, ("lang_pred", "score")) == documents.count()
    assert unchanged(language.accept(documents, model), documents, ("lang",)) == 60
    assert unchanged(language.lettered(documents), documents) == 60


def test_toxicity(spark, documents):
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(50)], "doc_id long, toxic int")
    field = toxicity.fit(documents, labels)
    assert unchanged(toxicity.score(documents, field), documents, ("score", "predicted", "spans")) == documents.count()


def test_html(documents):
    pages = documents.withColumn("html", F.concat(F.lit("<article><p>"), "text"))
    weights = html_blocks.train([], rounds=1)
    assert unchanged(html_blocks.extract(pages, weights), pages, ("text", "n_chars")) == documents.count()


def test_mixing(documents):
    mixed = mixing.mix(documents)
    added = ("size", "source_size", "target", "taken", "shards")
    assert unchanged(mixed, documents, added) == documents.count()
    dealt = mixing.deal(mixed)
    assert unchanged(dealt, documents, (*added, "shard")) == mixed.select(F.sum(F.size("shards"))).first()[0]


def test_simhash(documents):
    one = simhash.keep_one(documents.union(documents))
    assert one.columns == documents.columns
    assert unchanged(one, documents) == simhash.near_duplicates(documents).select("component_id").distinct().count()


def test_decontamination(spark, documents):
    items = spark.createDataFrame([(1, "lazy dog and runs far away from here today 3 the quick brown")], "item_id long, text string")
    clean = decontaminate.clean(documents, items)
    assert clean.columns == documents.columns
    dirty = decontaminate.contamination(documents, items).where("contaminated").count()
    assert 0 < dirty and unchanged(clean, documents) == documents.count() - dirty


def test_host_rules(documents):
    added = ("host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_rate", "kept")
    judged = host_rules.judge(documents, F.col("source"))
    assert unchanged(judged, documents, added) == documents.count()


def test_audit_and_token_counts(spark, documents):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(9)], "doc_id long, quality int, toxic int")
    plain = documents.select("doc_id", "text", "lang")
    rows = [sorted(map(tuple, filter_audit.audit_documents(d, labels).collect())) for d in (documents, plain)]
    assert rows[0] == rows[1] and len(rows[0]) == 600 * 3
    counted = token_counts.count_tokens(documents, token_counts.prove(public_tokenizers.path("byte_bpe_50k.json")))
    assert unchanged(counted, documents, ("n_bytes", "n_tokens", "over_limit")) == documents.count()


def test_language_stage_decides(spark):
    """Without labels nothing is lost; wanted languages and scores do decide."""
    words = {"en": "the house and the garden are there", "de": "das haus und der garten sind dort", "fr": "la maison et le jardin sont ici"}
    rows = [(i, f"{words[lang]} {extra}", lang) for i, (lang, extra) in enumerate(itertools.product(words, "abcdefghij"))]
    docs = spark.createDataFrame([*rows, (90, "12 !", "en"), (91, None, "de"), (92, "", None)], "doc_id long, text string, lang string")
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert sorted(map(tuple, language.accept(unlabelled, language.fit(unlabelled)).collect())) == [(i, t, None) for i, t, _ in rows]
    model = language.fit(docs)
    assert sorted(map(tuple, language.accept(unlabelled, model).collect())) == rows
    assert {r.lang for r in language.accept(docs, model, wanted=["de", "fr"]).collect()} == {"de", "fr"}
    scores = {r.doc_id: r.score for r in language.predict(docs, model).collect()}
    middle = sorted(scores[i] for i, _, _ in rows)[15]
    assert {r.doc_id for r in language.accept(docs, model, least_score=middle).collect()} == {i for i, _, _ in rows if scores[i] >= middle}


def test_letters_in_either_case_and_regions(spark):
    assert [language.family_of(x) for x in ("pt-BR", "pt", "DE_AT", "xx-YY")] == ["romance", "romance", "germanic", "xx"]
    for text in ("привіт світе", "Straße nach ÄÖÜ", "hello there"):
        assert sorted(language.trigrams(text.upper().lower().encode())) == sorted(language.trigrams(text.upper().encode()))
    assert sorted(language.trigrams("été là".encode())) == sorted(language.trigrams("  été — là ".encode()))
    ru = "он не знал что это было так давно и все же думал о том как она ушла тогда".split()
    uk = "він не знав що це було так давно і все ж думав про те як вона пішла тоді".split()
    rows = [(i, " ".join(own[(i * 7 + k * k) % len(own)] for k in range(8)), lang) for i in range(80) for lang, own in (("ru", ru), ("uk", uk))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    judged = language.predict(docs.withColumn("text", F.upper("text")), language.fit(docs))
    assert judged.where("lang = lang_pred").count() > 0.95 * len(rows)
