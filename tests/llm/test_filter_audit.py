"""Filter audits against running every order of the filters over the documents."""

from itertools import permutations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.llm import filter_audit, queries
from test_llm import importable, none, odd, table  # noqa: F401

COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def failing(row, rows):
    text = row.text or ""
    words = text.encode().split()
    found = {
        "A": len(words) < 200,
        "B": 100 * len(set(words)) < 50 * len(words),
        "C": 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text),
        "D": any(c in "#$%&*|" for c in text),
        "E": row.doc_id is not None and any(r.doc_id is not None and r.doc_id < row.doc_id and (r.text or "") == text for r in rows),
    }
    return {name for name, fails in found.items() if fails}


def brute(rows, labels):
    """Every order, walked document by document."""
    good = {r.doc_id for r in labels if r.doc_id is not None and r.quality == 1}
    toxic = {r.doc_id for r in labels if r.doc_id is not None and r.toxic == 1}
    fails = [(r.lang or "", r.doc_id, failing(r, rows)) for r in rows]
    out = {}
    for part in {f[0] for f in fails}:
        own = [f for f in fails if f[0] == part]
        totals = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, name in enumerate(order, 1):
                removed = [f for f in left if name in f[2]]
                left = [f for f in left if name not in f[2]]
                totals[name] += len(removed)
                out[part, "".join(order), step] = [
                    len(left), len(removed), sum(name in f[2] for f in own) - len(removed), sum(f[2] == {name} for f in own),
                    sum(f[1] in good for f in removed), sum(f[1] in toxic for f in removed),
                ]
        for (p, order, step), values in out.items():
            if p == part:
                values.append(totals[order[step - 1]])
    return sorted((*key, *values) for key, values in out.items())


def check(docs, labels):
    df = filter_audit.audit_documents(docs, labels)
    assert df.columns == COLUMNS
    assert sorted(map(tuple, df.collect())) == brute(docs.collect(), labels.collect())


def varied(spark):
    rng = np.random.Generator(np.random.PCG64(3))
    rows = []
    for i in range(300):
        long, poor = rng.integers(2, size=2)
        words = [f"w{j % 20 if poor else j}" for j in range(220 if long else 30)]
        text = " ".join(words) + (" # " if rng.integers(2) else "") + ("LOUD" * 40 if rng.integers(2) else "")
        rows.append((i, text + str(rng.integers(6)), ["en", "fr", None, ""][rng.integers(4)]))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_every_order(spark):
    docs = varied(spark)
    labels = spark.createDataFrame([(i, i % 2, i % 3 % 2) for i in range(0, 300, 2)], "doc_id long, quality int, toxic int")
    check(docs, labels)


def test_odd_rows(spark, odd, none):
    """NULLs, empty and long texts, repeated rows, contradicting labels and columns named like inner ones."""
    labels = spark.createDataFrame(
        [(1, 1, 0), (1, 0, 1), (1, 1, 1), (3, None, 1), (4, 1, None), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int"
    )
    check(odd, labels)
    clashing = odd.withColumns({c: F.lit(1) for c in ("digest", "fails", "n", "good", "part", "spread", "pattern", "first")})
    check(clashing.withColumn("extra", F.create_map(F.lit("a"), F.lit(1))), labels)
    check(odd, labels.limit(0))
    assert filter_audit.audit_documents(none, labels).count() == 0


def test_copies_in_many_parts(spark):
    """A text with most of the rows: the smallest id alone passes, wherever it stands; ids may repeat or be NULL."""
    rows = [(i, "the same text", f"p{i % 7}") for i in range(10, 400)] + [(None, "the same text", "p1")] * 3
    rows += [(3, "the same text", "p2")] * 2 + [(None, None, "p3"), (5, "", "p3"), (6, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(6)
    labels = spark.createDataFrame([(3, 1, 1), (10, 1, 1), (6, 1, 0)], "doc_id long, quality int, toxic int")
    check(docs, labels)


def test_words_of_long_texts(monkeypatch):
    text = ("a b\tc\x0bd  é\x85x " * 50 + "end").encode()
    want = filter_audit._word_counts(text)
    monkeypatch.setattr(filter_audit, "LONG_BYTES", 10)
    assert filter_audit._word_counts(text) == want == (len(text.split()), len(set(text.split())))


def test_contraction_is_selection():
    tensors = np.arange(2 * 1 * 8, dtype=np.int64).reshape(2, 1, 2, 2, 2)
    chosen = np.array([[filter_audit.PASS, filter_audit.ALL, filter_audit.FAIL]])
    assert filter_audit.contract(tensors, chosen)[:, 0, 0].tolist() == [t[0, 0, :, 1].sum() for t in tensors]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_matches_sql(spark, sf):
    db = duckdb.connect()
    for name in ("documents", "labels"):
        db.register(name, table(spark, name, sf).toArrow())
    want = db.sql(queries.oracle_sql()["op11_filter_audit"])
    from conftest import DATA

    df = queries.op11_filter_audit(spark, str(DATA / sf))
    assert sorted(df.columns) == sorted(want.columns)
    assert sorted(map(tuple, df.select(COLUMNS).collect())) == sorted(map(tuple, want.select(", ".join(COLUMNS)).fetchall()))
