"""Callers' columns whose names a step uses itself come out as they went in."""

import pytest
from pyspark.sql import functions as F

from driftline.llm import decontamination, language, near_duplicates, pieces, secret_scan

NAMES = ("base all_spans _more s score lang_pred _p label _id _key g r key class node component_id kept n_shingles h d n_hit contaminated ids n_pieces exact others "
         "_text given rest end start word words a.b").split()
TEXTS = [(1, "some words in a row password = hunter22hunter ok"), (2, "was it of the and or"), (3, None), (4, ""), (None, "a null id of the or"), (5, "was it of the and or")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame([(i, t, "en") for i, t in TEXTS], "doc_id long, text string, lang string")
    return rows.select("doc_id", *[F.concat(F.lit(n), F.coalesce("doc_id", F.lit(0))).alias(n) for n in NAMES], "text", "lang")


def same(out, docs):
    assert out.columns == docs.columns
    for r in out.collect():
        assert all(r[n] == f"{n}{r['doc_id'] or 0}" for n in NAMES)


def test_filters_and_redaction(spark, docs):
    items = spark.createDataFrame([(9, "some words in a row password")], "item_id long, text string")
    out = secret_scan.redact(docs)
    same(out, docs)
    assert out.where("doc_id = 1").first()["text"] == "some words in a row [SECRET] ok" and out.count() == len(TEXTS)
    same(language.keep_identified(docs), docs)
    same(near_duplicates.one_of_each(docs), docs)
    out = decontamination.clean(docs, items)
    same(out, docs)
    assert sorted(r["doc_id"] or 0 for r in out.select("doc_id").collect()) == [0, 2, 3, 4, 5]


def test_encoding(docs):
    names = tuple(f"given_{n}" if n in pieces.RESULTS else n for n in NAMES)
    out = pieces.encode(docs, names=("doc_id", *NAMES))
    assert out.columns == ["doc_id", *names, *pieces.RESULTS]
    for r in out.collect():
        assert all(r[m] == f"{n}{r['doc_id'] or 0}" for m, n in zip(names, NAMES)) and r["exact"] in (True, None)
