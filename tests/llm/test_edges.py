"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names, for every operator."""

from __future__ import annotations

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from millrace.llm import bpe, decontaminate, gif, language, quality, secrets, simhash, suffix_tree, token_counts, warc

CODES, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
PROSE = "the cat sat on the mat and the dog ran to the old house by the river. "
LONG = " ".join(f"word{k % 977} and then some" for k in range(40_000))
NAMES = ("key", "k", "t", "doc", "own", "fp", "ids", "score", "row", "n", "words", "least", "root", "size", "grouped", "component_id", "media", "x", "p", "u", "w", "l", "item_id")
ROWS = [(1, PROSE * 4), (2, None), (3, ""), (4, LONG), (5, PROSE * 4), (5, PROSE * 4), (None, "some text without an id"), (7, " \t\n "), (8, None), (9, "Ünï ÇÖDÉ 中文 \U0001f600 \x00 \x85"), (10, "a"), (11, "token = \"abcdef0123456789\"")]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame([(i, t, "en" if i is None or i % 2 else None, f"s{i}") for i, t in ROWS], "doc_id long, text string, lang string, source string")
    return df.withColumns({n: F.lit(f"clash {n}") for n in NAMES})


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


def tree_scores(df):
    return suffix_tree.score(df, suffix_tree.fit(df), kept={"held_out": F.lit(False)})


def languages(df):
    model = language.fit(df.sparkSession.createDataFrame([(k, PROSE + str(k), "en") for k in range(12)] + [(k + 20, "le chat est sur la table avec nous", "fr") for k in range(12)], "doc_id long, text string, lang string"), F.lit(True))
    return language.predict(df, model)


def qualities(df):
    labels = df.sparkSession.createDataFrame([(1, 1, 0), (5, 1, None), (None, 1, 0), (4, None, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    return quality.score(df, quality.fit(df, labels, F.lit(True)))


PER_ROW = {
    "bpe": lambda df: bpe.encode_decode(df, CODES),
    "bpe_two_steps": lambda df: bpe.decode(bpe.encode(df, CODES), CODES),
    "token_counts": lambda df: token_counts.token_counts(df, PIECES),
    "gif": lambda df: gif.decode_column(gif.store_texts(df), others=("n_bytes",)),
    "language": languages,
    "quality": qualities,
    "secrets": lambda df: secrets.find(df, secrets.fit(df)),
    "simhash": simhash.groups,
    "suffix_tree": tree_scores,
    "redacted": lambda df: secrets.redacted(df, secrets.fit(df)),
}


@pytest.mark.parametrize("name", PER_ROW)
def test_one_row_each(name, docs):
    found = PER_ROW[name](docs).toPandas()
    assert sorted(found["doc_id"].fillna(-1)) == sorted(-1 if i is None else i for i, _ in ROWS)
    twice = found[found["doc_id"] == 5].astype(str)
    assert (twice.iloc[0] == twice.iloc[1]).all()


@pytest.mark.parametrize("name", PER_ROW)
def test_empty_table(name, nothing):
    assert PER_ROW[name](nothing).count() == 0


def test_nulls_count_as_empty(docs):
    coded = {r["doc_id"]: r for r in bpe.encode_decode(docs, CODES).collect()}
    assert coded[2]["ids"] == coded[3]["ids"] == [] and coded[2]["decoded"] == ""
    fps = {r["doc_id"]: r for r in simhash.groups(docs).collect()}
    assert [fps[k]["fp"] for k in (2, 3, 7, 8)] == [0] * 4 and {fps[k]["component_id"] for k in (2, 3, 7, 8)} == {2} and fps[5]["component_id"] == 1
    named = {r["doc_id"]: r for r in languages(docs).collect()}
    assert all(named[k]["lang_pred"] == "und" and named[k]["score"] == 0 for k in (2, 3, 7))
    scores = {r["doc_id"]: r["score"] for r in qualities(docs).collect()}
    assert scores[2] == scores[3] == scores[7] and 0 <= scores[1] <= 1
    lm = {r["doc_id"]: r for r in tree_scores(docs).collect()}
    assert lm[2]["n_tokens"] == lm[3]["n_tokens"] == 1 and lm[2]["score"] == lm[3]["score"]


def test_decontamination(docs, nothing, spark):
    items = spark.createDataFrame([(1, PROSE), (2, None), (3, ""), (4, PROSE), (None, "some text without an id"), (6, "?!")], "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.find(docs, items).collect()}
    assert found == {(1, 1), (1, 4), (5, 1), (5, 4), (None, None)}
    assert decontaminate.find(nothing, items).count() == 0 and decontaminate.find(docs, items.limit(0)).count() == 0
    assert sorted(r["doc_id"] for r in decontaminate.clean(docs, items).collect()) == [2, 3, 4, 7, 8, 9, 10, 11]
    assert decontaminate.clean(docs, items).columns == docs.columns and decontaminate.clean(nothing, items).count() == 0


def test_filters_keep_columns(docs, nothing):
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 1, 2, 4, 9, 10, 11]
    assert simhash.deduplicated(nothing).count() == 0
    twice = docs.filter("doc_id = 5")
    assert simhash.deduplicated(twice).count() == 1
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    good = quality.accepted(docs, quality.fit(docs, labels, F.lit(True)))
    assert good.columns == docs.columns and good.count() <= docs.count()
    clean = {r["doc_id"]: r["text"] for r in secrets.redacted(docs, secrets.fit(docs)).collect()}
    assert clean[11] == "[SECRET]\"" and clean[2] is None and clean[1] == PROSE * 4


def test_warc(spark):
    long = "<p>" + "x" * 300 + "</p>"
    rows = [(3, "http://a", long), (1, "http://b", long), (1, None, long), (2, "http://c\r\n evil: x", "short"), (4, "", "short"), (5, None, None), (6, "http://é", ""), (None, "http://n", long), (7, "u", "é" * 50)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).withColumn("key", F.lit("clash"))
    got = warc.read(warc.write(warc.plan(pages))).collect()
    assert all(r["error"] is None for r in got) and len(got) == len(rows)
    kinds = sorted((r["record_id"], r["record_type"], r["refers_to"], r["payload_length"]) for r in got)
    n, page = len(long), "<urn:millrace:page:{}>".format
    assert kinds == sorted([
        (page(3), "revisit", page(1), n), (page(1), "response", None, n), (page(1), "response", None, n), (page(2), "response", None, 5), (page(4), "response", None, 5), (page(5), "response", None, 0),
        (page(6), "response", None, 0), (page(""), "revisit", page(1), n), (page(7), "response", None, 100),
    ])
    assert warc.read(warc.write(warc.plan(pages.limit(0)))).count() == 0
    odd = spark.createDataFrame([("a", None), ("b", bytearray())], "archive string, data binary")
    assert warc.read(odd).count() == 0
