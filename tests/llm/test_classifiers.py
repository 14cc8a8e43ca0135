"""Language, quality and toxicity: held-out accuracy, defined results, folds."""

import zlib

from tessera.llm import language, quality, toxicity
from tessera.llm.queries import QUERIES

SF01 = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    got = {r["doc_id"]: r for r in QUERIES["op3_language"](spark, SF01).collect()}
    docs = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "lang").collect()
    assert len(got) == len(docs)
    for r in docs:
        assert got[r["doc_id"]]["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= got[r["doc_id"]]["score"] <= 1
    held = [r for r in docs if got[r["doc_id"]]["held_out"]]
    assert sum(got[r["doc_id"]]["lang_pred"] == r["lang"] for r in held) >= 0.98 * len(held)


def test_language_edges(spark):
    rows = [(1, "the cat and the dog", "en", 0), (2, "le chat et le chien", "fr", 0), (3, None, "en", 0), (4, "", "fr", 0),
            (5, "123 !! 🙂", "en", 0), (None, "the house", None, 0), (2, "le chat et le chien", "fr", 0), (7, "漢字" * 5000, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    got = language.predict(docs, language.fit(docs)).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (3, 4, 5))
    assert by[1]["lang_pred"] == "en" and by[2]["lang_pred"] == "fr"
    none = language.predict(docs, language.fit(docs.where("lang = 'xx'")))
    assert {r["lang_pred"] for r in none.collect()} == {"und"}
    empty = docs.limit(0)
    assert language.predict(empty, language.fit(empty)).count() == 0


def test_quality_held_out(spark):
    got = {r["doc_id"]: r for r in QUERIES["op5_quality"](spark, SF01).collect()}
    marks = spark.read.parquet(f"{SF01}/labels.parquet").collect()
    held = [r for r in marks if got[r["doc_id"]]["held_out"]]
    assert held and all((zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in held)
    assert sum(got[r["doc_id"]]["predicted"] == r["quality"] for r in held) >= 0.97 * len(held)
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in got.values())


def test_quality_edges(spark):
    rows = [(1, "A plain line of words.\nAnother one."), (2, None), (3, ""), (4, " \n "), (4, " \n "), (5, "#$ " * 20000), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    feats = quality.features(docs)
    assert feats.count() == len(rows)
    marks = spark.createDataFrame([(1, 1), (5, 0), (3, 1)], "doc_id long, label int")
    model = quality.fit(feats.join(marks, "doc_id"))
    assert all(0 <= r["score"] <= 1 for r in quality.score(feats, model).collect())
    assert quality.fit(feats.join(marks.limit(0), "doc_id")) is None
    assert {r["score"] for r in quality.score(feats, None).collect()} == {0.5}


def test_pairwise_boosting_learns_an_interaction():
    import numpy as np
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    p = quality.boost(x, y).score(x)
    assert ((p > 0.5) == (y > 0.5)).mean() > 0.95


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    got = {r["doc_id"]: r for r in QUERIES["op9_toxicity"](spark, d).collect()}
    held = [r for r in spark.read.parquet(f"{d}/labels.parquet").collect() if got[r["doc_id"]]["held_out"]]
    right = sum(got[r["doc_id"]]["predicted"] == r["toxic"] for r in held)
    clean = [r for r in held if not r["toxic"]]
    assert right >= 0.97 * len(held)
    assert sum(got[r["doc_id"]]["predicted"] for r in clean) <= 0.01 * len(clean)


def test_toxicity_folding_and_exceptions(spark):
    model = toxicity.ToxicityModel({"idiot": 5.0, "trash": 4.0}, toxicity.HARMLESS, __import__("numpy").array([-3.0, 1, 1, 1]))
    rows = [(1, "you idiot"), (2, "you 1d10t!"), (3, "уоu іdіоt"), (4, "put it in the trash can"), (5, "what trash"),
            (6, "unidiotic words"), (7, None), (8, ""), (9, "ＩＤＩＯＴ"), (None, "idiot"), (1, "you idiot"), (11, "fine " * 50000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r["doc_id"], r["score"] > 0.5) for r in toxicity.score(docs, model).collect()]
    hot = sorted((i or 0) for i, toxic in got if toxic)
    assert hot == [0, 1, 1, 2, 3, 5, 9] and len(got) == len(rows)


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, label int")
    assert toxicity.fit(docs, none) is None
    assert {r["score"] for r in toxicity.score(docs, None).collect()} == {0.0}
    only = spark.createDataFrame([(1, 0)], "doc_id long, label int")
    assert all(r["score"] < 0.5 for r in toxicity.score(docs, toxicity.fit(docs, only)).collect())
