"""Corpus pipeline: each stage's decisions on its own input."""

import corpus_pipeline as P
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_stages_in_order(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {r["doc_id"]: r for r in docs.collect()}
    bench = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for k, (name, stage) in enumerate(P.STAGES[:-1]):
        out = stage(spark, docs, SF)
        assert out.columns == columns and out.schema.simpleString() == docs.schema.simpleString(), name
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        now = {r["doc_id"]: r for r in docs.collect()}
        assert set(now) <= set(kept)
        gone = set(kept) - set(now)
        if name == "language_id":
            assert len(gone) <= 2                             # clean documents stay
        if name == "line_dedup":
            assert all(r["n_chars"] == len(r["text"]) for i, r in now.items() if r["text"] != kept[i]["text"])
        if name == "decontamination":
            hit = {i for i, r in kept.items() if any(b in r["text"] for b in bench)}
            assert hit <= gone and len(gone) <= len(hit) + 1
        kept = now
    last = P.STAGES[-1][1](spark, docs, SF)
    assert last.count() == len(kept) and last.where(F.element_at("ids", -1) != 2).count() == 0


def test_nulls_and_clashing_columns(spark):
    rows = [(1, "the first of the texts\nb\nc\nd", "en", "s", 5), (2, None, None, None, None), (None, "the text and the words", "en", None, 3),
            (4, "", "en", "s", 0), (1, "the first of the texts\nb\nc\nd", "en", "s", 5), (6, "le chat et la souris\nb\nc\nd", "fr", "s", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumn("gone", F.lit(1)).withColumn("score", F.lit("x")).withColumn("n_lines", F.lit(0.5))
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        docs = out
    assert P.STAGES[-1][1](spark, docs, SF).count() == docs.count()
    assert P.STAGES[-1][1](spark, docs.limit(0), SF).count() == 0


def test_run(spark):
    assert P.run(spark, SF).count() > 0


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_near_dedup_by_row(spark):
    """Rows without an id, repeated rows and different texts under one id."""
    words = [f"word{i}" for i in range(60)]
    a, b = " ".join(words), " ".join(words[:-1])
    other, third = " ".join(reversed(words)), " ".join(words[::2])
    rows = [(None, a), (None, a), (4, b), (4, b), (5, a), (5, other), (None, third), (None, third), (9, ""), (None, None)]
    got = sorted(((r["doc_id"], r["text"]) for r in P.near_dedup(spark, _docs(spark, rows), SF).collect()), key=str)
    assert got == sorted([(4, b), (5, other), (None, third), (9, ""), (None, None)], key=str)


def test_benchmark_text_goes_whatever_its_id(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first()["text"]
    clean = " ".join(f"clean{i}" for i in range(50))
    rows = [(None, item), (1, "before " + item + " after"), (1, clean), (None, clean), (3, None)]
    got = sorted(((r["doc_id"], r["text"]) for r in P.benchmark_free(spark, _docs(spark, rows), SF).collect()), key=str)
    assert got == sorted([(1, clean), (None, clean), (3, None)], key=str)


def test_last_stage_decodes(spark):
    import hashlib
    rows = [(1, "The end of  it."), (2, ""), (None, "é漢😀")]
    got = {r["doc_id"]: r for r in P.tokens(spark, _docs(spark, rows), SF).collect()}
    assert got[2]["decoded_sha256"] == hashlib.sha256(b"").hexdigest()
    assert all(r["n_tokens"] == len(r["ids"]) and len(r["decoded_sha256"]) == 64 for r in got.values())
