"""Corpus pipeline: stages applied to ``documents`` one after the other.

Each stage takes ``(spark, docs, sf_dir)``, works on all documents that its
predecessor kept and returns a DataFrame with the columns of documents (the
last one: ids).  ``run`` writes every stage's result as Parquet into the shared
checkpoint folder and reads it again as the next stage's input.

Stages decide by row: rows without an id, and rows that share one, are judged by
their texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, language, lines, minhash, sentencepiece_bpe
from tessera.llm.data import load_table, materialize
from tessera.llm.queries import tokenizer_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised go on: texts without letters and
    those that no language wins with half of the probability are rejected."""
    model = language.fit(docs)
    got = language.predict(docs, model, keep=tuple(docs.columns), score="lang_score__", pred="lang_pred__")
    return got.where((F.col("lang_pred__") != language.UNKNOWN) & (F.col("lang_score__") >= 0.5)).select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of runs of three or more lines, of one or two lines of 50
    words or more, and of whole shorter texts are cut out of the texts; a
    document that loses all its lines goes."""
    got = lines.drop_repeated_lines(docs, prefix="lines__", min_words=50)
    changed = F.col("lines__n_removed") > 0
    got = got.where(~(changed & (F.col("lines__n_removed") == F.col("lines__n_lines"))))
    n_chars = F.when(changed, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return got.withColumn("n_chars", n_chars).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more)
    one row stays: that of smallest id (null last), of one id that of smallest
    text digest, of equal rows any one."""
    found = minhash.component_rows(docs, percent=80)
    best = found.where("comp is not null").groupBy("comp").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "digest")).alias("r"))
    stay = best.select(F.col("r.id").alias("id__"), F.col("r.digest").alias("digest__"))
    stay = stay.union(found.where("comp is null and digest is not null").select("id", "digest")).distinct()
    own = docs.withColumn("own__", minhash.text_digest(F.col("text")))
    kept = own.join(stay, (F.col("own__") == F.col("digest__")) & F.col("doc_id").eqNullSafe(F.col("id__")), "left_semi")
    again = found.groupBy("id", "digest").count().where("count > 1").select(F.col("id").alias("id__"), F.col("digest").alias("digest__"))
    if not again.isEmpty():                                   # repeated rows: one of each stays
        same = (F.col("own__") == F.col("digest__")) & F.col("doc_id").eqNullSafe(F.col("id__"))
        kept = kept.join(again, same, "left_anti").unionByName(kept.join(again, same, "left_semi").dropDuplicates(["doc_id", "own__"]))
    return kept.select(docs.columns).unionByName(docs.where("text is null"))


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that hold a benchmark item, edited or not, go, whatever their id."""
    own = docs.withColumn("own__", minhash.text_digest(F.col("text")))
    found = decontaminate.find_items(own, load_table(spark, sf_dir, "benchmark"), key="own__", item_key="item_id")
    return own.join(found.select("own__").distinct(), "own__", "left_anti").select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, end id included, and the digest of what they decode to:
    ``doc_id, lang, source, n_tokens, ids, decoded_sha256``."""
    got = sentencepiece_bpe.encode(docs, tokenizer_path(), keep=("doc_id", "lang", "source"), decoded=True)
    return got.select("doc_id", "lang", "source", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", benchmark_free),
    ("sentencepiece", tokens),
]

#: SQL can express neither the classifier nor the alignment nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage over the whole ``documents`` table."""
    docs = load_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"pipeline-{name}")
    return docs
