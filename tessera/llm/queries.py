"""Registered queries of this package: one per operator, over whole tables."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.data import label_rows, load_table, materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql.strip()
        return fn
    return deco


def tokenizer_path(name: str = "piece_bpe_32k.model") -> str:
    """Place of a public tokenizer file; ``TOKENIZER_DIR`` overrides the folder."""
    folder = os.environ.get("TOKENIZER_DIR")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers
    return str(public_tokenizers.path(name))


@query("op10_sentencepiece")
def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.sentencepiece_bpe import encode

    got = encode(load_table(spark, sf_dir, "documents"), tokenizer_path(), ids="text", decoded=True)
    return got.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op3_language")
def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.language import fit, held_out, predict

    docs = load_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = held_out(F.col("doc_id"), 3, 1)
    model = fit(docs.where(~out))
    got = predict(docs, model)
    return got.select("doc_id", out.alias("held_out"), "lang_pred", "score")


@query("op5_quality")
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.language import held_out
    from tessera.llm.quality import features, fit, score

    out = held_out(F.col("doc_id"), 5, 0)
    rows = materialize(features(load_table(spark, sf_dir, "documents")), "quality-features")
    marks = label_rows(spark, sf_dir, "quality").where(~out)
    got = score(rows, fit(rows.join(marks, "doc_id")))
    return got.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op9_toxicity")
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.language import held_out
    from tessera.llm.toxicity import fit, score

    out = held_out(F.col("doc_id"), 5, 0)
    docs = load_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, label_rows(spark, sf_dir, "toxic").where(~out))
    return score(docs, model).select("doc_id", out.alias("held_out"), "score",
                                     (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op6_minhash")
def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.minhash import near_duplicates

    return near_duplicates(load_table(spark, sf_dir, "documents"), percent=85)


@query("op4_embeddings")
def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.embeddings import near_vectors

    return near_vectors(load_table(spark, sf_dir, "embeddings"))


LINES_SQL = """
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
w AS (SELECT doc_id, i, trim(ls[i], ' ') || chr(10) || trim(ls[i + 1], ' ') || chr(10) || trim(ls[i + 2], ' ') AS k
      FROM (SELECT doc_id, ls, unnest(range(1, len(ls) - 1)) AS i FROM d)),
dup AS (SELECT doc_id, i FROM w QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, i + o AS i FROM dup, (VALUES (0), (1), (2)) v(o)),
runs AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (fresh) AS n_runs FROM (
           SELECT doc_id, lag(i) OVER (PARTITION BY doc_id ORDER BY i) IS DISTINCT FROM i - 1 AS fresh FROM gone)
         GROUP BY doc_id),
kept AS (SELECT l.doc_id, string_agg(l.s, chr(10) ORDER BY l.i) AS text
         FROM (SELECT doc_id, unnest(ls) AS s, unnest(range(1, len(ls) + 1)) AS i FROM d) l
         ANTI JOIN gone USING (doc_id, i) GROUP BY l.doc_id)
SELECT d.doc_id, CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN runs USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


@query("op8_lines", LINES_SQL)
def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.lines import drop_repeated_lines

    got = drop_repeated_lines(load_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "n_lines", "n_removed", "n_runs",
                      F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query("op2_decontaminate")
def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.decontaminate import find_items

    return find_items(load_table(spark, sf_dir, "documents"), load_table(spark, sf_dir, "benchmark"))


@query("op1_licenses")
def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.licenses import scan

    return scan(load_table(spark, sf_dir, "documents"))


@query("op7_suffixes")
def op7_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.suffixes import remove_repeats

    got = remove_repeats(load_table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))


RANKING_SQL = r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
len AS (SELECT doc_id, sum(tf) AS n FROM tf GROUP BY doc_id),
all_docs AS (SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM len),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * big_n + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
      FROM tf SEMI JOIN q USING (term) CROSS JOIN all_docs GROUP BY term, big_n),
m AS (SELECT doc_id, 75 + (25 * CAST(n AS BIGINT) * big_n) // big_l AS m FROM len CROSS JOIN all_docs),
s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
      FROM q JOIN w USING (term) JOIN tf USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 20
"""


@query("op11_ranking", RANKING_SQL)
def op11_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.ranking import ranked

    return ranked(load_table(spark, sf_dir, "documents"), load_table(spark, sf_dir, "benchmark"), k=20)


@query("op12_mixture")
def op12_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.mixing import mix

    return mix(load_table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5)


COLLOCATIONS_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
             translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, k, w[i:i + k - 1] AS ws FROM (
        SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (VALUES (1), (2), (3), (4), (5)) v(k) WHERE len(w) >= k)),
total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
f AS (SELECT lang, k, ws, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
cut AS (SELECT lang, k, ws, f AS a, unnest(range(1, k)) AS j FROM f WHERE k > 1),
s AS (SELECT c.lang, c.k, c.ws, c.a, c.j, x.f AS l, y.f AS r, t.n,
             CAST((1000::HUGEINT * c.a * t.n) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
      FROM cut c JOIN f x ON x.lang = c.lang AND x.ws = c.ws[1:c.j] JOIN f y ON y.lang = c.lang AND y.ws = c.ws[c.j + 1:c.k]
      JOIN total t ON t.lang = c.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, ws ORDER BY score, j) = 1),
inside AS (SELECT f.lang, f.ws[i:i + m - 1] AS ws, max(f.f) AS most
           FROM f, (VALUES (2), (3), (4)) v(m), (VALUES (1), (2), (3), (4)) o(i) WHERE m < f.k AND i + m - 1 <= f.k GROUP BY ALL)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, array_to_string(b.ws, ' ')) AS rank,
       array_to_string(b.ws, ' ') AS phrase, b.a, b.l, b.r, b.n, b.score
FROM b LEFT JOIN inside ON inside.lang = b.lang AND inside.ws = b.ws
WHERE inside.most IS NULL OR 100 * inside.most < 100 * b.a QUALIFY rank <= 2000
"""


@query("op13_collocations", COLLOCATIONS_SQL)
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.collocations import collocations

    return collocations(load_table(spark, sf_dir, "documents"), least=100, most=2000)
