"""SentencePiece operator against the library itself."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.llm.queries import QUERIES, tokenizer_path
from tessera.llm.sentencepiece_bpe import LONG_WORD, decode, decode_flat, encode, load_model

sentencepiece = pytest.importorskip("sentencepiece")

EDGES = ["", " ", " a", "  a b", "\n", "a ", "▁a", "a▁▁ b", "é漢字😀", "<s>x</s><unk>", "\x00a", "<0x0A>", "　x", "\t x\r\n",
         " " * 1000 + "x", "colony colonies coloncolony" * 40, "a" * (LONG_WORD + 5), "ab" * LONG_WORD, "😀" * 50]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())


def texts():
    rnd = random.Random(5)
    parts = ["a", "b", "é", "漢", "😀", " ", "\n", "▁", "th", "in", " er", "ing", "colon", "y", "   "]
    return EDGES + ["".join(rnd.choices(parts, k=rnd.randint(0, 80))) for _ in range(300)]


def test_encode_and_decode_equal_the_library(spark, library):
    rows = [(i, t, "x") for i, t in enumerate(texts())] + [(-1, None, None), (3, "  a b", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = encode(docs, tokenizer_path(), decoded=True).collect()
    by = {(r["doc_id"], tuple(r["ids"]), r["decoded"], r["n_tokens"]) for r in got}
    want = set()
    for i, t, _ in rows:
        ids = library.encode(t or "", add_eos=True)
        want.add((i, tuple(ids), library.decode(ids), len(ids)))
    assert by == want and len(got) == len(rows)


def test_decode_operator_and_invalid_bytes(spark, library):
    rnd = random.Random(2)
    lists = [[rnd.choice([0, 1, 2, rnd.randint(3, 258), rnd.randint(200, 258), rnd.randint(259, 31999), 28705])
              for _ in range(rnd.randint(0, 9))] for _ in range(200)]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lists)] + [(-1, None)], "doc_id long, ids array<int>")
    got = {r["doc_id"]: r["text"] for r in decode(rows, tokenizer_path()).collect()}
    assert got.pop(-1) == ""
    assert got == {i: library.decode(x) for i, x in enumerate(lists)}


def test_query_digests(spark, library):
    import hashlib
    d = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in QUERIES["op10_sentencepiece"](spark, d).collect()}
    for r in spark.read.parquet(f"{d}/documents.parquet").collect():
        ids = library.encode(r["text"] or "", add_eos=True)
        g = got[r["doc_id"]]
        assert g["n_tokens"] == len(ids)
        assert g["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert g["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert encode(docs, tokenizer_path(), ids="text", decoded=True).where(F.col("n_tokens") > 0).count() == 0


def test_no_rows_decode():
    import numpy as np
    data, off = decode_flat(load_model(tokenizer_path()), np.zeros(0, np.int64), np.zeros(1, np.int64))
    assert len(data) == 0 and off.tolist() == [0]
