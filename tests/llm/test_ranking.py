"""Ranked search and collocations against plain Python."""

import math
import random
import re
from collections import Counter

import pytest

from tessera.llm import collocations as col
from tessera.llm import ranking

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute_ranking(docs, items, k):
    words = [(d, TERM.findall(lower(t or ""))) for d, t in docs]
    n_docs, n_words = sum(bool(w) for _, w in words), sum(len(w) for _, w in words)
    df = Counter(t for _, w in words for t in set(w))
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * f + 1))) for t, f in df.items()}
    out = []
    for item, text in {(i, t) for i, t in items}:
        scored = []
        for d, w in words:
            if w:
                m, tf = 75 + 25 * len(w) * n_docs // n_words, Counter(w)
                score = sum(weight[t] * (10**9 * tf[t] // (1000 * tf[t] + 12 * m)) for t in TERM.findall(lower(text or "")) if t in tf)
                if score > 0:
                    scored.append((-score, d is not None, d or 0, d))
        out += [(item, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def corpus(seed, n=300):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)] + ["Ä", "ä", "été", "漢字", "X1", "x1"]
    pick = lambda m: " ".join(vocab[min(len(vocab) - 1, int(rnd.expovariate(0.12)))] + rnd.choice(["", ",", ".", "-"]) for _ in range(m))
    docs = [(i, pick(rnd.randint(0, 40))) for i in range(n)]
    docs += [(i + 1000, docs[i][1]) for i in range(0, 40)]     # ties
    docs += [(5, docs[9][1]), (5, docs[9][1]), (None, docs[3][1]), (2000, None), (2001, ""), (2002, "?!"), (2003, pick(30_000))]
    items = [(i, pick(rnd.randint(1, 12))) for i in range(25)] + [(3, "w0 w0 w1 W1"), (99, None), (98, ""), (97, "zzz"), (None, "w2")]
    return docs, items + [items[0]]


@pytest.mark.parametrize("window,short,segment", [(512, 8, 8 << 20), (16, 1000, 2000), (8, 1, 1)])
def test_ranking_is_exact(spark, monkeypatch, window, short, segment):
    monkeypatch.setattr(ranking, "WINDOW", window)
    monkeypatch.setattr(ranking, "SHORT", short)
    monkeypatch.setattr(ranking, "LEAST", 3)
    monkeypatch.setattr(ranking, "SEGMENT_BYTES", segment)
    monkeypatch.setattr(ranking, "BLOCK_BYTES", 900)
    docs, items = corpus(7)
    d = spark.createDataFrame([(i, t, "s", 1) for i, t in docs], "doc_id long, text string, term string, score int").repartition(3)
    q = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, rank int")
    got = ranking.ranked(d, q, k=6).collect()
    assert got[0].__fields__ == ["item_id", "rank", "doc_id", "score"]
    assert sorted([tuple(r) for r in got], key=str) == brute_ranking(docs, items, 6)


def test_long_lists_are_skipped():
    """A window whose bounds stay below the k-th best score is not scored."""
    import numpy as np
    import pyarrow as pa
    n = 4096
    tfs = np.r_[np.full(512, 50), np.ones(n - 512, np.int64)]
    queries = ranking.Queries([[0]], [[1000]], n, n * 10)
    seg = ranking.Segment(pa.array(np.arange(n)), np.full(n, 10), np.array([0]), np.array([0, n]), np.arange(n), tfs, queries)
    best = ranking.Best(5)
    ranking.rank_segment(seg, queries.terms[0], queries.weights[0], best)
    assert best.ids == [0, 1, 2, 3, 4]
    before = list(best.scores)
    low = ranking.Segment(pa.array(np.arange(n)), np.full(n, 10), np.array([0]), np.array([0, n]), np.arange(n), np.ones(n, np.int64), queries)
    ranking.rank_segment(low, queries.terms[0], queries.weights[0], best)
    assert best.scores == before and not low.parts              # nothing of it was even computed


def test_ranking_of_empty_tables(spark):
    docs, items = corpus(1)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    q = spark.createDataFrame(items, "item_id long, text string")
    assert ranking.ranked(d.limit(0), q).count() == 0
    assert ranking.ranked(d, q.limit(0)).count() == 0
    assert ranking.ranked(d.where("text is null"), q).count() == 0


def brute_phrases(docs, least, most):
    grams, total = {}, Counter()
    for text, lang in docs:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\x0A-\x0D]", lower(text or "")):
            w = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    grams.setdefault(lang, Counter())[tuple(w[i:i + k])] += 1
    out = []
    for lang, f in grams.items():
        found = []
        for p, a in f.items():
            if len(p) < 2 or a < least:
                continue
            if any(f[x] >= a for x in f if len(x) > len(p) and f[x] >= least and any(x[i:i + len(p)] == p for i in range(len(x) - len(p) + 1))):
                continue
            score, _, left, right = min((1000 * a * total[lang] // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), a, left, right, score))
        out += [(lang, i + 1, p.decode(), a, left, right, total[lang], s)
                for i, (_, _, p, a, left, right, s) in enumerate(sorted(found)[:most])]
    return sorted(out)


def phrase_docs(seed):
    rnd = random.Random(seed)
    phrases = ["New York City", "out of the blue", "été à la mer", "a b a b a b", "x x x x x x", "one two three four five six"]
    words = ["the", "of", "to", "Ärger", "ärger", "z\x00z", "o'k"]
    docs = []
    for _ in range(250):
        text = "".join(rnd.choice(phrases + words * 2) + rnd.choice([" ", " ", "  ", "\t", ", ", ".", "\n", "\r", "; "]) for _ in range(rnd.randint(0, 30)))
        docs.append((text, rnd.choice(["en", "en", "fr", None])))
    return docs + [(None, "en"), (None, None), ("", "de"), (" ,. ", "de"), docs[0], docs[0]]


@pytest.mark.parametrize("shards,chunk", [(1, 8 << 20), (4, 700), (7, 1)])
def test_collocations_are_exact(spark, monkeypatch, shards, chunk):
    monkeypatch.setattr(col, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(col, "BUCKET_WORDS", max(1, chunk >> 10))
    monkeypatch.setattr(col, "ADD_BYTES", min(chunk, 8 << 20))
    monkeypatch.setattr(col, "ROW_KEYS", min(chunk, 1 << 15))
    monkeypatch.setattr(col, "NAME_CHUNKS", 2)
    docs = phrase_docs(11)
    df = spark.createDataFrame([(t, lang, 1, "x") for t, lang in docs], "text string, lang string, n int, phrase string").repartition(3)
    got = col.collocations(df, least=8, most=30, shards=shards).collect()
    assert got[0].__fields__ == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got) == brute_phrases(docs, 8, 30)


@pytest.mark.parametrize("slots", [2, 32, 128])
def test_clashes_in_the_table_of_active_phrases_change_nothing(spark, monkeypatch, slots):
    """Few slots for everything: phrases start early, counts stay exact."""
    monkeypatch.setattr(col, "CHUNK_BYTES", 500 if slots == 2 else 1 << 20)
    monkeypatch.setattr(col, "MOST_SLOTS", slots)
    docs = phrase_docs(4)
    got = col.collocations(spark.createDataFrame(docs, "text string, lang string").repartition(3), least=8, most=50, shards=3)
    assert sorted(tuple(r) for r in got.collect()) == brute_phrases(docs, 8, 50)


def test_collocations_of_empty_and_long_texts(spark):
    kind = "text string, lang string"
    assert col.collocations(spark.createDataFrame([], kind)).count() == 0
    assert col.collocations(spark.createDataFrame([(None, "en"), ("", None)], kind)).count() == 0
    got = col.collocations(spark.createDataFrame([("ab cd " * 200_000, "en")], kind), least=100, most=9)
    assert [tuple(r)[2:4] for r in got.collect()] == [tuple(r)[2:4] for r in got.collect()] and got.count() > 0
    assert all(r["n"] == 400_000 for r in got.collect())
