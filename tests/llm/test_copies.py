"""MinHash, embeddings, lines, suffix arrays and components against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from tessera.llm import embeddings, minhash, suffixes
from tessera.llm.components import components
from tessera.llm.lines import drop_repeated_lines, runs


def union(n, pairs):
    up = {x: x for x in n}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in n}


def shingle_set(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def near_texts(n_copies=45):
    rnd = random.Random(3)
    vocab = [f"w{i}" for i in range(400)]
    texts = [" ".join(rnd.choices(vocab, k=rnd.randint(1, 80))) for _ in range(60)]
    base = rnd.choices(vocab, k=120)
    for i in range(n_copies):                                  # one family larger than a small bucket
        own = list(base)
        for _ in range(rnd.randint(0, 5)):
            own[rnd.randrange(120)] = f"edit{i}-{rnd.randint(0, 9)}"
        texts.append(" ".join(own))
    texts += [texts[0], texts[0].upper(), "", " \t\n", None, "one two", "One  two", "x " * 3000 + "end"]
    return texts


def test_minhash_components(spark):
    texts = near_texts()
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, slot string")
    got = {r["doc_id"]: r for r in minhash.near_duplicates(docs, percent=85).collect()}
    sets = [shingle_set(t) for t in texts]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j]
             and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    comp = union(range(len(texts)), pairs)
    assert {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in got.items()} == \
        {i: (len(s), comp[i], comp[i] == i) for i, s in enumerate(sets)}


def test_minhash_repeated_rows_and_nulls(spark):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (None, None), (7, "z y x w v u")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"], r["kept"]) for r in
                 minhash.near_duplicates(docs).collect() if r["n_shingles"])
    assert got == [(0, 2, 5, False), (5, 2, 5, True), (5, 2, 5, True), (7, 2, 7, True)]
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def _hashes(words):
    raw = np.frombuffer(" ".join(words).encode(), np.uint8)
    return minhash.shingles(raw, np.array([0, len(raw)]))


def test_minhash_class_alone_in_its_size_band(spark):
    # 106 shingles whose minima all lie in the first 100, so all texts below share every table of the longest,
    # and at 95 percent the smallest class' band ends at 105
    same = lambda w: (minhash.half_keys(*_hashes(w)) == minhash.half_keys(*_hashes(w[:104]))).all()
    base = next(w for w in ([f"s{seed}w{i}" for i in range(110)] for seed in range(2000)) if same(w))
    texts = [" ".join(base[:n]) for n in range(104, 111)] + [f"own{k} " + " ".join(base[:104]) for k in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs, percent=95).collect()}
    assert got[6] == (106, 0) and {c for _, c in got.values()} == {0}


def test_bucket_links_finds_every_join():
    import pandas as pd
    rnd = random.Random(8)
    sets = [np.array(sorted(rnd.sample(range(1, 60), 50)), np.uint64) for _ in range(60)]
    frame = pd.DataFrame({"sid": range(60), "comp": range(60), "side": 1, "items": [x.tobytes() for x in sets]})
    got = minhash.bucket_links(frame, 77)
    alike = [(i, j) for i in range(60) for j in range(i) if 100 * len(set(sets[i]) & set(sets[j])) >= 77 * len(set(sets[i]) | set(sets[j]))]
    assert alike and union(range(60), alike) == union(range(60), list(got.itertuples(index=False)))


@pytest.mark.parametrize("block", [1024, 8])
def test_embeddings(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rng = np.random.default_rng(4)
    base = rng.standard_normal((12, 16))
    vecs = [list(map(float, base[i % 12] + rng.standard_normal(16) * rng.choice([0.02, 0.15, 0.6]))) for i in range(120)]
    vecs += [vecs[0], vecs[0], [2 * x for x in vecs[1]], None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] * 16,
             [None] + [1.0] * 15, [1.0, 2.0], [2.0, 4.0], [1e-30] * 16, [1e30] * 16]
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(vecs)], "vec_id long, embedding array<double>, cid int")
    got = {r["vec_id"]: r for r in embeddings.near_vectors(df, recall=0.999999).collect()}
    unit = [np.array(v) / np.abs(v).max() / np.linalg.norm(np.array(v) / np.abs(v).max())
            if v and None not in v and np.isfinite(v).all() and any(v) else None for v in vecs]
    pairs = [(i, j) for i in range(len(vecs)) for j in range(i)
             if unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.9]
    deg = np.bincount(np.array(pairs).ravel(), minlength=len(vecs))
    comp = union(range(len(vecs)), pairs)
    assert {i: (r["n_links"], r["component_id"], r["kept"]) for i, r in got.items()} == \
        {i: (deg[i], comp[i], comp[i] == i) for i in range(len(vecs))}


def test_embeddings_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embeddings.near_vectors(df).count() == 0
    df = spark.createDataFrame([(1, None), (None, [1.0]), (None, [1.0])], "vec_id long, embedding array<float>")
    assert sorted((r["vec_id"] or 0, r["n_links"]) for r in embeddings.near_vectors(df).collect()) == [(0, 1), (0, 1), (1, 0)]


def test_lines_against_brute_force(spark):
    rnd = random.Random(1)
    texts = ["\n".join(rnd.choice(["aa", "bb", " cc", "cc ", "", "dd"]) for _ in range(rnd.randint(0, 14))) for _ in range(60)]
    texts += [None, "", texts[3], "only", "x\n" * 2000]
    docs = spark.createDataFrame([(i, t, 9) for i, t in enumerate(texts)], "doc_id long, text string, n_lines int")
    got = {r["doc_id"]: r for r in drop_repeated_lines(docs).collect()}
    seen, n = set(), 3
    for i, t in enumerate(texts):
        own = t.split("\n") if t is not None else []
        gone = set()
        for k in range(len(own) - n + 1):
            w = tuple(x.strip(" ") for x in own[k:k + n])
            if w in seen:
                gone |= set(range(k, k + n))
            seen.add(w)
        kept = "\n".join(x for k, x in enumerate(own) if k not in gone) if t is not None else None
        assert (got[i]["text"], got[i]["n_lines"], got[i]["n_removed"]) == (kept, len(own), len(gone))
        assert got[i]["n_runs"] == sum(k - 1 not in gone for k in gone)


def test_short_runs_of_many_words_against_brute_force(spark):
    rnd = random.Random(5)
    pool = ["aa", "b b", " c c c ", "", "d e f g h", "i j k l m n o", "漢" * 41, "p  q\tr s t"]
    texts = ["\n".join(rnd.choice(pool) for _ in range(rnd.randint(1, 7))) for _ in range(80)]
    texts += ["u v w x y\nown one", "z", "own two\nu v w x y", "z", "", "", None, "own three\nz\nz"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in drop_repeated_lines(docs, min_words=5).collect()}
    seen = set()
    for i, t in enumerate(texts):
        own, gone = t.split("\n") if t is not None else [], set()
        for n in (1, 2, 3):
            for k in range(len(own) - n + 1):
                w = tuple(x.strip(" ") for x in own[k:k + n])
                words = sum(max(len(x.split()), len(x) // 8) for x in w)
                for kind in ["run"] * (n == 3 or words >= 5) + ["whole"] * (n == len(own) and words > 0):
                    if (kind, w) in seen:
                        gone |= set(range(k, k + n))
                    seen.add((kind, w))
        kept = "\n".join(x for k, x in enumerate(own) if k not in gone) if t is not None else None
        assert (got[i]["text"], got[i]["n_removed"], got[i]["n_runs"]) == (kept, len(gone), sum(k - 1 not in gone for k in gone))
    assert got[82]["text"] == "own two" and got[83]["n_removed"] == 1 and got[87]["n_removed"] == 0


def test_line_runs_name_their_source(spark):
    docs = spark.createDataFrame([(1, "q\na\nb\nc\nd\nr"), (2, "a\nb\nc\nd"), (None, None), (2, "a\nb\nc\nd")], "doc_id long, text string")
    got = [(r["doc"], r["start"], r["n_lines"], r["source"], r["source_line"]) for r in runs(docs).collect()]
    assert got == [(2, 0, 4, 1, 1)]
    assert runs(docs.limit(0)).count() == 0


def brute_bytes(texts, length):
    seen, out = set(), []
    for t in texts:
        b, mark = (t or "").encode(), set()
        for i in range(len(b) - length + 1):
            w = b[i:i + length]
            if w in seen:
                mark |= set(range(i, i + length))
            seen.add(w)
        out.append((len(b), len(mark), sum(k - 1 not in mark for k in mark), bytes(x for k, x in enumerate(b) if k not in mark)))
    return out


@pytest.mark.parametrize("hot", [5000, 2])
def test_suffixes(spark, monkeypatch, hot):
    monkeypatch.setattr(suffixes, "HOT_CONTEXTS", hot)
    rnd = random.Random(6)
    text = lambda k: "".join(rnd.choices("abcdé \n", k=k))
    passage = text(260)
    texts = [text(rnd.randint(0, 300)) for _ in range(25)]
    texts += [text(rnd.randint(0, 90)) + passage[rnd.randint(0, 80):260 - rnd.randint(0, 80)] + text(rnd.randint(0, 90)) for _ in range(30)]
    texts += [texts[3], passage, None, "", "z" * 5000, "ab" * 400, "short"]
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, part string")
    got = {r["doc_id"]: r for r in suffixes.remove_repeats(docs).collect()}
    for i, want in enumerate(brute_bytes(texts, suffixes.LENGTH)):
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], len(r["spans"]), bytes(r["kept"])) == want


def test_suffixes_repeated_rows(spark):
    t = "".join(random.Random(1).choices("abcdef", k=200))
    docs = spark.createDataFrame([(1, t), (1, t), (None, t), (2, t)], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_removed"]) for r in suffixes.remove_repeats(docs).collect())
    assert got == [(0, 0), (1, 200), (1, 200), (2, 200)]
    assert suffixes.remove_repeats(docs.limit(0)).count() == 0


def test_suffix_array_and_common_prefixes():
    rng = np.random.default_rng(3)
    for _ in range(25):
        parts = [bytes(rng.integers(97, 99, rng.integers(0, 120)).astype(np.uint8)) for _ in range(6)]
        parts += parts[:2]
        data, ends = np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts])
        order, rank = suffixes.suffix_array(data, ends)
        at = [(p[i:], e - len(p) + i) for p, e in zip(parts, ends) for i in range(len(p))]
        want = sorted(at)
        assert [k for _, k in want] == order.tolist()
        common = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert suffixes.kasai(data, ends, order, rank).tolist() == [0] + [common(a, b) for (a, _), (b, _) in zip(want, want[1:])]


def test_merge_runs_keeps_the_smallest_place():
    rng = np.random.default_rng(1)
    d, p = rng.integers(0, 40, 200), rng.permutation(200)
    cut = [0, 50, 51, 120, 200]
    made = [(d[a:b][o], p[a:b][o]) for a, b in zip(cut, cut[1:]) for o in [np.lexsort((p[a:b], d[a:b]))]]
    first = {}
    for x, y in zip(d.tolist(), p.tolist()):
        first[x] = min(first.get(x, y), y)
    assert sorted(suffixes.merge_runs(made).tolist()) == sorted(set(p.tolist()) - set(first.values()))


def test_components(spark):
    rnd = random.Random(2)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(rnd.randrange(300, 400), rnd.randrange(300, 400)) for _ in range(60)] + [(7, 7)]
    edges = spark.createDataFrame(pairs, "a long, b long").repartition(6)
    want = union({x for p in pairs if p[0] != p[1] for x in p}, [p for p in pairs if p[0] != p[1]])
    assert {r["node"]: r["comp"] for r in components(edges).collect()} == want
    assert components(edges.limit(0)).count() == 0


def test_kept_hash_matches_query(spark):
    from tessera.llm.queries import QUERIES
    d = "/root/testdata/sf0.001"
    docs = sorted(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect())
    got = {r["doc_id"]: r for r in QUERIES["op7_suffixes"](spark, d).collect()}
    for (i, _), want in zip(docs, brute_bytes([t for _, t in docs], 100)):
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (*want[:3], hashlib.sha256(want[3]).hexdigest())


def test_minhash_links_through_rows_without_an_id(spark):
    """A is like B and C, B is not like C: one group, whether A has an id or not."""
    from tessera.llm.minhash import near_duplicates
    words = [f"w{i}" for i in range(120)]
    a, b, c = " ".join(words), " ".join(words[10:]), " ".join(words[:-10])
    for own in (1, None):
        docs = spark.createDataFrame([(own, a), (2, b), (3, c)], "doc_id long, text string")
        got = {r["doc_id"]: r["component_id"] for r in near_duplicates(docs, percent=85).collect()}
        assert got == {own: own or 2, 2: own or 2, 3: own or 2}


def test_many_runs_in_one_long_text(spark):
    """Thousands of removed runs in one text: what is left is right, in order."""
    n = 12_000
    first = "\n".join(f"line {i} of the first text" for i in range(n))
    other = "\n".join(f"own {i}" if i % 4 == 3 else f"line {i} of the first text" for i in range(n))
    docs = spark.createDataFrame([(1, first), (2, other), (3, first), (4, None), (5, "")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in drop_repeated_lines(docs).collect()}
    assert got[1]["text"] == first and got[3]["text"] == "" and got[4]["text"] is None and got[5]["text"] == ""
    assert got[2]["text"] == "\n".join(f"own {i}" for i in range(3, n, 4))
    assert (got[2]["n_lines"], got[2]["n_removed"], got[2]["n_runs"]) == (n, n * 3 // 4, n // 4)
    assert (got[3]["n_removed"], got[3]["n_runs"]) == (n, 1)
