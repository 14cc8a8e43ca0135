"""Mixing sources: targets, the knapsack against brute force, whole mixes."""

import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import mixing
from tessera.llm.queries import QUERIES


def test_knapsack_is_nearest_to_the_budget():
    rnd = random.Random(3)
    for _ in range(150):
        sizes = np.array(sorted(rnd.sample(range(1, 40), rnd.randint(1, 5))))
        counts = np.array([rnd.randint(0, 3) for _ in sizes])
        budget = rnd.randint(0, 120)
        got = mixing.knapsack(sizes, counts, budget)
        assert (got >= 0).all() and (got <= counts).all()
        sums = {sum(a * b for a, b in zip(sizes.tolist(), c)) for c in itertools.product(*[range(n + 1) for n in counts])}
        best = min(abs(x - budget) for x in sums)
        assert abs(int((got * sizes).sum()) - budget) == best


def test_fill_uses_the_whole_budget_of_many_sizes():
    rnd = np.random.default_rng(1)
    sizes = np.unique(np.r_[1, 2, rnd.integers(1, 3000, 700)])
    counts = rnd.integers(1, 400, len(sizes))
    total = int((sizes * counts).sum())
    for budget in (1, 1000, total // 3, total // 2 + 7, total - 1, total, total + 5):
        got = mixing.fill(sizes, counts, budget)
        assert (got <= counts).all() and int((got * sizes).sum()) == min(budget, total)


def brute_targets(size: dict, weights=(3, 1, 2), share=1.5) -> dict:
    names = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, budget = set(), share * sum(size.values())
    while True:
        free = [s for s in names if s not in full]
        rest = budget - sum(2 * size[s] for s in full)
        over = [s for s in free if rest * w[s] / sum(w[x] for x in free) > 2 * size[s]]
        if not over:
            return {s: 2.0 * size[s] if s in full else rest * w[s] / sum(w[x] for x in free) for s in names}
        full |= set(over)


def rows_of(seed: int):
    rnd = random.Random(seed)
    rows = []
    for i in range(400):
        source = rnd.choice(["a", "b", "é", "z", None, "a", "a"])
        text = rnd.choice([None, "", " ", "\t\n"]) if rnd.random() < 0.1 else " ".join("wört" for _ in range(rnd.randint(1, 60)))
        rows.append((i, text, source))
    return rows + [(7, "x y z", "a")] * 30 + [(None, "x\x0by z", "b")] * 3 + [(1, "one two", "z"), (1, "one  two", "z")]


@pytest.fixture
def tiny_cells(monkeypatch):
    monkeypatch.setattr(mixing, "CELL", 4)
    monkeypatch.setattr(mixing, "COPIES", 7)


def test_a_mix_hits_the_targets_and_reruns_agree(spark, tiny_cells):
    rows = rows_of(5)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
    words = lambda t: len((t or "").replace("\x0b", " ").split())
    size = defaultdict(int)
    for _, text, source in rows:
        size[source] += words(text)
    want = brute_targets(size)
    by_size = {v: s for s, v in size.items()}                 # sizes of the sources differ here
    taken = defaultdict(int)
    for r in got:
        source = by_size[r["source_size"]]
        assert r["target"] == pytest.approx(want[source], rel=1e-12)
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[source] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in size)
    again = mixing.mix(docs.repartition(11)).collect()
    assert Counter(got) == Counter(again)
    other = mixing.mix(docs, seed=99).collect()
    assert Counter(got) != Counter(other)


def test_edges(spark):
    kind = "doc_id long, text string, source string, size string, tie int"
    assert mixing.mix(spark.createDataFrame([], kind)).count() == 0
    blank = mixing.mix(spark.createDataFrame([(1, None, None, "x", 1), (2, " ", "a", None, 2)], kind)).collect()
    assert {(r["doc_id"], r["size"], r["source_size"], r["target"], r["taken"]) for r in blank} == {(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)}
    one = mixing.mix(spark.createDataFrame([(1, "a b c d", "s", "x", 1)], kind)).collect()
    assert [(r["target"], r["taken"]) for r in one] == [(6.0, 4)]   # 6 words are as far from 4 as from 8: the lower
    long_text = mixing.mix(spark.createDataFrame([(1, "w " * 300_000, "s", "x", 1), (2, "a", "s", "x", 1)], kind)).collect()
    assert {(r["doc_id"], r["size"]) for r in long_text} == {(1, 300_000), (2, 1)}


def test_query_over_the_whole_table(spark):
    got = QUERIES["op12_mixture"](spark, "/root/testdata/sf0.001").toPandas()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").toPandas()
    assert sorted(got["doc_id"]) == sorted(docs["doc_id"])
    got = got.merge(docs[["doc_id", "source"]], on="doc_id")
    sums = got.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), size=("source_size", "first"))
    want = brute_targets(sums["size"].to_dict())
    assert all(abs(sums["target"][s] - want[s]) < 1e-6 * max(1, want[s]) for s in want)
    assert ((sums["taken"] - sums["target"]).abs() <= 0.005 * sums["target"]).all()   # ten documents a source here
