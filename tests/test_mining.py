"""Itemsets, rules, sequences and graph Apriori on own data, against brute force."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tessera.functions.columns import parse_timestamp
from tessera.operators import graphs, itemsets, sequences


def _tx(spark, baskets):
    rows = [(i, it) for i, b in enumerate(baskets) for it in b]
    return itemsets.basket_items(spark.createDataFrame(rows, "INVOICENO long, PRODUCTNAME string"),
                                 "INVOICENO", "PRODUCTNAME")


def _sets(mined):
    return {r.itemset: r.support_count for r in itemsets.itemset_table(mined).collect()}


def test_apriori_fixture(spark):
    m = itemsets.mine(_tx(spark, ["ABC", "AB", "BC", "AC", "ABD"]), min_support=0.4)
    assert _sets(m) == {"A": 4, "B": 4, "C": 3, "A, B": 3, "A, C": 2, "B, C": 2}
    rules = {(r.antecedent, r.consequent): round(r.confidence, 4)
             for r in itemsets.association_rules(m.frequent, 0.5).collect()}
    assert rules == {("A", "B"): 0.75, ("B", "A"): 0.75, ("A", "C"): 0.5, ("B", "C"): 0.5,
                     ("C", "A"): 0.6667, ("C", "B"): 0.6667}


def test_fp_fixture_apriori_and_fpgrowth_agree(spark):
    tx = _tx(spark, ["ABC", "AB", "BC", "AC", "ABCD"])
    expected = {"A": 4, "B": 4, "C": 4, "A, B": 3, "A, C": 3, "B, C": 3, "A, B, C": 2}
    assert _sets(itemsets.mine(tx, min_support=0.4)) == expected
    b = tx.groupBy("basket").agg(F.collect_list("item").alias("items"))
    fp = {r.itemset: r.support_count for r in itemsets.fpgrowth(b, 0.4).collect()}
    assert fp == expected
    rules = itemsets.association_rules(itemsets.mine(tx, min_support=0.4).frequent, 0.5).collect()
    conf = {(r.antecedent, r.consequent): round(r.confidence, 4) for r in rules}
    assert conf[("A, B", "C")] == conf[("A, C", "B")] == conf[("B, C", "A")] == 0.6667
    assert sum(1 for v in conf.values() if v == 0.75) == 6


def test_support_boundary_is_inclusive(spark):
    """7 of 100 baskets at support 0.07 is frequent (count/total >= s)."""
    baskets = ["XY"] * 7 + ["Z"] * 93
    tx = _tx(spark, baskets)
    assert _sets(itemsets.mine(tx, min_support=0.07))["X, Y"] == 7
    b = tx.groupBy("basket").agg(F.collect_list("item").alias("items"))
    assert "X, Y" in {r.itemset for r in itemsets.fpgrowth(b, 0.07).collect()}


def test_empty_and_high_support(spark):
    assert itemsets.mine(_tx(spark, []), min_support=0.4).n_baskets == 0
    assert _sets(itemsets.mine(_tx(spark, ["ABC", "AB", "BC", "AC", "ABD"]), min_support=0.9)) == {}


def _edge_files(seed, n_graphs=5):
    """Random edge lists as text, and the edge sets they stand for."""
    rnd = random.Random(seed)
    lines, sets = [], []
    for g in range(n_graphs):
        pairs = sorted({tuple(sorted(rnd.sample("KLMNO", 2))) for _ in range(rnd.randint(2, 6))})
        lines += [f"# Graph {g + 1}", *[" ".join(rnd.sample(p, 2)) for p in pairs]]
        sets.append({f"({a}, {b})" for a, b in pairs})
    return "\n".join(lines), sets


@pytest.mark.parametrize("seed,least", [(1, 2), (2, 3), (5, 2)])
def test_graph_apriori(spark, tmp_path, seed, least):
    text, sets = _edge_files(seed)
    p = tmp_path / "edges.txt"
    p.write_text(text)
    edges = graphs.parse_edge_list_text(spark, str(p))
    tx = itemsets.basket_items(edges.select("graph_id", graphs.edge_label("src", "dst").alias("e")), "graph_id", "e")
    m = itemsets.mine(tx, min_count=least, candidate_rule="extend")
    every = sorted(set().union(*sets))
    want = {c: n for k in range(1, len(every) + 1) for c in combinations(every, k)
            if (n := sum(set(c) <= s for s in sets)) >= least}
    assert want and {tuple(r["items"]): r.support_count for r in m.frequent.collect()} == want


def _gsp_rows(spark, rows):
    df = spark.createDataFrame(rows, "NAME string, INVOICEDATE string, PRODUCTNAME string")
    return sequences.vertical_by_element(
        df, "NAME", F.unix_seconds(parse_timestamp("INVOICEDATE", "dd-MM-yyyy")), "PRODUCTNAME")


def _patterns(res):
    return {r.pattern: r.support_count for r in sequences.pattern_table(res.frequent).collect()}


def _random_sequences(seed, customers=6):
    rnd = random.Random(seed)
    return {str(c): [sorted(set(rnd.choices("KLMN", k=rnd.randint(1, 3)))) for _ in range(rnd.randint(1, 4))]
            for c in range(customers)}


def _holds(pattern, sequence):
    at = 0
    for part in pattern:
        while at < len(sequence) and not set(part) <= set(sequence[at]):
            at += 1
        if at == len(sequence):
            return False
        at += 1
    return True


def _brute_sequences(data, support):
    """Every pattern of any length that enough sequences hold, by growth."""
    need, parts = support * len(data), [c for k in (1, 2, 3) for c in combinations("KLMN", k)]
    count = lambda p: sum(_holds(p, s) for s in data.values())
    out, level = {}, [(c,) for c in parts if count((c,)) >= need]
    while level:
        out.update({p: count(p) for p in level})
        level = [p + (c,) for p in level for c in parts if count(p + (c,)) >= need]
    show = lambda c: c[0] if len(c) == 1 else "{" + ", ".join(c) + "}"
    return {("{" + ", ".join(p[0]) + "}") if len(p) == 1 else "<" + " -> ".join(map(show, p)) + ">": n for p, n in out.items()}


@pytest.mark.parametrize("seed,support", [(1, 0.5), (2, 0.34), (4, 0.67)])
def test_sequences_by_element(spark, seed, support):
    data = _random_sequences(seed)
    rows = [(c, f"{3 + 2 * i:02d}-0{1 + i % 3}-2024", x) for c, s in data.items() for i, e in enumerate(s) for x in e]
    rows = [(c, f"05-{1 + int(d[:2]):02d}-2024", x) for c, d, x in rows]
    got = _patterns(sequences.mine_sequences(_gsp_rows(spark, rows), support))
    assert got == _brute_sequences(data, support)


@pytest.mark.parametrize("seed,support", [(3, 0.5), (6, 0.34)])
def test_sequences_by_row(spark, seed, support):
    data = _random_sequences(seed)
    rows = [(int(c), f"{1 + i // 2}/7/2024", ",".join(e), i) for c, s in data.items() for i, e in enumerate(s)]
    df = spark.createDataFrame(rows, "NAME long, INVOICEDATE string, PRODUCTNAME string, row long") \
        .withColumn("d", parse_timestamp("INVOICEDATE", "M/d/yyyy"))
    v = sequences.vertical_by_row(df, "NAME", ["d", "row"], "PRODUCTNAME")
    assert _patterns(sequences.mine_sequences(v, support)) == _brute_sequences(data, support)


def test_pattern_format_and_length(spark):
    df = spark.createDataFrame([([["A", "B"]],), ([["A"], ["B"]],), ([["C"]],)], "p array<array<string>>")
    out = df.select(sequences.format_sequence(F.col("p")).alias("f"),
                    sequences.sequence_length(F.col("p")).alias("n")).collect()
    assert [(r.f, r.n) for r in out] == [("{A, B}", 2), ("<A -> B>", 2), ("{C}", 1)]


def test_hybrid_small_and_big_baskets_agree(spark, monkeypatch):
    rnd = random.Random(3)
    baskets = ["".join(sorted(set(rnd.choice("ABCDEFG") for _ in range(rnd.randint(1, 6))))) for _ in range(60)]
    tx = _tx(spark, baskets)
    base = _sets(itemsets.mine(tx, min_support=0.1))
    monkeypatch.setattr(itemsets, "SMALL_BASKET", 2)   # most baskets now take the candidate-join path
    mixed = _sets(itemsets.mine(tx, min_support=0.1))
    assert mixed == base and any(len(k.split(", ")) >= 3 for k in base)


def test_edge_list_parser_edge_cases(spark, tmp_path):
    d = tmp_path / "g"
    d.mkdir()
    (d / "a.txt").write_text("# G1\n# G2\nB A\n\n# G3\nC D\nD C\n")
    (d / "b.txt").write_text("# only\nX Y\n")
    rows = graphs.parse_edge_list_text(spark, str(d)).collect()
    got = sorted((r.file.rsplit("/", 1)[-1], r.graph_id, r.src, r.dst) for r in rows)
    assert got == [("a.txt", 1, "A", "B"), ("a.txt", 2, "C", "D"), ("a.txt", 2, "C", "D"), ("b.txt", 1, "X", "Y")]


def _brute_itemsets(baskets, least):
    from itertools import combinations
    out, items = {}, sorted({i for b in baskets for i in b})
    for k in (1, 2, 3, 4):
        for c in combinations(items, k):
            n = sum(set(c) <= set(b) for b in baskets)
            if n >= least:
                out[", ".join(c)] = n
    return out


@pytest.mark.parametrize("small,buckets", [(64, 1 << 18), (64, 3), (4, 3), (1, 1), (3, 1 << 18)])
def test_pair_counters_lose_nothing(spark, monkeypatch, small, buckets):
    """Counters that share buckets, baskets on both sides of the size limit, pairs
    frequent only in large baskets or only in both kinds together."""
    import random
    monkeypatch.setattr(itemsets, "SMALL_BASKET", small)
    monkeypatch.setattr(itemsets, "PAIR_BUCKETS", buckets)
    rnd = random.Random(3)
    baskets = ["".join(sorted(rnd.sample("ABCDEFGHIJ", rnd.choice([1, 2, 3, 5, 7])))) for _ in range(60)] + ["YZVWX"] * 9 + ["YZ"] * 2
    mined = itemsets.mine(_tx(spark, baskets), min_count=9, max_level=4)
    assert _sets(mined) == _brute_itemsets(baskets, 9)
    assert "NestedLoop" not in mined.frequent._jdf.queryExecution().executedPlan().toString()


def test_pairs_of_heavy_items_come_block_by_block(spark):
    df = spark.createDataFrame([(c,) for c in "DACBE"], "item string")
    got = sorted("".join(r["items"]) for r in itemsets._heavy_pairs(df, block=2).collect())
    assert got == ["AB", "AC", "AD", "AE", "BC", "BD", "BE", "CD", "CE", "DE"]


def test_element_pairs_are_counted_from_occurrences(spark):
    """Ordered pairs per sequence, an element after itself included."""
    import random
    rnd = random.Random(8)
    seqs = {s: [rnd.choice("abcd") for _ in range(rnd.randint(1, 7))] for s in range(40)}
    occ = spark.createDataFrame([([x], str(s), i) for s, xs in seqs.items() for i, x in enumerate(xs)], "elem array<string>, sid string, eid long")
    got = {(r["prefix"][0][0], r["elem"][0]): r["support_count"] for r in sequences._element_pairs(occ).collect()}
    want = {}
    for xs in seqs.values():
        for p in {(xs[i], xs[j]) for i in range(len(xs)) for j in range(i + 1, len(xs))}:
            want[p] = want.get(p, 0) + 1
    assert got == want


def test_sequence_levels_join_on_numbers(spark):
    """Occurrences and states carry numbers of elements; their items stay in the small tables."""
    v = spark.createDataFrame([("s", i, x) for i, x in enumerate("abab")] + [("t", 1, "a"), ("t", 1, "b"), ("t", 2, "a")],
                              "sid string, eid long, item string")
    _, codes, occ = sequences.frequent_elements(v, 0.5)
    assert dict(occ.dtypes) == {"e": "bigint", "sid": "string", "eid": "bigint"}
    back = {(tuple(r["elem"]), r["sid"], r["eid"]) for r in occ.join(codes, "e").collect()}
    assert back == {(("a",), "s", 0), (("b",), "s", 1), (("a",), "s", 2), (("b",), "s", 3), (("a",), "t", 1), (("b",), "t", 1),
                    (("a", "b"), "t", 1), (("a",), "t", 2)}
