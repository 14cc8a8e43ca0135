"""Equal baskets are looked up once a class, equal graphs walked once a bucket."""

import pandas as pd
from pyspark.sql import functions as F

from tessera.operators import gspan, itemsets


def _baskets(spark):
    """300 baskets of three sets, and two large baskets beyond the bound of a set."""
    rows = [(f"b{i}", x) for i in range(300) for x in ("pq", "pqr", "s")[i % 3]]
    rows += [(f"big{j}", f"i{n}") for j in range(2) for n in range(itemsets.SMALL_BASKET + 5)] + [("big0", "p"), ("big0", "q")]
    return spark.createDataFrame(rows, "basket string, item string")


def test_classes_hold_every_basket_once(spark):
    c = itemsets.basket_classes(_baskets(spark))
    assert sorted(r["weight"] for r in c.sizes.collect()) == [1, 1, 100, 100, 100]
    assert c.members.count() == 302 and c.members.select("basket").distinct().count() == 302
    assert c.rows.count() == 2 + 3 + 1 + 2 * (itemsets.SMALL_BASKET + 5) + 2


def test_member_baskets_equal_the_plain_join(spark, monkeypatch):
    monkeypatch.setattr(itemsets, "MEMBERS_PER_SALT", 7)
    tx = _baskets(spark)
    cands = spark.createDataFrame([(["p", "q"],), (["s"],), (["p", "r"],), (["p", "s"],), (["i1", "i2", "p"],)], "items array<string>")
    want = sorted(map(str, itemsets.containing_baskets(tx, cands).collect()))
    got = sorted(map(str, itemsets.member_baskets(itemsets.basket_classes(tx), cands).select("items", "basket").collect()))
    assert got == want and len(got) == 201 + 100 + 100 + 1


def test_candidates_are_counted_on_classes(spark, monkeypatch):
    seen, real = [], itemsets.count_support
    monkeypatch.setattr(itemsets, "count_support", lambda tx, c, k: seen.append(tx.count()) or real(tx, c, k))
    tx = _baskets(spark).where(~F.col("basket").startswith("big"))
    m = itemsets.mine(tx, min_count=20, candidate_rule="extend")
    got = {tuple(r["items"]): r["support_count"] for r in m.frequent.collect()}
    assert got == {("p",): 200, ("q",): 200, ("r",): 100, ("s",): 100, ("p", "q"): 200, ("p", "r"): 100, ("q", "r"): 100, ("p", "q", "r"): 100}
    assert seen and max(seen) == 6


def test_equal_graphs_are_walked_once(monkeypatch):
    walks, real = [], gspan.dfs_code
    monkeypatch.setattr(gspan, "dfs_code", lambda *a: walks.append(1) or real(*a))
    ring = [("K", 0, "L"), ("L", 0, "M"), ("M", 0, "K")]
    turned = [("K", 0, "M"), ("M", 0, "L"), ("L", 0, "K")]
    pdf = pd.DataFrame([(f"g{i:02d}", *e) for i in range(40) for e in (reversed(ring) if i % 4 else turned)],
                       columns=["graph", "src", "pos", "dst"])
    out = gspan.bucket_codes(pdf, None, True)
    assert len(walks) == 2 and list(out["graph"].unique()) == [f"g{i:02d}" for i in range(40)]
    for g, part in out.groupby("graph"):
        want = real({"K": ["M"], "M": ["L"], "L": ["K"]} if int(g[1:]) % 4 == 0 else {"K": ["L"], "L": ["M"], "M": ["K"]}, "K")
        assert list(part[["i", "j", "li", "el", "lj"]].itertuples(index=False, name=None)) == want
