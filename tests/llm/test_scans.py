"""License scan and benchmark decontamination on planted texts."""

import random

import numpy as np

from tessera.llm.decontaminate import MATCH, align, find_items
from tessera.llm.licenses import TEMPLATES, scan


def test_every_template_is_found_exactly(spark):
    names = list(TEMPLATES)
    rows = [(i, "Some prose comes first here.\n" + TEMPLATES[n] + "\nAnd other prose follows it.", 1) for i, n in enumerate(names)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, line int")
    got = {r["doc_id"]: r for r in scan(docs).collect()}
    for i, n in enumerate(names):
        assert (got[i]["license"], got[i]["form"], got[i]["exact"], got[i]["line"]) == (*n, True, 1)


def test_license_wording_differences_and_edges(spark):
    rows = [(1, "licensed under the apache license, version 2.0"), (2, "Released under an MIT License."), (3, None), (4, ""),
            (5, "A driving licence is needed."), (6, "plain words"), (None, "Released under the MIT License."),
            (8, "word " * 30000 + "\nReleased under the MIT License.\n" + "word " * 30000)]
    docs = spark.createDataFrame(rows + rows[:1], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["license"], r["exact"], r["n_missing"], r["n_added"]) for r in scan(docs, least=0.75).collect())
    assert got == [(0, "MIT", True, 0, 0), (1, "Apache-2.0", True, 0, 0), (1, "Apache-2.0", True, 0, 0), (2, "MIT", False, 1, 1),
                   (8, "MIT", True, 0, 0)]
    assert scan(docs.limit(0)).count() == 0


def test_every_notice_of_a_text_is_found(spark):
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    header = TEMPLATES["Apache-2.0", "header"].replace(" you may", "\nyou may").replace(" Unless", "\nUnless")
    gpl = TEMPLATES["GPL-3.0", "header"].replace(" the Free", "\nthe Free")
    rows = [(1, f"{mit}\nprose\n{apache}"), (2, f"{apache}\nprose\n{mit}"), (3, f"{mit} {apache}"), (4, f"İ prose\n\nx\n{apache} Prose. {mit}"),
            (5, f"{mit[:-1]} and {apache[:-1]} and {mit}"), (6, f"prose\n{header}\nprose\n{gpl}\n{mit}"), (7, f"{mit}\n{mit}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {}
    for r in scan(docs).collect():
        assert r["exact"]
        got.setdefault(r["doc_id"], []).append((r["line"], r["license"], r["form"]))
    m, a = ("MIT", "line"), ("Apache-2.0", "line")
    assert got == {1: [(0, *m), (2, *a)], 2: [(0, *a), (2, *m)], 3: [(0, *m), (0, *a)], 4: [(3, *a), (3, *m)],
                   5: [(0, *m), (0, *a), (0, *m)], 6: [(1, "Apache-2.0", "header"), (5, "GPL-3.0", "header"), (7, *m)],
                   7: [(0, *m), (1, *m)]}


def test_notices_are_found_whatever_the_length_of_the_text(spark):
    """The longer templates, wrapped at 60 columns, without blank lines, in prose of
    8 kB to 600 kB and in one single line."""
    import textwrap
    rnd = random.Random(4)
    vocab = ["".join(rnd.choices("abcdefghilmnoprstu", k=rnd.randint(2, 9))) for _ in range(400)]
    prose = lambda k: " ".join(rnd.choices(vocab, k=k))
    names = [n for n, t in TEMPLATES.items() if len(t) > 150]
    rows = []
    for i, size in enumerate((8_000, 60_000, 600_000)):
        parts = [prose(size // 6 // (len(names) + 1)) + ". " + TEMPLATES[n] + " " for n in names] + [prose(50)]
        rows.append((2 * i, textwrap.fill("".join(parts), 60)))
        rows.append((2 * i + 1, "".join(parts)))
    got = {}
    for r in scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r["doc_id"], []).append((r["license"], r["form"]))
    assert all(sorted(got[i]) == sorted(names) for i, _ in rows)


def test_windows_hold_every_short_part():
    from tessera.llm.licenses import windows, word_list
    words = [f"license{i}" for i in range(57)]
    for n in (3, 7, 14, 15, 21, 57):
        text = " ".join(words[:n])
        got = [(at, word_list(w)) for at, w in windows(text, 7)]
        assert all(w == words[at:at + len(w)] and len(w) <= 14 for at, w in got)
        assert all(any(at <= s and s + 7 <= at + len(w) for at, w in got) for s in range(max(0, n - 6)))


def smith_waterman(a, b):
    h, best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)], 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    return best


def test_alignment_score():
    rnd = random.Random(1)
    a = [[rnd.randrange(1, 6) for _ in range(rnd.randint(1, 14))] for _ in range(60)]
    b = [[rnd.randrange(1, 6) for _ in range(rnd.randint(1, 30))] for _ in range(60)]
    pad = lambda rows: np.array([r + [0] * (max(map(len, rows)) - len(r)) for r in rows], np.uint64)
    size = lambda rows: np.array([len(r) for r in rows])
    got, _ = align(pad(a), size(a), pad(b), size(b))
    assert got.tolist() == [smith_waterman(x, y) for x, y in zip(a, b)]


def test_planted_items(spark):
    rnd = random.Random(9)
    vocab = [f"{c}{d}{e}" for c in "bdfgk" for d in "aeiou" for e in "lmnrst"]
    text = lambda k: " ".join(rnd.choices(vocab, k=k))
    items = [(i, text(40)) for i in range(6)] + [(6, None), (7, "too short"), (8, "")]
    edited = items[1][1].split()
    for k in range(0, 40, 9):
        edited[k] = "changed"
    del edited[20]
    docs = [(1, text(60) + " " + items[0][1].upper() + ", " + text(60)), (2, text(30) + " " + " ".join(edited) + " " + text(2000)),
            (3, text(300)), (4, None), (5, ""), (6, items[2][1] + ". " + items[3][1]), (None, items[4][1]), (6, items[2][1] + ". " + items[3][1]),
            (8, "too short"), (9, " ".join(items[5][1].split()[:12]))]
    df = spark.createDataFrame([(i, t, 0.0) for i, t in docs], "doc_id long, text string, score double")
    tests = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r["doc_id"] or 0, r["item_id"], r["score"]) for r in find_items(df, tests).collect()))
    assert [(a, b) for a, b, _ in got] == [(0, 4), (1, 0), (2, 1), (6, 2), (6, 2), (6, 3), (6, 3)]
    by = {(a, b): s for a, b, s in got}
    assert by[1, 0] == 1.0 and 0.6 <= by[2, 1] < 1.0
    words = df.where("doc_id = 1").first()["text"].lower().replace(",", "").split()
    row = find_items(df, tests).where("doc_id = 1").first()
    assert words[row["last_word"] - 40:row["last_word"]] == items[0][1].split() and MATCH == 2
    assert find_items(df.limit(0), tests).count() == 0 and find_items(df, tests.limit(0)).count() == 0
