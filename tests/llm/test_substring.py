import hashlib
import random

import pytest

from gridloom.llm.substring import factors, remove_repeats


def brute(rows, window):
    first = {}
    lists = [(d, (t or "").encode().split()) for d, t in rows]
    for d, words in lists:
        for s in range(len(words) - window + 1):
            key = tuple(words[s : s + window])
            if d is not None:
                first[key] = min(first.get(key, d), d)
    out = []
    for d, words in lists:
        gone = set()
        for s in range(len(words) - window + 1):
            if d is not None and first[tuple(words[s : s + window])] < d:
                gone |= set(range(s, s + window))
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((d, len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("seed", "window", "vocabulary"), [(1, 50, 300), (2, 20, 3), (3, 7, 2)])
def test_against_brute_force(spark, seed, window, vocabulary):
    r = random.Random(seed)
    word = lambda: r.choice(["é", "x", "Y."]) + str(r.randrange(vocabulary))
    passages = [[word() for _ in range(r.randint(window - 5, 3 * window))] for _ in range(6)]
    rows = []
    for d in range(90):
        words = []
        for _ in range(r.randint(0, 4)):
            words += r.choice(passages) if r.random() < 0.6 else [word() for _ in range(r.randint(0, 2 * window))]
            if words and r.random() < 0.5:
                words[r.randrange(len(words))] = word()
        rows.append((d * 3 % 91, " ".join(words) + r.choice(["", "\n", " \t"])))
    rows += [(200, rows[3][1]), (201, rows[3][1]), (5, rows[4][1]), (5, rows[4][1]), (None, rows[3][1]), (None, None), (300, None), (301, "  ")]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, version string, n int").repartition(3)
    got = sorted(((x.doc_id, x.n_words, x.n_removed, x.kept) for x in remove_repeats(df, window, digest=True).collect()), key=str)
    assert got == brute(rows, window)


def test_text_and_empty(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    text = " ".join(f"w{i}" for i in range(60))
    got = {x.doc_id: x.kept for x in remove_repeats(spark.createDataFrame([(1, text), (2, "a " + text + "  b")], "doc_id long, text string")).collect()}
    assert got == {1: text, 2: "a b"}


def test_greedy_parse():
    first, n = factors([10, 0, 12, 13, 14, 40, 40], [2, 4, 1, 1, 3, 1, 1], [7, 7, 7, 7, 9, 7, 7], [100, 50, 102, 104, 0, 3, 3])
    assert list(zip(first.tolist(), n.tolist(), strict=True)) == [(0, 4), (10, 3), (13, 1), (14, 3), (40, 1)]


def test_a_factor_grows_past_blocks(spark):
    words = [f"w{i}" for i in range(2000)]
    rows = [(1, " ".join(words)), (2, " ".join(["x", *words[100:1900], "y"])), (3, " ".join(words[300:500] + words[900:1100])), (4, " ".join(words[:49]))]
    got = {r.doc_id: r for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {d: (r.n_removed, r.n_factors) for d, r in got.items()} == {1: (0, 0), 2: (1800, 1), 3: (400, 2), 4: (0, 0)}
