import random
from collections import Counter

import numpy as np
import pytest

from gridloom.llm.components import components
from gridloom.llm.near_dup import LOW, alike, dart_minhash, least_agreeing, near_duplicates, shingles


def shingle_set(text):
    w = (text or "").encode().split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def brute(rows):
    sets = [(d, shingle_set(t)) for d, t in rows]
    parent = {d: d for d, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if s and t and (s & t).total() >= 0.8 * (s | t).total():
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: root(d) for d in parent}


def corpus(seed, groups=12):
    r = random.Random(seed)
    rows = []
    for _ in range(groups):
        base = [f"w{r.randrange(400)}é" for _ in range(r.choice([3, 8, 60, 200]))]
        rows.append(list(base))
        for _ in range(r.choice([0, 1, 4, 12])):
            copy = list(base) + base * r.choice([0, 0, 0, 1])
            for _ in range(r.choice([0, 1, 2, max(1, len(base) // 40)])):
                copy[r.randrange(len(copy))] = f"e{r.randrange(10000)}"
            rows.append(copy)
    r.shuffle(rows)
    texts = [(i * 3, "  ".join(x)) for i, x in enumerate(rows)]
    return [*texts, (1000, ""), (1001, None), (1002, " \n"), (1003, texts[0][1] + " "), (1004, texts[0][1])]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_classes_against_brute_force(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, c string, bands int").repartition(3)
    got = near_duplicates(df).collect()
    want = brute(rows)
    assert {x.doc_id: x.class_id for x in got} == want
    assert {x.doc_id for x in got if x.kept} == set(want.values())


def test_edge_rows(spark):
    schema = "doc_id long, text string"
    assert near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (8, "a b c d e f"), (9, None)]
    got = sorted(((x.doc_id, x.class_id, x.kept) for x in near_duplicates(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == sorted([(None, None, True), (7, 7, True), (7, 7, True), (8, 7, False), (9, 9, True)], key=str)


def test_signatures_estimate_weighted_jaccard():
    r = np.random.default_rng(1)
    a, b = r.integers(0, 2**63, 300, np.int64).astype(np.uint64), r.integers(0, 2**63, 40, np.int64).astype(np.uint64)
    w = r.uniform(0.2, 9, 300)
    v = w * r.choice([1.0, 0.5, 2.0], 300)
    sig = dart_minhash(np.repeat([0, 1], [300, 340]), np.concatenate([a, a, b]), np.concatenate([w, v, np.ones(40)]), 2000)
    want = np.minimum(w, v).sum() / (np.maximum(w, v).sum() + 40)
    assert (sig[0] == sig[1]).mean() == pytest.approx(want, abs=0.04)
    assert (dart_minhash(np.zeros(1, np.int64), a[:1], np.ones(1), 64) != 0).all()
    assert dart_minhash(np.zeros(0, np.int64), a[:0], np.zeros(0), 8).shape == (0, 8)


def test_components(spark):
    r = random.Random(4)
    pairs = [(r.randrange(400), r.randrange(400)) for _ in range(230)] + [(i, i + 1) for i in range(500, 560)] + [(700, i) for i in range(701, 740)] + [(5, 5)]
    parent = list(range(800))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = {x.node: x.component for x in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    nodes = {x for p in pairs if p[0] != p[1] for x in p}
    assert got == {x: root(x) for x in nodes}


def test_links_that_no_chosen_member_shows(spark):
    """A chain of small edits, and copies that differ from one another more than from their source."""
    r = random.Random(8)
    base = [f"c{i}" for i in range(150)]
    rows, now = [(0, " ".join(base))], list(base)
    for i in range(1, 12):
        now = list(now)
        now[i * 12] = f"x{i}"
        rows.append((i, " ".join(now)))
    source = [f"s{i}" for i in range(200)]
    for i in range(100, 180):
        copy = list(source)
        for _ in range(r.choice([3, 4, 5, 6])):
            copy[r.randrange(200)] = f"e{r.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    got = {x.doc_id: x.class_id for x in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("seed", [21981, 64181])
def test_similar_pair_with_unlucky_sketches(spark, seed):
    """Jaccard 0.8, and sketches that agree on 97 of 150 coordinates (of 100,000 such pairs the least)."""
    common = [f"s{seed}w{i}" for i in range(84)]
    texts = [" ".join(common + [f"{x}{seed}v{i}" for i in range(10)]) for x in "ab"]
    document, element, _ = shingles([t.encode().split() for t in texts], 5)
    sketch = dart_minhash(document, element, np.ones(len(element)), 150) & np.uint64(0xFFFF)
    assert (sketch[0] == sketch[1]).sum() == 97 >= least_agreeing(150, 0.8) == 95
    got = near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {x.doc_id: x.class_id for x in got} == brute(list(enumerate(texts))) == {0: 0, 1: 0}


def test_many_pairs_near_the_bound(spark):
    """Pairs at a similarity of 0.8 to 0.83 are all found and pairs at 0.77 to 0.8 are not; some words repeat."""
    r = random.Random(5)
    rows, near = [], []
    while len(near) < 600:
        i, n = len(near), r.randint(40, 300)
        words = [f"p{i}w{r.randrange(n)}" if r.random() < 0.8 else "the" for _ in range(n)]
        copy = list(words)
        cut = round(n * r.uniform(0.08, 0.14))
        at = r.randrange(n - cut)
        copy[at : at + cut] = [f"q{i}w{j}" for j in range(cut)]
        a, b = shingle_set(" ".join(words)), shingle_set(" ".join(copy))
        share = (a & b).total() / (a | b).total()
        if 0.77 <= share < 0.83:
            rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(copy))]
            near.append(share >= 0.8)
    got = {x.doc_id: x.class_id for x in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[2 * i] == got[2 * i + 1] for i in range(600)] == near and 150 < sum(near) < 500


def test_least_hashes_lose_no_similar_pair():
    r = np.random.default_rng(3)
    for n in (5, 100, 400, 3000):
        for share in (0.95, 0.85, 0.8, 0.5, 0.1):
            a = r.choice(2**32, n, replace=False).astype("<u4")
            keep = round(2 * n * share / (1 + share))
            b = np.concatenate([a[:keep], r.choice(2**32, n - keep, replace=False).astype("<u4")])
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            said = alike(np.sort(a)[:LOW], [np.sort(b)[:LOW]], 0.8)[0]
            assert said or true < 0.8
            assert not said or true > 0.7
