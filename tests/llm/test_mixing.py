import hashlib
import random

import pytest

from gridloom.llm.mixing import mix_sources


def brute(rows):
    """rows: (doc_id, size, source)."""
    totals = {}
    for _, size, source in rows:
        totals[source] = totals.get(source, 0) + size
    names = sorted(totals, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, left, open_ = dict.fromkeys(names, 0.0), float(sum(totals.values())), set(names)
    while left > 1e-9 and open_:
        share = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * share > 3 * totals[s]}
        if not over:
            for s in open_:
                target[s] = weight[s] * share
            break
        for s in over:
            target[s] = 3.0 * totals[s]
            left -= target[s]
        open_ -= over
    queue = []
    for no, s in enumerate(names):
        mine = sorted((hashlib.md5(str(d).encode()).hexdigest(), d, z) for d, z, x in rows if x == s)
        run = 0
        for e in range(3):
            for key, d, z in mine:
                run += z
                if z:
                    queue.append((run / target[s], no, e, key, d, z))
    taken, total = {}, 0
    for _, _, _, _, d, z in sorted(queue):
        total += z
        if total > sum(totals.values()):
            break
        taken[d] = taken.get(d, 0) + z
    return totals, target, taken


def made(seed, n):
    r = random.Random(seed)
    sources = ["hot"] * 5 + ["b", "B", "é", "", None]
    return [(i, r.choice([0, 1, 3, 10, 40, 400]), r.choice(sources)) for i in range(n)]


@pytest.mark.parametrize(("seed", "n"), [(1, 400), (2, 40), (3, 3), (4, 1)])
def test_against_brute_force(spark, seed, n):
    rows = made(seed, n)
    df = spark.createDataFrame([(d, "  ".join(["wé"] * z) + "\n" if z else None, s, "x") for d, z, s in rows], "doc_id long, text string, source string, size string")
    totals, target, taken = brute(rows)
    got = mix_sources(df).collect()
    assert len(got) == n
    for row, (d, z, s) in zip(sorted(got, key=lambda r: r.doc_id), rows, strict=True):
        assert (row.doc_id, row.size, row.source_size) == (d, z, totals[s])
        assert row.target == pytest.approx(target[s])
        assert row.taken == taken.get(d, 0) <= 3 * z


def test_repeated_rows_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a b", "s"), (1, "a b", "s"), (None, "c", "s"), (None, None, None)], "doc_id long, text string, source string")
    got = mix_sources(df).collect()
    assert sum(r.taken for r in got) == 5 and len(got) == 4


def test_empty(spark):
    assert mix_sources(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
