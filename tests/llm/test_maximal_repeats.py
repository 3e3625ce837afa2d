import hashlib
import random
import tracemalloc
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from gridloom.llm import common, maximal_repeats

SCHEMA = "doc_id long, text string, k1 string, begin int"


def places(rows, least):
    at = defaultdict(list)
    for k, (_, text) in enumerate(rows):
        data = (text or "").encode()
        for s in range(len(data) - least + 1):
            at[data[s : s + least]].append((k, s))
    return at


def brute(rows, least):
    gone = defaultdict(set)
    for of in places(rows, least).values():
        if len(of) > 1:
            for k, s in of:
                gone[k] |= set(range(s, s + least))
    out = []
    for k, (d, text) in enumerate(rows):
        data, own = (text or "").encode(), gone[k]
        runs = sum(1 for b in own if b - 1 not in own)
        out.append((d, len(data), len(own), runs, hashlib.sha256(bytes(x for b, x in enumerate(data) if b not in own)).hexdigest()))
    return sorted(out, key=str)


def made(spark, rows, least):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in maximal_repeats.remove_repeats(df, least, digest=True).collect()), key=str)


def corpus(seed, n, least, letters):
    r = random.Random(seed)
    some = lambda k: "".join(r.choices(letters, k=k))
    passages = [some(r.randint(least // 2, 3 * least)) for _ in range(6)]
    rows = []
    for d in range(n):
        text = ""
        for _ in range(r.randint(0, 5)):
            part = r.choice(passages) if r.random() < 0.6 else some(r.randint(0, least))
            cut = r.randint(0, len(part))
            text += part if r.random() < 0.4 else part[:cut] + r.choice(["", "_", "é"]) + part[cut:]
        rows.append((d * 7 % n, text))
    return rows


@pytest.mark.parametrize(("seed", "least", "letters"), [(1, 400, "abcdefgh é"), (2, 40, "ab"), (3, 9, "aé日"), (4, 300, "a")])
def test_against_brute_force(spark, seed, least, letters):
    rows = corpus(seed, 60, least, letters)
    rows += [(70, rows[3][1]), (71, rows[3][1]), (5, rows[4][1]), (5, rows[4][1]), (None, rows[5][1]), (None, rows[5][1]), (None, None), (300, None), (301, "ab" * 700)]
    assert made(spark, rows, least) == brute(rows, least)


def test_long_texts_and_hot_anchors(spark, monkeypatch):
    monkeypatch.setattr(maximal_repeats, "CHUNK_BYTES", 150)
    monkeypatch.setattr(maximal_repeats, "MOST_KINDS", 3)
    monkeypatch.setattr(maximal_repeats, "ANCHOR_BYTES", 10)
    rows = corpus(5, 60, 40, "abc")
    assert made(spark, rows, 40) == brute(rows, 40)


@pytest.mark.parametrize("most", [1000, 2])
def test_groups_have_all_places(spark, monkeypatch, most):
    monkeypatch.setattr(maximal_repeats, "MOST_KINDS", most)
    least, rows = 30, corpus(6, 50, 30, "abcd")
    ids = [(k, t) for k, (_, t) in enumerate(rows)]
    found = defaultdict(set)
    for r in maximal_repeats.repeats(spark.createDataFrame(ids, "doc_id long, text string"), least).collect():
        found[r.repeat].add((r.doc_id, r.begin, r.end))
    data = {k: (t or "").encode() for k, t in ids}
    covered = set()
    for of in found.values():
        (string,) = {data[k][a:z] for k, a, z in of}
        assert len(string) >= least
        everywhere = {(k, s, s + len(string)) for k, d in data.items() for s in range(len(d)) if d.startswith(string, s)}
        assert of == everywhere and len(of) > 1
        covered |= {(k, b) for k, a, z in of for b in range(a, z)}
    assert covered == {(k, b) for of in places(ids, least).values() if len(of) > 1 for k, s in of for b in range(s, s + least)}


def test_intervals():
    strings = sorted([b"banana", b"band", b"ban", b"bandana", b"cat", b"ca"])
    common = maximal_repeats.common_prefixes(strings).tolist()
    got = {(n, strings[a : b + 1][0][:n], b - a + 1) for n, a, b in maximal_repeats.intervals(common, 1)}
    assert got == {(3, b"ban", 4), (4, b"band", 2), (2, b"ca", 2)}


def test_sides_that_differ_on_the_left_are_groups_of_their_own():
    left, right = [b"xy", b"xz", b"q", b"xy"], [b"AAAA1", b"AAAA2", b"AAAA3", b"AAAB"]
    got = {(b, a, tuple(sorted(m))) for b, a, m in maximal_repeats.repeat_groups(left, right, 3, 5)}
    assert got == {(1, 4, (0, 1)), (2, 3, (0, 3))}


def test_sliding_argmin():
    r = np.random.default_rng(1)
    x = r.integers(0, 9, 500).astype(np.uint64) << np.uint64(40)
    for width in (1, 2, 7, 64, 500):
        assert maximal_repeats.sliding_argmin(x, width).tolist() == [i + int(np.argmin(x[i : i + width])) for i in range(501 - width)]


def test_empty(spark):
    assert maximal_repeats.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, "short"), (2, None)]
    assert made(spark, rows, 400) == brute(rows, 400)


def test_hashing_takes_little_memory_at_once():
    r = random.Random(8)
    texts = pa.array(["".join(r.choices("abcdefgh ", k=2000)) for _ in range(1500)])
    tracemalloc.start()
    try:
        for data, rows, _ in maximal_repeats._texts(texts, 400):
            maximal_repeats.blocks(data, rows, 400)
        assert tracemalloc.get_traced_memory()[1] < 30e6  # 83 MB with pieces of a megabyte
    finally:
        tracemalloc.stop()


def test_a_core_has_one_worker_for_windows(spark, monkeypatch):
    workers, plain = {}, maximal_repeats.written

    def written(df, name):
        workers[name] = df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow")
        return plain(df, name)

    monkeypatch.setattr(maximal_repeats, "written", written)
    monkeypatch.setattr(maximal_repeats, "MOST_KINDS", 3)
    r = random.Random(9)
    some = lambda k: "".join(r.choices("abcdé ", k=k))
    shared = some(500)
    rows = [(k, some(r.randint(0, 300)) + shared[r.randint(0, 50) :] + some(r.randint(0, 300))) for k in range(12)]
    assert made(spark, rows, 400) == brute(rows, 400)
    assert workers["windows"] == 1


def test_worker_gives_memory_back_when_a_task_ends(monkeypatch):
    seen = []
    monkeypatch.setattr(common, "_trim", lambda: seen.append("trimmed"))

    def task(batches):
        for batch in batches:
            seen.append(batch)
            yield batch

    assert list(common.trimmed(task)(iter([1, 2]))) == [1, 2]
    assert seen == [1, 2, "trimmed"]


def test_repeats_across_the_pieces_of_long_texts(spark):
    r, size = random.Random(10), maximal_repeats.CHUNK_BYTES
    assert size <= 1 << 17  # else these texts are in one piece
    some = lambda k: "".join(r.choices("abcdefgh", k=k))
    long = some(2 * size + 5000)
    rows = [(1, long), (2, some(100) + long[size - 700 : size + 700] + some(100)), (3, long[2 * size - 399 : 2 * size + 1]), (4, long[size - 200 : size + 199]), (5, long[:3] + "é" + long[3:600])]
    assert made(spark, rows, 400) == brute(rows, 400)
