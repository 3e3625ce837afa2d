import hashlib
import random
from collections import Counter

import pytest

from gridloom.llm import fingerprints as fp


def jaccard(a, b):
    a, b = Counter(a.split()), Counter(b.split())
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def test_collisions_follow_similarity(spark):
    r = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(r.choice(words) for _ in range(r.choice([20, 80, 200]))) for _ in range(24)]
    texts += [t + " " + " ".join(r.choice(words) for _ in range(20)) for t in texts]
    df = spark.createDataFrame([*enumerate(texts)], "k int, text string")
    got = {row.k: row.samples for row in fp.fingerprint(df, ["k"], "text", 400).collect()}
    for i in range(24):
        for j in (i + 24, (i + 1) % 24):
            near = sum(x == y for x, y in zip(got[i], got[j], strict=True)) / 400
            assert near == pytest.approx(jaccard(texts[i], texts[j]), abs=0.11)


@pytest.mark.parametrize("group_rows", [256, 3])
def test_edits(spark, monkeypatch, group_rows):
    monkeypatch.setattr(fp, "GROUP_ROWS", group_rows)
    monkeypatch.setattr(fp, "BOUNDS", 3 if group_rows == 3 else 1000)
    r = random.Random(1)
    texts = {i * i - 40: "".join(r.choice("ab é🙂\n") for _ in range(r.randint(0, 40))) for i in range(30)}
    texts |= {-1: "same words here", 0: "same words here", 5: None, 6: "", 2000: "x" * 5000}
    df = spark.createDataFrame([(d, t, "x", "y") for d, t in texts.items()], "doc_id long, text string, row string, part string").repartition(4)
    got = {row.doc_id: row for row in fp.edited_fingerprints(df).collect()}
    ids = sorted(texts)
    assert sorted(got) == ids
    for d, after in zip(ids, ids[1:] + ids[:1], strict=True):
        own, other = texts[d] or "", texts[after] or ""
        half = len(own) // 2
        row = got[d]
        assert row.n_chars == len(own)
        assert row.edited_sha256 == hashlib.sha256((own[: len(own) - half] + other[:half]).encode()).hexdigest()
        assert 0 <= row.near_edited <= 1 and 0 <= row.near_next <= 1
        assert (row.fingerprint == got[after].fingerprint) == (row.near_next == 1)
    assert got[-1].fingerprint == got[0].fingerprint
    assert got[5].fingerprint == got[6].fingerprint


def test_repeated_ids_and_single_and_empty(spark):
    schema = "doc_id long, text string"
    assert fp.edited_fingerprints(spark.createDataFrame([], schema)).count() == 0
    (one,) = fp.edited_fingerprints(spark.createDataFrame([(4, "a b c d")], schema)).collect()
    assert one.near_next == 1 and one.edited_sha256 == hashlib.sha256(b"a b a b"[:4] + b"a b").hexdigest()
    assert fp.edited_fingerprints(spark.createDataFrame([(4, "a"), (4, "a"), (4, "b"), (None, None)], schema)).count() == 4


def test_no_python_in_plan(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    for made in (fp.fingerprint(df, ["doc_id"], "text"), fp.neighbours(df, "doc_id", "text"), fp.edited_fingerprints(df)):
        plan = df.sparkSession._jvm.PythonSQLUtils.explainString(made._jdf.queryExecution(), "simple")
        assert "Python" not in plan and "Arrow" not in plan and "InPandas" not in plan


@pytest.mark.parametrize("bounds", [1000, 20])
def test_hot_ids_are_dealt_out(spark, monkeypatch, bounds):
    """Half of the rows have no id and a tenth share one; the chain is a single cycle through all rows, in order of ids."""
    monkeypatch.setattr(fp, "GROUP_ROWS", 8)
    monkeypatch.setattr(fp, "BOUNDS", bounds)
    r = random.Random(3)
    rows = [(None if k % 2 else 77 if k % 10 == 0 else k, f"t{r.randrange(900)}") for k in range(1500)]
    laid = fp.neighbours(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), "doc_id", "text")
    sizes = [x["count"] for x in laid.groupBy("g").count().collect()]
    assert max(sizes) <= 40
    at = {(x.g, x.place): x for x in laid.collect()}
    assert len(at) == 1500 and sorted((x.doc_id or -1, x.text) for x in at.values()) == sorted((d or -1, t) for d, t in rows)
    seen, now = [], min(at)
    for _ in range(1500):
        seen.append(at[now])
        now = (at[now].next_g, at[now].next_place)
    assert now == min(at) and len({(x.g, x.place) for x in seen}) == 1500
    assert [x.doc_id or -1 for x in seen] == sorted(d or -1 for d, _ in rows)
    assert all(x.next_text == y.text for x, y in zip(seen, seen[1:] + seen[:1], strict=True))


def test_likeness_of_the_registered_query(spark):
    """At the query's 32 samples: unbiased, and off by no more than its standard error says."""
    r = random.Random(6)
    # words of their own for every two documents, since draws belong to words
    texts = [" ".join(f"w{i // 2}_{r.randrange(r.choice([5, 40]))}" for _ in range(r.randint(5, 60))) for i in range(300)]
    got = sorted(fp.edited_fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect(), key=lambda x: x.doc_id)
    off = []
    for i, row in enumerate(got):
        own, after = texts[i], texts[(i + 1) % 300]
        half = len(own) // 2
        for other, said in ((after, row.near_next), (own[: len(own) - half] + after[:half], row.near_edited)):
            a, b = Counter(own.split()), Counter(other.split())
            off.append(said - (a & b).total() / (a | b).total())
    assert abs(sum(off) / len(off)) < 0.03 and (sum(x * x for x in off) / len(off)) ** 0.5 < 0.1
