import random

import pytest

from gridloom.llm.line_dedup import SPACE, dedup_lines


def near(x, y):
    if x == y or abs(len(x) - len(y)) > 1 or min(len(x), len(y)) < 20:
        return False
    a = 0
    while a < min(len(x), len(y)) and x[a] == y[a]:
        a += 1
    return x[a + 1 :] == y[a + 1 :] or x[a + 1 :] == y[a:] or x[a:] == y[a + 1 :]


def brute(rows):
    first = {}
    bare = lambda line: line.encode().strip(SPACE).decode()
    for d, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        for no, line in enumerate((t or "").split("\n")):
            if bare(line):
                first.setdefault(bare(line), (d, no))
    bad = {x for x in first for y in first if near(x, y) and first[y] < first[x]}
    out = {}
    for d, t in rows:
        if t is None or d is None:
            out[d] = t
            continue
        seen, stays = set(), []
        for line in t.split("\n"):
            b = bare(line)
            if not b or (b not in bad and b not in seen and first[b][0] == d):
                stays.append(line)
            seen.add(b)
        out[d] = "\n".join(stays)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(spark, seed):
    r = random.Random(seed)
    bases = ["".join(r.choice("abé ") for _ in range(r.choice([3, 19, 20, 21, 40, 200]))) for _ in range(12)] + ["x" * 30, "xy" * 16, "", "  "]

    def line():
        s = list(r.choice(bases))
        for _ in range(r.choice([0, 0, 1, 1, 2])):
            at = r.randrange(len(s) + 1)
            if r.random() < 0.4:
                s.insert(at, r.choice("abx🙂"))
            elif at < len(s):
                s[at : at + 1] = r.choice([[], ["a"], ["é"]])
        return "".join(s) + r.choice(["", " ", "\r"])

    rows = [(i * 2 - 30, "\n".join(line() for _ in range(r.randint(0, 8)))) for i in range(60)] + [(500, None), (501, ""), (None, "x" * 30)]
    df = spark.createDataFrame([(d, t, "v", f"g{d}", 1) for d, t in rows], "doc_id long, text string, version string, gone string, n_lines int").repartition(3)
    got = dedup_lines(df).collect()
    assert {x.doc_id: x.text for x in got} == brute(rows)
    assert len(got) == len(rows)
    assert all(x.version == "v" and x.gone == f"g{x.doc_id}" for x in got)
    for x in got:
        assert x.n_lines - x.n_removed == (len(x.text.split("\n")) if x.text else 0) or x.text == ""


def test_empty_and_repeats(spark):
    assert dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    got = dedup_lines(spark.createDataFrame([(1, "a\nb\na"), (1, "a\nb\na"), (2, "b\nc")], "doc_id long, text string")).collect()
    assert sorted((x.doc_id, x.text, x.n_removed) for x in got) == [(1, "a\nb", 1), (1, "a\nb", 1), (2, "c", 1)]
