import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from gridloom.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, a string"


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        host = c - (c % 20 if c >= 0 else -(-c % 20))
        built[c] = own.get(host, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
    words = {n: len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) if n else 0 for n in members}
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for n in members:
        if n:
            children[n[:-1]] += 1
    for n in members:
        for d in range(len(n) + 1):
            leaves[n[:d]] += not children[n]
            saved[n[:d]] += (len(members[n]) - 1) * words[n]
    ends = {n: ",".join(str(c) for c in of if len(built[c]) == len(n)) for n, of in members.items()}
    return sorted((of[0], len(n), members[n[:-1]][0] if n else None, len(of), children[n], leaves[n], saved[n], hashlib.sha256(ends[n].encode()).hexdigest()) for n, of in members.items())


def made(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(3)
    return sorted(tuple(r)[:8] for r in prefix_trie.prefix_trie(df).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    r = random.Random(seed)
    texts = ["hello", "a b  c", "", None, "é x \t y", "bye\n now"]
    rows = []
    for c in [*range(-25, 70), 2**62, 1000, 1001, 1007]:
        if r.random() < 0.9:
            rows += [(c, r.choice([t, t, None]), r.choice(["user", "assistant", None]), r.choice(texts[: 2 + c % 5])) for t in range(r.randint(1, 6))]
    rows += rows[:7] + [(None, 0, "user", "lost")]
    assert made(spark, rows) == brute(rows)


def test_one_conversation_in_many_ranges(spark):
    rows = [(5, t, "user" if t % 2 else "assistant", f"w{t % 3} x") for t in range(900)] + [(c, t, "user", "w0 x") for c in (0, 1, 2, 25) for t in range(5)]
    rows += [(45, t, role, text) for _, t, role, text in rows[:900]]  # as long, and equal after its own head
    rows += [(7, 0, "user", "long " * 30_000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        ranges = prefix_trie.numbered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
        assert ranges.where("conv_id = 5").select("range").distinct().count() > 3
        assert made(spark, rows) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_long_member_lists(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 7)
    rows = [(c, 0, "user", "same") for c in range(8, 300)]
    assert made(spark, rows) == brute(rows)


def test_empty(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert made(spark, [(None, None, None, None)]) == []
    assert made(spark, [(3, None, None, None)]) == brute([(3, None, None, None)])
