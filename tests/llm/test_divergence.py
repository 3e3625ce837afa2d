import random
import re
from collections import Counter, defaultdict

import pytest

from gridloom.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, p long, term string"


def brute(rows, least=10):
    groups, df, counts = set(), Counter(), defaultdict(Counter)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        groups.add((lang, source))
        df.update((lang, t) for t in set(terms))
        counts[lang, source].update(terms)
        counts[lang, None].update(terms)
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for (x, t), n in df.items() if x == lang and n >= least]
        share = {}
        for source in [None, *(s for x, s in groups if x == lang)]:
            c = counts[lang, source]
            total = sum(c[t] for t in kept)
            share[source] = {t: 1 + 1_000_000_000 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}
        f = lambda p, q: (p - q) ** 2 // (p + q)
        for x, source in groups:
            if x == lang:
                mine = share[source]
                pairs = [(sum(f(mine[t], share[o][t]) for t in kept), o) for y, o in groups if y == lang and o != source]
                terms = [(f(mine[t], share[None][t]), t) for t in kept if counts[lang, source][t] and mine[t] > share[None][t]]
                for part, items, most in (("pair", pairs, None), ("term", terms, 10)):
                    ranked = sorted(items, key=lambda i: (-i[0], i[1].encode()))[:most]
                    out += [(lang, source, part, item, value, k) for k, (value, item) in enumerate(ranked, 1)]
    return sorted(out)


def made(spark, rows):
    df = spark.createDataFrame([(k, *r, 1, "x") for k, r in enumerate(rows)], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in divergence.audit(df).select("lang", "source", "part", "item", "value", "rank").collect())


def corpus(seed, n, sources):
    r = random.Random(seed)
    words = ["The", "a", "É", "naïve", "x1y", "日本", "don't", "ﬀ", "\x00z", "KK"] + [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)]
    rows = []
    for _ in range(n):
        source = r.choice(sources)
        lang = r.choice(["en", "de", None, ""])
        own = words[: 10 + len(source or "") % 3] + [w for w in words if (len(w) * 7 + ord(w[-1])) % 9 == sources.index(source) % 9]
        rows.append((r.choice([None, "", "  ", "1 2"]) if r.random() < 0.05 else " ".join(r.choices(own, k=r.randint(1, 30))), lang, source))
    return rows + rows[:5]


@pytest.mark.parametrize(("seed", "n_sources"), [(1, 3), (2, 24)])
def test_against_brute_force(spark, monkeypatch, seed, n_sources):
    monkeypatch.setattr(divergence, "PIECE_BYTES", 16)
    rows = corpus(seed, 400, [None, "", *(f"s{k}" for k in range(n_sources))])
    assert made(spark, rows) == brute(rows)


@pytest.mark.parametrize(("light", "block", "tile"), [(16, 5, 7), (0, 64, 2048), (3, 1, 1000)])
def test_split_and_tiles_change_nothing(spark, monkeypatch, light, block, tile):
    monkeypatch.setattr(divergence, "MOST_LIGHT", light)
    monkeypatch.setattr(divergence, "TILE_SOURCES", block)
    monkeypatch.setattr(divergence, "TILE_TERMS", tile)
    rows = corpus(3, 500, [f"s{k}" for k in range(30)])
    assert made(spark, rows) == brute(rows)


def test_flushed_counts_add_up(spark, monkeypatch):
    monkeypatch.setattr(divergence, "FLUSH_TERMS", 3)
    docs = spark.createDataFrame([("a b c d e f", "en", "s"), ("a a b", "en", "s"), ("x", "de", "s")], "text string, lang string, source string").coalesce(1)
    rows = divergence.count_terms(docs.select("lang", "source", "text")).where("term is not null").groupBy("lang", "term").sum("n", "docs").collect()
    assert {r[1]: (r[2], r[3]) for r in rows if r[0] == "en"} == {"a": (3, 2), "b": (2, 2), **{t: (1, 1) for t in "cdef"}}


def test_shares_are_exact(spark):
    rows = [(n, total, v) for n in (0, 1, 10**12, 2**61) for total in (2**61, 2**62, 10**13 + 7) if n <= total for v in (1, 12345)]
    got = spark.createDataFrame(rows, "n long, total long, v long").select("*", divergence.share(*(divergence.F.col(c) for c in ("n", "total", "v"))).alias("p")).collect()
    assert all(r.p == 1 + 10**9 * (r.n + 2) // (r.total + 2 * r.v) for r in got)


def test_no_kept_terms_and_empty(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [("a b", "en", "x"), ("c", "en", "y"), (None, None, None), ("x " * 300_000, "de", "z")]
    assert made(spark, rows) == brute(rows) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]
