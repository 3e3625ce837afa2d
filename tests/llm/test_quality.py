import random
import zlib

import numpy as np
import pytest

from gridloom.llm import quality


def made(n, seed):
    r = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9))) for _ in range(r.randint(5, 80))]
        good = r.random() < 0.7
        text = " ".join(words) if good else r.choice([" ".join(words[:2] * 30), " ".join(w.upper() + "!!" for w in words)])
        rows.append((i, text))
        labels.append((i, int(good)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = made(600, 1)
    docs = spark.createDataFrame([*[(d, t, "x", 0.1) for d, t in rows], (None, "abc def", "x", 0.1), (900, None, "x", 0.2), (901, "", "x", 0.3)], "doc_id long, text string, lang string, score double")
    marks = spark.createDataFrame([*labels, (3, 1 - labels[3][1]), (5000, 1), (7, None)], "doc_id long, quality int")
    got = {x.doc_id: x for x in quality.classify(docs, marks).collect()}
    assert len(got) == 603
    truth = dict(labels)
    out = [d for d in truth if zlib.crc32(str(d).encode()) % 5 == 0]
    assert all(got[d].held_out == (d in set(out)) for d in truth)
    assert np.mean([got[d].predicted == truth[d] for d in out]) > 0.95
    assert all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3) for x in got.values())
    assert got[900].score == got[901].score and not got[None].held_out


def test_flat_trees_match_walking():
    r = np.random.default_rng(0)
    x = r.normal(size=(500, 4)).astype(np.float32)
    y = (x[:, 0] + x[:, 1] ** 2 > 0.5).astype(float)
    m = quality.train(x, y, trees=30, depth=3)
    score = m.score(x)
    for i in range(0, 500, 23):
        total = m.base
        for t in range(30):
            node = 0
            for _ in range(3):
                node = 2 * node + (2 if x[i, m.feature[t, node]] > m.threshold[t, node] else 1)
            total += m.leaf[t, node - 7]
        assert score[i] == pytest.approx(1 / (1 + np.exp(-total)))
    assert ((score > 0.5) == (y > 0.5)).mean() > 0.95


def test_without_labels_or_documents(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert [x.score for x in quality.classify(docs, none).collect()] == [0.5]
    assert quality.classify(docs.limit(0), none).count() == 0


def test_statistics_against_plain_counting():
    text = "The cat, the cat!\n\nÉ 12 the   Zoo#\nThe cat, the cat!\n" + "x" * 30
    got = dict(zip(quality.FEATURES, quality.statistics(text.encode()), strict=True))
    words, lines, n = text.split(), text.split("\n"), len(text.encode())
    assert got["log_words"] == pytest.approx(np.log1p(len(words)))
    assert got["distinct_words"] == pytest.approx(len(set(words)) / len(words))
    assert got["most_common_word"] == pytest.approx(max(words.count(w) for w in words) / len(words))
    assert got["distinct_pairs"] == pytest.approx(len(set(zip(words, words[1:], strict=False))) / len(words))
    assert got["upper"] == pytest.approx(sum(c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for c in text) / n)
    assert got["digits"] == pytest.approx(2 / n)
    assert got["other_bytes"] == pytest.approx(2 / n)
    assert got["blank_lines"] == pytest.approx(lines.count("") / len(lines))
    assert got["repeated_lines"] == pytest.approx(1 - 3 / 4)
    assert got["long_words"] == pytest.approx(1 / len(words))
    assert quality.statistics(b"") == [0.0] * len(quality.FEATURES)
    assert quality.statistics(b"long " * 200_000)[1] == pytest.approx(np.log1p(200_000))


def test_first_split_is_the_best_of_all():
    r = np.random.default_rng(4)
    x = r.normal(size=(300, 3)).astype(np.float32)
    y = ((x[:, 1] > 0.4) | (x[:, 2] < -1)).astype(float)
    m = quality.train(x, y, trees=1, depth=1, rate=1.0, bins=16, ridge=1.0, least_weight=2.0)
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    g, h, best = p - y, np.full(300, p * (1 - p)), (-1.0, None, None)
    for j in range(3):
        for edge in np.unique(np.quantile(x[:, j], np.linspace(0, 1, 17)[1:-1], method="lower")).astype(np.float32):
            low = x[:, j] <= edge
            if h[low].sum() >= 2 and h[~low].sum() >= 2:
                gain = sum(g[s].sum() ** 2 / (h[s].sum() + 1) for s in (low, ~low)) - g.sum() ** 2 / (h.sum() + 1)
                best = max(best, (gain, j, float(edge)))
    assert (m.feature[0, 0], m.threshold[0, 0]) == (best[1], np.float32(best[2]))
    low = x[:, best[1]] <= best[2]
    assert m.leaf[0] == pytest.approx([-g[s].sum() / (h[s].sum() + 1) for s in (low, ~low)])


def test_repeated_rows_and_more_labels_than_are_learnt_from(spark):
    rows, labels = made(400, 2)
    docs = spark.createDataFrame(rows + rows[:50], "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    scores = {}
    for x in quality.classify(docs, marks).collect():
        assert scores.setdefault(x.doc_id, x.score) == x.score
    features = quality.document_statistics(docs)
    few, again = (quality.fit(features, marks, max_rows=100) for _ in range(2))
    assert (few.threshold == again.threshold).all() and (few.leaf == again.leaf).all()
