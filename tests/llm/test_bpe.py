import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.llm.bpe import Encoder, bpe_decode, bpe_encode
from gridloom.llm.token_store import Packed, ordered, pack, read_tokens, write_texts, write_tokens

PATH = public_tokenizers.path("word_bpe_49k.json")
SMALL = Encoder(PATH, leaf_chars=7)
ODD = ["a", "b", "th", "E", "é", "é", "̣́", "'s", "'", "!", "!!", "7", "½", "漢字", "가", "<|endoftext|>", "<|", "|>", " ", "\x1c", "ing", "İ", "ß", "🙂", "the", "́"]


def direct(text):
    return SMALL.tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(ODD), max_size=60).map("".join))
def test_tree_is_exact(text):
    assert SMALL.unbroken(text).tolist() == direct(text)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*ODD, " ", "\n", "\t "]), max_size=40).map("".join), max_size=5))
def test_words_are_exact(texts):
    assert [x.tolist() for x in SMALL.encode_all([t.encode() for t in texts])] == [direct(t) for t in texts]


LATIN = ["A", "b", "É", "ß", "ÿ", ".", ",", "1", "×", "÷", "!", "'", "'S", "ing", "Th", " ", "\n", " ", "-", "<|ENDOFTEXT|>", "ō", "J̌", "\x00"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.sampled_from(LATIN), max_size=25).map("".join), max_size=4))
def test_plain_texts_are_exact(texts):
    assert [x.tolist() for x in SMALL.encode_all([t.encode() for t in texts])] == [direct(t) for t in texts]


def test_long_unbroken_run():
    r = random.Random(3)
    text = "".join(r.choice("etaoinshrdlu") for _ in range(30_000))
    assert Encoder(PATH, leaf_chars=1000).unbroken(text).tolist() == direct(text)


@pytest.mark.parametrize("seed", range(6))
def test_halves_of_long_texts(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice(ODD) for _ in range(r.choice([1, 2, 5, 40]))) if r.random() < 0.3 else r.choice(["tokenization", "the", "Über", "x."])
    texts = [r.choice([" ", "\n", "\t "]).join(word() for _ in range(r.choice([30, 300, 900]))) for _ in range(12)] + ["e" * 3000 + " " + "ab" * 900]
    e = Encoder(PATH, leaf_chars=r.choice([300, 500, 701]), cached_words=50)
    made = []
    e.long = lambda text, long=e.long: made.append(text) or long(text)
    assert [x.tolist() for x in e.encode_texts([t.encode() for t in texts])] == [direct(t) for t in texts]
    assert len(made) > 5


def test_halves_in_separate_tasks(spark):
    r = random.Random(9)
    texts = [" ".join(r.choice(["the", "naïve", "İstanbul", "x" * 50, "don't", "漢字"]) for _ in range(r.choice([5, 400, 2000]))) for _ in range(20)]
    rows = [(i, "a" if i % 2 else None, t) for i, t in enumerate(texts)]
    got = bpe_encode(spark.createDataFrame(rows, "doc_id long, _row string, text string"), PATH, split_chars=1500, leaf_chars=600).collect()
    assert {x.doc_id: (x._row, x.text, np.frombuffer(x.ids, "<u4").tolist()) for x in got} == {i: (k, t, direct(t)) for i, k, t in rows}


def test_forgetting_words():
    e = Encoder(PATH, cached_words=2)
    texts = [b"one two three", b"four five", b"one six"]
    assert [e.encode_all([t])[0].tolist() for t in texts] == [direct(t.decode()) for t in texts]


def test_encode_decode(spark):
    texts = [None, "", "Hello  World's <|endoftext|> x", "ab" * 500, "the quick " * 300, "the quick " * 300, "é" * 200]
    df = spark.createDataFrame([(i, t, "clash", "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string, decoded string")
    got = bpe_decode(bpe_encode(df, PATH, split_chars=100, leaf_chars=9), PATH).collect()
    assert len(got) == len(texts)
    for row in got:
        ids = direct(texts[row.doc_id] or "")
        assert np.frombuffer(row.ids, "<u4").tolist() == ids
        assert row.decoded == SMALL.tokenizer.decode(ids, skip_special_tokens=False)
        assert row.text == texts[row.doc_id]


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string")
    coded = bpe_encode(df, PATH)
    assert bpe_decode(coded, PATH).count() == 0
    write_tokens(ordered(coded), str(tmp_path / "s"))
    assert read_tokens(spark, str(tmp_path / "s")).count() == 0


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 5000])
def test_packed_random_access(n):
    r = np.random.default_rng(n)
    ids = (r.integers(0, 2**32, n, dtype=np.uint64) >> r.integers(0, 32, n).astype(np.uint64)).astype(np.uint32)
    p = Packed(pack(ids))
    assert len(p) == n and p.slice(0, n).tolist() == ids.tolist()
    for i in range(0, n, 37):
        assert p[i] == ids[i]
        assert p.slice(i, min(n, i + 50)).tolist() == ids[i : i + 50].tolist()


def test_store(spark, tmp_path):
    rows = [(i * 7 % 50, np.arange(i, dtype="<u4").tobytes()) for i in range(50)] + [(3, b""), (3, b""), (None, None)]
    df = spark.createDataFrame([(d, bytearray(x) if x is not None else None) for d, x in rows], "doc_id long, ids binary")
    write_tokens(ordered(df, "doc_id", "ids"), path := str(tmp_path / "s"), end_id=2, shard_tokens=100)
    got = sorted(read_tokens(spark, path).collect(), key=lambda r: r.start)
    want = sorted(((d is not None, d or 0, x or b"") for d, x in rows))
    start = 0
    for row, (_, d, x) in zip(got, want, strict=True):
        assert (row.doc_id or 0, row.start, bytes(row.ids)) == (d, start, x + b"\x02\0\0\0")
        assert row.n_tokens == len(row.ids) // 4
        start += row.n_tokens


def test_decoding_in_the_same_worker(spark):
    rows = [(1, "Hello, World! naïve"), (2, None), (3, ""), (4, "ab" * 700), (5, "x y " * 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("text", "body").selectExpr("doc_id", "body as text", "7 as other")
    apart = bpe_decode(bpe_encode(df, PATH, split_chars=500, leaf_chars=64), PATH, text="said").drop("text")
    at_once = bpe_encode(df, PATH, split_chars=500, leaf_chars=64, decoded="said")
    assert sorted(at_once.columns) == sorted(apart.columns)
    assert sorted(map(str, at_once.select(apart.columns).collect())) == sorted(map(str, apart.collect()))


def test_a_worker_drops_what_another_operator_kept():
    from gridloom.llm import bpe, common, substring

    bpe.encoder(PATH)
    assert bpe._encoders
    common.using("hashes")
    substring._hashes.of([b"a", b"b"])
    assert not bpe._encoders and substring._hashes
    common.using("bpe")
    assert not substring._hashes and len(substring._hashes.values64) == 0
    assert substring._hashes.of([b"b"])[0] == substring._hashes.of([b"c", b"b"])[1]


def test_texts_written_as_the_registered_query_writes_them(spark, tmp_path):
    r = random.Random(12)
    texts = [" ".join(r.choice(["the", "Naïve", "x.", "漢字", "don't"]) for _ in range(r.choice([0, 3, 200]))) for _ in range(60)] + [None, "", "ab" * 9000]
    rows = [(i * 37 % 63 - 20, t, "clash", 1) for i, t in enumerate(texts)] + [(5, "again", "clash", 1), (5, "again", "clash", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, start int").repartition(4)
    write_texts(df, path := str(tmp_path / "t"), PATH, end_id=2)
    got = sorted(read_tokens(spark, path).collect(), key=lambda x: x.start)
    assert [x.doc_id for x in got] == sorted(x[0] for x in rows)
    start, left = 0, {}
    for d, t, _, _ in rows:
        left.setdefault(d, []).append([*direct(t or ""), 2])
    for x in got:
        ids = np.frombuffer(x.ids, "<u4").tolist()
        left[x.doc_id].remove(ids)
        assert (x.start, x.n_tokens) == (start, len(ids))
        start += len(ids)
