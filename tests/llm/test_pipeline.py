import random
import re

import public_tokenizers
import pytest

import corpus_pipeline as cp

from . import test_line_dedup, test_mixing, test_near_dup


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(8)
    word = lambda: "".join(r.choice("aeioubdst") for _ in range(r.randint(2, 8)))
    texts = ["\n".join(" ".join(word() for _ in range(r.randint(8, 25))) for _ in range(r.randint(1, 5))) for _ in range(120)]
    texts += [texts[0], texts[1] + "\nmore here", " ".join(["spam"] * 40), "A!! B!! C!! " * 12, "", None]
    texts += [" ".join(w if i % 40 else word() for i, w in enumerate(t.split())) for t in texts[2:20]]
    texts += [" ".join([word()] * 30) for _ in range(40)]
    rows = [(i, t, "en", r.choice(["s0", "s0", "s1", None]), len(t or "")) for i, t in enumerate(texts)]
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    marks = [(i, int(len(set((t or "").split())) > 5), 0) for i, t, *_ in rows if i % 2]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages_against_brute_force(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    tables = [docs]
    for name, stage in cp.STAGES:
        stage(spark, tables[-1], folder).write.parquet(f"{tmp_path}/{name}")
        tables.append(spark.read.parquet(f"{tmp_path}/{name}"))
    rows = [t.collect() for t in tables]
    for t in tables[:-1]:
        assert t.columns == list(cp.COLUMNS)
    texts = [{x.doc_id: x.text for x in own} for own in rows[:-1]]

    lost = set(texts[0]) - set(texts[1])
    good = {d for d, t in texts[0].items() if len(set((t or "").split())) > 5}
    assert len(lost & good) <= 3 and len(lost - good) >= 38

    want = test_line_dedup.brute([(x.doc_id, x.text) for x in rows[1]])
    assert texts[2] == {d: t for d, t in want.items() if t == texts[1][d] or re.search(r"\S", t)}
    assert all(x.n_chars == (None if x.text is None else len(x.text)) for x in rows[2])

    assert set(texts[3]) == set(test_near_dup.brute([(x.doc_id, x.text) for x in rows[2]]).values())

    _, _, taken = test_mixing.brute([(x.doc_id, len((x.text or "").split()), x.source) for x in rows[3]])
    size = {x.doc_id: len((x.text or "").split()) for x in rows[3]}
    got = [x.doc_id for x in rows[4]]
    assert {d: got.count(d) * size[d] for d in set(got)} == taken

    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert sorted((x.doc_id, x.n_tokens) for x in rows[5]) == sorted((x.doc_id, len(t.encode(x.text, add_special_tokens=False).ids)) for x in rows[4])


def test_run_and_empty(spark, folder, tmp_path):
    assert cp.run(spark, folder).count() > 0
    schema = spark.read.parquet(f"{folder}/documents.parquet").schema
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0
