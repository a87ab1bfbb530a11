import hashlib
import os
import random
import re
from collections import Counter

import pytest
from tokenizers import Tokenizer as Library

import corpus_pipeline
from reticula.llm import queries

from .test_near_dups import brute_fp

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def brute_near(rows):
    fps = {i: brute_fp(t) for i, t in rows}
    ids = sorted(fps)
    comp = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if comp[a] > comp[b] and (fps[a] ^ fps[b]).bit_count() <= 4:
                    comp[a], changed = comp[b], True
    return {i for i in ids if comp[i] == i}


def test_pipeline_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DATA)
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        kept.append(docs.collect())
    start = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    stay = {r.doc_id for r in kept[0]}
    clean = [r.doc_id for r in start if labels.get(r.doc_id) == 0]
    assert sum(i in stay for i in clean) >= 0.97 * len(clean)
    # Exact: the smallest id of each normalised text.
    first = {}
    for r in sorted(kept[0], key=lambda r: r.doc_id):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text), r.doc_id)
    assert {r.doc_id for r in kept[1]} == set(first.values())
    assert {r.doc_id for r in kept[2]} == brute_near([(r.doc_id, r.text) for r in kept[1]])
    # Mixing: whole copies, at most two, with 150 % of the words or what the limits allow.
    words = {r.doc_id: len(r.text.encode().split()) for r in kept[2]}
    copies = Counter(r.doc_id for r in kept[3])
    assert set(copies) <= set(words) and max(copies.values()) <= 2
    assert abs(sum(words[i] * n for i, n in copies.items()) / sum(words.values()) - 1.5) < 0.1
    library = Library.from_file(queries.vocabulary())
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for r in kept[3]:
        ids = library.encode(r.text, add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, kept[4])) == sorted(want)


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, DATA)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 0


def odd_documents():
    r = random.Random(8)
    vocab = ["".join(r.choices("abcdeghiklmnorstu", k=r.randint(3, 8))) for _ in range(200)]
    text = lambda bad: " ".join(w for _ in range(8) for w in [*r.choices(vocab, k=3), *bad])
    plain = [(i, text([]), "en", "ab"[i % 2]) for i in range(40)]
    toxic = [(100 + i, text(["florp"]), "en", "a") for i in range(40)]
    odd = [(200, None, None, None), (201, "", "en", None), (202, " \t\n", "en", "a"), (None, "a text without an id here", None, "b"), (None, "a text without an id here", None, "b"),
           (7, plain[7][1], "en", "b"), (7, plain[7][1], "en", "b"), (203, "long words " * 20_000, "en", "b"), (204, "\x85 \x1c é", "xx", "c")]
    return [(*d, 1, "x", 0.5) for d in plain + toxic + odd], plain, toxic


SCHEMA = "doc_id long, text string, lang string, source string, id int, key string, score double"


@pytest.fixture
def odd_dir(spark, tmp_path):
    rows, plain, toxic = odd_documents()
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(d[0], 0, 1) for d in plain] + [(d[0], 1, 0) for d in toxic] + [(None, 1, 0), (7, None, 1), (9999, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, toxic int, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def test_stages_take_odd_rows_and_clashing_columns(spark, odd_dir, tmp_path):
    docs = spark.read.parquet(f"{odd_dir}/documents.parquet")
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, odd_dir)
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / f"stage{k}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{k}"))
        kept.append(docs.collect())
    _, plain, toxic = odd_documents()
    clean, exact, near, mixed, coded = kept
    assert {r.doc_id for r in clean} == {d[0] for d in plain} | {200, 201, 202, 203, 204, None}
    assert len(clean) == 40 + 9
    # The same text once: white space runs are a space, null is empty.
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    texts = {}
    for r in sorted(clean, key=lambda r: (r.doc_id is None, r.doc_id)):
        texts.setdefault(norm(r.text), r.doc_id)
    assert sorted(map(str, texts.values())) == sorted(str(r.doc_id) for r in exact)
    assert {r.doc_id for r in near} == brute_near([(10**9 if r.doc_id is None else r.doc_id, r.text) for r in exact]) - {10**9} | {None}
    assert Counter(r.doc_id for r in mixed).keys() <= {r.doc_id for r in near} and max(Counter(r.doc_id for r in mixed).values()) <= 2
    assert Counter(r.doc_id for r in coded) == Counter(r.doc_id for r in mixed)
    assert all((r.id, r.key, r.score) == (1, "x", 0.5) for part in kept[:4] for r in part)


def test_empty_tables_stay_empty(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
