import math
import random
import re
from collections import Counter

import numpy as np

from reticula.llm import brown_lm, queries


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), " "]


def corpus(n=300, seed=5):
    r = random.Random(seed)
    nouns, verbs, rare = [f"n{i}a" for i in range(40)], [f"v{i}b" for i in range(40)], (f"rare{i}" for i in range(10**6))
    out = []
    for i in range(n):
        w = []
        for _ in range(r.randint(0, 60)):
            w += ["The", r.choice(nouns), r.choice(verbs)] + ([next(rare)] if r.random() < 0.1 else [])
        out.append((i, " \n\x0b".join(w)))
    return out


def test_counts_base_and_gain(spark):
    from zlib import crc32

    rows = [*corpus(), (None, None), (None, "the n1a unseen\x85word"), (7, "dup"), (7, "dup")]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, score int, word string")
    held = lambda i: i is not None and crc32(str(i).encode()) % 7 == 2
    c = Counter(x for i, t in rows if not held(i) for x in tokens(t))
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), held(i), len(tokens(t)), sum(x in c for x in tokens(t)), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in tokens(t)), 6)) for i, t in rows)
    for size in (2_000_000, 50):
        got = queries.lm_scores(df, chunk_tokens=size).collect()
        assert sorted((str(g.doc_id), g.held_out, g.n_tokens, g.n_known, g.train_tokens, round(g.base_score, 6)) for g in got) == want
        out = [g for g in got if g.held_out]
        assert sum(g.score for g in out) > 0.7 * sum(g.base_score for g in out)  # nearer to 0
        assert all(g.score < 0 for g in got)
    assert queries.lm_scores(df.limit(0)).count() == 0
    alone = spark.createDataFrame([(9, "a b")], "doc_id long, text string")
    from pyspark.sql import functions as F
    r = brown_lm.score(alone, F.lit(True)).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (3, 0, 0, 0.0, 0.0)


def test_long_text_in_parts(spark, monkeypatch):
    from pyspark.sql import functions as F

    rows = corpus(60, 2)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    whole = {g.doc_id: g.score for g in brown_lm.score(df, F.lit(False)).collect()}
    small = brown_lm._chunk_kernel
    assert len(list(brown_lm._slices(b"aa bb " * 10))) == 1
    monkeypatch.setattr(brown_lm, "SLICE", 40)
    assert [w for s in brown_lm._slices(b"aa bb " * 30) for w in s] == [b"aa", b"bb"] * 30
    assert len(list(brown_lm._slices(b"aa bb " * 30))) > 3

    def cut_kernel(*a):
        inner = small(*a)

        def kernel(batches):
            brown_lm.SLICE = 40
            yield from inner(batches)
        return kernel

    monkeypatch.setattr(brown_lm, "_chunk_kernel", cut_kernel)
    parts = {g.doc_id: g.score for g in brown_lm.score(df, F.lit(False), chunk_tokens=64).collect()}
    assert parts.keys() == whole.keys() and all(abs(parts[k] - whole[k]) < 1e-6 for k in whole)


def test_transitions_are_distributions():
    r = np.random.default_rng(1)
    k = 6
    n, v = np.array([50.0, 0, 30, 20, 7, 9]), np.array([20.0, 0, 9, 4, 3, 1])
    seen = np.where((n[:, None] > 0) & (n[None] > 0), r.integers(1, 20, (k, k)), 0)
    p = 10 ** brown_lm.transitions(seen, n, v, 0.6)
    emitted = np.divide(n - 0.6 * v, n, out=np.zeros(k), where=n > 0)  # what known words of a class get
    for row in p:
        assert abs(row[:k] @ emitted + row[k] - 1) < 1e-9


def brute_classes(lists, k, sweeps):
    """Classes of the words after the sweeps, by plain counting."""
    words = sorted({w for x in lists for w in x})
    cls = {w: k - 1 if w == brown_lm.END else brown_lm._ending(w.encode(), k) for w in words}
    for _ in range(sweeps):
        dense = {w: np.zeros(2 * k) for w in words}
        for x in lists:
            for a, b in zip(x, x[1:], strict=False):
                dense[b][cls[a]] += 1
                dense[a][k + cls[b]] += 1
        m = np.full((k, 2 * k), 0.1)
        for w in words:
            m[cls[w]] += dense[w]
        logs = np.hstack([np.log(h / h.sum(axis=1, keepdims=True)) for h in (m[:, :k], m[:, k:])])[:-1]
        cls = {w: k - 1 if w == brown_lm.END else int(np.round(dense[w] @ logs.T, 6).argmax()) for w in words}
    return cls


def brute_scores(rows, held, k, sweeps):
    """The model written down word by word."""
    lists = {i: [brown_lm.END, *tokens(t)] for i, t in rows}
    train = [x for i, x in lists.items() if not held(i)]
    cls = brute_classes(train, k, sweeps)
    c = Counter(w for x in train for w in x[1:])
    n, v = Counter(), Counter()
    for w, m in c.items():
        n[cls[w]] += m
        v[cls[w]] += 1
    n1, n2 = sum(m == 1 for m in c.values()), sum(m == 2 for m in c.values())
    d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    pair = Counter((cls[a], cls[b]) for x in train for a, b in zip(x, x[1:], strict=False))
    total, all_words = sum(n.values()), sum(v.values())

    def move(a, b):
        return (pair[a, b] + brown_lm.PRIOR * n[b] / total) / (sum(m for (x, _), m in pair.items() if x == a) + brown_lm.PRIOR)

    def chance(a, b):  # of word class b (None: unknown) after a
        if a is None:
            return sum(v[x] / all_words * chance(x, b) for x in v)
        return move(a, b) if b is not None else sum(move(a, x) * d * v[x] / n[x] for x in n)

    known: dict = {}
    out = {}
    for i, x in lists.items():
        s = 0.0
        for a, b in zip(x, x[1:], strict=False):
            ca, cb = (cls[w] if c[w] else None for w in (a, b))
            if (ca, cb) not in known:
                known[ca, cb] = math.log10(chance(ca, cb))
            s += known[ca, cb] + (math.log10((c[b] - d) / n[cb]) if cb is not None else 0.0)
        out[i] = s
    return out


def test_scores_against_brute_force(spark):
    rows, k = [*corpus(120, 8), (500, None), (501, "n1a never seen words")], 8
    held = lambda i: i % 5 == 1
    want = brute_scores(rows, held, k, 3)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    from pyspark.sql import functions as F
    for size in (10**6, 90):
        got = {r.doc_id: r.score for r in brown_lm.score(df, F.col("doc_id") % 5 == 1, classes=k, chunk_tokens=size).collect()}
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-6 for i in want)


def test_neighbour_classes_are_those_of_the_sweep_before(spark):
    from pyspark.sql import functions as F

    rows, k = corpus(80, 3), 8
    df = spark.createDataFrame(rows, "doc long, text string").withColumn("held", F.lit(False)).select("doc", "held", "text")
    for sweeps in (0, 1, 3):
        want = brute_classes([[brown_lm.END, *tokens(t)] for _, t in rows], k, sweeps)
        for size in (10**6, 100):
            chunks = brown_lm.chunked(df, k, size)
            words = {}  # the words of a chunk's part, in the order of its classes
            for r in chunks.where(F.col("kind") == brown_lm.COUNTS).collect():
                words[r.chunk, r.part] = brown_lm._unpack(r.data)[0].tobytes().decode().split("\n")
            for r in brown_lm.cluster(chunks, k, sweeps).where(F.col("kind") == brown_lm.CLASS).collect():
                assert [want[w] for w in words[r.chunk, r.part]] == brown_lm._unpack(r.data)[0].tolist()


def test_packed_arrays():
    arrays = [np.array([], np.int64), np.array([0, 1, 300]), np.array([-5, 2**40]), np.array([1.5, -2.0]), np.array([True, False]), np.array([2**63 - 1])]
    for a, b in zip(arrays, brown_lm._unpack(brown_lm._pack(*arrays)), strict=True):
        assert a.tolist() == b.tolist()


def test_parts_add_up_in_steps(monkeypatch):
    r = np.random.default_rng(4)
    k = 5
    logs = np.log(r.random((k - 1, 2 * k)))
    dense = r.integers(0, 3, (57, 2 * k))
    many = (dense > 0).sum(axis=1)
    ctx, counts = np.nonzero(dense)[1], dense[dense > 0]
    got = []
    for gather, at_once in ((10**6, 10**6), (40, 10)):
        monkeypatch.setattr(brown_lm, "GATHER", gather)
        monkeypatch.setattr(brown_lm, "WORDS_AT_ONCE", at_once)
        p = brown_lm._Part(2 * k)
        p.n, p.end = np.arange(57), 9
        for _ in range(3):
            p.add(np.arange(57), many, ctx, counts)
        got.append(p.classes(logs).tolist())
    want = (3 * dense @ logs.T).argmax(axis=1)
    want[9], want[0] = k - 1, k  # the end, and a word without training text
    assert got[0] == got[1] == want.tolist()
