import random
import re

import numpy as np
import xxhash

from reticula.llm import embedding_dedup, simhash_dedup


def brute_components(ids, linked):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def brute_fp(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    sh = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_simhash(rows):
    fps = {i: brute_fp(t) for i, t in rows}
    pairs = [(a, b) for a in fps for b in fps if a < b and bin(fps[a] ^ fps[b]).count("1") <= 4]
    comp = brute_components(list(fps), pairs)
    return {i: (f"{fps[i]:016x}", comp[i]) for i in fps}


def texts(n=160, seed=1):
    r = random.Random(seed)
    words = [f"Wörd{i}" for i in range(300)]
    out = []
    for i in range(n):
        base = out[r.randrange(len(out))][1] if out and r.random() < 0.5 else " ".join(r.choices(words, k=r.randint(0, 300)))
        w = (base or "").split(" ")
        if r.random() < 0.7 and w:
            w[r.randrange(len(w))] = r.choice(words)
        out.append((i, r.choice([" ", "\n", "\t "]).join(w)))
    return [*out, (n, None), (n + 1, ""), (n + 2, "  \x85 \x1c"), (n + 3, "A b"), (n + 4, "a  B")]


def test_simhash_matches_brute_force(spark):
    rows = texts()
    want = brute_simhash(rows)
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, fp int, component string")
    for block in (4096, 8):
        got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash_dedup.near_duplicates(df, block=block).collect()}
        assert got == want
    kept = simhash_dedup.dedup(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in want.values()})


def test_simhash_all_masks_find_all_pairs():
    r = random.Random(3)
    for n in (1, 1_000, 10**6, 10**9, 10**13):
        masks = simhash_dedup.key_masks(n, 4)
        for _ in range(200):
            flip = sum(1 << b for b in r.sample(range(64), 4))
            assert any(flip & m == 0 for m in masks)


def test_simhash_nulls_repeats_empty(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (None, "a b c d e"), (7, "a b c d e"), (7, "a b c d e"), (None, "zz yy xx ww vv uu")], "doc_id long, text string")
    got = sorted((r.doc_id is None, r.doc_id, r.component_id is None, r.component_id) for r in simhash_dedup.near_duplicates(df).collect())
    assert [g[1:] for g in got] == [(7, False, 7), (7, False, 7), (None, False, 7), (None, False, 7), (None, True, None)]
    assert simhash_dedup.dedup(df).count() == 2
    assert simhash_dedup.near_duplicates(df.limit(0)).count() == 0
    assert simhash_dedup.dedup(df.limit(0)).count() == 0


def brute_vectors(rows, t=0.95):
    good = [(i, np.array(v, float)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {k: set() for k in range(len(good))}
    for a in range(len(good)):
        for b in range(len(good)):
            x, y = good[a][1], good[b][1]
            if a != b and len(x) == len(y) and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= t:
                links[a].add(b)
    comp = brute_components(range(len(good)), [(a, b) for a in links for b in links[a] if a < b])
    least = {}
    for a in comp:
        least[comp[a]] = min(least.get(comp[a], 1 << 60), good[a][0])
    out = [(good[a][0], len(links[a]), least[comp[a]], good[a][0] == least[comp[a]]) for a in comp]
    ok = {i for i, _ in good}
    return sorted(out + [(i, 0, i, True) for i, v in rows if i not in ok])


def test_embeddings_match_brute_force(spark):
    r = np.random.default_rng(5)
    rows = []
    for i in range(400):
        if rows and r.random() < 0.6:
            base = np.array(rows[r.integers(len(rows))][1])
            v = base + r.normal(size=16) * r.choice([0, 0.02, 0.06, 0.09])
        else:
            v = r.normal(size=16)
        rows.append((int(i), [float(np.float32(x)) for x in v * r.choice([1, 3])]))
    odd = [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [None] + [1.0] * 15), (904, []), (905, [1.0, 2.0]), (906, [2.0, 4.0]), (907, [float("inf")] * 16)]
    df = spark.createDataFrame([(i, v, 3, "x") for i, v in rows + odd], "vec_id long, embedding array<float>, node int, links string")
    want = brute_vectors(rows + odd)
    for cell, block in ((8192, 4096), (40, 16)):
        got = sorted(tuple(x) for x in embedding_dedup.near_duplicates(df, cell_rows=cell, block=block).select("vec_id", "n_links", "component_id", "kept").collect())
        assert got == want
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_int8_bound_is_rigorous():
    r = np.random.default_rng(2)
    x = r.normal(size=(300, 64))
    x[:20] *= np.eye(64)[:20] * 50 + 0.01
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    q = embedding_dedup.quantise(u)
    for t in (0.0, 0.1, 0.3):
        i, j = embedding_dedup.candidates(q, q, t)
        got = set(zip(i.tolist(), j.tolist()))
        a, b = np.nonzero(u @ u.T >= t)
        assert set(zip(a.tolist(), b.tolist())) <= got
        assert len(got) < 1.2 * len(a) + 300
