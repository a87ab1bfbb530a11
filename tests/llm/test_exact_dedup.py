import hashlib
import random
import re

from reticula.llm import exact_dedup


def brute(rows):
    norm = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in rows]
    key = lambda i: (i is None, i or 0)
    out = []
    for k, (i, t) in enumerate(norm):
        same = [(key(j), m) for m, (j, u) in enumerate(norm) if u == t]
        out.append((str(i), str(norm[min(same)[1]][0]), len(same), hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out)


def sample():
    r = random.Random(8)
    pool = ["", " ", "a", "aa", "aaa", "abcabcabc", "x y", "é" * 9, "日本語😀" * 5, "line sep\x85 \x00 end"] + ["".join(r.choices("ab \n", k=r.randint(1, 60))) for _ in range(40)]
    rows = [(i, r.choice(pool)) for i in range(200)] + [(300, None), (301, "x \n\t y"), (None, "a"), (None, "unique null"), (5, "rep"), (5, "rep")]
    return rows


def test_matches_brute_force(spark):
    rows = sample()
    df = spark.createDataFrame([(i, t, 1, "n") for i, t in rows], "doc_id long, text string, uid int, name string")
    for size, bits in ((4096, 64), (4, 64), (4, 3)):
        got = exact_dedup.exact_duplicates(df, block_chars=size, hash_bits=bits).collect()
        assert sorted((str(g.doc_id), str(g.keep_id), g.group_size, g.text_sha256) for g in got) == brute(rows)
        kept = [g for g in got if g.kept]
        assert len(kept) == len({g.text_sha256 for g in got}) and all(g.doc_id == g.keep_id for g in kept)


def test_dedup_rows(spark):
    df = spark.createDataFrame([(i, t, 1, "n") for i, t in sample()], "doc_id long, text string, uid int, _text string")
    got = exact_dedup.dedup(df)
    assert got.columns == df.columns
    texts = [re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in got.collect()]
    assert len(texts) == len(set(texts)) == len({t[3] for t in brute(sample())})
    assert exact_dedup.dedup(df.limit(0)).count() == 0
