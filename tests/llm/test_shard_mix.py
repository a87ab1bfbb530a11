import random
import zlib

import pytest

from reticula.llm import mixing, sharding


def rows():
    r = random.Random(6)
    out = [(i, " ".join("wé" for _ in range(r.choice([0, 1, 5, 30, 400]))), r.choice(["a", "a", "a", "b", "c", None])) for i in range(300)]
    return [*out, (None, "x y", "b"), (4, "rep rep", "c"), (4, "rep rep", "c"), (400, None, "b"), (401, "\x85 \x1c a", "d")]


@pytest.mark.parametrize("shards", [1, 24, 500])
def test_shards(spark, shards):
    data = rows()
    df = spark.createDataFrame([(i, t, 1, 2) for i, t, _ in data], "doc_id long, text string, shard int, id int")
    got = sharding.assign_shards(df, shards).collect()
    size = lambda t: len((t or "").encode()) + 8
    assert sorted((str(g.doc_id), g.size, g.text_crc32) for g in got) == sorted((str(i), size(t), zlib.crc32((t or "").encode())) for i, t, _ in data)
    total, most = sum(g.size for g in got), max(g.size for g in got)
    for s in range(shards):
        own = [g for g in got if g.shard == s]
        assert sorted(g.slot for g in own) == list(range(len(own)))
        assert abs(sum(g.size for g in own) - total / shards) <= most
    by_text = {}
    for g in got:
        by_text.setdefault((g.text_crc32, g.size), set()).add(g.shard)
    for s in by_text.values():  # equal texts stand together
        assert max(s) - min(s) + 1 >= len(s)
    assert sharding.assign_shards(df.limit(0)).count() == 0


def brute_targets(sizes, weights=(5, 2, 1)):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % 3] for k, s in enumerate(order)}
    target, left, free = {}, 1.5 * sum(sizes.values()), set(order)
    while free:
        level = left / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > 2 * sizes[s]}
        if not over:
            return target | {s: level * w[s] for s in free}
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        free -= over
    return target


def test_mix_targets(spark):
    data = rows()
    df = spark.createDataFrame([(i, t, s, 1, 2) for i, t, s in data], "doc_id long, text string, source string, size int, rank int")
    count = lambda t: len((t or "").encode().split())
    sizes = {}
    for _, t, s in data:
        sizes[s] = sizes.get(s, 0) + count(t)
    want = brute_targets(sizes)
    joined = mixing.plan(df).collect()
    assert len(joined) == len(data)
    target = {}
    for g in joined:
        assert g.taken <= 2 * g.size and g.taken == g.copies * g.size
        assert (g.position is None) == (g.copies == 0) and (g.position is None or 0 <= g.position <= g.last_position <= 1)
        key = (g.source_size, round(g.target, 6))
        target[key] = target.get(key, 0) + g.taken
    assert set(target) == {(sizes[s], round(want[s], 6)) for s in sizes}
    for (_, t), taken in target.items():
        assert t - 400 <= taken <= t  # never above, and no more than a document below
        assert t - taken <= 0.03 * t or t < 2000  # what small documents can fill is filled
    again = mixing.plan(df.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, joined))
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    assert sum(count(r.text) for r in mixed.collect()) == sum(g.taken for g in joined)
    assert mixing.plan(df.limit(0)).count() == 0 and mixing.mix(df.limit(0)).count() == 0


def test_position_inverts_the_schedule(spark):
    from pyspark.sql import functions as F

    df = spark.range(101).select((F.col("id") / 100).alias("x")).crossJoin(spark.createDataFrame([(-0.9,), (0.0,), (0.5,)], "tilt double"))
    for r in df.withColumn("t", mixing.position(F.col("x"), F.col("tilt"))).collect():
        assert abs((1 - r.tilt) * r.t + r.tilt * r.t**2 - r.x) < 1e-9


def test_no_document_fits_what_is_left_open(spark):
    r = random.Random(11)
    data = [(i, " ".join("w" for _ in range(r.randint(200, 1500))), f"s{i % 6}") for i in range(60)]
    got = mixing.plan(spark.createDataFrame(data, "doc_id long, text string, source string")).collect()
    source = {i: s for i, _, s in data}
    for s in set(source.values()):
        own = [g for g in got if source[g.doc_id] == s]
        rounds = own[0].target // own[0].source_size
        left = own[0].target - sum(g.taken for g in own)
        assert left >= 0 and all(g.size > left for g in own if g.copies == rounds)


def test_equal_rows_match_by_source_and_number(spark):
    from collections import Counter

    text = " ".join(["w"] * 40)
    data = [(1, text, "a"), (1, text, "b"), (1, text, "c"), (2, text, "c"), (2, text, "c"), (None, None, None), (None, text, None)]
    data += [(10 + i, " ".join(["x"] * 30), "abc"[i % 3]) for i in range(30)]
    df = spark.createDataFrame([(*d, 1, 2) for d in data], "doc_id long, text string, source string, copies int, position int")
    for seed in range(3):
        want = Counter()
        for r in mixing.plan(df.repartition(seed + 1)).collect():
            want[r.doc_id, r.size, r.source] += r.copies
        got = Counter((r.doc_id, len((r.text or "").split()), r.source) for r in mixing.mix(df.repartition(seed + 1)).collect())
        assert got == +want


def test_a_source_of_one_long_text(spark):
    data = [(1, " ".join(["w"] * 200_000), "big"), *[(i, "one two three", "small") for i in range(2, 200)]]
    got = {r.doc_id: r for r in mixing.plan(spark.createDataFrame(data, "doc_id long, text string, source string")).collect()}
    assert got[1].size == 200_000 and got[1].taken in (0, 200_000, 400_000) and got[1].taken <= got[1].target
