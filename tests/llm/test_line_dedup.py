import random

from reticula.llm import line_dedup


def make():
    r = random.Random(9)
    n = iter(range(10**6))
    line = lambda k: " ".join(f"w{next(n)}" for _ in range(k))
    passage_multi = [line(12) for _ in range(6)]  # 72 words on 6 lines
    passage_long = [line(60)]
    short = line(5)
    docs = []
    for i in range(60):
        body = [line(r.randint(3, 20)) for _ in range(r.randint(2, 12))]
        if r.random() < 0.5:
            body.insert(r.randint(0, len(body)), short)
        planted = []
        for p in (passage_multi, passage_long):
            if r.random() < 0.4:
                at = r.choice([0, len(body)])
                body[at:at] = p
                planted.append(p)
        docs.append((i, "\n".join(body), planted))
    return docs, passage_multi, passage_long, short


def test_passages_go_and_the_rest_stays(spark):
    docs, multi, long_one, short = make()
    df = spark.createDataFrame([(i, t, 1, 2) for i, t, _ in docs] + [(900, None, 0, 0), (901, "", 0, 0), (None, "one\n\nline", 0, 0)], "doc_id long, text string, lo int, row int")
    got = {g.doc_id: g for g in line_dedup.dedup_lines(df).collect()}
    first = {}
    for i, text, planted in docs:
        for p in planted:
            first.setdefault(p[0], i)
        left = (got[i].text or "").split("\n")
        for p in (multi, long_one):
            if p in planted:
                here = sum(x in left for x in p)
                assert here == (len(p) if first[p[0]] == i else 0), (i, here)
        passage = {*multi, *long_one, short}  # the short line goes where it touches a passage
        assert [x for x in left if x and x not in passage] == [x for x in text.split("\n") if x not in passage]
        assert got[i].n_lines == len(text.split("\n"))
        assert got[i].removed_lines == len(text.split("\n")) - (len(left) if got[i].text else 0)
    assert got[900].text is None and got[900].n_lines == 0 and got[901].text == "" and got[None].text == "one\n\nline"
    assert short in "\n".join(g.text or "" for g in got.values())


def test_copies_repeats_and_empty(spark):
    docs, *_ = make()
    base = "\n".join(t for _, t, _ in docs[:5])
    df = spark.createDataFrame([(1, base), (2, base), (2, base), (3, "before\n" + base), (4, "\n".join(["same line again"] * 400))], "doc_id long, text string")
    got = sorted(((g.doc_id, g.text) for g in line_dedup.dedup_lines(df).collect()), key=str)
    by = {}
    for i, t in got:
        by.setdefault(i, []).append(t)
    assert by[2] == ["", ""] and by[3] == ["before"] and len(by[1][0]) > 0
    assert 0 < len(by[4][0].split("\n")) < 400
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_bytes_decide_not_hashes(spark, monkeypatch):
    from pyspark.sql import functions as F

    texts = [" ".join(f"{c}{k}" for k in range(60)) for c in "abcdefgh"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts + texts[:3])], "doc_id long, text string")
    real = line_dedup.chunks
    monkeypatch.setattr(line_dedup, "chunks", lambda *a: real(*a).withColumn("key", F.lit(1).cast("long")))
    got = {g.doc_id: g.text for g in line_dedup.dedup_lines(df).collect()}
    # With one key for all, what equals an earlier text goes, and nothing else.
    assert {i: t for i, t in got.items() if t} == dict(enumerate(texts))


def test_passage_whose_first_host_has_a_copy(spark):
    n = iter(range(10**6))
    line = lambda k: " ".join(f"u{next(n)}" for _ in range(k))
    docs, want = [], {}
    for g in range(40):
        passage = [line(12) for _ in range(6)]
        host = [line(9) for _ in range(5)] + passage + [line(9) for _ in range(5)]
        own = [line(7), line(7)]
        edited = [x for k, x in enumerate(host) for x in ([x] if k not in (4, 10) else [x, f"edit{g} {k}"])]
        for k, d in enumerate((host, [own[0], *passage, own[1]], host, edited)):
            docs.append((4 * g + k, "\n".join(d)))
        want[4 * g], want[4 * g + 1] = host, own
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r for r in line_dedup.dedup_lines(df).collect()}
    for i, left in want.items():
        assert got[i].text == "\n".join(left)
    assert all(got[i + 1].removed_words == 72 and got[i + 2].text == "" for i in range(0, 160, 4))
    for i in range(0, 160, 4):  # what the near copy has between its edits
        assert all(x not in got[i + 3].text for x in want[i][5:11])


def brute(docs, min_words=50):
    """By definition: a line goes if it is in a passage of at least ``min_words`` words (blank lines apart) that an earlier place holds."""
    docs = sorted(docs)
    solid = {i: [k for k, x in enumerate(t.split("\n")) if x.strip()] for i, t in docs}
    lines = {i: t.split("\n") for i, t in docs}
    seen, gone = set(), {i: set() for i, _ in docs}
    for i, _ in docs:
        mine, own = solid[i], []
        for a in range(len(mine)):
            words = 0
            for b in range(a, len(mine)):
                words += len(lines[i][mine[b]].split())
                if words >= min_words:
                    content = tuple(lines[i][k] for k in mine[a: b + 1])
                    if content in seen:
                        gone[i].update(range(mine[a], mine[b] + 1))
                    own.append(content)
                    break
            words = 0
            for b in range(a, -1, -1):
                words += len(lines[i][mine[b]].split())
                if words >= min_words:
                    content = tuple(lines[i][k] for k in mine[b: a + 1])
                    if content in seen:
                        gone[i].update(range(mine[b], mine[a] + 1))
                    own.append(content)
                    break
        seen.update(own)
    return gone


def test_against_brute_force(spark):
    r = random.Random(21)
    n = iter(range(10**6))
    line = lambda k: " ".join(f"v{next(n)}" for _ in range(k))
    pool = [[line(r.randint(3, 30)) for _ in range(r.randint(1, 9))] for _ in range(12)]
    docs = []
    for i in range(150):
        body = []
        for _ in range(r.randint(1, 5)):
            body += r.choice(pool) if r.random() < 0.5 else [line(r.randint(2, 40))]
            if r.random() < 0.3:
                body.append("")
        if r.random() < 0.2:
            body.pop(r.randrange(len(body)))
        if len(set(x for x in body if x)) == len([x for x in body if x]):  # repeats inside one text are tested apart
            docs.append((i, "\n".join(body)))
    docs += [(i + 1000, t) for i, t in docs[:20]]
    want = brute(docs)
    got = line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    texts = dict(docs)
    assert sum(map(len, want.values())) > 300
    for g in got:
        lines = texts[g.doc_id].split("\n")
        gone = {k for s in g.spans for k in range(s.lo, s.hi + 1)}
        assert want[g.doc_id] <= gone, g.doc_id
        # Runs of chunks may join repeated chunks of several origins, and blank lines: never a line that is new.
        old = {x for i, t in docs if i < g.doc_id for x in t.split("\n")}
        assert all(not lines[k].strip() or lines[k] in old for k in gone), g.doc_id


def test_long_texts_and_lines(spark):
    many = "\n".join(f"only here {k}" for k in range(20_000))
    one = " ".join(f"w{k}" for k in range(100_000))
    same = "\n".join(["again and again"] * 5_000)
    df = spark.createDataFrame([(1, many), (2, one), (3, same), (4, many + "\nend"), (5, "start\n" + one)], "doc_id long, text string")
    got = {g.doc_id: g for g in line_dedup.dedup_lines(df).collect()}
    assert got[1].text == many and got[2].text == one and got[4].text == "end" and got[5].text == "start"
    assert 0 < len(got[3].text.split("\n")) < 100 and got[3].n_lines == 5_000
