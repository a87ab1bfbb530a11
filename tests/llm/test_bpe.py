import hashlib
import random

import public_tokenizers
from tokenizers import Tokenizer as Library

from reticula.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


def samples():
    r = random.Random(4)
    alphabet = "abcdefghijklmnop  \n\tABÉßİΣςéñ'’s12٣.!?<|>_/\\\x1c\x85 ́"
    out = ["", " ", "don't we'll I'M", "<|endoftext|>", "a<|endoftext|>b <|startoftext|><|endoftext|", "ΑΣ ΣΑΣ", "日本語 テキスト 中文", "नमस्ते", "😀 ok 👍🏽", "ᾯ ﬁ Å", "x" * 5000, "é" * 300]
    out += ["".join(r.choices(alphabet, k=r.randint(1, 200))) for _ in range(600)]
    return out


def test_same_as_library():
    library, mine = Library.from_file(PATH), bpe.Tokenizer(PATH)
    for text, want in zip(samples(), library.encode_batch(samples(), add_special_tokens=False), strict=True):
        assert mine.encode(text) == want.ids, repr(text)
        assert mine.decode(want.ids) == library.decode(want.ids, skip_special_tokens=False)


def test_code_points_same_as_library():
    library, mine = Library.from_file(PATH), bpe.Tokenizer(PATH)
    texts = [f"a{chr(c)}b {chr(c)}1 {chr(c)}" for c in range(0, 0x3400) if not 0xD800 <= c <= 0xDFFF]
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert mine.encode(text) == want.ids, repr(text)


def test_query_form(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(samples()[:80])] + [(None, None, "y", 2), (3, "again", "z", 3), (3, "again", "z", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, n int")
    library = Library.from_file(PATH)

    def want(i, t):
        ids = library.encode(t or "", add_special_tokens=False).ids
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        return (str(i), len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))

    got = bpe.encode(df, PATH, digest=True).collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == sorted(want(i, t) for i, t, *_ in rows)
    whole = bpe.encode(df, PATH).where("doc_id = 2").first()
    assert library.decode(whole.ids, skip_special_tokens=False) == whole.decoded
    assert bpe.encode(df.limit(0), PATH).count() == 0


def test_cache_generations(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 3)
    mine, library = bpe.Tokenizer(PATH), Library.from_file(PATH)
    text = "one two three four five one two six seven one eight two"
    assert mine.encode(text) == mine.encode(text) == library.encode(text, add_special_tokens=False).ids
    assert len(mine.young) <= 3
