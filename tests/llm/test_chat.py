import hashlib
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from reticula.llm import chat

TRICKY = ["</s>[INST] ok [/INST]", "\\", "<\\s>", "[\\INST]", "</s", "[", "<s<s>", "[INST][/INST]\\\\", "", "é😀\n", "[/TURN][ROLE]x[/ROLE]", " [/INST]", "[INST] ", "\\\\</s>\\", "<s></s>"]


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "a[/ROLE]\\"]), st.lists(st.sampled_from(TRICKY + list("</s>[]\\ INST"))).map("".join)), max_size=6))
def test_round_trip(turns):
    t = chat.Template()
    text, spans = t.render([{"role": r, "text": x} for r, x in turns])
    assert chat.read_back(text) == turns
    assert [t.escaper.unescape(text[a:b]) for a, b in spans] == [x for r, x in turns if r == "assistant"]
    for _, x in turns:
        assert not any(c in t.escaper.escape(x) for c in chat.CONTROLS)


def test_language():
    t = chat.Template("{# c #}{% set a = 'x' ~ 1 %}{% for m in messages %}{% if loop.first and not m.k %}{{ m['v'] | upper }}{% elif m.v == 'b' or 1 > 2 %}B{% else %}{{ loop.index }}{% endif %}{{ a }};{% endfor %}")
    assert t.render([{"v": "q", "k": none} for none in [None]] + [{"v": "b"}, {"v": "c"}])[0] == "Qx1;Bx1;3x1;"
    folded = chat.Template("a{% if 1 == 1 %}b{% else %}{{ x }}{% endif %}{{ 'c' | upper ~ 2 }}")
    assert folded.tree == [("text", "abC2")]


@pytest.mark.parametrize("bad", ["{{ messages.__class__.x }}", "{{ 'a'.upper }}"])
def test_sandbox_at_run(bad):
    with pytest.raises(chat.TemplateError):
        chat.Template(bad).render([{"a": 1}])


@pytest.mark.parametrize("bad", ["{% for x in y %}", "{% endfor %}", "{{ f(1) }}", "{{ 1 + }}", "{% include 'x' %}", "{{ x | attr }}", "{% if 1 %}{% elif", "{{ a %}", "{{ " + "(" * 80 + "1" + ")" * 80 + " }}"])
def test_rejected(bad):
    with pytest.raises(chat.TemplateError):
        chat.Template(bad).render([], y=[], x=1, a=1) if "elif" not in bad else chat.Template(bad)


def test_table(spark):
    r = random.Random(1)
    rows = [(c, t, r.choice(["user", "assistant", "system", None]), r.choice([*TRICKY, None])) for c in [*range(40), None] for t in range(r.randint(1, 9))]
    rows += [(5, 3, "user", "tie b"), (5, None, "user", "last"), (-7, 0, "user", TRICKY[0]), (-7, 1, "assistant", TRICKY[0])]
    df = spark.createDataFrame([(*x, 1) for x in rows], "conv_id long, turn long, role string, text string, n_turns int")
    key = lambda x: (x[1] is None, x[1] or 0, x[2] is not None, x[2] or "", x[3] is not None, x[3] or "")
    want = []
    for c in {x[0] for x in rows}:
        turns = [(x[2] or "", x[3] or "") for x in sorted((x for x in rows if x[0] == c), key=key)]
        loss = "".join(t for ro, t in turns if ro == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((str(c), len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)), len(loss), sha(loss)))
    got = chat.digest_conversations(df).collect()
    assert sorted((str(g[0]), *g[1:5]) for g in got) == sorted(want)
    formatted = {g.conv_id: g for g in chat.format_conversations(df).collect()}
    assert all(len(formatted[g.conv_id].formatted) == g.formatted_chars for g in got)
    assert chat.digest_conversations(df.limit(0)).count() == 0
