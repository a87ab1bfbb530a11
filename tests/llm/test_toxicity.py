import random
import zlib

from reticula.llm import queries, toxicity
from reticula.llm.toxicity import INSULT, NEGATION, OTHER, REPORT, TARGET, THREAT


def paths(parts, words):
    """Weights of every path through the transducers in turn, by listing them."""
    live = [(tuple(0 for _ in parts), 0.0)]
    for alternatives in words:
        grown = []
        for states, total in live:
            for symbol, weight in alternatives:
                ways = [((), symbol, 1.0)]
                for part, state in zip(parts, states, strict=True):
                    ways = [((*s, after), out, f * g) for s, mid, f in ways for after, out, g in part.arcs[state][mid]]
                grown += [(s, total + f * weight) for s, _, f in ways]
        live = grown
    return [t for states, t in live if all(s in p.finals for s, p in zip(states, parts, strict=True))]


def test_composition_equals_listing_all_paths():
    r = random.Random(2)
    parts = [toxicity.negation(), toxicity.reported(), toxicity.attack()]
    whole = toxicity.machine()
    for _ in range(300):
        words = [[(r.randrange(6), r.choice([0.0, 1.0, 2.5])) for _ in range(r.choice([1, 1, 2]))] for _ in range(r.randrange(8))]
        assert abs(whole.best(words) - max(paths(parts, words))) < 1e-12


def test_long_runs_of_other_words_change_nothing():
    m = toxicity.Model({"idiot": 4.0}, {})
    for text in ("not a idiot", "you b idiot", "said b idiot", "idiot b you", "kill b you"):
        for n in range(1, 9):
            words = text.replace(" b ", " " + "b " * n).replace(" a ", " " + "b " * n)
            assert m.clauses(words) == [x for x in [m.grammar.best([m.classify(w) for w in words.split()])] if x]


def test_grammar_reads_clauses():
    m = toxicity.Model({"idiot": 4.0}, {"lowei": 4.0})
    one = lambda t: sum(m.clauses(t))
    assert one("You idiot.") > one("An idiot.") > one("He is not an idiot") > 0
    assert one("She said idiot") < one("an idiot")
    assert one("kill the lights") == 0 and one("") == 0
    assert one("LOWEIschaft***") > 0
    threat = one("I will kill you")
    assert threat > one("he said I will kill you") > one("he said I will not kill you") > 0
    assert threat > one("I will not kill you") > one("he said I will not kill you")
    assert one("I will kill him and hurt her") > threat > one("kill. You")
    assert one("Ich werde dich nicht schlagen") == 0 < one("nicht schlagen, dich") < one("schlagen, dich")
    assert {INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER} == set(range(6))


def identity():
    arcs = tuple(((0, s, 1.0 if s in (INSULT, THREAT) else 0.0),) for s in range(toxicity.SYMBOLS))
    return toxicity.Transducer((arcs,), frozenset([0]))


def test_labels_teach_every_class_and_scores_need_the_grammar(spark):
    """Toxic: insults and aimed threats; clean: the same words negated, reported, or without a target - in no language."""
    r = random.Random(11)
    vocab = ["".join(r.choices("abcdeghiklmnorstu", k=r.randint(3, 8))) for _ in range(300)]
    fill = lambda n: r.choices(vocab, k=n)
    rows, labels = [], []
    for i in range(1500):
        kind = r.randrange(6)
        toxic = kind in (0, 1)
        bad = r.choice(["florp", "grunx"])
        core = {0: [bad], 1: ["smite", "you"], 2: ["zod", bad], 3: ["qith", *fill(3), bad], 4: ["smite", "vaz"], 5: []}[kind]
        rows.append((i, " ".join([*fill(r.randint(2, 4)), ".", *fill(1), *core, *fill(4), ".", *fill(r.randint(2, 4))])))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    table = spark.createDataFrame(labels[:1000], "doc_id long, toxic int")
    found = toxicity._tally(docs.join(table, "doc_id").select("text", "toxic"), toxicity._patterns).where("before is null")
    assert found.where("pattern = 'tsmite'").first().bad > 0 == found.where("pattern = 'tsmite'").first().clean
    # Insults stand in as many clean as toxic texts here, so their lexicon is given; the words around them are learned.
    model = toxicity._learn_context(toxicity.Model({"florp": 5.0, "grunx": 5.0}, {}, threats={"smite": 4.0}), docs.join(table, "doc_id").select("text", "toxic"))
    assert "zod" in model.negations and "qith" in model.reports and "you" in model.targets and "vaz" not in model.targets
    good = lambda m: [m.features(t)[1] for _, t in rows[1000:]]
    truth = [y for _, y in labels[1000:]]

    def apart(values):  # accuracy of the best threshold
        return max(sum((v >= c) == bool(y) for v, y in zip(values, truth, strict=True)) for c in set(values)) / len(truth)

    with_grammar = apart(good(model))
    model.grammar = identity()
    assert with_grammar > 0.99 and apart(good(model)) < 0.7


def test_threats_are_words_that_are_toxic_with_a_target_only(spark):
    r = random.Random(12)
    vocab = ["".join(r.choices("abcdeghiklmnorstu", k=r.randint(3, 8))) for _ in range(300)]
    rows, labels = [], []
    for i in range(800):
        toxic = r.random() < 0.3
        words = r.choices(vocab, k=12)
        words[r.randrange(3, 9)] = "smite you" if toxic else "smite"
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert "smite" in model.threats and "smite" not in model.words
    assert model.score("they smite you here") > 0.5 > model.score("they smite here")
    assert model.score("they never smite you") < model.score("they smite you")
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert toxicity.score(empty, model).count() == 0 and toxicity.remove_toxic(empty, model).count() == 0
    long_text = "b " * 300_000 + ". smite you " + "b " * 300_000
    assert model.score(long_text) == model.score("smite you")


def test_learns_and_holds_out(spark):
    r = random.Random(3)
    vocab = ["".join(r.choices("abcdeghiklmnorstu", k=r.randint(3, 8))) for _ in range(400)]
    rows, labels = [], []
    for i in range(900):
        w = r.choices(vocab, k=r.randint(30, 90))
        toxic = int(r.random() < 0.2)
        for _ in range(3 * toxic):
            w.insert(r.randrange(len(w)), r.choice(["florp", "grunx", "zzabbel" + r.choice(["er", "st", "ing"])]))
        rows.append((i, " ".join(w), "x"))
        labels.append((i, toxic, 1))
    rows += [(i, rows[0][1] + " copy", "x") for i in range(900, 960)]  # copies of one text teach nothing about its words
    labels += [(i, labels[0][1], 1) for i in range(900, 960)] + [(1, None, 0), (5000, 1, 0)]
    docs = spark.createDataFrame([*rows, (None, None, "x"), (None, "", "y")], "doc_id long, text string, score string")
    table = spark.createDataFrame(labels, "doc_id long, toxic int, quality int")
    got = queries.toxicity_scores(docs, table).collect()
    assert len(got) == 962
    truth = {a: b for a, b, _ in labels if b is not None}
    held = [g for g in got if g.held_out and g.doc_id in truth]
    assert all(g.held_out == (g.doc_id is not None and zlib.crc32(str(g.doc_id).encode()) % 5 == 0) for g in got)
    assert sum(g.predicted == truth[g.doc_id] for g in held) / len(held) > 0.97
    assert {g.predicted for g in got if g.doc_id is None} == {0}
    model = toxicity.fit(docs, table)
    assert any(s.startswith("zzab") for s in model.stems) and "florp" in model.words
    kept = toxicity.remove_toxic(docs, model)
    assert kept.columns == docs.columns and 700 < kept.count() < 900
    assert toxicity.score(docs.limit(0), model).count() == 0
    empty = toxicity.fit(docs, table.limit(0))
    assert toxicity.score(docs, empty).where("score between 0 and 1").count() == 962
