"""Toxicity by a weighted finite-state pattern grammar.

A clause is a sequence of words; the lexical transducer gives each word its classes, INSULT,
THREAT, TARGET, NEGATION, REPORT or other, with a weight.  Three transducers are composed into
one machine: negation marks the attacks that follow it closely, reported speech marks those in
the rest of its clause, and attack matches insults (more if a target is near) and threats (only
if a target follows), scaled by their marks.  The machine is not deterministic: whether an attack
is read as aimed is guessed and must come true.  A clause scores its best path; a document scores
by its matched clauses, and a logistic regression turns that into a probability.

What the labels teach.  A pattern is a word, the beginning of words (4 to 6 letters, so that
derived forms match), or a word with a target after it.  A pattern's evidence is the number of
different words it follows in toxic texts (copies of one text count once that way), but at most
two for each toxic text it is in (so that one long text doesn't count often); occurrences under
negation or report are no evidence.  Patterns enter the lexicon if that much evidence is expected
for about one of all patterns by chance: as insults, or as threats where only the pattern with
the target does.  In a second pass the words around attacks enter the other classes: those before
attacks in clean texts as negations or reports, those after threats in toxic texts as targets.
The fixed words of a class leave it if the labels speak against them.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import drop
from .common import cut, pack

#: Bound of the labelled rows that the model is fitted on (in hash order).
SAMPLE_ROWS = 20_000

# Fixed words that the classes start from: English, German, French, Spanish.
THREATS = frozenset("""kill hurt destroy beat burn punish crush murder stab shoot attack strangle
    töten umbringen schlagen verbrennen zerstören erwürgen erschießen tuer frapper brûler détruire égorger étrangler
    matar golpear quemar destruir estrangular apuñalar""".split())
TARGETS = frozenset("""you your he she they them him her this that these those everyone people
    du dich dir euch ihn ihm alle tu te toi vous lui leur tous ti usted ustedes ellos ellas todos""".split())
NEGATIONS = frozenset("""not never no nobody isn aren wasn don doesn didn won cannot without hardly
    nicht nie kein keine keinen niemals ohne pas jamais aucun aucune sans nunca jamás ningún ninguna sin""".split())
REPORTS = frozenset("""said says wrote writes quoted quotes reported claims claimed called told according alleged
    sagte sagt schrieb behauptete nannte zitierte dit écrit disait appelé selon dijo dice escribió llamó según""".split())

#: Factors of the grammar, weight of a fixed threat word, words that a negation and a target reach.
NEGATED, REPORTED, AIMED, THREAT_WEIGHT = 0.4, 0.6, 1.2, 3.0
REACH, GAP = 2, 3
#: A word around attacks: least documents to judge it by; share of toxic ones against all, below which it softens.
LEAST, SOFT = 5, 0.25

WORDS = re.compile(r"[^\W\d_]+")
CLAUSES = re.compile(r"[.!?;:\n]+")
#: Classes of words; then attacks that are marked as negated, reported, or both.
INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER, INSULT_N, THREAT_N, INSULT_R, THREAT_R, INSULT_NR, THREAT_NR = range(12)
SYMBOLS = 12
_NEGATE = {INSULT: INSULT_N, THREAT: THREAT_N}
_REPORTED = {INSULT: INSULT_R, THREAT: THREAT_R, INSULT_N: INSULT_NR, THREAT_N: THREAT_NR}
_FACTORS = {INSULT: 1.0, INSULT_N: NEGATED, INSULT_R: REPORTED, INSULT_NR: NEGATED * REPORTED}
_THREAT_FACTORS = {THREAT: 1.0, THREAT_N: NEGATED, THREAT_R: REPORTED, THREAT_NR: NEGATED * REPORTED}


# ---- transducers ---------------------------------------------------------------------------

Arc = tuple[int, int, float]


@dataclass(frozen=True)
class Transducer:
    """Weighted transducer: ``arcs[state][symbol]`` are (next state, symbol out, factor of the word's weight).

    State 0 is the start.  A path through a sequence of words weighs the sum of factor * weight.
    """

    arcs: tuple[tuple[tuple[Arc, ...], ...], ...]
    finals: frozenset[int]

    def compose(self, other: Transducer) -> Transducer:
        """The transducer that feeds this one's output to ``other``; states that the start reaches."""
        number, order, arcs = {(0, 0): 0}, [(0, 0)], []
        for a, b in order:
            row = []
            for symbol in range(SYMBOLS):
                made = []
                for a2, mid, f in self.arcs[a][symbol]:
                    for b2, out, g in other.arcs[b][mid]:
                        if (a2, b2) not in number:
                            number[a2, b2] = len(order)
                            order.append((a2, b2))
                        made.append((number[a2, b2], out, f * g))
                row.append(tuple(made))
            arcs.append(tuple(row))
        return Transducer(tuple(arcs), frozenset(k for k, (a, b) in enumerate(order) if a in self.finals and b in other.finals))

    def best(self, words: Iterable[Iterable[tuple[int, float]]]) -> float | None:
        """Weight of the best path through words with alternative (symbol, weight); None without any."""
        live = {0: 0.0}
        for alternatives in words:
            grown: dict[int, float] = {}
            for symbol, weight in alternatives:
                for state, total in live.items():
                    for after, _, factor in self.arcs[state][symbol]:
                        reached = total + factor * weight
                        if reached > grown.get(after, -1.0):
                            grown[after] = reached
            live = grown
        return max((t for s, t in live.items() if s in self.finals), default=None)


def _row(arcs: dict[int, list[Arc]]) -> tuple[tuple[Arc, ...], ...]:
    return tuple(tuple(arcs.get(s, ())) for s in range(SYMBOLS))


def negation() -> Transducer:
    """Marks the attacks within REACH words after a negation.  State: words it still reaches."""
    rows = []
    for left in range(REACH + 1):
        after = max(left - 1, 0)
        rows.append(_row({s: [(REACH, OTHER, 1.0)] if s == NEGATION else [(after, _NEGATE.get(s, s) if left else s, 1.0)] for s in range(6)}))
    return Transducer(tuple(rows), frozenset(range(len(rows))))


def reported() -> Transducer:
    """Marks the attacks after a verb of speech, to the end of the clause."""
    symbols = [INSULT, THREAT, INSULT_N, THREAT_N, TARGET, OTHER]
    rows = [_row({s: [(state, _REPORTED.get(s, s) if state else s, 1.0)] for s in symbols} | {REPORT: [(1, OTHER, 1.0)]}) for state in (0, 1)]
    return Transducer(tuple(rows), frozenset((0, 1)))


def attack() -> Transducer:
    """Insults and threats.  States: 0; a target stood within GAP words (1 to GAP left); one must follow within GAP words."""
    def seen(left: int) -> int:
        return left

    def owed(left: int) -> int:
        return GAP + left

    rows = []
    for state in range(2 * GAP + 1):
        near, due = (state, 0) if state <= GAP else (0, state - GAP)
        # What a word that is no target leads to; a target that is due must come in time.
        step = [owed(due - 1)] if due > 1 else [] if due else [seen(max(near - 1, 0))]
        arcs: dict[int, list[Arc]] = {TARGET: [(seen(GAP), OTHER, 0.0)], OTHER: [(s, OTHER, 0.0) for s in step]}
        for symbol, factor in _FACTORS.items():
            aimed = factor * (AIMED if near else 1.0)
            arcs[symbol] = [(s, INSULT, aimed) for s in step]
            if not near and not due:  # guess that its target follows
                arcs[symbol].append((owed(GAP), INSULT, factor * AIMED))
        for symbol, factor in _THREAT_FACTORS.items():
            arcs[symbol] = [(s, OTHER, 0.0) for s in step] + ([(s, THREAT, factor) for s in step] if due else [(owed(GAP), THREAT, factor)])
        rows.append(_row(arcs))
    return Transducer(tuple(rows), frozenset(range(GAP + 1)))


def marks() -> Transducer:
    return negation().compose(reported())


def machine() -> Transducer:
    return marks().compose(attack())


# ---- scoring -------------------------------------------------------------------------------

_MARKS = marks()
_SPEECH = dict.fromkeys(NEGATIONS, NEGATION) | dict.fromkeys(REPORTS, REPORT)


@dataclass
class Model:
    """Learned lexicon (pattern to weight), words of the other classes, and the logistic layer over the features."""

    words: dict[str, float]
    stems: dict[str, float]
    weights: tuple[float, ...] = (-3.0, 1.5, 0.5)
    threats: dict[str, float] = field(default_factory=lambda: dict.fromkeys(THREATS, THREAT_WEIGHT))
    targets: frozenset[str] = TARGETS
    negations: frozenset[str] = NEGATIONS
    reports: frozenset[str] = REPORTS
    grammar: Transducer = field(default_factory=machine)
    _known: dict[str, tuple[tuple[int, float], ...]] = field(default_factory=dict)

    def classify(self, word: str) -> tuple[tuple[int, float], ...]:
        """The lexical transducer: every class of a word, with its weight."""
        found = self._known.get(word)
        if found is None:
            weight = max([self.words.get(word, 0.0), *(self.stems.get(word[:k], 0.0) for k in (4, 5, 6) if len(word) >= k)])
            kinds = [(INSULT, weight)] if weight else []
            kinds += [(THREAT, self.threats[word])] if word in self.threats else []
            kinds += [(c, 0.0) for c, of in ((TARGET, self.targets), (NEGATION, self.negations), (REPORT, self.reports)) if word in of]
            found = tuple(kinds) or ((OTHER, 0.0),)
            if len(self._known) > 200_000:
                self._known.clear()
            self._known[word] = found
        return found

    def hits(self, text: str) -> Iterator[tuple[list[str], list[tuple[tuple[int, float], ...]]]]:
        """Words and classes of the clauses that hold an insult or threat."""
        lowered = text.lower()
        classify = self.classify
        if not any(classify(w)[0][0] <= THREAT for w in set(WORDS.findall(lowered))):
            return
        for clause in CLAUSES.split(lowered):
            words = WORDS.findall(clause)
            classes = [classify(w) for w in words]
            if any(c[0][0] <= THREAT for c in classes):
                yield words, classes

    def clauses(self, text: str) -> list[float]:
        """Scores of the clauses that match: best paths."""
        scores = []
        for _, classes in self.hits(text):
            short, run = [], 0  # more other words than the grammar counts change nothing
            for c in classes:
                run = run + 1 if c[0][0] == OTHER else 0
                if run <= max(REACH, GAP) + 1:
                    short.append(c)
            total = self.grammar.best(short)
            if total:
                scores.append(total)
        return scores

    def features(self, text: str) -> tuple[float, float]:
        scores = self.clauses(text)
        return (math.log1p(sum(scores)), max(scores)) if scores else (0.0, 0.0)

    def score(self, text: str) -> float:
        x = self.features(text)
        z = self.weights[0] + self.weights[1] * x[0] + self.weights[2] * x[1]
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


# ---- learning ------------------------------------------------------------------------------

def _patterns(text: str) -> set[tuple[str, str]]:
    """(pattern, word before it): words as 'w...', stems as 's...', words with a target behind as 't...'; none that negation or report would mark."""
    found: set[tuple[str, str]] = set()
    add = found.add
    for clause in CLAUSES.split(text.lower()):
        words, state, before = WORDS.findall(clause), 0, ""
        aimed = {i for j, w in enumerate(words) if w in TARGETS for i in range(max(0, j - GAP), j)}
        for i, word in enumerate(words):
            free = state == 0 or _MARKS.arcs[state][INSULT][0][1] == INSULT
            if free and len(word) >= 3:
                add(("w" + word, before))
                if len(word) >= 4:
                    add(("s" + word[:4], before))
                    if len(word) >= 5:
                        add(("s" + word[:5], before))
                        if len(word) >= 6:
                            add(("s" + word[:6], before))
                if i in aimed:
                    add(("t" + word, before))
            if state or word in _SPEECH:
                state = _MARKS.arcs[state][_SPEECH.get(word, OTHER)][0][0]
            before = word
    return found


def _tally(texts: DataFrame, found: Callable[[str], set[tuple[str, str]]]) -> DataFrame:
    """(pattern, before, bad, clean): different words before a pattern in toxic texts, and its toxic and clean documents (before: null)."""
    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            pairs: set[tuple[str, int]] = set()
            documents: tuple[Counter[str], Counter[str]] = (Counter(), Counter())
            for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist(), strict=True):
                seen = found(text.as_py() or "")
                documents[bool(toxic)].update({p for p, _ in seen})
                if toxic:
                    pairs |= {(p, xxhash.xxh32_intdigest(b)) for p, b in seen}
            names = [*documents[0], *documents[1]]
            clean = [*documents[0].values(), *[0] * len(documents[1])]
            bad = [*[0] * len(documents[0]), *documents[1].values()]
            empty = [0] * len(pairs)
            yield pa.RecordBatch.from_arrays(
                [pa.array([*(p for p, _ in pairs), *names]), pa.array([*(b for _, b in pairs), *[None] * len(names)], pa.int64()), pa.array(empty + bad, pa.int64()), pa.array(empty + clean, pa.int64())],
                names=["pattern", "before", "bad", "clean"])

    seen = texts.mapInArrow(kernel, "pattern string, before long, bad long, clean long")
    return seen.groupBy("pattern", "before").agg(F.sum("bad").alias("bad"), F.sum("clean").alias("clean"))


def _gain(t: Column, c: Column, share: Column | float) -> Column:
    """Log-likelihood ratio of t toxic and c clean against the share of toxic documents."""
    part = lambda n, p: F.when(n > 0, n * F.log(n / ((t + c) * p))).otherwise(0.0)
    return part(t, share) + part(c, 1 - share)


def lexicon(weights: dict[str, float]) -> dict[str, float]:
    """Patterns without the stems that some longer pattern clearly beats: those are parts of innocent words too."""
    best: dict[str, float] = {}
    for p, w in weights.items():
        for k in range(4, len(p)):
            best[p[1:k]] = max(best.get(p[1:k], 0.0), w)
    return {p: w for p, w in weights.items() if p[0] == "w" or w >= best.get(p[1:], 0.0) - 0.5}


def _around(model: Model) -> Callable[[str], set[tuple[str, str]]]:
    """Words around attacks: 'n' close before one, 'r' farther before, 'a' soon after a threat; '*' for any such attack."""
    def found(text: str) -> set[tuple[str, str]]:
        out: set[tuple[str, str]] = set()
        for words, classes in model.hits(text):
            for i, kinds in enumerate(classes):
                if kinds[0][0] > THREAT:
                    continue
                places = [("n", words[max(0, i - REACH): i]), ("r", words[: max(0, i - REACH)])]
                if any(c == THREAT for c, _ in kinds):
                    places.append(("a", words[i + 1: i + 1 + GAP]))
                for role, near in places:
                    out.add((role + "*", ""))
                    out.update((role + w, "") for w in near)
        return out

    return found


def _learn_context(model: Model, sample: DataFrame) -> Model:
    """The other classes after the words around attacks: those the labels support come in, those they refute go."""
    counts = _tally(sample, _around(model)).groupBy("pattern").agg(F.sum("bad").alias("t"), F.sum("clean").alias("c"))
    counts = cut(pack(counts.withColumn("role", F.substring("pattern", 1, 1))))
    base = {r["role"]: (r["t"], r["c"]) for r in counts.where(F.substring("pattern", 2, 10) == "*").collect()}
    classes = {"n": set(model.negations), "r": set(model.reports), "a": set(model.targets)}
    chance = math.log(max(counts.count(), 2))
    for role, (bad, good) in base.items():
        share = (bad + 0.5) / (bad + good + 1)
        t, c = F.col("t"), F.col("c")
        own = counts.where((F.col("role") == role) & (t + c >= LEAST) & (F.substring("pattern", 2, 10) != "*"))
        odd = (t / (t + c) > share) if role == "a" else (t / (t + c) < SOFT * share)
        against = (t / (t + c) <= share / 2) if role == "a" else (t / (t + c) >= share / 2)
        seeds = [role + w for w in classes[role]]
        rows = own.withColumn("enters", odd & (_gain(t, c, share) >= chance)).withColumn("leaves", against & F.col("pattern").isin(seeds)).where("enters or leaves")
        for r in rows.select("pattern", "enters").collect():  # few: each has evidence beyond chance, or is a fixed word
            (classes[role].add if r["enters"] else classes[role].discard)(r["pattern"][1:])
    drop(counts)
    return replace(model, negations=frozenset(classes["n"]), reports=frozenset(classes["r"]), targets=frozenset(classes["a"]), _known={})


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learn from the labelled rows (``labels``: id, toxic), at most ``sample_rows`` of them in hash order.

    Cases: labels that are null or whose id is null or has no text teach nothing; of several
    labels of an id the larger counts; null and empty texts have no words; repeated rows of
    ``docs`` count each.  With labels of one kind only, or none (an empty table), the model gives
    that kind (or clean) to every text.  Other columns are ignored.
    """
    chosen = (labels.where("toxic is not null").select(F.col(id_col).cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic"))
              .where("id is not null").groupBy("id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("id"), "id").limit(sample_rows))
    # At most sample_rows rows of two numbers: small enough for a broadcast by its own bound.
    chosen = cut(chosen)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sample = cut(texts.join(F.broadcast(chosen), "id"))
    drop(chosen)
    size = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = size.get(1, 0), size.get(0, 0)
    if not bad or not good:
        return Model({}, {}, (-3.0 if good else 3.0 if bad else -3.0, 0.0, 0.0))
    counts = _tally(sample, _patterns).groupBy("pattern").agg(F.least(F.count("before"), 2 * F.sum("bad")).alias("toxic"), F.sum("clean").alias("clean"))
    counts = cut(pack(counts))
    share = bad / (bad + good)
    chance = math.log(max(counts.count(), 2))  # about one pattern enters by chance
    t, c = F.col("toxic"), F.col("clean")
    # Evidence beyond chance over all patterns: no more of them than the sample can support.
    strong = counts.where((t >= 3) & (t > 4 * c) & (_gain(t, c, share) >= chance)).collect()
    drop(counts)
    weight = {r["pattern"]: min(6.0, math.log((r["toxic"] + 0.5) / (r["clean"] + 0.5))) for r in strong}
    insults = lexicon({p: w for p, w in weight.items() if p[0] != "t"})
    model = Model({p[1:]: w for p, w in insults.items() if p[0] == "w"}, {p[1:]: w for p, w in insults.items() if p[0] == "s"})
    # Toxic with a target only: a threat.
    model.threats |= {p[1:]: w for p, w in weight.items() if p[0] == "t" and model.classify(p[1:])[0][0] != INSULT}
    model = _learn_context(model, sample)

    def features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [model.features(t.as_py() or "") for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in x], pa.float64()), pa.array([b for _, b in x], pa.float64()), batch.column("toxic")], names=["a", "b", "toxic"])

    rows = sample.mapInArrow(features, "a double, b double, toxic int").groupBy("a", "b", "toxic").count().collect()  # at most sample_rows
    drop(sample)
    model.weights = logistic(np.array([[1.0, r["a"], r["b"]] for r in rows]), np.array([float(r["toxic"]) for r in rows]), np.array([float(r["count"]) for r in rows]))
    return model


def logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 1.0) -> tuple[float, ...]:
    """Ridge logistic regression by Newton steps; n: how often each row counts."""
    w = np.zeros(x.shape[1])
    penalty = np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    order = np.lexsort((y, *x.T))  # sums in one order, whatever order the rows came in
    x, y, n = x[order], y[order], n[order]
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x.T * (n * p * (1 - p) + 1e-9)) @ x + penalty, x.T @ (n * (y - p)) - penalty @ w)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(v) for v in w)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, ``score`` (0 to 1) and ``predicted`` of every row, whole texts.

    Cases: null and empty texts have no clauses and get the score of that; repeated rows and
    null ids give a row each; an empty table gives no rows; long texts are read whole, clause by
    clause; other columns are ignored.
    """
    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(t.as_py() or "") for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(scores, pa.float64())], names=["id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(kernel, "id long, score double")
    return rows.select(F.col("id").alias(id_col), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def remove_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows whose score is under the threshold; columns as given.

    Cases: null and empty texts have no clauses and stay if the score of that is under the
    threshold; equal rows go or stay together; an empty table gives no rows.
    """
    names = docs.columns

    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index(text_col)
        for batch in batches:
            yield batch.filter(pa.array([model.score(t.as_py() or "") < threshold for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(kernel, docs.schema)
