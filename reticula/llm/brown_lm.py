"""Language-model scoring by Brown classes: class bigrams with exchange clustering.

    log10 p(text) = sum of log10 p(class | class before) + log10 p(word | class)

Every distinct training word belongs to one class.  Clustering starts from classes by word
ending and then exchanges: in each sweep every word moves to the class that best predicts
the classes it stood beside (left and right, counted over all training text).  Both the
classes beside and the class statistics are those the sweep before left - the batch form of
the exchange algorithm, which has no order of words and so runs in parallel.

Smoothing.  Word counts are discounted by D = n1 / (n1 + 2 n2); what a class loses is its
chance to emit an unknown word, so known words and "unknown" sum to one after any context.
Class transitions are mixed with the class distribution.

Data flow.  Texts are cut into chunks of bounded size.  A chunk numbers its own words and keeps
its texts as those numbers.  Words are dealt to parts by hash; the one message of a chunk to a
part holds all its words there, as a few compressed arrays.  A part knows its words' totals over
all chunks; it gets counts of neighbour classes from the chunks and sends classes back, once for
each sweep.  Words themselves travel only once.  The driver sees class matrices (classes
squared) only, summed by the executors.
"""

from __future__ import annotations

import math
import re
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import drop
from .common import cut

#: Classes (the last is that of the text's end), exchange sweeps, tokens of a chunk.
CLASSES, SWEEPS, CHUNK_TOKENS = 64, 3, 2_000_000
#: Weight of the class distribution in class transitions, in counts.
PRIOR = 5.0
#: Bytes of text that are split into words at once.
SLICE = 1_000_000
#: Neighbour counts that a part gathers before it adds them up, and words whose counts stand side by side.
GATHER, WORDS_AT_ONCE = 2_000_000, 10_000
END = " "  # no word has a space

#: Kinds of messages.  A chunk's texts sort behind the classes of its words, a part's rows before the counts.
PAIRS, CLASS, TEXTS, ROWS, COUNTS, STATS, SCORED = range(7)
_MESSAGE = pa.schema([("chunk", pa.int64()), ("part", pa.int32()), ("kind", pa.int32()), ("data", pa.binary())])
_MESSAGE_SQL = "chunk long, part int, kind int, data binary"


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed bytes; integers take as few bytes as their values need."""
    import zstandard

    head, body = [struct.pack("<B", len(arrays))], []
    for a in arrays:
        if a.dtype.kind in "iu" and len(a) and a.min() >= 0:
            a = a.astype(np.min_scalar_type(int(a.max())))
        head.append(struct.pack("<2sq", a.dtype.str[1:].encode(), len(a)))
        # Bytes of equal weight side by side: the high ones are mostly zero.
        body.append(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes())
    return b"".join(head) + zstandard.ZstdCompressor(level=1).compress(b"".join(body))


def _unpack(data: bytes) -> list[np.ndarray]:
    import zstandard

    at, out, start = 1, [], 0
    kinds = [struct.unpack_from("<2sq", data, 1 + 10 * k) for k in range(data[0])]
    at += 10 * len(kinds)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[at:]), np.uint8)
    for kind, n in kinds:
        dtype = np.dtype("<" + kind.decode())
        stop = start + n * dtype.itemsize
        a = np.ascontiguousarray(raw[start:stop].reshape(dtype.itemsize, n).T).view(dtype).ravel()
        out.append(a.astype(np.int64) if dtype == np.uint64 else a)
        start = stop
    return out


def _batch(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    chunk, part, kind, data = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(chunk, pa.int64()), pa.array(part, pa.int32()), pa.array(kind, pa.int32()), pa.array(data, pa.binary())], schema=_MESSAGE)


def _messages(rows: Iterable[tuple[int, int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    """Rows in batches of some megabytes."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[3]) + 32
        if size > 4_000_000:
            yield _batch(held)
            held, size = [], 0
    if held:
        yield _batch(held)


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, int, int, list[np.ndarray]]]:
    for batch in batches:
        chunk, part, kind, data = (batch.column(c) for c in ("chunk", "part", "kind", "data"))
        for i in range(batch.num_rows):
            yield chunk[i].as_py(), part[i].as_py(), kind[i].as_py(), _unpack(data[i].as_py())


def _slices(text: bytes) -> Iterator[list[bytes]]:
    """Words of a lower-cased text, a megabyte at a time."""
    at = 0
    while at < len(text):
        stop = len(text)
        if stop - at > SLICE:
            m = re.compile(rb"[\x20\x09-\x0D]").search(text, at + SLICE)
            stop = m.end() if m else stop
        yield text[at:stop].split()
        at = stop


def _ending(word: bytes, classes: int) -> int:
    import xxhash

    return xxhash.xxh32_intdigest(word[-2:]) % (classes - 1)


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


# ---- chunks --------------------------------------------------------------------------------

def _train_pairs(ids: np.ndarray, lengths: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the words before, and of the tokens, of training text; a text's entry begins with the word before it."""
    inner = np.repeat(train, lengths)
    inner[(np.cumsum(lengths) - lengths)[lengths > 0]] = False
    at = np.flatnonzero(inner)
    return ids[at - 1], ids[at]


def _neighbours(prev: np.ndarray, cur: np.ndarray, cls: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of neighbour classes (left, then right): how many has each word, which, how often."""
    width = 2 * classes
    kind = np.uint32 if len(cls) * width < 2**32 else np.uint64
    keys, counts = np.zeros(0, kind), np.zeros(0, np.int64)
    c = cls.astype(kind)
    for at in range(0, len(cur), 500_000):  # bounded temporary arrays
        p, w = prev[at: at + 500_000].astype(kind), cur[at: at + 500_000].astype(kind)
        new, n = np.unique(np.concatenate([w * kind(width) + c[p], p * kind(width) + kind(classes) + c[w]]), return_counts=True)
        keys, where = np.unique(np.concatenate([keys, new]), return_inverse=True)
        counts = np.bincount(where, weights=np.concatenate([counts, n])).astype(np.int64)
    return np.bincount((keys // kind(width)).astype(np.int64), minlength=len(cls)), (keys % kind(width)).astype(np.int64), counts


def _count(chunk: int, parts: np.ndarray, prev: np.ndarray, cur: np.ndarray, cls: np.ndarray, classes: int, extra=None) -> Iterator[tuple[int, int, int, bytes]]:
    """A chunk's messages for its words, which stand in order of ``parts``: neighbour classes by part; class pairs of the chunk."""
    pairs = np.zeros(classes * classes, np.int64)
    for at in range(0, len(cur), 500_000):
        pairs += np.bincount(cls[prev[at: at + 500_000]].astype(np.int64) * classes + cls[cur[at: at + 500_000]], minlength=classes * classes)
    yield chunk, -1, PAIRS, _pack(pairs)
    many, ctx, counts = _neighbours(prev, cur, cls, classes)
    starts = np.concatenate([[0], np.cumsum(many)])
    edges = np.flatnonzero(np.concatenate([[True], parts[1:] != parts[:-1], [True]]))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        own = slice(starts[a], starts[b])
        yield chunk, int(parts[a]), COUNTS, _pack(*(extra(a, b) if extra else ()), many[a:b], ctx[own], counts[own])


def _chunk_kernel(classes: int, chunk_tokens: int, n_parts: int):
    """Texts (doc, held, text) -> a chunk's texts as numbers, and its words with their counts, by part."""
    def flush(chunk: int, numbers: _Numbers, entries: list) -> Iterator[tuple[int, int, int, bytes]]:
        import xxhash

        words = list(numbers)
        part = np.fromiter((xxhash.xxh32_intdigest(w) % n_parts for w in words), np.int64, len(words))
        order = np.argsort(part, kind="stable")
        rank = np.empty(len(words), np.int32)
        rank[order] = np.arange(len(words), dtype=np.int32)
        cls = np.fromiter((_ending(w, classes) for w in words), np.int64, len(words))
        cls[0] = classes - 1
        table = [np.array(x, np.int64) for x in zip(*((e[0], e[1] or 0, e[1] is None, e[2], len(e[3])) for e in entries), strict=True)]
        ids = np.concatenate([e[3] for e in entries])
        # Numbers by first occurrence: common words have small ones.
        yield chunk, -1, TEXTS, _pack(order, ids, table[0] - (chunk >> 32 << 40), *table[1:])
        prev, cur = _train_pairs(ids, table[4], table[3] == 0)
        seen = np.bincount(cur, minlength=len(words))[order]
        listed = lambda a, b: (np.frombuffer(b"\n".join(words[i] for i in order[a:b]), np.uint8), seen[a:b])
        yield from _count(chunk, part[order], rank[prev], rank[cur], cls[order], classes, listed)

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, int, int, bytes]]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        chunk, uid = task << 32, task << 40
        numbers, entries, tokens = _Numbers({END.encode(): 0}), [], 0
        for batch in batches:
            for doc, held, text in zip(batch.column("doc").to_pylist(), batch.column("held").to_pylist(), batch.column("text"), strict=True):
                before = np.zeros(1, dtype=np.int32)
                parts = _slices((text.as_py() or "").encode("utf-8").lower())
                words: list[bytes] | None = next(parts, [])
                while words is not None:
                    following = next(parts, None)
                    ids = np.fromiter(map(numbers.__getitem__, words), np.int32, len(words))
                    entry = np.concatenate([before, ids, *([np.zeros(1, np.int32)] if following is None else [])])
                    entries.append((uid, doc, held, entry))
                    tokens += len(entry)
                    if tokens >= chunk_tokens:
                        last = words[-1] if words else None
                        yield from flush(chunk, numbers, entries)
                        chunk, numbers, entries, tokens = chunk + 1, _Numbers({END.encode(): 0}), [], 0
                        # The word before the next part of this text, in the numbers of the new chunk.
                        before = np.array([numbers[last] if last else 0], dtype=np.int32)
                    else:
                        before = entry[-1:]
                    words = following
                uid += 1
        if entries:
            yield from flush(chunk, numbers, entries)

    return lambda batches: _messages(rows(batches))


def _of_chunk(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """Classes of a chunk's words, then its texts -> (chunk, parts, arrays by word of each message, order, texts)."""
    parts, held = [], []
    for chunk, part, kind, data in _rows(batches):
        if kind == CLASS:
            parts.append(np.full(len(data[0]), part))
            held.append(data)
        else:
            yield chunk, np.concatenate(parts), [np.concatenate(x) for x in zip(*held, strict=True)], data[0], data[1:]
            parts, held = [], []


def _recount_kernel(classes: int):
    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, int, int, bytes]]:
        for chunk, parts, (cls,), order, (ids, _, _, _, held, lengths) in _of_chunk(batches):
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(len(order), dtype=np.int32)
            prev, cur = _train_pairs(ids, lengths, held == 0)
            yield from _count(chunk, parts, rank[prev], rank[cur], cls.astype(np.int64), classes)

    return lambda batches: _messages(rows(batches))


# ---- words ---------------------------------------------------------------------------------

class _Part:
    """One part of the vocabulary: its words' counts, and neighbour classes as (word * width + class, count), added up now and then."""

    def __init__(self, width: int):
        self.width, self.keys, self.sums, self.new, self.size = width, np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0
        self.rows: dict[int, np.ndarray] = {}  # of each chunk's words, in order
        self.n, self.end = np.zeros(0, np.int64), -1

    def add(self, row: np.ndarray, many: np.ndarray, ctx: np.ndarray, counts: np.ndarray) -> None:
        self.new.append((np.repeat(row, many) * self.width + ctx, counts))
        self.size += len(ctx)
        if self.size > GATHER:
            self.settle()

    def settle(self) -> None:
        keys, counts = (np.concatenate([old, *x]) for old, x in zip((self.keys, self.sums), zip(*self.new, strict=True), strict=True)) if self.new else (self.keys, self.sums)
        self.keys, where = np.unique(keys, return_inverse=True)
        self.sums = np.bincount(where, weights=counts, minlength=len(self.keys)).astype(np.int64)
        self.new, self.size = [], 0

    def classes(self, logs: np.ndarray) -> np.ndarray:
        """The best class of each word; that of words without training text: one behind all."""
        self.settle()
        k = len(logs) + 1
        cls = np.full(len(self.n), k)
        for a in range(0, len(self.n), WORDS_AT_ONCE):
            b = min(a + WORDS_AT_ONCE, len(self.n))
            i, j = np.searchsorted(self.keys, [a * self.width, b * self.width])
            dense = np.bincount(self.keys[i:j] - a * self.width, weights=self.sums[i:j], minlength=(b - a) * self.width).reshape(b - a, -1)
            # Rounded: equal scores stay equal whatever the order of the sums.
            cls[a:b] = np.round(dense @ logs.T, 6).argmax(axis=1)
        if self.end >= 0:
            cls[self.end] = k - 1
        return np.where(self.n > 0, cls, k)


def _word_kernel(classes: int, logs: np.ndarray | None, last: bool):
    """A part's words (first sweep), or its rows and counts -> the classes of every chunk's words there.

    ``logs`` None: words stay in the classes of their endings.  The last sweep also sends the words' counts, and sums by class.
    """
    def close(part: int, p: _Part, endings: list[int] | None) -> Iterator[tuple[int, int, int, bytes]]:
        if logs is None:
            cls = np.where(p.n > 0, endings, classes)
        else:
            cls = p.classes(logs)
        if endings is not None and not last:
            yield -1, part, ROWS, _pack(p.n, np.array([p.end + 1]))
        for chunk, row in p.rows.items():
            if endings is not None and not last:
                yield chunk, part, ROWS, _pack(row)
            yield chunk, part, CLASS, _pack(cls[row], p.n[row]) if last else _pack(cls[row])
        if last:
            known = p.n > 0
            by = lambda w=None: np.bincount(cls[known], weights=w, minlength=classes).astype(np.int64)
            yield -1, part, STATS, _pack(np.concatenate([by(p.n[known]), by(), [(p.n == 1).sum(), (p.n == 2).sum()]]))

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, int, int, bytes]]:
        now, p, numbers, endings = None, None, None, None
        for chunk, part, kind, data in _rows(batches):
            if part != now:
                if p is not None:
                    yield from close(now, p, endings)
                now, p, numbers, endings = part, _Part(2 * classes), None, None
            if kind == ROWS and chunk < 0:
                p.n, p.end = data[0].astype(np.int64), int(data[1][0]) - 1
            elif kind == ROWS:
                p.rows[chunk] = data[0].astype(np.int64)
            elif len(data) == 5:
                if numbers is None:
                    numbers, endings = _Numbers(), []
                words = data[0].tobytes().split(b"\n")
                row = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
                for w in list(numbers)[len(endings):]:
                    endings.append(classes - 1 if w == END.encode() else _ending(w, classes))
                    if w == END.encode():
                        p.end = len(endings) - 1
                p.n = np.concatenate([p.n, np.zeros(len(endings) - len(p.n), np.int64)])
                p.n[row] += data[1]  # no word twice
                p.rows[chunk] = row
                p.add(row, *data[2:])
            else:
                p.add(p.rows[chunk], *data)
        if p is not None:
            yield from close(now, p, endings)

    return lambda batches: _messages(rows(batches))


# ---- rounds --------------------------------------------------------------------------------

def _total(messages: DataFrame, size: int) -> np.ndarray:
    """Sum of the arrays of all messages, added up by the executors; the driver gets ``size`` numbers."""
    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for *_, data in _rows(batches):
            total += data[0].astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["i", "n"])

    out = np.zeros(size)
    for r in messages.mapInArrow(kernel, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect():
        out[r["i"]] = r["n"]
    return out


def _parts(spark) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _to_chunks(chunks: DataFrame, found: DataFrame) -> DataFrame:
    """The classes of its words, by part, and its texts, for every chunk."""
    both = found.where(F.col("kind") == CLASS).union(chunks.where(F.col("kind") == TEXTS).select(*found.columns))
    return both.repartition(_parts(both.sparkSession), "chunk").sortWithinPartitions("chunk", "kind", "part")


def chunked(source: DataFrame, classes: int, chunk_tokens: int) -> DataFrame:
    """``source`` (doc, held, text) -> messages of its chunks."""
    return cut(source.mapInArrow(_chunk_kernel(classes, chunk_tokens, _parts(source.sparkSession)), _MESSAGE_SQL), by="kind")


def cluster(chunks: DataFrame, classes: int, sweeps: int) -> DataFrame:
    """Exchange sweeps, each over the classes of the one before -> messages with class and count of every chunk's words, and sums by class."""
    n, counted, rows = _parts(chunks.sparkSession), chunks, None
    for sweep in range(max(sweeps, 1)):
        last, logs = sweep >= sweeps - 1, None
        if sweeps:
            right = _total(counted.where(F.col("kind") == PAIRS), classes * classes).reshape(classes, classes) + 0.1
            left = right.T
            logs = np.hstack([np.log(left / left.sum(axis=1, keepdims=True)), np.log(right / right.sum(axis=1, keepdims=True))])[:-1]
        messages = counted.where(F.col("kind") == COUNTS)
        if rows is not None:
            messages = messages.union(rows.where(F.col("kind") == ROWS))
        # Parts are as many as partitions, and even by the hash of their words.
        dealt = messages.repartitionById(n, F.col("part")).sortWithinPartitions("part", "chunk", "kind")
        found = cut(dealt.mapInArrow(_word_kernel(classes, logs, last), _MESSAGE_SQL), by="kind")
        if counted is not chunks:
            drop(counted)
        if last:
            break
        counted = cut(_to_chunks(chunks, found).mapInArrow(_recount_kernel(classes), _MESSAGE_SQL), by="kind")
        if rows is None:
            rows = found
        else:
            drop(found)
    if rows is not None:
        drop(rows)
    return found


def _score_kernel(classes: int, discount: float, class_n: list[float]):
    """A chunk's texts with all but the class transitions, and their classes; class pairs of training text."""
    size = np.array([*class_n, 1.0])

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, int, int, bytes]]:
        for chunk, _, (cls, n), order, (ids, uid, doc, none, held, lengths) in _of_chunk(batches):
            count, of = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
            count[order], of[order] = n, cls
            known = count > 0
            emitted = np.where(known, np.log10(np.maximum(count - discount, 1e-12) / np.maximum(size[of], 1.0)), 0.0)
            starts = np.cumsum(lengths.astype(np.int64)) - lengths

            def sums(by_word: np.ndarray) -> np.ndarray:  # over the tokens of each entry: all but the word before
                values = by_word[ids]
                values[starts] = 0
                return np.add.reduceat(values, starts)

            prev, cur = _train_pairs(ids, lengths, held == 0)
            yield chunk, -1, PAIRS, _pack(np.bincount(of[prev] * classes + of[cur], minlength=classes * classes))
            yield chunk, -1, SCORED, _pack(uid.astype(np.int64) + (chunk >> 32 << 40), doc, none, held, lengths, sums(known.astype(np.int64)), sums(np.log10(count + 1.0)), sums(emitted), of[ids])

    return lambda batches: _messages(rows(batches))


def transitions(seen: np.ndarray, class_n: np.ndarray, class_words: np.ndarray, discount: float) -> np.ndarray:
    """log10 of the chance of each class (the last: an unknown word) after each class, from counts of class pairs."""
    classes = len(class_n)
    side = classes + 1
    total = class_n.sum()
    if total == 0:  # nothing learned: every word is unknown
        return np.zeros((side, side))
    share = class_n / total
    p = (seen + PRIOR * share) / (seen.sum(axis=1, keepdims=True) + PRIOR)
    lost = np.divide(discount * class_words, class_n, out=np.zeros(classes), where=class_n > 0)
    unknown = discount * class_words
    origin = unknown / unknown.sum()  # classes of unknown words, by what each lost
    out = np.empty((side, side))
    out[:classes, :classes], out[:classes, classes] = p, p @ lost
    out[classes] = origin @ out[:classes]
    return np.log10(np.maximum(out, 1e-300))


def _final_kernel(table: np.ndarray):
    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for *_, (uid, doc, none, held, lengths, known, base, emitted, seq) in _rows(batches):
            starts = np.cumsum(lengths.astype(np.int64)) - lengths
            moved = np.concatenate([[0.0], table[seq[:-1], seq[1:]]])
            moved[starts] = 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(uid, pa.int64()), pa.array(doc.astype(np.int64), mask=none.astype(bool)), pa.array(held.astype(bool)), pa.array(lengths.astype(np.int64) - 1),
                 pa.array(known.astype(np.int64)), pa.array(base), pa.array(np.add.reduceat(moved, starts) + emitted)], names=["uid", "doc", "held", "tokens", "known", "base", "score"])

    return kernel


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", classes: int = CLASSES,
          sweeps: int = SWEEPS, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """Score every whole text with a model of the texts that are not held out.

    Returns the id, ``held_out``, ``n_tokens`` and ``n_known`` (words and one end), ``train_tokens``,
    ``base_score`` (add-one unigrams) and ``score`` (the class model), both log10.

    Cases: null and empty texts have one token, their end; a text of any length is read in slices.
    An empty table gives no rows.  A null ``held_out`` counts as
    false.  Repeated rows and null ids give a row each.  Without training texts every token
    is unknown and both scores are 0.  Other columns are ignored.
    """
    if classes < 2 or classes > 1000:
        raise ValueError("classes must be 2 to 1000")
    source = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(held_out, F.lit(False)).alias("held"), F.col(text_col).cast("string").alias("text"))
    chunks = chunked(source, classes, chunk_tokens)
    found = cluster(chunks, classes, sweeps)
    stats = _total(found.where(F.col("kind") == STATS), 2 * classes + 2)
    class_n, class_words, (n1, n2) = stats[:classes], stats[classes:-2], stats[-2:]
    discount = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    total, distinct = int(class_n.sum()), int(class_words.sum())
    facts = cut(_to_chunks(chunks, found).mapInArrow(_score_kernel(classes, discount, class_n.tolist()), _MESSAGE_SQL), by="kind")
    drop(chunks, found)
    seen = _total(facts.where(F.col("kind") == PAIRS), classes * classes).reshape(classes, classes)
    table = transitions(seen, class_n, class_words, discount)
    scored = facts.where(F.col("kind") == SCORED).mapInArrow(_final_kernel(table), "uid long, doc long, held boolean, tokens long, known long, base double, score double")
    # A text in several parts has a row for each.
    sums = scored.groupBy("uid").agg(F.first("doc").alias("doc"), F.first("held").alias("held"), F.sum("tokens").alias("tokens"), F.sum("known").alias("known"), F.sum("base").alias("base"), F.sum("score").alias("score"))
    return sums.select(F.col("doc").alias(id_col), F.col("held").alias("held_out"), F.col("tokens").alias("n_tokens"), F.col("known").alias("n_known"),
                       F.lit(total).cast("long").alias("train_tokens"), (F.col("base") - F.col("tokens") * F.lit(math.log10(total + distinct + 1))).alias("base_score"), "score")
