"""BPE encoding and decoding with a given vocabulary file.

A pre-token becomes a doubly linked list of symbols.  A priority queue holds the
merges that are possible, by (rank, position); entries whose symbols have changed
since are stale and skipped.  Decoding puts the vocabulary strings together.  Reads a
``tokenizers`` JSON file of type BPE whose normaliser, splitting and added tokens are
those handled in ``Tokenizer``; it is never trained here.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: From this code point on the classes of characters differ between Unicode versions;
#: texts with such characters are normalised and split by the library itself.
FAR = 0x0530
#: Pre-tokens whose encoding a worker keeps: two generations of this many.
CACHE = 100_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    stands = {b: chr(b) for b in printable} | {b: chr(next(spare)) for b in range(256) if b not in printable}
    return [stands[b] for b in range(256)]


class Tokenizer:
    """Encoder and decoder for one vocabulary file."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = dict(model["vocab"])
        self.end = model.get("end_of_word_suffix") or ""
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.added.items()}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault((self.vocab[a], self.vocab[b]), (rank, self.vocab[a + b]))
        steps = spec["normalizer"]["normalizers"] if spec["normalizer"] else []
        known = [("NFC",), ("Replace", "\\s+", " "), ("Lowercase",)]
        got = [(s["type"], s["pattern"]["Regex"], s["content"]) if s["type"] == "Replace" else (s["type"],) for s in steps]
        if got != known:
            raise ValueError(f"unknown normaliser {got}")
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        if (split["type"], split["behavior"], split["invert"]) != ("Split", "Removed", True):
            raise ValueError("unknown pre-tokeniser")
        # White space of the pattern language of the file: the Unicode property.
        space = r"\p{White_Space}"
        self.space = regex.compile(f"{space}+")
        self.split = regex.compile(split["pattern"]["Regex"].replace(r"[^\s", f"[^{space}").replace(r"\s", space), regex.V0)
        self.path, self.library, self.far = path, None, regex.compile(f"[{chr(FAR)}-{chr(0x10FFFF)}]")
        self.bytes = {c: b for b, c in enumerate(byte_symbols())}
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.first = [self.vocab.get(c) for c in byte_symbols()]
        self.last = [self.vocab.get(c + self.end) for c in byte_symbols()]
        self.young: dict[str, tuple[int, str, str]] = {}
        self.old: dict[str, tuple[int, str, str]] = {}

    def normalise(self, text: str) -> str:
        text = self.space.sub(" ", unicodedata.normalize("NFC", text))
        # Character by character: a capital sigma never becomes a final one.
        return text.replace("Σ", "σ").lower()

    def tokens(self, stretch: str) -> list[str]:
        """Pre-tokens of a stretch without added tokens."""
        if not self.far.search(stretch):
            return self.split.findall(self.normalise(stretch))
        if self.library is None:
            from tokenizers import Tokenizer as Library

            self.library = Library.from_file(self.path)
        pieces = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(stretch))
        return [bytes(self.bytes[c] for c in symbols).decode("utf-8") for symbols, _ in pieces]

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        symbols = [self.first[b] for b in piece[:-1]] + [self.last[piece[-1]]]
        symbols = [s for s in symbols if s is not None]
        n, merges = len(symbols), self.merges
        if n < 2:
            return symbols
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = []
        for i in range(n - 1):
            found = merges.get((symbols[i], symbols[i + 1]))
            if found:
                queue.append((found[0], i, found[1], symbols[i], symbols[i + 1]))
        heapq.heapify(queue)
        pop, push = heapq.heappop, heapq.heappush
        while queue:
            _, i, new, left, right = pop(queue)
            j = after[i]
            if symbols[i] != left or j >= n or symbols[j] != right:
                continue  # stale
            symbols[i], symbols[j] = new, -1
            k = after[j]
            after[i] = k
            if k < n:
                before[k] = i
                found = merges.get((new, symbols[k]))
                if found:
                    push(queue, (found[0], i, found[1], new, symbols[k]))
            h = before[i]
            if h >= 0:
                found = merges.get((symbols[h], new))
                if found:
                    push(queue, (found[0], h, found[1], symbols[h], new))
        return [s for s in symbols if s >= 0]

    def piece(self, token: str) -> tuple[int, str, str]:
        """(number of ids, ids joined by spaces, vocabulary strings joined by spaces), from the cache if possible."""
        found = self.old.get(token)
        if found is None:
            ids = self.merge(token.encode("utf-8"))
            found = (len(ids), " ".join(map(str, ids)), " ".join(self.strings[i] for i in ids))
        if len(token) < 64:
            if len(self.young) >= CACHE:
                self.old, self.young = self.young, {}
            self.young[token] = found
        return found

    def parts(self, text: str) -> Iterator[tuple[int, str, str]]:
        """The pieces of a text in order, added tokens included."""
        at = 0
        for m in [*(self.special.finditer(text) if self.special else ()), None]:
            stretch = text[at: m.start() if m else len(text)]
            if stretch:
                young, piece = self.young, self.piece
                for token in self.tokens(stretch):
                    found = young.get(token)
                    if found is None:
                        found = piece(token)
                        young = self.young
                    if found[0]:
                        yield found
            if m:
                yield 1, str(self.added[m[0]]), m[0]
                at = m.end()

    def encode(self, text: str) -> list[int]:
        return [int(i) for _, ids, _ in self.parts(text) for i in ids.split(" ")]

    def decode(self, ids: Iterable[int]) -> str:
        """Vocabulary strings with one space between them (the file names no decoder)."""
        return " ".join(self.strings[i] for i in ids if i in self.strings)


_LOADED: dict[str, Tokenizer] = {}


def load(path: str) -> Tokenizer:
    """One tokenizer for each worker and file."""
    if path not in _LOADED:
        _LOADED[path] = Tokenizer(path)
    return _LOADED[path]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """Encode every whole text and decode the ids.

    Returns the id column, ``n_tokens``, and ``ids`` (array) with ``decoded``, or with
    ``digest`` their SHA-256: of the decimal ids joined by one space, and of the decoded
    text in UTF-8.  ``path`` is the vocabulary file, present on every machine.

    Cases: null text counts as empty: no ids, empty decoded text.  Strings of added
    tokens in a text become those tokens.  Repeated rows and null ids give a row each;
    other columns are ignored.
    """
    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(path)
        sha = hashlib.sha256
        for batch in batches:
            counts, ids_out, decoded_out = [], [], []
            for scalar in batch.column("text"):
                text = scalar.as_py()
                parts = list(tokenizer.parts(text)) if text else []
                counts.append(sum(p[0] for p in parts))
                ids, decoded = " ".join([p[1] for p in parts]), " ".join([p[2] for p in parts])
                if digest:
                    ids_out.append(sha(ids.encode()).hexdigest())
                    decoded_out.append(sha(decoded.encode()).hexdigest())
                else:
                    ids_out.append([int(i) for i in ids.split()])
                    decoded_out.append(decoded)
            kind = pa.string() if digest else pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(counts, pa.int64()), pa.array(ids_out, kind), pa.array(decoded_out, pa.string())],
                names=["id", "n", "ids", "decoded"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = source.mapInArrow(kernel, f"id long, n long, ids {'string' if digest else 'array<int>'}, decoded string")
    names = ("ids_sha256", "decoded_sha256") if digest else ("ids", "decoded")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_tokens"), F.col("ids").alias(names[0]), F.col("decoded").alias(names[1]))
