"""Best-fit packing by patterns: non-negative least squares over a histogram of piece lengths.

Documents become token pieces of at most ``capacity`` tokens. Only the histogram of their lengths reaches the driver,
which has at most ``capacity`` entries whatever the corpus. Patterns are sets of few lengths that fill a sequence; their
repeat counts are fitted to the histogram by non-negative least squares, rounded down, and what is left over is packed
best-fit on the histogram itself: many equal pieces go into many equal gaps in one step. The result is a table of
(pattern, repeats); every piece finds its sequence and offset from its length and its rank among pieces of that length.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlab.llm.common import map_rows
from barlab.session import checkpoint

CAPACITY = 2048
END_ID = 0
#: Lengths are fitted in this many equal classes; patterns hold up to PARTS pieces.
CLASSES, PARTS = 128, 3
#: Rows of one length that are ranked together.
RANK_ROWS = 20_000
#: A worker keeps the ids of the words it saw last, in two generations of at most this many.
CACHE_WORDS = 300_000
Pattern = tuple[int, ...]

# ---- tokens ----

# Letters, numbers and white space below U+0250 as the tokenizer's own split pattern sees them, lower case.
_LETTER, _NUMBER, _BLANK = "a-zªµºß-öø-ɏ", "0-9²³¹¼-¾", "\\t-\\r \\x85\\xa0"
_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_BLANK}{_LETTER}{_NUMBER}]+")
#: Texts with other characters (or capitals that lower-case to two or to another one) go through the tokenizer whole.
_OTHER = re.compile("[^\\x00-\\u024f]|[İȺȾ]|<\\|(?:start|end)oftext\\|>")
#: White space to ``str.split`` only.
_CONTROLS = "\x1c\x1d\x1e\x1f"


def whole(text: str) -> bool:
    """True for texts that only the tokenizer itself splits rightly."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return _OTHER.search(text) is not None
    return "<|" in text and _OTHER.search(text) is not None


class Encoder:
    """Ids of whole texts. The vocabulary has word ends, so a word's ids depend on that word alone and can be kept."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def plain(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn_pieces(self, pieces: list[str]) -> None:
        """Encodes new pieces in one call and splits the ids where words end."""
        for k in range(0, len(pieces), 2000):
            part = pieces[k : k + 2000]
            ids = np.asarray(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, "<u4")
            cuts = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(cuts) == len(part):
                raw = ids.tobytes()
                self.known.update(zip(part, [raw[i:j] for i, j in zip([0, *cuts], cuts)], strict=True))
            else:
                self.known.update((w, self.plain(w)) for w in part)

    def learn(self, words: set[str]) -> None:
        """Takes new words from the generation before, or makes their ids out of those of their pieces."""
        before, known = self.before, self.known
        known.update([(w, before[w]) for w in words if w in before])
        split = {w: _PIECE.findall(w) for w in words.difference(known)}
        self.learn_pieces(list({x for pieces in split.values() for x in pieces}.difference(known)))
        known.update((w, b"".join([known[x] for x in pieces])) for w, pieces in split.items() if len(pieces) > 1)

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids."""
        if whole(text):
            return self.plain(text)
        text = text.lower()
        # no piece crosses white space, so most words are looked up without being taken apart
        words = _PIECE.findall(text) if any(c in text for c in _CONTROLS) else text.split()
        new = set(words).difference(self.known)
        if new:
            if len(new) > CACHE_WORDS // 4:
                return self.plain(text)
            if len(self.known) + len(new) > CACHE_WORDS:
                self.known, self.before = {}, self.known
                new = set(words)
            self.learn(new)
        return b"".join(map(self.known.__getitem__, words))


_ENCODERS: dict[str, Encoder] = {}


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): the ids of every text and a closing 0, cut every ``capacity`` ids."""

    def run(batches):
        encoder = _ENCODERS.setdefault(tokenizer_path, None) or Encoder(tokenizer_path)
        _ENCODERS[tokenizer_path] = encoder
        tail = END_ID.to_bytes(4, "little")
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
            for doc_id, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True):
                ids = memoryview(encoder.encode(text or "") + tail)
                for k in range(0, len(ids), 4 * capacity):
                    part = ids[k : k + 4 * capacity]
                    for name, v in zip(out, (doc_id, k // (4 * capacity), k // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        out[name].append(v)
            yield out

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, piece int, start long, length int, ids_crc32 long")


# ---- patterns: all work below is on the histogram ----


def nnls(a: np.ndarray, b: np.ndarray, sweeps: int = 400) -> np.ndarray:
    """Non-negative least squares by cyclic coordinate descent on the normal equations; stops when a sweep moves nothing."""
    gram, target = a.T @ a, a.T @ b
    diagonal = np.maximum(np.diag(gram), 1e-12)
    x = np.zeros(a.shape[1])
    slope = -target
    for _ in range(sweeps):
        moved = 0.0
        for j in np.argsort(slope / diagonal, kind="stable"):
            step = max(-x[j], -slope[j] / diagonal[j])
            if step:
                x[j] += step
                slope += step * gram[:, j]
                moved = max(moved, abs(step))
        if moved < 1e-3 * max(1.0, x.max()):
            break
    return x


def class_patterns(classes: int, parts: int) -> list[Pattern]:
    """Multisets of two to ``parts`` class numbers (1..classes) that add up to ``classes``, larger ones first."""
    out: list[Pattern] = []

    def grow(prefix: Pattern, left: int, most: int) -> None:
        if not left:
            if len(prefix) > 1:
                out.append(prefix)
            return
        if len(prefix) == parts:
            return
        for c in range(min(left, most), 0, -1):
            if c * (parts - len(prefix)) < left:
                break
            grow((*prefix, c), left - c, c)

    grow((), classes, classes)
    return out


def pattern_counts(histogram: Counter[int], capacity: int) -> Counter[Pattern]:
    """Repeats of length patterns by NNLS. Takes what it uses out of ``histogram``.

    Lengths are put into classes by rounding up, so a class pattern always fits. The fit weighs a class by its length:
    long pieces left over cost a sequence each, short ones fill gaps. A class pattern is turned into length patterns that
    fill a sequence exactly; repeats for which the histogram holds no such lengths are left to best fit.
    """
    width = -(-capacity // min(CLASSES, capacity))
    classes = capacity // width
    have: dict[int, list[int]] = {}
    for length in sorted(histogram):
        have.setdefault(min(classes, -(-length // width)), []).append(length)
    patterns = [p for p in class_patterns(classes, PARTS) if all(c in have for c in p)]
    out: Counter[Pattern] = Counter()
    if not patterns:
        return out
    rows = {c: k for k, c in enumerate(have)}
    a, weight = np.zeros((len(have), len(patterns))), np.array([c / classes for c in have])
    for j, p in enumerate(patterns):
        for c in p:
            a[rows[c], j] += 1
    b = np.array([float(sum(histogram[x] for x in ls)) for ls in have.values()])
    x = nnls(a * weight[:, None], b * weight)
    for j in np.argsort(-x, kind="stable"):
        left = int(x[j])
        while left > 0 and (chosen := exact_fill(patterns[j], have, histogram, capacity)):
            used = Counter(chosen)
            times = min(left, *(histogram[v] // m for v, m in used.items()))
            out[chosen] += times
            left -= times
            for v, m in used.items():
                histogram[v] -= m * times
    return out


def exact_fill(pattern: Pattern, have: dict[int, list[int]], histogram: Counter[int], capacity: int) -> Pattern:
    """Lengths for a class pattern that fill a sequence to the last token, or nothing.

    All but two are the longest that their classes hold. The next is tried from the longest on until the rest of the
    sequence is itself a length that is left.
    """
    room, head, used = capacity, (), Counter()
    for c in pattern[:-2]:
        v = next((v for v in reversed(have[c]) if histogram[v] > used[v]), 0)
        if not v:
            return ()
        head, room = (*head, v), room - v
        used[v] += 1
    for v in reversed(have[pattern[-2]]):
        rest = room - v
        if rest > 0 and histogram[v] > used[v] and histogram[rest] > used[rest] + (rest == v):
            return (*head, v, rest)
    return ()


def fill(histogram: Counter[int], started: Counter[Pattern], capacity: int) -> Counter[Pattern]:
    """Best fit on counts: the longest pieces left go into the fullest sequences that still take them."""
    gaps: dict[int, Counter[Pattern]] = {}
    for p, n in started.items():
        gaps.setdefault(capacity - sum(p), Counter())[p] += n
    rooms = sorted(g for g in gaps)
    for length in sorted((v for v, n in histogram.items() if n > 0), reverse=True):
        left = histogram[length]
        while left:
            k = bisect_left(rooms, length)
            if k == len(rooms):
                each = capacity // length
                for size, n in ((each, left // each), (left % each, 1)):
                    if size and n:
                        room = capacity - size * length
                        if room not in gaps:
                            insort(rooms, room)
                        gaps.setdefault(room, Counter())[(length,) * size] += n
                break
            room = rooms[k]
            pattern, n = next(iter(gaps[room].items()))
            fit = min(room // length, left)
            times = min(n, left // fit)
            gaps[room][pattern] -= times
            if not gaps[room][pattern]:
                del gaps[room][pattern]
                if not gaps[room]:
                    del gaps[room], rooms[k]
            rest = room - fit * length
            if rest not in gaps:
                insort(rooms, rest)
            gaps.setdefault(rest, Counter())[pattern + (length,) * fit] += times
            left -= fit * times
    out: Counter[Pattern] = Counter()
    for group in gaps.values():
        out.update(group)
    return out


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[Pattern, int]]:
    """(pattern, repeats) that use every piece of the histogram exactly once."""
    left = Counter({k: v for k, v in histogram.items() if v})
    full = Counter({(capacity,): left.pop(capacity)}) if capacity in left else Counter()
    started = pattern_counts(left, capacity)
    packed = fill(left, started, capacity)
    packed.update(full)
    return sorted(packed.items())


def slots(packed: list[tuple[Pattern, int]]) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, first sequence, repeats, copies in the pattern, offset of the first copy)."""
    out: dict[int, list[tuple[int, int, int, int, int]]] = {}
    ranks: Counter[int] = Counter()
    sequence = 0
    for pattern, times in packed:
        offset = 0
        for length, copies in sorted(Counter(pattern).items(), reverse=True):
            out.setdefault(length, []).append((ranks[length], sequence, times, copies, offset))
            ranks[length] += times * copies
            offset += copies * length
        sequence += times
    return {k: np.array(v, np.int64) for k, v in out.items()}


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (doc_id, piece, start, length, ids_crc32) with sequence_id and offset.

    Ranks within a length are counted in buckets of about RANK_ROWS rows and shifted by the buckets before them, so that a
    length with a third of all rows is spread over many tasks. Pieces equal in every column are interchangeable.
    """
    spark = pieces.sparkSession
    pieces = checkpoint(pieces)
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if not histogram:
        return pieces.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    table = spark.sparkContext.broadcast(slots(plan(histogram, capacity)))
    buckets = F.lit([max(1, -(-histogram.get(k, 0) // RANK_ROWS)) for k in range(capacity + 1)])[F.col("length")]
    keys = ["doc_id", "piece", "start", "ids_crc32"]
    salt = F.pmod(F.xxhash64(*keys, F.spark_partition_id()), buckets).cast("int")
    numbered = pieces.withColumn("_bucket", salt)
    numbered = checkpoint(numbered)
    sizes = numbered.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    ranked = numbered.join(sizes, ["length", "_bucket"]).withColumn("_rank", F.col("_first") + F.row_number().over(Window.partitionBy("length", "_bucket").orderBy(*keys)) - 1)

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        lengths, ranks = length.to_numpy(), rank.to_numpy(np.int64)
        seq, off = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for v in np.unique(lengths):
            own = np.flatnonzero(lengths == v)
            rows = table.value[int(v)]
            row = rows[np.searchsorted(rows[:, 0], ranks[own], side="right") - 1]
            inside = ranks[own] - row[:, 0]
            seq[own], off[own] = row[:, 1] + inside // row[:, 3], row[:, 4] + inside % row[:, 3] * v
        return pd.DataFrame({"sequence_id": seq, "offset": off})

    placed = ranked.withColumn("_at", place("length", "_rank"))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "_at.sequence_id", "_at.offset")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents in sequences of at most ``capacity`` tokens.

    Every row of ``docs`` gives one piece or more, repeated rows pieces of their own. Null and empty texts are the closing
    id alone. Only doc_id and text are read, so extra columns never clash. An empty table gives an empty table. Very long
    texts are cut into full pieces and a last one.
    """
    return pack(token_pieces(docs, tokenizer_path, capacity), capacity)
