"""Periodic runs of words: stretches that repeat with a fixed period, found by dyadic square catchers.

Words are appended to a stream. On each level L = 1, 2, 4, ... every completed block of L words at a
multiple of L is a catcher: it waits for its own words to come again between 2L and 4L words later.
An appended word completes one window per level, and only two catchers of a level have that window
in their reach, so appending costs two comparisons of fingerprints per word and level. What a
catcher reports is a block that equals its copy at a lag. Reports of neighbouring blocks with the
same lag chain into one stretch, which suffix comparisons extend by less than a block on each
side; a stretch of at least the lag is a square, and overlapping squares of one lag are one run.

A run of period q >= 2L and exponent e contains whole blocks of the level with 2L <= q < 4L, so none
is missed. Fingerprints can only be equal for different words, never the reverse: runs are compared
word by word in the end, and split where the words differ.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtusk.llm.common import arrow_slices, text_or_empty

#: A run has at least LEAST words and EXPONENT periods.
LEAST, EXPONENT = 6, 4
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _mixed(words: np.ndarray) -> np.ndarray:
    """Spread word numbers over 64 bits."""
    x = words.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    x *= np.uint64(_BASE)
    return x ^ (x >> np.uint64(29))


def _powers(base: int, begin: int, count: int) -> np.ndarray:
    """base ** begin, base ** (begin + 1), ... modulo 2 ** 64."""
    factors = np.full(count, base, dtype=np.uint64)
    factors[:1] = pow(base, begin, 1 << 64)
    return np.cumprod(factors, dtype=np.uint64)


class SquareCatchers:
    """Catchers over a stream of word numbers that is appended in slabs of any size."""

    def __init__(self, least: int = LEAST, exponent: int = EXPONENT, longest: int | None = None):
        """Runs of at least `least` words and `exponent` periods (2 or more), within `longest` words."""
        if exponent < 2:
            raise ValueError("a run has two periods at least")
        self.least, self.exponent, self.longest = least, exponent, longest
        self.n, self.words = 0, np.zeros(0, dtype=np.int64)
        self.sums, self.shifts = np.zeros(1, dtype=np.uint64), np.zeros(0, dtype=np.uint64)
        self.caught: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

    def _grow(self, size: int) -> None:
        room = len(self.words)
        if size > room:
            room = max(size, 2 * room if room else size)
            for name, spare in (("words", 0), ("sums", 1), ("shifts", 0)):
                old = getattr(self, name)
                new = np.zeros(room + spare, dtype=old.dtype)
                new[:self.n + spare] = old[:self.n + spare]
                setattr(self, name, new)

    def append(self, words: np.ndarray) -> None:
        """The next words of the stream; each advances the catchers that have it in reach."""
        before, size = self.n, self.n + len(words)
        self._grow(size)
        self.words[before:size] = words
        added = _mixed(words) * _powers(_BASE, before, len(words))
        self.sums[before + 1:size + 1] = self.sums[before] + np.cumsum(added, dtype=np.uint64)
        self.shifts[before:size] = _powers(_INVERSE, before, len(words))
        self.n = size
        level = 1
        # No catcher has a window in reach before 3L words, and no run of its periods fits into fewer than 2eL.
        while level == 1 or 3 * level <= size and (self.longest is None or 2 * self.exponent * level <= self.longest):
            self._catch(level, max(0, before - level + 1))
            level *= 2

    def _fingerprint(self, at, size):
        """Of the `size` words from each place of `at` (none from the end of the stream)."""
        return (self.sums[at + size] - self.sums[at]) * self.shifts[np.minimum(at, self.n - 1)]

    def _catch(self, level: int, first: int) -> None:
        """Compare the windows that begin at `first` and later with the catchers 2L to 4L words back."""
        begin = max(0, (first // level - 3) * level)
        end = self.n - level + 1
        if end <= first:
            return
        prints = (self.sums[begin + level:end + level] - self.sums[begin:end]) * self.shifts[begin:end]
        blocks = np.repeat(prints[::level], level)
        for back in (1, 2, 3) if level == 1 else (2, 3):
            lag = back * level
            hits = np.flatnonzero(prints[lag:] == blocks[:max(0, len(prints) - lag)])
            hits = hits[hits + lag >= first - begin]
            if len(hits):
                catcher = hits // level * level + begin
                self.caught.setdefault(level, []).append((hits + lag + begin - catcher, catcher))

    def _extension(self, at: np.ndarray, lag: np.ndarray, most: np.ndarray, side: int) -> np.ndarray:
        """How many words before (side -1) or from `at` on equal those a lag later, `most` at most."""
        low, high = np.zeros_like(at), most.copy()
        while (low < high).any():
            size = (low + high + 1) // 2
            place = at - size if side < 0 else at
            same = self._fingerprint(place, size) == self._fingerprint(place + lag, size)
            low, high = np.where(same, size, low), np.where(same, high, size - 1)
        return low

    def _stretches(self, level: int) -> np.ndarray:
        """Chains of reports as rows of start, end, period: long enough ones."""
        lag = np.concatenate([lags for lags, _ in self.caught[level]])
        block = np.concatenate([blocks for _, blocks in self.caught[level]])
        order = np.lexsort((block, lag))
        lag, block = lag[order], block[order]
        heads = np.flatnonzero(np.r_[True, (lag[1:] != lag[:-1]) | (block[1:] != block[:-1] + level)])
        count = np.diff(np.r_[heads, len(lag)])
        lag, begin = lag[heads], block[heads]
        end = begin + count * level
        needed = np.maximum(self.least, self.exponent * lag) - lag
        fits = end - begin + 2 * (level - 1) >= needed
        lag, begin, end, needed = lag[fits], begin[fits], end[fits], needed[fits]
        begin = begin - self._extension(begin, lag, np.minimum(level - 1, begin), -1)
        end = end + self._extension(end, lag, np.minimum(level - 1, self.n - lag - end), 1)
        keep = end - begin >= needed
        return np.stack([begin, end + lag, lag], axis=1)[keep]

    def _compared(self, rows: np.ndarray) -> tuple[np.ndarray, bool]:
        """The stretches of `rows` whose words are really equal, and whether all were whole."""
        found, whole = [], True
        for start, end, lag in rows.tolist():
            differ = np.flatnonzero(self.words[start:end - lag] != self.words[start + lag:end])
            whole &= not len(differ)
            edges = np.r_[-1, differ, end - lag - start]
            for a, b in zip(edges[:-1] + 1, edges[1:], strict=True):
                if b - a + lag >= max(self.least, self.exponent * lag):
                    found.append((start + a, start + b + lag, lag))
        return np.array(found, dtype=np.int64).reshape(-1, 3), whole

    def runs(self) -> np.ndarray:
        """All runs of the stream so far, by start, then period: rows of start, length, period."""
        rows = [self._stretches(level) for level in sorted(self.caught)]
        every = np.concatenate([np.zeros((0, 3), dtype=np.int64), *rows])
        found, whole = self._compared(_smallest(every))
        if not whole:  # equal fingerprints of different words: no stretch may stand for another then
            found = _smallest(self._compared(every)[0])
        found = found[np.lexsort((found[:, 2], found[:, 0]))]
        return np.stack([found[:, 0], found[:, 1] - found[:, 0], found[:, 2]], axis=1)


def _smallest(rows: np.ndarray) -> np.ndarray:
    """Of the rows (start, end, period) of one stretch that with the smallest period: all others
    are its multiples, as a stretch has at least two of each."""
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    first = np.ones(len(rows), dtype=bool)
    first[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    return rows[first]


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words between ASCII white space, and where each text's words begin (one more than texts)."""
    lists = pc.split_pattern_regex(texts, "[\\x09-\\x0D\\x20]+")
    words = lists.flatten()
    real = pc.not_equal(pc.binary_length(words), 0)
    before = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
    offsets = lists.offsets.to_numpy()
    return words.filter(real), before[offsets - offsets[0]]


def _text_runs(texts: pa.Array, least: int, exponent: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The words of all texts, where each text's begin, the runs of all texts (start, length, period; starts
    count over all texts), and the number of runs before each text's (one more than texts)."""
    words, begins = split_words(texts)
    counts = np.diff(begins)
    codes = words.dictionary_encode()
    # A separator that occurs once follows each text, so that no run goes beyond it.
    gaps = np.arange(len(texts))
    stream = np.empty(len(words) + len(texts), dtype=np.int64)
    inside = np.ones(len(stream), dtype=bool)
    inside[begins[1:] + gaps] = False
    stream[inside] = codes.indices.to_numpy()
    stream[~inside] = len(codes.dictionary) + gaps
    catchers = SquareCatchers(least, exponent, int(counts.max(initial=0)))
    catchers.append(stream)
    runs = catchers.runs()
    owner = np.searchsorted(begins[1:] + gaps, runs[:, 0])
    runs[:, 0] -= owner
    return words, begins, runs, np.searchsorted(owner, np.arange(len(texts) + 1))


def _collapsed(words: pa.Array, begins: np.ndarray, runs: np.ndarray) -> pa.Array:
    """Each text without the repetitions: the words that no run contains after its first period."""
    change = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    kept = np.cumsum(change[:-1]) == 0
    offsets = np.concatenate([[0], np.cumsum(kept)])[begins]
    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), words.filter(pa.array(kept)))
    return pc.binary_join(lists, " ")


def find_runs(docs: DataFrame, text: str = "text", least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """The rows of `docs` with n_words, runs (array of start, length, period by start, then period) and collapsed.

    Words stand between ASCII white space and are compared byte for byte; they are numbered from 0.
    A run is a stretch of at least `least` words and `exponent` times its smallest period that no
    neighbouring word extends. `collapsed` joins by one space the words that stay when from each run
    all after its first period go. Null, empty and blank texts have no words, no runs and an empty
    `collapsed`. Repeated rows are repeated; other columns are kept as they are, but those named like
    a new one are replaced. No rows give no rows. Every text is searched in the task that reads it.
    """
    new = ("n_words", "runs", "collapsed")
    keep = [field for field in docs.schema.fields if field.name not in new]
    rest = F.struct(*[F.col(f"`{f.name}`") for f in keep]).alias("row")
    frame = docs.select(rest, text_or_empty(F.col(f"`{text}`")).alias("text"))

    def search(batches) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        for batch in arrow_slices(batches, "text", 2_000_000):
            words, begins, runs, offsets = _text_runs(batch.column("text"), least, exponent)
            collapsed = _collapsed(words, begins, runs)
            own = np.repeat(begins[:-1], np.diff(offsets))
            flat = pa.StructArray.from_arrays([pa.array(c) for c in (runs[:, 0] - own, runs[:, 1], runs[:, 2])], fields=list(kind))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(np.diff(begins)), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat), collapsed],
                ["row", *new])

    kind = frame.schema["row"].dataType.simpleString()
    found = frame.mapInArrow(search, f"row {kind}, n_words bigint, "
                             "runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")
    return found.select(*[F.col("row").getField(f.name).alias(f.name) for f in keep], *new)
