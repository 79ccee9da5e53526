"""Periodic runs of words, caught online over dyadic blocks, and texts with their repetitions collapsed.

Words are appended to one growing sequence. At every level the sequence has blocks of a power of two words, one begun at each
half block. A completed block has a catcher: every appended word completes a suffix of the block's length, and the fingerprint
of that suffix is compared with the one block that lies half a block to a whole block before it. Where they are equal
the block repeats at that distance, which is at most its own length: the words from the block to the suffix hold a square.
Squares of one distance over consecutive blocks merge; their words are compared, the stretch is extended to both sides
and, if it reaches the end of what has been appended, stays open until an appended word breaks it.

A stretch inside one of a smaller period at a lower level has that period's multiple and is not looked at again. A run of
at least four periods always holds a whole block and its repetition, so none is missed.
"""

from collections.abc import Callable
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .frames import binary, bound_batches, text_rows, unpacked
from .words import mix, segments_of

LEAST_EXPONENT = 4
APPENDED = 1 << 18
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
RUN_TYPE = "struct<start:bigint,length:bigint,period:bigint>"

_LEFT, _RIGHT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Catchers:
    """Runs of a sequence of numbers that grows by :meth:`append`; how it is cut into appended slices does not matter.

    A run is a maximal stretch of smallest period q and length of at least ``max(least, exponent * q)``. ``longest`` bounds the length
    of any run, where the caller knows it.
    """

    def __init__(self, exponent: int = LEAST_EXPONENT, least: int = 6, longest: int | None = None):
        if exponent < LEAST_EXPONENT:
            raise ValueError(f"runs of fewer than {LEAST_EXPONENT} periods may hold no whole block")
        self.exponent, self.least, self.longest = exponent, least, longest
        self._words, self.size = np.empty(1024, dtype=np.int64), 0
        # per level: fingerprints of the latest windows of 2**level words, and where the first of them starts
        self._prints, self._first = [], []
        # stretches [start, end, period], in the order found; the open ones reach the end; the last one of each period
        self._stretches, self._open, self._last = [], [], {}

    def append(self, words: np.ndarray) -> None:
        if not len(words):
            return
        before, self.size = self.size, self.size + len(words)
        if self.size > len(self._words):
            grown = np.empty(max(self.size, 2 * len(self._words)), dtype=np.int64)
            grown[:before] = self._words[:before]
            self._words = grown
        self._words[before : self.size] = words
        for stretch in self._open:
            stretch[1] = self._end(stretch[2], stretch[1])
        self._open = [s for s in self._open if s[1] == self.size]
        level = 0
        while self._advance(level, before):
            level += 1

    def runs(self) -> np.ndarray:
        """Rows (start, length, period) by start, then period, of what has been appended so far."""
        found = np.array(self._stretches, dtype=np.int64).reshape(-1, 3)
        length = found[:, 1] - found[:, 0]
        found[:, 1] = length
        found = found[length >= np.maximum(self.least, self.exponent * found[:, 2])]
        return found[np.lexsort((found[:, 2], found[:, 0]))]

    def _advance(self, level: int, before: int) -> bool:
        """Fingerprints of the windows that the appended words complete, and what their catchers catch; false beyond the last level."""
        width, half = 1 << level, 1 << level >> 1
        if self.size < width or self.longest is not None and self.exponent * half > self.longest:
            return False
        if level == len(self._prints):
            self._prints.append(np.empty(0, dtype=np.uint64))
            self._first.append(0)
        first = self._first[level]
        start = first + len(self._prints[level])
        stop = self.size - width + 1
        if level == 0:
            new = mix(self._words[start:stop].astype(np.uint64) * _LEFT + _RIGHT)
        else:
            below, at = self._prints[level - 1], start - self._first[level - 1]
            new = below[at : at + stop - start] * _LEFT + below[at + half : at + half + stop - start]
            new ^= new >> np.uint64(29)
            new *= _RIGHT
            new ^= new >> np.uint64(32)
        prints = np.concatenate([self._prints[level], new])
        if level:
            self._catch(prints, first, start, stop, level)
        kept = max(first, before - 4 * width)  # the level above still reads what this one knew before
        self._prints[level], self._first[level] = prints[kept - first :], kept
        return True

    def _catch(self, prints: np.ndarray, first: int, start: int, stop: int, level: int) -> None:
        width, half = 1 << level, 1 << level >> 1
        suffix = np.arange(max(start, half), stop)
        block = (suffix // half - 1) * half
        hit = np.flatnonzero(prints[max(start, half) - first : stop - first] == prints[block - first])
        if not len(hit):
            return
        block, period = block[hit], suffix[hit] - block[hit]
        order = np.lexsort((block, period))
        block, period = block[order], period[order]
        new = np.ones(len(block), dtype=bool)
        new[1:] = (period[1:] != period[:-1]) | (block[1:] != block[:-1] + half)
        lo, period = block[new], period[new]
        hi = block[np.append(np.flatnonzero(new)[1:] - 1, len(block) - 1)] + width + period
        inside = self._inside_smaller(lo, hi, half)
        for low, high, p in zip(lo[~inside].tolist(), hi[~inside].tolist(), period[~inside].tolist()):
            same = self._words[low : high - p] == self._words[low + p : high]
            if same.all():
                self._stretch(low, high, p)
                continue
            # fingerprints of different words were equal
            edges = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]]))).reshape(-1, 2)
            a, b = (edges[edges[:, 1] - edges[:, 0] >= width] + (low, low + p)).T
            inside_too = self._inside_smaller(a, b, half)
            for begin, end in zip(a[~inside_too].tolist(), b[~inside_too].tolist()):
                self._stretch(begin, end, p)

    def _inside_smaller(self, lo: np.ndarray, hi: np.ndarray, half: int) -> np.ndarray:
        known = np.array([s for s in self._stretches if s[2] < half], dtype=np.int64).reshape(-1, 3)
        if not len(known):
            return np.zeros(len(lo), dtype=bool)
        known = known[np.argsort(known[:, 0], kind="stable")]
        reach = np.append(0, np.maximum.accumulate(known[:, 1]))
        return reach[np.searchsorted(known[:, 0], lo, side="right")] >= hi

    def _stretch(self, low: int, high: int, period: int) -> None:
        last = self._last.get(period)
        if last and low >= last[0] and high <= last[1]:
            return
        found = [self._begin(period, low), self._end(period, high), period]
        self._last[period] = found
        self._stretches.append(found)
        if found[1] == self.size:
            self._open.append(found)

    def _end(self, period: int, at: int) -> int:
        """Where the stretch that reaches to ``at`` ends."""
        step = 64
        while at < self.size:
            stop = min(at + step, self.size)
            differ = np.flatnonzero(self._words[at:stop] != self._words[at - period : stop - period])
            if len(differ):
                return at + int(differ[0])
            at, step = stop, step * 2
        return at

    def _begin(self, period: int, at: int) -> int:
        step = 64
        while at > 0:
            stop = max(at - step, 0)
            differ = np.flatnonzero(self._words[stop:at] != self._words[stop + period : at + period])
            if len(differ):
                return stop + int(differ[-1]) + 1
            at, step = stop, step * 2
        return at


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        found = self[word] = len(self)
        return found


def runs_of(texts: list[bytes], exponent: int = LEAST_EXPONENT, least: int = 6) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs (start, length, period) of all texts one after the other, the text of each, and the words of every text.

    The texts follow each other in one sequence, parted by numbers that no word has.
    """
    numbers, counts, slices = _Numbers(), np.zeros(len(texts), dtype=np.int64), []
    for i, text in enumerate(texts):
        for words in segments_of(text):
            counts[i] += len(words)
            slices.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
        slices.append(np.array([-1 - i], dtype=np.int64))
    catchers = Catchers(exponent, least, int(counts.max(initial=0)))
    pending, size = [], 0
    for part in slices:
        pending.append(part)
        size += len(part)
        if size >= APPENDED:
            catchers.append(np.concatenate(pending))
            pending, size = [], 0
    if pending:
        catchers.append(np.concatenate(pending))
    found = catchers.runs()
    begins = np.concatenate([[0], np.cumsum(counts + 1)])
    text = np.searchsorted(begins, found[:, 0], side="right") - 1
    found[:, 0] -= begins[text]
    return found, text, counts


def collapsed(text: bytes, runs: np.ndarray, n_words: int) -> bytes:
    """The words that no run holds after its first period, joined by one space."""
    if not len(runs):
        return b" ".join(b" ".join(words) for words in segments_of(text))
    steps = np.zeros(n_words + 1, dtype=np.int64)
    np.add.at(steps, runs[:, 0] + runs[:, 2], 1)
    np.add.at(steps, runs[:, 0] + runs[:, 1], -1)
    keep, at, parts = np.cumsum(steps[:-1]) == 0, 0, []
    for words in segments_of(text):
        parts += [words[i] for i in np.flatnonzero(keep[at : at + len(words)])]
        at += len(words)
    return b" ".join(parts)


def strongest(runs: np.ndarray) -> dict | None:
    """The run of the greatest exact length by period; of equals the one that starts first, then that of the smaller period."""
    if not len(runs):
        return None
    start, length, period = max(runs.tolist(), key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]))
    return {"start": start, "length": length, "period": period}


def collapse_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", exponent: int = LEAST_EXPONENT, least: int = 6) -> DataFrame:
    """The documents without the repetitions of periodic runs.

    Words are runs of bytes other than space and 0x09-0x0D, compared as they are and numbered from 0. A run is a stretch of consecutive
    words of one row with smallest period q that is at least ``max(least, exponent * q)`` words long and that no neighbouring word
    extends. Words that any run holds after its first q words go.

    Returns the columns of ``docs`` with the kept words joined by one space as the text, and ``n_words``, ``runs`` (start,
    length, period; by start, then period) and ``strongest`` (the run of the most periods; null without runs), which replace columns of those names. A
    null, empty or blank text has no words and comes back empty, without runs. Rows are judged alone: rows without an id and
    repeated rows are like others. An empty table gives none. Nothing is shuffled.
    """
    bound_batches(docs.sparkSession)
    rows = text_rows(docs, id_col, text_col)
    schema = T.StructType([rows.schema["_id"], rows.schema["_rest"], T.StructField("_kept", T.StringType()), T.StructField("_words", T.LongType())])
    schema = T.StructType([*schema, *T.StructType.fromDDL(f"_runs array<{RUN_TYPE}>, _strongest {RUN_TYPE}")])

    def collapse(batches):
        for batch in batches:
            texts = [t or b"" for t in binary(batch["_text"])]
            found, text, counts = runs_of(texts, exponent, least)
            ends = np.searchsorted(text, np.arange(len(texts)), side="right")
            each = [found[a:b] for a, b in zip(np.append(0, ends), ends)]
            kept = [collapsed(t, r, n) for t, r, n in zip(texts, each, counts)]
            runs = pa.ListArray.from_arrays(
                pa.array(np.append(0, ends), pa.int32()), pa.StructArray.from_arrays([pa.array(found[:, i]) for i in range(3)], fields=list(RUN))
            )
            columns = [batch["_id"], batch["_rest"], pa.array(kept, pa.binary()).cast(pa.string()), pa.array(counts), runs]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([strongest(r) for r in each], RUN)], schema.names)

    out = rows.mapInArrow(collapse, schema)
    more = {"n_words": F.col("_words"), "runs": F.col("_runs"), "strongest": F.col("_strongest")}
    return unpacked(out, docs, id_col, F.col("_kept"), text_col, more)


def runs_by_brute_force(words: list, exponent: int = LEAST_EXPONENT, least: int = 6) -> list[tuple]:
    """(start, length, period) of all runs of a list, in plain Python; for tests."""
    out = []
    smallest: Callable = lambda a, b: next(q for q in range(1, b - a + 1) if words[a : b - q] == words[a + q : b])
    for q in range(1, len(words) // exponent + 1):
        at = 0
        while at + q < len(words):
            if words[at] != words[at + q]:
                at += 1
                continue
            end = at + q
            while end < len(words) and words[end] == words[end - q]:
                end += 1
            if end - at >= max(least, exponent * q) and smallest(at, end) == q:
                out.append((at, end - at, q))
            at = end - q + 1
    return sorted(out, key=lambda r: (r[0], r[2]))
