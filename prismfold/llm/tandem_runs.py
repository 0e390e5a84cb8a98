"""Periodic runs of words by the linear tandem-repeat method of Gusfield and Stoye.

1. A suffix array with common prefixes stands for the suffix tree of a chunk: an interval of suffixes that share their
   first words is a place in the tree. Names of all stretches of 2^k words, which sorting makes on the way, give common
   extensions to both sides in constant steps.
2. The Lempel-Ziv factorisation cuts the text into blocks. A square's leftmost occurrence reaches over a block's border, so
   extensions from the borders give squares that cover all leftmost occurrences (leftmost-covering set).
3. From each of them suffix links lead from a square to its rotation: its place without the first word, and from there
   down by that word again. As long as the text itself goes on in that way the rotation stands one word further on, so
   a walk is a stretch of starts; where the text breaks off, the next rotation, if there is one, has its leftmost occurrence
   in another walk. The different places of all walks are the complete vocabulary of squares.
4. The suffixes below a place are all occurrences of its square. Squares of one period at neighbouring starts are one run.

Only squares whose root is no power are followed: rotations keep that, and a run's smallest period is such a root.
Documents are told apart by names of their own for their words, so that one chunk of many documents is one text.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels, shared

LEAST = 12
_CHUNK = 1 << 18
_OUT = "doc_id long, n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, place in it) for groups of so many members."""
    which = np.repeat(np.arange(len(counts)), counts)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)


class Text:
    """Names of stretches, suffix array and common extensions of a sequence of whole numbers."""

    def __init__(self, symbols: np.ndarray) -> None:
        n = self.n = len(symbols)
        names = [np.unique(symbols, return_inverse=True)[1].astype(np.int32)]
        while int(names[-1].max()) < n - 1:
            here, width = names[-1].astype(np.int64), 1 << len(names) - 1
            then = np.zeros(n, np.int64)  # 0: beyond the end
            then[: n - width] = here[width:] + 1
            names.append(np.unique(here * (n + 1) + then, return_inverse=True)[1].astype(np.int32))
        self.names, self.rank = names, names[-1].astype(np.int64)
        self.sa = np.empty(n, np.int64)
        self.sa[self.rank] = np.arange(n)
        self.common = np.zeros(n, np.int64)  # of a suffix and the one before it in the array
        self.common[1:] = self.ahead(self.sa[:-1], self.sa[1:])

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols are equal from two different places on."""
        out = np.zeros(len(i), np.int64)
        for k in range(len(self.names) - 2, -1, -1):
            a, b = i + out, j + out
            there = np.maximum(a, b) < self.n
            same = there & (self.names[k][np.where(there, a, 0)] == self.names[k][np.where(there, b, 0)])
            out += same.astype(np.int64) << k
        return out

    def back(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The same towards the front, the two places included."""
        out = np.zeros(len(i), np.int64)
        for k in range(len(self.names) - 2, -1, -1):
            a, b = i - out - (1 << k) + 1, j - out - (1 << k) + 1
            there = np.minimum(a, b) >= 0
            same = there & (self.names[k][np.where(there, a, 0)] == self.names[k][np.where(there, b, 0)])
            out += same.astype(np.int64) << k
        return out

    def blocks(self) -> np.ndarray:
        """Starts of the Lempel-Ziv blocks: each is the longest stretch that starts earlier as well, or a new symbol.

        Suffixes leave the array from the last to the first one; those beside a suffix that are still there start before it.
        """
        n = self.n
        rank, common = self.rank.tolist(), [*self.common.tolist(), 0]
        up, down = list(range(-1, n)), list(range(1, n + 2))
        longest = [0] * n
        for i in range(n - 1, -1, -1):
            r = rank[i]
            a, b = up[r], down[r]
            x, y = common[r], common[b]
            longest[i] = x if x > y else y
            if y > x:
                common[b] = x
            up[b], down[a] = a, b
        out, h = [], 0
        while h < n:
            out.append(h)
            h += longest[h] or 1
        return np.array(out, np.int64)

    @cached_property
    def _least(self) -> list[np.ndarray]:
        """Smallest common prefix of the 2^t places up to each one, as far as two symbols are in common somewhere."""
        out = [self.common.astype(np.int32)]
        while int(out[-1].max(initial=0)) >= 2:
            last, w = out[-1], 1 << len(out) - 1
            out.append(np.concatenate([np.zeros(min(w, self.n), np.int32), np.minimum(last[w:], last[:-w])]))
        return out

    def places(self, i: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last suffix of the array that begin as the suffix i does, for so many symbols."""
        lo, hi = self.rank[i], self.rank[i]
        for t in range(len(self._least) - 1, -1, -1):
            w = 1 << t
            lo = np.where((lo >= w) & (self._least[t][lo] >= length), lo - w, lo)
            nxt = np.minimum(hi + w, self.n - 1)
            hi = np.where((hi + w < self.n) & (self._least[t][nxt] >= length), nxt, hi)
        return lo, hi

    def distinct(self, i: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Indices of one of each different stretch: two overlapping names and the length tell it."""
        level = np.minimum(np.frexp(length.astype(np.float64))[1] - 1, len(self.names) - 1)
        a, b = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
        for k in np.unique(level):
            at = level == k
            a[at] = self.names[k][i[at]]
            b[at] = self.names[k][i[at] + np.maximum(length[at] - (1 << int(k)), 0)]
        order = np.lexsort((i, b, a, length))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0) | (np.diff(length[order]) != 0)
        return order[new]


def _covering(text: Text) -> tuple[np.ndarray, np.ndarray]:
    """(start, root length) of squares that cover the leftmost occurrences of all squares from the left."""
    begin = text.blocks()
    end = np.append(begin[1:], text.n)
    last = np.append(end[1:], text.n)  # of the block after
    # the right half reaches the next block, the centre is in this one
    which, k = _spread(end - begin)
    k = k + 1
    h1 = end[which]
    inside = h1 < text.n
    h1, k = h1[inside], k[inside]
    q = h1 - k
    k1, k2 = text.ahead(h1, q), np.where(q > 0, text.back(h1 - 1, np.maximum(q - 1, 0)), 0)
    hit = (k1 + k2 >= k) & (k1 > 0)
    starts, roots = [np.maximum(q - k2, q - k + 1)[hit]], [k[hit]]
    # the left half begins before this block
    which, k = _spread(last - begin)
    k = k + 1
    h = begin[which]
    q = h + k
    inside = (q < text.n) & (h > 0)
    h, q, k, h1 = h[inside], q[inside], k[inside], end[which][inside]
    k1, k2 = text.ahead(h, q), text.back(h - 1, q - 1)
    start = np.maximum(h - k2, h - k + 1)
    hit = (k1 + k2 >= k) & (k1 > 0) & (k2 > 0) & (start + k <= h1)
    starts.append(start[hit])
    roots.append(k[hit])
    return np.concatenate(starts), np.concatenate(roots)


def _primitive(text: Text, start: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Whether the root is no power of a shorter one."""
    good, rest, prime = np.ones(len(root), bool), root.copy(), 2
    top = int(root.max(initial=1))
    while prime * prime <= top:
        for_now = np.flatnonzero(rest % prime == 0)
        if len(for_now):
            part = root[for_now] // prime
            good[for_now] &= text.ahead(start[for_now], start[for_now] + part) < root[for_now] - part
            while len(for_now):
                rest[for_now] //= prime
                for_now = for_now[rest[for_now] % prime == 0]
        prime += 1
    left = np.flatnonzero(rest > 1)
    part = root[left] // rest[left]
    good[left] &= text.ahead(start[left], start[left] + part) < root[left] - part
    return good


def runs_of(symbols: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs of a sequence, by start, then period: maximal stretches with their smallest
    period that are at least two periods and least symbols long."""
    none = np.zeros(0, np.int64)
    if len(symbols) < 2:
        return none, none, none
    text = Text(symbols)
    start, root = _covering(text)
    keep = _primitive(text, start, root)
    start, root = start[keep], root[keep]
    # the walks, one for each run of the text that holds some leftmost occurrence
    first = start - np.where(start > 0, text.back(np.maximum(start - 1, 0), start + root - 1), 0)
    walks = np.unique(np.stack([root, first]), axis=1)
    root, first = walks[0], walks[1]
    which, step = _spread(text.ahead(first, first + root) - root + 1)
    at, root = first[which] + step, root[which]
    vocabulary = text.distinct(at, 2 * root)
    at, root = at[vocabulary], root[vocabulary]
    # all occurrences of the vocabulary
    lo, hi = text.places(at, 2 * root)
    which, step = _spread(hi - lo + 1)
    key = np.sort(root[which] * text.n + text.sa[lo[which] + step])
    if not len(key):
        return none, none, none
    cut = np.flatnonzero(np.diff(key) != 1) + 1
    head, tail = key[np.insert(cut, 0, 0)], key[np.append(cut, len(key)) - 1]
    period, start = np.divmod(head, text.n)
    length = tail - head + 2 * period
    keep = length >= np.maximum(least, 2 * period)
    start, length, period = start[keep], length[keep], period[keep]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _suspects(ids: np.ndarray, row: np.ndarray, width: int) -> np.ndarray:
    """Rows in which some stretch of width words may stand twice; a row without has no run of 2 * width words. Stretches
    are compared by a hash: equal ones that differ cost time only."""
    n = len(ids) - width + 1
    if n < 2:
        return np.zeros(0, np.int64)
    often = np.bincount(ids)[ids] > 1
    mixed = kernels.mix(ids.astype(np.uint64))
    sums = np.zeros(n, np.uint64)
    whole = row[:n] == row[width - 1 :]
    for k in range(width):
        whole &= often[k : n + k]
        sums = kernels.mix(sums + mixed[k : n + k])
    at = np.flatnonzero(whole)
    order = np.argsort(sums[at], kind="stable")
    same = np.flatnonzero(np.diff(sums[at][order]) == 0)
    return np.unique(row[at[order[same]]])


def _of_chunk(data: np.ndarray, offs: np.ndarray, least: int):
    """(words a row, run rows, starts, lengths, periods, collapsed texts) of some whole texts."""
    rows = len(offs) - 1
    starts, ends, row = kernels.words(data, offs)
    counts = np.bincount(row, minlength=rows)
    first = np.cumsum(counts) - counts
    none = np.zeros(0, np.int64)
    found = (none, none, none, none)
    kept = np.ones(len(row), bool)
    if len(row):
        size = ends - starts
        within = np.concatenate([[0], np.cumsum(size)])
        bytes_of_words = data[kernels.NOT_SPACE[data]]
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(row), [None, pa.py_buffer(within.astype(np.int64)), pa.py_buffer(bytes_of_words)])
        codes = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        own = np.unique(row * (int(codes.max()) + 1) + codes, return_inverse=True)[1]
        suspects = _suspects(own, row, max(1, least // 2))
        chosen = np.flatnonzero(np.isin(row, suspects))
        if len(chosen):
            start, length, period = runs_of(own[chosen], least)
            at = chosen[start]  # a run lies in one row, so its words follow each other there as well
            gone = np.zeros(len(row) + 1, np.int64)
            np.add.at(gone, at + period, 1)
            np.add.at(gone, at + length, -1)
            kept = np.cumsum(gone)[:-1] == 0
            found = (row[at], at - first[row[at]], length, period)
    at = np.flatnonzero(kept)
    size = ends[at] - starts[at] + 1
    which, step = _spread(size)
    text = data[np.minimum(starts[at][which] + step, max(len(data) - 1, 0))] if len(at) else np.zeros(0, np.uint8)
    text[np.cumsum(size) - 1] = 0x20
    total = np.bincount(row[at], weights=size, minlength=rows).astype(np.int64) if len(at) else np.zeros(rows, np.int64)
    place = np.cumsum(total) - total
    return counts, found, text, place, np.maximum(total - 1, 0)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """(doc_id, n_words, runs, collapsed): a document's runs of words, by start, then period, and its words joined by one
    space without those that repeat: the words of any run after its first period.

    Words are maximal stretches of bytes other than white space (0x20, 0x09 to 0x0D); a run is a longest stretch with a
    smallest period q, of max(least, 2 q) words or more. Whole texts, each for itself: no shuffle, one chunk of texts
    in memory at a time, a very long text alone (some 300 bytes a word, and 8 for each place of a square). Null and empty
    texts have no words, no runs and an empty text; rows with equal or null ids are rows of their own; empty tables give none.
    Further columns are ignored.
    """
    of_run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(of_run)), ("collapsed", pa.string())])

    def run(batches):
        for b in batches:
            for lo, hi, data, offs in kernels.chunks(b.column(1), limit=6 * _CHUNK):
                counts, (row, *found), text, place, size = _of_chunk(data, offs, least)
                cut = np.searchsorted(row, np.arange(hi - lo + 1)).astype(np.int32)
                runs = pa.ListArray.from_arrays(pa.array(cut), pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in found], fields=list(of_run)))
                texts = [text[p : p + z].tobytes().decode() for p, z in zip(place.tolist(), size.tolist())]
                yield shared.batch(schema, b.column(0).slice(lo, hi - lo), pa.array(counts, pa.int64()), runs, pa.array(texts, pa.string()))

    return shared.ids_and_texts(docs, id_col, text_col).mapInArrow(run, _OUT)
