"""Vectorised work on Arrow text columns: bytes, words, shingles, local union-find."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import xxhash

CHUNK = 1 << 20
#: bits of a shingle id; the rest of a 64-bit word holds a row number within a chunk
ID_BITS = 54
MAX_ROWS = 1 << (64 - ID_BITS)
#: spans of more bytes are hashed one by one
LONG_SPAN = 96
_SEED = 0x7A3C1F5E9B2D4861
_ODD = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F], dtype=np.uint64)
#: the first k bytes of a little-endian word
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


#: items that are mixed at once: all steps stay in the cache
_LOT = 1 << 14


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    out = np.array(x, dtype=np.uint64, order="C")
    flat = out.reshape(-1)
    spare = np.empty(min(_LOT, len(flat)), np.uint64)
    for lo in range(0, len(flat), _LOT):
        y = flat[lo : lo + _LOT]
        t = spare[: len(y)]
        for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
            np.right_shift(y, np.uint64(shift), out=t)
            np.bitwise_xor(y, t, out=y)
            if times != 1:
                np.multiply(y, np.uint64(times), out=y)
    return out


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a string column and the n + 1 offsets into them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offs = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8), offs


def tidy() -> None:
    """Free memory goes back to the system: workers live through many stages, and each would keep the most that any stage took."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:  # another C library keeps its own ways
        pass


def chunks(column: pa.Array, limit: int = CHUNK, rows: int = MAX_ROWS - 1):
    """(lo, hi, bytes, offsets) for runs of rows of about limit bytes; a longer row stands alone."""
    data, offs = raw(column)
    lo, n = 0, len(column)
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1
        hi = min(n, max(hi, lo + 1), lo + rows)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi
    if n:
        tidy()


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
NOT_SPACE = ~_SPACE
#: ASCII letters and all bytes of longer code points
LETTERS = np.zeros(256, bool)
LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words(data: np.ndarray, offs: np.ndarray, kind: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row of each maximal run of bytes of a kind (not white space); runs end with their row."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    text = (NOT_SPACE if kind is None else kind)[data]
    edge = np.empty(len(data) + 1, bool)
    edge[0], edge[-1] = text[0], text[-1]
    np.not_equal(text[1:], text[:-1], out=edge[1:-1])
    cut = offs[1:-1]
    cut = np.unique(cut[(cut > 0) & (cut < len(data))])
    cut = cut[text[cut] & text[cut - 1]]
    at = np.flatnonzero(edge)
    if len(cut):
        at = np.sort(np.concatenate([at, cut, cut]))
    starts, ends = at[0::2], at[1::2]
    row = np.searchsorted(offs, starts, side="right") - 1
    return starts, ends, row


def lowered(data: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and of the Latin-1 letters (U+00C0 to U+00DE), byte for byte."""
    out = _LOWER[data]
    at = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
    out[at] += 32
    return out


def word_views(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as a little-endian word (zeros beyond the end)."""
    buf = np.zeros(len(data) + 8, np.uint8)
    buf[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", buffer=buf, strides=(1,)).copy()  # aligned: gathers are much faster


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each byte span: words of 8 bytes are mixed in one after the other; long spans by seeded XXH3."""
    if lower:
        data = _LOWER[data]
    n = ends - starts
    at = word_views(data)
    h = mix((at[starts] & _FIRST[np.minimum(n, 8)]) ^ (n.astype(np.uint64) * _ODD[0] + np.uint64(_SEED)))
    live, k = np.flatnonzero((n > 8) & (n <= LONG_SPAN)), 8
    while len(live):
        h[live] = mix((h[live] * _ODD[1]) ^ (at[starts[live] + k] & _FIRST[np.minimum(n[live] - k, 8)]))
        k += 8
        live = live[n[live] > k]
    long = np.flatnonzero(n > LONG_SPAN)
    if len(long):
        view = memoryview(np.ascontiguousarray(data))
        one = xxhash.xxh3_64_intdigest
        h[long] = np.fromiter((one(view[s:e], _SEED) for s, e in zip(starts[long].tolist(), ends[long].tolist())), np.uint64, len(long))
    return h


def word_hashes(at: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """span_hashes of spans of 8 bytes, given the word_views of their bytes."""
    return mix(at[starts] ^ np.uint64((8 * int(_ODD[0]) + _SEED) & (1 << 64) - 1))


def window_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """A hash of the width bytes from each place on (width up to 64)."""
    n = len(data) - width + 1
    at = word_views(data)
    if width < 8:
        return mix((at[:n] & _FIRST[width]) * _ODD[0])
    acc = at[:n] * _ODD[0]
    for k, place in enumerate([*range(8, width - 7, 8), *([width - 8] if width % 8 else [])]):
        acc += at[place : place + n] * _ODD[(k + 1) % 8]
    acc ^= acc >> np.uint64(29)
    acc *= np.uint64(0xBF58476D1CE4E5B9)
    return acc ^ (acc >> np.uint64(32))


_TURN = np.array([pow(0xD6E8FEB86659FD93, k + 1, 1 << 64) for k in range(16)], dtype=np.uint64)


def shingles(word_hash: np.ndarray, row: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each window of words; a row with fewer words gives its whole sequence once."""
    n = len(word_hash)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short_h, short_r = [], []
    counts = np.bincount(row)
    few = np.flatnonzero((counts > 0) & (counts < width))
    first = np.searchsorted(row, few)
    for k in range(1, width):
        sel = counts[few] == k
        if sel.any():
            acc = np.full(int(sel.sum()), k, np.uint64)
            for j in range(k):
                acc += word_hash[first[sel] + j] * _TURN[j]
            short_h.append(mix(acc))
            short_r.append(few[sel])
    m = n - width + 1
    if m > 0:
        ok = row[:m] == row[width - 1 :]
        acc = np.zeros(m, np.uint64)
        for j in range(width):
            acc += word_hash[j : j + m] * _TURN[j]
        short_h.append(mix(acc[ok]))
        short_r.append(row[:m][ok])
    if not short_h:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(short_h), np.concatenate(short_r)


def distinct_ids(hashes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct ID_BITS-bit ids of each row, rows in order; rows must be below MAX_ROWS."""
    packed = np.sort((row.astype(np.uint64) << np.uint64(ID_BITS)) | (hashes >> np.uint64(64 - ID_BITS)))
    if len(packed):
        keep = np.ones(len(packed), bool)
        np.not_equal(packed[1:], packed[:-1], out=keep[1:])
        packed = packed[keep]
    return packed & np.uint64((1 << ID_BITS) - 1), (packed >> np.uint64(ID_BITS)).astype(np.int64)


def shingle_sets(column: pa.Array, width: int):
    """(lo, hi, ids, bounds): the shingle set of row lo + k is ids[bounds[k]:bounds[k+1]], sorted."""
    for lo, hi, data, offs in chunks(column):
        starts, ends, row = words(data, offs)
        h, r = shingles(span_hashes(data, starts, ends), row, width)
        ids, r = distinct_ids(h, r)
        yield lo, hi, ids, np.searchsorted(r, np.arange(hi - lo + 1))


def unique_spans(values: np.ndarray) -> np.ndarray:
    """Bounds of the runs of equal neighbours in a sorted array, with its length at the end."""
    if not len(values):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1, [len(values)]])


def forest(u: np.ndarray, v: np.ndarray, order=None) -> tuple[np.ndarray, np.ndarray]:
    """(node, first node of its component) for the graph with these edges, without the trivial pairs.

    The first node is the smallest, or that with the smallest value of order (a function of the nodes).
    """
    nodes, inv = np.unique(np.concatenate([u, v]), return_inverse=True)
    if order is not None:
        by = np.argsort(order(nodes), kind="stable")
        place = np.empty(len(nodes), np.int64)
        place[by] = np.arange(len(nodes))
        nodes, inv = nodes[by], place[inv]
    a, b = inv[: len(u)], inv[len(u) :]
    label = np.arange(len(nodes))
    while True:
        m = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], m)
        np.minimum.at(new, label[b], m)
        np.minimum.at(new, a, m)
        np.minimum.at(new, b, m)
        while True:
            jump = new[new]
            if np.array_equal(jump, new):
                break
            new = jump
        if np.array_equal(new, label):
            break
        label = new
    own = label != np.arange(len(nodes))
    return nodes[own], nodes[label[own]]
