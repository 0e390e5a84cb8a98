"""SentencePiece encoding with seeded merge-dropout, and decoding without loss.

The vocabulary of a merge-type (BPE) model is used as published: nothing is trained. Spaces become the
mark U+2581 with one in front, as the model was made; no piece holds a mark after another character
(checked), so a text falls apart into units (a run of marks and what follows, or one control character)
that merge independently. A unit is merged by an agenda of neighbouring pairs, best rank first and
leftmost on ties. Each candidate taken from the agenda is skipped for good if a keyed hash of (seed,
document id, the unit's place, its span and its middle) falls below the dropout rate: every occurrence draws for itself. Each
different unit of a chunk is merged once without skips, with a note of the candidates taken; occurrences whose draws
skip none of them share its pieces, the others are merged one by one, all of a length class at a time: one array row
for each unit's symbols, one agenda step for all rows. Characters without a piece are encoded as bytes;
so is a literal mark. Decoding turns pieces to bytes and marks to spaces, and drops the first mark.
"""

from __future__ import annotations

from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame

from . import kernels, shared

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: symbols from here on stand for code points without a piece
_LOOSE = 1 << 20
_NEVER = np.int32(2**31 - 1)
#: units of more characters are merged one by one
_LONG = 48
_MASK = (1 << 64) - 1


def load_pieces(model_file: str = MODEL) -> dict:
    """Ranks by piece (0 is merged first), ids by piece, byte ids and surfaces by id."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    ids, scores, bytes_, surface = {}, {}, [0] * 256, []
    for k in range(sp.get_piece_size()):
        piece = sp.id_to_piece(k)
        if sp.is_byte(k):
            bytes_[int(piece[3:5], 16)] = k
            surface.append(bytes([int(piece[3:5], 16)]))
        elif sp.is_control(k) or sp.is_unknown(k):
            surface.append(b"")
        else:
            if MARK in piece.lstrip(MARK):
                raise ValueError(f"piece {piece!r} joins words; units would not be independent")
            ids[piece], scores[piece] = k, sp.get_score(k)
            surface.append(piece.replace(MARK, " ").encode())
    chars = {c for p in ids for c in p if len(p) > 1}
    symbol = dict(ids) | {c: _LOOSE + ord(c) for c in chars if c not in ids}
    joins = {}
    for piece in ids:
        for k in range(1, len(piece)):
            a, b = symbol.get(piece[:k]), symbol.get(piece[k:])
            if a is not None and b is not None:
                joins[a << 32 | b] = piece
    keys = np.array(list(joins), np.uint64)
    bits = max(4, int(len(keys) * 4).bit_length())
    table = np.full(1 << bits, -1, np.int64)
    for k, at in enumerate(_slots(keys, bits).tolist()):
        while table[at] >= 0:
            at = (at + 1) & ((1 << bits) - 1)
        table[at] = k
    ranks = np.unique([-scores[p] for p in joins.values()], return_inverse=True)[1].astype(np.int32) if joins else np.zeros(0, np.int32)
    joined = np.array([ids[p] for p in joins.values()], np.int32)
    if not any(bytes_):
        raise ValueError("the model has no byte pieces; encoding could lose characters")
    return {"ids": ids, "rank": {p: -s for p, s in scores.items()}, "bytes": bytes_, "surface": surface, "bits": bits, "table": table, "keys": keys, "ranks": ranks, "joined": joined, "chars": {ord(p): k for p, k in ids.items() if len(p) == 1}}


def _slots(keys: np.ndarray, bits: int) -> np.ndarray:
    return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def _lookup(pieces: dict, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Numbers of the joins of two symbols; -1 where there is none."""
    key = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
    at, mask = _slots(key, pieces["bits"]), (1 << pieces["bits"]) - 1
    got = pieces["table"][at]
    todo = np.flatnonzero((got >= 0) & (pieces["keys"][got] != key))
    while len(todo):
        at[todo] = (at[todo] + 1) & mask
        got[todo] = pieces["table"][at[todo]]
        todo = todo[(got[todo] >= 0) & (pieces["keys"][got[todo]] != key[todo])]
    return got


def _costs(pieces, left, right):
    """Ranks and numbers of the joins of two symbols; _NEVER and -1 where there is none."""
    got = _lookup(pieces, np.maximum(left, 0), np.maximum(right, 0))
    got[(left < 0) | (right < 0)] = -1
    return np.where(got >= 0, pieces["ranks"][got] if len(pieces["ranks"]) else _NEVER, _NEVER), got


def _spans(start, middle, stop):
    """What a candidate's places add to its hash."""
    return (start * np.uint64(0x9E3779B97F4A7C15)) ^ (middle * np.uint64(0xD6E8FEB86659FD93)) ^ (stop * np.uint64(0xC2B2AE3D27D4EB4F))


def _skipped(salts: np.ndarray, spans: np.ndarray, rate: float) -> np.ndarray:
    h = salts ^ spans
    return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(32) < np.uint64(int(rate * (1 << 32)))


def merge_units(symbols: np.ndarray, size: np.ndarray, pieces: dict, rate: float, salts: np.ndarray, taken: list | None = None) -> np.ndarray:
    """Symbols left of each unit (a row, -1 beyond its size) when its agenda is empty; as merge_unit for all.

    taken gets the rows and the spans of all candidates that the agendas gave out.
    """
    n, width = symbols.shape
    out = symbols.copy()
    if width < 2:
        return out
    # a unit's pieces as a list linked by places; a piece stands at its first place, places of others in it are empty
    after = np.minimum(np.arange(1, width + 1, dtype=np.int32)[None, :], size[:, None]).astype(np.int32)
    before = np.repeat(np.arange(-1, width - 1, dtype=np.int32)[None, :], n, axis=0)
    cost, join = np.full((n, width), _NEVER, np.int32), np.full((n, width), -1, np.int32)
    first, number = _costs(pieces, out[:, :-1].ravel(), out[:, 1:].ravel())
    cost[:, :-1], join[:, :-1] = first.reshape(n, width - 1), number.reshape(n, width - 1)
    sym, rows, size, salts = out.copy(), np.arange(n), size.astype(np.int64), salts.astype(np.uint64)
    while len(rows):
        k = cost.argmin(axis=1)
        base = np.arange(len(rows)) * width
        live = cost.ravel()[base + k] != _NEVER
        if live.sum() < 0.7 * len(rows):
            out[rows[~live]] = sym[~live]
            sym, after, before, cost, join, rows, size, salts, k = (x[live] for x in (sym, after, before, cost, join, rows, size, salts, k))
            go, base = np.arange(len(rows)), np.arange(len(rows)) * width
            if not len(rows):
                break
        else:
            go = np.flatnonzero(live)
        s, nxt, prv, c, number = (x.reshape(-1) for x in (sym, after, before, cost, join))
        at, k = base[go], k[go]
        here = at + k
        middle = nxt[here].astype(np.int64)
        stop = nxt[at + middle].astype(np.int64)
        spans = _spans(k.astype(np.uint64), middle.astype(np.uint64), stop.astype(np.uint64)) if rate or taken is not None else None
        if taken is not None:
            taken.append((rows[go], spans))
        if rate:
            skip = _skipped(salts[go], spans, rate)
            c[here[skip]] = _NEVER
            keep = ~skip
            go, at, k, here, middle, stop = go[keep], at[keep], k[keep], here[keep], middle[keep], stop[keep]
        new = pieces["joined"][number[here]] if len(here) else np.zeros(0, np.int32)
        s[here], s[at + middle], c[at + middle], c[here], nxt[here] = new, -1, _NEVER, _NEVER, stop
        inside = stop < size[go]
        right = at[inside] + stop[inside]
        prv[right] = k[inside]
        c[here[inside]], number[here[inside]] = _costs(pieces, new[inside], s[right])
        left = prv[here] >= 0
        there = at[left] + prv[here[left]]
        c[there], number[there] = _costs(pieces, s[there], new[left])
    return out


def merge_unit(unit: str, pieces: dict, rate: float, salt: int) -> list[int]:
    """Piece ids of one unit (marks already in place, U+D800 for a mark of the text itself).

    The agenda is a heap of pairs, the pieces a linked list: n log n in the unit's length.
    """
    get, n = pieces["rank"].get, len(unit)
    limit = int(rate * (1 << 32))
    end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))

    def pair(start):
        """The agenda's entry for the piece at start and the next one: best rank first, leftmost on ties."""
        middle = end[start]
        if middle < n and (cost := get(unit[start : end[middle]])) is not None:
            heappush(agenda, (cost, start, middle, end[middle]))

    agenda: list = []
    for k in range(n - 1):
        pair(k)
    gone = bytearray(n)
    while agenda:
        _, start, middle, stop = heappop(agenda)
        if gone[start] or end[start] != middle or end[middle] != stop:
            continue  # one of the two has been merged meanwhile
        if limit:
            h = (salt ^ (start * 0x9E3779B97F4A7C15) ^ (middle * 0xD6E8FEB86659FD93) ^ (stop * 0xC2B2AE3D27D4EB4F)) & _MASK
            h = ((h ^ (h >> 29)) * 0xBF58476D1CE4E5B9) & _MASK
            if (h >> 32) < limit:
                continue
        gone[middle] = 1
        end[start] = after[start] = stop
        if stop < n:
            before[stop] = start
            pair(start)
        if before[start] >= 0:
            pair(before[start])
    cuts, k = [], 0
    while k < n:
        cuts.append(k)
        k = end[k]
    cuts.append(n)
    ids, bytes_, out = pieces["ids"], pieces["bytes"], []
    for a, b in zip(cuts, cuts[1:]):
        k = ids.get(unit[a:b])
        if k is not None:
            out.append(k)
        else:
            out += [bytes_[c] for c in unit[a:b].replace("\ud800", MARK).encode()]
    return out


def _starts(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of units and their rows: a row's start, a space run's first space, control characters on their own."""
    space, control = data == 32, data < 32
    start = control.copy()
    start[1:] |= (space[1:] & ~space[:-1]) | control[:-1]
    start[offs[:-1][offs[:-1] < offs[1:]]] = True
    at = np.flatnonzero(start)
    return at, np.searchsorted(offs, at, side="right") - 1


def _segment(units: np.ndarray, size: np.ndarray, text: np.ndarray, first: np.ndarray, pieces: dict, symbol: np.ndarray, rate: float, salts: np.ndarray, taken: list | None = None):
    """Ids of units (starts in the code points of text), one after the other, and how many each has. taken gets (unit, span) of the candidates of all but long units."""
    length = size + first
    flat_ids, flat_of = [], []
    lo = 0
    for width in (1, 4, 6, 8, 10, 12, 16, 24, 32, _LONG):
        sel = np.flatnonzero((length > lo) & (length <= width))
        lo = width
        for a in range(0, len(sel), 1 << 15):
            s = sel[a : a + (1 << 15)]
            cols = np.arange(width)[None, :] - first[s][:, None]
            inside = (cols >= 0) & (cols < size[s][:, None])
            sym = np.where(inside, symbol[text[np.minimum(units[s][:, None] + np.maximum(cols, 0), len(text) - 1)]], -1).astype(np.int32)
            sym[first[s].astype(bool), 0] = pieces["ids"][MARK]
            given: list | None = None if taken is None else []
            left = merge_units(sym, length[s], pieces, rate, salts[s], given)
            if taken is not None:
                taken += [(s[r], m) for r, m in given]
            here = left >= 0
            flat_ids.append(left[here])
            flat_of.append(np.repeat(s, here.sum(axis=1)))
    for k in np.flatnonzero(length > _LONG):
        chars = text[units[k] : units[k] + size[k]]
        unit = (MARK if first[k] else "") + "".join(map(chr, np.where(chars == 32, ord(MARK), np.where(chars == ord(MARK), 0xD800, chars))))
        ids = merge_unit(unit, pieces, rate, int(salts[k]))
        flat_ids.append(np.array(ids, np.int32))
        flat_of.append(np.full(len(ids), k))
    ids = np.concatenate(flat_ids) if flat_ids else np.zeros(0, np.int32)
    of = np.concatenate(flat_of) if flat_of else np.zeros(0, np.int64)
    order = np.argsort(of, kind="stable")
    ids, of = ids[order], of[order]
    loose = np.flatnonzero(ids >= _LOOSE)
    if len(loose):  # code points without a piece become their bytes
        encoded = [[pieces["bytes"][c] for c in chr(v - _LOOSE).encode()] for v in ids[loose].tolist()]
        times = np.ones(len(ids), np.int64)
        times[loose] = [len(e) for e in encoded]
        start = np.cumsum(times) - times
        ids, of = np.repeat(ids, times), np.repeat(of, times)
        for at, e in zip(start[loose].tolist(), encoded):
            ids[at : at + len(e)] = e
    return ids, np.bincount(of, minlength=len(units))


def _symbols(pieces: dict) -> np.ndarray:
    """The symbol of each code point: its piece, the byte piece of one byte, or itself from _LOOSE on; spaces are marks."""
    out = np.arange(_LOOSE, _LOOSE + 0x110000, dtype=np.int32)
    out[:128] = pieces["bytes"][:128]
    for c, k in pieces["chars"].items():
        out[c] = k
    out[ord(MARK)] = _LOOSE + ord(MARK)
    out[32] = pieces["ids"][MARK]
    return out


def _encoder(pieces, rate, seed):
    symbol = _symbols(pieces)

    def rows(doc_ids: np.ndarray, column: pa.Array):
        """(lo, hi, ids, bounds) for each chunk."""
        for lo, hi, data, offs in kernels.chunks(column, limit=1 << 19, rows=1 << 30):
            if not len(data):
                yield lo, hi, np.zeros(0, np.int32), np.zeros(hi - lo + 1, np.int64)
                continue
            text = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32).astype(np.int64)
            letter = np.cumsum((data & 0xC0) != 0x80) - 1
            at, row = _starts(data, offs)
            end = np.append(at[1:], len(data))
            first = np.append(True, row[1:] != row[:-1])
            letters = np.append(letter[at], len(text))
            length, first = np.diff(letters), first.astype(np.int64)

            def cut(which, own_rate, salts, taken=None):
                return _segment(letters[which], length[which], text, first[which], pieces, symbol, own_rate, salts, taken)

            # each different unit once, without skips
            key = kernels.span_hashes(data, at, end, lower=False) ^ (first.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
            _, pick, inv = np.unique(key, return_index=True, return_inverse=True)
            taken: list = []
            flat, size = cut(pick, 0.0, np.zeros(len(pick), np.uint64), taken if rate else None)
            n, begin = size[inv], (np.cumsum(size) - size)[inv]
            if rate:
                # an occurrence whose draws skip none of the candidates that its unit takes has the same pieces; the others are cut one by one
                place = np.arange(len(at)) - np.searchsorted(row, row)
                salts = kernels.mix(kernels.mix(doc_ids[lo + row].view(np.uint64) ^ np.uint64(seed * 0x9E3779B97F4A7C15 & _MASK)) + place.astype(np.uint64))
                unit, spans = (np.concatenate(c) for c in zip(*taken)) if taken else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
                order = np.argsort(unit, kind="stable")
                spans = spans[order]
                bounds = np.searchsorted(unit[order], np.arange(len(pick) + 1))
                many = np.diff(bounds)[inv]
                which = np.repeat(np.arange(len(at)), many)
                flat_at = np.repeat(bounds[:-1][inv] - (np.cumsum(many) - many), many) + np.arange(len(which))
                own = length + first > _LONG
                own[which[_skipped(salts[which], spans[flat_at], rate)]] = True
                own = np.flatnonzero(own)
                more, counts = cut(own, rate, salts[own])
                n[own], begin[own] = counts, len(flat) + np.cumsum(counts) - counts
                flat = np.concatenate([flat, more])
            total = np.concatenate([[0], np.cumsum(n)])
            ids = flat[np.repeat(begin - total[:-1], n) + np.arange(total[-1])]
            yield lo, hi, ids, total[np.searchsorted(row, np.arange(hi - lo + 1))]

    return rows


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", out: str = "tokens", model_file: str = MODEL, rate: float = 0.1, seed: int = 1) -> DataFrame:
    """docs with a column out, array<int>: piece ids of the whole text; a clashing column gives way.

    rate 0 gives the model's own segmentation. Null and empty texts give an empty array. Rows with a null id
    draw as id 0. Rows with the same id and text get the same ids, at every run. The vocabulary file
    is read on the driver and its pieces (well below a MB) are broadcast.
    """
    pieces = shared.Shipped(docs.sparkSession, load_pieces(model_file))
    docs = docs.select([c for c in docs.columns if c != out])
    id_at, text_at = docs.columns.index(id_col), docs.columns.index(text_col)
    fields = docs.selectExpr("*", f"array(0) as `{out}`").schema

    def run(batches):
        rows = _encoder(pieces.value, rate, seed)
        for b in batches:
            ids = b.column(id_at).cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
            for lo, hi, tokens, bounds in rows(ids, b.column(text_at)):
                values = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(tokens))
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in b.columns), values], names=[*b.schema.names, out])

    return docs.mapInArrow(run, fields)


def decode(docs: DataFrame, tokens_col: str = "tokens", out: str = "decoded", model_file: str = MODEL) -> DataFrame:
    """docs with a string column out: the text of the piece ids. Null tokens give null, none an empty text."""
    surface = shared.Shipped(docs.sparkSession, load_pieces(model_file)["surface"])
    docs = docs.select([c for c in docs.columns if c != out])
    place = docs.columns.index(tokens_col)
    fields = docs.selectExpr("*", f"'' as `{out}`").schema

    def run(batches):
        table = surface.value
        length = np.array([len(s) for s in table])
        start = np.concatenate([[0], np.cumsum(length)[:-1]])
        letters = np.frombuffer(b"".join(table), np.uint8)
        for b in batches:
            column = b.column(place)
            for lo in range(0, b.num_rows, 256):
                part = column.slice(lo, 256)
                ids = part.flatten().to_numpy(zero_copy_only=False)
                n = length[ids]
                total = np.concatenate([[0], np.cumsum(n)])
                data = letters[np.repeat(start[ids] - total[:-1], n) + np.arange(total[-1])].tobytes()
                sizes = [0 if k is None else k for k in pa.compute.list_value_length(part).to_pylist()]
                bounds = total[np.concatenate([[0], np.cumsum(sizes)]).astype(int)]
                known = part.is_valid().to_pylist()
                texts = [data[a + (1 if z > a else 0) : z].decode("utf-8", "replace") if ok else None for a, z, ok in zip(bounds, bounds[1:], known)]
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, 256) for c in b.columns), pa.array(texts, pa.string())], names=[*b.schema.names, out])

    return docs.mapInArrow(run, fields)
