"""Quality classifier: generalised additive model with pairwise interactions, by cyclic boosting.

A text becomes FEATURES, figures of its bytes, words and lines. Each feature is cut into bins at
quantiles of the sample. Round by round, each feature in turn gets a shallow tree (a few cuts of its
bins) fitted to the gradient, added to its lookup table; then the pairs of features with the
largest gain on a coarse grid get tables in the same way, with a cut in each feature. A score is the
logistic of the sum of one bin lookup for each table. The model is fitted on the driver, on a bounded
sample of labelled rows, one in six of which chooses the number of rounds.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels, shared
from .training import labelled_sample

BINS, PAIR_BINS = 48, 8
#: labelled rows at most that the model is fitted on
SAMPLE_ROWS = 20_000
FEATURES = ("log_bytes", "log_words", "mean_word", "upper", "digit", "symbol", "bar", "letters_above_ascii", "space", "distinct_words", "top_word", "repeated_trigrams", "short_words", "symbol_ends", "upper_words", "log_lines", "line_length", "repeated_lines", "sentence_ends", "longest_word")
_ROWS = pa.schema([("doc_id", pa.int64()), ("y", pa.int32()), ("x", pa.binary())])

_KINDS = {"upper": range(65, 91), "digit": range(48, 58), "symbol": b"!#$%&*@^~<>=+_\\{}[]", "bar": b"|", "letters_above_ascii": range(128, 256), "space": b" \t\n\r", "sentence_ends": b".?!"}


def _per_row(mask_sum: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask_sum)])
    return (total[offs[1:]] - total[offs[:-1]]).astype(float)


def _distinct(values: np.ndarray, row: np.ndarray, rows: int):
    """Distinct values of each row, and the count of its commonest one."""
    if not len(values):
        return np.zeros(rows), np.zeros(rows)
    order = np.lexsort((values, row))
    v, r = values[order], row[order]
    new = np.append(True, (v[1:] != v[:-1]) | (r[1:] != r[:-1]))
    at = np.flatnonzero(new)
    most = np.zeros(rows)
    np.maximum.at(most, r[at], np.diff(np.append(at, len(v))))
    return np.bincount(r[at], minlength=rows).astype(float), most


def features(column: pa.Array):
    """(lo, hi, matrix): FEATURES of the rows of each chunk, from whole texts."""
    for lo, hi, data, offs in kernels.chunks(column):
        rows = hi - lo
        size = np.diff(offs).astype(float)
        kinds = {k: np.isin(np.arange(256), list(v)) for k, v in _KINDS.items()}
        share = {k: _per_row(kind[data], offs) / np.maximum(size, 1) for k, kind in kinds.items()}
        starts, ends, row = kernels.words(data, offs)
        n = np.bincount(row, minlength=rows).astype(float)
        h = kernels.span_hashes(data, starts, ends)
        length = (ends - starts).astype(float)
        distinct, most = _distinct(h, row, rows)
        grams, gram_row = kernels.shingles(h, row, 3)
        n_grams = np.bincount(gram_row, minlength=rows).astype(float)
        lines_h, lines_r, lines_n = _lines(data, offs)
        distinct_lines, _ = _distinct(lines_h, lines_r, rows)
        longest = np.zeros(rows)
        np.maximum.at(longest, row, length)
        words = np.maximum(n, 1)
        some = len(data) > 0
        upper = np.bincount(row, (kinds["upper"][data[starts]] & kinds["upper"][data[np.minimum(starts + 1, ends - 1)]]) if some and len(starts) else None, minlength=rows)
        symbol_ends = np.bincount(row, kinds["symbol"][data[ends - 1]] if some and len(starts) else None, minlength=rows)
        columns = {
            **share,
            "log_bytes": np.log1p(size),
            "log_words": np.log1p(n),
            "mean_word": np.bincount(row, length, minlength=rows) / words,
            "distinct_words": distinct / words,
            "top_word": most / words,
            "repeated_trigrams": 1 - _distinct(grams, gram_row, rows)[0] / np.maximum(n_grams, 1),
            "short_words": np.bincount(row, length <= 3, minlength=rows) / words,
            "symbol_ends": symbol_ends / words,
            "upper_words": upper / words,
            "log_lines": np.log1p(lines_n),
            "line_length": np.log1p(size / np.maximum(lines_n, 1)),
            "repeated_lines": 1 - distinct_lines / np.maximum(lines_n, 1),
            "longest_word": np.log1p(longest),
        }
        yield lo, hi, np.stack([columns[f] for f in FEATURES], axis=1).astype(np.float32)


def _lines(data, offs):
    kind = np.ones(256, bool)
    kind[10] = False
    starts, ends, row = kernels.words(data, offs, kind)
    return (kernels.span_hashes(data, starts, ends, lower=False) if len(starts) else np.zeros(0, np.uint64)), row, np.bincount(row, minlength=len(offs) - 1).astype(float)


@dataclass
class Model:
    cuts: list
    coarse: list
    bias: float = 0.0
    tables: list = field(default_factory=list)
    pairs: list = field(default_factory=list)

    def bins(self, x: np.ndarray):
        fine = [np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(self.cuts)]
        rough = [np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(self.coarse)]
        return fine, rough

    def raw(self, x: np.ndarray) -> np.ndarray:
        fine, rough = self.bins(x)
        out = np.full(len(x), self.bias)
        for f, t in enumerate(self.tables):
            out += t[fine[f]]
        for a, b, t in self.pairs:
            out += t[rough[a] * PAIR_BINS + rough[b]]
        return out


def _tree(grad: np.ndarray, hess: np.ndarray, depth: int, l2: float) -> np.ndarray:
    """Values by bin of a tree of this depth over ordered bins, from sums of gradient and hessian."""
    out = np.empty(len(grad))

    def grow(lo, hi, d):
        g, h = grad[lo:hi], hess[lo:hi]
        if d and hi - lo > 1:
            cg, ch = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
            gain = cg**2 / (ch + l2) + (g.sum() - cg) ** 2 / (h.sum() - ch + l2)
            k = int(np.argmax(gain))
            if gain[k] > g.sum() ** 2 / (h.sum() + l2) + 1e-9:
                grow(lo, lo + k + 1, d - 1)
                grow(lo + k + 1, hi, d - 1)
                return
        out[lo:hi] = g.sum() / (h.sum() + l2)

    grow(0, len(grad), depth)
    return out


def _cross(grad: np.ndarray, hess: np.ndarray, l2: float):
    """The best cut of a grid in both its features: values by cell, and the gain."""
    best, value = -1.0, None
    cg, ch = grad.cumsum(0).cumsum(1), hess.cumsum(0).cumsum(1)
    for i in range(grad.shape[0] - 1):
        for j in range(grad.shape[1] - 1):
            g = np.array([cg[i, j], cg[i, -1] - cg[i, j], cg[-1, j] - cg[i, j], cg[-1, -1] - cg[i, -1] - cg[-1, j] + cg[i, j]])
            h = np.array([ch[i, j], ch[i, -1] - ch[i, j], ch[-1, j] - ch[i, j], ch[-1, -1] - ch[i, -1] - ch[-1, j] + ch[i, j]])
            gain = float((g**2 / (h + l2)).sum())
            if gain > best:
                v = g / (h + l2)
                value = np.empty(grad.shape)
                value[: i + 1, : j + 1], value[: i + 1, j + 1 :], value[i + 1 :, : j + 1], value[i + 1 :, j + 1 :] = v
                best = gain
    return value, best


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, pair_rounds: int = 40, pairs: int = 8, rate: float = 0.1, depth: int = 2, l2: float = 2.0, seed: int = 5) -> Model:
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for f in range(len(FEATURES))]
    coarse = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, PAIR_BINS + 1)[1:-1])) if len(x) else np.zeros(0) for f in range(len(FEATURES))]
    base = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
    m = Model(cuts, coarse, float(np.log(base / (1 - base))), [np.zeros(len(c) + 1) for c in cuts])
    if len(y) < 12 or y.min() == y.max():
        return m
    fine, rough = m.bins(x)
    rng = np.random.default_rng(seed)
    held = np.zeros(len(y), bool)
    held[rng.permutation(len(y))[: len(y) // 6]] = True
    use = ~held
    z = np.full(len(y), m.bias)

    def slopes():
        p = 1 / (1 + np.exp(-z))
        return (y - p) * use, np.maximum(p * (1 - p), 1e-6) * use

    def loss():
        p = np.clip(1 / (1 + np.exp(-z[held])), 1e-6, 1 - 1e-6)
        return -np.mean(y[held] * np.log(p) + (1 - y[held]) * np.log(1 - p))

    best, kept, z_kept = np.inf, None, None
    for _ in range(rounds):
        for f in range(len(FEATURES)):
            g, h = slopes()
            step = rate * _tree(np.bincount(fine[f], g, len(cuts[f]) + 1), np.bincount(fine[f], h, len(cuts[f]) + 1), depth, l2)
            m.tables[f] += step
            z += step[fine[f]]
        if (now := loss()) < best - 1e-6:
            best, kept, z_kept = now, [t.copy() for t in m.tables], z.copy()
    if kept:
        m.tables, z = kept, z_kept
    cell = lambda a, b: rough[a] * PAIR_BINS + rough[b]
    grid = lambda v, a, b: np.bincount(cell(a, b), v, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS)
    g, h = slopes()
    gains = [(_cross(grid(g, a, b), grid(h, a, b), l2)[1], a, b) for a in range(len(FEATURES)) for b in range(a)]
    chosen = [(a, b) for _, a, b in sorted(gains, reverse=True)[:pairs]]
    tables = [np.zeros(PAIR_BINS**2) for _ in chosen]
    kept = [t.copy() for t in tables]
    for _ in range(pair_rounds):
        for t, (a, b) in zip(tables, chosen):
            g, h = slopes()
            step = rate * _cross(grid(g, a, b), grid(h, a, b), l2)[0].ravel()
            t += step
            z += step[cell(a, b)]
        if (now := loss()) < best - 1e-6:
            best, kept = now, [t.copy() for t in tables]
    m.pairs = [(a, b, t) for (a, b), t in zip(chosen, kept)]
    return m


def _sample(batches):
    for b in batches:
        for lo, hi, x in features(b.column(1)):
            yield shared.batch(_ROWS, b.column(0).slice(lo, hi - lo), b.column(2).slice(lo, hi - lo), [r.tobytes() for r in x])


@shared.call
def train(docs: DataFrame, labels: DataFrame, keep: Column, label: str = "quality", sample_rows: int = SAMPLE_ROWS, **params) -> Model:
    """The model fitted on labelled rows whose doc_id satisfies keep."""
    got = labelled_sample(docs, labels, label, keep, sample_rows).mapInArrow(_sample, "doc_id long, y int, x binary").orderBy("doc_id").collect()
    x = np.stack([np.frombuffer(r.x, np.float32) for r in got]) if got else np.zeros((0, len(FEATURES)), np.float32)
    return fit(x, np.array([min(1, max(0, r.y)) for r in got], float), **params)


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "quality") -> DataFrame:
    """docs with a double column out from 0 to 1; a clashing column gives way.

    Null and empty texts score as texts of no bytes, words or lines. Whole texts are read, however long.
    """
    held = shared.Shipped(docs.sparkSession, model)

    def run(column: pa.Array) -> np.ndarray:
        values = np.empty(len(column))
        for lo, hi, x in features(column):
            values[lo:hi] = 1 / (1 + np.exp(-np.clip(held.value.raw(x), -30, 30)))
        return values

    return shared.with_scores(docs.select([c for c in docs.columns if c != out]), text_col, out, run)
