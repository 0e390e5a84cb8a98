"""Toxicity: a factorization machine over hashed terms.

A text is the set of its terms: runs of letters, lower-cased, and the first STEMS bytes of the longer
ones, hashed to 2 ** TERM_BITS buckets. The score is the logistic of bias + linear weights + inner products of the latent vectors of all pairs of
present terms, so that a pair such as an insult and a group mention counts beyond its parts. The
machine is fitted in one task, on a bounded sample of labelled rows; every term of at least three of them has a weight
and a latent vector. Scoring is one pass of the workers with a few MB of weights.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels, shared
from .training import labelled_sample

TERM_BITS = 20
#: lengths in bytes of the word beginnings that are terms too
STEMS = (4, 6)
#: labelled rows at most that the machine is fitted on
SAMPLE_ROWS = 20_000
#: standard deviations between the labels from which a term counts in full, and from which it is fitted first
SURE, CLEAR = 6.0, 2.5
_TERMS = pa.schema([("doc_id", pa.int64()), ("y", pa.int32()), ("terms", pa.binary())])


@dataclass
class Machine:
    """place maps a term bucket to its row of linear and latent, -1 for terms without weight."""

    place: np.ndarray
    bias: float
    linear: np.ndarray
    latent: np.ndarray

    def raw(self, terms: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
        at = self.place[terms]
        at, row = at[at >= 0], row[at >= 0]
        out = self.bias + np.bincount(row, self.linear[at], minlength=rows)
        for f in range(self.latent.shape[1]):
            v = self.latent[at, f]
            out += 0.5 * (np.bincount(row, v, minlength=rows) ** 2 - np.bincount(row, v * v, minlength=rows))
        return out


def text_terms(column: pa.Array):
    """(lo, hi, terms, row): the distinct term buckets of each row of a chunk."""
    for lo, hi, data, offs in kernels.chunks(column):
        data = kernels.lowered(data)
        starts, ends, row = kernels.words(data, offs, kernels.LETTERS)
        spans, rows = [kernels.span_hashes(data, starts, ends, lower=False)], [row]
        for n in STEMS:
            longer = ends - starts > n
            spans.append(kernels.mix(kernels.span_hashes(data, starts[longer], starts[longer] + n, lower=False) + np.uint64(n)))
            rows.append(row[longer])
        h = (np.concatenate(spans) >> np.uint64(64 - TERM_BITS)).astype(np.int64)
        packed = np.unique((np.concatenate(rows) << TERM_BITS) | h)
        yield lo, hi, packed & ((1 << TERM_BITS) - 1), packed >> TERM_BITS


def _said(count: np.ndarray, toxic: np.ndarray, rows: int, positive: float) -> np.ndarray:
    """How many standard deviations the shares of rows with a term differ between the labels."""
    share = np.clip(count / max(1, rows), 1e-9, 1 - 1e-9)
    differ = toxic / max(1.0, positive) - (count - toxic) / max(1.0, rows - positive)
    return np.abs(differ) / np.sqrt(share * (1 - share) * (1 / max(1.0, positive) + 1 / max(1.0, rows - positive)))


def fit(terms: np.ndarray, row: np.ndarray, y: np.ndarray, factors: int = 8, epochs: int = 60, rate: float = 0.2, decay: float = 1e-4, least: int = 3, seed: int = 7) -> Machine:
    """AdaGrad on the logistic loss in fixed batches; one row in eight chooses the epoch.

    Every term that at least `least` rows hold has a weight and a latent vector. A term's input is 1 for terms that tell
    the labels apart by themselves (SURE standard deviations) and falls with the square of what it tells, down to
    1 / sqrt(terms a row): all terms that say nothing alone weigh together as much as one that does. The
    clear terms (CLEAR) are fitted first, then all.
    """
    rows = len(y)
    positive = float(y.sum())
    count = np.bincount(terms, minlength=1 << TERM_BITS)
    z = _said(count, np.bincount(terms, y[row], minlength=1 << TERM_BITS), rows, positive)
    known = np.flatnonzero(count >= least)
    place = np.full(1 << TERM_BITS, -1, np.int32)
    place[known] = np.arange(len(known))
    base = np.clip(y.mean() if rows else 0.5, 1e-3, 1 - 1e-3)
    rng = np.random.default_rng(seed)
    bias = float(np.log(base / (1 - base)))
    linear, latent = np.zeros(len(known)), rng.normal(0, 0.01, (len(known), factors))
    if rows < 8 or positive in (0, rows) or not len(known):
        return Machine(place, bias, linear.astype(np.float32), latent.astype(np.float32))
    at = place[terms]
    some = at >= 0
    row, at = row[some], at[some]
    del some, terms
    scale = np.clip((z[known] / SURE) ** 2, min(1.0, (rows / max(1, len(at))) ** 0.5), 1.0)
    order = rng.permutation(rows)
    held, train = order[: rows // 8], order[rows // 8 :]
    size = int(np.clip(len(train) // 40, 16, 256))
    g_bias, g_lin, g_lat = 1.0, np.ones(len(known)), np.ones(latent.shape)
    best, kept = np.inf, (bias, linear.copy(), latent * 0)

    clear = z[known] > CLEAR
    for use, upto, patience in ((clear, epochs, 8), (np.ones(len(known), bool), *((epochs // 10, 2) if clear.any() else (epochs, 20)))):
        a_all, r_all = (at, row) if use.all() else (at[use[at]], row[use[at]])
        start = np.searchsorted(r_all, np.arange(rows + 1))
        bias, linear, latent = kept[0], kept[1].copy(), np.where(kept[2].any(axis=1)[:, None], kept[2], latent)

        def gather(which):
            n = start[which + 1] - start[which]
            flat = np.repeat(start[which] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            return a_all[flat], np.repeat(np.arange(len(which)), n)

        def forward(a, r, k):
            v = np.take(latent, a, axis=0) * np.take(scale, a)[:, None]
            there, begin = np.unique(r, return_index=True)  # rows in order
            total = np.zeros((k, factors))
            if len(a):
                total[there] = np.add.reduceat(v, begin, axis=0)
            squares = np.bincount(r, np.einsum("ij,ij->i", v, v), minlength=k)
            raw = bias + np.bincount(r, np.take(linear * scale, a), minlength=k) + 0.5 * (np.einsum("ij,ij->i", total, total) - squares)
            return 1 / (1 + np.exp(-np.clip(raw, -30, 30))), v, total

        held_terms, since = gather(held), 0
        for _ in range(upto if len(a_all) else 0):
            rng.shuffle(train)
            for lo in range(0, len(train), size):
                which = train[lo : lo + size]
                a, r = gather(which)
                p, v, total = forward(a, r, len(which))
                e = (p - y[which]) / len(which) * 16
                used = np.flatnonzero(np.bincount(a, minlength=len(known)))
                inv = np.empty(len(known), np.int64)
                inv[used] = np.arange(len(used))
                inv = inv[a]
                lin = np.bincount(inv, e[r], minlength=len(used)) * scale[used] + decay * linear[used]
                by_pair = e[r][:, None] * (total[r] - v)
                lat = np.stack([np.bincount(inv, by_pair[:, f], minlength=len(used)) for f in range(factors)], axis=1) * scale[used][:, None] + decay * latent[used]
                g_lin[used] += lin**2
                g_lat[used] += lat**2
                linear[used] -= rate * lin / np.sqrt(g_lin[used])
                latent[used] -= rate * lat / np.sqrt(g_lat[used])
                g_bias += e.sum() ** 2
                bias -= rate * e.sum() / np.sqrt(g_bias)
            p = np.clip(forward(*held_terms, len(held))[0], 1e-6, 1 - 1e-6)
            loss = -np.mean(y[held] * np.log(p) + (1 - y[held]) * np.log(1 - p))
            since += 1
            if loss < best:
                best, kept, since = loss, (bias, linear.copy(), latent * use[:, None]), 0
            if since >= patience:
                break
    bias, linear, latent = kept
    return Machine(place, bias, (linear * scale).astype(np.float32), (latent * scale[:, None]).astype(np.float32))


def _sample_terms(batches):
    for b in batches:
        ids, y = b.column(0), b.column(2)
        for lo, hi, terms, row in text_terms(b.column(1)):
            cut = np.searchsorted(row, np.arange(hi - lo + 1))
            yield shared.batch(_TERMS, ids.slice(lo, hi - lo), y.slice(lo, hi - lo), [terms[cut[k] : cut[k + 1]].astype(np.int32).tobytes() for k in range(hi - lo)])


def _fitted(params):
    """The machine of all rows of a task, pickled."""

    def run(batches):
        terms, y = [], []
        for b in batches:
            terms += [np.frombuffer(t, np.int32) for t in b.column(2).to_pylist()]
            y += b.column(1).to_pylist()
        row = np.repeat(np.arange(len(terms), dtype=np.int32), [len(t) for t in terms])
        flat = np.concatenate(terms) if terms else np.zeros(0, np.int32)
        terms.clear()
        machine = fit(flat, row, np.clip(np.array(y, float), 0, 1), **params)
        yield pa.RecordBatch.from_arrays([pa.array([cloudpickle.dumps(machine)], pa.binary())], names=["machine"])

    return run


@shared.call
def train(docs: DataFrame, labels: DataFrame, keep: Column, label: str = "toxic", sample_rows: int = SAMPLE_ROWS, **params) -> Machine:
    """The machine fitted on labelled rows whose doc_id satisfies keep: at most sample_rows, brought to one task by their terms."""
    sample = labelled_sample(docs, labels, label, keep, sample_rows).mapInArrow(_sample_terms, "doc_id long, y int, terms binary")
    rows = sample.repartition(1).sortWithinPartitions("doc_id").mapInArrow(_fitted(params), "machine binary").collect()
    return cloudpickle.loads(rows[0].machine) if rows else fit(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), **params)


def score(docs: DataFrame, machine: Machine, text_col: str = "text", out: str = "toxicity") -> DataFrame:
    """docs with a double column out from 0 to 1; a clashing column gives way.

    Null and empty texts have no terms and get the bias's score. Whole texts are read, however long.
    """
    model = shared.Shipped(docs.sparkSession, machine)
    kept = docs.select([c for c in docs.columns if c != out])

    def run(column: pa.Array) -> np.ndarray:
        values = np.empty(len(column))
        for lo, hi, terms, row in text_terms(column):
            values[lo:hi] = 1 / (1 + np.exp(-np.clip(model.value.raw(terms, row, hi - lo), -30, 30)))
        return values

    return shared.with_scores(kept, text_col, out, run)


def keep_civil(docs: DataFrame, machine: Machine, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """docs without the rows that score at or above threshold, with the same columns."""
    name = "__prismfold_score"
    return score(docs, machine, text_col, name).where(F.col(name) < threshold).drop(name)
