"""Embedding near-dedup: int8 tile products with rigorous error bounds, doubtful pairs recomputed in double.

Vectors of one label are dealt to blocks of about TILE vectors; each pair of blocks is one task, so a
label of any size is spread and no pair is left out. In a tile every unit vector x is s q + e with int8 q.
|x.y - s_x s_y q_x.q_y| <= |s_x q_x| |e_y| + |e_x| |s_y q_y| + |e_x| |e_y| holds for each pair; only
pairs whose quantised cosine plus this bound (and SLACK for rounding) reaches the threshold are computed
again from the original components in double precision. Products of int8 run in float32, which is
exact below 2 ** 24.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels, shared
from .components import components

TILE = 2048
SLACK = 1e-9
_LINKS = pa.schema([("u", pa.int64()), ("n", pa.int64()), ("v", pa.int64())])


def quantised(x: np.ndarray):
    """int8 values, scales, norms of the quantised vectors and of their errors, for unit rows."""
    scale = np.abs(x).max(axis=1) / 127
    q = np.rint(x / scale[:, None]).astype(np.int8)
    back = q * scale[:, None]
    return q, scale, np.linalg.norm(back, axis=1), np.linalg.norm(x - back, axis=1)


def tile_links(x: np.ndarray, y: np.ndarray | None, threshold: float):
    """Places (i, j) of all pairs of rows of x and y (or i < j of x) with cosine >= threshold."""
    same = y is None
    y = x if same else y
    nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    qx, sx, bx, ex = quantised(x / nx[:, None])
    qy, sy, by, ey = quantised(y / ny[:, None])
    step = (1 << 24) // (127 * 127)  # longer vectors are summed in exact pieces
    found_i, found_j = [], []
    for lo in range(0, len(x), 512):
        hi = min(lo + 512, len(x))
        dots = np.zeros((hi - lo, len(y)))
        for d in range(0, x.shape[1], step):
            dots += qx[lo:hi, d : d + step].astype(np.float32) @ qy[:, d : d + step].astype(np.float32).T
        bound = bx[lo:hi, None] * ey[None, :] + ex[lo:hi, None] * (by + ey)[None, :]
        i, j = np.nonzero(dots * sx[lo:hi, None] * sy[None, :] + bound >= threshold - SLACK)
        i += lo
        if same:
            i, j = i[i < j], j[i < j]
        for k in range(0, len(i), 1 << 16):
            a, b = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
            ok = np.einsum("ij,ij->i", x[a], y[b]) / (nx[a] * ny[b]) >= threshold
            found_i.append(a[ok])
            found_j.append(b[ok])
    if not found_i:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_i), np.concatenate(found_j)


def _tile(threshold):
    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        ids, side = group.column("vec_id").to_numpy(), group.column("side").to_numpy()
        vectors = [np.frombuffer(v, "<f8") for v in group.column("v").to_pylist()]
        us, vs = [], []
        for width in sorted({len(v) for v in vectors}):  # vectors of different lengths have no cosine
            own = np.array([k for k, v in enumerate(vectors) if len(v) == width])
            left, right = own[side[own] == 0], own[side[own] == 1]
            x = np.stack([vectors[k] for k in left]) if len(left) else None
            if x is None or len(left) + len(right) < 2:
                continue
            one = group.column("i")[0].as_py() == group.column("j")[0].as_py()
            if not one and not len(right):
                continue
            i, j = tile_links(x, None if one else np.stack([vectors[k] for k in right]), threshold)
            us.append(ids[left[i]])
            vs.append(ids[left[j]] if one else ids[right[j]])
        u = np.concatenate(us) if us else np.zeros(0, np.int64)
        v = np.concatenate(vs) if vs else np.zeros(0, np.int64)
        u, v = u[u != v], v[u != v]
        node, n = np.unique(np.concatenate([u, v]), return_counts=True)
        root = node.copy()
        if len(u):
            a, b = kernels.forest(u, v)
            root[np.searchsorted(node, a)] = b
        return pa.table({"u": node.astype(np.int64), "n": n.astype(np.int64), "v": root.astype(np.int64)})

    return run


def scaled(v: np.ndarray) -> np.ndarray:
    """v times the power of two that brings its largest component to between 1/2 and 1: exact, and no norm overflows or vanishes."""
    return np.ldexp(v, -np.frexp(np.abs(v).max())[1]).astype("<f8")


def _usable(batches):
    """Rows whose vectors can link, as packed doubles."""
    for b in batches:
        rows = [(i, lab, v) for i, lab, v in zip(*(b.column(k).to_pylist() for k in range(3))) if v and None not in v]
        packed = [(i, lab, scaled(a)) for i, lab, v in rows if np.isfinite(a := np.array(v, "<f8")).all() and a.any()]
        if packed:
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in packed], pa.int64()), pa.array([p[1] for p in packed], b.schema.field(1).type), pa.array([p[2].tobytes() for p in packed], pa.binary())], names=["vec_id", "label", "v"])


@shared.call
def embedding_near_dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    Only vectors of the same non-null label link, at cosine >= threshold in double precision. Null,
    empty and zero vectors, and those with null or non-finite components, link with nothing; nor do
    vectors of different lengths. Magnitudes do not matter: vectors are scaled by powers of two first. A null id has no links, a null component and is not kept. Rows that
    share an id count as one in components, and each has the sum of their links to other ids. Other
    columns are ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    label_type = rows.schema["label"].dataType.simpleString()
    use = shared.written(rows.where("vec_id is not null and label is not null and v is not null").mapInArrow(_usable, f"vec_id long, label {label_type}, v binary"))
    blocks = use.groupBy("label").count().select("label", F.ceil(F.col("count") / TILE).cast("int").alias("blocks"))
    dealt = use.join(blocks, "label").withColumn("b", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("b", o).alias("i"), F.greatest("b", o).alias("j"), F.when(o < F.col("b"), 1).otherwise(0).alias("side")))
    tiles = dealt.select("label", "vec_id", "v", F.explode(pairs).alias("p")).select("label", "p.i", "p.j", "p.side", "vec_id", "v")
    links = shared.written(tiles.groupBy("label", "i", "j").applyInArrow(_tile(threshold), "u long, n long, v long"))
    counts = links.groupBy("u").agg(F.sum("n").alias("n"))
    found = counts.join(components(links).withColumnRenamed("node", "u"), "u", "left").select(F.col("u").alias("vec_id"), "n", "component")
    out = rows.select("vec_id").join(found, "vec_id", "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id"))
    return shared.lasting(out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept")))
