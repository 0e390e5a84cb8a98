"""Connected components of an edge table that never leaves the executors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels, shared

_EDGE = pa.schema([("u", pa.int64()), ("v", pa.int64())])
_SETTLED = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("up", pa.bool_())])
_ROWS = 100_000


def _order(level: int):
    """A hash order of the nodes, another one at each level, so that paths and hubs of any shape shrink."""
    turn = np.uint64(0x9E3779B97F4A7C15 * (2 * level + 1) & (1 << 64) - 1)
    return lambda nodes: kernels.mix(nodes.view(np.uint64) + turn)


def _contract(level):
    """Each task's edges as stars onto the first node of each component it can see, and those first nodes onto themselves."""

    def run(batches):
        held, total, order = [], 0, _order(level)
        for b in batches:
            held.append(tuple(b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)))
            total += b.num_rows
            if total > 2_000_000:
                held = [kernels.forest(*map(np.concatenate, zip(*held)), order)]
                total = len(held[0][0])
        if total:
            u, v = kernels.forest(*map(np.concatenate, zip(*held)), order)
            roots = np.unique(v)
            u, v = np.concatenate([u, roots]), np.concatenate([v, roots])
            for k in range(0, len(u), _ROWS):
                yield shared.batch(_EDGE, u[k : k + _ROWS], v[k : k + _ROWS])

    return run


def _settle(level):
    """With all stars of a node at hand: a node that is nowhere a root takes the first of its roots, and its
    others are linked to that one; the edges of a node that is a root elsewhere go up to the next level."""

    def run(batches):
        held = [tuple(b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)) for b in batches if b.num_rows]
        if not held:
            return
        u, v = map(np.concatenate, zip(*held))
        order = np.lexsort((_order(level)(v), u))
        u, v = u[order], v[order]
        cut = kernels.unique_spans(u)
        which = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
        root = np.bincount(which, u == v, minlength=len(cut) - 1) > 0
        first = v[cut[:-1]]
        leaf = ~root
        link = leaf[which] & (v != first[which])
        edge = root[which] & (u != v)
        us = [u[cut[:-1]][leaf], v[link], u[edge]]
        vs = [first[leaf], first[which][link], v[edge]]
        up = np.repeat([False, True, True], [len(x) for x in us])
        us, vs = np.concatenate(us), np.concatenate(vs)
        for k in range(0, len(us), _ROWS):
            yield shared.batch(_SETTLED, us[k : k + _ROWS], vs[k : k + _ROWS], up[k : k + _ROWS])

    return run


def components(edges: DataFrame, u: str = "u", v: str = "v", smallest: bool = True) -> DataFrame:
    """(node, component): for every node with an edge to another, the smallest node it reaches.

    Level by level: a union-find inside each task turns its edges into stars (no hub sends more than one row
    a task), one shuffle brings a node's stars together, and what is left between roots is the graph of the
    next level. Its nodes are roots only, and fewer each time: the first node of a component under the level's order can be
    a root, its last cannot. The levels' tables are then joined from the top. Each is written to the
    shared folder, so a lost executor costs one step. Without smallest, the component of
    a node is any one node of its component, and nodes without a row are the components themselves. Null ends and
    loops are ignored; an empty table gives an empty one.
    """
    parts = shared.partitions(edges.sparkSession)
    e = edges.select(F.col(u).cast("long").alias("u"), F.col(v).cast("long").alias("v")).where("u <> v")
    levels: list[DataFrame] = []
    while True:
        k = len(levels)
        stars = e.mapInArrow(_contract(k), "u long, v long").repartition(parts, "u")
        t = shared.written(stars.mapInArrow(_settle(k), "u long, v long, up boolean"))
        levels.append(t.where("not up").select("u", "v"))
        e = t.where("up").select("u", "v")
        if not e.take(1):
            break
    out = levels.pop()
    while levels:
        top = out.toDF("r", "w")
        out = levels.pop().join(top, F.col("v") == F.col("r"), "left").select("u", F.coalesce("w", "v").alias("v")).unionAll(top)
        out = shared.written(out)
    if not smallest:
        return out.select(F.col("u").alias("node"), F.col("v").alias("component"))
    least = out.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
    named = out.join(least, "v").where("u <> m").select(F.col("u").alias("node"), F.col("m").alias("component"))
    return named.unionAll(least.where("v <> m").select(F.col("v").alias("node"), F.col("m").alias("component")))
