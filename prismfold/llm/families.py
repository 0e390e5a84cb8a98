"""Candidate pairs to verified components, in blocks of bounded size, and fixed-size key filters.

A family is a component of the candidate graph. Its members come together with their texts in blocks
of at most BLOCK sets on the average; two blocks meet in one task for each pair of blocks, so that no
family lands in one task and no pair of a family is lost.

Loose candidates (bands) chain unlike sets to families that grow faster than the input. Of a loose family of
more than LOOSE sets, those that may link are found first, none lost: sets that link share a shingle of their prefixes, which
start with the shingles that are rare in such families.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels, shared
from .components import components

BLOCK = 2048
#: groups of at most so many sets are verified together
SMALL = 12
#: log2 of a key filter's bits: 4 MB at any corpus size; a full filter lets more rows into the exact join
FILTER_BITS = 25
FILTER_PART = 1 << 17

#: loose families of more sets than this are split into the sets that may link
LOOSE = 256
#: log2 of the counters by which shingles are ordered: 4 MB at any corpus size; shingles that share one keep a common order
RARITY_BITS = 19
RARITY_PART = 1 << 14
#: prefix keys that are sent on together
_LOT = 200_000
MAP_WORDS = 4

_BITS = pa.schema([("part", pa.int32()), ("bits", pa.binary())])
_TALLY = pa.schema([("part", pa.int32()), ("counts", pa.binary())])
POSTINGS = pa.schema([("part", pa.int32()), ("keys", pa.binary()), ("at", pa.binary()), ("nodes", pa.binary()), ("sizes", pa.binary()), ("maps", pa.binary())])
EDGE = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def ddl(schema: pa.Schema) -> str:
    names = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def _places(keys: np.ndarray):
    h = kernels.mix(keys.astype(np.int64).view(np.uint64))
    return ((h >> np.uint64(s)).astype(np.int64) & ((1 << FILTER_BITS) - 1) for s in (0, 32))


def _bits(batches):
    bits = np.zeros(1 << FILTER_BITS, bool)
    for b in batches:
        for at in _places(b.column(0).drop_null().to_numpy(zero_copy_only=False)):
            bits[at] = True
    if bits.any():
        rows = np.packbits(bits).reshape(-1, FILTER_PART)
        some = np.flatnonzero(rows.any(axis=1))
        yield shared.batch(_BITS, some.astype(np.int32), [rows[k].tobytes() for k in some])


def _or(batches):
    held: dict[int, np.ndarray] = {}
    for b in batches:
        for part, bits in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            held[part] = held.get(part, np.uint8(0)) | np.frombuffer(bits, np.uint8)
    if held:
        yield shared.batch(_BITS, np.array(list(held), np.int32), [v.tobytes() for v in held.values()])


def members(df: DataFrame, key: str):
    """A broadcast Bloom filter of df's keys (two hashes, 2 ** FILTER_BITS bits)."""
    parts = df.select(F.col(key).cast("long").alias("k")).mapInArrow(_bits, "part int, bits binary")
    parts = parts.repartition(32, "part").mapInArrow(_or, "part int, bits binary")
    bits = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for r in parts.collect():
        bits[r.part * FILTER_PART : (r.part + 1) * FILTER_PART] |= np.frombuffer(r.bits, np.uint8)
    return shared.broadcast(df.sparkSession, bits)


def in_filter(keys: np.ndarray, bits: np.ndarray) -> np.ndarray:
    ok = np.ones(len(keys), bool)
    for at in _places(keys):
        ok &= (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
    return ok


def having_any(df: DataFrame, keys, filter_) -> DataFrame:
    """df's rows that may have one of the filter's keys in one of several columns (no nulls)."""
    places = [df.columns.index(k) for k in keys]

    def run(batches):
        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            for p in places:
                keep |= in_filter(b.column(p).to_numpy(zero_copy_only=False), filter_.value)
            if keep.any():
                yield b.filter(pa.array(keep))

    return df.mapInArrow(run, df.schema)


def having(df: DataFrame, key: str, filter_, others: bool = False) -> DataFrame:
    """df's rows whose key may be in the filter (or the others): what an exact join of a few keys need not shuffle."""
    place = df.columns.index(key)

    def run(batches):
        for b in batches:
            known = b.column(place).is_valid().to_numpy(zero_copy_only=False)
            keep = (known & in_filter(b.column(place).fill_null(0).to_numpy(zero_copy_only=False), filter_.value)) != others
            if keep.any():
                yield b.filter(pa.array(keep))

    return df.mapInArrow(run, df.schema)


def may_link(na, nb, maps_a, maps_b, percent):
    """Sizes and parity maps allow Jaccard >= percent / 100."""
    small, large = np.minimum(na, nb), np.maximum(na, nb)
    differ = np.bitwise_count(maps_a ^ maps_b).sum(axis=-1, dtype=np.int64)
    return (100 * small >= percent * large) & (differ * (100 + percent) <= (100 - percent) * (na + nb))


def prefix_sizes(n: np.ndarray, percent: int) -> np.ndarray:
    return np.where(n > 0, n + (-n * percent // 100) + 1, 0)


def dealt(part, parts, *columns):
    """(part, column values of its items...) for each part that has items."""
    order = np.argsort(part, kind="stable")
    cut = np.searchsorted(part[order], np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(cut)):
        sel = order[cut[p] : cut[p + 1]]
        yield int(p), *[c[sel] for c in columns]


def _bucket_edges(size, maps, group, percent):
    """Forest edges (as places) of the pairs in one large bucket (by size) that may link, besides what group connects already:
    pairs of one group need no look, so that near copies cost a few rows and not their square."""
    group = group.copy()
    left = len(np.unique(group))
    stop = np.searchsorted(size, size * 100 // percent, side="right")
    us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for r in range(len(size)):
        if left == 1:
            break
        near = np.flatnonzero(group[r + 1 : stop[r]] != group[r]) + r + 1
        near = near[may_link(size[r], size[near], maps[r], maps[near], percent)]
        if len(near):
            other, first = np.unique(group[near], return_index=True)
            us.append(np.full(len(other), r))
            vs.append(near[first])
            group[np.isin(group, other)] = group[r]
            left -= len(other)
    return np.concatenate(us), np.concatenate(vs)


def bucket_pairs(percent):
    def run(batches):
        held = [[] for _ in range(5)]
        base = 0
        for b in batches:
            for keys, at, nodes, sizes, maps in zip(*(b.column(k).to_pylist() for k in range(1, 6))):
                held[0].append(np.frombuffer(keys, np.uint64))
                held[1].append(np.frombuffer(at, np.uint32).astype(np.int64) + base)
                held[2].append(np.frombuffer(nodes, np.int64))
                held[3].append(np.frombuffer(sizes, np.int64))
                held[4].append(np.frombuffer(maps, np.uint64).reshape(-1, MAP_WORDS))
                base += len(held[2][-1])
        if not base:
            return
        keys, at, nodes, sizes, maps = map(np.concatenate, held)
        order = np.lexsort((at, keys))
        keys, at = keys[order], at[order]
        bounds = kernels.unique_spans(keys)
        length = np.diff(bounds)
        us, vs = [], []
        names, who = np.unique(nodes, return_inverse=True)
        group = np.arange(len(names))  # what the buckets so far connect
        for k in np.flatnonzero(length > 64):
            own = at[bounds[k] : bounds[k + 1]]
            own = own[np.argsort(sizes[own], kind="stable")]
            i, j = _bucket_edges(sizes[own], maps[own], group[who[own]], percent)
            if len(i):
                us.append(own[i])
                vs.append(own[j])
                old, new = kernels.forest(group[who[own[i]]], group[who[own[j]]])
                turn = np.arange(len(names))
                turn[old] = new
                group = turn[group]
        left = np.repeat(np.where(length > 64, 0, length), length) - (np.arange(len(keys)) - np.repeat(bounds[:-1], length))
        for step in range(1, 64):
            i = np.flatnonzero(left > step)
            if not len(i):
                break
            a, b = at[i], at[i + step]
            for lo in range(0, len(a), 1 << 18):
                x, y = a[lo : lo + (1 << 18)], b[lo : lo + (1 << 18)]
                ok = may_link(sizes[x], sizes[y], maps[x], maps[y], percent)
                us.append(x[ok])
                vs.append(y[ok])
        if not us:
            return
        u, v = nodes[np.concatenate(us)], nodes[np.concatenate(vs)]
        if len(u):
            u, v = kernels.forest(u, v)
            for k in range(0, len(u), 100_000):
                yield shared.batch(EDGE, u[k : k + 100_000], v[k : k + 100_000])

    return run


def _overlaps(probe, ids, bounds, which):
    """Intersection sizes of one sorted set with the sets at which."""
    n = bounds[which + 1] - bounds[which]
    flat = np.repeat(bounds[which] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    values = ids[flat]
    place = np.searchsorted(probe, values)
    hit = probe[np.minimum(place, len(probe) - 1)] == values
    total = np.concatenate([[0], np.cumsum(hit)])
    cut = np.concatenate([[0], np.cumsum(n)])
    return total[cut[1:]] - total[cut[:-1]]


def verified_links(sizes, ids, bounds, maps, prefixes, left, right, percent):
    """Forest edges (places) of the links between two groups of rows (or within one), none lost.

    Rows are tried by falling number of possible partners in a sample, so that a hub comes first; a pair
    whose ends are connected already needs no look.
    """
    parent = np.arange(len(sizes))
    us, vs = [], []
    some = right[:: max(1, len(right) // 64)]
    partners = np.concatenate([may_link(sizes[r][:, None], sizes[some], maps[r][:, None], maps[some], percent).sum(axis=1) for r in np.split(left, range(1024, len(left), 1024))])
    rest = np.zeros(len(sizes), bool)
    rest[right] = True
    for r in left[np.argsort(-partners, kind="stable")]:
        rest[r] = False  # of one group, each pair once
        near = right[rest[right] & (parent[right] != parent[r])]
        near = near[may_link(sizes[r], sizes[near], maps[r], maps[near], percent)]
        if not len(near):
            continue
        for keys, cut in prefixes:
            near = near[_overlaps(keys[cut[r] : cut[r + 1]], keys, cut, near) > 0]
            if not len(near):
                break
        if not len(near):
            continue
        common = _overlaps(ids[bounds[r] : bounds[r + 1]], ids, bounds, near)
        linked = near[100 * common >= percent * (sizes[r] + sizes[near] - common)]
        if len(linked):
            roots = np.unique(np.append(parent[linked], parent[r]))
            parent[np.isin(parent, roots[1:])] = roots[0]
            us.append(np.full(len(linked), r))
            vs.append(linked)
    if not us:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(us), np.concatenate(vs)


def _pair_overlaps(ids, bounds, a, b):
    """Intersection sizes of the sorted sets at places a and b, pair by pair."""
    out = np.zeros(len(a), np.int64)
    size = np.diff(bounds)
    for lo in range(0, len(a), 512):
        x, y = a[lo : lo + 512], b[lo : lo + 512]
        which = np.concatenate([x, y])
        n = size[which]
        pair = np.repeat(np.tile(np.arange(len(x)), 2), n)
        flat = np.repeat(bounds[which] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        packed = np.sort((pair.astype(np.uint64) << np.uint64(kernels.ID_BITS)) | ids[flat])
        twice = packed[1:][packed[1:] == packed[:-1]] >> np.uint64(kernels.ID_BITS)
        out[lo : lo + len(x)] = np.bincount(twice.astype(np.int64), minlength=len(x))
    return out


def _small_pairs(start, stop, side):
    """All pairs (within one block, or across two) of each small group of places."""
    us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for step in range(1, int((stop - start).max(initial=0))):
        own = stop - start > step
        n = (stop - start)[own] - step
        u = np.repeat(start[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        us.append(u)
        vs.append(u + step)
    return np.concatenate(us), np.concatenate(vs)


def _verify(sets_of, percent, filters, node_of):
    """Links of whole groups of rows (component, i, j, side, node, text), many small groups at a time."""

    def links(group, side, nodes, text):
        sets, place = [], []
        for lo, hi, ids, bounds in sets_of(text):
            there = np.diff(bounds) > 0
            if node_of:  # a row that shares the key of the set meant, but not the set, stays out
                there &= node_of(ids, bounds) == nodes[lo:hi]
            at = np.flatnonzero(there)
            sets += [ids[bounds[k] : bounds[k + 1]] for k in at]
            place.append(lo + at)
        place = np.concatenate(place) if place else np.zeros(0, np.int64)
        if len(place) < 2:
            return None
        order = np.lexsort((nodes[place], side[place], group[place]))
        place = place[order]
        g, d, n = group[place], side[place], nodes[place]
        once = np.append(True, (g[1:] != g[:-1]) | (d[1:] != d[:-1]) | (n[1:] != n[:-1]))
        place, g, d, n = place[once], g[once], d[once], n[once]
        sets = [sets[k] for k in order[once]]
        sizes = np.array([len(s) for s in sets], np.int64)
        bounds, ids = np.concatenate([[0], np.cumsum(sizes)]), np.concatenate(sets)
        maps = parity_maps(ids, bounds)
        cut = kernels.unique_spans(g)
        start, stop = cut[:-1], cut[1:]
        small = stop - start <= SMALL
        u, v = _small_pairs(start[small], stop[small], d)
        crossed = np.zeros(len(g), bool)
        crossed[d == 1] = True
        across = np.maximum.reduceat(crossed, start)[np.repeat(np.arange(len(start)), stop - start)] if len(start) else crossed
        ok = (~across[u] | (d[u] != d[v])) & may_link(sizes[u], sizes[v], maps[u], maps[v], percent)
        u, v = u[ok], v[ok]
        for keys, at in filters(ids, bounds) if filters and len(u) else []:
            ok = _pair_overlaps(keys, at, u, v) > 0
            u, v = u[ok], v[ok]
        common = _pair_overlaps(ids, bounds, u, v)
        ok = 100 * common >= percent * (sizes[u] + sizes[v] - common)
        us, vs = [n[u[ok]]], [n[v[ok]]]
        for k in np.flatnonzero(~small):
            own = slice(bounds[start[k]], bounds[stop[k]])
            b, here = bounds[start[k] : stop[k] + 1] - bounds[start[k]], d[start[k] : stop[k]]
            left, right = np.flatnonzero(here == 0), np.flatnonzero(here == 1)
            right = right if len(right) else left
            x, y = verified_links(sizes[start[k] : stop[k]], ids[own], b, maps[start[k] : stop[k]], filters(ids[own], b) if filters else [], left, right, percent)
            us.append(n[start[k] + x])
            vs.append(n[start[k] + y])
        u, v = np.concatenate(us), np.concatenate(vs)
        return kernels.forest(u, v) if len(u) else None

    def run(batches):
        held: list[pa.RecordBatch] = []
        rows = 0

        def flush(table, upto):
            part = table.slice(0, upto).combine_chunks()
            key = [part.column(c).to_numpy() for c in ("component", "i", "j")]
            new = np.append(True, np.any([k[1:] != k[:-1] for k in key], axis=0)) if upto else np.zeros(0, bool)
            text = part.column("text")
            found = links(np.cumsum(new), part.column("side").to_numpy(), part.column("node").to_numpy(), text.combine_chunks() if isinstance(text, pa.ChunkedArray) else text)
            if found is not None:
                yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64())], names=["u", "v"])

        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            rows += b.num_rows
            if rows < 4000:
                continue
            table = pa.Table.from_batches(held)
            key = [table.column(c).to_numpy() for c in ("component", "i", "j")]
            new = np.flatnonzero(np.any([k[1:] != k[:-1] for k in key], axis=0)) + 1
            if len(new):  # the last group may go on in the next batch
                yield from flush(table, int(new[-1]))
                table = table.slice(int(new[-1]))
            held, rows = table.to_batches(), table.num_rows
        if rows:
            yield from flush(pa.Table.from_batches(held), rows)

    return run


def parity_maps(ids, bounds) -> np.ndarray:
    """Four 64-bit words for each set: bit k is the parity of its ids that are k modulo 256."""
    n = len(bounds) - 1
    row = np.repeat(np.arange(n), np.diff(bounds))
    odd = np.bincount(row * 256 + (ids & np.uint64(255)).astype(np.int64), minlength=256 * n) & 1
    return np.packbits(odd.astype(bool).reshape(n, 256), axis=1).view(np.uint64)


def _cells(ids: np.ndarray) -> np.ndarray:
    return (kernels.mix(ids) >> np.uint64(64 - RARITY_BITS)).astype(np.int64)


def _tally(sets_of):
    """A task's number of sets for each counter."""

    def run(batches):
        counts = np.zeros(1 << RARITY_BITS, np.int64)
        for b in batches:
            for _, _, ids, _ in sets_of(b.column(0)):
                counts += np.bincount(_cells(ids), minlength=len(counts))
        rows = counts.reshape(-1, RARITY_PART)
        some = np.flatnonzero(rows.any(axis=1))
        if len(some):
            yield shared.batch(_TALLY, some.astype(np.int32), [rows[k].tobytes() for k in some])

    return run


def _sum(batches):
    held: dict[int, np.ndarray] = {}
    for b in batches:
        for part, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            held[part] = held.get(part, 0) + np.frombuffer(counts, np.int64)
    if held:
        yield shared.batch(_TALLY, np.array(list(held), np.int32), [v.tobytes() for v in held.values()])


def _rarity(texts: DataFrame, sets_of):
    """Broadcast counters of the sets that hold a shingle (several shingles share one)."""
    parts = texts.select("text").mapInArrow(_tally(sets_of), ddl(_TALLY)).repartition(32, "part").mapInArrow(_sum, ddl(_TALLY))
    counts = np.zeros(1 << RARITY_BITS, np.int64)
    for r in parts.collect():
        counts[r.part * RARITY_PART : (r.part + 1) * RARITY_PART] += np.frombuffer(r.counts, np.int64)
    return shared.broadcast(texts.sparkSession, counts)


def _rare_prefixes(sets_of, percent, counts, parts):
    """Prefixes (rare shingles first) of rows (component, node, text), by shingle and component."""

    def flush(keys, at, nodes, sizes, maps):
        base = np.cumsum([0, *map(len, nodes)])
        at = np.concatenate([a + s for a, s in zip(at, base)])
        keys, nodes, sizes, maps = map(np.concatenate, (keys, nodes, sizes, maps))
        out = [[] for _ in POSTINGS]
        for p, k, a in dealt((keys % np.uint64(parts)).astype(np.int64), parts, keys, at):
            used, own = np.unique(a, return_inverse=True)
            for column, value in zip(out, (p, k.tobytes(), own.astype(np.uint32).tobytes(), nodes[used].tobytes(), sizes[used].tobytes(), maps[used].tobytes())):
                column.append(value)
        return shared.batch(POSTINGS, *out)

    def run(batches):
        held, size = [], 0
        for b in batches:
            components_, nodes = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for lo, hi, ids, bounds in sets_of(b.column(2)):
                n = np.diff(bounds)
                row = np.repeat(np.arange(len(n)), n)
                rank = kernels.mix(ids)
                order = np.lexsort((rank, counts.value[_cells(ids)], row))
                keep = np.arange(len(ids)) - np.repeat(bounds[:-1], n) < np.repeat(prefix_sizes(n, percent), n)
                at = row[keep]
                keys = kernels.mix(rank[order][keep] ^ kernels.mix(components_[lo:hi].view(np.uint64))[at])
                held.append((keys, at, nodes[lo:hi], n, parity_maps(ids, bounds)))
                size += len(keys)
                if size > _LOT:
                    yield flush(*zip(*held))
                    held, size = [], 0
        if size:
            yield flush(*zip(*held))

    return run


def _counted(fam: DataFrame, above: int) -> DataFrame:
    """fam with the size n of each row's family, 1 for families of at most so many rows."""
    large = fam.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > above)
    return fam.join(large, "component", "left").select("component", "node", F.coalesce("n", F.lit(1)).alias("n"))


def _closer(member: DataFrame, sets_of, percent: int) -> DataFrame:
    """(component, node, n) of smaller families: of the rows (component, node, text), those that may link to another of their component."""
    parts = shared.partitions(member.sparkSession)
    posts = member.select("component", "node", "text").mapInArrow(_rare_prefixes(sets_of, percent, _rarity(member, sets_of), parts), ddl(POSTINGS))
    fam = components(posts.repartition(parts, "part").mapInArrow(bucket_pairs(percent), ddl(EDGE)), smallest=False)
    fam = shared.written(fam.unionAll(fam.select("component", "component").distinct()))
    return shared.written(_counted(fam, BLOCK))


def verified_components(edges: DataFrame, texts, sets_of, percent: int, filters=None, node_of=None, loose: bool = False) -> DataFrame:
    """(node, component: any one node of it) of the pairs within candidate families whose sets have Jaccard >= percent / 100.

    texts maps a frame with a column node to that frame with a column text; sets_of yields the sets
    of a text column; filters gives prefix arrays of further orders, all of which a pair must share. loose: candidates need not
    be close, and large families are split first; the links are the same.
    """
    fam = components(edges, smallest=False)
    fam = shared.written(fam.unionAll(fam.select("component", "component").distinct()))
    member = texts(shared.written(_counted(fam, LOOSE if loose else BLOCK))).select("component", "node", "n", "text")
    if loose:
        member = shared.written(member)
    if loose and (wide := member.where(F.col("n") > LOOSE)).take(1):
        closer = _closer(wide, sets_of, percent)
        wide = having(wide.select("node", "text"), "node", members(closer, "node")).join(closer, "node")
        member = member.where(F.col("n") <= LOOSE).unionAll(wide.select("component", "node", "n", "text"))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    member = member.withColumn("b", F.pmod(F.xxhash64("node"), blocks).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), blocks - 1), lambda o: F.struct(F.least("b", o).alias("i"), F.greatest("b", o).alias("j"), F.when(o < F.col("b"), 1).otherwise(0).alias("side")))
    member = member.select("component", "node", "text", F.explode(pairs).alias("p")).select("component", "p.i", "p.j", "p.side", "node", "text")
    groups = member.repartition(shared.partitions(edges.sparkSession), "component", "i", "j").sortWithinPartitions("component", "i", "j")
    linked = components(groups.mapInArrow(_verify(sets_of, percent, filters, node_of), "u long, v long"), smallest=False)
    return linked.unionAll(linked.select("component", "component").distinct())
