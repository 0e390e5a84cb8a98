"""Valid-time enrichment of sales by a stateful stream: every sale gets its client's version of the time it was sold.

Segment ownership. A version's segment reaches from its valid time to that of the client's next version and owns the sales
that wait in this span. A new version splits the segment it falls into, the horizon H drains the sales it has passed,
pruning deletes versions whose successor H has passed as well and whose segments are therefore empty. State is a
MapState of blocks: neighbouring segments, each version followed by its waiting sales, some thousand rows an entry. (One entry
a segment took 13,700 CPU seconds a GB, nearly all of it for single calls to the state server.)

Hot clients. Clients with more than a small part of all rows, of which there are 2 * buckets at most, have their time lines cut
into slots of slot_seconds, which are dealt to buckets like clients of their own; a bucket is one key of the stream. A
slot knows its own versions only. For what crosses slots every start reports what each slot of a hot client holds (its last
version, their number): a sale in front of its slot's first version takes the last version of the slots before, found by
running maxima over the slots of a day and over the days of a client, both bounded by the time span; slots that H
and a later slot's version have passed are cleared at the next start.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from . import shared

BATCHES, FIRST_DAY, DAYS = 12, 19723, 152
#: stands for null in the whole numbers of the stream, whose pandas frames have none; below every real value
NONE = -(1 << 63)
ALL = (1 << 63) - 1
CHANGE = ("change_id", "client_id", "seq", "op", "valid_at", "source", "segment", "city", "balance")
SALE, VERSION, CLEAR, WAKE, LATE, HELD, LEFT_SALE, LEFT_HELD = range(8)

_INPUT = "kind int, bucket int, client long, known int, hot int, slot long, at long, id long, tie long, cents long, op string"
_OUTPUT = "kind int, client long, known int, hot int, slot long, id long, at long, change long, tie long, cents long, op string, n long, passed int"
_PLACE, _ROW = ("known", "client", "slot"), ("hot", "at", "id", "tie", "cents")
_BLOCK = pa.schema([("kind", pa.int32()), *((c, pa.int64()) for c in (*_PLACE, *_ROW)), ("op", pa.string())])
#: rows of a block of state, and of a frame of results
_ROWS, _FRAME = 4096, 50_000
#: partitions that the state has at least, as far as the session has as many
_STORES = 64


def _day(c: Column) -> Column:
    return F.unix_date(F.to_date(c))


def _micros(c: Column) -> Column:
    """Microseconds since 1970 by the time as written, with or without a zone."""
    second = (F.date_part(F.lit("SECONDS"), c) * 1_000_000).cast("long")
    return _day(c).cast("long") * 86_400_000_000 + (F.hour(c) * 60 + F.minute(c)).cast("long") * 60_000_000 + second


def _batch(day: Column) -> Column:
    """The batch of a day; unknown days come last, days before the first one first."""
    return F.greatest(F.lit(0), F.least(F.lit(BATCHES - 1), F.floor((day - FIRST_DAY) * BATCHES / DAYS))).cast("int")


def _packed(rows: dict[str, np.ndarray]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _BLOCK) as out:
        out.write_batch(pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) for f in _BLOCK], schema=_BLOCK))
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> dict[str, np.ndarray]:
    table = pa.ipc.open_stream(data).read_all()
    return {name: table.column(name).to_numpy() for name in table.column_names}


class Segments(StatefulProcessor):
    """One start, with its horizon and its changes' watermark; the last one emits what waits when it has pruned. Keys are buckets. In state and in memory rows stand in the order of
    client, slot and time, sales behind the versions of their time: a segment is a version and the sales up to the next one."""

    def __init__(self, horizon: int, floor: int, last: bool) -> None:
        self.horizon, self.floor, self.last = horizon, floor, last

    def init(self, handle) -> None:
        self.state = handle.getMapState("segments", "block int", "rows binary")

    def handleInputRows(self, key, rows, timerValues):
        names = [f.name for f in _BLOCK]
        told = [{c: f[c].to_numpy() for c in names} for f in rows]
        held = [(k[0], _unpacked(v[0])) for k, v in self.state.iterator()]
        told = {c: np.concatenate([x[c] for x in told]) for c in names}
        old = {c: np.concatenate([x[c] for _, x in held] or [told[c][:0]]) for c in names}
        cleared = {(n, c, s) for n, c, s in zip(*(told[x][told["kind"] == CLEAR].tolist() for x in _PLACE))}
        if cleared:
            doubtful = np.flatnonzero((old["kind"] == VERSION) & (old["hot"] == 1))
            gone = [k for k, *place in zip(doubtful.tolist(), *(old[x][doubtful].tolist() for x in _PLACE)) if tuple(place) in cleared]
            stays = np.ones(len(old["kind"]), bool)
            stays[gone] = False
            old = {c: x[stays] for c, x in old.items()}
        late = (told["kind"] == VERSION) & (told["at"] < self.floor)
        new = ((told["kind"] == VERSION) & ~late) | (told["kind"] == SALE)
        if late.any():
            yield from _results(LATE, {c: x[late] for c, x in told.items()})
        at = {c: np.concatenate([old[c], told[c][new]]) for c in names}
        is_sale = at["kind"] == SALE
        order = np.lexsort((at["tie"], at["id"], at["kind"] == SALE, at["at"], at["slot"], at["client"], at["known"]))
        at = {c: x[order] for c, x in at.items()}
        found, stays = self._drained(at, self.horizon, SALE, HELD)
        yield from found
        at = {c: x[stays] for c, x in at.items()}
        if self.last:
            found, stays = self._drained(at, ALL, LEFT_SALE, LEFT_HELD)
            yield from found
            at = {c: x[stays] for c, x in at.items()}
        blocks = -(-len(at["id"]) // _ROWS)
        for k in range(blocks):
            self.state.updateValue((k,), (_packed({c: x[k * _ROWS : (k + 1) * _ROWS] for c, x in at.items()}),))
        for k, _ in held:
            if k >= blocks:
                self.state.removeKey((k,))

    def _drained(self, at: dict[str, np.ndarray], until: int, sale: int, held: int) -> tuple[list[pd.DataFrame], np.ndarray]:
        """Results for the sales before until and for hot slots, and which rows stay: sales that wait, versions that the horizon
        has not passed, and the last one that it has."""
        is_sale = at["kind"] == SALE
        n = len(is_sale)
        if not n:
            return [], is_sale
        out = []
        head = np.ones(n, bool)  # first row of its client and slot
        head[1:] = np.any([at[c][1:] != at[c][:-1] for c in _PLACE], axis=0)
        place = np.cumsum(head) - 1
        count = np.bincount(place, ~is_sale).astype(np.int64)
        owner = np.maximum.accumulate(np.where(is_sale, -1, np.arange(n)))
        owned = (owner >= 0) & (place[owner] == place)
        ready = is_sale & ((at["at"] == NONE) | (at["at"] < until))
        if ready.any():
            own, mine = np.where(owned, owner, 0)[ready], owned[ready]
            version = {c: np.where(mine, at[c][own], NONE) for c in ("tie", "cents")} | {"op": np.where(mine, at["op"][own], None)}
            out += _results(sale, {c: x[ready] for c, x in at.items()} | version, np.where(mine, at["id"][own], NONE), count[place[ready]], mine)
        last = np.flatnonzero(~is_sale)
        following = np.append(last[1:], -1)[: len(last)]
        same = (following >= 0) & (place[following] == place[last])
        hot = last[~same & (at["hot"][last] == 1)]
        if len(hot):
            passed = np.zeros(count.shape, bool)
            passed[place[last[at["at"][last] <= self.horizon]]] = True
            out += _results(held, {c: x[hot] for c, x in at.items()}, at["id"][hot], count[place[hot]], passed[place[hot]])
        stays = ~ready
        stays[last[same & (at["at"][following] <= self.horizon)]] = False  # pruned: the successor has been passed
        return out, stays

    def close(self) -> None:
        pass


def _results(kind: int, rows: dict[str, np.ndarray], change=NONE, n=0, passed=0):
    total = len(rows["id"])
    whole = rows | {"kind": np.full(total, kind), "change": np.broadcast_to(change, total), "n": np.broadcast_to(n, total), "passed": np.broadcast_to(passed, total)}
    columns = [x.split() for x in _OUTPUT.split(", ")]
    frame = pd.DataFrame({name: pd.Series(whole[name], dtype=object) if t == "string" else whole[name].astype(np.int32 if t == "int" else np.int64) for name, t in columns})
    for k in range(0, total, _FRAME):
        yield frame.iloc[k : k + _FRAME]


_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "100",  # of an executor: as many stores are open as tasks run, each is read and written once
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else every store of every start takes 4 MB of disk at least
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",  # a store is closed with its task: else an executor holds one for each of its partitions, and those of ended starts for a while
    "spark.sql.streaming.minBatchesToRetain": "2",
    "spark.sql.streaming.checkpoint.fileChecksum.enabled": "false",  # a second file beside each one of a checkpoint that ends with the call
}


def _stores(spark: SparkSession) -> int:
    """Partitions of the state: two for each core, never more than the session has. Every start opens each one's store anew, and
    an opened store leaves some 0.5 MB of native memory in its executor, so that their number may not grow with the input.
    Buckets do, and a task holds one of them at a time."""
    return min(shared.partitions(spark), max(_STORES, 2 * spark.sparkContext.defaultParallelism))


def _staged(sales: DataFrame, changes: DataFrame, slot_us: int, buckets: int) -> DataFrame:
    none = F.lit(NONE)
    fill = lambda c: F.coalesce(c.cast("long"), none)
    s = sales.select(F.lit(SALE).alias("kind"), _batch(_day(F.col("arrived_at"))).alias("batch"), "client_id", fill(_micros(F.col("sold_at"))).alias("at"), fill(F.col("sale_id")).alias("id"), none.alias("tie"), none.alias("cents"), F.lit(None).cast("string").alias("op"))
    c = changes.select(*[x for x in CHANGE if x in changes.columns]).where("valid_at is not null").distinct()
    late = F.crc32(F.col("change_id").cast("string").cast("binary")) % 4
    c = c.select(F.lit(VERSION).alias("kind"), _batch(_day(F.col("valid_at")) + late).alias("batch"), "client_id", _micros(F.col("valid_at")).alias("at"), fill(F.col("change_id")).alias("id"), F.xxhash64(*c.columns).alias("tie"), fill(F.floor(100 * F.col("balance") + 0.5)).alias("cents"), F.col("op").cast("string").alias("op"))
    named = lambda df: df.withColumns({"client": F.coalesce(F.col("client_id").cast("long"), F.lit(0)), "known": F.col("client_id").isNotNull().cast("int")}).drop("client_id")
    # clients with more than 1 / (2 buckets) of all rows: not more than 2 buckets, so they can be broadcast
    sizes = named(sales.select("client_id").unionAll(changes.select("client_id"))).groupBy("client", "known").agg(F.count(F.lit(1)).alias("n"))
    sizes = shared.written(sizes)
    all_rows = sizes.agg(F.sum("n")).first()[0] or 0
    hot = sizes.where(F.col("n") > all_rows / (2 * buckets)).select("client", "known", F.lit(1).alias("hot"))
    rows = named(s.unionByName(c)).join(F.broadcast(hot), ["client", "known"], "left").withColumn("hot", F.coalesce("hot", F.lit(0)))
    # sales without a time are in no slot; they are dealt by their ids
    slot = F.when(F.col("hot") == 0, 0).when(F.col("at") == none, -(F.lit(1 << 40) + F.pmod(F.xxhash64("id"), F.lit(1024)))).otherwise(F.floor(F.col("at") / slot_us))
    rows = rows.withColumn("slot", slot.cast("long"))
    return rows.withColumn("bucket", F.pmod(F.xxhash64("client", "known", "slot"), F.lit(buckets)).cast("int"))


def _with_versions(raw: DataFrame) -> DataFrame:
    """The stream's rows of all starts as results: a hot client's sales in front of their slot's first version look further back.

    What the last start leaves is a batch of its own; slots that would have been cleared before it hold nothing then."""
    left = F.col("kind").isin(LEFT_SALE, LEFT_HELD)
    latest = raw.where(F.col("kind") == LEFT_HELD).where("passed = 1").groupBy("client", "known").agg(F.max("slot").alias("latest"))
    raw = raw.join(F.broadcast(latest), ["client", "known"], "left").where((F.col("kind") != LEFT_HELD) | F.coalesce(F.col("slot") >= F.col("latest"), F.lit(True)))  # 2 * buckets rows at most
    raw = raw.withColumns({"batch": F.col("batch") + left.cast("int"), "kind": F.when(F.col("kind") == LEFT_SALE, SALE).when(F.col("kind") == LEFT_HELD, HELD).otherwise(F.col("kind"))})
    client, slot = ["batch", "client"], F.col("slot")
    last = F.struct("at", "change", "tie", "cents", "op")
    known = raw.where("known = 1 and hot = 1")
    held = known.where(F.col("kind") == HELD).select(*client, "slot", last.alias("last"), "n")
    asked = known.where(F.col("kind") == SALE).select(*client, "slot", F.lit(None).cast(held.schema["last"].dataType).alias("last"), F.lit(0).cast("long").alias("n"))
    slots = held.unionByName(asked).groupBy(*client, F.floor(slot / 24).alias("day"), "slot").agg(F.max("last").alias("last"), F.sum("n").alias("n"))
    slots = shared.written(slots)
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    days = slots.groupBy(*client, "day").agg(F.max("last").alias("last"), F.sum("n").alias("n"))
    days = days.select(*client, "day", F.max("last").over(before(Window.partitionBy(*client).orderBy("day"))).alias("of_days"), F.sum("n").over(Window.partitionBy(*client)).alias("held"))
    slots = slots.select(*client, "day", "slot", F.max("last").over(before(Window.partitionBy(*client, "day").orderBy("slot"))).alias("of_slots"))
    back = slots.join(days, [*client, "day"]).select(*client, "slot", F.coalesce("of_slots", "of_days").alias("back"), "held")
    sales = known.where(F.col("kind") == SALE).join(back, [*client, "slot"])
    further = (F.col("passed") == 0) & (F.col("at") != NONE)
    of_hot = {c: F.when(further, F.coalesce(F.col("back")[c], F.lit(NONE))).otherwise(F.col(c)) for c in ("change", "cents")} | {"op": F.when(further, F.col("back")["op"]).otherwise(F.col("op")), "n": F.col("held")}
    columns = ["id", "batch", "n", "change", "cents", "op"]
    sales = sales.withColumns(of_hot).select(*columns)
    light = raw.where((F.col("kind") == SALE) & (F.col("hot") * F.col("known") == 0)).withColumns({c: F.when(F.col("known") == 1, F.col(c)) for c in ("n", "change", "cents", "op")}).select(*columns)
    number = lambda name: F.when(F.col(name) != NONE, F.col(name))
    sales = sales.unionByName(light).select(F.lit("sale").alias("rec"), number("id").alias("id"), F.col("batch").cast("long").alias("batch"), F.coalesce("n", F.lit(0)).cast("long").alias("n_held"), number("change").alias("change_id"), number("cents").alias("balance_cents"), "op")
    nothing = F.lit(None).cast("long")
    late = raw.where(F.col("kind") == LATE).select(F.lit("late").alias("rec"), number("id").alias("id"), F.col("batch").cast("long").alias("batch"), nothing.alias("n_held"), nothing.alias("change_id"), nothing.alias("balance_cents"), F.lit(None).cast("string").alias("op"))
    return sales.unionByName(late)


def enriched_sales(sales: DataFrame, changes: DataFrame, slot_seconds: int = 3600, buckets: int | None = None) -> DataFrame:
    """(rec, id, batch, n_held, change_id, balance_cents, op): one row a sale, and one a change that came too late.

    Twelve batches by day are fed to one stateful query, started anew for each on one checkpoint in a new folder under
    spark.checkpoint.dir; the last start then emits what still waits, as batch 12. Watermarks are two numbers a batch. buckets:
    keys of the stream, four a shuffle partition by default; a task holds the rows of one bucket at a time. State has a number of
    partitions that goes by the cores (_stores).
    Sales without a time are emitted on arrival without a version, sales without a client have none and n_held 0, changes
    without valid_at are ignored, those without a client are versions of nobody; repeated sales give repeated rows; versions
    with equal time and change_id follow each other by a hash of their rows; rows without arrived_at come in the last
    batch. Empty tables give no rows, further columns are ignored.
    """
    spark: SparkSession = sales.sparkSession
    buckets = buckets or 4 * shared.partitions(spark)
    root = f"{shared.shared_dir(spark)}/prismfold-{uuid.uuid4().hex}"
    feed, out = f"{root}/feed", f"{root}/out"
    settings = _SETTINGS | {"spark.sql.shuffle.partitions": str(_stores(spark))}
    before = {k: spark.conf.get(k, None) for k in settings}
    with shared.space() as own:
        own.tables.append((spark, f"{root}/staged"))
        own.tables.append((spark, feed))
        own.tables.append((spark, f"{root}/state"))
        staged = _staged(sales, changes, slot_seconds * 1_000_000, buckets)
        staged.write.partitionBy("batch").parquet(f"{root}/staged")
        written = spark.read.schema(f"{_INPUT}, batch int").parquet(f"{root}/staged")
        tops = {(r.batch, r.kind): r.top for r in written.where(F.col("at") != NONE).groupBy("batch", "kind").agg(F.max("at").alias("top")).collect()}
        wake = spark.range(0, buckets, 1, 1).select(F.lit(WAKE).alias("kind"), F.col("id").cast("int").alias("bucket"), *[F.lit(NONE if t != "int" else 0).cast(t).alias(n) for n, t in (("client", "long"), ("known", "int"), ("hot", "int"), ("slot", "long"), ("at", "long"), ("id", "long"), ("tie", "long"), ("cents", "long"))], F.lit(None).cast("string").alias("op"))
        try:
            for k, v in settings.items():
                spark.conf.set(k, v)
            for b in range(BATCHES):
                mark = lambda kind: max((t for (k, d), t in tops.items() if d == kind and k < b), default=NONE)  # noqa: B023, E731
                floor, horizon = mark(VERSION), min(mark(SALE), mark(VERSION))
                rows = wake if not b else wake.unionByName(_cleared(spark.read.schema(_OUTPUT).parquet(f"{out}/batch={b - 1}"), buckets))
                rows.write.parquet(f"{feed}/told={b}")
                _move(spark, f"{root}/staged/batch={b}", f"{feed}/rows={b}")
                _start(spark, feed, f"{root}/state", f"{out}/batch={b}", Segments(horizon, floor, b == BATCHES - 1))
        finally:
            for k, v in before.items():
                spark.conf.unset(k) if v is None else spark.conf.set(k, v)
        own.tables.append((spark, out))
        return shared.lasting(_with_versions(spark.read.schema(f"{_OUTPUT}, batch int").parquet(out)))


def _move(spark: SparkSession, source: str, target: str) -> None:
    """A batch's folder comes into the stream's sight; a batch without rows has none."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(source).getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(path(source)) and not fs.rename(path(source), path(target)):
        raise OSError(f"{source} could not be moved to {target}")


def _cleared(raw: DataFrame, buckets: int) -> DataFrame:
    """Rows that clear the slots which a later slot's version, passed by H as well, makes obsolete."""
    held = raw.where(F.col("kind") == HELD).select("client", "known", "slot", "passed")  # hot clients only
    latest = held.where("passed = 1").groupBy("client", "known").agg(F.max("slot").alias("latest"))
    old = held.join(F.broadcast(latest), ["client", "known"]).where("slot < latest")  # 2 * buckets rows at most
    bucket = F.pmod(F.xxhash64("client", "known", "slot"), F.lit(buckets)).cast("int")
    none = F.lit(NONE)
    return old.select(F.lit(CLEAR).alias("kind"), bucket.alias("bucket"), "client", "known", F.lit(1).alias("hot"), "slot", none.alias("at"), none.alias("id"), none.alias("tie"), none.alias("cents"), F.lit(None).cast("string").alias("op"))


def _start(spark: SparkSession, feed: str, state: str, target: str, processor: Segments) -> None:
    """One start of the query over the files that are new in feed."""
    rows = spark.readStream.schema(_INPUT).option("recursiveFileLookup", True).parquet(feed)
    found = rows.groupBy("bucket").transformWithStateInPandas(processor, outputStructType=_OUTPUT, outputMode="Append", timeMode="None")

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(target)

    query = found.writeStream.foreachBatch(keep).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
