"""Reading tables, cutting lineage in the shared folder, small column helpers."""

from __future__ import annotations

import contextlib
import functools
import tempfile
import threading
import uuid

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: rows of an Arrow batch, unless the session says otherwise: whole texts are long, and every task holds a few batches
BATCH_ROWS = 2000


def modest(spark: SparkSession) -> None:
    """Arrow batches of BATCH_ROWS rows where the session has no size of its own (Spark's is 10,000 rows)."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name, None) in (None, "10000"):
        spark.conf.set(name, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    modest(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset, a temporary folder serves a local master (tests) only."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not configured:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        configured = "file://" + tempfile.mkdtemp(prefix="prismfold-")
        spark.sparkContext.setCheckpointDir(configured)
    return configured.rstrip("/")


def _delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Space:
    """Intermediate tables and broadcasts of one call; close() deletes them."""

    def __init__(self) -> None:
        self.tables: list[tuple[SparkSession, str]] = []
        self.broadcasts: list = []

    def close(self) -> None:
        while self.tables:
            _delete(*self.tables.pop())
        while self.broadcasts:
            self.broadcasts.pop().destroy()


class _Stack(threading.local):
    def __init__(self) -> None:
        self.spaces = [Space()]  # of a thread; the first one stays: results outside any call

    def __reduce__(self):  # this module travels with the functions that run on executors
        return _Stack, ()


_STACK = _Stack()


@contextlib.contextmanager
def space(held: Space | None = None):
    """What is written inside goes at the end (or with held, when that is closed), but for lasting() tables."""
    own = held or Space()
    _STACK.spaces.append(own)
    try:
        yield own
    finally:
        _STACK.spaces.remove(own)
        if held is None:
            own.close()


@contextlib.contextmanager
def _frugal(spark: SparkSession):
    """Shuffle files of what runs inside go as soon as it has ended: its output is stored, nothing reads them again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _stored(df: DataFrame, owner: Space) -> DataFrame:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/prismfold-{uuid.uuid4().hex}"
    owner.tables.append((spark, path))
    with _frugal(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._prismfold_path = path
    return out


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends here, lost executors lose nothing. It goes with the current space."""
    return _stored(df, _STACK.spaces[-1])


def lasting(df: DataFrame) -> DataFrame:
    """As written(), for what a call returns: the table goes with the space around the current one."""
    return _stored(df, _STACK.spaces[-2] if len(_STACK.spaces) > 1 else _STACK.spaces[0])


def forget(df: DataFrame) -> None:
    """Delete a stored table, once nothing reads it any more."""
    for s in _STACK.spaces:
        s.tables = [t for t in s.tables if t[1] != df._prismfold_path]
    _delete(df.sparkSession, df._prismfold_path)


def broadcast(spark: SparkSession, value):
    """A broadcast value that goes with the current space."""
    out = spark.sparkContext.broadcast(value)
    _STACK.spaces[-1].broadcasts.append(out)
    return out


def call(f):
    """An operator whose intermediate tables go when it returns: its result reads lasting() tables only."""

    @functools.wraps(f)
    def run(*args, **kwargs):
        with space():
            return f(*args, **kwargs)

    return run


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def ids_and_texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns under fixed names, so that clashing extra columns cannot matter."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def with_scores(df: DataFrame, text_col: str, out: str, run) -> DataFrame:
    """df and a double column that run makes of the text column, one Arrow batch at a time."""
    place = df.columns.index(text_col)
    fields = df.withColumn(out, F.lit(0.0)).schema

    def each(batches):
        for b in batches:
            column = b.column(place)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(run(column), pa.float64())], names=[*b.schema.names, out])

    return df.mapInArrow(each, fields)


class Shipped:
    """A broadcast value whose class may live in this package; unpickled once a task."""

    def __init__(self, spark: SparkSession, value) -> None:
        self._bytes = spark.sparkContext.broadcast(cloudpickle.dumps(value))
        self._held: list = []

    @property
    def value(self):
        if not self._held:
            self._held.append(cloudpickle.loads(self._bytes.value))
        return self._held[0]
