"""Shared plumbing of the training-data operators.

Tables are read by Spark's own readers only, intermediate tables are written to the folder that
the session names in spark.checkpoint.dir, and Python code runs over Arrow batches.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterator
from functools import partial, wraps

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ARROW_BYTES, shared_base, ship

#: Bytes of text handled at once by one Python worker.
SLICE_BYTES = ARROW_BYTES
#: Most rows of a narrow table that is joined by broadcast once they have been counted. Results don't depend on it.
FEW = 250_000
#: Rows of a join that no task minds, whatever their keys.
LITTLE = 20_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ship_package(spark: SparkSession) -> None:
    """Make this package importable on executors, wherever the driver found it. Done once a context."""
    ship(spark)


def shared_dir(spark: SparkSession) -> str:
    """The operators' part of the cluster's shared folder."""
    return f"{shared_base(spark)}/lemmaflow"


def materialise(df: DataFrame) -> DataFrame:
    """Write df once to the shared folder and read it back: lineage ends there, and no task has the only copy."""
    spark = df.sparkSession
    path = new_folder(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lemmaflow_path = path
    return out


def new_folder(spark: SparkSession) -> str:
    """A name in the shared folder that nothing has yet; what is written there is deleted when the process ends."""
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    if not _WRITTEN:
        atexit.register(_at_exit)
    _WRITTEN.append((spark, path))
    return path


_WRITTEN: list = []


def cleanup() -> None:
    """Delete all tables of materialise() of this process; results that read them must have been written before."""
    while _WRITTEN:
        _delete(*_WRITTEN.pop())


def _at_exit() -> None:
    try:
        cleanup()
    except Exception:  # noqa: BLE001, S110  the session has ended; its folder is the cluster's to clean
        pass


def _delete(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Let the context drop shuffle files of plans that are done with: it does so when the driver's JVM collects garbage."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(*tables: DataFrame) -> None:
    """Delete tables of materialise() that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_lemmaflow_path", None)
        if path:
            _delete(df.sparkSession, path)
            _WRITTEN[:] = [x for x in _WRITTEN if x[1] != path]


def free_name(df: DataFrame, base: str) -> str:
    """A column name like `base` that df does not have, in any case of its letters."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def crc_bucket(col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null ids count as the empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % n


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that a piece holds about `limit` bytes of `column`; one longer text is a piece of its own."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        if batch.nbytes <= limit:
            yield batch
            continue
        values = batch.column(column)
        kind = values.type
        sizes = pa.compute.multiply(pa.compute.list_value_length(values), 8) if pa.types.is_list(kind) or pa.types.is_large_list(kind) else pa.compute.binary_length(values)
        sizes = sizes.fill_null(0).to_pylist()
        start = held = 0
        for i, n in enumerate(sizes):
            if held and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        yield batch.slice(start)


_CLEAR: list[Callable] = []
_OWNER: list[str] = []


def keeps(clear: Callable) -> None:
    """Register what empties an operator's tables that outlive a task."""
    _CLEAR.append(clear)


def trim() -> None:
    """Give memory that is free, but kept by the allocators, back to the machine."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    give = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give is not None:
        give(0)


def settle(owner: str) -> None:
    """At the start of a task: drop what another operator has left in this Python worker, and give its memory back."""
    if _OWNER and _OWNER[0] != owner:
        for clear in _CLEAR:
            clear()
        trim()
    _OWNER[:] = [owner]


def lean(run: Callable) -> Callable:
    """A task's function over batches, after which its worker, which waits for other tasks, holds no more than its tables."""

    @wraps(run)
    def held(*args, **more):
        try:
            yield from run(*args, **more)
        finally:
            trim()

    return held


@lean
def _apply(batches, fn, column, names, schema, limit):
    settle(getattr(fn, "func", fn).__module__)
    state: dict = {}
    for piece in slices(batches, column, limit):
        columns = fn(piece.column(column).to_pylist(), state)
        if columns is None:
            continue
        keep = columns.pop("__keep__", None)
        arrays = [piece.column(n) if n not in columns else pa.array(columns[n], type=schema.field(n).type) for n in names]
        out = pa.RecordBatch.from_arrays([a.cast(schema.field(n).type) for n, a in zip(names, arrays)], schema=schema)
        yield out if keep is None else out.filter(pa.array(keep, type=pa.bool_()))


def map_text(df: DataFrame, column: str, fn: Callable, added: str, limit: int = SLICE_BYTES) -> DataFrame:
    """df's columns and those that fn(texts, state) returns as a dict of lists; `added` is their DDL.

    state is a dict kept for one task. A list "__keep__" of booleans filters the rows.
    """
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    ship_package(df.sparkSession)
    new = T._parse_datatype_string(added) if added else T.StructType([])
    fields = [f for f in df.schema.fields if f.name not in new.names] + list(new.fields)
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in fields])
    arrow = to_arrow_schema(schema)
    return df.mapInArrow(partial(_apply, fn=fn, column=column, names=schema.names, schema=arrow, limit=limit), schema)


def join_unique(rows: DataFrame, table: DataFrame, key: str, n: str = "n") -> DataFrame:
    """Inner join of rows with a table of one row a key, where a few keys may hold most rows.

    The table's column n, each key's number of rows, is left out of the result. Keys with more than a thousandth of
    all rows (so at most a thousand keys) are joined by broadcast where their rows lie; only the others are shuffled.
    """
    total = table.agg(F.sum(n)).first()[0] or 0
    plain = table.drop(n)
    if total <= LITTLE:
        return rows.join(plain, key)
    hot = F.broadcast(table.where(F.col(n) > total // 1000).drop(n))
    cool = rows.join(hot.select(key), key, "left_anti").join(plain, key)
    return rows.join(hot, key).unionByName(cool)


def if_few(table: DataFrame) -> DataFrame:
    """A written table, marked for broadcast if it has at most FEW rows; else it is joined by a shuffle."""
    return F.broadcast(table) if table.count() <= FEW else table


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): rows (node, component), component = smallest node; nodes without edges are absent.

    Alternates large-star and small-star steps over the edge table until it no longer changes; a step
    is a minimum over each node's edges, and each round is written to the shared folder. Minima are
    aggregated before the shuffle and joined to the edges, and a hub's edges are the join's larger side, which
    adaptive execution splits (few edges are joined by broadcast); no task gets all edges of a hub.
    """
    def two(d: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
        return d.select(F.explode(F.array(*[F.struct(F.col(x).alias("u"), F.col(y).alias("v")) for x, y in pairs])).alias("e")).select("e.u", "e.v")

    def least(e: DataFrame, rows: int) -> DataFrame:
        m = e.groupBy("u").agg(F.min("v").alias("m"))
        return e.join(F.broadcast(m) if rows <= FEW else m, "u").withColumn("m", F.least("u", "m"))

    def tally(e: DataFrame):
        r = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return tuple(r)

    cur = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    state = tally(cur)
    while state[0]:
        # Large star: neighbours above u go to u's smallest neighbour; then small star: so do those below it, and u.
        large = materialise(least(two(cur, ("a", "b"), ("b", "a")), state[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        small = two(least(large, state[0]), ("v", "m"), ("u", "m")).where("u <> v").select(F.col("u").alias("a"), F.col("v").alias("b"))
        nxt = materialise(small.distinct())
        new = tally(nxt)
        discard(large, cur)
        cur = nxt
        if new == state:
            break
        state = new
    return cur.select(F.col("a").alias("node"), F.col("b").alias("component")).union(cur.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
