"""Resumable ingestion: an incremental job that continues where the last run stopped.

An extension: the batch operators need none of it. A row's key is kept in the stream's state, so a row that has
come once, in this run or an earlier one, is not processed again, and no batch reads the output of
those before it. Each micro-batch writes a folder of its own, overwritten if the batch is repeated
after a failure, so a restart repeats nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.curate import pending


def _exists(spark: SparkSession, path: str) -> bool:
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(sc._jsc.hadoopConfiguration()).exists(p)


def ingest(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, key: Callable[[DataFrame], Column], process: Callable[[DataFrame], DataFrame]):
    """Read new JSON files of `source`, run `process` on rows that are new, and add the result to `target`; stops when all is read.

    key(df) is the row's identity; `process` must keep the columns that it needs. Rows that `process` drops are
    not written and not asked again. What an output without a checkpoint holds already counts as done.
    """
    from ..sources.files import read_progress

    stream = spark.readStream.schema(schema).json(source)
    done = None
    if _exists(spark, target) and not _exists(spark, checkpoint):
        empty = process(spark.createDataFrame([], schema))
        out_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in empty.schema.fields)
        earlier = read_progress(spark, target, out_schema)
        done = earlier.select(key(earlier).cast("string").alias("_done")).persist()

    def step(batch: DataFrame, number: int) -> None:
        rows = batch if done is None else pending(batch, done, key(batch), done["_done"])
        process(rows.drop("_key")).write.mode("overwrite").json(f"{target}/batch={number}")

    once = stream.withColumn("_key", F.md5(key(stream).cast("string").cast("binary"))).dropDuplicates(["_key"])
    return once.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, by: str, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by tumbling window and `by`; works on streams (with a watermark) and on tables."""
    return events.withWatermark(time, late).groupBy(F.window(time, size), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")

