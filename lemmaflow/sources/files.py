"""Readers and writers of the corpus's files. Writes go through Spark's commit protocol."""

from __future__ import annotations

import inspect
import time
import uuid
from collections import deque
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import PROCESSED_DDL
from ..shipping import shared_base


def read_examples(spark: SparkSession, path: str, joined: bool = False) -> DataFrame:
    """One row per example of `{"examples": [...]}` or of a bare array, with its place `pos`; a document is read by as many tasks as it has splits.

    Over several files pos counts on: the number of the file in order of name times 2^40, plus the place in the file. With joined they are
    the parts of one document, as write_document makes them.
    """
    from .documents import read_document

    return read_document(spark, path, joined=joined)


def read_processed(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of processed records; blank lines are skipped."""
    return spark.read.schema(PROCESSED_DDL).json(path)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """The `sequence` field of JSON lines."""
    return spark.read.schema("sequence STRING").json(path)


def count_examples(spark: SparkSession, path: str) -> DataFrame:
    """n: lines with something on them."""
    return spark.read.text(path).where(F.col("value").rlike(r"(?U)\S")).agg(F.count("*").alias("n"))


def work_folder(spark: SparkSession) -> str:
    """A new folder below the shared one."""
    return f"{shared_base(spark)}/lemmaflow-work/{uuid.uuid4().hex}"


def read_progress(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Earlier output, or an empty table where there is none yet."""
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(sc._jsc.hadoopConfiguration())
    if not fs.exists(p) or fs.getContentSummary(p).getLength() == 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def write_examples(df: DataFrame, stats: DataFrame | None, path: str, key: str = "examples") -> None:
    """Examples as JSON lines in `path`/examples and the stage's counts in `path`/stats, nulls included."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(f"{path}/{key}")
    if stats is not None:
        stats.write.mode("overwrite").option("ignoreNullFields", False).json(f"{path}/stats")


def write_document(df: DataFrame, stats: DataFrame, path: str, order: str, key: str = "examples", stats_key: str = "stats") -> None:
    """One JSON document `{key: [...], stats_key: {...}}` in parts that follow one another in order of name."""
    from . import documents

    documents.write_document(df, stats, path, order, key, stats_key)


def write_splits(df: DataFrame, path: str) -> None:
    """One folder of JSON lines a split."""
    df.write.mode("overwrite").partitionBy("split").json(path)


def append_checkpoint(df: DataFrame, path: str) -> None:
    """Add rows; readers see all of a commit or nothing."""
    df.write.mode("append").json(path)


def write_vocabulary(spark: SparkSession, merges: list[tuple[str, str]], path: str) -> None:
    spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(merges)], "rank long, left string, right string").coalesce(1).write.mode("overwrite").json(path)


def read_vocabulary(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """Merges in order; a vocabulary is bounded by its size."""
    rows = spark.read.schema("rank long, left string, right string").json(path).orderBy("rank").collect()
    return [(r["left"], r["right"]) for r in rows]


def write_config(config, path: str, spark: SparkSession) -> None:
    """A dataclass as one JSON document."""
    import dataclasses
    import json

    spark.createDataFrame([(json.dumps(dataclasses.asdict(config)),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_config(spark: SparkSession, path: str, kind):
    import json

    return kind(**json.loads(spark.read.text(path).first()["value"]))


def backoff(attempt: int, error: Exception) -> float:
    """Seconds to wait after a failed try (from 0): 1, 2, 4, ...; after a refusal for too many calls 10, 20, 30, ..."""
    text = str(error).lower()
    return 10.0 * (attempt + 1) if "429" in text or "rate limit" in text else float(2**attempt)


def generate(requests: DataFrame, call: Callable, reply: str = "reply", tries: int = 3, in_flight: int = 4, wait: Callable[[float], None] = time.sleep, delay: Callable[[int, Exception], float] = backoff) -> DataFrame:
    """requests with what `call` returns for each row, and `tries`, `waited` (seconds) and `failure` (the last error's text, null for a reply).

    A call that raises is tried again after a wait, `tries` times in all; then the row has no reply and a failure, and the job goes on. Each task keeps at most
    in_flight calls going and rows in their order. call takes a row as a dict, and the number of the try (from 0) if it has a second parameter. A task that
    Spark repeats calls again: what must not be asked twice is committed by sources.files.append_checkpoint and left out by curate.pending.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema.fields) + f", `{reply}` string, tries int, waited double, failure string"
    numbered = len(inspect.signature(call).parameters) > 1

    def one(row: dict) -> tuple:
        waited = 0.0
        for attempt in range(tries):
            try:
                return (call(row, attempt) if numbered else call(row), attempt + 1, waited, None)
            except Exception as e:  # noqa: BLE001  whatever a service raises is its row's failure
                error = e
            if attempt + 1 < tries:
                seconds = delay(attempt, error)
                waited += seconds
                wait(seconds)
        return None, tries, waited, str(error)[:500]

    def run(parts):
        with ThreadPoolExecutor(max_workers=in_flight) as pool:
            for pdf in parts:
                rows, going, out = iter(pdf.to_dict("records")), deque(), []
                for row in rows:
                    going.append(pool.submit(one, row))
                    if len(going) >= in_flight:
                        out.append(going.popleft().result())
                out += [f.result() for f in going]
                columns = list(zip(*out)) or [()] * 4
                yield pdf.assign(**{n: list(c) for n, c in zip((reply, "tries", "waited", "failure"), columns)})  # noqa: B905

    return requests.mapInPandas(run, schema)


def packable_column(path: Column, ignored_parts: set[str], ignored_suffixes: tuple[str, ...]) -> Column:
    """packable() of a column of paths."""
    parts = F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, sorted(ignored_parts))).cast("array<string>"))
    suffix = F.lit(False)
    for x in ignored_suffixes:
        suffix = suffix | F.endswith(path, F.lit(x))
    return ~(parts | suffix)


def packable(path: str, ignored_parts: set[str], ignored_suffixes: tuple[str, ...]) -> bool:
    """Whether a project archive takes a path: none of its parts, nor its suffix, is ignored."""
    return not (set(path.split("/")) & ignored_parts) and not path.endswith(ignored_suffixes)
