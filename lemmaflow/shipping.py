"""What a session needs: this package importable on executors, and a folder that they all share."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile

from pyspark.sql import SparkSession


#: Bytes of an Arrow batch.
ARROW_BYTES = 8 << 20


def ship(spark: SparkSession) -> None:
    """Send the package's code to the executors, once a context. The folder here holds only that archive, which Spark distributes.

    Also bounds the bytes of the session's Arrow batches, where nobody has set them: ten thousand long texts in
    one batch are held by a task several times over.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "67108864b":
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{ARROW_BYTES}b")
    sc = spark.sparkContext
    if getattr(sc, "_lemmaflow_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="lemmaflow-")), "lemmaflow_pkg.zip")
    with zipfile.ZipFile(target, "w") as z:
        for top, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(top, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(target)
    sc._lemmaflow_shipped = True


def shared_base(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where none is, a temporary one in local mode (tests), else an error."""
    base = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lemmaflow-shared-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")
