"""Helpers shared by the corpus operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_root(spark: SparkSession) -> str:
    """The folder shared by driver and executors: ``spark.checkpoint.dir``.

    Only a local session without that setting (tests) gets a temporary folder of
    its own; on a cluster such a folder would be seen by one machine alone.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if configured:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(configured)
        return configured
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return context.getCheckpointDir()


#: Rows and bytes that go to a Python worker at once, about; a batch stands in memory several times on its way.
TEXT_ROWS, TEXT_BYTES = 1000, 8 << 20


def text_batches(spark: SparkSession) -> None:
    """Bounds the batches in which Python operators take whole texts, by rows and bytes; a smaller setting stays.

    Spark reads both settings when a plan runs, so they stay set for the session.
    """
    for name, most in (("maxRecordsPerBatch", TEXT_ROWS), ("maxBytesPerBatch", TEXT_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        number, unit = re.fullmatch(r"(-?\d+)([a-z]*)", spark.conf.get(name).lower()).groups()
        if not 0 < int(number) << 10 * " kmgt".find(unit[:1] if unit[:1] in "kmgt" else " ") <= most:
            spark.conf.set(name, str(most))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` doesn't have, made of ``names``; upper and lower case count as equal."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        name = f"__{name}"
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and cut its lineage."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder name under the shared folder, as a URI."""
    root = checkpoint_root(spark)
    if "://" not in root and not root.startswith("file:"):
        root = "file://" + root
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
