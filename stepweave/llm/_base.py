"""What the operators share: tables, the shared folder, numbers of partitions."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join of at most so many rows is broadcast; it is counted first.
BROADCAST_ROWS = 100_000
#: Beyond that, keys with more than this part of the other side's rows are; there can't be more such keys than parts.
PARTS = 10_000
#: Of the rows that go to a Python worker at a time.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one of our own only where it is unset, as in tests."""
    jsc = spark.sparkContext._jsc.sc()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and jsc.getCheckpointDir().isDefined():
        folder = jsc.getCheckpointDir().get()
    if folder is None:
        folder = f"file://{tempfile.mkdtemp(prefix='stepweave-')}"
    if not jsc.getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


@contextmanager
def without_constraints(spark: SparkSession) -> Iterator[None]:
    """For loops over checkpoints: these keep what the optimizer has inferred, which would grow from round to round."""
    name = "spark.sql.constraintPropagation.enabled"
    before = spark.conf.get(name, "true")
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def checkpoint(df: DataFrame) -> DataFrame:
    """The rows as written to the shared folder: the lineage ends there and every later read sees the same rows."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bound_batches(spark: SparkSession) -> None:
    """Rows go to Python in Arrow batches of BATCH_BYTES (a longer row alone), if the session has Spark's own bound: it is what a worker and its executor hold beside their work."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == f"{64 << 20}b":
        spark.conf.set(name, str(BATCH_BYTES))


def require(df: DataFrame, *columns: str) -> None:
    bound_batches(df.sparkSession)
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}; there are {', '.join(df.columns)}")


def fresh(df: DataFrame, name: str) -> str:
    """The name, with underscores before it until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def spread_join(rows: DataFrame, side: DataFrame, on: list[str], weight: str, how: str = "inner") -> DataFrame:
    """Joins rows with ``side``, which has one row for each key and, as ``weight``, the number of rows of that key.

    A small side is broadcast. Of a larger one the heavy keys are, so that no
    task gets more than a ten-thousandth of the weight for one key. ``side``
    should be checkpointed: it is counted and read more than once.
    """
    if side.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(side), on, how)
    total = side.agg(F.sum(weight)).first()[0]
    heavy = F.broadcast(side.where(F.col(weight) > total / PARTS))
    light = side.where(F.col(weight) <= total / PARTS)
    return rows.join(heavy, on).unionByName(rows.join(heavy.select(*on), on, "left_anti").join(light, on, how))
