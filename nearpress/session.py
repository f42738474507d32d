"""Settings of a session that other modules need."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows and bytes up to which a counted table is broadcast.
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 64 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; one is set only where none is named."""
    sc = spark.sparkContext
    have = sc._jsc.sc().getCheckpointDir()
    if have.isDefined():
        return have.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not (sc.master or "").startswith("local"):
            raise RuntimeError("name a folder shared by all executors in spark.checkpoint.dir")
        named = os.path.join("/tmp", f"nearpress-{uuid.uuid4().hex}")
    sc.setCheckpointDir(named)
    return named


#: Files of the checkpoints made within each open ``scratch``.
_SCRATCH: list[list[tuple[SparkSession, str]]] = []


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    if _SCRATCH:
        made = out._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
        if made.isDefined():
            _SCRATCH[-1].append((df.sparkSession, made.get()))
    return out


@contextmanager
def scratch() -> Iterator[None]:
    """Removes the checkpoints made within when left; what is built there has to be written before.

        with scratch():
            query(spark, folder).write.parquet(path)
    """
    _SCRATCH.append([])
    try:
        yield
    finally:
        for spark, file in _SCRATCH.pop():
            path = spark._jvm.org.apache.hadoop.fs.Path(file)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Tasks that heavy work is parted into at most.
MOST_TASKS = 10_000


def spread(df: DataFrame, *keys: str, groups: int = 0) -> DataFrame:
    """Parts a table by keys for work that is heavy beside its bytes.

    Adaptive execution would gather partitions of few bytes into one task,
    however long their rows take; a number that is asked for it leaves alone.
    With a number of ``groups`` about each is a task of its own.
    """
    spark = df.sparkSession
    n = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), min(groups, MOST_TASKS))
    return df.repartition(n, *keys)


def small(df: DataFrame, n_rows: int, row_bytes: int = 64) -> DataFrame:
    """Marks a counted table for broadcast if it is small; leaves it alone else."""
    return F.broadcast(df) if n_rows <= BROADCAST_ROWS and n_rows * row_bytes <= BROADCAST_BYTES else df


def ordinal(df: DataFrame, order: list[str], group: list[str] = (), out: str = "i") -> DataFrame:
    """Adds the position of each row in an order, from 0, within each group.

    Rows are sorted by ranges over all tasks; only the number of rows of each
    task and group is summed, so no group is gathered in one task.
    """
    group = list(group)
    ranged = df.repartitionByRange(*[F.col(c) for c in [*group, *order]]).sortWithinPartitions(*group, *order)
    # the task and the place in it have to be read off the sorted rows before they are cut
    ranged = cut(ranged.withColumn("__at", F.monotonically_increasing_id()))
    task = F.shiftright("__at", 33).cast("int")
    ranged = ranged.withColumn("__task", task)
    counts = cut(ranged.groupBy(*group, "__task").agg(F.count("*").alias("__n"), F.min("__at").alias("__first")))
    # as many rows as tasks and groups that meet
    before = Window.partitionBy(*group).orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    on = F.lit(True)
    for c in group:
        on = on & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    joined = ranged.alias("a").join(small(starts, counts.count()).alias("b"), on & (F.col("a.__task") == F.col("b.__task")))
    kept = [F.col(f"a.{c}") for c in df.columns]
    return joined.select(*kept, (F.col("a.__at") - F.col("b.__first") + F.col("b.__start")).cast("long").alias(out))
