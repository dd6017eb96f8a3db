"""Cutting lineage between rounds of an iterative operator.

A round's result is written as a parquet table in the shared folder that the
cluster names in ``spark.checkpoint.dir`` and read back.  Compared with a
cached block this survives the loss of executors, and the reader sees true
sizes, so joins against it are planned from facts.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_roots: dict[str, str] = {}
_open: list[list[Staged]] = []  # tables of the blocks that delete theirs


def staging_root(spark: SparkSession) -> str:
    """Folder for this application's tables, below the session's shared folder.

    A machine-local folder is taken only under a local master.  The folder goes when
    the application ends.
    """
    app = spark.sparkContext.applicationId
    if app not in _roots:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            shared = tempfile.mkdtemp(prefix="depfleet-")
        root = f"{shared.rstrip('/')}/depfleet-{app}"
        fs, path = _file_system(spark, root)
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _roots[app] = root
    return _roots[app]


def _file_system(spark: SparkSession, path: str):
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()), jvm_path


# the largest table that is sent whole to every task: by the size of its files, and by the rows that a shuffle has counted
BROADCAST = {"spark.sql.autoBroadcastJoinThreshold": 32 << 10, "spark.sql.adaptive.autoBroadcastJoinThreshold": 1 << 20}


def measured_joins(spark: SparkSession) -> None:
    """Let this session's joins send only small tables through the driver.

    Columns of paths and ids take a hundredth of their memory in a file, so the size of a staged table's files says little of
    what a broadcast of it holds.  Joins of other tables meet in a shuffle, and adaptive execution still sends those that turn
    out small.  Lower limits that the session has already stay.
    """
    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for name, most in BROADCAST.items():
        if _bytes(spark.conf.get(name, usual)) > most:
            spark.conf.set(name, str(most))


def _bytes(size: str) -> int:
    """Bytes that a setting of a size names."""
    number, unit = re.fullmatch(r"(-?\d+)\s*([a-z]*)", size.strip().lower()).groups()
    return int(number) << 10 * "bkmgtp".index((unit or "b")[0])


# what is handed to a Python worker at once; the JVM's buffers of a batch take up to four times as much beside its heap
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Let this session hand tables to Python workers in batches of bounded size, however long their texts are.

    A lower limit that the session has already stays.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if _bytes(spark.conf.get(name)) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


@dataclass
class Staged:
    """A written table: ``df`` reads it, ``facts`` holds figures taken while writing."""

    df: DataFrame
    facts: dict
    path: str

    @property
    def rows(self) -> int:
        return self.facts["rows"]

    def drop(self) -> None:
        """Delete the table; only for rounds that nothing reads any more."""
        fs, path = _file_system(self.df.sparkSession, self.path)
        fs.delete(path, True)


def stage(df: DataFrame, **facts: Column) -> Staged:
    """Write ``df`` and read it back; row count and ``facts`` come from the same job."""
    spark = df.sparkSession
    path = f"{staging_root(spark)}/{uuid.uuid4().hex}"
    seen = Observation()
    watched = df.observe(
        seen,
        F.count(F.lit(1)).alias("rows"),
        *[c.alias(name) for name, c in facts.items()],
    )
    watched.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    table = Staged(back, seen.get, path)
    if _open:
        _open[-1].append(table)
    return table


@contextmanager
def passing() -> Iterator[Callable[[Staged], Staged]]:
    """Deletes the tables staged inside when it ends, but for those given to the function it yields.

    What leaves the block must not read the others.  Blocks may be nested; those of several threads share their tables'
    lifetime with the outermost one.
    """
    made: list[Staged] = []
    kept: list[str] = []

    def keep(table: Staged) -> Staged:
        kept.append(table.path)
        return table

    _open.append(made)
    try:
        yield keep
    finally:
        _open.remove(made)
        for table in made:
            if table.path not in kept:
                table.drop()
            elif _open:
                _open[-1].append(table)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """What is staged inside leaves no shuffle files behind: they go when its table is written, not when the driver next collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Union of frames that share one schema."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def together(*tasks: Callable[[], object]) -> list:
    """Run independent operators side by side: the short rounds of one fill the gaps of another."""
    with ThreadPoolExecutor(len(tasks)) as pool:
        return [f.result() for f in [pool.submit(t) for t in tasks]]
