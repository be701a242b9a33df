"""Where intermediate tables live, and the words that several operators share.

Every intermediate table goes to the folder named by ``spark.checkpoint.dir``,
which driver and executors share; a lost executor can therefore reread it. Only
where the setting is missing and the session runs on this machine alone (tests), a
temporary folder is used; a cluster without the setting is an error.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java regular expression of the white space that ends a word.
SPACE = r"[\x20\x09-\x0D]+"
#: A word: a run without white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_root(spark: SparkSession) -> str:
    """The shared folder of the session, without a trailing slash."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
    if set_dir.isDefined():
        return set_dir.get().rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="roadweave-")
    spark.sparkContext.setCheckpointDir(root)
    return root


#: Paths that the running pipeline stage has made, while one runs; those of the stage before.
_in_stage: list[str] | None = None
_last_stage: list[str] = []


@contextmanager
def stage_tables(spark: SparkSession) -> Iterator[None]:
    """Marks the intermediates made inside as a pipeline stage's; the next stage deletes them.

    A stage's result has been written when the next stage begins, so nothing reads them then.
    """
    global _in_stage, _last_stage
    for path in _last_stage:
        drop_shared(spark, path)
    _in_stage, _last_stage = [], []
    try:
        yield
    finally:
        _in_stage, _last_stage = None, _in_stage


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, deleted when the JVM ends."""
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    if _in_stage is not None:
        _in_stage.append(path)
    return path


def drop_shared(spark: SparkSession, path: str) -> None:
    """Delete a path below the shared folder that nothing reads any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """What is planned and run inside hands Python at most ``rows`` texts at a time; the JVM and Python hold a batch each."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again."""
    path = shared_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def without(columns: list[str], made: Iterable[str]) -> list[str]:
    """``columns`` without those named like one of ``made``; as in Spark, case does not count."""
    taken = {c.lower() for c in made}
    return [c for c in columns if c.lower() not in taken]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words_of(text: Column) -> Column:
    """Array of the words of a text; null and blank texts have none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
