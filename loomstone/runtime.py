"""Session helpers: reading input tables and cutting lineage in shared storage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Session property that names the folder all executors and the driver share.
SHARED_DIR = "spark.checkpoint.dir"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Lazily read one input table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared scratch folder.

    A cluster names it in ``spark.checkpoint.dir``.  Where that is unset on one
    machine (master ``local``), a temporary folder of this process is used and
    remembered in the session; elsewhere that is an error, since executors would
    write to disks that the others cannot read.
    """
    named = spark.conf.get(SHARED_DIR, None) or spark.conf.get("loomstone.scratch.dir", None)
    if not named:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local[") and master != "local":
            raise RuntimeError(f"{SHARED_DIR} must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="loomstone-")
        spark.conf.set("loomstone.scratch.dir", named)
    return named.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/loomstone-{uuid.uuid4().hex}/{name}"


def persist_table(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    The result has no lineage beyond the files, survives lost executors, and can
    be read any number of times with column pruning.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    for made in _RECORDS:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


_RECORDS: list[list[str]] = []


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The paths that :func:`persist_table` writes meanwhile, in order."""
    made: list[str] = []
    _RECORDS.append(made)
    try:
        yield made
    finally:
        _RECORDS.pop()


def drop_paths(spark: SparkSession, paths: Iterable[str], unless: Iterable[DataFrame] = ()) -> None:
    """Delete scratch tables, apart from those that the frames ``unless`` read."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    # Below the shared folder each table has a folder of its own, named by a random number.
    key = lambda p: p.rsplit("/loomstone-", 1)[-1].split("/", 1)[0]
    used = {key(f) for df in unless for f in df.inputFiles()}
    for name in set(paths):
        if key(name) not in used:
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(conf).delete(path, True)


def drop_table(df: DataFrame) -> None:
    """Delete the files below a frame made by :func:`persist_table`."""
    drop_paths(df.sparkSession, {f.rsplit("/", 1)[0] for f in df.inputFiles()})
