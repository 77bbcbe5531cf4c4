"""Table access and intermediate results that survive a lost executor."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


_written: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: the one the cluster names, or in a session without one a folder of our own."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="memloom-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    return f"file://{own}"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one; ``release`` deletes it."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def materialize(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` as a parquet table in the shared folder and read it back.

    Cuts the lineage and lets several later steps read one computed result;
    any executor can read it, and a lost one takes nothing with it.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    w = df.write
    if partition_by:
        w = w.partitionBy(partition_by)
    w.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_shared(df: DataFrame, name: str) -> str:
    """Write ``df`` as ``materialize`` does and give its path, for tasks that read it themselves by ``read_shared``."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return path


def read_shared(path: str, columns: list[str] | None = None, part: str | None = None, names: bool = False) -> Iterator:
    """The Arrow batches of a table in the shared folder, file by file in order (one of them with ``part``), or the names of its files.

    Called in tasks, which reach the folder by its scheme as Arrow knows it.
    """
    import pyarrow.fs as fs
    import pyarrow.parquet as pq

    where, root = fs.FileSystem.from_uri(path)
    files = [part] if part else sorted(x.path for x in where.get_file_info(fs.FileSelector(root)) if x.base_name.startswith("part-"))
    for f in files:
        if names:
            yield f
            continue
        with where.open_input_file(f) as opened:
            yield from pq.ParquetFile(opened).iter_batches(columns=columns)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least one partition per core: a small file read by one task would keep the others idle in Python steps.

    Only plain scans are looked at; what comes out of a shuffle is spread already.
    """
    plan = df._jdf.queryExecution().sparkPlan().toString()
    if any(x in plan for x in ("Join", "Aggregate", "Exchange", "Window", "Sort")):
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def release(spark: SparkSession) -> int:
    """Delete the intermediate tables written so far; for sessions that go on after a result was saved. Returns their number."""
    jvm, n = spark.sparkContext._jvm, 0
    while _written:
        p = jvm.org.apache.hadoop.fs.Path(_written.pop())
        n += bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True))
    return n
