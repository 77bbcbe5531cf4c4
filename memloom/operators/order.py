"""Places of rows within a scope, and windows over the rows before, without ever sorting a scope in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.sources.tables import materialize


def numbered(rows: DataFrame, scope: str, order: list[str | Column], name: str = "ord") -> DataFrame:
    """``rows`` with their place (from one) in their scope, in ``order``, which must be total.

    One range partitioning sorts all rows by scope and order, so a large scope
    spreads over many tasks; places follow from each partition's size, of
    which there is one number a partition.
    """
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    s = rows.repartitionByRange(F.col(scope).asc_nulls_first(), *cols).sortWithinPartitions(F.col(scope).asc_nulls_first(), *cols)
    s = materialize(s.withColumn("_m", F.monotonically_increasing_id()), "sorted")
    sizes = s.groupBy(F.shiftright("_m", 33).cast("int").alias("_p")).agg(F.count(F.lit(1)).alias("n")).collect()
    at, starts = 0, []
    for r in sorted(sizes, key=lambda x: x["_p"]):
        starts.append((r["_p"], at))
        at += r["n"]
    # one row per shuffle partition
    base = F.broadcast(rows.sparkSession.createDataFrame(starts or [(0, 0)], "_p int, _start long"))
    g = s.withColumn("_p", F.shiftright("_m", 33).cast("int")).join(base, "_p").withColumn("_g", F.col("_start") + F.col("_m").bitwiseAND((1 << 33) - 1))
    first = g.groupBy(scope).agg(F.min("_g").alias("_first")).withColumnRenamed(scope, "_scope")
    out = g.join(first, F.col(scope).eqNullSafe(F.col("_scope")))
    return out.withColumn(name, F.col("_g") - F.col("_first") + 1).drop("_m", "_p", "_start", "_g", "_first", "_scope")


def windows_before(rows: DataFrame, scope: str, size: int, chunk: int = 2048, name: str = "ord") -> DataFrame:
    """``rows`` cut into chunks of their scope, each with the ``size`` rows before it as a border.

    Adds ``_chunk`` and ``_own`` (false for border rows); partitioned by scope
    and chunk and sorted by place, so a task meets a row after the ``size``
    rows before it.  A chunk holds at most ``chunk`` rows and its border.
    """
    step = max(chunk, size)
    c = F.floor((F.col(name) - 1) / step).cast("long")
    to_next = (F.col(name) - 1) % step >= step - size
    marks = F.when(to_next, F.array(F.struct(c.alias("c"), F.lit(True).alias("o")), F.struct((c + 1).alias("c"), F.lit(False).alias("o")))).otherwise(F.array(F.struct(c.alias("c"), F.lit(True).alias("o"))))
    out = rows.withColumn("_w", F.explode(marks)).withColumn("_chunk", F.col("_w.c")).withColumn("_own", F.col("_w.o")).drop("_w")
    return out.repartition(scope, "_chunk").sortWithinPartitions(scope, "_chunk", name)
