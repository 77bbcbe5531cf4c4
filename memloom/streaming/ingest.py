"""Structured Streaming: idempotent ingest, admission with state, log tail, expiring keys, tick windows, session activity."""

from __future__ import annotations

import json
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.functions import stages as S
from memloom.functions.text import word_set
from memloom.sources.store import EVENT_SCHEMA
from memloom.sources.tables import shared_dir


def read_events(spark: SparkSession, sf_dir: str, name: str = "events") -> DataFrame:
    """A table as a stream of files; event times become zoned timestamps, which watermarks need."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}*.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


def drain(stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream over all data available now and return its result as a table in the shared folder.

    ``append`` results are the batches together, ``complete`` ones the last
    batch.  A batch that is run again after a failure overwrites itself.
    """
    spark = stream.sparkSession
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    last: list[int] = []

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{at}/out/batch={batch}")
        last.append(batch)

    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    if not last:
        return spark.createDataFrame([], stream.schema)
    path = f"{at}/out" if mode == "append" else f"{at}/out/batch={max(last)}"
    return spark.read.schema(stream.schema).parquet(path).select(*stream.columns)


def deduplicated(events: DataFrame, delay: str = "2 days") -> DataFrame:
    """Each event once, by user, type and time, within the watermark; the state forgets older ones."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def tick_windows(events: DataFrame, width: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Counts and values by tumbling window and type."""
    g = events.withWatermark("ts", delay).groupBy(F.window("ts", width), "event_type")
    return g.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), "event_type", "n", "value")


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Sessions of each user: no pause of ``gap`` or more."""
    g = events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), "user_id")
    return g.agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")


def ingest(spark: SparkSession, stream: DataFrame, target: str, checkpoint: str) -> None:
    """Append a stream's rows to a parquet table, each micro-batch once: a batch replayed after a failure overwrites itself."""

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{target}/batch={batch}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


GATE_OUT = "scope string, engram_id string, peer string, jaccard double, accepted boolean"


def gated(rows: DataFrame, window: int = S.GATE_WINDOW) -> DataFrame:
    """Verdicts of a stream of rows (scope, engram_id, content, free): each scope's state holds the word sets of its last ``window`` accepted rows.

    Within a micro-batch the rows of a scope go by ``place``.  A row is refused
    at a word Jaccard of the reject limit or more with an accepted row; the
    review band needs a separation, which a stream of new rows does not have.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    def run(key, batches, state):
        kept = [(i, frozenset(w)) for i, w in json.loads(state.get[0])] if state.exists else []
        out = []
        new = [r for pdf in batches for r in pdf.itertuples(index=False)]
        for r in sorted(new, key=lambda x: (x.place, x.engram_id)):
            ws, best = frozenset(r.ws if r.ws is not None else ()), None
            for i, w in kept:
                j = round(len(ws & w) / len(ws | w), 9) if ws and w else 0.0
                if j > 0 and (best is None or j > best[0]):
                    best = (j, i)
            ok = bool(r.free) or best is None or best[0] < S.REJECT
            if ok:
                kept = [*kept, (r.engram_id, ws)][-window:]
            out.append((key[0], r.engram_id, best[1] if best else None, best[0] if best else None, ok))
        state.update((json.dumps([(i, sorted(w)) for i, w in kept]),))
        yield pd.DataFrame(out, columns=["scope", "engram_id", "peer", "jaccard", "accepted"]).astype({"peer": object, "jaccard": "float64"})

    return rows.select("scope", "engram_id", word_set(F.col("content")).alias("ws"), "free", "place").groupBy("scope").applyInPandasWithState(run, GATE_OUT, "kept string", "append", GroupStateTimeout.NoTimeout)


def log_tail(spark: SparkSession, root: str) -> DataFrame:
    """The event log of a store as a stream: new files of it as they come, broken lines left out."""
    raw = spark.readStream.schema(EVENT_SCHEMA + ", _broken string").option("columnNameOfCorruptRecord", "_broken").json(f"{root.rstrip('/')}/log")
    return raw.filter("_broken is null and seq is not null").drop("_broken")


def fresh(events: DataFrame, key: str, seconds: int = 60) -> DataFrame:
    """Events whose ``key`` was not seen in the ``seconds`` before: a cache of keys that expire, as state under a watermark."""
    return events.withWatermark("ts", f"{seconds} seconds").dropDuplicatesWithinWatermark([key])
