"""A store of versioned parquet tables and an append-only event log.

A commit writes new table folders and then a manifest of its own number, under
another name first: the rename makes the version visible, and no moment lacks a
manifest.  Readers follow the newest one, so they see whole versions only.  The
log is the source of truth: state is a snapshot plus the events after its
sequence number.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

EVENT_SCHEMA = (
    "seq long, op string, engram_id string, content string, context string, outcome string, agent_id string, salience double, separation double, kind string, source_uri string, doc_id string, chunk_id string, "
    "tick long, verified boolean, confidence double, key string, magnitude double"
)
OPS = ("experience", "verify", "core", "forget", "forget_before", "replay", "absorb", "sleep", "reward", "tick", "death", "compact")
#: Events that touch all rows (deaths, forget_before) travel as one broadcast row up to this number.
MOST_GLOBAL = 10_000


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _manifests(self) -> list[int]:
        at = self._path(f"{self.root}/manifest")
        return sorted(int(f.getPath().getName()[1:]) for f in self._fs.listStatus(at) if f.getPath().getName()[:1] == "v") if self._fs.exists(at) else []

    def manifest(self) -> dict:
        """The committed version, its tables and the last event in them; version zero for a new store."""
        known = self._manifests()
        if not known:
            return {"version": 0, "tables": {}, "seq": 0}
        return json.loads(self.spark.read.text(f"{self.root}/manifest/v{known[-1]:012d}", wholetext=True).first()[0])

    def commit(self, tables: dict[str, DataFrame], seq: int) -> int:
        """Write tables as a new version and return its number; a version another writer took first is an error."""
        m = self.manifest()
        v = m["version"] + 1
        names = dict(m["tables"])
        for name, df in tables.items():
            names[name] = f"{name}/v{v}"
            df.write.mode("overwrite").parquet(f"{self.root}/{names[name]}")
        new, final = self._path(f"{self.root}/manifest/.v{v}.new"), self._path(f"{self.root}/manifest/v{v:012d}")
        out = self._fs.create(new, True)
        out.write(bytearray(json.dumps({"version": v, "tables": names, "seq": seq}).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(new, final):
            raise RuntimeError(f"version {v} was committed by another writer")
        return v

    def verify(self) -> DataFrame:
        """(name, rows, error): every committed table read once."""
        out = []
        for name in sorted(self.manifest()["tables"]):
            try:
                out.append((name, self.table(name).count(), None))
            except Exception as e:  # an unreadable table is what this reports
                out.append((name, None, type(e).__name__))
        return self.spark.createDataFrame(out, "name string, rows long, error string")

    def truncate(self) -> int:
        """Delete log files all of whose events a snapshot holds; returns their number."""
        seq, n = self.manifest()["seq"], 0
        if not self._fs.exists(self._path(f"{self.root}/log")):
            return 0
        raw = self.spark.read.schema(EVENT_SCHEMA).json(f"{self.root}/log").groupBy(F.input_file_name().alias("f")).agg(F.max("seq").alias("last")).filter(F.coalesce("last", F.lit(0)) <= seq)
        for r in raw.toLocalIterator():
            n += bool(self._fs.delete(self._path(r["f"]), False))
        return n

    def replica(self, root: str) -> "Store":
        """Copy the committed version and the log to another root; readers there see this version until the next copy."""
        other, m = Store(self.spark, root), self.manifest()
        for path in m["tables"].values():
            self.spark.read.parquet(f"{self.root}/{path}").write.mode("overwrite").parquet(f"{other.root}/{path}")
        self.log(m["seq"]).write.mode("overwrite").json(f"{other.root}/log")
        if m["version"] and m["version"] not in other._manifests():
            out = other._fs.create(other._path(f"{other.root}/manifest/v{m['version']:012d}"), True)
            out.write(bytearray(json.dumps(m).encode()))
            out.close()
        return other

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{self.manifest()['tables'][name]}")

    def append(self, events: DataFrame) -> None:
        """Append events (EVENT_SCHEMA) to the log."""
        cols = [f.name for f in self.spark.createDataFrame([], EVENT_SCHEMA).schema]
        events.select(*cols).write.mode("append").json(f"{self.root}/log")

    def log(self, after: int = 0) -> DataFrame:
        """Events after ``after``; broken lines are skipped, an event logged twice counts once."""
        if not self._fs.exists(self._path(f"{self.root}/log")):
            return self.spark.createDataFrame([], EVENT_SCHEMA)
        raw = self.spark.read.schema(EVENT_SCHEMA + ", _broken string").option("columnNameOfCorruptRecord", "_broken").json(f"{self.root}/log")
        return raw.filter("_broken is null and seq is not null").drop("_broken").filter(F.col("seq") > after).dropDuplicates(["seq"])

    def state(self) -> DataFrame:
        """Live rows: the snapshot with all later events applied."""
        m = self.manifest()
        live = replay(self.log(m["seq"]), self.table("rows") if "rows" in m["tables"] else None)
        return live

    def checkpoint(self) -> int:
        """Commit the present state; returns the new version."""
        last = self.log().agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
        return self.commit({"rows": self.state()}, max(last, self.manifest()["seq"]))


ROW_SCHEMA = (
    "engram_id string, content string, context string, outcome string, agent_id string, salience double, separation double, kind string, source_uri string, doc_id string, chunk_id string, "
    "tick long, verified boolean, confidence double, is_core boolean, replay_count long, life int, seq long"
)
_BORN = ("content", "context", "outcome", "agent_id", "salience", "separation", "kind", "source_uri", "doc_id", "chunk_id", "tick", "verified", "confidence")


def replay(events: DataFrame, snapshot: DataFrame | None = None) -> DataFrame:
    """Fold of all events that touch rows into rows, in one aggregate per row.

    A row exists from its first experience on; verification, core marks,
    replays and absorbed rows after it count.  It is gone if it is forgotten or
    absorbed by another, if its tick lies under a later forget_before, or at
    the first death after it; core rows outlive the last two, with the life
    they were born in.
    """
    spark = events.sparkSession
    base = snapshot if snapshot is not None else spark.createDataFrame([], ROW_SCHEMA)
    born = events.filter("op = 'experience'").groupBy("engram_id").agg(F.min(F.struct("seq", *_BORN)).alias("b"))
    everywhere = events.filter("op in ('death', 'forget_before')").select("op", "seq", "tick")
    if everywhere.limit(MOST_GLOBAL + 1).count() > MOST_GLOBAL:
        raise RuntimeError(f"more than {MOST_GLOBAL} events over all rows since the snapshot; commit one first")
    one = F.broadcast(everywhere.agg(F.collect_list(F.when(F.col("op") == "death", F.col("seq"))).alias("deaths"), F.collect_list(F.when(F.col("op") == "forget_before", F.struct("seq", "tick"))).alias("cuts")))
    last = base.agg(F.max("life")).first()[0] if snapshot is not None else None
    lives = F.lit(last or 0)
    born = born.crossJoin(one).select("engram_id", *[f"b.{c}" for c in _BORN], F.lit(False).alias("is_core"), F.lit(0).cast("long").alias("replay_count"), (lives + F.size(F.filter("deaths", lambda x: x < F.col("b.seq")))).cast("int").alias("life"), "b.seq")
    born = born.withColumn("verified", F.coalesce("verified", F.lit(False)))
    rows = base.unionByName(born.join(base.select("engram_id"), "engram_id", "left_anti").select(base.columns))
    of = lambda op, c="seq": F.when(F.col("op") == op, F.col(c))
    marks = events.filter("op in ('verify', 'core', 'forget', 'replay', 'absorb')").groupBy("engram_id").agg(
        F.max_by("confidence", of("verify")).alias("v_conf"), F.max(of("verify")).alias("v_seq"), F.min(of("core")).alias("c_seq"), F.max(F.greatest(of("forget"), of("absorb"))).alias("f_seq"), F.count(of("replay")).alias("n_replays"),
    )
    gained = events.filter("op = 'absorb'").groupBy(F.col("key").alias("engram_id")).agg(F.max("salience").alias("g_sal"), F.sum("magnitude").cast("long").alias("g_rep"))
    r = rows.join(marks, "engram_id", "left").join(gained, "engram_id", "left").filter("f_seq is null or f_seq < seq").crossJoin(one)
    core_by = lambda at: F.col("is_core") | F.coalesce(F.col("c_seq") < at, F.lit(False))
    cut = F.exists("cuts", lambda x: (x["seq"] > F.col("seq")) & (F.coalesce("tick", F.lit(0)) < x["tick"]) & ~core_by(x["seq"]))
    dead = F.exists("deaths", lambda x: (x > F.col("seq")) & ~core_by(x))
    r = r.filter(~cut & ~dead)
    conf = F.when(F.col("v_seq").isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("v_conf", F.lit(1.0))))).otherwise(F.col("confidence"))
    r = r.withColumn("verified", F.col("verified") | F.col("v_seq").isNotNull()).withColumn("confidence", conf).withColumn("is_core", F.col("is_core") | F.col("c_seq").isNotNull())
    r = r.withColumn("salience", F.greatest("salience", "g_sal")).withColumn("replay_count", F.col("replay_count") + F.coalesce("n_replays", F.lit(0)) + F.coalesce("g_rep", F.lit(0)))
    return r.select(base.columns)


def ordered(events: DataFrame) -> DataFrame:
    """Events numbered anew by time and id, where a source has no sequence of its own."""
    return events.withColumn("seq", F.row_number().over(W.partitionBy("stream").orderBy("ts", "event_id")))
