"""A memory store with the engine's verbs: experience, activate, verify, forget, mark_core, sleep, compact, tick, reward, death, checkpoint.

Every change is an event in the store's log; state is the snapshot plus later
events. Whole batches go in and out as DataFrames.
"""

from __future__ import annotations

import time
from collections import OrderedDict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from memloom.functions import stages as S
from memloom.functions.text import has_secret, rich_tokens
from memloom.operators import gate, graph, lifecycle, query, recall
from memloom.operators.order import numbered
from memloom.sources.store import EVENT_SCHEMA, Store
from memloom.sources.tables import materialize

KINDS = ("chat_assertion", "file_observation", "tool_grounded", "ledger_verified", "user_explicit")


def provenance(kind: Column, verified: Column, doc_id: Column) -> Column:
    """Provenance of a row that came without a full one: verified rows keep their kind at 0.95, rows with a document are observations at 0.6, others chat at 0.35."""
    known = F.when(F.lower(F.trim(kind)).isin(*KINDS), F.lower(F.trim(kind))).otherwise("ledger_verified")
    v = F.coalesce(verified, F.lit(False))
    return F.struct(
        F.when(v, known).when(doc_id.isNotNull(), "file_observation").otherwise("chat_assertion").alias("kind"), F.when(v, 0.95).when(doc_id.isNotNull(), 0.6).otherwise(0.35).cast("float").alias("confidence"), v.alias("verified")
    )


def progress(rows: int, sleeps: int, ticks: int, stage: int) -> float:
    """Mean share of the next stage's needs in rows, sleeps and ticks; one at the last stage."""
    if stage + 1 >= len(S.STAGES):
        return 1.0
    need = S.STAGES[stage + 1][5:8]
    return sum(1.0 if n == 0 else min(1.0, x / n) for x, n in zip((rows, sleeps, ticks), need)) / 3


class ResultCache:
    """Results of small recalls by cue, vector, agent and store version; least recently used ones leave first, old ones expire."""

    def __init__(self, size: int = 512, seconds: float = 60.0):
        self.size, self.seconds, self._kept = size, seconds, OrderedDict()

    def get(self, key):
        hit = self._kept.get(key)
        if hit is None or time.monotonic() - hit[0] > self.seconds:
            self._kept.pop(key, None)
            return None
        self._kept.move_to_end(key)
        return hit[1]

    def put(self, key, value) -> None:
        self._kept[key] = (time.monotonic(), value)
        self._kept.move_to_end(key)
        while len(self._kept) > self.size:
            self._kept.popitem(last=False)


class Memory:
    """One tenant's store.  Rows that must not be stored, repeated chunks and near copies are refused; everything else is logged."""

    def __init__(self, spark: SparkSession, root: str, tenant: str = "default", quota: int = S.QUOTA_ROWS, read_only: bool = False):
        self.spark, self.store, self.tenant, self.cache, self.quota, self.read_only = spark, Store(spark, root), tenant, ResultCache(), quota, read_only

    def rows(self) -> DataFrame:
        """Live rows in the shape of the recall and query operators."""
        r = self.store.state()
        prov = F.struct(F.coalesce("kind", F.when(F.col("verified"), "ledger_verified").otherwise("chat_assertion")).alias("kind"), "source_uri", F.col("confidence").cast("float").alias("confidence"), "verified")
        return r.select(
            "engram_id", F.lit(self.tenant).alias("tenant_id"), F.concat(F.lit("life-"), F.col("life").cast("string")).alias("life_id"), "agent_id", "content", "context", "outcome", F.coalesce("tick", "seq").alias("encoded_at_tick"), F.col("salience").cast("float").alias("salience"),
            F.col("replay_count").cast("int").alias("replay_count"), F.col("separation").cast("float").alias("separation_index"), "is_core", query.rag_ref(F.col("source_uri"), F.col("doc_id"), F.col("chunk_id")).alias("rag"), prov.alias("provenance"),
        )

    def _log(self, events: DataFrame) -> None:
        if self.read_only:
            raise PermissionError("opened for reading")
        have = {f.name for f in events.schema}
        kinds = [c.split() for c in EVENT_SCHEMA.split(", ")]
        self.store.append(events.select(*[F.col(n).cast(t).alias(n) if n in have else F.lit(None).cast(t).alias(n) for n, t in kinds]))

    def _next(self) -> int:
        return max(self.store.manifest()["seq"], self.store.log().agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]) + 1

    def control(self) -> dict:
        """Stage, counters and modulators: the log's fold, on top of the last commit's."""
        e = self.store.log().select(F.lit("log").alias("log"), F.col("seq").alias("tick"), F.col("seq").alias("event_id"), (F.col("op") == "experience").alias("experience"), (F.col("op") == "sleep").alias("sleeps"), F.lit(0).alias("pruned"), F.when(F.col("op") == "reward", F.col("magnitude")).alias("reward"), F.when((F.col("op") == "experience") & (F.col("salience") > 0.5), F.col("salience")).alias("surprise"), "op")
        end = self.spark.createDataFrame([("log", 1 << 60, 1 << 60, False, False, 0, None, None, "end")], e.schema)
        m = lifecycle.modulators(e.unionByName(end), "log").filter(F.col("event_id") == 1 << 60).first()
        n = e.agg(F.count_if(F.col("op") == "experience").alias("x"), F.count_if(F.col("op") == "sleep").alias("s"), F.count_if(F.col("op").isin("experience", "sleep", "tick")).alias("t"), F.count_if(F.col("op") == "death").alias("d")).first()
        counted = e.filter(F.col("op").isin("experience", "sleep", "tick"))
        st = lifecycle.stage_timeline(numbered_ticks(counted), "log").agg(F.max("stage").alias("stage")).first()["stage"]
        stage = st if st is not None else 0
        return {"stage": stage, "name": S.STAGES[stage][1], "experiences": n["x"], "sleeps": n["s"], "ticks": n["t"], "deaths": n["d"], "progress": progress(n["x"], n["s"], n["t"], stage), "dopamine": m["dopamine"], "acetylcholine": m["acetylcholine"], "norepinephrine": m["norepinephrine"]}

    def experience(self, episodes: DataFrame) -> DataFrame:
        """Store a batch (place, content, context and, if given, outcome, agent_id, salience_hint, doc_id, chunk_id, source_uri, kind, verified, confidence; place orders it).

        Returns (engram_id, accepted, peer, jaccard, reason).  Refused are texts
        over the limit or with a secret, chunks stored before (the row already
        there is named as peer), rows over the quota, and what the gate
        rejects, judged in order against the rows stored.  A row's id is a hash
        of its text and context, so a batch sent again is stored once.
        """
        seq = self._next()
        have = {f.name for f in episodes.schema}
        col = lambda n, t: F.col(n).cast(t) if n in have else F.lit(None).cast(t)
        hint = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.nanvl(col("salience_hint", "double"), F.lit(0.5)), F.lit(0.5))))
        prov = provenance(col("kind", "string"), col("verified", "boolean"), col("doc_id", "string"))
        new = episodes.select(
            (F.col("place").cast("long") + seq).alias("seq"), F.sha2(F.concat_ws("|", F.lit(self.tenant), "context", "content"), 256).substr(1, 32).alias("engram_id"), "content", "context", col("outcome", "string").alias("outcome"), col("agent_id", "string").alias("agent_id"),
            hint.alias("salience"), prov["kind"].alias("kind"), col("source_uri", "string").alias("source_uri"), col("doc_id", "string").alias("doc_id"), col("chunk_id", "string").alias("chunk_id"), prov["verified"].alias("verified"), F.coalesce(col("confidence", "double"), prov["confidence"].cast("double")).alias("confidence"),
        )
        live = materialize(self.rows(), "rows")
        new = new.groupBy("engram_id").agg(F.min(F.struct(*[c for c in new.columns if c != "engram_id"])).alias("x")).select("engram_id", "x.*").join(live.select("engram_id"), "engram_id", "left_anti")
        bad = F.when(F.char_length("content") > S.MAX_CONTENT, "too long").when(has_secret(F.col("content")), "secret")
        new = materialize(new.withColumn("refused", bad), "new")
        # a chunk is stored once; within the batch its first row comes first
        stored = live.filter("rag.doc_id is not null and rag.chunk_id is not null").groupBy(F.col("rag.doc_id").alias("doc_id"), F.col("rag.chunk_id").alias("chunk_id")).agg(F.min("engram_id").alias("known"))
        first = new.filter("refused is null and doc_id is not null and chunk_id is not null").groupBy("doc_id", "chunk_id").agg(F.min_by("engram_id", "seq").alias("first"))
        n = new.join(stored, ["doc_id", "chunk_id"], "left").join(first, ["doc_id", "chunk_id"], "left")
        n = n.withColumn("known", F.coalesce("known", F.when(F.col("first") != F.col("engram_id"), F.col("first")))).withColumn("refused", F.coalesce("refused", F.when(F.col("known").isNotNull(), "deduplicated")))
        n = materialize(n, "judged")
        as_row = lambda d: d.select("engram_id", F.lit(self.tenant).alias("tenant_id"), "content", "context", "outcome", F.col("seq").alias("encoded_at_tick"), F.struct("kind", "source_uri", F.col("confidence").cast("float").alias("confidence"), "verified").alias("provenance"))
        shape = ["engram_id", "tenant_id", "content", "context", "outcome", "encoded_at_tick", "provenance"]
        fresh = n.filter("refused is null")
        every = live.select(*shape).unionByName(as_row(fresh))
        sep = gate.assess(every).select("engram_id", "separation")
        every = every.join(sep, "engram_id").withColumn("separation_index", F.col("separation"))
        verdict = gate.ordered_gate(every).join(fresh.select("engram_id"), "engram_id", "left_semi")
        verdict = materialize(verdict.join(sep, "engram_id").join(fresh.select("engram_id", "seq"), "engram_id"), "verdict")
        room = self.quota - live.count()
        ranked = verdict.withColumn("place", F.when(F.col("accepted"), F.sum(F.col("accepted").cast("int")).over(W.orderBy("seq"))))
        judged = materialize(ranked.withColumn("reason", F.when(~F.col("accepted"), "near copy").when(F.col("place") > room, "quota")).withColumn("accepted", F.col("reason").isNull()), "verdict")
        self._log(n.join(judged.filter("accepted").select("engram_id", "separation"), "engram_id").withColumn("op", F.lit("experience")).withColumn("tick", F.col("seq")))
        out = judged.select("engram_id", "accepted", "peer", "jaccard", "reason")
        return out.unionByName(n.filter("refused is not null").select("engram_id", F.lit(False).alias("accepted"), F.col("known").alias("peer"), F.lit(None).cast("double").alias("jaccard"), F.col("refused").alias("reason")))

    def _event(self, op: str, **values) -> None:
        row = {"seq": self._next(), "op": op, **values}
        names = [c.split()[0] for c in EVENT_SCHEMA.split(", ")]
        self._log(self.spark.createDataFrame([tuple(row.get(n) for n in names)], EVENT_SCHEMA))

    def verify(self, engram_id: str, confidence: float = 0.95) -> None:
        self._event("verify", engram_id=engram_id, confidence=confidence)

    def mark_core(self, engram_id: str, key: str | None = None) -> None:
        self._event("core", engram_id=engram_id, key=key or engram_id)

    def forget(self, engram_id: str) -> None:
        self._event("forget", engram_id=engram_id)

    def forget_before(self, tick: int) -> None:
        self._event("forget_before", tick=tick)

    def reward(self, magnitude: float) -> None:
        self._event("reward", magnitude=magnitude)

    def death(self, cause: str = "") -> None:
        """End this life: all but core rows go, rows from here on belong to the next."""
        self._event("death", content=cause, key=f"death:{self.control()['deaths'] + 1}")

    def core_memories(self) -> DataFrame:
        """(key, engram_id, content): the last row marked under each key."""
        marks = self.store.log().filter("op = 'core'").groupBy("key").agg(F.max_by("engram_id", "seq").alias("engram_id"))
        return marks.join(self.store.state().select("engram_id", "content"), "engram_id", "left").select("key", "engram_id", "content")

    def activate(self, cue: str, k: int = S.TOP_K, agent: str | None = None) -> list[tuple[str, float]]:
        """The k best rows of one cue (of one agent), from the cache while the store stands still."""
        key = (cue, k, agent, self._next())
        hit = self.cache.get(key)
        if hit is None:
            cues = self.spark.createDataFrame([("q", cue, agent, self.tenant)], "cue_id string, cue string, agent_id string, tenant_id string")
            hit = [(r["engram_id"], r["activation"]) for r in self.activate_batch(cues, k, "pre" if agent else None).orderBy("rank").collect()]
            self.cache.put(key, hit)
        return hit

    def activate_batch(self, cues: DataFrame, k: int = S.TOP_K, scope: str | None = None, wired: bool = True) -> DataFrame:
        """The k best rows of every cue, scored with the rows' own edges, ledger rows first where a cue asks for money."""
        rows = materialize(self.rows(), "rows")
        edges = materialize(graph.merge_max(graph.wiring(rows.drop("life_id"), life="life")), "edges") if wired else None
        got = recall.recall(rows, cues, k, scope, edges)
        return recall.prefer_ledger(got, cues.withColumn("tenant_id", F.lit(self.tenant)), rows, k)

    def sleep(self) -> dict[str, DataFrame]:
        """Replay the newest rows and log it; returns what consolidation derives from them: word facts and edges, pruned by the stage's threshold."""
        rows = materialize(self.rows(), "rows")
        recent = materialize(rows.orderBy(F.desc("encoded_at_tick"), "engram_id").limit(S.REPLAY_ROWS), "recent")
        seq = self._next()
        self._log(recent.select("engram_id").withColumn("op", F.lit("replay")).withColumn("seq", F.row_number().over(W.orderBy("engram_id")) + F.lit(seq - 1)))
        self._event("sleep")
        c = self.control()
        edges = materialize(graph.merge_max(graph.wiring(rows)), "edges")
        strong = graph.hebbian(graph.together(edges, recent))
        out = {"facts": graph.token_facts(recent), "edges": graph.prune(strong, S.STAGES[c["stage"]][3]), "duplicates": graph.exact_duplicates(rows), "replayed": recent.select("engram_id")}
        if c["sleeps"] % S.COMPACT_EVERY == 0:
            self.compact()
        return out

    def compact(self) -> int:
        """Merge rows that are equal or nearly so into the first of them and log what was absorbed; returns their number."""
        rows = materialize(self.rows(), "rows")
        body = rows.filter("not is_core").withColumn("ts", rich_tokens(F.col("content"), F.col("context"), F.col("outcome")))
        of = body.join(body.groupBy("ts").agg(F.min("engram_id").alias("cls")), "ts").select("engram_id", "cls", "salience", "replay_count")
        near = graph.keepers(graph.merge_pairs(rows)).select("cls", "keeper")
        gone = materialize(of.join(near, "cls", "left").select("engram_id", F.coalesce("keeper", "cls").alias("key"), "salience", "replay_count").filter("engram_id <> key"), "gone")
        seq = self._next()
        self._log(gone.select("engram_id", "key", "salience", F.col("replay_count").cast("double").alias("magnitude")).withColumn("op", F.lit("absorb")).withColumn("seq", F.row_number().over(W.orderBy("engram_id")) + F.lit(seq - 1)))
        self._event("compact")
        return gone.count()

    def tick(self, n: int = 1) -> int:
        """``n`` ticks; a sleep falls due every SLEEP_INTERVAL of them, as often as the window lets. Returns the number of sleeps."""
        seq = self._next()
        self._log(self.spark.range(n).select((F.col("id") + seq).alias("seq"), F.lit("tick").alias("op")))
        log = self.store.log().filter("op = 'tick'").select(F.lit("log").alias("log"), "seq")
        t = lifecycle.auto_sleeps(numbered_ticks(log.withColumn("tick", F.col("seq"))), "log")
        due = t.filter("slept").count() - self.store.log().filter("op = 'sleep' and key = 'auto'").count()
        for _ in range(max(0, due)):
            self.sleep()
            self._event("sleep", key="auto")
        return max(0, due)

    def status(self) -> DataFrame:
        return query.stats(self.rows())

    def checkpoint(self) -> int:
        return self.store.checkpoint()


def numbered_ticks(log: DataFrame) -> DataFrame:
    """``log`` with consecutive ticks in place of sequence numbers."""
    return numbered(log.withColumnRenamed("tick", "_seq"), "log", ["_seq"], "tick").drop("_seq")
