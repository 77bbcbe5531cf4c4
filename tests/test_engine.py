"""The store's verbs end to end."""

import pytest
from pyspark.sql import functions as F

from memloom.engine import Memory, ResultCache, progress, provenance

SCHEMA = "place int, content string, context string, verified boolean, confidence double"


def test_memory(spark, tmp_path):
    m = Memory(spark, str(tmp_path / "m"))
    batch = spark.createDataFrame([(0, "database connection pool exhausted on the edge", "prod", None, None), (1, "database connection pool exhausted on the edge", "lab", None, None), (2, "redis cache miss storm", "prod", True, 0.9), (3, None, "prod", None, None)], SCHEMA)
    v = {r["engram_id"]: r["accepted"] for r in m.experience(batch).collect()}
    assert sorted(v.values()) == [False, True, True, True]
    assert m.experience(batch.filter("place = 2")).count() == 0  # sent again
    best = m.activate("connection pool")
    assert len(best) == 1 and m.activate("connection pool") == best
    keep = best[0][0]
    m.mark_core(keep)
    m.verify(keep, 3.0)
    assert m.checkpoint() == 1
    m.forget_before(1_000)
    live = m.rows().collect()
    assert [r["engram_id"] for r in live] == [keep] and live[0]["provenance"]["confidence"] == 1.0 and live[0]["is_core"]
    assert m.activate("connection pool")[0][1] > best[0][1]  # verified rows rank higher
    m.forget(keep)
    assert m.rows().count() == 0 and m.activate("connection pool") == [] and m.status().count() == 0
    assert set(m.sleep()) == {"facts", "edges", "duplicates", "replayed"}


FULL = "place int, content string, context string, agent_id string, salience_hint double, doc_id string, chunk_id string"


def test_life_cycle(spark, tmp_path):
    """Refusals, chunks, sleep, compaction, death: everything is in the log, and replay gives the state again."""
    m = Memory(spark, str(tmp_path / "m"), quota=4)
    rows = [
        (0, "the planner moved the index to another shard", "work", "a", 2.0, "d", "1"), (1, "a wholly different remark about lunch", "work", "b", 0.1, "d", "1"), (2, "token ghp_" + "x" * 24, "work", "a", 0.1, None, None),
        (3, "x" * 9000, "work", "a", 0.1, None, None), (4, "replicas lag behind the leader by minutes", "work", "b", None, None, None), (5, "nobody restarted the crawler last night", "work", None, 0.7, None, None), (6, "queue lengths doubled after the release", "work", None, 0.7, None, None), (7, "the fifth row is over the quota", "work", None, 0.7, None, None),
    ]
    got = m.experience(spark.createDataFrame(rows, FULL)).collect()
    assert sorted(r["reason"] for r in got if r["reason"]) == ["deduplicated", "quota", "secret", "too long"]
    live = {r["content"]: r for r in m.rows().collect()}
    first = live["the planner moved the index to another shard"]
    assert len(live) == 4 and first["agent_id"] == "a" and first["salience"] == 1.0 and first["rag"]["doc_id"] == "d" and first["separation_index"] is not None
    assert m.activate("planner index", agent="b") == [] and m.activate("planner index", agent="a")[0][0] == first["engram_id"]
    c = m.control()
    assert c["stage"] == 2 and c["experiences"] == 4 and c["norepinephrine"] > 0.3
    m.sleep()
    assert {r["replay_count"] for r in m.rows().collect()} == {1} and m.control()["dopamine"] < 0.5
    m.mark_core(first["engram_id"], "plan")
    m.reward(1.0)
    m.death("test")
    m.experience(spark.createDataFrame([(0, "a new life begins with this", "work", None, 0.2, None, None)], FULL))
    life = {r["content"]: r["life_id"] for r in m.rows().collect()}
    assert life == {"the planner moved the index to another shard": "life-0", "a new life begins with this": "life-1"}
    assert [tuple(r) for r in m.core_memories().collect()] == [("plan", first["engram_id"], first["content"])]
    whole = {tuple(r) for r in m.rows().collect()}
    m.checkpoint()
    assert {tuple(r) for r in Memory(spark, str(tmp_path / "m"), read_only=True).rows().collect()} == whole
    with pytest.raises(PermissionError):
        Memory(spark, str(tmp_path / "m"), read_only=True).reward(1.0)


def test_compaction_and_ticks(spark, tmp_path):
    m = Memory(spark, str(tmp_path / "m"))
    b = spark.createDataFrame([(0, "ledger rows agree with the bank statement of today", "x", True, 0.9), (1, "ledger rows agree with the bank statement of today", "x ", True, 0.9), (2, "unrelated remark", "x", None, None)], SCHEMA)
    assert m.experience(b).filter("accepted").count() == 3  # verified rows pass the gate
    assert m.compact() == 1 and m.rows().count() == 2
    assert m.tick(360) == 1 and m.tick(10) == 0 and m.control()["sleeps"] >= 1


def test_project(spark, tmp_path):
    from memloom.project import Project

    p = Project(spark, str(tmp_path / "p"), "planner")
    assert p.session_context() == "" and p.handoffs().count() == 0
    p.remember("the release train leaves on monday", verified=True, confidence=0.9).count()
    p.remember("private remark about the release", shared=False).count()
    assert {side for side, *_ in p.recall("release")} == {"project", "agent"} and {side for side, *_ in p.recall("release", "agent")} == {"agent"}
    p.handoff("indexer half done", "core/index", "blocked", ["finish"])
    text = p.session_context("core/index/")
    assert "release train" in text and "[blocked] planner in core/index: indexer half done" in text
    with pytest.raises(ValueError):
        Project(spark, str(tmp_path / "p"), "../x")


def test_command_line(spark, tmp_path, capsys):
    from memloom.__main__ import main, run

    m = Memory(spark, str(tmp_path / "c"))
    assert run(m, "remember", ["a note for later"])[0]["accepted"] and run(m, "recall", ["note later"])[0]["activation"] > 0
    assert run(m, "checkpoint", []) == 1 and run(m, "check", [])[0]["rows"] == 1 and run(m, "stage", [])["experiences"] == 1
    assert main([]) == 2 and "remember TEXT" in capsys.readouterr().out


def test_embedded(spark):
    from memloom.sources.fovea import embedded

    d = spark.createDataFrame([(1, "alpha beta"), (2, ""), (3, None)], "id int, t string")
    v = {r["id"]: r["vector"] for r in embedded(d, "id", "t").collect()}
    assert len(v[1]) == 32 and sum(x * x for x in v[1]) == pytest.approx(1, abs=1e-5) and v[2] is None and v[3] is None
    assert embedded(d, "id", "t", lambda c: F.array(F.length(c).cast("float"))).filter("id = 1").first()["vector"] == [10.0]


def test_cache():
    c = ResultCache(2, 60)
    c.put("a", 1)
    c.put("b", 2)
    assert c.get("a") == 1
    c.put("c", 3)
    assert c.get("b") is None and c.get("a") == 1 and ResultCache(2, -1).get("a") is None


def test_progress_and_provenance(spark):
    assert progress(15, 1, 20, 2) == 1.0 and progress(0, 0, 0, 0) == 2 / 3 and progress(0, 0, 0, 6) == 1.0
    d = spark.createDataFrame([("x", True, None), ("tool_grounded", True, None), ("x", None, "d"), (None, False, None)], "k string, v boolean, d string")
    got = [tuple(r["p"])[::2] for r in d.select(provenance(F.col("k"), F.col("v"), F.col("d")).alias("p")).collect()]
    assert got == [("ledger_verified", True), ("tool_grounded", True), ("file_observation", False), ("chat_assertion", False)]
