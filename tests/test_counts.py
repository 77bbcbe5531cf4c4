"""Seeds, BM25 and overlaps by compact blocks: brute force, block borders, and plans that read the rows once."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_core import rows

from memloom.operators import blocks, counts, graph, recall
from memloom.plans import catalog

SEEDED = ["lexical_seeds", "cue_overlap", "recall_batch", "candidate_cap", "recall_agent_post", "slim_payload"]


def made(spark, n=150, m=12, seed=3):
    rng = random.Random(seed)
    vocab = [f"wort{i}" for i in range(30)] + ["the"]
    text = lambda k: " ".join(rng.choice(vocab) for _ in range(rng.randint(0, k))) + rng.choice(["", " the the"])
    own = [{"content": text(12), "agent_id": rng.choice(["a", "b", None])} for _ in range(n)]
    cues = [(f"q{i}", text(6), rng.choice(["a", "b", None])) for i in range(m)] + [("q_empty", "", "a"), ("q_many", "the " * 300, "a")]
    return own, cues, rows(spark, own), spark.createDataFrame(cues, "cue_id string, cue string, agent_id string")


@pytest.mark.parametrize(("size", "agents", "group"), [(65_536, False, 32), (16, False, 32), (16, True, 32), (16, False, 1)])
def test_seeds_against_brute_force(spark, monkeypatch, size, agents, group):
    monkeypatch.setattr(counts, "INDEX_ROWS", size)
    monkeypatch.setattr(counts, "GROUP_BLOCKS", group)
    own, cues, r, c = made(spark)
    got = {(x["cue_id"], x["rank"]): (x["engram_id"], x["hits"]) for x in recall.lexical_seeds(r, c, 7, agents).collect()}
    want = {}
    for q, text, agent in cues:
        times = Counter(text.split())
        scored = [(-sum(times[w] for w in set(x["content"].split())), f"e{i:03d}") for i, x in enumerate(own) if not agents or agent is not None and x["agent_id"] == agent]
        want |= {(q, k + 1): (i, -s) for k, (s, i) in enumerate(sorted(x for x in scored if x[0])[:7])}
    assert got == want


@pytest.mark.parametrize("size", [65_536, 16])
def test_bm25_against_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(counts, "INDEX_ROWS", size)
    own, cues, r, c = made(spark)
    got = {(x["cue_id"], x["rank"]): (x["engram_id"], x["score"]) for x in recall.bm25(r, c, 5).collect()}
    docs = [x["content"].split() for x in own]
    avg, df, want = sum(map(len, docs)) / len(docs), Counter(w for d in docs for w in set(d)), {}
    for q, text, _ in cues:
        scored = []
        for i, d in enumerate(docs):
            tf = Counter(d)
            s = sum(math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(d) / avg)) for w in set(text.split()) if tf[w])
            scored.append((-round(s, 9), f"e{i:03d}", s))
        want |= {(q, k + 1): (i, s) for k, (_, i, s) in enumerate(sorted(x for x in scored if x[0] < 0)[:5])}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(got[k][1] == pytest.approx(want[k][1]) for k in want)


@pytest.mark.parametrize("name", [*SEEDED, "bm25_topk"])
def test_many_cues_read_the_rows_once(spark, sf, monkeypatch, name):
    # a pass of Python over all rows for each block of cues took the time at size
    monkeypatch.setattr(blocks, "BLOCK_CUES", 4)
    calls = []
    monkeypatch.setattr(blocks, "best_rows", lambda *a, **k: calls.append(a))
    monkeypatch.setattr(recall, "best_rows", lambda *a, **k: calls.append(a) or blocks_best(*a, **k))
    catalog.queries()[name](spark, sf)
    assert not calls


blocks_best = blocks.best_rows


@pytest.mark.parametrize("sets", [131_072, 5])
def test_overlaps_against_sets(spark, monkeypatch, sets):
    monkeypatch.setattr(counts, "SET_CUES", sets)
    rng = random.Random(4)
    a = [(f"e{i}", rng.sample(range(40), rng.randint(0, 20))) for i in range(30)]
    b = [(f"q{i}", rng.sample(range(60), rng.randint(0, 9))) for i in range(20)]
    pairs = [(q, e) for q, _ in b for e, _ in a if rng.random() < 0.5]
    got = counts.shared_counts(spark.createDataFrame(a, "engram_id string, x array<long>"), F.col("x"), spark.createDataFrame(b, "cue_id string, y array<long>"), F.col("y"), spark.createDataFrame(pairs, "cue_id string, engram_id string")).collect()
    da, db = dict(a), dict(b)
    assert sorted(map(tuple, got)) == sorted((q, e, len(set(da[e]) & set(db[q])), len(db[q])) for q, e in pairs)


def moved(df) -> list[str]:
    """What the exchanges of a plan carry."""
    text = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    parts = text.split("\n\n")
    return [p.split("\n")[1] for p in parts if ") Exchange" in p.split("\n")[0]]


@pytest.mark.parametrize("name", ["cue_overlap", "feature_overlap"])
def test_overlaps_move_no_features(spark, sf, monkeypatch, name):
    # a row's features were joined to each of its pairs and moved with them
    monkeypatch.setattr(recall, "MAX_BROADCAST_CUES", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = moved(catalog.queries()[name](spark, sf))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got and not any(x in line for line in got for x in ("ts#", "cts#", "dg#", "ca3#", "fs#", "cf#"))


def test_node_owners_join_nothing(spark, sf):
    # the exploded nodes, taken for small, were broadcast
    df = catalog.queries()["node_registry"](spark, sf)
    assert "Join" not in df._jdf.queryExecution().executedPlan().toString()
    r = rows(spark, [{"content": "alpha"}, {"content": "alpha beta"}])
    assert graph.node_owners(r).groupBy("engram_id").count().count() == 2
