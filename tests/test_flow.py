"""Propagation and energies inside the tasks against the plans by joins."""

import random

import pytest
from pyspark.sql import functions as F
from test_core import rows

from memloom.operators import flow, graph, recall


def both(monkeypatch, of):
    """What ``of`` gives by arrays in the tasks and by joins."""
    out = []
    for most in (flow.MAX_GRAPH_EDGES, -1):
        monkeypatch.setattr(flow, "MAX_GRAPH_EDGES", most)
        out.append({(x[0], x[1]): x[2] for x in of().collect()})
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_spread_as_by_joins(spark, monkeypatch, seed):
    rng = random.Random(seed)
    e = {(rng.randrange(40), rng.randrange(40)): rng.choice([0.2, 0.3, 0.9, 0.01]) for _ in range(260)}
    edges = spark.createDataFrame([(a, b, w) for (a, b), w in e.items()], "src long, dst long, weight double")
    seeds = spark.createDataFrame([(f"q{i}", n, 1.0) for i in range(9) for n in rng.sample(range(60), 4)], "cue_id string, node long, activation double")
    a, b = both(monkeypatch, lambda: recall.spread(seeds, edges, 0.5))
    assert a.keys() == b.keys() and len(a) > 40
    assert all(a[k] == pytest.approx(b[k]) for k in a)


def test_spread_joins_no_edges(spark):
    # each hop was a shuffled join of all activations with the edges
    edges = spark.createDataFrame([(1, 2, 0.5)], "src long, dst long, weight double")
    seeds = spark.createDataFrame([("q", 1, 1.0)], "cue_id string, node long, activation double")
    df = recall.spread(seeds, edges, 0.5)
    assert "Join" not in df._jdf.queryExecution().executedPlan().toString()
    assert {x["node"]: x["activation"] for x in df.collect()} == {1: 1.0, 2: pytest.approx(1.0)}


def test_spread_without_edges(spark):
    edges = spark.createDataFrame([], "src long, dst long, weight double")
    seeds = spark.createDataFrame([("q", 1, 1.0), ("q", 2, 0.001)], "cue_id string, node long, activation double")
    assert [x["node"] for x in recall.spread(seeds, edges, 0.5).collect()] == [1]


def test_hybrid_recall_as_by_joins(spark, monkeypatch):
    rng = random.Random(7)
    vocab = [f"word{i}" for i in range(12)]
    r = rows(spark, [{"content": " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 8)))} for _ in range(40)])
    cues = spark.createDataFrame([(f"q{i}", " ".join(rng.choice(vocab) for _ in range(3))) for i in range(6)] + [("none", "")], "cue_id string, cue string").withColumn("agent_id", F.lit("a"))
    edges = graph.merge_max(graph.wiring(r, life="life"))
    a, b = both(monkeypatch, lambda: recall.recall(r, cues, edges=edges).select("cue_id", "engram_id", "activation"))
    assert a.keys() == b.keys() and len(a) > 20
    assert all(a[k] == pytest.approx(b[k]) for k in a)
