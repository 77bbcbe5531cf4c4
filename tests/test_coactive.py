"""Edges and the rows in which both their ends are active: brute force, block borders, features as the columns make them, no features in exchanges."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_core import rows
from test_counts import moved

from memloom.operators import coactive, graph
from memloom.plans import catalog

TEXTS = [
    {"content": "Alpha beta, gamma ÄÖ delta alpha beta", "context": "one two three four five six seven", "outcome": "saved", "life_id": "l"},
    {"content": "Alpha beta, gamma ÄÖ delta alpha beta", "context": "one two three four five six seven", "outcome": "saved", "life_id": "l", "salience": 0.7},
    {"content": "alpha beta gamma", "context": None, "outcome": None, "life_id": None},
    {"content": None, "context": "x:y", "outcome": None, "life_id": None},
    {"content": "x", "context": "", "outcome": "", "life_id": "l", "salience": float("nan")},
    {"content": "x " * 30 + "ticket 4711 İstanbul ß", "context": "RAG:a-1#2", "outcome": "failed", "life_id": "l"},
]


def test_features_as_the_columns_make_them(spark, monkeypatch):
    monkeypatch.setattr(coactive, "STEP_ROWS", 4)
    r = rows(spark, TEXTS)
    want = {x["engram_id"]: (x["dg"], x["ca3"]) for x in graph.features(r).collect()}
    got = {}
    for b in coactive.texts(r, "life_id", engram_id=F.col("engram_id")).toArrow().to_batches():
        at = 0
        for dg, ends, ca3, bound_ends in coactive.features(b):
            for i in range(len(ends) - 1):
                got[b["engram_id"][at].as_py()] = (dg[ends[i] : ends[i + 1]].tolist(), ca3[bound_ends[i] : bound_ends[i + 1]].tolist())
                at += 1
    assert got == want
    edges = lambda df: sorted(map(tuple, df.select("src", "dst", "weight").collect()))
    assert edges(coactive.wired(r)) == edges(graph.wiring(r))


@pytest.mark.parametrize(("pairs", "heavy"), [(2_000_000, 512), (3, 2)])
def test_edges_meet_blocks(monkeypatch, pairs, heavy):
    monkeypatch.setattr(coactive, "CHUNK_PAIRS", pairs)
    monkeypatch.setattr(coactive, "HEAVY", heavy)
    rng = random.Random(5)
    own = [(rng.sample(range(30), rng.randint(0, 12)), rng.random()) for _ in range(40)]
    src, dst = (np.array(x) for x in zip(*sorted((rng.randrange(34), rng.randrange(34)) for _ in range(200))))
    n, gain = np.zeros(200, np.int64), np.zeros(200)
    for part in (own[:25], own[25:], [([], 1.0)]):
        at = np.repeat(np.arange(len(part)), [len(x) for x, _ in part]).astype(np.uint16)
        b = coactive._block([(np.array([y for x, _ in part for y in x], np.int64), at, np.array([g for _, g in part]))])
        coactive._meet(src, dst, n, gain, b.to_pylist()[0])
    for s, d, k, g in zip(src.tolist(), dst.tolist(), n.tolist(), gain.tolist()):
        both = [y for x, y in own if s in x and d in x]
        assert k == len(both) and g == pytest.approx(sum(both))


@pytest.mark.parametrize(("block", "chunk"), [(65_536, 2_000_000), (4, 7)])
def test_co_active_against_brute_force(spark, monkeypatch, block, chunk):
    monkeypatch.setattr(coactive, "INDEX_ROWS", block)
    monkeypatch.setattr(coactive, "CHUNK_EDGES", chunk)
    r = rows(spark, TEXTS * 7).withColumn("gate", F.lit(0.25))
    edges = graph.merge_max(graph.wiring(r)).unionByName(spark.createDataFrame([(1, 2, 0.5)], "src long, dst long, weight double"))
    of = [set(x["ca3"]) for x in graph.features(r).collect()]
    got = coactive.co_active(edges, r, F.col("gate")).collect()
    assert len(got) == edges.count()
    for x in got:
        n = sum(x["src"] in s and x["dst"] in s for s in of)
        assert (x["n"], x["gain"]) == (n, 0.25 * n)
    none = coactive.co_active(edges, r.withColumn("engram_id", F.lit(None).cast("string")), F.col("gate"))
    assert none.filter("n > 0").isEmpty()


def test_hebbian_weights_move_no_features(spark, sf):
    # every feature of every row was shuffled, once for each end of an edge
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = catalog.queries()["hebbian_weights"](spark, sf)
        assert all("src#" in x for x in moved(df)) and "Join" not in df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_no_rows(spark):
    r = rows(spark, TEXTS).filter("false")
    assert coactive.wired(r).isEmpty()
    none = graph.together(spark.createDataFrame([(1, 2, 0.5)], "src long, dst long, weight double"), r)
    assert [tuple(x) for x in none.collect()] == [(1, 2, 0.5, 0, 0.0)]
