"""Tokens are told apart by hashes of their words' hashes, made in the tasks."""

import random

from pyspark.sql import functions as F
from test_core import rows

from memloom.functions.text import cue_tokens, rich_tokens
from memloom.operators import counts, recall

TEXTS = ["", None, "x", "alpha", "alpha beta", "beta alpha", "alpha beta gamma alpha beta gamma", "ÄÖ ß 4711 İstanbul, alpha_beta", "one two three four five six seven eight nine ten eleven twelve thirteen"]


def test_token_hashes_stand_for_tokens(spark):
    rng = random.Random(6)
    r = rows(spark, [{"content": rng.choice(TEXTS), "context": rng.choice(TEXTS), "outcome": rng.choice(TEXTS)} for _ in range(200)])
    cols = [F.col(c) for c in ("content", "context", "outcome")]
    t = r.select(rich_tokens(*cols).alias("ts"), counts.token_words(*cols).alias("ws")).toArrow().combine_chunks()
    flat, ptr = counts.token_lists(t["ws"])
    got = [frozenset(flat[a:b].tolist()) for a, b in zip(ptr[:-1].tolist(), ptr[1:].tolist())]
    want = [frozenset(x) for x in t["ts"].to_pylist()]
    assert [len(x) for x in got] == [len(x) for x in want]
    # rows share as many hashes as tokens
    assert all(len(got[i] & got[j]) == len(want[i] & want[j]) for i in range(200) for j in range(i))


def test_overlaps_make_no_token_strings(spark):
    # all tokens of all rows were built and hashed as strings, which took most of the time of the overlaps
    own = rows(spark, [{"content": x, "context": y} for x in TEXTS for y in TEXTS])
    cues = spark.createDataFrame([(f"q{i}", x) for i, x in enumerate(TEXTS) if x], "cue_id string, cue string")
    pairs = cues.crossJoin(own).select("cue_id", "engram_id")
    df = recall.pair_overlap(own, cues, pairs)
    assert "bg:c:" not in df._jdf.queryExecution().optimizedPlan().toString()
    ts = own.select("engram_id", rich_tokens(F.col("content"), F.col("context"), F.col("outcome")).alias("ts")).crossJoin(cues.select("cue_id", cue_tokens(F.col("cue")).alias("cs")))
    want = ts.select("cue_id", "engram_id", F.size(F.array_intersect("ts", "cs")).cast("long"), F.size("cs"))
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, want.collect()))
