"""Unit tests of the core: tokens, gate, edges, folds, store, sources, streams."""

import random

import pytest
from pyspark.sql import functions as F

from memloom.functions import stages as S
from memloom.functions.text import cue_tokens, dollar_amounts, jaccard, micro, rich_tokens, slug, word_set
from memloom.operators import gate, graph, lifecycle, query, recall
from memloom.sources import fovea
from memloom.sources.store import EVENT_SCHEMA, Store, replay

ROW = "engram_id string, tenant_id string, life_id string, agent_id string, content string, context string, outcome string, encoded_at_tick long, salience float, replay_count int, separation_index float, is_core boolean, rag struct<source_uri:string,doc_id:string,chunk_id:string>, provenance struct<kind:string,source_uri:string,confidence:float,verified:boolean>"


def rows(spark, items):
    base = {"tenant_id": "t", "life_id": "l", "agent_id": "a", "context": "work", "outcome": None, "salience": 0.5, "replay_count": 0, "separation_index": 1.0, "is_core": False, "rag": None, "provenance": ("chat_assertion", None, 0.3, False)}
    names = [c.split()[0] for c in ROW.split(", ")]
    out = []
    for i, x in enumerate(items):
        d = {**base, "engram_id": f"e{i:03d}", "encoded_at_tick": i, **x}
        out.append(tuple(d.get(n) for n in names))
    return spark.createDataFrame(out, ROW)


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def test_rich_tokens(spark):
    got = set(one(spark, rich_tokens(F.lit("agent completed task successfully"), F.lit("workspace"), F.lit("saved"))))
    assert len(got) == 13
    assert {"c:agent", "x:workspace", "o:saved", "bg:c:agent_completed", "tg:c:completed_task_successfully", "ctx@workspace", "sum@agent_completed_task_successfully"} <= got


def test_cue_tokens_and_empty(spark):
    assert set(one(spark, cue_tokens(F.lit("tool timeout")))) == {"c:tool", "c:timeout", "bg:c:tool_timeout", "ctx@", "sum@tool_timeout"}
    assert one(spark, rich_tokens(F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string"))) == ["ctx@", "sum@"]
    assert one(spark, slug(F.lit("One two three four five six seven"))) == "one_two_three_four_five_six"


def test_jaccard_properties(spark):
    a, b = word_set(F.lit("task failed timeout")), word_set(F.lit("task failed latency"))
    assert one(spark, jaccard(a, b)) == pytest.approx(0.5) == one(spark, jaccard(b, a))
    assert one(spark, jaccard(a, word_set(F.lit("")))) == 0.0


def test_dollars(spark):
    assert one(spark, dollar_amounts(F.lit("pay $12.50, then $ 7 or 9"))) == [12.5, 7.0]


def test_gate_fixtures(spark):
    text = "I think my wallet balance is $60 from yesterday's chat"
    r = rows(spark, [{"content": text}, {"content": text}, {"content": "task failed timeout"}, {"content": "task failed latency"}, {"content": text, "provenance": ("ledger_verified", None, 0.9, True)}, {"content": text, "context": "ledger:x"}])
    got = {x["engram_id"]: x["accepted"] for x in gate.ordered_gate(r).collect()}
    assert got == {"e000": True, "e001": False, "e002": True, "e003": True, "e004": True, "e005": True}
    snap = {x["engram_id"]: x["verdict"] for x in gate.snapshot_gate(r).collect()}
    assert snap["e001"] == "reject" and snap["e004"] == "accept" and snap["e005"] == "accept"


def test_ordered_gate_equals_a_plain_walk(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(14)]
    items = [{"content": " ".join(rng.choice(vocab) for _ in range(rng.randint(3, 9))), "tenant_id": rng.choice(["a", "b", None]), "separation_index": rng.choice([0.125, 0.25, 0.5, 1.0])} for _ in range(160)]
    got = {x["engram_id"]: x["accepted"] for x in gate.ordered_gate(rows(spark, items), window=20).collect()}
    for tenant in ("a", "b", None):
        kept = []
        for i, it in enumerate(items):
            if it["tenant_id"] != tenant:
                continue
            ws, best = set(it["content"].split()), None
            for p, sep in kept[-20:]:
                j = round(len(ws & p) / len(ws | p), 9)
                if j >= S.REVIEW and (best is None or j > best[0]):
                    best = (j, sep)
            ok = best is None or not (best[0] >= S.REJECT or max(best[1], 1 - best[0]) < S.MIN_SEPARATION)
            assert got[f"e{i:03d}"] == ok
            if ok:
                kept.append((ws, it["separation_index"]))


def test_ordered_gate_of_copies_is_linear(spark):
    """Twenty thousand equal rows of one tenant: the first and, each time it has left the window, no other is accepted."""
    r = spark.range(20_000).selectExpr("lpad(cast(id as string), 6, '0') engram_id", "'t' tenant_id", "'the same words again and again' content", "'c' context", "cast(null as string) outcome", "id encoded_at_tick", "cast(1 as float) separation_index", "cast(null as struct<kind:string,verified:boolean>) provenance")
    g = gate.ordered_gate(r)
    assert g.filter("accepted").count() == 1 and g.count() == 20_000


def test_assess_against_all_rows_before(spark):
    """Chunks with borders see the same rows as a plain scan."""
    from memloom.operators import order

    rng = random.Random(9)
    items = [{"content": " ".join(rng.choice("abcdefghij") * 3 for _ in range(rng.randint(0, 6))), "tenant_id": rng.choice(["a", None])} for _ in range(120)]
    w = order.windows_before
    try:
        gate.windows_before = lambda r, s, n: w(r, s, n, 16)
        got = {x["engram_id"]: x for x in gate.assess(rows(spark, items), window=10).collect()}
    finally:
        gate.windows_before = w
    for tenant in ("a", None):
        seen = []
        for i, it in enumerate(items):
            if it["tenant_id"] != tenant:
                continue
            ws = set(it["content"].split())
            best = max((round(len(ws & p) / len(ws | p), 9) if ws and p else 0.0 for p in seen[-10:]), default=0.0)
            assert got[f"e{i:03d}"]["jaccard"] == pytest.approx(best)
            seen.append(ws)


def test_numbered_places(spark):
    from memloom.operators.order import numbered

    d = spark.createDataFrame([(g, i) for i in range(500) for g in ("a", None, "c")], "g string, i int").repartition(7)
    n = numbered(d, "g", ["i"]).collect()
    assert len(n) == 1500 and all(x["ord"] == x["i"] + 1 for x in n)


def test_insert_once(spark):
    new = spark.createDataFrame([(1, "d", "1"), (2, "d", "1"), (3, "d", "2"), (4, None, "2")], "episode_id long, doc_id string, chunk_id string")
    old = spark.createDataFrame([("d", "2")], "doc_id string, chunk_id string")
    assert [tuple(r) for r in gate.insert_once(new, old).collect()] == [(1, "d", "1")]


def test_edges(spark):
    e = spark.createDataFrame([("a", "b", 0.3, 1), ("a", "b", 0.8, 2), ("b", "c", 0.1, 3)], "src string, dst string, weight double, n int")
    assert {tuple(r) for r in graph.merge_max(e).collect()} == {("a", "b", 0.8), ("b", "c", 0.1)}
    assert {tuple(r) for r in graph.keep_first(e, ["n"]).collect()} == {("a", "b", 0.3), ("b", "c", 0.1)}
    assert graph.prune(e, 0.2).count() == 2
    w = graph.wiring(rows(spark, [{"content": "alpha beta gamma"}, {"content": ""}, {"content": None}]))
    f = {x["engram_id"]: x for x in graph.features(rows(spark, [{"content": "alpha beta gamma"}])).collect()}["e000"]
    assert f["dg"] == sorted(f["dg"]) and set(f["dg"]) < set(f["ca3"]) and len(f["ca3"]) == 2 * len(f["dg"]) - 1
    one = [(x["src"], x["dst"], x["weight"]) for x in w.filter("engram_id = 'e000'").collect()]
    # infant stage: a clique of four, eight links of each chain
    assert len(one) == 6 + 8 + 8 and all(a < b for a, b, _ in one) and sorted(x for *_, x in one) == [0.2] * 8 + [0.3] * 14


def test_spread_decays(spark):
    edges = spark.createDataFrame([("a", "b", 0.5), ("b", "c", 0.5)], "src string, dst string, weight double")
    seeds = spark.createDataFrame([(1, "a", 1.0)], "cue_id int, node string, activation double")
    got = {r["node"]: r["activation"] for r in recall.spread(seeds, edges, 0.6, 1).collect()}
    assert got == pytest.approx({"a": 1.0, "b": 0.3})


def test_recall_prefers_verified_and_scopes(spark):
    r = rows(spark, [{"content": "database connection pool exhausted", "agent_id": "a"}, {"content": "database connection pool exhausted today", "agent_id": "b", "provenance": ("ledger_verified", None, 0.9, True)}])
    cues = spark.createDataFrame([("q", "connection pool", "a")], "cue_id string, cue string, agent_id string")
    every = recall.recall(r, cues).collect()
    assert {x["engram_id"] for x in every} == {"e000", "e001"} and [x["verified"] for x in sorted(every, key=lambda x: x["rank"])][0]
    for scope in ("pre", "post"):
        assert [x["engram_id"] for x in recall.recall(r, cues, scope=scope).collect()] == ["e000"]


def test_recall_of_nothing(spark):
    r = rows(spark, [])
    cues = spark.createDataFrame([("q", "connection pool", "a")], "cue_id string, cue string, agent_id string")
    assert recall.recall(r, cues).count() == 0


def test_separation_fixture(spark):
    r = rows(spark, [{"content": "task failed timeout", "context": "production"}, {"content": "task failed latency", "context": "production"}])
    a, b = sorted(gate.assess(r).collect(), key=lambda x: x["engram_id"])
    assert (a["separators"], a["separation"], a["peer"]) == (0, 1.0, None)
    assert b["overlap"] == pytest.approx(10 / 26) and b["separators"] == 6 and b["overlap_after"] == pytest.approx(10 / 32) and b["separation"] == pytest.approx(0.6875)


def test_hybrid_recall_by_vector_alone(spark):
    """A row without a word of the cue is found by its vector; one without either is not."""
    unit = lambda i: [1.0 if k == i else 0.0 for k in range(64)]
    r = rows(spark, [{"content": "redis cache miss storm"}, {"content": "nginx upstream timeout"}, {"content": "graphql limit"}])
    v = spark.createDataFrame([("e000", unit(1)), ("e001", unit(2)), ("e002", None)], "engram_id string, vector array<float>")
    cues = spark.createDataFrame([("q", "proxy timeout", "a", unit(1)), ("none", "", "a", None)], "cue_id string, cue string, agent_id string, vector array<float>")
    got = {x["engram_id"]: x["activation"] for x in recall.recall(r.join(v, "engram_id"), cues).collect()}
    assert set(got) == {"e000", "e001"} and got["e000"] == pytest.approx(0.45 * 2 / 10 * 0 + 0.2) or got["e000"] > 0.19
    wired = recall.recall(r.join(v, "engram_id"), cues, edges=graph.merge_max(graph.wiring(r.drop("life_id"), life="life")))
    assert wired.filter("engram_id = 'e001'").first()["activation"] >= got["e001"]


def test_ledger_row_comes_first(spark):
    r = rows(spark, [{"content": "wallet balance is 60 dollars"}, {"content": "ledger verified: agent wallet balance is $0.00", "context": "ledger:wallet", "provenance": ("ledger_verified", None, 0.99, True)}, {"content": "wallet wallet wallet"}])
    cues = spark.createDataFrame([("q", "wallet balance", "a", "t"), ("z", "weather", "a", "t")], "cue_id string, cue string, agent_id string, tenant_id string")
    got = recall.prefer_ledger(recall.recall(r, cues), cues, r).collect()
    assert [x["engram_id"] for x in sorted(got, key=lambda x: x["rank"])][0] == "e001" and all(x["cue_id"] == "q" for x in got)
    assert max(x["activation"] for x in got) >= 10


def test_cosine_of_merging(spark):
    """Rows of middling word overlap merge if their vectors are nearly equal; core rows never."""
    r = rows(spark, [{"content": "alpha beta gamma delta epsilon zeta"}, {"content": "alpha beta gamma delta epsilon theta"}, {"content": "alpha beta gamma delta epsilon zeta", "is_core": True}, {"content": "something else entirely"}])
    v = spark.createDataFrame([("e000", [1.0] * 64), ("e001", [1.0] * 63 + [1.1]), ("e003", [1.0] * 64)], "engram_id string, vector array<double>")
    assert graph.merge_pairs(r).count() == 0
    p = graph.merge_pairs(r, v).collect()
    assert [(x["a"], x["b"]) for x in p] == [("e000", "e001")] and p[0]["cosine"] > 0.94 and 0.35 < p[0]["jaccard"] < 0.85


def test_keepers_are_greedy(spark):
    p = spark.createDataFrame([("t", "a", "b"), ("t", "b", "c"), ("t", "c", "d"), ("u", "a", "z")], "scope string, a string, b string")
    got = {(x["scope"], x["cls"]): x["keeper"] for x in graph.keepers(p).collect()}
    assert got == {("t", "a"): "a", ("t", "b"): "a", ("t", "c"): "c", ("t", "d"): "c", ("u", "a"): "a", ("u", "z"): "a"}


def test_preplay_walks(spark):
    from memloom.operators.preplay import preplay, terminal

    r = rows(spark, [{"content": "alpha beta gamma"}]).drop("life_id")
    cues = spark.createDataFrame([("q", "alpha beta gamma")], "cue_id string, cue string")
    p = preplay(graph.merge_max(graph.wiring(r, life="life")), cues, r, 3)
    assert [x["step"] for x in p.orderBy("step").collect()] == [0, 1, 2] and p.select("node").distinct().count() == 3
    assert terminal(p).first()["previews"] == ["alpha beta gamma"]


def test_fovea_packets(spark):
    d = spark.createDataFrame([(1, "The quick brown fox jumps over the lazy dog while agents read in fixations"), (2, ""), (3, None)], "doc_id long, text string")
    p = fovea.packets(d, "doc_id", "text").orderBy("packet").collect()
    assert [(x["doc_id"], x["token_offset"], x["salience_percent"]) for x in p] == [(1, 0, 45), (1, 8, 55)]
    assert p[0]["after"] == "in fixations" and p[1]["before"] == "The quick brown fox jumps over the lazy" and p[1]["after"] == ""


def test_query_pages_and_forget(spark):
    r = rows(spark, [{"content": f"row {i}", "is_core": i == 0} for i in range(30)])
    assert [x["tick"] for x in query.page(r, 1, 10).collect()] == list(range(10, 20))
    assert query.forget_before(r, 25).count() == 6


def test_modulators_clip(spark):
    e = spark.createDataFrame([("k", i + 1, i, 1.0, None, i == 3) for i in range(5)], "k string, tick long, event_id long, reward double, surprise double, sleeps boolean")
    got = lifecycle.modulators(e, "k").orderBy("event_id").collect()
    assert [round(r["dopamine"], 3) for r in got] == [0.5, 0.7, 0.9, 1.0, 0.85] and round(got[4]["acetylcholine"], 2) == 0.75


def test_stages_need_rows_sleeps_and_pruned(spark):
    e = spark.createDataFrame([("k", i, i > 1, i % 3 == 0, 2) for i in range(1, 60)], "k string, tick long, experience boolean, sleeps boolean, pruned int")
    t = lifecycle.stage_timeline(e, "k")
    first = {r["stage"]: r["t"] for r in t.groupBy("stage").agg(F.min("tick").alias("t")).collect()}
    assert first == {1: 1, 2: 4, 3: 20} and lifecycle.stage_report(t, "k").first()["next_stage"] == "adolescent"


def test_secrets(spark):
    from memloom.functions.text import has_secret

    bad = ["ghp_" + "a" * 20, "github_pat_" + "b" * 20, "sk-" + "c" * 20, "AKIA" + "D" * 16, "-----BEGIN RSA PRIVATE KEY-----", "-----BEGIN PRIVATE KEY-----"]
    good = ["ghp_short", "sk-" + "c" * 19, "-----BEGIN DSA PRIVATE KEY-----", "plain"]
    d = spark.createDataFrame([(x,) for x in bad + good], "x string").select("x", has_secret(F.col("x")).alias("s")).collect()
    assert [r["s"] for r in d] == [True] * len(bad) + [False] * len(good)


def test_clipped_keeps_whole_characters(spark):
    got = [one(spark, fovea.clipped(F.lit(x), 80)) for x in ("a" * 80, "a" * 81, "é" * 41, "数" * 30)]
    assert got == ["a" * 80, "a" * 79 + "…", "é" * 39 + "…", "数" * 26 + "…"]


def test_micro_rounds_half_up(spark):
    assert one(spark, micro(F.lit(0.0000005))) == 1


def events(spark, items):
    names = [c.split()[0] for c in EVENT_SCHEMA.split(", ")]
    return spark.createDataFrame([tuple({"seq": i + 1, **x}.get(n) for n in names) for i, x in enumerate(items)], EVENT_SCHEMA)


LOG = [
    {"op": "experience", "engram_id": "a", "content": "x", "tick": 1}, {"op": "experience", "engram_id": "b", "content": "y", "tick": 2}, {"op": "core", "engram_id": "a"},
    {"op": "verify", "engram_id": "b", "confidence": 7.0}, {"op": "experience", "engram_id": "c", "content": "z", "tick": 3}, {"op": "forget", "engram_id": "c"}, {"op": "forget_before", "tick": 2},
]


def test_replay(spark):
    got = {r["engram_id"]: (r["verified"], r["confidence"], r["is_core"]) for r in replay(events(spark, LOG)).collect()}
    assert got == {"a": (False, None, True), "b": (True, 1.0, False)}


def test_store_round_trip(spark, tmp_path):
    st = Store(spark, str(tmp_path / "store"))
    st.append(events(spark, LOG[:4]))
    assert st.checkpoint() == 1
    rest = events(spark, LOG).filter("seq > 4")
    st.append(rest)
    st.append(rest)  # logged twice
    with open(tmp_path / "store/log/broken.json", "w") as f:
        f.write("{not json\n")
    whole = {tuple(r) for r in replay(events(spark, LOG)).collect()}
    assert {tuple(r) for r in st.state().collect()} == whole
    assert st.checkpoint() == 2 and {tuple(r) for r in st.table("rows").collect()} == whole


def test_deaths_absorbed_and_replays(spark):
    log = [{"op": "experience", "engram_id": x, "content": x, "salience": 0.25} for x in "abc"] + [{"op": "core", "engram_id": "a"}, {"op": "replay", "engram_id": "a"}, {"op": "absorb", "engram_id": "c", "key": "a", "salience": 0.5, "magnitude": 4.0}, {"op": "death"}, {"op": "experience", "engram_id": "d", "content": "d"}]
    got = {r["engram_id"]: (r["life"], r["salience"], r["replay_count"]) for r in replay(events(spark, log)).collect()}
    assert got == {"a": (0, 0.5, 5), "d": (1, None, 0)}


def test_store_upkeep(spark, tmp_path):
    st = Store(spark, str(tmp_path / "s"))
    st.append(events(spark, LOG[:4]))
    st.checkpoint()
    assert st.truncate() >= 1 and st.log().count() == 0 and st.state().count() == 2
    assert [(r["name"], r["rows"], r["error"]) for r in st.verify().collect()] == [("rows", 2, None)]
    copy = st.replica(str(tmp_path / "copy"))
    assert copy.state().count() == 2 and copy.manifest() == st.manifest()
    # a manifest another writer put there first is not overwritten
    st.manifest = lambda: {"version": 0, "tables": {}, "seq": 0}
    with pytest.raises(RuntimeError):
        st.commit({}, 9)


def test_export_import(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/engrams.parquet")
    fovea.export_raw(e, str(tmp_path / "raw"))
    assert fovea.import_raw(spark, str(tmp_path / "raw"), e).exceptAll(e).count() == 0


def test_feed(spark, tmp_path):
    (tmp_path / "f.json").write_text('{"kind":"user","content":"hello"}\n{broken\n{"kind":"tool","content":"bye","context":"c"}\n')
    got = sorted((r["content"], r["context"], r["salience_hint"], len(r["chunk_id"])) for r in fovea.read_feed(spark, str(tmp_path / "f.json")).collect())
    assert got == [("bye", "c", 0.58, 16), ("user:hello", "feed", 0.62, 16)]


def test_stream_ingest_is_idempotent(spark, sf, tmp_path):
    from memloom.streaming import ingest as st

    for _ in range(2):
        st.ingest(spark, st.read_events(spark, sf), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == spark.read.parquet(f"{sf}/events.parquet").count()


def test_log_tail_and_expiring_keys(spark, tmp_path):
    from memloom.streaming import ingest as st

    store = Store(spark, str(tmp_path / "s"))
    store.append(events(spark, LOG[:3]))
    store.append(events(spark, LOG).filter("seq > 3"))
    got = st.drain(st.log_tail(spark, str(tmp_path / "s")), "append")
    assert {tuple(r) for r in replay(got).collect()} == {tuple(r) for r in replay(events(spark, LOG)).collect()}
    (tmp_path / "in").mkdir()
    spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:00:30"), ("b", "2024-01-01 00:00:10")], "k string, ts string").coalesce(1).write.json(str(tmp_path / "in/x"))
    s = spark.readStream.schema("k string, ts timestamp").json(str(tmp_path / "in/x"))
    assert sorted(r["k"] for r in st.drain(st.fresh(s, "k"), "append").collect()) == ["a", "b"]


def test_release_deletes_intermediate_tables(spark):
    from memloom.sources.tables import materialize, release, spread

    d = materialize(spark.range(5).toDF("x"), "five")
    assert d.count() == 5 and release(spark) >= 1
    assert spread(spark.range(10).repartition(1)).count() == 10
