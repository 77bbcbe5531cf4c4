"""Training-data operators on small tables: brute force, edge cases, SQL."""

import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from memloom.llm import queries as Q
from memloom.llm.dedupe import batch_repeats, components, same_text_groups
from memloom.llm.leakage import leaks
from memloom.llm.markov import cliques, closed_cliques, clusters, markov_clusters, similarity_graph
from memloom.llm.mixing import mix
from memloom.llm.pii import find_pii
from memloom.llm.spam import spam_pages
from memloom.llm.split import split_episodes
from memloom.llm.survivor import best_members, truth_discovery
from memloom.llm.textnorm import canonical, same
from memloom.llm.truncation import cut_records, cut_shares
from memloom.llm.vectors import from_arrays, from_blobs, similar_pairs, top_similar


def got(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


# -- p1 ---------------------------------------------------------------------------
EP = "episode_id long, content string, context string, rag struct<source_uri:string,doc_id:string,chunk_id:string>, piece string, kind int"
LIMITS = [("rag", 50, 10), ("other", 80, 5), (None, 3, 1)]


def test_split_episodes(spark):
    rows = [(1, "word " * 30, " RAG :x", ("u", "d/1", "c#2"), "clash", 1), (2, None, "rag:x", None, None, None), (3, "", None, None, None, 2), (4, "short", "rag:", None, None, None), (5, "w" * 80, "plain", None, None, None), (6, "w" * 81, "unknown:rag", None, None, None)]
    p = split_episodes(spark.createDataFrame(rows, EP), spark.createDataFrame(LIMITS, "kind string, max_chars int, overlap_chars int"))
    n = {(r["episode_id"], r["kind"]): r["n_pieces"] for r in p.collect()}
    assert set(n) == {(1, "rag"), (3, "other"), (4, "rag"), (5, "other"), (6, "other")}
    assert n[1, "rag"] > 1 and n[5, "other"] == 1 and n[6, "other"] == 2
    assert p.filter("char_length(piece) > max_chars").count() == 0
    assert p.filter("episode_id = 1").orderBy("piece_no").first()["chunk_id"] == "d%2F1#c%232@1/0"
    assert split_episodes(spark.createDataFrame([], EP), spark.createDataFrame([], "kind string, max_chars int, overlap_chars int")).count() == 0


# -- p2 ---------------------------------------------------------------------------
def test_cut_records(spark):
    rng = random.Random(2)
    full = [f"The {a} {b} lost its lease before dawn. Nobody expected that the {b} stalled again." for a in ("quiet", "noisy", "legacy", "shared") for b in ("edge pruner", "token budget", "sleep cycle", "review lane", "merge train")]
    rows = [("e", str(i), "f", rng.choice(full) + f" See case {i}.") for i in range(400)]
    rows += [("e", f"cut{i}", "f", (f"case {i}: " + rng.choice(full) + rng.choice(full))[:77]) for i in range(40)]
    rows += [("e", "dots", "f", "and so it goes for case 7..."), ("e", "dots2", "f", "and so it goes for case 8..."), ("e", "dots3", "f", "and so it goes for case 9...")] + [("e", f"nofs{i}", "f", full[i][:-1]) for i in range(5)]
    rows += [("e", "null", "f", None), ("e", "empty", "f", ""), ("e", "null feed", None, "All is well."), ("e", "again", "f", full[0]), ("e", "again", "f", full[0])]
    r = cut_records(spark.createDataFrame(rows, "rec_kind string, rec_key string, feed string, text string"))
    cut = {x["rec_key"] for x in r.filter("cut").collect()}
    assert {f"cut{i}" for i in range(40)} - cut == set() or len({f"cut{i}" for i in range(40)} - cut) <= 2
    assert not {k for k in cut if not k.startswith("cut")}
    assert r.filter("limit_measure is not null").count() >= 35
    share = {x["feed"]: x["cut_share"] for x in cut_shares(r).collect()}
    assert share["f"] > 0.05 and share[None] == 0
    assert cut_records(spark.createDataFrame([], "rec_kind string, rec_key string, feed string, text string")).count() == 0


# -- p3, p5 -----------------------------------------------------------------------------
def test_groups_and_hot_group(spark):
    base = "ticket #123456789 The support desk noticed that alerts fired twice in the shared hub during the weekly freeze."
    rows = [(f"a{i:04d}", "t1", base if i % 2 else base.replace("noticed", "saw")) for i in range(300)]
    rows += [("b1", "t1", base.replace("123456789", "123456780")), ("b2", "t2", base), ("c1", None, "free text of one row 5"), ("c2", None, "free text of one row 5"), ("d1", "t1", None), ("d2", "t1", ""), ("d3", "t1", "")]
    rows += [("w1", "t1", "the queue lost its ordering so the backlog spread"), ("w2", "t1", "The queue lost its ordring, so the backlog spread!"), ("w3", "t1", "the queue never lost its ordering so the backlog spread")]
    g = same_text_groups(spark.createDataFrame(rows, "id string, tenant string, text string"), "id", "text", ["tenant"])
    by = {}
    for r in g.collect():
        by.setdefault(r["group_id"], set()).add(r["id"])
    assert sorted(map(len, by.values())) == [2, 2, 300] and {"w1", "w2"} in by.values() and {"c1", "c2"} in by.values()


def test_salted_groups_agree(spark):
    rows = [(i, f"ticket #{1000000 + i % 40} the merge train stalled {'again ' * (i % 3)}today") for i in range(200)]
    df = spark.createDataFrame(rows, "id long, text string")
    a, b = (same_text_groups(df, "id", "text", [], s).groupBy("group_id").agg(F.array_sort(F.collect_list("id")).alias("m")) for s in (1, 3))
    assert got(a, "m") == got(b, "m")


def test_batches(spark):
    s = "row_id long, tenant string, text string"
    d = lambda *r: spark.createDataFrame(list(r), s)
    t = "build-1234567 The merge train stalled before dawn."
    out = batch_repeats(
        d((1, "a", t), (2, None, t)),
        [d((10, "a", t + " (resent)"), (11, "b", t), (12, "b", t.upper()), (13, None, t), (14, "a", "")), d((20, "b", t), (21, "a", t.replace("7", "8")), (22, "a", t.replace("7", "8")), (23, "b", None)), d()],
        ["tenant"],
    )
    assert got(out, "first_id", "repeat_id") == [(1, 10), (11, 12), (11, 20), (21, 22)]


def _plain_repeats(history, batches):
    """First and repeat ids by comparing every row with all accepted ones before it."""
    acc, out = [(i, canonical(t)) for i, t in history], []
    for b in batches:
        for i, t in sorted(b):
            w = canonical(t)
            hit = min((j for j, x in acc if j < i and same(w, x)), default=None)
            if hit is None:
                acc.append((i, w))
            else:
                out.append((hit, i))
    return sorted(out)


def _wordy(rng, n):
    """Texts without any digit, some of them lightly reworded copies of others, some chains of them."""
    vocab = ["".join(rng.choice("abcdefghiklmnoprstuvw") for _ in range(rng.randint(4, 9))) for _ in range(60)]
    base = [" ".join(rng.choice(vocab) for _ in range(rng.randint(6, 25))) for _ in range(n // 3)]
    out = []
    for _ in range(n):
        w = rng.choice(base).split()
        for _ in range(rng.choice((0, 0, 1, 1, 2))):
            k = rng.randrange(len(w))
            w[k] = w[k][:1] + rng.choice("xyzq") + w[k][1:]
        if rng.random() < 0.3:
            w.insert(0, "apparently")
        out.append(" ".join(w))
    return out


def test_batches_without_numbers_against_a_plain_pass(spark, tmp_path):
    from memloom.llm.dedupe import IncrementalIndex, with_canonical

    rng = random.Random(4)
    t = _wordy(rng, 240)
    parts = [list(enumerate(t))[a : a + 60] for a in (0, 60, 120, 180)]
    h, acc = [], []
    for i, x in parts[0]:
        w = canonical(x)
        if not any(same(w, y) for y in acc):
            acc.append(w)
            h.append((i, x))
    rows = lambda p: spark.createDataFrame([(i, "t", x) for i, x in p], "row_id long, s string, text string")
    want = _plain_repeats(h, parts[1:])
    assert got(batch_repeats(rows(h), [rows(p) for p in parts[1:]], ["s"]), "first_id", "repeat_id") == want and len(want) > 40
    # the index is opened anew before every batch, and history is not read again
    canon = lambda p: with_canonical(rows(p), "text").filter("n_words > 0").drop("text")
    IncrementalIndex(spark, f"{tmp_path}/index", ["s"], 4).add_history(canon(h))
    found = []
    for p in parts[1:]:
        found += got(IncrementalIndex.open(spark, f"{tmp_path}/index").add_batch(canon(p)), "first_id", "repeat_id")
    assert sorted(found) == want


def test_a_repeat_leans_on_accepted_rows_only(spark):
    """c says the same as b and not as a, b the same as a: b is no accepted row, so c is none's repeat."""
    a = "alpha beta gamma delta epsilon zeta theta kappa lambda sigma"
    b = a.replace("alpha", "alpxha").replace("beta", "bexta").replace("gamma", "gamxma")
    c = b.replace("delta", "delxta").replace("epsilon", "epsixlon").replace("zeta", "zexta")
    assert same(canonical(a), canonical(b)) and same(canonical(b), canonical(c)) and not same(canonical(a), canonical(c))
    rows = lambda p: spark.createDataFrame([(i, "t", x) for i, x in p], "row_id long, s string, text string")
    r = batch_repeats(rows([(1, a)]), [rows([(2, b), (3, c), (4, c + "!")])], ["s"])
    assert got(r, "first_id", "repeat_id") == [(1, 2), (3, 4)]


def test_components(spark):
    rng = random.Random(4)
    e = [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(120)] + [(i, i + 1) for i in range(500, 560)]
    root = {x: x for p in e for x in p}
    for _ in range(200):
        for a, b in e:
            root[a] = root[b] = min(root[a], root[b])
    c = dict(got(components(spark.createDataFrame(e, "a long, b long")), "node", "root"))
    assert c == {x: r for x, r in root.items() if sum(root[y] == r for y in root) > 1 or x in c}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_truth_discovery(spark):
    rows = [(str(o), "f", s, "right" if s != "bad" else "wrong", 1.0) for o in range(20) for s in ("good", "fair", "bad")] + [("x", "f", "good", "A", 1.0), ("x", "f", "bad", "B", 1.0), ("y", "f", None, None, 1.0), ("y", "f", "good", " ", 1.0)]
    truths, trust = truth_discovery(spark.createDataFrame(rows, "object string, field string, source string, value string, weight double"))
    t = {r["object"]: r["value"] for r in truths.collect()}
    assert t["x"] == "A" and all(t[str(o)] == "right" for o in range(20)) and "y" not in t
    tr = {r["source"]: r["trust"] for r in trust.collect()}
    assert tr["good"] > tr["bad"]


def test_best_members(spark):
    rows = [(1, "b", None, 2.0, 5, 0.1), (1, "a", False, 0.4, 1, 0.1), (1, "c", True, None, 1, None), (2, "z", False, float("nan"), 9, 0.5), (2, "y", None, 0.0, None, float("nan")), (3, "q", None, None, None, None), (3, "p", None, None, None, None)]
    b = best_members(spark.createDataFrame(rows, "g int, id string, verified boolean, confidence float, tick long, salience float"), "g", "id")
    assert got(b, "g", "first_id", "best_id", "members") == [(1, "a", "c", 3), (2, "y", "y", 2), (3, "p", "p", 2)]


# -- p4, p6 --------------------------------------------------------------------------------
def clouds(rng, sizes, noise, dim=64, spread=0.04):
    out = []
    for n in sizes:
        c = rng.normal(size=dim)
        c /= np.linalg.norm(c)
        out += [c + rng.normal(size=dim) * spread for _ in range(n)]
    return out + [rng.normal(size=dim) for _ in range(noise)]


def test_clusters_against_brute_force(spark):
    rng = np.random.default_rng(7)
    v = [[float(x) for x in a * rng.uniform(0.3, 3)] for a in clouds(rng, [300, 40, 6, 5, 4, 2], 300)]
    odd = [None, [], [0.0] * 64, [1.0] * 63, [float("nan")] * 64, [float("inf")] + [1.0] * 63, [None] + [1.0] * 63]
    rows = [(i, x) for i, x in enumerate(v + odd)] + [(10_000, v[0]), (10_001, v[0])]
    vec = from_arrays(spark.createDataFrame(rows, "id long, v array<float>"), "id", "v")
    assert vec.count() == len(v) + 2
    m, sizes = closed_cliques(clusters(similarity_graph(vec, 0.8)), vec, 0.8)
    res = m.join(sizes, "cluster").groupBy("cluster").agg(F.array_sort(F.collect_list("id")).alias("ids"), F.first("size").alias("size"))
    mat = np.array([np.array(x, np.float32) for _, x in rows if x is not None and len(x) == 64 and all(y is not None and np.isfinite(y) for y in x) and any(x)], float)
    ids = [i for i, x in rows if x is not None and len(x) == 64 and all(y is not None and np.isfinite(y) for y in x) and any(x)]
    mat /= np.linalg.norm(mat, axis=1, keepdims=True)
    adj = mat @ mat.T >= 0.8
    want, seen = [], set()
    for i in range(len(ids)):
        members = set(np.flatnonzero(adj[i]).tolist())
        if i in seen:
            continue
        comp, todo = {i}, [i]
        while todo:
            for y in np.flatnonzero(adj[todo.pop()]).tolist():
                if y not in comp:
                    comp.add(y)
                    todo.append(y)
        seen |= comp
        if len(comp) >= 5 and all(adj[a, b] for a in comp for b in comp):
            want.append((sorted(ids[x] for x in comp), len(comp)))
        del members
    assert sorted((list(r["ids"]), r["size"]) for r in res.collect()) == sorted(want)


def test_a_bridge_joins_no_clusters(spark):
    """Two cliques of five and one link between them: one component, two clusters by flow."""
    two = [(a + o, b + o, 0.95) for o in (0, 10) for a in range(5) for b in range(a)] + [(14, 4, 0.8)]
    g = spark.createDataFrame(two, "src long, dst long, cosine double")
    c = dict(got(clusters(g), "id", "cluster"))
    assert len(set(components(g, "src", "dst").select("root").collect())) == 1
    assert len({c[i] for i in range(5)}) == len({c[i] for i in range(10, 15)}) == 1 and c[0] != c[10]


def test_unsettled_flow_and_trust_warn(spark):
    g = spark.createDataFrame([(b, a, 0.9) for b in range(6) for a in range(b)], "src long, dst long, cosine double")
    with pytest.warns(RuntimeWarning):
        assert markov_clusters(g, most=1).count() == 6
    c = spark.createDataFrame([("x", "f", "a", "1", 1.0), ("x", "f", "b", "2", 1.0), ("x", "f", "c", "2", 1.0), ("y", "f", "a", "1", 1.0), ("y", "f", "b", "2", 1.0)], "object string, field string, source string, value string, weight double")
    with pytest.warns(RuntimeWarning):
        truth_discovery(c, most=1)


def test_split_cluster_is_joined_again(spark):
    """A clique that the flow would split is one cluster after the search outside."""
    rng = np.random.default_rng(11)
    c = rng.normal(size=64)
    v = [[float(x) for x in c / np.linalg.norm(c) + rng.normal(size=64) * 0.04] for _ in range(60)]
    vec = from_arrays(spark.createDataFrame(list(enumerate(v)), "id long, v array<float>"), "id", "v")
    m = spark.createDataFrame([(i, i % 3, i % 3, 1.0) for i in range(60)], "id long, cluster long, attractor long, flow double")
    m, sizes = closed_cliques(m, vec, 0.8)
    assert [r["size"] for r in sizes.collect()] == [60] and m.select("cluster").distinct().count() == 1


def test_clusters_of_nothing(spark):
    vec = from_arrays(spark.createDataFrame([], "id long, v array<float>"), "id", "v")
    assert clusters(similarity_graph(vec, 0.8)).count() == 0


@pytest.mark.parametrize("floor,block", [(-1.0, 8192), (-1.0, 64), (0.85, 64)])
def test_top_similar_against_brute_force(spark, floor, block):
    rng = np.random.default_rng(3)
    v = clouds(rng, [20, 5, 3], 150, spread=0.05)
    rows = [(f"e{i:04d}", 64, struct.pack("<64f", *x)) for i, x in enumerate(v)] + [("bad1", 63, struct.pack("<64f", *v[0])), ("bad2", 64, b"12"), ("bad3", 64, struct.pack("<64f", *[0.0] * 64)), ("bad4", 64, struct.pack("<64f", float("inf"), *[1.0] * 63)), ("bad5", 64, None), (None, 64, struct.pack("<64f", *v[0]))]
    t = top_similar(from_blobs(spark.createDataFrame(rows, "id string, dim int, vec binary"), "id", "vec", "dim"), 5, floor, block_rows=block)
    m = np.array(v, np.float32).astype(float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    s = m @ m.T
    np.fill_diagonal(s, -2)
    want = {(f"e{i:04d}", f"e{j:04d}") for i in range(len(m)) for j in np.argsort(-s[i], kind="stable")[:5] if s[i, j] >= floor}
    assert {(r["id"], r["other"]) for r in t.collect()} == want
    assert similar_pairs(t).count() == len({tuple(sorted(p)) for p in want})


def even_groups(n, size, cosine, seed):
    """(id, vec) of n groups of ``size`` vectors of about this cosine to each other."""
    rng = np.random.default_rng(seed)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    centre = np.repeat(unit(rng.normal(size=(n, 64))), size, 0)
    v = unit(np.sqrt(cosine) * centre + np.sqrt(1 - cosine) * unit(rng.normal(size=centre.shape)))
    return [(i, x.astype("<f4").tobytes()) for i, x in enumerate(v)]


def test_graph_salted_keeps_groups_whole(spark):
    df = spark.createDataFrame(even_groups(120, 20, 0.87, 3), "id long, vec binary").cache()
    r = components(similarity_graph(df, 0.8, rows=2_000_000), "src", "dst").groupBy((F.col("node") / 20).cast("int").alias("g")).agg(F.countDistinct("root").alias("n"), F.count(F.lit(1)).alias("rows"))
    assert {(x["n"], x["rows"]) for x in r.collect()} == {(1, 20)}


def test_closed_cliques_see_what_tables_missed(spark):
    # 40 groups of six at .9 with a vector outside near one member only, and 40 groups of five at .85
    rows, rng = even_groups(40, 6, 0.9, 4), np.random.default_rng(8)
    v = np.stack([np.frombuffer(b, "<f4") for _, b in rows]).reshape(40, 6, 64).astype(float)
    for g in range(40):
        m, away = v[g, 0], v[g, 0] - v[g, 1:].mean(0)
        side = away - (away @ m) * m + 0.3 * rng.normal(size=64)
        side -= (side @ m) * m
        x = 0.81 * m + np.sqrt(1 - 0.81**2) * side / np.linalg.norm(side)
        rows.append((1000 + g, x.astype("<f4").tobytes()))
    rows += [(2000 + i, b) for i, b in even_groups(40, 5, 0.85, 9)]
    x = np.stack([np.frombuffer(b, "<f4") for _, b in rows]).astype(float)
    ids, near = np.array([i for i, _ in rows]), x @ x.T >= 0.8
    want = {(int(ids[n].min()), int(i)) for i, n in zip(ids, near) if n.sum() >= 5 and (near[n] == n).all()}
    df = spark.createDataFrame(rows, "id long, vec binary").cache()
    members, sizes = closed_cliques(clusters(similarity_graph(df, 0.8, rows=5_000_000)), df, 0.8)
    m = members.join(sizes, "cluster")
    r = m.join(m.groupBy("cluster").agg(F.min("id").alias("first")), "cluster")
    assert {(x["first"], x["id"]) for x in r.collect()} == want and want


# -- p7, p8, p9, p10 -----------------------------------------------------------------------
def test_find_pii_edges(spark):
    rows = [(1, "Assigned to Anna Berg for review. Call back on 030 23125 199."), (2, None), (3, ""), (4, "x" * 100_000), (1, "Assigned to Anna Berg for review. Call back on 030 23125 199.")]
    r = {x["id"]: x for x in find_pii(spark.createDataFrame(rows, "id long, text string"), "text", ["id"]).collect()}
    assert {s["pii_type"] for s in r[1]["spans"]} == {"person_name", "phone"} and r[1]["redacted"] == "Assigned to [PERSON_NAME] for review. Call back on [PHONE]."
    assert r[2]["redacted"] is None and r[3]["redacted"] == "" and r[4]["spans"] == []


def test_leaks_edges(spark, sf):
    items = spark.read.parquet(f"{sf}/eval_items.parquet")
    t = items.orderBy("item_id").first()["text"]
    half = t[: len(t) // 2]
    docs = spark.createDataFrame([(1, f"Intro. <p>{t.upper()}</p> End."), (2, f"Some words before. {half}"), (3, None), (4, ""), (5, "Nothing of the sort is in here at all, only plain words about a queue."), (6, t), (6, t)], "doc_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in leaks(docs, items).collect()} == {(1, 1), (2, 1), (6, 1)}
    assert leaks(docs, items.limit(0)).count() == 0 and leaks(docs.limit(0), items).count() == 0


def test_leaks_of_stock_words(spark):
    # no word is in few items, so only their order tells the items apart
    rng = np.random.default_rng(5)
    stock = [f"stock{i}" for i in range(30)]
    texts = [[stock[j] for j in rng.permutation(30)] for _ in range(40)]
    items = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(texts)], "item_id long, text string")
    docs = spark.createDataFrame([(k, " ".join([f"own{k}_{i}" for i in range(60)] + texts[k][8:22] + [f"end{k}_{i}" for i in range(60)])) for k in range(5)], "doc_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in leaks(docs, items).collect()} >= {(k, k) for k in range(5)}


def test_mix(spark):
    rows = [(i, f"text number {i} " + "words " * (i % 7 + 3), ("A " if i % 3 else "b") if i < 90 else "c") for i in range(100)] + [(200, "shared text in two places", "a"), (201, "shared text in two places", "b"), (300, None, "a"), (301, "", "a"), (302, "no source", None), (0, "text number 0 words words words ", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.4, 3), ("none", 0.1, 2)], "source string, target_share double, max_repeats int")
    sel, rep = mix(docs, targets)
    r = {x["source"]: x for x in rep.collect()}
    assert r["a"]["share"] == pytest.approx(5 / 9, abs=0.03) and r["b"]["share"] == pytest.approx(4 / 9, abs=0.03) and r["none"]["share"] == 0
    assert r["a"]["most_uses"] <= 1 and r["b"]["most_uses"] <= 3
    assert sel.groupBy("doc_id").count().filter("count > 1").count() == 0 and sel.filter("source not in ('a', 'b')").count() == 0
    assert got(mix(docs, targets)[0], "doc_id", "uses") == got(sel, "doc_id", "uses")
    sel, rep = mix(docs, targets.limit(0))
    assert sel.count() == 0 and rep.count() == 0


def test_spam_edges(spark):
    prose = [(i, f"The night planner saw that the queue {i} was full and it had no room for the rest of the batch. Nobody expected that it would happen again so soon.", "en") for i in range(40)]
    rows = prose + [(100, "[sync tool](https://x.test/1)\n" * 30, "en"), (101, "cheap tool, best tool, buy tool, top tool, " * 20, None), (102, None, None), (103, "", "EN"), (104, "n/a", "en"), (105, "If you want sync tool, get sync tool, because sync tool means sync tool. " * 8, "en")]
    r = {x["doc_id"]: x["reason"] for x in spam_pages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert {k for k, v in r.items() if v} == {100, 101, 105} and len(r) == len(rows)
    assert spam_pages(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0


def test_registered(spark, sf):
    q = Q.queries()
    assert {f"p{n}_found" for n in (1, 2, 3, 4, 5, 6, 7, 8, 10)} <= set(q) and {"p9_mix", "p9_shares"} <= set(q)
    assert set(Q.oracle_sql()) <= set(q)


@pytest.mark.parametrize("name", ["p1_found", "p4_found"])
def test_sql(spark, sf, name):
    from oracle import compare, duck

    assert compare(Q.queries()[name](spark, sf), duck(sf), Q.oracle_sql()[name]) == []
