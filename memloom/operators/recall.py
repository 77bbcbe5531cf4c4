"""Inverted index, seeds, hybrid candidates and scored recall for batches of cues.

Seeds come from block scoring (``blocks``): every row is scored where it lies
against all cues, and only the k best of each cue leave a partition.  All later
steps work on the candidates, at most LEXICAL_SEEDS + VECTOR_SEEDS a cue.
Every ranking has a total order with the row id last.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from memloom.functions import stages as S
from memloom.functions.features import bound, granules
from memloom.functions.text import RECALL_WORDS, cosine, cue_tokens, is_factual, rich_tokens, words
from memloom.operators import flow
from memloom.operators.blocks import best_rows, cue_blocks, vector_scorer
from memloom.operators.counts import best_by_words, shared_counts, token_lists, token_sets, token_words
from memloom.sources.tables import materialize, spread as over_cores, write_shared

MAX_BROADCAST_CUES = 4096


def small(cues: DataFrame) -> DataFrame:
    """The batch of cues, marked for broadcast if it holds at most MAX_BROADCAST_CUES rows."""
    return F.broadcast(cues) if cues.limit(MAX_BROADCAST_CUES + 1).count() <= MAX_BROADCAST_CUES else cues


def postings(rows: DataFrame) -> DataFrame:
    """(engram_id, token): distinct rich tokens of every row."""
    return rows.select("engram_id", F.explode(rich_tokens(F.col("content"), F.col("context"), F.col("outcome"))).alias("token"))


def long_words(c: Column) -> Column:
    return F.filter(words(c), lambda x: F.octet_length(x) > 2)


def _lists(block: list, of) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Word to (cue numbers, weights) for a block of cues; ``of`` gives a cue's words and weights."""
    at: dict[str, tuple[list, list]] = {}
    for i, c in enumerate(block):
        for w, x in of(c).items():
            p = at.setdefault(w, ([], []))
            p[0].append(i)
            p[1].append(x)
    return {w: (np.array(i, np.int64), np.array(x, np.float64)) for w, (i, x) in at.items()}


def lexical_seeds(rows: DataFrame, cues: DataFrame, k: int = S.LEXICAL_SEEDS, agents: bool = False) -> DataFrame:
    """(cue_id, engram_id, hits, rank): the rows with most words of the cue (over two bytes); a word repeated in the cue counts each time.

    ``agents`` restricts every cue to the rows of its agent_id.
    """
    got = best_by_words(over_cores(rows), cues, F.array_distinct(long_words(F.col("content"))), long_words(F.col("cue")), k, agents)
    return got.select("cue_id", "engram_id", F.col("score").cast("long").alias("hits"), "rank")


def top(df: DataFrame, by: str, order: list[Column], k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(*order))).filter(F.col("rank") <= k)


def bm25(rows: DataFrame, cues: DataFrame, k: int = 10, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(cue_id, engram_id, score, rank): BM25 over the distinct words of a cue."""
    got = best_by_words(over_cores(rows), cues, words(F.col("content")), F.array_distinct(words(F.col("cue"))), k, bm25=(k1, b))
    return got.select("cue_id", "engram_id", "score", "rank")


def vector_hits(rows: DataFrame, queries: DataFrame, floor: float = 0.05) -> DataFrame:
    """(query_id, vec_id, sim): cosine over ``floor`` of every query against every row, the query itself left out.

    The queries are a stated, small set; each row is compared where it lies.
    """
    q = small(queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")))
    sim = cosine(F.col("q"), F.col("embedding"))
    return rows.join(q, F.col("vec_id") != F.col("query_id")).select("query_id", "vec_id", "label", sim.alias("sim")).filter(F.col("sim") > floor)


def vector_topk(rows: DataFrame, queries: DataFrame, k: int, floor: float = S.SIM_FLOOR, dim: int = 64) -> DataFrame:
    """(query_id, vec_id, label, sim, rank): the k most similar other rows of every query, of cosine over ``floor``."""
    r = over_cores(rows).select("vec_id", F.col("embedding").alias("vec"))
    out = None
    for block in cue_blocks(queries.select(F.col("vec_id").alias("cue_id"), F.col("embedding").alias("vector"))):
        got = best_rows(r, block, k, vector_scorer(block, dim, floor, id_col="vec_id", skip_same=True), "vec_id")
        out = got if out is None else out.unionByName(got)
    return out.join(rows.select("vec_id", "label"), "vec_id").select(F.col("cue_id").alias("query_id"), "vec_id", "label", F.col("score").alias("sim"), "rank")


def vector_seeds(rows: DataFrame, cues: DataFrame, k: int = S.VECTOR_SEEDS, dim: int = 64) -> DataFrame:
    """(cue_id, engram_id, sim, rank): the k rows whose ``vector`` is most similar to the cue's, of cosine over the floor."""
    r = over_cores(rows).select("engram_id", F.col("vector").alias("vec"))
    out = None
    for block in cue_blocks(cues.select("cue_id", "vector")):
        got = best_rows(r, block, k, vector_scorer(block, dim, S.SIM_FLOOR))
        out = got if out is None else out.unionByName(got)
    return out.select("cue_id", "engram_id", F.col("score").alias("sim"), "rank")


def hybrid_candidates(rows: DataFrame, cues: DataFrame, agents: bool = False, dim: int = 64) -> DataFrame:
    """(cue_id, engram_id): lexical and vector seeds together, each pair once."""
    c = lexical_seeds(rows, cues, agents=agents).select("cue_id", "engram_id")
    if "vector" in rows.columns and "vector" in cues.columns:
        v = vector_seeds(rows, cues, dim=dim).select("cue_id", "engram_id")
        if agents:
            mine = cues.select("cue_id", F.col("agent_id").alias("_a"))
            v = v.join(rows.select("engram_id", "agent_id"), "engram_id").join(mine, "cue_id").filter("agent_id = _a").select("cue_id", "engram_id")
        c = c.unionByName(v)
    return c.distinct()


def pair_overlap(rows: DataFrame, cues: DataFrame, pairs: DataFrame) -> DataFrame:
    """(cue_id, engram_id, matched, cue_size): tokens a row shares with a cue, for ``pairs`` only.

    Every token stands for two granules and pair bindings never equal a cue's
    features, so the share of tokens is the share of features.
    """
    of_row, of_cue = token_words(F.col("content"), F.col("context"), F.col("outcome")), token_words(F.col("cue"), F.lit(""), F.lit(None).cast("string"))
    return shared_counts(rows.select("engram_id", "content", "context", "outcome"), of_row, token_sets(cues, of_cue), F.col("fs"), pairs, token_lists)


def cue_features(cues: DataFrame, life: Column) -> DataFrame:
    """(cue_id, node): features of every cue."""
    return cues.select("cue_id", F.explode(granules(cue_tokens(F.col("cue")), life)).alias("node"))


def bound_features(rows: DataFrame, pairs: DataFrame, life: Column) -> DataFrame:
    """(engram_id, fs): bound features of the rows of ``pairs``."""
    r = over_cores(rows).join(pairs.select("engram_id").distinct(), "engram_id", "left_semi").select("engram_id", granules(rich_tokens(F.col("content"), F.col("context"), F.col("outcome")), life).alias("dg"))
    return r.select("engram_id", bound(F.col("dg")).alias("fs"))


def activated_sums(rows: DataFrame, pairs: DataFrame, act: DataFrame, life: Column) -> DataFrame:
    """(cue_id, engram_id, energy): activation summed over the bound features of a row, for ``pairs`` only."""
    r = materialize(bound_features(rows, pairs, life), "bound")
    hit = pairs.select("cue_id", "engram_id").join(r, "engram_id").repartition("cue_id", "engram_id").select("cue_id", "engram_id", F.explode("fs").alias("node"))
    # the smaller side is hashed: neither is worth a sort
    return hit.join(act.hint("shuffle_hash"), ["cue_id", "node"]).groupBy("cue_id", "engram_id").agg(F.sum("activation").alias("energy"))


def recall(rows: DataFrame, cues: DataFrame, k: int = S.TOP_K, scope: str | None = None, edges: DataFrame | None = None, stage: int = 2, boosts: DataFrame | None = None, dim: int = 64) -> DataFrame:
    """(cue_id, engram_id, verified, activation, rank): the k best rows of every cue.

    Candidates are the lexical and, where rows and cues have a ``vector``, the
    vector seeds.  The score weighs the share of the cue's features found, the
    activation of the row's features after HOPS rounds along ``edges`` (that of
    the cue alone without edges) and the cosine; verified rows gain a boost,
    and so does every row of a cue in ``boosts`` (cue_id, boost).  ``scope``
    'pre' restricts rows to the cue's agent_id before the seeds, 'post' filters
    after the cut, so fewer than k may remain.
    """
    cand = materialize(hybrid_candidates(rows, cues, scope == "pre", dim), "candidates")
    life = F.lit("life")
    seeds = cue_features(cues, life).withColumn("activation", F.lit(1.0))
    factor = S.SPREAD * max(S.STAGES[stage][2], 0.1)
    o = pair_overlap(rows, cues, cand)
    if edges is None:
        # every matched token has two features of activation one
        s = o.withColumn("energy", 2.0 * F.col("matched"))
    else:
        if edges.count() <= flow.MAX_GRAPH_EDGES:
            path = write_shared(edges.select("src", "dst", F.col("weight").cast("double").alias("weight")), "graph")
            sums = flow.energies(seeds, path, factor, S.HOPS, cand, bound_features(rows, cand, life))
        else:
            sums = activated_sums(rows, cand, materialize(spread(seeds, edges, factor), "activation"), life)
        s = o.join(sums, ["cue_id", "engram_id"], "left")
    meta = rows.select("engram_id", "agent_id", F.coalesce(F.col("provenance.verified"), F.lit(False)).alias("verified"), *(["vector"] if "vector" in rows.columns else []))
    s = s.join(meta, "engram_id")
    sim = F.lit(0.0)
    if "vector" in rows.columns and "vector" in cues.columns:
        s = s.join(small(cues.select("cue_id", F.col("vector").alias("_q"))), "cue_id")
        # usable vectors have ``dim`` finite numbers; both sides, as in the seeds
        ok = lambda c: F.coalesce((F.size(c) == dim) & ~F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) > 3.5e38)), F.lit(False))
        sim = F.when(ok(F.col("vector")) & ok(F.col("_q")), cosine(F.col("vector"), F.col("_q"))).otherwise(0.0)
        sim = F.when(sim > S.SIM_FLOOR, sim).otherwise(0.0)
    s = s.withColumn("activation", S.W_OVERLAP * F.col("matched") / F.greatest("cue_size", F.lit(1)) + S.W_ACTIVATION * F.coalesce("energy", F.lit(0.0)) + S.W_COSINE * sim)
    cut = top(s.filter(F.col("activation") > S.SCORE_FLOOR), "cue_id", [F.desc(F.round("activation", 9)), F.col("engram_id")], k).drop("rank")
    if boosts is not None:
        cut = cut.join(boosts, "cue_id", "left").withColumn("activation", F.col("activation") + S.BOOST_RATE * F.coalesce("boost", F.lit(0.0)))
    cut = cut.withColumn("activation", F.col("activation") + F.when(F.col("verified"), S.VERIFIED_BOOST).otherwise(0.0))
    if scope == "post":
        cut = cut.join(small(cues.select("cue_id", F.col("agent_id").alias("cue_agent"))), "cue_id").filter("agent_id = cue_agent")
    return top(cut, "cue_id", [F.desc(F.round("activation", 9)), F.col("engram_id")], k).select("cue_id", "engram_id", "verified", "activation", "rank")


def ledger_rows(rows: DataFrame) -> DataFrame:
    """(tenant_id, engram_id): the row that speaks for a tenant's ledger.

    The row referred to as (ledger, wallet-balance), else the verified ledger
    row about a wallet, balance or ledger of the greatest salience; of equal
    ones the largest id.
    """
    low = F.lower(F.coalesce("content", F.lit("")))
    about = F.lit(False)
    for w in S.LEDGER_ROWS:
        about = about | low.contains(w)
    named = F.coalesce((F.col("rag.doc_id") == "ledger") & (F.col("rag.chunk_id") == "wallet-balance"), F.lit(False))
    ledger = F.coalesce(F.col("context").startswith("ledger:"), F.lit(False)) | (F.lower(F.trim(F.coalesce("provenance.kind", F.lit("")))) == "ledger_verified")
    ok = named | (F.coalesce(F.col("provenance.verified"), F.lit(False)) & ledger & about)
    sal = F.round(F.coalesce(F.nanvl(F.col("salience"), F.lit(0.0)).cast("double"), F.lit(0.0)), 6)
    return rows.filter(ok).groupBy("tenant_id").agg(F.max(F.struct(named.alias("n"), F.when(named, 0.0).otherwise(sal).alias("s"), "engram_id"))["engram_id"].alias("engram_id"))


def prefer_ledger(recalled: DataFrame, cues: DataFrame, rows: DataFrame, k: int = S.TOP_K) -> DataFrame:
    """``recalled`` with the ledger row of the cue's tenant first, where the cue asks for money: five more on at least five, or ten if it was not recalled."""
    low = F.lower("cue")
    asks = F.lit(False)
    for w in S.LEDGER_CUES:
        asks = asks | low.contains(w)
    truth = cues.filter(asks).select("cue_id", "tenant_id").join(ledger_rows(rows), "tenant_id").select("cue_id", "engram_id", F.lit(True).alias("_l"))
    j = recalled.select("cue_id", "engram_id", "verified", "activation").join(truth, ["cue_id", "engram_id"], "full")
    boosted = F.when(F.col("_l").isNull(), F.col("activation")).when(F.col("activation").isNull(), 10.0).otherwise(F.greatest("activation", F.lit(5.0)) + 5.0)
    j = j.select("cue_id", "engram_id", (F.coalesce("verified", F.lit(False)) | F.coalesce("_l", F.lit(False))).alias("verified"), boosted.alias("activation"))
    return top(j, "cue_id", [F.desc(F.round("activation", 9)), F.col("engram_id")], k)


def trust_of_recalled(content: Column, verified: Column) -> Column:
    """The note on a recalled row that states facts without being verified."""
    return F.when(~verified & is_factual(content, RECALL_WORDS), F.lit("recalled utterance — not verified ground truth; check ledger/tools"))


def spread(seeds: DataFrame, edges: DataFrame, factor: float, hops: int = S.HOPS) -> DataFrame:
    """(cue_id, node, activation) after ``hops`` synchronous rounds along directed weighted edges.

    Single contributions under MIN_DELTA do not count; after each round what
    is at or under ACTIVATION_FLOOR fades.
    """
    if edges.count() <= flow.MAX_GRAPH_EDGES:
        return flow.propagate(seeds, write_shared(edges.select("src", "dst", F.col("weight").cast("double").alias("weight")), "graph"), factor, hops)
    act = seeds.select("cue_id", "node", "activation")
    # every source keeps its value by a loop of its own, so a round reads the one before once
    loops = edges.select("src").distinct().select("src", F.col("src").alias("dst"), F.lit(None).cast("double").alias("weight"))
    e = edges.select("src", "dst", "weight").unionByName(loops)
    for _ in range(hops):
        j = act.join(e, act["node"] == e["src"], "left")
        j = j.select("cue_id", F.coalesce("dst", "node").alias("node"), F.col("weight").isNull().alias("stays"), F.when(F.col("weight").isNull(), F.col("activation")).otherwise(F.col("activation") * F.col("weight") * factor).alias("activation"))
        act = j.filter(F.col("stays") | (F.col("activation") > S.MIN_DELTA)).groupBy("cue_id", "node").agg(F.sum("activation").alias("activation")).filter(F.col("activation") > S.ACTIVATION_FLOOR)
    return act


def complete(rows: DataFrame, cues: DataFrame, floor: float = 0.2) -> DataFrame:
    """(cue_id, engram_id, overlap): the one row of largest overlap, if over ``floor``; ties go to the later tick, then the larger id.

    Rows are scored in blocks; only each partition's best row of a cue leaves it.
    """
    r = over_cores(rows).select("engram_id", F.coalesce("encoded_at_tick", F.lit(0)).alias("tick"), rich_tokens(F.col("content"), F.col("context"), F.col("outcome")).alias("ws"))
    out = None
    for block in cue_blocks(cues.select("cue_id", cue_tokens(F.col("cue")).alias("ws"))):
        lists, sizes, names = _lists(block, lambda c: dict.fromkeys(c["ws"], 1.0)), np.array([max(1, len(c["ws"])) for c in block], float), [c["cue_id"] for c in block]
        n = len(block)

        def run(batches, lists=lists, sizes=sizes, names=names, n=n):
            import pandas as pd

            best, tick, rid = np.full(n, floor), np.zeros(n, np.int64), np.empty(n, object)
            for pdf in batches:
                for i, t, ws in zip(pdf["engram_id"].tolist(), pdf["tick"].tolist(), pdf["ws"].tolist()):
                    hit = [lists[w][0] for w in ws if w in lists]
                    if not hit:
                        continue
                    share = np.round(np.bincount(np.concatenate(hit), minlength=n) / sizes, 9)
                    for c in np.flatnonzero((share > best) | ((share == best) & (share > floor))).tolist():
                        if share[c] > best[c] or (t, i) > (tick[c], rid[c]):
                            best[c], tick[c], rid[c] = share[c], t, i
            at = [c for c in range(n) if rid[c] is not None]
            if at:
                yield pd.DataFrame({"cue_id": [names[c] for c in at], "engram_id": rid[at], "tick": tick[at], "o": best[at]})

        got = r.mapInPandas(run, "cue_id string, engram_id string, tick long, o double")
        out = got if out is None else out.unionByName(got)
    return out.groupBy("cue_id").agg(F.max(F.struct("o", "tick", "engram_id")).alias("b")).select("cue_id", F.col("b.engram_id").alias("engram_id"), F.col("b.o").alias("overlap"))
