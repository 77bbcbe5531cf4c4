"""Edges between features: wiring, merging, reinforcement, pruning; centroids, facts, merging of near-equal rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.functions import stages as S
from memloom.functions.features import band_features, band_sums, bound, granules, neighbours, plasticity
from memloom.functions.text import cosine, rich_tokens, words
from memloom.operators.coactive import co_active
from memloom.operators.gate import near_sets
from memloom.sources.tables import materialize, spread


def features(rows: DataFrame, life: str = "life_id") -> DataFrame:
    """(engram_id, dg, ca3): granules of a row, sorted, and the same with their pair bindings."""
    life_of = F.coalesce(F.col(life), F.lit("")) if life in rows.columns else F.lit(life)
    g = spread(rows).select("engram_id", granules(rich_tokens(F.col("content"), F.col("context"), F.col("outcome")), life_of).alias("dg"))
    return g.select("engram_id", "dg", bound(F.col("dg")).alias("ca3"))


def node_owners(rows: DataFrame, life: str = "life_id", **more: Column) -> DataFrame:
    """(engram_id, tick, node) and columns ``more`` of every granule of every row, in one pass: the exploded side meets no join."""
    life_of = F.coalesce(F.col(life), F.lit("")) if life in rows.columns else F.lit(life)
    dg = granules(rich_tokens(F.col("content"), F.col("context"), F.col("outcome")), life_of)
    # no row is without granules; the outer form spares the filter that would make them twice
    return spread(rows).select("engram_id", F.coalesce("encoded_at_tick", F.lit(0)).alias("tick"), *(c.alias(n) for n, c in more.items()), F.explode_outer(dg).alias("node"))


def wiring(rows: DataFrame, stage: int = 2, life: str = "life_id") -> DataFrame:
    """(engram_id, src, dst, weight): a clique over the first bound features, a chain over the granules and one over the bound features, within the stage's budget."""
    clique, dg_links, ca3_links = S.STAGES[stage][9:12]
    f = features(rows, life)
    pair = lambda x, y, w: F.struct(x.alias("src"), y.alias("dst"), F.lit(w).alias("weight"))
    head = f.select("engram_id", F.slice("ca3", 1, clique + 1).alias("head"), F.slice("dg", 1, dg_links + 1).alias("dg"), F.slice("ca3", 1, ca3_links + 1).alias("ca3"))
    cl = F.flatten(F.transform("head", lambda x, i: F.transform(F.slice(F.col("head"), i + 2, clique + 1), lambda y: pair(x, y, S.CLIQUE_WEIGHT))))

    def chain(c: str, w: float):
        a, b = neighbours(F.col(c))
        return F.zip_with(a, b, lambda x, y: pair(x, y, w))

    # the inner form would filter by the size of the list first and so make all features twice
    e = head.select("engram_id", F.explode_outer(F.concat(cl, chain("dg", S.CHAIN_WEIGHT), chain("ca3", S.BOUND_WEIGHT))).alias("e"))
    return e.filter("e is not null").select("engram_id", "e.src", "e.dst", "e.weight")


def band_wiring(vectors: DataFrame, rows: DataFrame, stage: int = 2, life: str = "life_id") -> DataFrame:
    """(engram_id, src, dst, weight): a chain over the band features of a row's vector and edges from its granules to them."""
    bands, cross = S.STAGES[stage][12:14]
    v = vectors.select("engram_id", band_features(band_sums(F.col("vector"), F.col("engram_id"))).alias("ec")).join(features(rows, life).select("engram_id", "dg"), "engram_id")
    pair = lambda x, y, w: F.struct(x.alias("src"), y.alias("dst"), F.lit(w).alias("weight"))
    a, b = neighbours(F.slice("ec", 1, bands + 1))
    links = F.zip_with(a, b, lambda x, y: pair(x, y, S.BAND_WEIGHT))
    both = F.slice(F.flatten(F.transform(F.slice("dg", 1, cross), lambda x: F.transform(F.col("ec"), lambda y: pair(x, y, S.CROSS_WEIGHT)))), 1, cross)
    return v.select("engram_id", F.explode(F.concat(links, both)).alias("e")).select("engram_id", "e.src", "e.dst", "e.weight")


def merge_max(edges: DataFrame) -> DataFrame:
    """One edge per (src, dst), of the largest weight."""
    return edges.groupBy("src", "dst").agg(F.max("weight").alias("weight"))


def keep_first(edges: DataFrame, order: list[str]) -> DataFrame:
    """One edge per (src, dst), the first in ``order``."""
    return edges.groupBy("src", "dst").agg(F.min_by("weight", F.struct(*order)).alias("weight"))


def together(edges: DataFrame, rows: DataFrame, life: str = "life_id") -> DataFrame:
    """``edges`` with n and gain: in how many rows both ends of an edge are active, and the sum of those rows' gates."""
    gate = plasticity(*[F.lit(S.MODULATORS[m]) for m in ("dopamine", "acetylcholine", "norepinephrine")], F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.nanvl(F.col("salience"), F.lit(0.0)).cast("double"), F.lit(0.0)))))
    return co_active(edges, rows, F.round(gate, 6), life)


def hebbian(co_active: DataFrame) -> DataFrame:
    """Edge weights after the co-activations of ``together``: least(1, w + delta · sum of gates); increments are never negative, so the sum may be cut once."""
    return co_active.select("src", "dst", F.least(F.lit(1.0), F.col("weight") + F.col("gain") * S.HEBB_DELTA).alias("weight"), F.col("n").alias("co_activations"))


def prune(edges: DataFrame, threshold: float) -> DataFrame:
    return edges.filter(F.col("weight") >= threshold)


def token_facts(rows: DataFrame) -> DataFrame:
    """(token, weight): a tenth of the salience for each occurrence of a word in content, context or outcome."""
    text = F.concat_ws(" ", "content", "context", "outcome")
    sal = F.round(F.coalesce(F.col("salience").cast("double"), F.lit(0.0)), 6)
    return rows.select(sal.alias("s"), F.explode(words(text)).alias("token")).groupBy("token").agg((F.sum("s") * S.FACT_RATE).alias("weight"), F.count(F.lit(1)).alias("times"))


def nearest_centroid(vectors: DataFrame, centroids: DataFrame, floor: float = S.CENTROID_FLOOR, dim: int = 64, block: int = 4096) -> DataFrame:
    """``vectors``' id, life_id and sim of the nearest centroid if over ``floor``; of equal ones the larger life_id.

    Centroids go in blocks of at most about ``block``; each block is held
    against all vectors by a matrix product.  Unusable vectors have none.
    """
    from memloom.operators.blocks import vector_scorer

    id_col = vectors.columns[0]
    kind = vectors.schema[id_col].dataType.simpleString()
    n = centroids.count()
    blocks, out = max(1, -(-n // block)), None
    for b in range(blocks):
        part = [{"cue_id": r[0], "vector": r[1]} for r in (centroids if blocks == 1 else centroids.filter(F.pmod(F.xxhash64("life_id"), F.lit(blocks)) == b)).select("life_id", "vector").collect()]
        part = [c for c in part if c["vector"] is not None and all(x is not None for x in c["vector"])]
        names = sorted(part, key=lambda c: c["cue_id"])

        def run(batches, names=names):
            import numpy as np
            import pandas as pd

            score = vector_scorer(names, dim, floor, vec="vector", id_col=id_col)
            for pdf in batches:
                for cue, s, ids in score(pdf):
                    o = np.lexsort((cue, np.round(s, 9), ids))
                    last = np.append(ids[o][1:] != ids[o][:-1], True) if len(o) else np.zeros(0, bool)
                    at = o[last]
                    if len(at):
                        yield pd.DataFrame({id_col: ids[at], "life_id": pd.Series([names[c]["cue_id"] for c in cue[at]], dtype=object), "sim": np.round(s[at], 9)})

        got = spread(vectors.select(id_col, "vector")).mapInPandas(run, f"{id_col} {kind}, life_id string, sim double").filter(F.col("sim") > floor)
        out = got if out is None else out.unionByName(got)
    return out.groupBy(id_col).agg(F.max(F.struct("sim", "life_id")).alias("b")).select(id_col, F.col("b.life_id").alias("life_id"), F.col("b.sim").alias("sim"))


def vector_boosts(cues: DataFrame, centroids: DataFrame, dim: int = 64) -> DataFrame:
    """(cue_id, centroid, semantic): the largest cosine of a cue's vector with a centroid times the root of its strength, within 0 and 1, and the same with the root cut at three, times 0.15.

    A batch of cues meets all centroids; unusable vectors on either side are left out.
    """
    from memloom.operators.recall import small

    usable = lambda c: F.coalesce((F.size(c) == dim) & ~F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) > 3.5e38)) & F.exists(c, lambda x: x != 0), F.lit(False))
    c = centroids.filter(usable(F.col("vector"))).select(F.col("vector").alias("_c"), F.sqrt(F.greatest(F.lit(0.0), F.coalesce(F.col("strength").cast("double"), F.lit(0.0)))).alias("_r"))
    # a stated batch of cues against all centroids, the smaller side broadcast while its size allows
    j = small(cues.filter(usable(F.col("vector")))).join(c, F.lit(True)).select("cue_id", cosine(F.col("vector"), F.col("_c")).alias("_s"), "_r")
    return j.groupBy("cue_id").agg(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.max(F.col("_s") * F.col("_r")))).alias("centroid"), F.max(F.col("_s") * F.least(F.lit(3.0), F.col("_r")) * 0.15).alias("semantic"))


def exact_duplicates(rows: DataFrame) -> DataFrame:
    """Rows of equal tenant, content and context merged into the first id: greatest salience, summed replays."""
    r = rows.filter("not coalesce(is_core, false)")
    g = r.groupBy("tenant_id", "content", "context").agg(F.min("engram_id").alias("keeper"), F.count(F.lit(1)).alias("merged"), F.max("salience").alias("salience"), F.sum(F.coalesce("replay_count", F.lit(0))).alias("replays"))
    return g.filter("merged > 1").select("keeper", "merged", "salience", "replays")


def merge_pairs(rows: DataFrame, vectors: DataFrame | None = None, scope: str = "tenant_id", dim: int = 64) -> DataFrame:
    """(scope, a, b, jaccard, cosine): classes of rows to merge, core rows left out: feature Jaccard over 0.85, or cosine over 0.94 with Jaccard over 0.35.

    A class is a row's text fields; equal rows are one class, named by its
    smallest id, so copies give no pairs.  There is no window.
    """
    r = rows.filter("not coalesce(is_core, false)").withColumn("scope", F.coalesce(scope, F.lit("")))
    c = r.groupBy("scope", rich_tokens(F.col("content"), F.col("context"), F.col("outcome")).alias("ts")).agg(F.min("engram_id").alias("cls"))
    c = materialize(c, "classes")
    near = near_sets(c, S.MERGE_JACCARD, elements="ts").filter((F.col("a") < F.col("b")) & (F.col("jaccard") > S.MERGE_JACCARD)).withColumn("cosine", F.lit(None).cast("double"))
    if vectors is None:
        return near.select("scope", "a", "b", "jaccard", "cosine")
    # vectors over the limit by the block join of unit vectors within the scope's classes
    v = materialize(vectors.join(c.select("scope", F.col("cls").alias("engram_id"), "ts"), "engram_id"), "vectors")
    close = close_vectors(v.select("scope", "engram_id", "vector"), S.MERGE_COSINE, dim)
    ts = v.select("scope", F.col("engram_id"), "ts")
    i = F.size(F.array_intersect("ta", "tb"))
    both = close.join(ts.select("scope", F.col("engram_id").alias("a"), F.col("ts").alias("ta")), ["scope", "a"]).join(ts.select("scope", F.col("engram_id").alias("b"), F.col("ts").alias("tb")), ["scope", "b"])
    both = both.withColumn("jaccard", F.round(i / (F.size("ta") + F.size("tb") - i), 9)).filter(F.col("jaccard") > S.MERGE_BOTH)
    both = both.join(near.select("scope", "a", "b"), ["scope", "a", "b"], "left_anti")
    return near.select("scope", "a", "b", "jaccard", "cosine").unionByName(both.select("scope", "a", "b", "jaccard", "cosine"))


def close_vectors(v: DataFrame, floor: float, dim: int = 64, block: int = 4096) -> DataFrame:
    """(scope, a, b, cosine): pairs of one scope with cosine over ``floor``, a before b; blocks of a scope meet pairwise, so no scope is held whole."""
    import numpy as np
    import pandas as pd

    sizes = v.groupBy("scope").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    b = v.join(sizes, "scope").withColumn("_b", F.pmod(F.xxhash64("engram_id"), "blocks").cast("int"))
    left = b.select("scope", "engram_id", "vector", F.col("_b").alias("x"), F.explode(F.sequence(F.col("_b"), F.col("blocks") - 1)).alias("y"))
    right = b.select("scope", "engram_id", "vector", F.col("_b").alias("y"), F.explode(F.sequence(F.lit(0), F.col("_b"))).alias("x")).toDF("r_scope", "r_id", "r_vector", "r_y", "r_x")

    def unit(vs: pd.Series) -> np.ndarray:
        m = np.stack(vs.to_list()).astype(np.float64)
        return m / np.maximum(1e-12, np.linalg.norm(m, axis=1, keepdims=True))

    def meet(key, p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(p) or not len(q):
            return pd.DataFrame({"scope": [], "a": [], "b": [], "cosine": []})
        s = unit(p["vector"]) @ unit(q["r_vector"]).T
        i, j = np.nonzero(np.round(s, 9) > floor)
        a, c = p["engram_id"].to_numpy()[i], q["r_id"].to_numpy()[j]
        ok = a < c if key[1] == key[2] else a != c
        lo, hi = np.where(a < c, a, c), np.where(a < c, c, a)
        return pd.DataFrame({"scope": key[0], "a": lo[ok], "b": hi[ok], "cosine": np.round(s[i, j][ok], 9)})

    return left.groupBy("scope", "x", "y").cogroup(right.groupBy("r_scope", "r_x", "r_y")).applyInPandas(meet, "scope string, a string, b string, cosine double")


def keepers(pairs: DataFrame, rounds: int = 100) -> DataFrame:
    """(scope, cls, keeper): greedy merging in order of ids: a class is absorbed by the first class before it that is itself kept.

    Each round decides the classes all of whose earlier partners are decided;
    one without a kept partner stays.
    """
    p = materialize(pairs.select("scope", "a", "b"), "pairs")
    nodes = p.select("scope", F.col("a").alias("cls")).union(p.select("scope", F.col("b").alias("cls"))).distinct()
    done = materialize(nodes.join(p.select("scope", F.col("b").alias("cls")).distinct(), ["scope", "cls"], "left_anti").withColumn("keeper", F.col("cls")), "keepers")
    for _ in range(rounds):
        left = nodes.join(done, ["scope", "cls"], "left_anti")
        if left.isEmpty():
            return done
        d = done.select("scope", F.col("cls").alias("a"), (F.col("keeper") == F.col("cls")).alias("kept"))
        of = left.join(p.withColumnRenamed("b", "cls"), ["scope", "cls"]).join(d, ["scope", "a"], "left")
        first = of.groupBy("scope", "cls").agg(F.min(F.when(F.col("kept"), F.col("a"))).alias("by"), F.min(F.when(F.col("kept").isNull(), F.col("a"))).alias("open"))
        ready = first.filter("open is null or by < open").select("scope", "cls", F.coalesce("by", "cls").alias("keeper"))
        done = materialize(done.unionByName(ready), "keepers")
    raise RuntimeError(f"merging not settled after {rounds} rounds")


def associations(rows: DataFrame, life: str = "life_id") -> DataFrame:
    """(a, b, shared, weight): every row linked to the last owner of each of its features, and how many features lead there.

    The last owner of a feature is its row of the latest tick, then the largest id.
    """
    f = features(rows, life).select("engram_id", F.explode("dg").alias("node")).join(rows.select("engram_id", F.coalesce("encoded_at_tick", F.lit(0)).alias("tick")), "engram_id")
    last = f.groupBy("node").agg(F.max(F.struct("tick", "engram_id"))["engram_id"].alias("owner"))
    n = f.join(last, "node").filter("engram_id <> owner").groupBy("engram_id", "owner").agg(F.count(F.lit(1)).alias("shared"))
    # where two rows own features of each other, the link of the smaller id counts
    n = n.groupBy(F.least("engram_id", "owner").alias("a"), F.greatest("engram_id", "owner").alias("b")).agg(F.min_by("shared", "engram_id").alias("shared"))
    return n.withColumn("weight", F.least(F.lit(0.9), 0.15 * F.col("shared")))
