"""Clusters of similar vectors by Markov clustering of a sparse similarity graph.

Graph.  Every vector falls into one cross-polytope bucket per hash table: the
index and sign of the largest coordinate after ROUNDS random rotations.  In a
bucket vectors pass in the order of one global random rank and link to the
leaders met so far that are similar enough; a vector similar to none becomes a
leader.  Edges therefore run from a vector to similar ones of lower rank, at
most one leader chain per table, however dense a cluster is.

Clustering.  The column-stochastic matrix of these edges (with loops) is
squared, inflated and pruned by joins until it stands still.  Its attractor
rows are the clusters, and the members of the strongest flow their typical
ones.  Attractors to which one column flows are one cluster; a link of the
graph alone joins nothing, so a bridge between dense parts is cut.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.llm.dedupe import components
from memloom.llm.vectors import int8_codes, matrix
from memloom.sources.tables import materialize

SEED = 20240117


def _rotations(n: int, dim: int) -> np.ndarray:
    rng = np.random.default_rng(SEED)
    return np.stack([np.linalg.qr(rng.normal(size=(dim, dim)))[0] for _ in range(n)]).astype(np.float32)


def bucketed(vectors: DataFrame, tables: int, rounds: int, dim: int = 64) -> DataFrame:
    """(key, rank, id, code, step, err): one row per vector and table."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rot = _rotations(tables * rounds, dim)
        for pdf in batches:
            if not len(pdf):
                continue
            v = matrix(pdf["vec"], dim)
            code, step, err = int8_codes(v)
            codes = [c.tobytes() for c in code]
            for t in range(tables):
                key = np.full(len(v), t, np.int64)
                for r in range(rounds):
                    p = v @ rot[t * rounds + r]
                    j = np.abs(p).argmax(1)
                    key = key * (2 * dim) + 2 * j + (p[np.arange(len(v)), j] > 0)
                yield pd.DataFrame({"key": key, "rank": pdf["rank"], "id": pdf["id"], "code": codes, "step": step, "err": err})

    return vectors.withColumn("rank", F.xxhash64("id")).mapInPandas(run, "key long, rank long, id long, code binary, step float, err float")


def _link(floor: float, dim: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, ids, lead, lerr = None, [], np.zeros((0, dim), np.float32), np.zeros(0, np.float32)
        for pdf in batches:
            if not len(pdf):
                continue
            keys = pdf["key"].to_numpy()
            row = pdf["id"].to_numpy()
            c = np.frombuffer(b"".join(bytes(x) for x in pdf["code"]), np.int8).reshape(-1, dim).astype(np.float32) * pdf["step"].to_numpy()[:, None]
            err = pdf["err"].to_numpy()
            # a long bucket goes in slices; the next slice meets the leaders of those before
            cuts = np.unique(np.concatenate([np.arange(0, len(keys), 1024), np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]]))
            src: list = []
            dst: list = []
            cos: list = []
            sure: list = []
            met: list = []

            def emit(i: np.ndarray, others, s: np.ndarray, e: np.ndarray) -> None:
                src.append(row[i])
                dst.append(np.asarray(others, np.int64))
                cos.append(s)
                sure.append(s - e >= floor)
                met.append(keys[i])

            for a, b in zip(cuts[:-1], cuts[1:]):
                if keys[a] != last:
                    last, ids, lead, lerr = keys[a], [], np.zeros((0, dim), np.float32), np.zeros(0, np.float32)
                if b - a == 1 and not ids:
                    ids, lead, lerr = [row[a]], c[a : a + 1], err[a : a + 1]
                    continue
                left = np.arange(a, b)
                if ids:
                    s = c[a:b] @ lead.T
                    e = err[a:b, None] * (1 + lerr[None]) + lerr[None]
                    i, j = np.nonzero(s + e >= floor)
                    if len(i):
                        emit(a + i, np.asarray(ids)[j], s[i, j], e[i, j])
                        left = np.delete(left, np.unique(i))
                if len(left):
                    g = c[left] @ c[left].T
                    e = err[left][:, None] * (1 + err[left][None]) + err[left][None]
                    near = g + e >= floor
                    free = np.ones(len(left), bool)
                    new = []
                    for x in range(len(left)):
                        if free[x]:
                            hit = np.flatnonzero(near[x, x + 1 :]) + x + 1
                            if len(hit):
                                emit(left[hit], np.full(len(hit), row[left[x]]), g[hit, x], e[hit, x])
                                free[hit] = False
                            new.append(x)
                    left = left[new]
                if len(left):
                    ids = [*ids, *row[left]]
                    lead, lerr = np.concatenate([lead, c[left]]), np.concatenate([lerr, err[left]])
            if src:
                yield pd.DataFrame({"src": np.concatenate(src), "dst": np.concatenate(dst), "cosine": np.concatenate(cos).astype(float), "sure": np.concatenate(sure), "key": np.concatenate(met)})

    return run


def similarity_graph(vectors: DataFrame, floor: float, tables: int = 12, dim: int = 64, rows: int | None = None, rounds: int = 2) -> DataFrame:
    """(src, dst, cosine): links of cosine ``floor`` or more to leaders of lower rank.

    Links whose int8 product lies within its error bound of the floor are
    decided in float.  Rounds and tables are the same at every size, and so is
    the chance of a pair to meet; buckets hold about rows / 128^rounds
    vectors.  From two million rows a bucket is spread over tasks first; the
    leaders of its parts, whatever links they have in other tables, meet again
    in the whole bucket.
    """
    n = vectors.count() if rows is None else rows
    salts = max(1, n // 1_000_000)
    schema = "src long, dst long, cosine double, sure boolean, key long"
    b = bucketed(vectors, tables, rounds, dim)
    if salts > 1:
        b = materialize(b, "buckets")
        s = b.withColumn("bucket", F.col("key")).withColumn("key", F.xxhash64("key", F.pmod("id", F.lit(salts))))
        first = materialize(s.drop("bucket").repartition("key").sortWithinPartitions("key", "rank").mapInPandas(_link(floor, dim), schema), "links")
        linked = first.select("key", F.col("src").alias("id")).distinct()
        leaders = s.join(linked, ["key", "id"], "left_anti").withColumn("key", F.col("bucket")).select(b.columns)
        links = first.unionByName(leaders.repartition("key").sortWithinPartitions("key", "rank").mapInPandas(_link(floor, dim), schema))
    else:
        links = b.repartition("key").sortWithinPartitions("key", "rank").mapInPandas(_link(floor, dim), schema)
    links = materialize(links.groupBy("src", "dst").agg(F.max("cosine").alias("cosine"), F.max("sure").alias("sure")), "links")
    unsure = links.filter("not sure").select("src", "dst").join(vectors.toDF("src", "v"), "src").join(vectors.toDF("dst", "w"), "dst")

    @F.pandas_udf("double")
    def exact(v: pd.Series, w: pd.Series) -> pd.Series:
        return pd.Series(np.einsum("ij,ij->i", matrix(v, dim).astype(np.float64), matrix(w, dim).astype(np.float64)) if len(v) else [], dtype=float)

    decided = unsure.select("src", "dst", exact("v", "w").alias("cosine")).filter(F.col("cosine") >= floor)
    return links.filter("sure").select("src", "dst", "cosine").unionByName(decided)


def markov_clusters(graph: DataFrame, inflation: float = 2.0, prune: float = 1e-3, most: int = 60) -> DataFrame:
    """(id, attractor, flow) of every node of ``graph``: the strongest attractor and its flow.

    Each round squares the matrix (a join on the middle node, which partial
    aggregation keeps narrow), raises the entries to ``inflation``, drops those
    under ``prune`` and rescales the columns.  It ends when no entry moves by
    more than a thousandth.  Flow that still moves after ``most`` rounds, which
    double its reach each, is used as it is, with a warning; what it splits
    wrongly ``closed_cliques`` joins again.
    """
    e = graph.select(F.col("src").alias("col"), F.col("dst").alias("row"), F.col("cosine").alias("w"))
    nodes = e.select("col").union(e.select("row")).distinct()
    m = e.unionByName(nodes.select("col", F.col("col").alias("row"), F.lit(1.0).alias("w")))
    # a node that has links keeps a weak loop, so that flow leaves it
    has = e.select("col").distinct().withColumn("_has", F.lit(True))
    m = m.join(has, "col", "left").withColumn("w", F.when(F.col("_has") & (F.col("col") == F.col("row")), 0.1).otherwise(F.col("w"))).drop("_has")

    def scaled(d: DataFrame) -> DataFrame:
        total = d.groupBy("col").agg(F.sum("w").alias("_t"))
        return d.join(total, "col").select("col", "row", (F.col("w") / F.col("_t")).alias("w"))

    m = materialize(scaled(m), "flow")
    for _ in range(most):
        left = m.select("col", F.col("row").alias("mid"), F.col("w").alias("a"))
        right = m.select(F.col("col").alias("mid"), "row", F.col("w").alias("b"))
        sq = left.join(right, "mid").groupBy("col", "row").agg(F.sum(F.col("a") * F.col("b")).alias("w"))
        sq = scaled(sq.select("col", "row", F.pow("w", F.lit(inflation)).alias("w")))
        nxt = materialize(scaled(sq.filter(F.col("w") >= prune)), "flow")
        moved = m.toDF("col", "row", "w0").join(nxt, ["col", "row"], "full").agg(F.max(F.abs(F.coalesce("w", F.lit(0.0)) - F.coalesce("w0", F.lit(0.0))))).first()[0]
        m = nxt
        if moved is None or moved < 1e-3:
            break
    else:
        warnings.warn(f"the flow still moves by {moved} after {most} rounds", RuntimeWarning, stacklevel=2)
    return m.groupBy("col").agg(F.max(F.struct("w", (-F.col("row")).alias("r"))).alias("_x"), F.collect_set("row").alias("rows")).select(F.col("col").alias("id"), (-F.col("_x.r")).alias("attractor"), F.col("_x.w").alias("flow"), "rows")


def clusters(graph: DataFrame) -> DataFrame:
    """(id, cluster, attractor, flow): attractors to which one column flows are one cluster, named by the smallest of them."""
    mc = materialize(markov_clusters(graph), "clusters")
    ends = mc.select(F.col("attractor").alias("a"), F.explode("rows").alias("b")).filter("a <> b").distinct()
    comp = components(ends)
    return mc.join(comp, mc["attractor"] == comp["node"], "left").select("id", F.coalesce("root", "attractor").alias("cluster"), "attractor", "flow")


def cliques(members: DataFrame, vectors: DataFrame, floor: float, least: int = 5, dim: int = 64, block_rows: int = 4096) -> DataFrame:
    """Clusters of ``least`` or more in which any two vectors have cosine ``floor`` or more: (cluster, size).

    A vector within half the angle of the mean direction is near every other
    such vector; only those farther out are compared, in blocks, with all
    members of their cluster.  Sums and comparisons run over partitions, a
    cluster is never collected.
    """
    mv = materialize(members.select("id", "cluster").join(vectors, "id"), "member_vectors")

    def part_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                v = matrix(pdf["vec"], dim).astype(np.float64)
                u, inv = np.unique(pdf["cluster"].to_numpy(), return_inverse=True)
                s = np.zeros((len(u), dim))
                np.add.at(s, inv, v)
                yield pd.DataFrame({"cluster": u, "n": np.bincount(inv), "s": list(s)})

    parts = mv.mapInPandas(part_sums, "cluster long, n long, s array<double>")
    sums = parts.groupBy("cluster").agg(F.sum("n").alias("size"), F.array(*[F.sum(F.col("s")[i]) for i in range(dim)]).alias("mean")).filter(F.col("size") >= least)
    sums = materialize(sums, "means")
    limit = float(np.cos(np.arccos(floor) / 2))

    @F.pandas_udf("double")
    def to_mean(v: pd.Series, mean: pd.Series) -> pd.Series:
        if not len(v):
            return pd.Series([], dtype=float)
        m = np.stack(mean.to_numpy())
        return pd.Series(np.einsum("ij,ij->i", matrix(v, dim).astype(np.float64), m) / np.maximum(1e-12, np.linalg.norm(m, axis=1)))

    near = materialize(mv.join(sums, "cluster").select("id", "cluster", "size", "vec", to_mean("vec", "mean").alias("to_mean")), "to_mean")
    far = F.col("to_mean") < limit + 1e-6
    counts = near.groupBy("cluster").agg(F.count(F.when(far, 1)).alias("n_far")).filter("n_far > 0")
    # block (q, p): part q of the far vectors against part p of all members of the cluster
    grid = near.join(counts, "cluster").select("id", "cluster", "vec", far.alias("is_far"), F.ceil(F.col("size") / block_rows).cast("int").alias("ps"), F.ceil(F.col("n_far") / block_rows).cast("int").alias("qs"))
    h = F.xxhash64("id")
    left = grid.filter("is_far").select("cluster", F.col("vec").alias("far_vec"), F.pmod(h, "qs").cast("int").alias("q"), F.explode(F.sequence(F.lit(0), F.col("ps") - 1)).alias("p"))
    right = grid.select(F.col("cluster").alias("c"), "vec", F.explode(F.sequence(F.lit(0), F.col("qs") - 1)).alias("r"), F.pmod(h, "ps").cast("int").alias("s"))

    def compare(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"cluster": [], "ok": []})
        a, b = matrix(left["far_vec"], dim), matrix(right["vec"], dim)
        return pd.DataFrame({"cluster": [key[0]], "ok": [float((a @ b.T).min()) >= floor - 1e-6]})

    bad = left.groupBy("cluster", "q", "p").cogroup(right.groupBy("c", "r", "s")).applyInPandas(compare, "cluster long, ok boolean").filter("not ok").select("cluster").distinct()
    return sums.select("cluster", "size").join(bad, "cluster", "left_anti")


def outside_links(members: DataFrame, closed: DataFrame, vectors: DataFrame, floor: float, dim: int = 64, block_rows: int = 65_536) -> DataFrame:
    """(id, cluster, cosine): vectors outside a cluster of ``closed`` (cluster) of cosine ``floor`` or more to one of its members.

    Exact: a vector that near to a member lies within the angle of ``floor``
    plus that of the farthest member from the mean direction, so all vectors
    are compared with all means, ``block_rows`` of them at a time, and those
    within that angle with the members.
    """
    mv = materialize(members.join(closed.select("cluster"), "cluster", "left_semi").select("id", "cluster").join(vectors, "id"), "closed")
    own = vectors.join(members.select("id", F.col("cluster").alias("own")), "id", "left")
    own = materialize(own.withColumn("own", F.coalesce("own", "id")), "owned")

    def part_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                u, inv = np.unique(pdf["cluster"].to_numpy(), return_inverse=True)
                s = np.zeros((len(u), dim))
                np.add.at(s, inv, matrix(pdf["vec"], dim).astype(np.float64))
                yield pd.DataFrame({"cluster": u, "s": list(s)})

    means = mv.mapInPandas(part_sums, "cluster long, s array<double>").groupBy("cluster").agg(F.array(*[F.sum(F.col("s")[i]) for i in range(dim)]).alias("mean"))

    @F.pandas_udf("double")
    def to_mean(v: pd.Series, mean: pd.Series) -> pd.Series:
        if not len(v):
            return pd.Series([], dtype=float)
        m = np.stack(mean.to_numpy())
        return pd.Series(np.einsum("ij,ij->i", matrix(v, dim).astype(np.float64), m) / np.maximum(1e-12, np.linalg.norm(m, axis=1)))

    means = materialize(means, "means")
    reps = materialize(mv.join(means, "cluster").select("cluster", to_mean("vec", "mean").alias("c")).groupBy("cluster").agg(F.min("c").alias("c")).join(means, "cluster"), "representatives")
    blocks = -(-reps.count() // block_rows)

    def near_means(ids: np.ndarray, m: np.ndarray, limit: np.ndarray):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                v, mine = matrix(pdf["vec"], dim), pdf["own"].to_numpy()
                for lo in range(0, len(ids), 2048):
                    i, j = np.nonzero(v @ m[lo : lo + 2048].T >= limit[lo : lo + 2048])
                    i, j = i[mine[i] != ids[lo + j]], j[mine[i] != ids[lo + j]]
                    yield pd.DataFrame({"id": pdf["id"].to_numpy()[i], "cluster": ids[lo + j]})

        return run

    found = None
    for b in range(blocks):
        rows = reps.filter(F.pmod(F.xxhash64("cluster"), F.lit(blocks)) == b).collect()
        m = np.array([r["mean"] for r in rows], np.float64).reshape(-1, dim)
        m = (m / np.maximum(1e-12, np.linalg.norm(m, axis=1, keepdims=True))).astype(np.float32)
        widest = np.arccos(floor) + np.arccos(np.clip([r["c"] for r in rows], -1, 1)) + 1e-3
        part = own.mapInPandas(near_means(np.array([r["cluster"] for r in rows], np.int64), m, np.cos(np.minimum(widest, np.pi)).astype(np.float32)), "id long, cluster long")
        part = materialize(part, "near_means")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return members.select("id", "cluster", F.lit(1.0).alias("cosine")).limit(0)

    @F.pandas_udf("double")
    def exact(v: pd.Series, w: pd.Series) -> pd.Series:
        return pd.Series(np.einsum("ij,ij->i", matrix(v, dim).astype(np.float64), matrix(w, dim).astype(np.float64)) if len(v) else [], dtype=float)

    def linked(pairs: DataFrame, among: DataFrame) -> DataFrame:
        met = pairs.join(vectors, "id").join(among.select("cluster", F.col("vec").alias("member")), "cluster")
        return met.select("id", "own", "cluster", exact("vec", "member").alias("cosine")).groupBy("id", "own", "cluster").agg(F.max("cosine").alias("cosine")).filter(F.col("cosine") >= floor)

    # one link joins two clusters: a few members first, all of them only for what is then still open
    found = materialize(found.join(own.select("id", "own"), "id"), "near_means")
    few = mv.groupBy("cluster", F.pmod(F.xxhash64("id"), F.lit(4)).alias("_p")).agg(F.min_by("vec", F.xxhash64("id", "cluster")).alias("vec"))
    first = materialize(linked(found, few), "linked")
    rest = found.join(first.select("own", "cluster").distinct(), ["own", "cluster"], "left_anti")
    return first.unionByName(linked(rest, mv)).select("id", "cluster", "cosine")


def closed_cliques(members: DataFrame, vectors: DataFrame, floor: float, least: int = 5, dim: int = 64) -> tuple[DataFrame, DataFrame]:
    """(members, sizes): clusters joined by the links the hash tables missed, and their cliques of ``least`` or more.

    Cliques of two or more, also those too small to report, are compared with
    all vectors; what is near to one joins it, until nothing outside is near.
    A cluster that is no clique stays none whatever joins it.  A group of
    which no two vectors met in any table is the one thing not seen.
    """
    check = sizes = cliques(members, vectors, floor, 2, dim)
    while True:
        links = materialize(outside_links(members, check, vectors, floor, dim), "outside")
        if links.isEmpty():
            return members, sizes.filter(F.col("size") >= least)
        own = links.select("id", F.col("cluster").alias("to")).join(members.select("id", "cluster"), "id", "left")
        # a vector alone is a cluster of its own, named by its id as all are by a member's
        ends = own.select(F.coalesce("cluster", "id").alias("a"), F.col("to").alias("b")).distinct()
        comp = materialize(components(ends), "joined")
        alone = own.filter("cluster is null").select("id", F.col("id").alias("cluster"), F.col("id").alias("attractor"), F.lit(0.0).alias("flow")).distinct()
        grown = members.unionByName(alone).join(comp, F.col("cluster") == F.col("node"), "left")
        members = materialize(grown.select("id", F.coalesce("root", "cluster").alias("cluster"), "attractor", "flow"), "clusters")
        sizes = materialize(cliques(members, vectors, floor, 2, dim), "cliques")
        check = sizes.join(comp.select(F.col("root").alias("cluster")).distinct(), "cluster", "left_semi")


def describe(members: DataFrame, sizes: DataFrame, vectors: DataFrame, cortex: DataFrame, typical: int = 3, dim: int = 64, most_lives: int = 100_000) -> DataFrame:
    """(cluster_first_id, size, typical_ids, life_id, life_cosine): the ``typical`` members of strongest flow and the nearest usable centroid.

    The table of lives is small by nature; its size is checked.  Typical
    members come from a bounded aggregate per part of a cluster, not a sort.
    """
    from memloom.llm.vectors import usable_array

    m = members.join(sizes, "cluster")
    part = m.withColumn("_p", F.pmod(F.xxhash64("id"), F.lit(64)))
    key = F.struct((-F.col("flow")).alias("f"), "id")
    best = part.groupBy("cluster", "_p").agg(F.slice(F.array_sort(F.collect_list(key)), 1, typical).alias("t"), F.min("id").alias("lo"), F.count(F.lit(1)).alias("n"))
    best = best.groupBy("cluster").agg(F.slice(F.array_sort(F.flatten(F.collect_list("t"))), 1, typical).alias("t"), F.min("lo").alias("cluster_first_id"), F.sum("n").alias("size"))
    best = best.select("cluster_first_id", "size", F.transform("t", lambda x: x["id"]).alias("typical_ids"))
    rep = materialize(best.join(vectors.toDF("_i", "vec"), F.col("typical_ids")[0] == F.col("_i")).drop("_i"), "described")
    lives = cortex.filter(usable_array(F.col("semantic_centroid"), dim)).select("life_id", "semantic_centroid").limit(most_lives + 1).collect()
    if len(lives) > most_lives:
        raise ValueError(f"more than {most_lives} lives")
    names = [r[0] for r in lives]
    c = np.array([r[1] for r in lives], np.float64).reshape(-1, dim)
    c = c / np.maximum(1e-12, np.linalg.norm(c, axis=1, keepdims=True))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pdf.drop(columns="vec")
            if len(pdf) and len(names):
                s = matrix(pdf["vec"], dim).astype(np.float64) @ c.T
                j = s.argmax(1)
                out["life_id"], out["life_cosine"] = [names[x] for x in j], np.round(s[np.arange(len(j)), j], 6)
            else:
                out["life_id"], out["life_cosine"] = None, np.nan
            yield out

    return rep.mapInPandas(run, "cluster_first_id long, size long, typical_ids array<long>, life_id string, life_cosine double")
