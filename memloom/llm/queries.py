"""Queries of the training-data operators: pN_found and their fuller results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.sources.tables import table


def _contents(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "episodes").select(F.lit("episode").alias("rec_kind"), F.col("episode_id").cast("string").alias("rec_key"), "feed", F.col("content").alias("text"))
    g = table(spark, sf, "engrams").select(F.lit("engram").alias("rec_kind"), F.col("engram_id").alias("rec_key"), "feed", F.col("content").alias("text"))
    return e.unionByName(g)


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Records whose content was cut off before its end."""
    from memloom.llm.truncation import cut_records

    return cut_records(_contents(spark, sf)).filter("cut").select("rec_kind", "rec_key").distinct()


def p2_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Share of cut records by feed."""
    from memloom.llm.truncation import cut_records, cut_shares

    return cut_shares(cut_records(_contents(spark, sf)))


def p3_survivors(spark: SparkSession, sf: str) -> DataFrame:
    """One fused record per group of engrams of a tenant that say the same."""
    from memloom.llm.dedupe import same_text_groups
    from memloom.llm.survivor import survivors
    from memloom.sources.tables import materialize

    e = table(spark, sf, "engrams")
    groups = materialize(same_text_groups(e, "engram_id", "content", ["tenant_id"]), "groups")
    return survivors(e, groups)


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """First id and best member of each group of engrams that say the same."""
    return p3_survivors(spark, sf).select("group_first_id", "best_id").distinct()


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Repeats among the batches 7-10, with the accepted episode they repeat."""
    from memloom.llm.dedupe import batch_repeats

    e = table(spark, sf, "episodes").select(F.col("episode_id").alias("row_id"), "batch_no", "tenant_id", "context", F.col("content").alias("text"))
    r = table(spark, sf, "reports").select("episode_id", "deduplicated", "gate_rejected").distinct()
    ok = r.filter(~F.coalesce("deduplicated", F.lit(False)) & ~F.coalesce("gate_rejected", F.lit(False))).select(F.col("episode_id").alias("row_id"))
    history = e.filter("batch_no <= 6").join(ok, "row_id", "left_semi")
    batches = [e.filter(F.col("batch_no") == b) for b in (7, 8, 9, 10)]
    return batch_repeats(history, batches, ["tenant_id", "context"]).distinct()


def p1_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """Pieces of all episodes within the limit of their kind."""
    from memloom.llm.split import split_episodes

    p = split_episodes(table(spark, sf, "episodes"), table(spark, sf, "size_limits"))
    return p.select("episode_id", "kind", "piece_no", "n_pieces", "start", "body_start", "end", "chunk_id", "piece")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Episodes that the splitter cut into more than one piece."""
    return p1_pieces(spark, sf).filter((F.col("piece_no") == 0) & (F.col("n_pieces") > 1)).select("episode_id").distinct()


def _episode_vectors(spark: SparkSession, sf: str) -> DataFrame:
    from memloom.llm.vectors import from_arrays
    from memloom.sources.tables import materialize

    return materialize(from_arrays(table(spark, sf, "episodes"), "episode_id", "semantic_vector"), "vectors")


def _p4_clusters(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    from memloom.llm.markov import closed_cliques, clusters, similarity_graph
    from memloom.sources.tables import materialize

    v = _episode_vectors(spark, sf)
    members = materialize(clusters(similarity_graph(v, 0.8)), "clusters")
    return v, *closed_cliques(members, v, 0.8)


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Members of the clusters of five or more mutually similar episode vectors."""
    _, members, sizes = _p4_clusters(spark, sf)
    firsts = members.groupBy("cluster").agg(F.min("id").alias("cluster_first_id"))
    return members.join(sizes, "cluster").join(firsts, "cluster").select("cluster_first_id", F.col("id").alias("episode_id")).distinct()


def p4_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Each cluster with its size, its most typical members (strongest flow) and the nearest cortex centroid."""
    from memloom.llm.markov import describe

    v, members, sizes = _p4_clusters(spark, sf)
    return describe(members, sizes, v, table(spark, sf, "cortex"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of engram vectors of cosine 0.85 or more, one among the five most similar of the other."""
    from memloom.llm.vectors import from_blobs, similar_pairs, top_similar

    v = from_blobs(table(spark, sf, "engram_vec"), "engram_id", "vec", "dim")
    return similar_pairs(top_similar(v, 5, floor=0.85)).select(F.col("a").alias("engram_a"), F.col("b").alias("engram_b")).distinct()


def p6_nearest(spark: SparkSession, sf: str) -> DataFrame:
    """The five most similar episode vectors of every episode vector."""
    from memloom.llm.vectors import top_similar

    return top_similar(_episode_vectors(spark, sf), 5).select(F.col("id").alias("episode_id"), F.col("other").alias("similar_id"), F.round("cosine", 6).alias("cosine"))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of stuffed keywords, links or product tags."""
    return p10_pages(spark, sf).select("doc_id").distinct()


def p10_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Spam pages with reason and measures."""
    from memloom.llm.spam import spam_pages

    r = spam_pages(table(spark, sf, "documents").select("doc_id", "text", "lang"))
    return r.filter("reason is not null").select("doc_id", "language", "reason", "n_words", *[F.round(c, 6).alias(c) for c in ("top_pair", "ten_pairs", "link_share", "separators", "function_share")])


def _pii(spark: SparkSession, sf: str, redacted: bool) -> DataFrame:
    from memloom.llm.pii import find_pii

    e = table(spark, sf, "episodes").select(F.lit("episode").alias("rec_kind"), F.col("episode_id").cast("string").alias("rec_key"), F.col("content").alias("text"))
    h = table(spark, sf, "handoffs").select(F.lit("handoff").alias("rec_kind"), F.col("handoff_id").alias("rec_key"), F.col("summary").alias("text")).distinct()
    return find_pii(e.unionByName(h), "text", ["rec_kind", "rec_key"], redacted)


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    """Types of personal information in each record."""
    return _pii(spark, sf, False).select("rec_kind", "rec_key", F.explode("spans.pii_type").alias("pii_type")).distinct()


def p7_redacted(spark: SparkSession, sf: str) -> DataFrame:
    """All records with typed placeholders in place of personal information."""
    return _pii(spark, sf, True).select("rec_kind", "rec_key", F.size("spans").alias("n_spans"), "redacted")


def p8_leaks(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that contain eval items, with the share of the item's words and whether its answer is there."""
    from memloom.llm.leakage import leaks

    r = leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items"))
    return r.withColumn("share", F.round("share", 6))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents and the eval items they leak."""
    return p8_leaks(spark, sf).select("doc_id", "item_id").distinct()


def p9_mix(spark: SparkSession, sf: str) -> DataFrame:
    """The documents of the mix and how often each is used."""
    from memloom.llm.mixing import mix

    return mix(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))[0]


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Shares reached by every listed source."""
    from memloom.llm.mixing import mix

    return mix(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))[1]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[:1] == "p" and k[1:2].isdigit()}


P1 = """
with k as (select episode_id, length(content) as n, regexp_replace(lower(split_part(context, ':', 1)), '^[\\s\\x{00A0}]+|[\\s\\x{00A0}]+$', '', 'g') as before, contains(context, ':') as colon from episodes)
select distinct episode_id from k join size_limits l on l.kind = case when colon and before in (select kind from size_limits) then before else 'other' end where n > max_chars"""
P4 = """
with v as (select episode_id as id, semantic_vector::double[] as x from episodes where len(semantic_vector) = 64 and len(list_filter(semantic_vector, lambda y: y is not null and isfinite(y))) = 64 and len(list_filter(semantic_vector, lambda y: y <> 0)) > 0),
u as (select id, list_transform(x, lambda y: y / list_max(list_transform(x, lambda z: abs(z)))) as x from v),
e as (select a.id, b.id as other from u a, u b where list_cosine_similarity(a.x, b.x) >= 0.8 or a.id = b.id),
n as (select id, min(other) as first, count(*) as size from e group by 1),
ok as (select e.id, min(a.first) as lo, max(b.first) as hi, max(b.size) as most, min(b.size) as least from e join n a on a.id = e.id join n b on b.id = e.other group by 1),
g as (select n.first, count(*) as members, bool_and(ok.lo = ok.hi and ok.most = n.size and ok.least = n.size) as good, min(n.size) as size from n join ok using (id) group by 1)
select g.first as cluster_first_id, n.id as episode_id from n join g using (first) where g.good and g.size = g.members and g.members >= 5"""


def oracle_sql() -> dict[str, str]:
    """SQL of what SQL can say; the other queries are tested against brute force or held-out labels."""
    return {"p1_found": P1, "p4_found": P4}
