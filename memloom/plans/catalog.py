"""All queries of the engine's core over the test tables, and their SQL (DuckDB)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from memloom.functions import stages as S
from memloom.functions.text import cosine, micro, rich_tokens, words
from memloom.operators import coactive, gate, graph, lifecycle, query, recall
from memloom.sources import fovea
from memloom.sources.tables import materialize, table
from memloom.streaming import ingest as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

WORDS = r"list_filter(regexp_split_to_array(lower(coalesce({0},'')), '[^\p{{L}}\p{{N}}]+'), lambda x: strlen(x) >= 2)"
SLUG = r"array_to_string(list_slice({0},1,6),'_')"


def _w(c: str) -> str:
    return WORDS.format(c)


def _rich(content: str, context: str, outcome: str) -> str:
    w = _w(content)
    gram = lambda n: f"(case when len({w}) >= {n} then list_transform(range(1, len({w}) - {n - 2}), lambda i: array_to_string(list_slice({w}, i, i + {n - 1}), '_')) else [] end)"
    pre = lambda p, x: f"list_transform({x}, lambda y: '{p}' || y)"
    return (
        f"list_distinct(list_concat({pre('c:', w)}, {pre('x:', _w(context))}, {pre('o:', _w(outcome))}, {pre('bg:c:', gram(2))}, {pre('tg:c:', gram(3))}, "
        f"['ctx@' || {SLUG.format(_w(context))}, 'sum@' || {SLUG.format(_w(f'substr({content},1,48)'))}]))"
    )


CUES = "(select handoff_id as cue_id, min(summary) as cue, min(agent) as agent_id from handoffs where summary is not null and summary <> '' group by 1)"
LEX = f"""
 cues as {CUES},
 cw as (select cue_id, w as word, count(*) as times from (select cue_id, unnest(list_filter({_w('cue')}, lambda x: strlen(x) > 2)) as w from cues) group by 1, 2),
 pw as (select engram_id, unnest(list_distinct(list_filter({_w('content')}, lambda x: strlen(x) > 2))) as word from engrams),
 hits as (select cue_id, engram_id, sum(times)::bigint as hits from pw join cw using (word) group by 1, 2),
 seeds as (select *, row_number() over (partition by cue_id order by hits desc, engram_id) as rank from hits qualify rank <= 64)"""
OVER = f"""
 ct as (select cue_id, len(ts) as cue_size, unnest(ts) as token from (select cue_id, {_rich('cue', "''", "''")} as ts from cues)),
 pt as (select engram_id, unnest({_rich('content', 'context', 'outcome')}) as token from engrams),
 ov as (select cue_id, engram_id, count(*) as matched, any_value(cue_size) as cue_size from pt join ct using (token) group by 1, 2)"""
HASH = "('0x' || substr(md5({0}), 1, 15))::bigint"


def _dg(tokens: str, life: str) -> str:
    h = lambda k: f"('0x' || substr(md5({life} || '|' || t), {k}, 15))::bigint"
    return f"list_sort(list_distinct(flatten(list_transform({tokens}, lambda t: [{h(1)}, {h(16)}]))))"


CA3 = f"list_sort(list_distinct(list_concat(dg, list_transform(range(1, len(dg)), lambda i: {HASH.format("dg[i]::varchar || '|' || dg[i+1]::varchar")}))))"


def _features(rows: str, life: str) -> str:
    """CTEs ``g`` (id, dg) and ``f`` (id, dg, ca3) of a table of rows."""
    return f" g as (select engram_id, {_dg(_rich('content', 'context', 'outcome'), life)} as dg from {rows}), f as (select engram_id, dg, {CA3} as ca3 from g)"


#: Rows and cues with vectors: stored episodes of batches 1-6, and every fiftieth episode of the later ones.
USABLE = "len({0}) = 64 and len(list_filter({0}, lambda y: y is not null and isfinite(y))) = 64"
STORED = f"""
 er as (select episode_id::varchar as engram_id, content, context, outcome, agent_id, provenance, case when {USABLE.format('semantic_vector')} then semantic_vector::double[] end as v from episodes where batch_no <= 6),
 ec as (select episode_id::varchar as cue_id, content as cue, agent_id, case when {USABLE.format('semantic_vector')} then semantic_vector::double[] end as v from episodes where batch_no > 6 and episode_id % 50 = 0),
 cw as (select cue_id, w as word, count(*) as times from (select cue_id, unnest(list_filter({_w('cue')}, lambda x: strlen(x) > 2)) as w from ec) group by 1, 2),
 pw as (select engram_id, unnest(list_distinct(list_filter({_w('content')}, lambda x: strlen(x) > 2))) as word from er),
 hits as (select cue_id, engram_id, sum(times)::bigint as hits from pw join cw using (word) group by 1, 2),
 lex as (select cue_id, engram_id from hits qualify row_number() over (partition by cue_id order by hits desc, engram_id) <= 64),
 sims as (select cue_id, engram_id, list_cosine_similarity(ec.v, er.v) as sim from ec, er where ec.v is not null and er.v is not null and list_max(list_transform(ec.v, lambda y: abs(y))) > 0 and list_max(list_transform(er.v, lambda y: abs(y))) > 0),
 vecs as (select cue_id, engram_id, sim from sims where sim > 0.05 qualify row_number() over (partition by cue_id order by round(sim, 9) desc, engram_id) <= 50),
 cand as (select cue_id, engram_id from lex union select cue_id, engram_id from vecs)"""
VER = "coalesce(struct_extract(provenance,'verified'),false)"
FACT = "(regexp_matches(lower(content),'[0-9]') or contains(lower(content),'$') or contains(lower(content),'balance') or contains(lower(content),'wallet') or contains(lower(content),'ledger'))"
MICRO = "floor(({0}) * 1000000 + 0.5)::bigint"


def q(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _engrams(s, d):
    return table(s, d, "engrams")


def _cues(s, d):
    return table(s, d, "handoffs").filter("summary is not null and summary <> ''").groupBy(F.col("handoff_id").alias("cue_id")).agg(F.min("summary").alias("cue"), F.min("agent").alias("agent_id"))


def _stored(s, d):
    """Episodes of batches 1-6 in the shape of stored rows, with vectors."""
    e = table(s, d, "episodes").filter("batch_no <= 6")
    return e.select(F.col("episode_id").cast("string").alias("engram_id"), "content", "context", "outcome", "agent_id", "tenant_id", "provenance", "rag", F.col("semantic_vector").alias("vector"))


def _vector_cues(s, d):
    """Every fiftieth episode of the later batches as a cue with a vector."""
    e = table(s, d, "episodes").filter("batch_no > 6 and episode_id % 50 = 0")
    return e.select(F.col("episode_id").cast("string").alias("cue_id"), F.col("content").alias("cue"), "agent_id", "tenant_id", F.col("semantic_vector").alias("vector"))


# -- text and sources ----------------------------------------------------------
@q(f"select engram_id, unnest({_w('content')}) as word, generate_subscripts({_w('content')}, 1) - 1 as pos from engrams")
def tokens_words(s, d):
    return _engrams(s, d).select("engram_id", F.posexplode(words(F.col("content"))).alias("pos", "word")).select("engram_id", "word", F.col("pos").cast("long").alias("pos"))


@q(f"select engram_id, unnest({_rich('content', 'context', 'outcome')}) as token from engrams")
def tokens_rich(s, d):
    return recall.postings(_engrams(s, d))


@q(f"select token, count(*) as n from (select unnest({_rich('text', chr(39) * 2, chr(39) * 2)}) as token from documents where text is not null) where token like 'tg:%' group by 1")
def tokens_ngrams(s, d):
    t = table(s, d, "documents").filter("text is not null").select(F.explode(rich_tokens(F.col("text"), F.lit(""), F.lit(None).cast("string"))).alias("token"))
    return t.filter(F.col("token").startswith("tg:")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def clip_sql(x: str) -> str:
    """At most 80 bytes of a text, else the characters that fit into 79 and an ellipsis."""
    return f"(case when strlen({x}) <= 80 then {x} else substr({x}, 1, list_max(list_filter(range(0, 80), lambda k: strlen(substr({x}, 1, k)) <= 79))) || '…' end)"


@q(f"""
with t as (select doc_id, list_filter(regexp_split_to_array(coalesce(text,''), '\\s+'), lambda x: x <> '') as ts from documents),
p as (select doc_id, ts, unnest(range(0, (case when len(ts) <= 12 then 0 else ceil((len(ts) - 12) / 8.0) end)::int + 1)) as packet from t where len(ts) > 0),
w as (select doc_id, packet, array_to_string(ts[packet*8+1 : packet*8+12],' ') as f, array_to_string(ts[greatest(packet*8-12,0)+1 : packet*8],' ') as b, array_to_string(ts[packet*8+13 : packet*8+24],' ') as a from p)
select doc_id, packet::int as packet, (packet * 8)::int as token_offset, f as fovea, {clip_sql('b')} as "before", {clip_sql('a')} as "after", (45 + 10 * least(packet,3))::int as salience_percent from w""")
def fovea_packets(s, d):
    return fovea.packets(table(s, d, "documents"), "doc_id", "text")


PROJECTED = """
 low as (select {0} as id, lower(coalesce({1},'')) as t from {2}), tk as (select id, t, list_filter(regexp_split_to_array(t, '[^a-z0-9]+'), lambda x: x <> '') as ws from low),
 w as (select id, unnest(case when len(ws) > 0 then ws else [substr(t,1,32)] end) as w from tk), h as (select id, w, count(*) as times, sha256(w) as h from w group by 1, 2),
 x as (select id, times, unnest(list_transform(range(0,8), lambda i: ('0x' || substr(h,7+8*i,2) || substr(h,5+8*i,2) || substr(h,3+8*i,2) || substr(h,1+8*i,2))::bigint)) as x from h),
 s as (select id, x % 32 as slot, sum(times * (case when x % 2 = 1 then 1 else -1 end))::bigint as value from x group by 1, 2 having value <> 0)"""


@q(f"with {PROJECTED.format('doc_id', 'text', 'documents')}, n as (select id, sqrt(sum(value::double * value)) as norm from s group by 1) select id as doc_id, slot, {MICRO.format('value / norm')} as value from s join n using (id)")
def hash_embedding(s, d):
    return fovea.hash_embedding(table(s, d, "documents"), "doc_id", "text").select("doc_id", "slot", micro(F.col("value")).alias("value"))


# -- seeds and recall ------------------------------------------------------------
@q(f"with {LEX} select cue_id, engram_id, hits, rank::int as rank from seeds")
def lexical_seeds(s, d):
    return recall.lexical_seeds(_engrams(s, d), _cues(s, d))


@q(f"""
with cues as {CUES}, w as (select engram_id, {_w('content')} as ws from engrams), st as (select count(*) as n, avg(len(ws)) as avg_len from w),
c as (select cue_id, unnest(list_distinct({_w('cue')})) as word from cues),
tf as (select engram_id, len(ws) as l, u.word, count(*) as tf from w, unnest(ws) as u(word) where u.word in (select word from c) group by 1, 2, 3),
df as (select word, count(*) as df from tf group by 1),
sc as (select cue_id, engram_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / avg_len))) as score from tf join df using (word) join c using (word), st group by 1, 2)
select cue_id, engram_id, floor(score * 1000 + 0.5)::bigint as milli, (row_number() over (partition by cue_id order by round(score, 9) desc, engram_id))::int as rank from sc qualify rank <= 10""")
def bm25_topk(s, d):
    return recall.bm25(_engrams(s, d), _cues(s, d)).select("cue_id", "engram_id", F.floor(F.col("score") * 1000 + 0.5).cast("long").alias("milli"), "rank")


COS = "list_cosine_similarity({0}::double[], {1}::double[])"


@q(f"""
with h as (select a.vec_id as query_id, b.vec_id, {COS.format('a.embedding', 'b.embedding')} as sim from embeddings a, embeddings b where a.vec_id % 50 = 0 and a.vec_id <> b.vec_id)
select query_id, vec_id, {MICRO.format('sim')} as sim, (row_number() over (partition by query_id order by round(sim, 9) desc, vec_id))::int as rank from h where sim > 0.05 qualify rank <= 10""")
def vector_topk(s, d):
    e = table(s, d, "embeddings")
    return recall.vector_topk(e, e.filter("vec_id % 50 = 0"), 10).select("query_id", "vec_id", micro(F.col("sim")).alias("sim"), "rank")


@q(f"select a.vec_id as query_id, count(*) as near from embeddings a, embeddings b where a.vec_id % 50 = 0 and a.vec_id <> b.vec_id and {COS.format('a.embedding', 'b.embedding')} > 0.3 group by 1")
def vector_pairs_threshold(s, d):
    e = table(s, d, "embeddings")
    return recall.vector_hits(e, e.filter("vec_id % 50 = 0"), 0.3).groupBy("query_id").agg(F.count(F.lit(1)).alias("near"))


@q(f"""
with h as (select a.vec_id as query_id, a.label = b.label as rel, row_number() over (partition by a.vec_id order by round({COS.format('a.embedding', 'b.embedding')}, 9) desc, b.vec_id) as rank
 from embeddings a, embeddings b where a.vec_id % 50 = 0 and a.vec_id <> b.vec_id and {COS.format('a.embedding', 'b.embedding')} > 0.05 qualify rank <= 10),
n as (select label, count(*) - 1 as rel_all from embeddings group by 1)
select query_id, {MICRO.format("sum(case when rel then 1 else 0 end) / any_value(rel_all)::double")} as recall_micro from h join embeddings e on e.vec_id = query_id join n on n.label = e.label group by 1""")
def recall_at_k(s, d):
    e = table(s, d, "embeddings")
    t = recall.vector_topk(e, e.filter("vec_id % 50 = 0"), 10)
    mine = e.join(e.groupBy("label").agg((F.count(F.lit(1)) - 1).alias("rel_all")), "label").select(F.col("vec_id").alias("query_id"), F.col("label").alias("own"), "rel_all")
    return t.join(mine, "query_id").groupBy("query_id").agg(micro(F.count_if(F.col("label") == F.col("own")) / F.first("rel_all")).alias("recall_micro"))


@q(f"""
with h as (select a.vec_id as query_id, case when a.label = b.label then 1 else 0 end as rel, row_number() over (partition by a.vec_id order by round({COS.format('a.embedding', 'b.embedding')}, 9) desc, b.vec_id) as rank
 from embeddings a, embeddings b where a.vec_id % 50 = 0 and a.vec_id <> b.vec_id and {COS.format('a.embedding', 'b.embedding')} > 0.05 qualify rank <= 10)
select query_id, {MICRO.format("sum(rel / log2(rank + 1)) / (select sum(1 / log2(i + 1)) from range(1, 11) t(i))")} as ndcg_micro from h group by 1""")
def ndcg_at_10(s, d):
    e = table(s, d, "embeddings")
    t = recall.vector_topk(e, e.filter("vec_id % 50 = 0"), 10).join(e.select(F.col("vec_id").alias("query_id"), F.col("label").alias("own")), "query_id")
    ideal = F.lit(sum(1 / __import__("math").log2(i + 1) for i in range(1, 11)))
    return t.groupBy("query_id").agg(micro(F.sum(F.when(F.col("label") == F.col("own"), 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)) / ideal).alias("ndcg_micro"))


@q(f"with {STORED} select cue_id, engram_id from cand")
def hybrid_candidates(s, d):
    return recall.hybrid_candidates(_stored(s, d), _vector_cues(s, d))


@q(f"with {LEX}, {OVER} select cue_id, engram_id, matched, {MICRO.format('matched / cue_size::double')} as overlap from ov join seeds using (cue_id, engram_id)")
def cue_overlap(s, d):
    pairs = materialize(recall.lexical_seeds(_engrams(s, d), _cues(s, d)), "pairs")
    return recall.pair_overlap(_engrams(s, d), _cues(s, d), pairs).filter("matched > 0").select("cue_id", "engram_id", "matched", micro(F.col("matched") / F.col("cue_size")).alias("overlap"))


def _recall_sql(where: str = "", cand: str = "seeds", after: str = "") -> str:
    return f"""
with {LEX}, {OVER},
 pre as (select h.*, row_number() over (partition by h.cue_id order by hits desc, h.engram_id) as r2 from hits h join engrams e using (engram_id) join cues c using (cue_id) where e.agent_id = c.agent_id qualify r2 <= 64),
 sc as (select cue_id, engram_id, e.agent_id, {VER} as verified, 0.45::double * matched / cue_size + 0.35::double * 2 * matched as a from ov join {cand} using (cue_id, engram_id) join engrams e using (engram_id)),
 cut as (select *, row_number() over (partition by cue_id order by round(a, 9) desc, engram_id) as r from sc where a > 0.05 qualify r <= 8),
 boosted as (select cut.cue_id, engram_id, verified, a + case when verified then 0.15::double else 0::double end as activation from cut join cues using (cue_id) {where})
select cue_id, engram_id, verified, {MICRO.format('activation')} as activation, (row_number() over (partition by cue_id order by round(activation, 9) desc, engram_id))::int as rank from boosted {after}"""


def _recalled(df):
    return df.select("cue_id", "engram_id", "verified", micro(F.col("activation")).alias("activation"), "rank")


@q(_recall_sql())
def recall_batch(s, d):
    return _recalled(recall.recall(_engrams(s, d), _cues(s, d)))


@q(_recall_sql(cand="pre"))
def recall_agent_scoped(s, d):
    return _recalled(recall.recall(_engrams(s, d), _cues(s, d), scope="pre"))


@q(_recall_sql(where="where cut.agent_id = cues.agent_id"))
def recall_agent_post(s, d):
    return _recalled(recall.recall(_engrams(s, d), _cues(s, d), scope="post"))


@q(f"""
with {LEX}, {OVER}, o as (select cue_id, engram_id, round(matched / cue_size::double, 9) as o, coalesce(encoded_at_tick, 0) as tick from ov join engrams using (engram_id) where matched / cue_size::double > 0.2)
select cue_id, engram_id, {MICRO.format('o')} as overlap from (select *, row_number() over (partition by cue_id order by o desc, tick desc, engram_id desc) as r from o) where r = 1""")
def pattern_complete(s, d):
    return recall.complete(_engrams(s, d), _cues(s, d)).select("cue_id", "engram_id", micro(F.col("overlap")).alias("overlap"))


WIRED = """
 raw as (select engram_id, src, dst, weight from (
   select engram_id, ca3[i] as src, ca3[j] as dst, 0.3 as weight from f, range(1, 5) a(i), range(1, 5) b(j) where j > i and j <= len(ca3)
   union all select engram_id, dg[i], dg[i+1], 0.2 from f, range(1, 9) t(i) where i < len(dg)
   union all select engram_id, ca3[i], ca3[i+1], 0.3 from f, range(1, 9) t(i) where i < len(ca3)))"""
EDGE_SQL = _features("engrams", "coalesce(life_id, '')") + "," + WIRED


@q(f"with {EDGE_SQL} select src, dst, count(*) as n, sum(floor(weight*10+0.5))::bigint as tenths from raw group by 1, 2")
def wiring_edges(s, d):
    return graph.wiring(_engrams(s, d)).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"), F.sum(F.floor(F.col("weight") * 10 + 0.5)).cast("long").alias("tenths"))


@q(f"with {EDGE_SQL} select src, dst, {MICRO.format('max(weight)')} as weight from raw group by 1, 2")
def edges_max_merge(s, d):
    return graph.merge_max(graph.wiring(_engrams(s, d))).select("src", "dst", micro(F.col("weight")).alias("weight"))


@q(f"with {EDGE_SQL} select src, dst, {MICRO.format('arg_min(weight, (engram_id, weight))')} as weight from raw group by 1, 2")
def edges_dedup_first(s, d):
    return graph.keep_first(graph.wiring(_engrams(s, d)), ["engram_id", "weight"]).select("src", "dst", micro(F.col("weight")).alias("weight"))


@q(f"""with {EDGE_SQL}, e as (select src, dst, max(weight)::double as w from raw group by 1, 2),
 gt as (select engram_id, round(greatest(0.05, least(1.0, 0.4::double*0.5 + 0.3::double*0.7 + 0.3::double*0.3 + 0.5::double * greatest(0.0, least(1.0, case when salience is null or isnan(salience) then 0 else salience::double end)))), 6) as gate from engrams),
 n as (select engram_id, unnest(ca3) as node from f),
 t as (select e.src, e.dst, count(*) as n, sum(gate) as gain from e join n a on a.node = e.src join n b on b.node = e.dst and b.engram_id = a.engram_id join gt on gt.engram_id = a.engram_id group by 1, 2)
 select e.src, e.dst, {MICRO.format('least(1.0, w + coalesce(gain, 0) * 0.05)')} as weight, coalesce(n, 0) as co_activations from e left join t using (src, dst)""")
def hebbian_weights(s, d):
    raw = materialize(graph.merge_max(coactive.wired(_engrams(s, d))), "edges")
    return graph.hebbian(graph.together(raw, _engrams(s, d))).select("src", "dst", micro(F.col("weight")).alias("weight"), "co_activations")


@q(f"with {EDGE_SQL}, e as (select src, dst, max(weight) as weight from raw group by 1, 2), p as (select src, dst, weight * ((src % 97 + 97) % 97) / 97.0 as weight from e) select src, dst, {MICRO.format('weight')} as weight from p where weight >= 0.05")
def edges_pruned(s, d):
    # imported weights may be small; natively wired ones never fall under a threshold
    e = graph.merge_max(graph.wiring(_engrams(s, d))).withColumn("weight", F.col("weight") * F.pmod("src", F.lit(97)) / 97)
    return graph.prune(e, S.STAGES[6][3]).select("src", "dst", micro(F.col("weight")).alias("weight"))


HOP = """ m{0} as (select cue_id, dst as node, activation * weight * 0.21 as a from a{1} join e on node = src where activation * weight * 0.21 > 0.001),
 a{0} as (select cue_id, node, sum(a) as activation from (select cue_id, node, activation as a from a{1} union all select cue_id, node, a from m{0}) group by 1, 2 having sum(a) > 0.01)"""


STORED_EDGES = _features("er", "'life'") + "," + WIRED + ", e as (select src, dst, max(weight)::double as weight from raw group by 1, 2)"
SPREAD = f" a0 as (select distinct cue_id, unnest({_dg(_rich('cue', chr(39) * 2, chr(39) * 2), chr(39) + 'life' + chr(39))}) as node, 1.0::double as activation from ec)," + ",".join(HOP.format(i, i - 1) for i in range(1, 5))


@q(f"with {STORED}, {STORED_EDGES}, {SPREAD} select cue_id, count(*) as nodes, floor(sum(activation) * 1000 + 0.5)::bigint as milli from a4 group by 1")
def spread_activation(s, d):
    edges = materialize(graph.merge_max(graph.wiring(_stored(s, d), life="life")), "edges")
    seeds = recall.cue_features(_vector_cues(s, d), F.lit("life")).withColumn("activation", F.lit(1.0))
    a = recall.spread(seeds, edges, S.SPREAD * S.STAGES[2][2])
    return a.groupBy("cue_id").agg(F.count(F.lit(1)).alias("nodes"), F.floor(F.sum("activation") * 1000 + 0.5).cast("long").alias("milli"))


HYBRID = f"""
with {STORED}, {STORED_EDGES}, {SPREAD},
 ct as (select cue_id, len(ts) as cue_size, unnest(ts) as token from (select cue_id, {_rich('cue', chr(39) * 2, chr(39) * 2)} as ts from ec)),
 pt as (select engram_id, unnest({_rich('content', 'context', 'outcome')}) as token from er where engram_id in (select engram_id from cand)),
 cs as (select cue_id, any_value(cue_size) as cue_size from ct group by 1),
 ov as (select cue_id, engram_id, count(*) as matched from pt join ct using (token) group by 1, 2),
 fs as (select engram_id, unnest(ca3) as node from f where engram_id in (select engram_id from cand)),
 en as (select cand.cue_id, cand.engram_id, sum(activation) as energy from cand join fs using (engram_id) join a4 on a4.cue_id = cand.cue_id and a4.node = fs.node group by 1, 2),
 sc as (select cand.cue_id, cand.engram_id, agent_id, {VER} as verified, 0.45::double * coalesce(matched, 0) / cue_size + 0.35::double * coalesce(energy, 0) + 0.2::double * (case when sim > 0.05 then sim else 0 end) as a
   from cand join er using (engram_id) join cs using (cue_id) left join ov using (cue_id, engram_id) left join en using (cue_id, engram_id) left join sims using (cue_id, engram_id)),
 cut as (select *, a + case when verified then 0.15::double else 0::double end as activation from sc where a > 0.05 qualify row_number() over (partition by cue_id order by round(a, 9) desc, engram_id) <= 8)
select cue_id, engram_id, verified, {MICRO.format('activation')} as activation, (row_number() over (partition by cue_id order by round(activation, 9) desc, engram_id))::int as rank from cut"""


@q(HYBRID)
def recall_hybrid(s, d):
    rows = _stored(s, d)
    edges = materialize(graph.merge_max(graph.wiring(rows, life="life")), "edges")
    return _recalled(recall.recall(rows, _vector_cues(s, d), edges=edges))


# -- admission ---------------------------------------------------------------------
WSET = "list_distinct(list_filter(regexp_split_to_array(lower(coalesce(content,'')), '\\s+'), lambda x: x <> ''))"
GATE = f"""
 o as (select tenant_id, engram_id as id, {WSET} as ws, {_rich('content', 'context', 'outcome')} as fs, row_number() over (partition by tenant_id order by encoded_at_tick nulls first, engram_id) as ord from engrams),
 p as (select a.id, b.id as peer, b.ord as peer_ord, case when len(a.ws) > 0 and len(b.ws) > 0 then len(list_intersect(a.ws, b.ws)) / (len(a.ws) + len(b.ws) - len(list_intersect(a.ws, b.ws)))::double else 0 end as j, len(list_intersect(a.fs, b.fs)) as i, len(a.fs) + len(b.fs) as n
   from o a join o b on a.tenant_id is not distinct from b.tenant_id and b.ord between a.ord - 512 and a.ord - 1)"""


@q(f"""
with {GATE}, best as (select id, peer, round(j, 9) as j, row_number() over (partition by id order by round(j, 9) desc, peer_ord) as r from p where round(j, 9) >= 0.72 qualify r = 1)
select b.id as engram_id, peer, {MICRO.format('j')} as jaccard, case when coalesce(struct_extract(e.provenance,'verified'),false) or coalesce(starts_with(e.context,'ledger:'),false) then 'accept'
 when j >= 0.85 or greatest(coalesce(q.separation_index::double, 0), 1 - j) < 0.35 then 'reject' else 'accept' end as verdict from best b join engrams e on e.engram_id = b.id join engrams q on q.engram_id = peer""")
def dedup_gate_snapshot(s, d):
    return gate.snapshot_gate(_engrams(s, d)).select("engram_id", "peer", micro(F.col("jaccard")).alias("jaccard"), "verdict")


ORDERED = f"""
with recursive o as (select coalesce(tenant_id, '') as scope, engram_id as id, {WSET} as ws, coalesce(separation_index::double, 0) as sep, coalesce(struct_extract(provenance,'verified'),false) or coalesce(starts_with(context,'ledger:'),false) as free,
   row_number() over (partition by coalesce(tenant_id, '') order by encoded_at_tick nulls first, engram_id) as ord from engrams),
 p as (select scope, ord, po, round(i / (n - i)::double, 9) as j, sep, pid from (select a.scope, a.ord, b.ord as po, len(list_intersect(a.ws, b.ws)) as i, len(a.ws) + len(b.ws) as n, b.sep, b.id as pid from o a join o b on a.scope = b.scope and b.ord < a.ord and len(a.ws) >= 0.7 * len(b.ws) and len(b.ws) >= 0.7 * len(a.ws) where len(a.ws) > 0)),
 near as (select scope, ord, list({{'j': j, 'o': -po, 'sep': sep, 'id': pid}}) as ps from p where j >= 0.72 group by 1, 2),
 w as (select scope, 0::bigint as ord, []::bigint[] as acc, null::varchar as id, null::varchar as peer, null::double as jaccard, true as accepted from o group by 1
  union all
  select scope, ord, case when ok then list_append(acc, ord) else acc end, id, case when best is not null then best.id end, case when best is not null then best.j end, ok from (
   select scope, ord, acc, id, best, free or best is null or not (best.j >= 0.85 or greatest(best.sep, 1 - best.j) < 0.35) as ok from (
    select w.scope, o.ord, w.acc, o.id, o.free, list_max(list_filter(near.ps, lambda x: coalesce(list_position(w.acc, -x.o), 0) > greatest(0, len(w.acc) - 512))) as best
    from w join o on o.scope = w.scope and o.ord = w.ord + 1 left join near on near.scope = o.scope and near.ord = o.ord)))
select id as engram_id, peer, {MICRO.format('jaccard')} as jaccard, accepted from w where id is not null"""


@q(ORDERED)
def dedup_gate_ordered(s, d):
    return gate.ordered_gate(_engrams(s, d)).select("engram_id", "peer", micro(F.col("jaccard")).alias("jaccard"), "accepted")


@q(f"""
with {GATE}, w as (select id, {', '.join(f'max(2 * i / greatest(1, 2 * (n - i) + {k})::double) as j{k}' for k in range(7))} from p group by 1),
 x as (select o.id, {', '.join(f'coalesce(j{k}, 0) as j{k}' for k in range(7))} from o left join w using (id))
select id as engram_id, {MICRO.format('j0')} as overlap, (case {' '.join(f'when j{k} <= 0.28 then {k}' for k in range(6))} else 6 end)::int as separators,
 {MICRO.format('1 - (case ' + ' '.join(f'when j{k} <= 0.28 then j{k}' for k in range(6)) + ' else j6 end)')} as separation from x""")
def separation_index(s, d):
    g = gate.separation_index(_engrams(s, d))
    return g.select("engram_id", micro(F.col("overlap")).alias("overlap"), "separators", micro(F.col("separation")).alias("separation"))


@q("""
with f as (select struct_extract(rag,'doc_id') as doc_id, struct_extract(rag,'chunk_id') as chunk_id, episode_id from episodes)
select min(episode_id) as episode_id, doc_id, chunk_id from f where doc_id is not null and chunk_id is not null and not exists (select 1 from engrams e where struct_extract(e.rag,'doc_id') = f.doc_id and struct_extract(e.rag,'chunk_id') = f.chunk_id) group by 2, 3""")
def ingest_idempotent(s, d):
    new = table(s, d, "episodes").select("episode_id", "rag.doc_id", "rag.chunk_id")
    return gate.insert_once(new, _engrams(s, d).select("rag.doc_id", "rag.chunk_id"))


# -- consolidation -------------------------------------------------------------------
@q(f"with t as (select round(coalesce(salience::double,0), 6) as s, unnest({_w(chr(99) + 'oncat_ws(' + chr(39) + ' ' + chr(39) + ', content, context, outcome)')}) as token from engrams) select token, floor(sum(s) * 0.1 * 1000 + 0.5)::bigint as milli, count(*) as times from t group by 1")
def token_facts(s, d):
    return graph.token_facts(_engrams(s, d)).select("token", F.floor(F.col("weight") * 1000 + 0.5).cast("long").alias("milli"), "times")


@q(f"""
with t as (select round(coalesce(salience::double,0), 6) as s, unnest({_w("concat_ws(' ', content, context, outcome)")}) as token from engrams), f as (select token, sum(s) * 0.1 as w from t group by 1),
cues as {CUES}, c as (select cue_id, len(ws) as n, unnest(ws) as token from (select cue_id, {_w('cue')} as ws from cues))
select cue_id, floor(sum(w) / any_value(n) * 100 + 0.5)::bigint as centi from c join f using (token) group by 1""")
def fact_boost(s, d):
    c = _cues(s, d).select("cue_id", words(F.col("cue")).alias("ws")).select("cue_id", F.size("ws").alias("n"), F.explode("ws").alias("token"))
    return graph.token_facts(_engrams(s, d)).join(recall.small(c), "token").groupBy("cue_id").agg(F.floor(F.sum("weight") / F.first("n") * 100 + 0.5).cast("long").alias("centi"))


CENT = "cent as (select label as centroid_id, list_transform(range(1, 65), lambda i: avg_at[i]) as centroid from (select label, list(m order by i) as avg_at from (select label, i, avg(embedding[i]::double) as m from embeddings, range(1, 65) t(i) group by 1, 2) group by 1))"


def _centroids(e):
    return e.groupBy(F.col("label").alias("centroid_id")).agg(F.array(*[F.avg(F.col("embedding")[i].cast("double")) for i in range(64)]).alias("centroid"))


@q(f"""
with e as (select episode_id, semantic_vector::double[] as v from episodes where {USABLE.format('semantic_vector')} and len(list_filter(semantic_vector, lambda y: y <> 0)) > 0), c as (select episode_id::varchar as life_id, v from e where episode_id % 50 = 0),
 s as (select episode_id, life_id, round({COS.format('e.v', 'c.v')}, 9) as sim from e, c where round({COS.format('e.v', 'c.v')}, 9) > 0.72)
select episode_id, arg_max(life_id, (sim, life_id)) as life_id, {MICRO.format('max(sim)')} as sim from s group by 1""")
def centroid_assign(s, d):
    # every fiftieth vector stands for a centroid
    v = table(s, d, "episodes").select("episode_id", F.col("semantic_vector").alias("vector"))
    c = v.filter("episode_id % 50 = 0").select(F.col("episode_id").cast("string").alias("life_id"), "vector")
    return graph.nearest_centroid(v, c).select("episode_id", "life_id", micro(F.col("sim")).alias("sim"))


@q(f"with {CENT} select centroid_id, count(*) as n, {MICRO.format('max(' + COS.format('embedding', 'centroid') + ')')} as best from embeddings join cent on label = centroid_id group by 1")
def centroid_boost(s, d):
    e = table(s, d, "embeddings")
    c = F.broadcast(_centroids(e)) if e.select("label").distinct().limit(1001).count() <= 1000 else _centroids(e)
    return e.join(c, F.col("label") == F.col("centroid_id")).groupBy("centroid_id").agg(F.count(F.lit(1)).alias("n"), micro(F.max(cosine(F.col("embedding"), F.col("centroid")))).alias("best"))


@q("select engram_id, round(salience::double, 6) as salience from engrams where round(salience::double, 6) >= 0.65 order by 2 desc, coalesce(encoded_at_tick,0), engram_id limit 20")
def consolidate_topn(s, d):
    r = _engrams(s, d).select("engram_id", F.round(F.col("salience").cast("double"), 6).alias("salience"), F.coalesce("encoded_at_tick", F.lit(0)).alias("t")).filter("salience >= 0.65")
    return r.orderBy(F.desc("salience"), "t", "engram_id").limit(20).select("engram_id", "salience")


@q("select tenant_id, engram_id, (row_number() over (partition by tenant_id order by encoded_at_tick desc nulls last, engram_id))::int as place, coalesce(replay_count,0) + 1 as replays from engrams qualify place <= 16")
def replay_recent16(s, d):
    w = W.partitionBy("tenant_id").orderBy(F.desc_nulls_last("encoded_at_tick"), "engram_id")
    return _engrams(s, d).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= S.REPLAY_ROWS).select("tenant_id", "engram_id", "place", (F.coalesce("replay_count", F.lit(0)) + 1).alias("replays"))


@q("select min(engram_id) as keeper, count(*) as merged, max(salience) as salience, sum(coalesce(replay_count,0))::bigint as replays from engrams where not coalesce(is_core,false) group by tenant_id, content, context having count(*) > 1")
def compact_exact_dups(s, d):
    return graph.exact_duplicates(_engrams(s, d))


@q(f"""
with c as (select coalesce(tenant_id, '') as scope, list_sort({_rich('content', 'context', 'outcome')}) as ts, min(engram_id) as cls, count(*) as n from engrams where not coalesce(is_core,false) group by 1, 2),
 p as (select a.scope, a.cls as a, b.cls as b, round(len(list_intersect(a.ts, b.ts)) / (len(a.ts) + len(b.ts) - len(list_intersect(a.ts, b.ts)))::double, 9) as j from c a join c b on a.scope = b.scope and a.cls < b.cls)
select scope, a, b, {MICRO.format('j')} as jaccard from p where j > 0.85""")
def compact_near_dups(s, d):
    return graph.merge_pairs(_engrams(s, d)).select("scope", "a", "b", micro(F.col("jaccard")).alias("jaccard"))


@q("select engram_id, floor((round(salience::double, 6) - 0.05) * 1000000 + 0.5)::bigint as weight from engrams where salience is not null and round(salience::double, 6) - 0.05 > 0.01 + 1e-9")
def salience_decay(s, d):
    return lifecycle.salience_decay(_engrams(s, d), 5).select("engram_id", micro(F.col("weight")).alias("weight"))


# -- metadata queries -------------------------------------------------------------------
KIND = "case when struct_extract(provenance,'kind') is null then null else case lower(trim(struct_extract(provenance,'kind'))) " + " ".join(f"when '{k}' then '{v}'" for k, v in S.KIND_NAMES.items()) + " else 'LedgerVerified' end end"
NOTED = f"not {VER} and coalesce({FACT}, false)"
SUMMARY = f"select engram_id, content, context, agent_id, tenant_id, coalesce(encoded_at_tick,0) as tick, salience, coalesce(is_core,false) as is_core, {VER} as verified, {KIND} as kind, struct_extract(provenance,'source_uri') as source_uri, case when {NOTED} then 'unverified factual claim — check ledger/tools' end as note, struct_extract(rag,'doc_id') as doc_id"


def _summary(df):
    return df.withColumn("doc_id", F.col("rag.doc_id")).drop("rag")


@q(f"{SUMMARY}, (select count(*) from engrams) as total from engrams order by tick, engram_id limit 50 offset 100")
def list_engrams_page(s, d):
    return _summary(query.page(_engrams(s, d), 2))


@q(f"{SUMMARY}, (select count(*) from engrams where {VER}) as total from engrams where {VER} order by tick, engram_id limit 200 offset 0")
def list_verified(s, d):
    return _summary(query.page(_engrams(s, d).filter(query.verified()), 0, 200))


@q(f"{SUMMARY}, (select count(*) from engrams where {NOTED}) as total from engrams where {NOTED} order by tick, engram_id limit 20 offset 20")
def list_unverified(s, d):
    return _summary(query.page(query.unverified(_engrams(s, d)), 1, 20))


@q(f"{SUMMARY} from engrams where {NOTED}")
def trust_notes(s, d):
    return _summary(query.summary(_engrams(s, d)).filter("note is not null"))


@q(f"select tenant_id, engram_id, 'unverified: ' || substr(content,1,100) as text, (row_number() over (partition by tenant_id order by coalesce(encoded_at_tick,0), engram_id))::int as rank from engrams where not {VER} and (contains(lower(content),'$') or contains(lower(content),'balance')) qualify rank <= 5")
def unverified_warnings(s, d):
    return query.warnings(_engrams(s, d))


CONTEXT_SQL = f"select tenant_id, engram_id, c as confidence, kind, content, (row_number() over (partition by tenant_id order by c desc, engram_id))::int as rank from (select tenant_id, engram_id, {KIND} as kind, content, case when round(struct_extract(provenance,'confidence')::double,6) between 0 and 1 then round(struct_extract(provenance,'confidence')::double,6) else 0.0 end as c from engrams where {VER}) qualify rank <= 5"


@q(CONTEXT_SQL)
def verified_context(s, d):
    return query.verified_context(_engrams(s, d))


@q(f"with c as ({CONTEXT_SQL}) select tenant_id, '## Verified ground truth' || chr(10) || string_agg('- [verified ' || floor(confidence * 100 + 0.5)::bigint::varchar || '%] ' || content, chr(10) order by rank) as block from c group by 1")
def prompt_block(s, d):
    return query.prompt_block(query.verified_context(_engrams(s, d)))


@q(f"{SUMMARY} from engrams where engram_id = (select min(engram_id) from engrams)")
def get_engram(s, d):
    e = _engrams(s, d)
    return _summary(query.summary(e.join(e.agg(F.min("engram_id").alias("engram_id")), "engram_id", "left_semi")))


@q(f"with r as (select * from engrams where struct_extract(rag,'doc_id') = (select min(struct_extract(rag,'doc_id')) from engrams)) {SUMMARY}, (select count(*) from r) as total from r order by tick, engram_id limit 50")
def search_by_rag(s, d):
    e = _engrams(s, d)
    doc = e.agg(F.min("rag.doc_id")).first()[0]
    return _summary(query.page(query.lookup(e, doc), 0))


@q("select engram_id from engrams where coalesce(encoded_at_tick,0) >= 1000 or coalesce(is_core,false)")
def forget_before(s, d):
    return query.forget_before(_engrams(s, d), 1000).select("engram_id")


@q(f"select tenant_id, count(*) as engrams, sum(case when {VER} then 1 else 0 end)::bigint as verified, sum(case when coalesce(is_core,false) then 1 else 0 end)::bigint as core, count(struct_extract(rag,'doc_id')) as with_reference, count(distinct life_id) as lives, max(encoded_at_tick) as last_tick, sum(coalesce(replay_count,0))::bigint as replays from engrams group by 1")
def stats(s, d):
    return query.stats(_engrams(s, d))


CLAIMS = "(select o_orderkey as key, 'the wallet balance is $' || printf('%.2f', abs(o_totalprice)) || ' and not $ ' || (o_orderkey % 1000)::varchar || '.5' as content, o_custkey from orders)"


def _claim_rows(s, d):
    """Texts that state amounts: order totals written as chat claims about the customer's balance."""
    o = table(s, d, "orders")
    return o.select(F.col("o_orderkey").alias("engram_id"), F.concat(F.lit("the wallet balance is $"), F.format_string("%.2f", F.abs("o_totalprice")), F.lit(" and not $ "), (F.col("o_orderkey") % 1000).cast("string"), F.lit(".5")).alias("content"), "o_custkey")


AMOUNTS = "unnest(list_transform(regexp_extract_all(content, '\\$\\s*(\\d+(?:\\.\\d{1,2})?)', 1), lambda x: x::double)) as amount"


@q(f"select key, floor(amount * 100 + 0.5)::bigint as cents, abs(amount - c_acctbal) > 0.01 as conflict from (select key, o_custkey, {AMOUNTS} from {CLAIMS}) join customer on c_custkey = o_custkey")
def claim_reconcile(s, d):
    truth = table(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_acctbal").alias("value"))
    rows = _claim_rows(s, d)
    claimed = query.claims(rows).join(rows.select("engram_id", "o_custkey"), "engram_id").withColumnRenamed("o_custkey", "key")
    r = query.reconcile(claimed.select("key", "engram_id", "amount"), truth.withColumnRenamed("o_custkey", "key"))
    return r.select(F.col("engram_id").alias("key"), F.floor(F.col("amount") * 100 + 0.5).cast("long").alias("cents"), "conflict")


@q(f"select key as engram_id, floor(amount * 100 + 0.5)::bigint as cents from (select key, {AMOUNTS} from {CLAIMS})")
def dollar_amounts(s, d):
    return query.claims(_claim_rows(s, d)).select("engram_id", F.floor(F.col("amount") * 100 + 0.5).cast("long").alias("cents"))


@q("select episode_id, case when length(content) > 8192 then 'too long' else 'secret' end as reason from episodes where length(content) > 8192 or regexp_matches(content, 'ghp_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,}|sk-[A-Za-z0-9]{20,}|AKIA[0-9A-Z]{16}|-----BEGIN (?:RSA |EC )?PRIVATE KEY-----')")
def secret_filter(s, d):
    return query.refused(table(s, d, "episodes"))


@q("select tenant_id, (('0x' || substr(md5(tenant_id),1,7))::bigint % 8) as shard, count(*) as rows from episodes where tenant_id is not null group by 1, 2")
def shard_route(s, d):
    e = table(s, d, "episodes").filter("tenant_id is not null")
    return e.groupBy("tenant_id", query.shard(F.col("tenant_id"), 8).alias("shard")).agg(F.count(F.lit(1)).alias("rows"))


@q("select tenant_id, feed, count(*) as rows, count(distinct agent_id) as agents from episodes group by rollup(tenant_id, feed)")
def tenant_metrics(s, d):
    return table(s, d, "episodes").rollup("tenant_id", "feed").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("agent_id").alias("agents"))


@q("select tenant_id, count(*) as rows, count(*) > 50 as over from engrams group by 1")
def quota_check(s, d):
    return lifecycle.quota(_engrams(s, d), 50)


def _has(c: str, *words: str) -> str:
    return "(" + " or ".join(f"contains(lower(coalesce({c},'')), '{w}')" for w in words) + ")"


REGION = (
    f"case when coalesce(is_core,false) then 'corpus-callosum' when coalesce(salience,0) >= 0.85 or {_has('content', 'error', 'death')} then 'temporal-l' when {_has('context', 'command', 'prefrontal')} then 'prefrontal-l'"
    f" when {_has('context', 'model')} or {_has('content', 'conversation')} then 'frontal-r' when {_has('context', 'wallet')} or {_has('content', 'reward', 'fine')} then 'parietal-r' when {_has('content', 'sleep', 'consolid')} then 'occipital-l'"
    " when coalesce(separation_index,0) > 0.7 then 'parietal-l' else 'temporal-r' end"
)
DOMAIN = f"case when coalesce(is_core,false) then 'core' when coalesce(salience,0) >= 0.75 then 'active' when {_has('content', 'error')} then 'pending' else 'client' end"


@q(f"select *, case domain when 'core' then '#c8a0ff' when 'active' then '#70c1b3' when 'client' then '#5b9bd5' else '#ffd166' end as color from (select engram_id, {REGION} as region, {DOMAIN} as domain, case when length(trim(content)) > 40 then substr(trim(content),1,40) || '…' else trim(content) end as label from engrams)")
def graph_nodes(s, d):
    return query.nodes(_engrams(s, d))


@q(f"""
with {_features('engrams', "coalesce(life_id, '')")}, n as (select engram_id, unnest(dg) as node from f), t as (select n.*, coalesce(encoded_at_tick,0) as tick from n join engrams using (engram_id)),
 l as (select node, arg_max(engram_id, (tick, engram_id)) as owner from t group by 1), c as (select t.engram_id, owner, count(*) as shared from t join l using (node) where t.engram_id <> owner group by 1, 2),
 u as (select least(engram_id, owner) as a, greatest(engram_id, owner) as b, arg_min(shared, engram_id) as shared from c group by 1, 2)
select a, b, shared, {MICRO.format('least(0.9::double, 0.15::double * shared)')} as weight from u""")
def graph_links_associate(s, d):
    return graph.associations(_engrams(s, d)).select("a", "b", "shared", micro(F.col("weight")).alias("weight"))


@q("""
with h as (select distinct handoff_id, agent, regexp_replace(replace(coalesce(subdir,''), '\\', '/'), '^/+|/+$', '', 'g') as subdir, case when lower(trim(coalesce(status,''))) = '' then 'open' else lower(trim(status)) end as status,
 strftime(try_strptime(replace(regexp_extract(trim(coalesce(created_at,'')), '^(\\d{4}-\\d{2}-\\d{2})[T ](\\d{2}:\\d{2}:\\d{2})', 0), 'T', ' '), '%Y-%m-%d %H:%M:%S'), '%Y-%m-%d %H:%M:%S') as created, coalesce(len(next_steps),0)::int as steps from handoffs)
select *, (row_number() over (partition by agent, subdir order by created desc nulls last, handoff_id))::int as rank from h qualify rank <= 3""")
def handoff_latest(s, d):
    return query.latest_handoffs(table(s, d, "handoffs"))


@q(f"""
with mc as (select episode_id::varchar as cue_id, content as cue, agent_id from episodes where batch_no > 6 and episode_id % 50 = 0),
 st as (select 'project' as side, engram_id, content from engrams union all select 'agent', episode_id::varchar, content from episodes where batch_no <= 6),
 cw as (select cue_id, w as word, count(*) as times from (select cue_id, unnest(list_filter({_w('cue')}, lambda x: strlen(x) > 2)) as w from mc) group by 1, 2),
 pw as (select side, engram_id, unnest(list_distinct(list_filter({_w('content')}, lambda x: strlen(x) > 2))) as word from st),
 h as (select side, cue_id, engram_id, sum(times)::bigint as hits from pw join cw using (word) group by 1, 2, 3 qualify row_number() over (partition by side, cue_id order by hits desc, engram_id) <= 8)
select cue_id, side, engram_id as id, hits, (row_number() over (partition by cue_id order by hits desc, side, engram_id))::int as rank from h qualify rank <= 12""")
def hub_spoke_merge(s, d):
    cues = _vector_cues(s, d)
    hub = recall.lexical_seeds(_engrams(s, d), cues, 8).select("cue_id", F.lit("project").alias("side"), F.col("engram_id").alias("id"), "hits")
    spoke = recall.lexical_seeds(_stored(s, d), cues, 8).select("cue_id", F.lit("agent").alias("side"), F.col("engram_id").alias("id"), "hits")
    return recall.top(hub.unionByName(spoke), "cue_id", [F.desc("hits"), F.col("side"), F.col("id")], 12)


LEDGER = f"""
 lr as (select tenant_id, arg_max(engram_id, (named::int, case when named then 0.0::double else s end, engram_id)) as truth from (
   select tenant_id, engram_id, round(coalesce(case when isnan(salience) then 0 else salience end::double, 0), 6) as s,
    coalesce(struct_extract(rag,'doc_id') = 'ledger' and struct_extract(rag,'chunk_id') = 'wallet-balance', false) as named,
    {VER} and (coalesce(starts_with(context,'ledger:'),false) or lower(trim(coalesce(struct_extract(provenance,'kind'),''))) = 'ledger_verified') and regexp_matches(lower(coalesce(content,'')), 'wallet|balance|ledger') as ok
   from ({{0}})) where named or ok group by 1)"""
MONEY_CUES = f"""
 mc as (select engram_id as cue_id, content as cue, tenant_id from engrams where engram_id in (select min(engram_id) from engrams group by tenant_id)),
 mr as (select mc.cue_id, e.engram_id, e.verified, e.a as activation from mc, lateral (select engram_id, {VER} as verified, round(coalesce(salience::double, 0), 6) as a from engrams x where x.tenant_id is not distinct from mc.tenant_id order by a desc, engram_id limit 8) e)"""


@q(f"""
with {MONEY_CUES}, {LEDGER.format('select * from engrams')},
 t as (select cue_id, truth from mc join lr on lr.tenant_id = mc.tenant_id where regexp_matches(lower(cue), 'balance|wallet|ledger|[$]|money|credit')),
 j as (select coalesce(mr.cue_id, t.cue_id) as cue_id, coalesce(mr.engram_id, t.truth) as engram_id, coalesce(verified, false) or truth is not null as verified, case when truth is null then activation when activation is null then 10.0::double else greatest(activation, 5.0::double) + 5 end as activation
   from mr full join t on mr.cue_id = t.cue_id and mr.engram_id = t.truth)
select cue_id, engram_id, verified, {MICRO.format('activation')} as activation, (row_number() over (partition by cue_id order by round(activation, 9) desc, engram_id))::int as rank from j qualify rank <= 8""")
def ledger_preference(s, d):
    # a cue per tenant, its recalled rows those of the greatest salience
    e = _engrams(s, d)
    first = e.groupBy("tenant_id").agg(F.min("engram_id").alias("engram_id"))
    cues = e.join(first.select("engram_id"), "engram_id", "left_semi").select(F.col("engram_id").alias("cue_id"), F.col("content").alias("cue"), "tenant_id")
    rows = e.select("tenant_id", "engram_id", query.verified().alias("verified"), F.round(F.coalesce(F.col("salience").cast("double"), F.lit(0.0)), 6).alias("activation"))
    best = recall.top(rows, "tenant_id", [F.desc("activation"), F.col("engram_id")], 8).drop("rank")
    recalled = best.join(cues.select("cue_id", F.col("tenant_id").alias("_t")), best["tenant_id"].eqNullSafe(F.col("_t"))).select("cue_id", "engram_id", "verified", "activation")
    return _recalled(recall.prefer_ledger(recalled, cues, e))


# -- event folds and streams ----------------------------------------------------------------
FOLD_KEY = "event_type"


@q("""
with recursive e as (select event_type, event_id, user_id, row_number() over (partition by event_type order by ts, event_id) as tick, value from events),
 w as (select event_type, 0::bigint as tick, 0::bigint as event_id, 0.5::double as da, 0.7::double as ach, 0.3::double as ne, 0.5::double as da0, 0.7::double as ach0, 0.3::double as ne0 from e group by 1
  union all
  select event_type, tick, event_id, case when sleep then da1 * 0.85 else da1 end, case when sleep then least(1.0, ach1 + 0.05) else ach1 end, case when sleep then ne1 * 0.7 else ne1 end, da0, ach0, ne0 from (
   select w.event_type, e.tick, e.event_id, e.tick % 50 = 0 as sleep, w.da as da0, w.ach as ach0, w.ne as ne0,
    case when e.user_id % 3 = 0 then greatest(0.0, least(1.0, w.da + 0.2)) else w.da end as da1,
    case when e.user_id % 3 = 1 then greatest(0.0, least(1.0, w.ach + 0.1 * 0.8)) else w.ach end as ach1,
    case when e.user_id % 3 = 1 then greatest(0.0, least(1.0, w.ne + 0.25 * 0.8)) else w.ne end as ne1
   from w join e on e.event_type = w.event_type and e.tick = w.tick + 1))
select event_id, floor(da0 * 1000000 + 0.5)::bigint as dopamine, floor(ach0 * 1000000 + 0.5)::bigint as acetylcholine, floor(ne0 * 1000000 + 0.5)::bigint as norepinephrine from w where tick > 0""")
def modulator_trace(s, d):
    e = lifecycle.ticks(table(s, d, "events"), FOLD_KEY)
    e = e.withColumn("reward", F.when(F.col("user_id") % 3 == 0, 1.0)).withColumn("surprise", F.when(F.col("user_id") % 3 == 1, 0.8)).withColumn("sleeps", F.col("tick") % 50 == 0)
    return lifecycle.modulators(e, FOLD_KEY).select("event_id", *[micro(F.col(c)).alias(c) for c in ("dopamine", "acetylcholine", "norepinephrine")])


NEXT_STAGE = "struct_extract([" + ", ".join(f"{{{{'x': {r[5]}, 's': {r[6]}, 't': {r[7]}, 'p': {r[8]}}}}}" for r in S.STAGES) + "][w.stage + 2], '{0}')"
AUTOMATON = f"""
 e as (select event_type, user_id % 4 as kind, row_number() over (partition by event_type order by ts, event_id) as tick from events),
 w as (select event_type, 0::bigint as tick, 0 as stage, 0::bigint as x, 0::bigint as sl, 0::bigint as pr from e group by 1
  union all
  select event_type, tick, case when stage < 6 and x >= nx and sl >= ns and tick >= nt and pr >= np then stage + 1 else stage end, x, sl, pr from (
   select w.event_type, e.tick, w.stage, w.x + (e.kind <> 3)::int as x, w.sl + (e.tick % 40 = 0)::int as sl, w.pr + (e.tick % 40 = 0)::int * 5 as pr,
    {NEXT_STAGE.format('x')} as nx, {NEXT_STAGE.format('s')} as ns, {NEXT_STAGE.format('t')} as nt, {NEXT_STAGE.format('p')} as np
   from w join e on e.event_type = w.event_type and e.tick = w.tick + 1))"""


def _automaton(s, d):
    e = lifecycle.ticks(table(s, d, "events"), FOLD_KEY)
    return lifecycle.stage_timeline(e.select(FOLD_KEY, "tick", (F.col("user_id") % 4 != 3).alias("experience"), (F.col("tick") % 40 == 0).alias("sleeps"), F.when(F.col("tick") % 40 == 0, 5).otherwise(0).alias("pruned")), FOLD_KEY)


@q(f"with recursive {AUTOMATON} select event_type, stage, min(tick) as reached_tick from w where stage > 0 group by 1, 2")
def stage_timeline(s, d):
    return _automaton(s, d).filter("stage > 0").groupBy(FOLD_KEY, "stage").agg(F.min("tick").alias("reached_tick"))


PROGRESS = f"with recursive {AUTOMATON}, z as (select * from w qualify row_number() over (partition by event_type order by tick desc) = 1)"


@q(f"""{PROGRESS} select event_type, w.stage, x as experiences, sl as sleeps, tick as ticks, case when w.stage = 6 then 1000000 else floor((least(1.0::double, x / greatest(1, {NEXT_STAGE.format('x')})::double) + least(1.0::double, sl / greatest(1, {NEXT_STAGE.format('s')})::double) + least(1.0::double, tick / greatest(1, {NEXT_STAGE.format('t')})::double)) / 3 * 1000000 + 0.5)::bigint end as progress from z w""")
def stage_progress(s, d):
    r = lifecycle.stage_report(_automaton(s, d), FOLD_KEY)
    return r.select(FOLD_KEY, "stage", "experiences", "sleeps", F.col("tick").alias("ticks"), micro(F.col("progress")).alias("progress"))


@q("""
with recursive e as (select event_type, row_number() over (partition by event_type order by ts, event_id) as tick from events),
 w as (select event_type, 0::bigint as tick, 0::bigint as since, 0::bigint as started, 0 as taken, false as slept from e group by 1
  union all
  select event_type, tick, case when due and taken1 < 6 then 0 else since1 end, started1, case when due and taken1 < 6 then taken1 + 1 else taken1 end, due and taken1 < 6 from (
   select *, since1 >= 36 as due, case when tick - started >= 360 then tick else started end as started1, case when tick - started >= 360 then 0 else taken end as taken1 from (
    select w.event_type, e.tick, w.since + 1 as since1, w.started, w.taken from w join e on e.event_type = w.event_type and e.tick = w.tick + 1)))
select event_type, tick from w where slept""")
def sleep_windows(s, d):
    e = lifecycle.ticks(table(s, d, "events"), FOLD_KEY)
    return lifecycle.auto_sleeps(e, FOLD_KEY, S.SLEEP_INTERVAL // 10, S.SLEEP_WINDOW // 10).filter("slept").select(FOLD_KEY, "tick")


@q("select event_id, user_id, event_type from events")
def stream_ingest_dedup(s, d):
    return streams.drain(streams.deduplicated(streams.read_events(s, d)).select("event_id", "user_id", "event_type"), "append")


@q("""
with recursive o as (select coalesce(tenant_id, '') as scope, engram_id as id, list_distinct(list_filter(regexp_split_to_array(lower(coalesce(content,'')), '\\s+'), lambda x: x <> '')) as ws, coalesce(struct_extract(provenance,'verified'), false) as free,
  row_number() over (partition by coalesce(tenant_id, '') order by coalesce(encoded_at_tick, 0), engram_id) as ord from engrams),
 near as (select scope, ord, list(-po) as ps from (select a.scope, a.ord, b.ord as po, len(list_intersect(a.ws, b.ws)) as i, len(a.ws) + len(b.ws) as n from o a join o b on a.scope = b.scope and b.ord < a.ord where len(a.ws) > 0 and len(b.ws) > 0) where round(i / (n - i)::double, 9) >= 0.85 group by 1, 2),
 w as (select scope, 0::bigint as ord, []::bigint[] as acc, null::varchar as id, true as ok from o group by 1
  union all
  select scope, ord, case when ok then list_append(acc, ord) else acc end, id, ok from (
   select w.scope, o.ord, w.acc, o.id, o.free or coalesce(len(list_filter(near.ps, lambda x: coalesce(list_position(w.acc, -x), 0) > greatest(0, len(w.acc) - 512))), 0) = 0 as ok
   from w join o on o.scope = w.scope and o.ord = w.ord + 1 left join near on near.scope = o.scope and near.ord = o.ord))
select id as engram_id, ok as accepted from w where id is not null""")
def stream_gate(s, d):
    schema = table(s, d, "engrams").schema
    raw = s.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{d}/engrams.parquet")
    r = raw.select(F.coalesce("tenant_id", F.lit("")).alias("scope"), "engram_id", "content", F.coalesce("provenance.verified", F.lit(False)).alias("free"), F.coalesce("encoded_at_tick", F.lit(0)).alias("place"))
    return streams.drain(streams.gated(r), "append").select("engram_id", "accepted")


@q("select strftime(time_bucket(interval 1 day, ts), '%Y-%m-%d') as day, event_type, count(*) as n from events group by 1, 2")
def stream_tick_windows(s, d):
    t = streams.drain(streams.tick_windows(streams.read_events(s, d)), "complete")
    return t.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@q("""
with g as (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 30 minutes then 0 else 1 end as fresh from events),
 n as (select *, sum(fresh) over (partition by user_id order by ts, event_id) as session from g)
select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as start, count(*) as n from n group by user_id, session""")
def stream_session_activity(s, d):
    # complete mode: the sessions still open at the end count as well
    t = streams.drain(streams.sessions(streams.read_events(s, d)), "complete")
    return t.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@q()
def preplay_path(s, d):
    from memloom.operators.preplay import preplay

    edges = materialize(graph.merge_max(graph.wiring(_stored(s, d), life="life")), "edges")
    return preplay(edges, _vector_cues(s, d), _stored(s, d))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from memloom.plans import catalog_more  # noqa: F401  (registers its queries)

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from memloom.plans import catalog_more  # noqa: F401

    return dict(SQL)
