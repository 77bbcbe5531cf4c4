"""More queries of the core: features, vectors, sources, handoffs, graph exports, counters, metrics; registered with those of ``catalog``."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from memloom.functions import features as X
from memloom.functions import stages as S
from memloom.functions.text import micro
from memloom.operators import graph, lifecycle, query, recall
from memloom.operators.counts import shared_counts
from memloom.plans.catalog import COS, DOMAIN, EDGE_SQL, FACT, LEX, MICRO, REGION, STORED, USABLE, VER, _cues, _dg, _engrams, _features, _rich, _stored, _vector_cues, clip_sql, q
from memloom.sources import fovea
from memloom.sources.tables import materialize, table

F_ENGRAMS = _features("engrams", "coalesce(life_id, '')")


# -- features ------------------------------------------------------------------------
@q(f"with {F_ENGRAMS} select engram_id, unnest(dg) as node from f")
def feature_granules(s, d):
    return graph.features(_engrams(s, d)).select("engram_id", F.explode("dg").alias("node"))


@q(f"with {F_ENGRAMS} select engram_id, unnest(list_filter(ca3, lambda x: not list_contains(dg, x))) as node from f")
def feature_binding(s, d):
    return graph.features(_engrams(s, d)).select("engram_id", F.explode(F.array_except("ca3", "dg")).alias("node"))


@q(f"with {STORED}, {_features('er', chr(39) + 'life' + chr(39))}, c as (select cue_id, {_dg(_rich('cue', chr(39) * 2, chr(39) * 2), chr(39) + 'life' + chr(39))} as cf from ec) select cue_id, engram_id, {MICRO.format('greatest(len(list_intersect(cf, dg)), len(list_intersect(cf, ca3))) / len(cf)::double')} as overlap from cand join f using (engram_id) join c using (cue_id)")
def feature_overlap(s, d):
    pairs = materialize(recall.hybrid_candidates(_stored(s, d), _vector_cues(s, d)), "pairs")
    dg = X.granules(recall.rich_tokens(F.col("content"), F.col("context"), F.col("outcome")), F.lit("life"))
    # bound features hold the granules, so the larger share is theirs; the lambda makes the granules once
    ca3 = F.get(F.transform(F.array(dg), lambda g: X.bound(g)), 0)
    j = shared_counts(_stored(s, d).select("engram_id", "content", "context", "outcome"), ca3, _vector_cues(s, d), X.granules(recall.cue_tokens(F.col("cue")), F.lit("life")), pairs)
    return j.select("cue_id", "engram_id", micro(F.col("matched") / F.greatest("cue_size", F.lit(1))).alias("overlap"))


@q(f"with {F_ENGRAMS}, l as (select engram_id, ca3, lag(engram_id) over (order by engram_id) as before, lag(ca3) over (order by engram_id) as was from f) select engram_id, before, {MICRO.format('len(list_intersect(ca3, was)) / len(list_distinct(list_concat(ca3, was)))::double')} as jaccard, len(list_distinct(list_concat(ca3, was))) as merged from l where before is not null")
def feature_merge(s, d):
    f = graph.features(_engrams(s, d)).select("engram_id", "ca3")
    # every row beside the one before it: an equi-join on places, no window over all rows
    from memloom.operators.order import numbered

    n = numbered(f.withColumn("one", F.lit(1)), "one", ["engram_id"])
    b = n.select((F.col("ord") + 1).alias("ord"), F.col("engram_id").alias("before"), F.col("ca3").alias("was"))
    return n.join(b, "ord").select("engram_id", "before", micro(X.jaccard_merge(F.col("ca3"), F.col("was"))).alias("jaccard"), F.size(F.array_union("ca3", "was")).cast("long").alias("merged"))


@q("""
with b as (select vec_id, embedding, unnest(range(0,16)) as band from embeddings),
 h as (select vec_id, embedding, band, md5(vec_id::varchar || '|' || band::varchar || '|a') || md5(vec_id::varchar || '|' || band::varchar || '|b') as h from b)
select vec_id, band::int as band, floor(list_sum(list_transform(range(1,65), lambda i: case when substr(h, i, 1) < '8' then embedding[i]::double else -embedding[i]::double end)) * 1000 + 0.5)::bigint as milli from h""")
def vector_bands(s, d):
    e = table(s, d, "embeddings").select("vec_id", F.posexplode(X.band_sums(F.col("embedding"), F.col("vec_id").cast("string"))).alias("band", "x"))
    return e.select("vec_id", "band", F.floor(F.col("x") * 1000 + 0.5).cast("long").alias("milli"))


@q(f"""
with t as (select label, vec_id, embedding::double[] as v, greatest(0.01::double, least(0.35::double, 0.2::double * (vec_id % 10))) as a from embeddings qualify row_number() over (partition by label order by vec_id desc) <= 16),
 f as (select label, list_reduce(list({{'v': v, 'a': a}} order by vec_id), lambda x, y: {{'v': list_transform(range(1,65), lambda i: x.v[i] * (1 - y.a) + y.v[i] * y.a), 'a': y.a}}) as r from t group by 1)
select label, unnest(range(0,64))::int as slot, {MICRO.format('unnest(r.v)')} as value from f""")
def vector_blend(s, d):
    w = W.partitionBy("label").orderBy(F.desc("vec_id"))
    newest = table(s, d, "embeddings").withColumn("r", F.row_number().over(w)).filter(F.col("r") <= S.REPLAY_ROWS)
    g = newest.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("vs"))
    b = g.select("label", X.blended(F.transform("vs", lambda x: x["embedding"]), F.transform("vs", lambda x: (x["vec_id"] % 10).cast("double"))).alias("v"))
    return b.select("label", F.posexplode("v").alias("slot", "x")).select("label", "slot", micro(F.col("x")).alias("value"))


@q(f"select a.vec_id, {MICRO.format('list_cosine_similarity(a.embedding[1:40]::double[], b.embedding[1:40]::double[])')} as sim from embeddings a join embeddings b on b.vec_id = a.vec_id + 1")
def vector_cosine_shorter(s, d):
    e = table(s, d, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return e.join(b, "vec_id").select("vec_id", micro(X.cosine_shorter(F.col("embedding"), F.slice("next", 1, 40))).alias("sim"))


@q(f"select episode_id, {MICRO.format('greatest(0.05::double, least(1.0::double, 0.4::double*0.5 + 0.3::double*0.7 + 0.3::double*0.3 + 0.5::double * round(greatest(0.0, least(1.0, case when salience_hint is null or isnan(salience_hint) then 0 else salience_hint end))::double, 6)))')} as gate from episodes")
def plasticity_gate(s, d):
    sal = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.nanvl(F.col("salience_hint"), F.lit(0.0)).cast("double"), F.lit(0.0)))), 6)
    m = S.MODULATORS
    return table(s, d, "episodes").select("episode_id", micro(X.plasticity(F.lit(m["dopamine"]), F.lit(m["acetylcholine"]), F.lit(m["norepinephrine"]), sal)).alias("gate"))


@q("select * from (values " + ", ".join(f"({r[0]}, '{r[1]}', {round(r[2] * 1e6)}::bigint, {round(r[3] * 1e6)}::bigint, {r[4]}::bigint, {r[5]}::bigint, {r[6]}::bigint, {r[7]}::bigint, {r[8]}::bigint, {r[9]}, {r[10]}, {r[11]}, {r[12]}, {r[13]})" for r in S.STAGES) + ") t(stage, name, spread, prune, max_edges, need_rows, need_sleeps, need_ticks, need_pruned, clique, row_chain, feature_chain, band_chain, cross_links)")
def stage_dim(s, d):
    return S.stage_table(s).withColumn("spread", micro(F.col("spread"))).withColumn("prune", micro(F.col("prune"))).withColumnRenamed("cross", "cross_links")


# -- trust, references, addresses ------------------------------------------------------
@q(f"select engram_id, 'recalled utterance — not verified ground truth; check ledger/tools' as note from engrams where not {VER} and ({FACT} or contains(lower(content), 'total'))")
def recall_trust(s, d):
    return _engrams(s, d).select("engram_id", recall.trust_of_recalled(F.col("content"), query.verified()).alias("note")).filter("note is not null")


@q("select episode_id, struct_extract(rag,'source_uri') is not null or struct_extract(rag,'doc_id') is not null or struct_extract(rag,'chunk_id') is not null as has_ref, struct_extract(rag,'doc_id') as doc_id from episodes")
def rag_refs(s, d):
    r = query.rag_ref(F.col("rag.source_uri"), F.col("rag.doc_id"), F.col("rag.chunk_id"))
    return table(s, d, "episodes").select("episode_id", r.alias("ref")).select("episode_id", F.col("ref").isNotNull().alias("has_ref"), "ref.doc_id")


@q(f"""
select episode_id, case when v and k is not null then k when v then 'ledger_verified' when doc is not null then 'file_observation' else 'chat_assertion' end as kind, case when v then 950000 when doc is not null then 600000 else 350000 end::bigint as confidence, v as verified
from (select episode_id, {VER} as v, struct_extract(rag,'doc_id') as doc, case when lower(trim(struct_extract(provenance,'kind'))) in ({', '.join(f"'{k}'" for k in S.KIND_NAMES)}) then lower(trim(struct_extract(provenance,'kind'))) end as k from episodes)""")
def provenance_default(s, d):
    from memloom.engine import provenance

    e = table(s, d, "episodes").select("episode_id", provenance(F.col("provenance.kind"), F.col("provenance.verified"), F.col("rag.doc_id")).alias("p"))
    return e.select("episode_id", "p.kind", micro(F.round(F.col("p.confidence").cast("double"), 6)).alias("confidence"), "p.verified")


@q("select distinct tenant_id, '127.0.0.1:' || (8792 + ('0x' || substr(md5(tenant_id),1,7))::bigint % 8)::varchar as address from episodes where tenant_id is not null")
def shard_address(s, d):
    return table(s, d, "episodes").filter("tenant_id is not null").select("tenant_id", query.shard_address(F.col("tenant_id"), 8).alias("address")).distinct()


@q(f"with {LEX} select cue_id, engram_id, rank::int as rank, substr(content, 1, 200) as content from seeds join engrams using (engram_id) where rank <= 8")
def slim_payload(s, d):
    # what leaves for a client: the first eight rows, texts cut, no vectors
    seeds = recall.lexical_seeds(_engrams(s, d), _cues(s, d), S.TOP_K)
    return seeds.join(_engrams(s, d).select("engram_id", F.substring("content", 1, 200).alias("content")), "engram_id").select("cue_id", "engram_id", "rank", "content")


# -- scans and sources -------------------------------------------------------------------
@q("select engram_id, coalesce(encoded_at_tick,0) as tick from engrams where life_id = (select min(life_id) from engrams)")
def life_scan(s, d):
    e = _engrams(s, d)
    return query.of_life(e, e.agg(F.min("life_id")).first()[0]).select("engram_id", F.coalesce("encoded_at_tick", F.lit(0)).alias("tick"))


@q("select life_id, engram_id, (row_number() over (partition by life_id order by coalesce(encoded_at_tick,0) desc, engram_id desc))::int as back from engrams where life_id is not null qualify back <= 12")
def life_tail(s, d):
    return query.tail(_engrams(s, d).filter("life_id is not null"), "life_id", 12).select("life_id", "engram_id", "back")


@q(f"select tenant_id, list({MICRO.format('sep')} order by back desc) as separations from (select tenant_id, coalesce(round(separation_index::double, 6), 0) as sep, row_number() over (partition by tenant_id order by coalesce(encoded_at_tick,0) desc, engram_id desc) as back from engrams qualify back <= 12) group by 1")
def separations_recent(s, d):
    t = query.tail(_engrams(s, d), "tenant_id", S.SEPARATION_RING)
    x = micro(F.coalesce(F.round(F.col("separation_index").cast("double"), 6), F.lit(0.0)))
    g = t.groupBy("tenant_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("back")).alias("b"), x.alias("x")))).alias("xs"))
    return g.select("tenant_id", F.transform("xs", lambda y: y["x"]).alias("separations"))


@q(f"""
with t as (select doc_id, list_filter(regexp_split_to_array(coalesce(text,''), '\\s+'), lambda x: x <> '') as ts from documents),
p as (select doc_id, ts, unnest(range(0, (case when len(ts) <= 12 then 0 else ceil((len(ts) - 12) / 8.0) end)::int + 1)) as i from t where len(ts) > 0),
w as (select doc_id, i, array_to_string(ts[i*8+1 : i*8+12],' ') as f, array_to_string(ts[greatest(i*8-12,0)+1 : i*8],' ') as b, array_to_string(ts[i*8+13 : i*8+24],' ') as a from p)
select doc_id, '[fix' || i || '] ' || f || ' | …' || {clip_sql('b')} || '… ' || {clip_sql('a')} || ' …' as content, 'fovea:' || doc_id || '.txt' as context, 'fovea-' || i as chunk_id from w""")
def file_ingest(s, d):
    p = fovea.packets(table(s, d, "documents"), "doc_id", "text")
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))
    e = fovea.packet_episodes(p, name, F.concat(F.lit("/docs/"), name))
    return e.select(F.regexp_extract("rag.doc_id", r"(\d+)\.txt$", 1).cast("long").alias("doc_id"), "content", "context", "rag.chunk_id")


@q("select 'rag:' || coalesce(doc, 'document') || '#' || coalesce(chunk, '0') as context, content, coalesce(doc, 'document') as doc_id, coalesce(chunk, '0') as chunk_id from (select struct_extract(rag,'doc_id') as doc, struct_extract(rag,'chunk_id') as chunk, content from episodes)")
def chunk_ingest(s, d):
    c = table(s, d, "episodes").select("rag.doc_id", "rag.chunk_id", "content")
    return fovea.chunk_episodes(c).select("context", "content", "doc_id", "chunk_id")


@q("""
with r as (select case episode_id % 4 when 0 then 'user' when 1 then 'assistant' when 2 then 'think' else 'event' end as kind, content, context, agent_id from episodes)
select substr((case when kind <> 'event' then kind || ':' else '' end) || content, 1, 500) as content, substr(coalesce(context,'feed'),1,120) as context, case when kind = 'user' then 620000 else 580000 end::bigint as salience, agent_id,
 substr(sha256(kind || '|' || content || '|' || coalesce(context,'feed') || '|' || coalesce(agent_id,'')), 1, 16) as chunk_id from r where content <> ''""")
def feed_reingest(s, d):
    kind = F.element_at(F.array(F.lit("user"), F.lit("assistant"), F.lit("think"), F.lit("event")), (F.col("episode_id") % 4 + 1).cast("int"))
    f = fovea.feed_episodes(table(s, d, "episodes").select(kind.alias("kind"), "content", "context", "agent_id"))
    return f.select("content", "context", micro(F.col("salience_hint")).alias("salience"), "agent_id", "chunk_id")


# -- handoffs --------------------------------------------------------------------------------
SUB = "regexp_replace(replace(coalesce(subdir,''), '\\', '/'), '^/+|/+$', '', 'g')"


@q(f"select distinct handoff_id, 'handoff:' || agent || ':' || case when {SUB} = '' then 'root' else replace({SUB}, '/', ':') end as context from handoffs where agent is not null")
def handoff_context(s, d):
    h = table(s, d, "handoffs").filter("agent is not null")
    return h.select("handoff_id", query.context_key(F.col("agent"), query.normal_subdir(F.col("subdir"))).alias("context")).distinct()


@q("select distinct handoff_id, agent, summary, len(next_steps)::int as steps, len(files)::int as files, created_at from handoffs")
def handoff_json(s, d):
    # written as the content of a row and read back
    h = table(s, d, "handoffs").distinct().select("handoff_id", query.handoff_content(table(s, d, "handoffs")).alias("content"))
    return h.select(query.from_content(F.col("content")).alias("h")).select("h.handoff_id", "h.agent", "h.summary", F.size("h.next_steps").alias("steps"), F.size("h.files").alias("files"), "h.created_at").withColumn("steps", F.when(F.col("steps") >= 0, F.col("steps"))).withColumn("files", F.when(F.col("files") >= 0, F.col("files")))


CLEAN = f"""(select distinct handoff_id, agent, {SUB} as subdir, case when lower(trim(coalesce(status,''))) = '' then 'open' else lower(trim(status)) end as status,
 strftime(try_strptime(replace(regexp_extract(trim(coalesce(created_at,'')), '^(\\d{{4}}-\\d{{2}}-\\d{{2}})[T ](\\d{{2}}:\\d{{2}}:\\d{{2}})', 0), 'T', ' '), '%Y-%m-%d %H:%M:%S'), '%Y-%m-%d %H:%M:%S') as created, coalesce(len(next_steps),0)::int as steps from handoffs)"""


@q(f"select * from {CLEAN} where status = 'done' and coalesce(created,'') >= '2020' order by created desc nulls last, handoff_id limit 20")
def handoff_list(s, d):
    return query.list_handoffs(table(s, d, "handoffs"), status="DONE", since="2020")


# -- graph exports -----------------------------------------------------------------------------
@q(f"select engram_id as source, 'region:' || ({REGION}) as target, 500000::bigint as weight, 'member' as kind from engrams union all select 'core:' || engram_id, engram_id, 1000000, 'core' from engrams where is_core")
def graph_links(s, d):
    return query.links(_engrams(s, d)).withColumn("weight", micro(F.col("weight")))


@q(f"with {EDGE_SQL}, o as (select f.engram_id, unnest(dg) as node from f) select node, arg_min({DOMAIN}, (coalesce(encoded_at_tick,0), engram_id)) as domain, count(*) as owners from o join engrams using (engram_id) group by 1")
def node_registry(s, d):
    # the first row that owns a feature names its domain
    n = graph.node_owners(_engrams(s, d), domain=query.domain())
    return n.groupBy("node").agg(F.min_by("domain", F.struct("tick", "engram_id")).alias("domain"), F.count(F.lit(1)).alias("owners"))


@q("select engram_id, content from engrams where is_core and not exists (select 1 from engram_vec v where v.engram_id = engrams.engram_id)")
def core_not_materialised(s, d):
    core = _engrams(s, d).filter("is_core").select("engram_id", "content")
    return core.join(table(s, d, "engram_vec").select("engram_id"), "engram_id", "left_anti")


@q(f"with {EDGE_SQL}, e as (select src, dst, max(weight) from raw group by 1, 2) select (select count(*) from engrams) as engrams, (select count(*) from engrams where is_core) as core, (select count(*) from e) as edges, (select count(distinct life_id) from engrams) as lives, (select count(*) from engram_vec) as vectors, (select count(*) from cortex where len(semantic_centroid) > 0) as centroids, (select max(encoded_at_tick) from engrams) as last_tick, {MICRO.format('least(1.0::double, (select count(*) from e) / 200000::double)')} as pressure")
def status(s, d):
    e = _engrams(s, d)
    edges = graph.merge_max(graph.wiring(e))
    r = query.status(e, edges, table(s, d, "engram_vec"), table(s, d, "cortex").filter(F.size("semantic_centroid") > 0), 2)
    return r.withColumn("pressure", micro(F.col("pressure")))


# -- boosts and tags -----------------------------------------------------------------------------
@q(f"""
with c as (select semantic_centroid::double[] as v, greatest(0, coalesce(semantic_strength, 0)) as st from cortex where {USABLE.format('semantic_centroid')}),
 e as (select episode_id, semantic_vector::double[] as v from episodes where episode_id % 50 = 0 and {USABLE.format('semantic_vector')} and len(list_filter(semantic_vector, lambda y: y <> 0)) > 0)
select episode_id, {MICRO.format("least(1.0::double, greatest(0.0::double, max(" + COS.format('e.v', 'c.v') + " * sqrt(st))))")} as boost, {MICRO.format("max(" + COS.format('e.v', 'c.v') + " * least(3.0::double, sqrt(st)) * 0.15::double)")} as semantic from e, c group by 1""")
def cue_boosts(s, d):
    e = table(s, d, "episodes").filter("episode_id % 50 = 0").select(F.col("episode_id").alias("cue_id"), F.col("semantic_vector").alias("vector"))
    b = graph.vector_boosts(e, table(s, d, "cortex").select("life_id", F.col("semantic_centroid").alias("vector"), F.col("semantic_strength").alias("strength")))
    return b.select(F.col("cue_id").alias("episode_id"), micro(F.col("centroid")).alias("boost"), micro(F.col("semantic")).alias("semantic"))


@q(f"select agent_id, {MICRO.format('least(1.0::double, sum(w))')} as weight from (select agent_id, round(salience::double, 6) - 0.05::double as w from engrams where salience is not null) where w > 0.01 + 1e-9 group by 1")
def tag_weights(s, d):
    t = _engrams(s, d).filter("salience is not null").select("agent_id", F.col("salience").alias("weight"))
    return lifecycle.tag_weights(t, "agent_id", 5).select("agent_id", micro(F.col("weight")).alias("weight"))


# -- metrics -----------------------------------------------------------------------------------
@q(f"""
with h as (select a.vec_id as query_id, a.label, a.label = b.label as rel, row_number() over (partition by a.vec_id order by round({COS.format('a.embedding', 'b.embedding')}, 9) desc, b.vec_id) as rank
 from embeddings a, embeddings b where a.vec_id % 50 = 0 and a.vec_id <> b.vec_id and {COS.format('a.embedding', 'b.embedding')} > 0.05 qualify rank <= 8),
 r as (select query_id, any_value(label) as label, bool_or(rel and rank = 1) as one, bool_or(rel) as any_hit from h group by 1), l as (select label, avg(one::int) as recall_1, avg(any_hit::int) as recall_8 from r group by 1)
select {MICRO.format('avg(recall_1)')} as macro_recall_1, {MICRO.format('avg(recall_8)')} as macro_recall_8, count(*) as labels from l""")
def retrieval_metrics(s, d):
    e = table(s, d, "embeddings")
    t = recall.vector_topk(e, e.filter("vec_id % 50 = 0"), 8).join(e.select(F.col("vec_id").alias("query_id"), F.col("label").alias("own")), "query_id")
    r = t.groupBy("query_id", "own").agg(F.max(((F.col("label") == F.col("own")) & (F.col("rank") == 1)).cast("int")).alias("one"), F.max((F.col("label") == F.col("own")).cast("int")).alias("hit"))
    m = r.groupBy("own").agg(F.avg("one").alias("one"), F.avg("hit").alias("hit"))
    return m.agg(micro(F.avg("one")).alias("macro_recall_1"), micro(F.avg("hit")).alias("macro_recall_8"), F.count(F.lit(1)).alias("labels"))


@q(f"""
with w as (select item_id, {_rich('text', chr(39) * 2, chr(39) * 2)} as ts from eval_items where text is not null), c as (select item_id, len(ts) as n, unnest(ts) as token from w),
 t as (select doc_id, unnest({_rich('text', chr(39) * 2, chr(39) * 2)}) as token from documents where text is not null),
 m as (select item_id, doc_id, count(*) / any_value(n)::double as share from c join t using (token) group by 1, 2)
select item_id, {MICRO.format('max(share)')} as evidence from m group by 1""")
def evidence_recall(s, d):
    # how much of a held-out item the best document covers
    rows = table(s, d, "documents").filter("text is not null").select(F.col("doc_id").cast("string").alias("engram_id"), F.col("text").alias("content"), F.lit("").alias("context"), F.lit(None).cast("string").alias("outcome"), F.lit(0).alias("encoded_at_tick"))
    cues = table(s, d, "eval_items").filter("text is not null").select(F.col("item_id").cast("string").alias("cue_id"), F.col("text").alias("cue"))
    return recall.complete(rows, cues, 0.0).select(F.col("cue_id").cast("long").alias("item_id"), micro(F.col("overlap")).alias("evidence"))


@q(f"with {LEX}, u as (select cue_id, engram_id, rank from seeds) select cue_id, engram_id from u where rank <= 128")
def candidate_cap(s, d):
    return recall.top(recall.lexical_seeds(_engrams(s, d), _cues(s, d)).drop("rank"), "cue_id", [F.desc("hits"), F.col("engram_id")], S.CANDIDATES).select("cue_id", "engram_id")
