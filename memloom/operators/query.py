"""Metadata queries over stored rows: paging, trust, lookups, status, exports, handoffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from memloom.functions import stages as S
from memloom.functions.text import dollar_amounts, has_secret, is_factual


def verified() -> Column:
    return F.coalesce(F.col("provenance.verified"), F.lit(False))


def kind_name(kind: Column) -> Column:
    """Display name of a provenance kind; unknown ones count as ledger_verified, a missing one stays missing."""
    k, out = F.lower(F.trim(kind)), F.lit(S.KIND_NAMES["ledger_verified"])
    for raw, name in S.KIND_NAMES.items():
        out = F.when(k == raw, name).otherwise(out)
    return F.when(kind.isNotNull(), out)


def summary(rows: DataFrame) -> DataFrame:
    """The thirteen public columns of a row, with a note where an unverified row states facts."""
    note = F.when(~verified() & F.coalesce(is_factual(F.col("content")), F.lit(False)), "unverified factual claim — check ledger/tools")
    return rows.select(
        "engram_id", "content", "context", "agent_id", "tenant_id", F.coalesce("encoded_at_tick", F.lit(0)).alias("tick"), "salience", F.coalesce("is_core", F.lit(False)).alias("is_core"), verified().alias("verified"),
        kind_name(F.col("provenance.kind")).alias("kind"), F.col("provenance.source_uri").alias("source_uri"), note.alias("note"), "rag",
    )


def page(rows: DataFrame, number: int, size: int = S.PAGE) -> DataFrame:
    """Page ``number`` of the rows by tick and id, with the total: the offset uses the size asked for, the page holds at most MAX_PAGE."""
    take = max(1, min(size, S.MAX_PAGE))
    s = summary(rows).orderBy("tick", "engram_id").offset(number * size).limit(take)
    # one row of a count
    return s.crossJoin(F.broadcast(rows.agg(F.count(F.lit(1)).alias("total"))))


def unverified(rows: DataFrame) -> DataFrame:
    """Rows that state facts without being verified."""
    return rows.filter(~verified() & F.coalesce(is_factual(F.col("content")), F.lit(False)))


def rag_ref(uri: Column, doc: Column, chunk: Column) -> Column:
    """A reference, or null if all three parts are."""
    return F.when(F.coalesce(uri, doc, chunk).isNotNull(), F.struct(uri.alias("source_uri"), doc.alias("doc_id"), chunk.alias("chunk_id")))


def lookup(rows: DataFrame, doc_id: str, chunk_id: str | None = None) -> DataFrame:
    """Rows that refer to a document, or to one chunk of it."""
    r = rows.filter(F.col("rag.doc_id") == doc_id)
    return r if chunk_id is None else r.filter(F.col("rag.chunk_id") == chunk_id)


def forget_before(rows: DataFrame, tick: int) -> DataFrame:
    """Rows that stay when all rows before ``tick`` but core ones are forgotten; a missing tick counts as zero."""
    return rows.filter((F.coalesce("encoded_at_tick", F.lit(0)) >= tick) | F.coalesce("is_core", F.lit(False)))


def stats(rows: DataFrame) -> DataFrame:
    """Counts over all rows, by tenant."""
    return rows.groupBy("tenant_id").agg(
        F.count(F.lit(1)).alias("engrams"), F.count_if(verified()).alias("verified"), F.count_if(F.coalesce("is_core", F.lit(False))).alias("core"),
        F.count_if(F.col("rag.doc_id").isNotNull()).alias("with_reference"), F.countDistinct("life_id").alias("lives"), F.max("encoded_at_tick").alias("last_tick"), F.sum(F.coalesce("replay_count", F.lit(0))).alias("replays"),
    )


def verified_context(rows: DataFrame, n: int = 5, by: str = "tenant_id") -> DataFrame:
    """(by, engram_id, confidence, kind, content, rank): the n verified rows of highest usable confidence."""
    conf = F.round(F.col("provenance.confidence").cast("double"), 6)
    r = rows.filter(verified()).select(by, "engram_id", F.when((conf >= 0) & (conf <= 1), conf).otherwise(0.0).alias("confidence"), kind_name(F.col("provenance.kind")).alias("kind"), "content")
    return r.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(F.desc("confidence"), "engram_id"))).filter(F.col("rank") <= n)


def warnings(rows: DataFrame, n: int = 5, by: str = "tenant_id") -> DataFrame:
    """(by, engram_id, text, rank): the first n unverified rows about money, 100 characters of each."""
    low = F.lower(F.coalesce("content", F.lit("")))
    r = rows.filter(~verified() & (low.contains("$") | low.contains("balance")))
    r = r.select(by, "engram_id", F.concat(F.lit("unverified: "), F.substring("content", 1, 100)).alias("text"), F.coalesce("encoded_at_tick", F.lit(0)).alias("tick"))
    return r.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy("tick", "engram_id"))).filter(F.col("rank") <= n).drop("tick")


def prompt_block(facts: DataFrame, by: str = "tenant_id") -> DataFrame:
    """(by, block): verified facts as lines of a prompt, in their order."""
    line = F.concat(F.lit("- [verified "), F.floor(F.col("confidence") * 100 + 0.5).cast("string"), F.lit("%] "), "content")
    lines = facts.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("ls"))
    return lines.select(by, F.concat(F.lit("## Verified ground truth\n"), F.array_join(F.transform("ls", lambda x: x["line"]), "\n")).alias("block"))


def claims(rows: DataFrame) -> DataFrame:
    """(engram_id, amount): every dollar amount stated."""
    return rows.select("engram_id", F.explode(dollar_amounts(F.col("content"))).alias("amount"))


def reconcile(claimed: DataFrame, truth: DataFrame) -> DataFrame:
    """Claims (key, amount) against true values (key, value): off by more than a cent is a conflict."""
    return claimed.join(truth, "key").withColumn("conflict", F.abs(F.col("amount") - F.col("value")) > 0.01)


def refused(rows: DataFrame) -> DataFrame:
    """Rows that must not be stored: longer than the limit or with a secret."""
    c = F.col("content")
    return rows.select("episode_id", F.when(F.char_length(c) > 8192, "too long").when(has_secret(c), "secret").alias("reason")).filter("reason is not null")


#: Display regions, domains and their colours (fixed values).
DOMAIN_COLORS = {"core": "#c8a0ff", "active": "#70c1b3", "client": "#5b9bd5", "pending": "#ffd166", "server": "#9b5de5", "partner": "#f4a261"}


def _has(c: str, *needles: str) -> Column:
    low, out = F.lower(F.coalesce(c, F.lit(""))), F.lit(False)
    for w in needles:
        out = out | low.contains(w)
    return out


def region() -> Column:
    """Region of a row for display, first rule that holds."""
    rules = (
        (F.coalesce("is_core", F.lit(False)), "corpus-callosum"), ((F.coalesce("salience", F.lit(0.0)) >= 0.85) | _has("content", "error", "death"), "temporal-l"), (_has("context", "command", "prefrontal"), "prefrontal-l"),
        (_has("context", "model") | _has("content", "conversation"), "frontal-r"), (_has("context", "wallet") | _has("content", "reward", "fine"), "parietal-r"), (_has("content", "sleep", "consolid"), "occipital-l"),
        (F.coalesce("separation_index", F.lit(0.0)) > 0.7, "parietal-l"),
    )
    out = F.lit("temporal-r")
    for rule, name in reversed(rules):
        out = F.when(rule, name).otherwise(out)
    return out


def domain() -> Column:
    return F.when(F.coalesce("is_core", F.lit(False)), "core").when(F.coalesce("salience", F.lit(0.0)) >= 0.75, "active").when(_has("content", "error"), "pending").otherwise("client")


def color(of: Column) -> Column:
    out = F.lit("#8048ff")
    for k, v in DOMAIN_COLORS.items():
        out = F.when(of == k, v).otherwise(out)
    return out


def truncated(text: Column, n: int) -> Column:
    """The trimmed text, at most ``n`` characters and an ellipsis."""
    t = F.trim(text)
    return F.when(F.char_length(t) > n, F.concat(t.substr(1, n), F.lit("…"))).otherwise(t)


def nodes(rows: DataFrame) -> DataFrame:
    """Graph nodes: id, region, domain, label of at most 40 characters, colour."""
    n = rows.select("engram_id", region().alias("region"), domain().alias("domain"), truncated(F.col("content"), 40).alias("label"))
    return n.withColumn("color", color(F.col("domain")))


def shard_address(tenant: Column, shards: int, host: str = "127.0.0.1", port: int = 8792) -> Column:
    """Where a tenant is served: one port per shard."""
    return F.concat(F.lit(f"{host}:"), (shard(tenant, shards) + port).cast("string"))


def shard(tenant: Column, shards: int) -> Column:
    """Shard of a tenant: its md5's first seven hexadecimal digits modulo the number of shards."""
    return F.pmod(F.conv(F.substring(F.md5(tenant), 1, 7), 16, 10).cast("long"), F.lit(shards))


def of_life(rows: DataFrame, life: str) -> DataFrame:
    """Rows of one life."""
    return rows.filter(F.col("life_id") == life)


def tail(rows: DataFrame, by: str, n: int) -> DataFrame:
    """The last n rows of each value of ``by`` with their place from the end."""
    w = W.partitionBy(by).orderBy(F.coalesce("encoded_at_tick", F.lit(0)).desc(), F.desc("engram_id"))
    return rows.withColumn("back", F.row_number().over(w)).filter(F.col("back") <= n)


def links(rows: DataFrame) -> DataFrame:
    """(source, target, weight, kind): rows to their display regions, core memories to their rows."""
    member = rows.select(F.col("engram_id").alias("source"), F.concat(F.lit("region:"), region()).alias("target"), F.lit(0.5).alias("weight"), F.lit("member").alias("kind"))
    core = rows.filter("is_core").select(F.concat(F.lit("core:"), "engram_id").alias("source"), F.col("engram_id").alias("target"), F.lit(1.0).alias("weight"), F.lit("core").alias("kind"))
    return member.unionByName(core)


def status(rows: DataFrame, edges: DataFrame, vectors: DataFrame, centroids: DataFrame, stage: int) -> DataFrame:
    """One row of counts over a store: rows, core, edges, lives, vectors, centroids, last tick and pressure of the edges."""
    one = rows.agg(F.count(F.lit(1)).alias("engrams"), F.count_if(F.coalesce("is_core", F.lit(False))).alias("core"), F.countDistinct("life_id").alias("lives"), F.max("encoded_at_tick").alias("last_tick"))
    n = lambda df, name: F.broadcast(df.agg(F.count(F.lit(1)).alias(name)))  # noqa: E731  (one row each)
    r = one.crossJoin(n(edges, "edges")).crossJoin(n(vectors, "vectors")).crossJoin(n(centroids, "centroids"))
    return r.withColumn("pressure", F.least(F.lit(1.0), F.col("edges") / S.STAGES[stage][4]))


def normal_subdir(c: Column) -> Column:
    """A folder with forward slashes and none at its ends."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"\\", "/"), r"^/+|/+$", "")


def clean_handoffs(h: DataFrame) -> DataFrame:
    """Handoffs once each, with status in lower case (``open`` if empty), normal subdir and a timestamp (null if unusable)."""
    sub = normal_subdir(F.col("subdir"))
    status = F.lower(F.trim(F.coalesce("status", F.lit(""))))
    iso = F.regexp_extract(F.trim(F.coalesce("created_at", F.lit(""))), r"^(\d{4}-\d{2}-\d{2})[T ](\d{2}:\d{2}:\d{2})", 0)
    at = F.try_to_timestamp(F.regexp_replace(iso, "T", " "), F.lit("yyyy-MM-dd HH:mm:ss"))
    return h.select("handoff_id", "agent", sub.alias("subdir"), F.when(status == "", "open").otherwise(status).alias("status"), F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("created"), F.coalesce(F.size("next_steps"), F.lit(0)).alias("steps")).distinct()


def context_key(agent: Column, subdir: Column) -> Column:
    """Context of a handoff's row: agent and folder, parts joined by colons."""
    sub = F.regexp_replace(subdir, "/", ":")
    return F.concat(F.lit("handoff:"), agent, F.lit(":"), F.when(sub == "", "root").otherwise(sub))


HANDOFF_JSON = "agent string, subdir string, session_id string, status string, summary string, next_steps array<string>, files array<string>, handoff_id string, created_at string"


def handoff_content(h: DataFrame) -> Column:
    """A handoff as the JSON text of a row's content, nulls kept."""
    return F.to_json(F.struct(*[c.split()[0] for c in HANDOFF_JSON.split(", ")]), {"ignoreNullFields": "false"})


def from_content(c: Column) -> Column:
    """The handoff in a row's content; null where it is none."""
    return F.from_json(c, HANDOFF_JSON)


def latest_handoffs(h: DataFrame, n: int = 3) -> DataFrame:
    """The n newest handoffs by agent and subdir."""
    w = W.partitionBy("agent", "subdir").orderBy(F.desc_nulls_last("created"), "handoff_id")
    return clean_handoffs(h).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def list_handoffs(h: DataFrame, agent: str | None = None, subdir: str | None = None, status: str | None = None, since: str | None = None, limit: int = 20) -> DataFrame:
    """The newest handoffs that match every filter given; agent and status whatever their case. An unusable time counts as the earliest."""
    c = clean_handoffs(h)
    if agent:
        c = c.filter(F.lower("agent") == agent.lower())
    if subdir is not None:
        c = c.filter(F.col("subdir") == subdir.replace("\\", "/").strip("/"))
    if status:
        c = c.filter(F.col("status") == status.lower())
    if since:
        c = c.filter(F.coalesce("created", F.lit("")) >= since)
    return c.orderBy(F.desc_nulls_last("created"), "handoff_id").limit(max(1, limit))
