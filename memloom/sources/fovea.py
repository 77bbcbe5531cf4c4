"""Text and feed sources: sliding token windows, hash embeddings, feed rows, raw export and import."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.functions import stages as S


def packets(docs: DataFrame, id_col: str, text: str, width: int = S.FOVEA_WIDTH, step: int = S.FOVEA_STEP) -> DataFrame:
    """(id, packet, token_offset, fovea, before, after, salience): windows of ``width`` blank-separated tokens every ``step``, until one reaches the end.

    Before and after hold up to ``width`` tokens each, cut to FOVEA_SIDE bytes; the salience grows with the first packets.
    """
    d = docs.select(id_col, F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"\s+"), lambda x: x != "").alias("ts")).filter(F.size("ts") > 0)
    n = F.size("ts")
    last = F.when(n <= width, 0).otherwise(F.ceil((n - width) / step)).cast("int")
    d = d.select(id_col, "ts", F.explode(F.sequence(F.lit(0), last)).alias("packet")).withColumn("token_offset", F.col("packet") * step)
    cut = lambda a, k: F.array_join(F.slice("ts", a, k), " ")
    side = lambda a, k: clipped(cut(a, k), S.FOVEA_SIDE)
    lo = F.greatest(F.col("token_offset") - width, F.lit(0))
    return d.select(
        id_col, "packet", "token_offset", cut(F.col("token_offset") + 1, F.lit(width)).alias("fovea"), side(lo + 1, F.col("token_offset") - lo).alias("before"),
        side(F.col("token_offset") + width + 1, F.lit(width)).alias("after"), (45 + 10 * F.least("packet", F.lit(3))).alias("salience_percent"),
    )


def clipped(c: Column, most: int) -> Column:
    """The text, or its longest beginning of less than ``most`` bytes and an ellipsis."""
    head = F.substring(c, 1, most - 1)
    # characters of several bytes: as many of the first ones as fit
    fit = F.size(F.filter(F.sequence(F.lit(1), F.lit(most - 1)), lambda k: F.octet_length(head.substr(F.lit(1), k)) <= most - 1))
    short = F.when(F.octet_length(head) <= most - 1, head).otherwise(head.substr(F.lit(1), fit))
    return F.when(F.octet_length(c) <= most, c).otherwise(F.concat(short, F.lit("…")))


def packet_episodes(packets_of: DataFrame, file: Column, path: Column) -> DataFrame:
    """Episodes of a file's packets: content by template, context, reference and provenance of an observed file."""
    content = F.concat(F.lit("[fix"), F.col("packet").cast("string"), F.lit("] "), "fovea", F.lit(" | …"), "before", F.lit("… "), "after", F.lit(" …"))
    uri = F.concat(F.lit("file://"), path)
    return packets_of.select(
        content.alias("content"), F.concat(F.lit("fovea:"), file).alias("context"), (F.col("salience_percent") / 100).alias("salience_hint"),
        F.struct(uri.alias("source_uri"), path.alias("doc_id"), F.concat(F.lit("fovea-"), F.col("packet").cast("string")).alias("chunk_id")).alias("rag"),
        F.struct(F.lit("file_observation").alias("kind"), uri.alias("source_uri"), F.lit(0.75).cast("float").alias("confidence"), F.lit(False).alias("verified")).alias("provenance"),
    )


def chunk_episodes(chunks: DataFrame) -> DataFrame:
    """Episodes of document chunks (doc_id, chunk_id, content): defaults for missing ids, context and provenance of an observed file."""
    doc, chunk = F.coalesce("doc_id", F.lit("document")), F.coalesce("chunk_id", F.lit("0"))
    return chunks.select(
        "content", F.concat(F.lit("rag:"), doc, F.lit("#"), chunk).alias("context"), F.lit(0.55).alias("salience_hint"), doc.alias("doc_id"), chunk.alias("chunk_id"),
        F.struct(F.lit("file_observation").alias("kind"), F.lit(None).cast("string").alias("source_uri"), F.lit(0.7).cast("float").alias("confidence"), F.lit(False).alias("verified")).alias("provenance"),
    )


def hash_embedding(docs: DataFrame, id_col: str, text: str, dim: int = 32) -> DataFrame:
    """(id, slot, value): the hash projection of a text, one row per non-zero slot, scaled to length one.

    Every run of a-z and 0-9 (or, without one, the first 32 characters) gives
    the eight little-endian words of its sha256: each adds one to, or takes one
    from, the slot of its remainder, by its lowest bit.
    """
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    tokens = F.filter(F.split(low, r"[^a-z0-9]+"), lambda x: x != "")
    d = docs.select(id_col, F.explode(F.when(F.size(tokens) > 0, tokens).otherwise(F.array(F.substring(low, 1, 32)))).alias("w"))
    # tokens repeat, so each is hashed once per row and counted
    d = d.groupBy(id_col, "w").agg(F.count(F.lit(1)).alias("times")).withColumn("h", F.sha2("w", 256))
    byte = lambda i, k: F.substring("h", 1 + 8 * i + 2 * k, 2)
    word = lambda i: F.conv(F.concat(byte(i, 3), byte(i, 2), byte(i, 1), byte(i, 0)), 16, 10).cast("long")
    parts = F.array(*[F.struct(F.pmod(word(i), F.lit(dim)).alias("slot"), F.when(word(i) % 2 == 1, 1).otherwise(-1).alias("sign")) for i in range(8)])
    s = d.select(id_col, "times", F.explode(parts).alias("p")).groupBy(id_col, F.col("p.slot").alias("slot")).agg(F.sum(F.col("times") * F.col("p.sign")).alias("value")).filter("value <> 0")
    norm = s.groupBy(id_col).agg(F.sqrt(F.sum(F.col("value").cast("double") * F.col("value"))).alias("norm"))
    return s.join(norm, id_col).select(id_col, "slot", (F.col("value") / F.col("norm")).alias("value"))


FEED_SCHEMA = "kind string, content string, context string, created_at string, agent_id string"


def embedded(rows: DataFrame, id_col: str, text: str, encode=None, dim: int = 32) -> DataFrame:
    """``rows`` with a ``vector``: of ``encode`` (a column function, such as a pandas UDF over texts), or the dense hash projection. Empty texts have none."""
    if encode is not None:
        return rows.withColumn("vector", F.when(F.trim(F.coalesce(F.col(text), F.lit(""))) != "", encode(F.col(text))))
    h = hash_embedding(rows.filter(F.trim(F.coalesce(F.col(text), F.lit(""))) != ""), id_col, text, dim).groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct(F.col("slot").cast("int"), "value"))).alias("_m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.element_at("_m", i), F.lit(0.0)).cast("float"))
    return rows.join(h.select(id_col, dense.alias("vector")), id_col, "left")


def feed_episodes(rows: DataFrame) -> DataFrame:
    """Rows of a feed (kind, content, context, agent_id) as episodes: the kind before the text, texts and contexts cut, empty ones left out; the chunk id is a hash of the row."""
    prefix = F.when(F.col("kind").isin("user", "assistant", "think"), F.concat("kind", F.lit(":"))).otherwise("")
    r = rows.filter(F.coalesce("content", F.lit("")) != "")
    return r.select(
        F.substring(F.concat(prefix, "content"), 1, 500).alias("content"), F.substring(F.coalesce("context", F.lit("feed")), 1, 120).alias("context"), F.when(F.col("kind") == "user", 0.62).otherwise(0.58).alias("salience_hint"), "agent_id",
        F.substring(F.sha2(F.concat_ws("|", F.coalesce("kind", F.lit("event")), "content", F.coalesce("context", F.lit("feed")), F.coalesce("agent_id", F.lit(""))), 256), 1, 16).alias("chunk_id"),
    )


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of a feed as episodes; broken lines are left out."""
    raw = spark.read.schema(FEED_SCHEMA + ", _broken string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").json(path).cache()
    return feed_episodes(raw.filter("_broken is null").drop("_broken"))


def export_raw(rows: DataFrame, path: str) -> None:
    """Rows as JSON lines, nested fields kept."""
    rows.write.mode("overwrite").json(path)


def import_raw(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """Rows of a raw export, read with the schema of ``like``."""
    return spark.read.schema(like.schema).json(path)
