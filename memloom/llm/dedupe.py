"""Groups of texts that say the same, and batches checked against all history.

Both operators work on *classes*: rows whose canonical words are equal collapse
first, so copies of one text never meet in pairs.  Classes that can say the
same share an index token, found by a prefix filter over one token order:
tokens with digits come first, rare ones before common ones, then words by
rarity.  Tokens with digits must agree, so a prefix ends with the first rare
one of them; without one it holds as many words as ``same`` lets differ and one
more, each together with the digits.  Within a token the classes pass through
in order and are compared with the leaders met so far: memory is bounded by
distinct texts, not by rows, and no pairs are emitted.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.llm.textnorm import SLACK, canonical, has_digit, same
from memloom.sources.tables import fresh_path, materialize, spread

#: A token with digits is rare if at most so many distinct texts hold it.
RARE = 32
MOST_FREQUENT = 1_000_000
CANON = "words string, n_words int, numbers string"


def _canonical_udf():
    @F.pandas_udf(f"struct<{CANON.replace(' ', ':').replace(',:', ',')}>")
    def canon(text: pd.Series) -> pd.DataFrame:
        out = []
        for t in text:
            w = canonical(t or "")
            out.append((" ".join(w), len(w), " ".join(x for x in w if has_digit(x))))
        return pd.DataFrame(out, columns=["words", "n_words", "numbers"])

    return canon


def with_canonical(df: DataFrame, text: str) -> DataFrame:
    """``df`` plus the canonical columns of column ``text`` (null counts as empty)."""
    return spread(df).withColumn("_c", _canonical_udf()(F.col(text))).select("*", "_c.*").drop("_c")


def _digits(rows: DataFrame) -> DataFrame:
    return rows.filter("numbers <> ''").select("class_id", F.explode(F.array_distinct(F.split("numbers", " "))).alias("token"))


class TokenOrder:
    """The order of index tokens, fixed once: which tokens with digits are common, and how often a word occurs in texts without a rare one.

    Two texts that say the same hold the same tokens with digits, so both go by
    a rare one or both by words.  Tokens not seen when the order was fixed are
    rare; that costs comparisons when they become common, never a result.
    """

    def __init__(self, frequent: DataFrame, words: DataFrame):
        self.frequent, self.words = frequent, words

    @classmethod
    def fixed(cls, rows: DataFrame, path: str) -> "TokenOrder":
        """Order by the classes of ``rows`` (class_id, words, numbers), kept under ``path``."""
        spark = rows.sparkSession
        d = _digits(rows).groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") > RARE).select("token")
        d.write.parquet(f"{path}/frequent")
        frequent = spark.read.parquet(f"{path}/frequent")
        plain = rows.join(cls(frequent, frequent).rare(rows).select("class_id"), "class_id", "left_anti")
        w = plain.select(F.explode(F.array_distinct(F.split("words", " "))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))
        w.write.parquet(f"{path}/words")
        return cls(frequent, spark.read.parquet(f"{path}/words"))

    @classmethod
    def opened(cls, spark: SparkSession, path: str) -> "TokenOrder":
        return cls(spark.read.parquet(f"{path}/frequent"), spark.read.parquet(f"{path}/words"))

    def rare(self, rows: DataFrame) -> DataFrame:
        """(class_id, token): the first rare token with digits of each class that has one."""
        few = self.frequent.limit(MOST_FREQUENT + 1).count() <= MOST_FREQUENT
        d = _digits(rows).join(F.broadcast(self.frequent) if few else self.frequent, "token", "left_anti")
        return d.groupBy("class_id").agg(F.min(F.struct(F.xxhash64("token"), "token"))["token"].alias("token"))

    def keyed(self, rows: DataFrame, scope: list[str]) -> DataFrame:
        """One row per class and index token; column ``key`` hashes scope and token."""
        base = [F.col(c) for c in scope]
        marked = materialize(rows.join(self.rare(rows), "class_id", "left"), "marked")
        strong = marked.filter("token is not null").withColumn("key", F.xxhash64(*base, F.lit("#"), F.col("token"))).drop("token")
        weak = marked.filter("token is null").drop("token")
        words = weak.select("class_id", F.col("n_words").alias("_n"), F.explode(F.array_distinct(F.split("words", " "))).alias("word"))
        ranked = words.join(self.words, "word", "left").groupBy("class_id").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "word"))).alias("_ws"), F.first("_n").alias("_n"))
        most = F.greatest(F.lit(6), F.ceil(2 * SLACK * F.col("_n"))).cast("int") + 1
        prefix = ranked.select("class_id", F.explode(F.slice("_ws", 1, most)).alias("_p"))
        weak = weak.join(prefix, "class_id").withColumn("key", F.xxhash64(*base, F.col("numbers"), F.col("_p.word"))).drop("_p")
        return strong.unionByName(weak)


def _leader_links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(class_id, leader) for every class whose text says the same as an earlier leader of its key."""
    leaders: dict[str, list[tuple[int, list[str]]]] = {}
    out: list[tuple[int, int]] = []
    last = None
    for pdf in batches:
        for key, cid, w, nums in zip(pdf["key"].tolist(), pdf["class_id"].tolist(), pdf["words"].tolist(), pdf["numbers"].tolist()):
            if key != last:
                leaders, last = {}, key
            ws = w.split(" ") if w else []
            mine = leaders.setdefault(nums, [])
            hits = [c for c, lw in mine if same(ws, lw)]
            out += [(cid, c) for c in hits]
            if not hits:
                mine.append((cid, ws))
        if out:
            yield pd.DataFrame(out, columns=["class_id", "leader"])
            out = []


def leader_links(keyed: DataFrame, salts: int = 1) -> DataFrame:
    """Links between classes of one key.  With ``salts`` above one a key is spread over that many tasks first and their leaders meet in a second pass."""
    cols = ["key", "class_id", "copies", "words", "numbers"]
    k = keyed.select(*cols)
    schema = "class_id long, leader long"
    if salts <= 1:
        return k.repartition("key").sortWithinPartitions("key", F.desc("copies"), "class_id").mapInPandas(_leader_links, schema)
    salted = k.withColumn("key", F.xxhash64("key", F.pmod(F.col("class_id"), F.lit(salts))))
    first = materialize(salted.repartition("key").sortWithinPartitions("key", F.desc("copies"), "class_id").mapInPandas(_leader_links, schema), "leaders")
    rest = k.join(first.select("class_id").distinct(), "class_id", "left_anti")
    return first.unionByName(rest.repartition("key").sortWithinPartitions("key", F.desc("copies"), "class_id").mapInPandas(_leader_links, schema))


def components(edges: DataFrame, a: str = "a", b: str = "b", most: int = 50) -> DataFrame:
    """Connected components of an edge list: (node, root), root the smallest node.

    Alternates large-star and small-star steps until the edges stop changing;
    every step is a shuffle on a node, and no neighbourhood is collected.
    """
    e = materialize(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "edges")
    for _ in range(most):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u")
        nxt = small.select("u", F.col("m").alias("v")).unionByName(small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).filter("u <> v").distinct()
        nxt = materialize(nxt, "edges")
        sig = lambda d: d.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))).first()
        done = sig(nxt) == sig(e)
        e = nxt
        if done:
            break
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    star = e.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    return star.unionByName(star.select(F.col("root").alias("node"), "root").distinct())


def same_text_groups(rows: DataFrame, id_col: str, text: str, scope: list[str], salts: int = 1) -> DataFrame:
    """(id_col, group_id): rows of equal ``scope`` whose texts say the same; only groups of two or more rows.

    Null scope values form a scope of their own.  Rows with no words at all
    are in no group.  group_id is an opaque number.
    """
    c = with_canonical(rows.select(id_col, *scope, text), text).filter("n_words > 0").drop(text)
    c = materialize(c.withColumn("class_id", F.xxhash64(*scope, "words")), "canon")
    classes = c.groupBy("class_id").agg(*[F.first(x).alias(x) for x in (*scope, "words", "n_words", "numbers")], F.count(F.lit(1)).alias("copies"))
    classes = materialize(classes, "classes")
    order = TokenOrder.fixed(classes, fresh_path(rows.sparkSession, "order"))
    links = materialize(leader_links(order.keyed(classes, scope), salts).distinct(), "links")
    comp = components(links, "class_id", "leader")
    g = c.select(id_col, "class_id").join(comp, c["class_id"] == comp["node"], "left").select(id_col, F.coalesce("root", "class_id").alias("group_id"))
    big = g.groupBy("group_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("group_id")
    return g.join(big, "group_id")


# -- batches against history ---------------------------------------------------


def _probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of a key in order (history first, then ids upward) against those before them that are neither repeats here nor known ones."""
    last, accepted = None, {}
    for pdf in batches:
        out = []
        for key, cid, rid, new, known, w, nums in zip(*(pdf[x].tolist() for x in ("key", "class_id", "row_id", "is_new", "known", "words", "numbers"))):
            if key != last:
                accepted, last = {}, key
            ws = w.split(" ") if w else []
            mine = accepted.setdefault(nums, [])
            hits = [r for r, aw in mine if same(ws, aw)] if new else []
            out += [(key, cid, rid, r) for r in hits]
            if not hits and not known:
                mine.append((rid, ws))
        if out:
            yield pd.DataFrame(out, columns=["key", "class_id", "row_id", "hit"])


POSTING = ("key", "class_id", "row_id", "words", "n_words", "numbers")
MOST_KEYS, MOST_PASSES = 1_000_000, 50


class IncrementalIndex:
    """Inverted index of accepted rows under a folder: postings (key, class, smallest row id, words) by index token.

    Postings lie in buckets of tokens, one part per batch; the order of tokens
    is fixed with the first part.  ``add_batch`` probes the index with the
    batch's prefix tokens only, finds repeats (also among the batch itself) and
    appends the postings of what it accepts.  History is canonicalised once,
    when it enters; ``open`` continues an index in another session.
    """

    def __init__(self, spark: SparkSession, path: str, scope: list[str], buckets: int = 16):
        self.spark, self.path, self.scope, self.buckets = spark, path.rstrip("/"), scope, buckets
        self.parts, self.order = 0, None

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> "IncrementalIndex":
        """The index a folder holds, with all batches that were added completely."""
        m = max((json.loads(r[0]) for r in spark.read.text(f"{path.rstrip('/')}/manifest").collect()), key=lambda x: x["parts"])
        out = cls(spark, path, m["scope"], m["buckets"])
        out.parts, out.order = m["parts"], TokenOrder.opened(spark, f"{out.path}/order")
        return out

    def _classes(self, rows: DataFrame) -> DataFrame:
        """One row per class of a batch, under its smallest row id."""
        cols = (*self.scope, "words", "n_words", "numbers")
        return rows.groupBy("class_id").agg(*[F.min_by(x, "row_id").alias(x) for x in cols], F.min("row_id").alias("row_id"))

    def _append(self, keyed: DataFrame) -> None:
        p = keyed.select(*POSTING).withColumn("bucket", F.pmod("key", F.lit(self.buckets)).cast("int"))
        p.repartition(self.buckets, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/postings/part={self.parts}")
        self.parts += 1
        # a part counts once the manifest names it; a part written before a crash is written again
        m = json.dumps({"parts": self.parts, "scope": self.scope, "buckets": self.buckets})
        self.spark.createDataFrame([(m,)], "value string").coalesce(1).write.mode("append").text(f"{self.path}/manifest")

    def postings(self) -> DataFrame:
        kinds = "key long, class_id long, row_id long, words string, n_words int, numbers string, bucket int"
        return self.spark.read.schema(kinds).option("basePath", f"{self.path}/postings").parquet(*[f"{self.path}/postings/part={k}" for k in range(self.parts)]).select(*POSTING)

    def _matching(self, keys: DataFrame) -> DataFrame:
        """Postings under one of ``keys``, one per class and key.

        The key columns meet first; the keys that occur on both sides are
        broadcast while they are few (MOST_KEYS, checked), so that the words of
        the history are filtered where they lie and not shuffled.
        """
        known = self.postings()
        both = materialize(known.select("key").join(keys.distinct(), "key", "left_semi").distinct(), "keys")
        few = both.limit(MOST_KEYS + 1).count() <= MOST_KEYS
        hits = known.join(F.broadcast(both) if few else both, "key", "left_semi")
        return hits.groupBy("key", "class_id").agg(F.min("row_id").alias("row_id"), F.first("words").alias("words"), F.first("n_words").alias("n_words"), F.first("numbers").alias("numbers"))

    def add_history(self, rows: DataFrame) -> None:
        """rows: row_id, scope columns and canonical columns of what is already accepted; canonicalised once."""
        rows = materialize(rows.withColumn("class_id", F.xxhash64(*self.scope, "words")), "history")
        classes = materialize(self._classes(rows), "classes")
        self.order = TokenOrder.fixed(classes, f"{self.path}/order")
        self._append(self.order.keyed(classes, self.scope))

    def add_batch(self, rows: DataFrame) -> DataFrame:
        """(first_id, repeat_id) of the batch's repeats; the rest is accepted and indexed.

        A row is a repeat if it says the same as an accepted row with a smaller
        id.  Each token's walk knows only its own repeats; where a row leans on
        a row that another token shows to be a repeat, the tokens of that row
        are walked again without it, until every repeat leans on an accepted row.
        """
        rows = materialize(rows.withColumn("class_id", F.xxhash64(*self.scope, "words")), "new")
        keyed = materialize(self.order.keyed(materialize(self._classes(rows), "classes"), self.scope).select(*POSTING), "batch")
        stream = self._matching(keyed.select("key")).withColumn("is_new", F.lit(False)).unionByName(keyed.withColumn("is_new", F.lit(True)))
        schema = "key long, class_id long, row_id long, hit long"
        walk = lambda s: s.repartition("key").sortWithinPartitions("key", "is_new", "row_id").mapInPandas(_probe, schema)
        links = materialize(walk(stream.withColumn("known", F.lit(False))), "found")
        for _ in range(MOST_PASSES):
            repeats = links.select("class_id", "row_id").distinct()
            sure = links.join(repeats.select(F.col("row_id").alias("hit")), "hit", "left_anti").groupBy("class_id").agg(F.min("hit").alias("first_id"))
            sure = materialize(sure, "sure")
            unsure = materialize(repeats.join(sure, "class_id", "left_anti").select("class_id"), "unsure")
            if unsure.isEmpty():
                break
            again = materialize(keyed.join(unsure, "class_id", "left_semi").select("key").distinct(), "again")
            marked = stream.join(again, "key", "left_semi").join(sure.select("class_id", F.lit(True).alias("known")), "class_id", "left").withColumn("known", F.col("is_new") & F.coalesce("known", F.lit(False)))
            links = materialize(links.join(again, "key", "left_anti").unionByName(walk(marked)), "found")
        else:
            raise RuntimeError(f"repeats still undecided after {MOST_PASSES} passes")
        firsts = rows.groupBy("class_id").agg(F.min("row_id").alias("_min"))
        out = (
            rows.select("row_id", "class_id").join(firsts, "class_id").join(sure, "class_id", "left")
            .select(F.coalesce("first_id", "_min").alias("first_id"), F.col("row_id").alias("repeat_id")).filter("first_id < repeat_id")
        )
        out = materialize(out, "repeats")
        self._append(keyed.join(sure.select("class_id"), "class_id", "left_anti"))
        return out


def batch_repeats(history: DataFrame, batches: list[DataFrame], scope: list[str], path: str | None = None) -> DataFrame:
    """Repeats of several batches, taken in order, against ``history`` and each other.

    ``history`` and batches hold row_id, ``scope`` and ``text``.  Rows with a
    null in ``scope`` or without words repeat nothing and are no first rows.
    The index is kept under ``path``, or in the shared folder.
    """
    def prepared(d: DataFrame) -> DataFrame:
        for s in scope:
            d = d.filter(F.col(s).isNotNull())
        return with_canonical(d.select("row_id", *scope, "text"), "text").filter("n_words > 0").drop("text")

    spark = history.sparkSession
    index = IncrementalIndex(spark, path or fresh_path(spark, "index"), scope)
    index.add_history(prepared(history))
    out = None
    for b in batches:
        r = index.add_batch(prepared(b))
        out = r if out is None else out.unionByName(r)
    return out if out is not None else history.select(F.col("row_id").alias("first_id"), F.col("row_id").alias("repeat_id")).limit(0)
