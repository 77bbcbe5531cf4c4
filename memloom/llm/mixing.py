"""Mixing sources to target shares of all tokens by min-cost flow.

Exact copies of a text under several sources are one text that may serve any
of them.  Texts are aggregated by their membership pattern, the set of target
sources that hold them.  A flow network routes token capacity from patterns
to source quotas; using a pattern a second, third, ... time costs more each
time, so texts are repeated only where a quota cannot be met otherwise.  The
flow is then turned into a seeded selection of documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from memloom.sources.tables import materialize, spread

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Splitting pattern of the byte-level tokenizer (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MAX_SOURCES, MAX_PATTERNS = 16, 65_536
_encoders: dict[int, object] = {}


def token_counts(docs: DataFrame, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """``docs`` without the text, plus n_tokens by a public tokenizer (rank file) and text_key.

    The vocabulary file is read on the driver and broadcast; its size is
    checked (at most 16 MB).
    """
    import base64

    raw = open(tokenizer, "rb").read()
    if len(raw) > 16_000_000:
        raise ValueError("the tokenizer file has more than 16 MB")
    shared = docs.sparkSession.sparkContext.broadcast(raw)

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        if not _encoders:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, shared.value.splitlines())}
            _encoders[0] = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        enc = _encoders[0]
        for s in batches:
            yield pd.Series([len(enc.encode_ordinary(t)) if t else 0 for t in s], dtype="int64")

    keep = [c for c in docs.columns if c != text]
    return spread(docs).select(*keep, count(F.col(text)).alias("n_tokens"), F.md5(F.col(text)).alias("text_key"))


class Flow:
    """Min-cost flow by successive cheapest paths (Bellman-Ford); graphs of a few thousand arcs."""

    def __init__(self, nodes: int):
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.cap: list[int] = []
        self.cost: list[int] = []

    def arc(self, a: int, b: int, cap: int, cost: int) -> int:
        k = len(self.to)
        for x, y, c, w in ((a, b, cap, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.cap.append(c)
            self.cost.append(w)
        return k

    def used(self, arc: int) -> int:
        return self.cap[arc ^ 1]

    def run(self, s: int, t: int) -> int:
        """Flow from s to t at least cost; returns its amount."""
        total = 0
        while True:
            dist = [None] * len(self.out)
            via = [-1] * len(self.out)
            dist[s] = 0
            queue, waiting = [s], {s}
            while queue:
                a = queue.pop(0)
                waiting.discard(a)
                for k in self.out[a]:
                    if self.cap[k] > 0:
                        b, d = self.to[k], dist[a] + self.cost[k]
                        if dist[b] is None or d < dist[b]:
                            dist[b], via[b] = d, k
                            if b not in waiting:
                                waiting.add(b)
                                queue.append(b)
            if dist[t] is None:
                return total
            push, b = None, t
            while b != s:
                k = via[b]
                push = self.cap[k] if push is None else min(push, self.cap[k])
                b = self.to[k ^ 1]
            b = t
            while b != s:
                k = via[b]
                self.cap[k] -= push
                self.cap[k ^ 1] += push
                b = self.to[k ^ 1]
            total += push


def route(patterns: dict[tuple[str, ...], int], targets: dict[str, tuple[float, int]], total: int) -> tuple[int, dict[tuple[tuple[str, ...], str], int]]:
    """Tokens of each pattern for each source at ``total`` tokens: (amount routed, {(pattern, source): tokens})."""
    names = sorted(targets)
    pats = sorted(patterns)
    g = Flow(2 + len(pats) + len(names))
    src, sink = 0, 1
    at = {p: 2 + i for i, p in enumerate(pats)}
    to = {s: 2 + len(pats) + i for i, s in enumerate(names)}
    arcs = {}
    for p in pats:
        for use in range(max(targets[s][1] for s in p)):
            g.arc(src, at[p], patterns[p], use * use)
        for s in p:
            # a pattern of few sources is spent first on them, at equal repetition
            arcs[p, s] = g.arc(at[p], to[s], patterns[p] * targets[s][1], 0)
    for s in names:
        g.arc(to[s], sink, int(targets[s][0] * total), 0)
    return g.run(src, sink), {k: g.used(a) for k, a in arcs.items()}


def largest_total(patterns: dict, targets: dict) -> int:
    """The largest total at which every quota can be met within the repetitions."""
    quotas = lambda t: sum(int(s * t) for s, _ in targets.values())
    lo, hi = 0, int(min(sum(patterns[p] * targets[s][1] for p in patterns if s in p) / share for s, (share, _) in targets.items() if share > 0)) + 1
    while hi - lo > max(1, lo // 2000):
        mid = (lo + hi) // 2
        if route(patterns, targets, mid)[0] >= quotas(mid):
            lo = mid
        else:
            hi = mid
    return lo


def mix(docs: DataFrame, mix_targets: DataFrame, total_tokens: int | None = None, seed: int = 1, tokenizer: str = TOKENIZER, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(selection, report).

    selection: doc_id, source, n_tokens, uses: how often each chosen document
    is used.  report: source, target_share, max_repeats, available_tokens,
    mixed_tokens, share, most_uses for every listed source.

    Sources are compared trimmed and in lower case.  Documents without tokens,
    without source or of a source not listed are left out.  A listed source
    without documents keeps share zero, and the others divide the whole in
    proportion to their targets.  Without ``total_tokens`` the mix is the
    largest that meets all shares.  A row that comes twice (same doc_id) counts
    once.  The same seed gives the same documents.
    """
    spark = docs.sparkSession
    rows = mix_targets.filter("source is not null and target_share is not null").select(F.lower(F.trim("source")).alias("source"), "target_share", "max_repeats").limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} target sources")
    asked = {r["source"]: (float(r["target_share"]), max(0, int(r["max_repeats"] or 0))) for r in rows}
    named = F.lower(F.regexp_replace(F.col("source"), r"^[\s ]+|[\s ]+$", ""))
    d = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", named.alias("source"), F.col(text).alias("_t"))
    d = token_counts(d.filter(F.col("source").isin(*asked)) if asked else d.limit(0), "_t", tokenizer).filter("n_tokens > 0")
    d = materialize(d.dropDuplicates(["doc_id"]), "tokens")
    members = d.groupBy("text_key", "source").agg(F.min("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"))
    texts = members.groupBy("text_key").agg(F.array_sort(F.collect_set("source")).alias("pattern"), F.max("n_tokens").alias("n_tokens"), F.map_from_entries(F.collect_list(F.struct("source", "doc_id"))).alias("docs"))
    texts = texts.withColumn("pattern", F.filter("pattern", lambda s: s.isin(*[k for k, v in asked.items() if v[1] > 0 and v[0] > 0]))).filter(F.size("pattern") > 0)
    texts = materialize(texts.withColumn("order", F.xxhash64(F.lit(seed), "text_key")), "texts")
    got = texts.groupBy("pattern").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n")).limit(MAX_PATTERNS + 1).collect()
    if len(got) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    patterns = {tuple(r["pattern"]): int(r["t"]) for r in got}
    n_texts = sum(r["n"] for r in got)
    there = {s for p in patterns for s in p}
    whole = sum(asked[s][0] for s in there)
    targets = {s: (asked[s][0] / whole, asked[s][1]) for s in there}
    total = largest_total(patterns, targets) if patterns and total_tokens is None else int(total_tokens or 0)
    flow = route(patterns, targets, total)[1] if patterns else {}

    # all uses of a pattern lie on a line, first uses first, each in seeded order; sources take stretches of it
    lines = [(list(p), s, lo, lo + f) for p in patterns for s, lo, f in _stretches(p, flow)]
    plan = spark.createDataFrame(lines, "pattern array<string>, source string, lo long, hi long")
    totals = spark.createDataFrame([(list(p), t) for p, t in patterns.items()], "pattern array<string>, whole long")
    buckets = max(64, n_texts // 50_000)
    t = texts.withColumn("bucket", F.pmod(F.shiftright("order", 20), F.lit(buckets)))
    sums = t.groupBy("pattern", "bucket").agg(F.sum("n_tokens").alias("_s"))
    starts = sums.select("pattern", "bucket", (F.sum("_s").over(W.partitionBy("pattern").orderBy("bucket")) - F.col("_s")).alias("_start"))
    inner = W.partitionBy("pattern", "bucket").orderBy("order", "text_key").rowsBetween(W.unboundedPreceding, -1)
    placed = t.withColumn("_in", F.coalesce(F.sum("n_tokens").over(inner), F.lit(0))).join(starts, ["pattern", "bucket"])
    placed = placed.withColumn("middle", F.col("_start") + F.col("_in") + F.col("n_tokens") / 2)
    # plan and totals hold a row per pattern and source: their number was checked above
    uses = placed.join(F.broadcast(plan.join(totals, "pattern")), "pattern")
    first = F.ceil((F.col("lo") - F.col("middle")) / F.col("whole"))
    last = F.ceil((F.col("hi") - F.col("middle")) / F.col("whole"))
    uses = uses.withColumn("uses", (last - F.greatest(first, F.lit(0))).cast("int")).filter("uses > 0")
    selection = materialize(uses.select(F.col("docs")[F.col("source")].alias("doc_id"), "source", "n_tokens", "uses"), "selection")

    have = d.groupBy("source").agg(F.sum("n_tokens").alias("available_tokens"))
    took = selection.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("mixed_tokens"), F.max("uses").alias("most_uses"))
    asked_df = spark.createDataFrame([(s, a, m) for s, (a, m) in asked.items()], "source string, target_share double, max_repeats int")
    report = asked_df.join(have, "source", "left").join(took, "source", "left").fillna(0, ["available_tokens", "mixed_tokens", "most_uses"])
    mixed = took.agg(F.coalesce(F.sum("mixed_tokens"), F.lit(0)).alias("_all"))
    report = report.crossJoin(F.broadcast(mixed)).withColumn("share", F.round(F.when(F.col("_all") > 0, F.col("mixed_tokens") / F.col("_all")).otherwise(0.0), 6)).drop("_all")
    return selection, report.select("source", "target_share", "max_repeats", "available_tokens", "mixed_tokens", "share", "most_uses")


def _stretches(p: tuple[str, ...], flow: dict) -> list[tuple[str, int, int]]:
    out, at = [], 0
    for s in p:
        f = flow.get((p, s), 0)
        if f:
            out.append((s, at, f))
            at += f
    return out
