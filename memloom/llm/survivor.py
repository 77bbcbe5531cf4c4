"""Best representative of each group of duplicate records.

``truth_discovery`` alternates between the reliability of each source and the
support of each value: a value's support is the summed reliability of the
sources that state it, a source's reliability the mean support share of the
values it states.  It runs until the reliabilities settle, then the highest
supported value per field makes the group's fused record.
"""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from memloom.sources.tables import materialize


def truth_discovery(claims: DataFrame, most: int = 100, tol: float = 1e-3) -> tuple[DataFrame, DataFrame]:
    """claims: object, field, source, value (string, nulls and blanks are no claims), weight (double).

    Returns (truths: object, field, value, support share) and (sources: source, reliability).
    Copies of a claim by one source are one claim with the larger weight.
    Ties go to the greater weight, then to the smaller value.  Reliabilities
    that still move by more than ``tol`` after ``most`` rounds give a warning.
    """
    c = claims.filter(F.col("value").isNotNull() & (F.trim("value") != "")).withColumn("source", F.coalesce("source", F.lit("?")))
    c = materialize(c.groupBy("object", "field", "source", "value").agg(F.max("weight").alias("weight")), "claims")
    # fields all of whose claims agree say nothing about who is right; their shares are one in every round
    open_fields = c.groupBy("object", "field").agg(F.min("value").alias("_a"), F.max("value").alias("_b")).withColumn("_open", F.col("_a") != F.col("_b")).select("object", "field", "_open")
    c = materialize(c.join(open_fields, ["object", "field"]), "claims")
    settled = c.filter("not _open").groupBy("source").agg(F.count(F.lit(1)).alias("n0"))
    settled = materialize(c.select("source").distinct().join(settled, "source", "left").select("source", F.coalesce("n0", F.lit(0)).alias("n0")), "sources")
    disputed = c.filter("_open")
    one = W.partitionBy("object", "field")

    def votes(trust: DataFrame, of: DataFrame) -> DataFrame:
        v = of.join(trust, "source").groupBy("object", "field", "value").agg(F.sum(F.col("trust") * F.col("weight")).alias("support"), F.max("weight").alias("weight"))
        return v.withColumn("share", F.col("support") / F.sum("support").over(one))

    trust = settled.select("source", F.lit(0.8).alias("trust"))
    for _ in range(most):
        got = disputed.join(votes(trust, disputed).select("object", "field", "value", "share"), ["object", "field", "value"]).groupBy("source").agg(F.sum("share").alias("s"), F.count(F.lit(1)).alias("n"))
        mean = (F.coalesce("s", F.lit(0.0)) + F.col("n0")) / (F.coalesce("n", F.lit(0)) + F.col("n0"))
        new = materialize(settled.join(got, "source", "left").select("source", F.least(F.lit(0.99), F.greatest(F.lit(0.01), mean)).alias("trust")), "trust")
        moved = new.join(trust.withColumnRenamed("trust", "old"), "source").agg(F.max(F.abs(F.col("trust") - F.col("old")))).first()[0]
        trust = new
        if moved is None or moved < tol:
            break
    else:
        warnings.warn(f"reliabilities still move by {moved} after {most} rounds", RuntimeWarning, stacklevel=2)
    votes = votes(trust, c)
    first = W.partitionBy("object", "field").orderBy(F.desc("support"), F.desc("weight"), "value")
    truths = votes.withColumn("_r", F.row_number().over(first)).filter("_r = 1").select("object", "field", "value", "share")
    return truths, trust


def best_members(rows: DataFrame, group: str, id_col: str) -> DataFrame:
    """The member of each group that comes first: verified, confidence, tick, salience, id; one aggregate, no sort of a group.

    rows: group, id_col, verified, confidence, tick, salience.  Missing values come last.
    """
    conf = F.when((F.col("confidence") >= 0) & (F.col("confidence") <= 1) & ~F.isnan("confidence"), F.col("confidence").cast("double")).otherwise(F.lit(-1.0))
    rank = F.struct(
        F.when(F.col("verified"), 0).otherwise(1).alias("v"), (-conf).alias("c"), F.coalesce(-F.col("tick"), F.lit(1 << 62)).alias("t"),
        F.when(F.col("salience").isNull() | F.isnan("salience"), F.lit(1e9)).otherwise(-F.col("salience").cast("double")).alias("s"), F.col(id_col).alias("id"),
    )
    return rows.groupBy(group).agg(F.min(id_col).alias("first_id"), F.min(rank).alias("_b"), F.count(F.lit(1)).alias("members")).select(group, "first_id", F.col("_b.id").alias("best_id"), "members")


FIELDS = ("content", "context", "outcome", "kind", "source_uri")


def survivors(rows: DataFrame, groups: DataFrame, id_col: str = "engram_id") -> DataFrame:
    """One fused record per group.

    rows: id_col, feed, content, context, outcome, provenance, encoded_at_tick, salience.
    groups: id_col, group_id.  The record keeps the id of its best member; every
    field carries the value of highest support in the group, ``agreement`` the
    mean share of the chosen values.  Ticks and salience are the best member's.
    """
    p = F.col("provenance")
    r = rows.join(groups, id_col).select(
        "group_id", id_col, "feed", "content", "context", "outcome", F.lower(F.trim(p["kind"])).alias("kind"), p["source_uri"].alias("source_uri"),
        p["verified"].alias("verified"), p["confidence"].alias("confidence"), F.col("encoded_at_tick").alias("tick"), "salience",
    )
    r = materialize(r, "members")
    best = best_members(r, "group_id", id_col)
    conf = F.when((F.col("confidence") >= 0) & (F.col("confidence") <= 1) & ~F.isnan("confidence"), F.col("confidence").cast("double")).otherwise(F.lit(0.1))
    weight = F.greatest(F.lit(0.05), conf) + F.when(F.col("verified"), 1.0).otherwise(0.0)
    blank = F.lower(F.trim(F.col("value"))).isin("", "n/a")
    claims = r.select(F.col("group_id").alias("object"), F.col("feed").alias("source"), weight.alias("weight"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in FIELDS])).alias("f"))
    claims = claims.select("object", "source", "weight", "f.field", F.col("f.value").alias("value")).filter(~blank)
    truths, _ = truth_discovery(claims)
    wide = truths.groupBy("object").agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in FIELDS], F.avg("share").alias("agreement"))
    kept = r.select(F.col("group_id").alias("_g"), F.col(id_col).alias("_i"), "verified", "confidence", "tick", "salience")
    out = best.join(wide, best["group_id"] == wide["object"], "left").join(kept, (F.col("group_id") == F.col("_g")) & (F.col("best_id") == F.col("_i")))
    return out.select(F.col("first_id").alias("group_first_id"), "best_id", "members", *FIELDS, "verified", "confidence", F.col("tick").alias("encoded_at_tick"), "salience", "agreement")
