"""Look-ahead along the strongest activation, for all cues at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.functions import stages as S
from memloom.functions.features import bound, granules
from memloom.functions.text import rich_tokens
from memloom.operators.recall import cue_features
from memloom.sources.tables import materialize

EDGE_FLOOR, MAX_STEPS, PREPLAY_SPREAD, PREVIEW = 0.02, 16, 0.55, 80


def preplay(edges: DataFrame, cues: DataFrame, rows: DataFrame | None = None, steps: int = 4, stage: int = 2) -> DataFrame:
    """(cue_id, step, node, activation, preview): the most active node of each step, from the cue's features on.

    A step takes the most active node not taken yet (of equal ones the smallest),
    passes activation over its edges, largest contribution first, and removes
    it.  A path ends when its most active node was taken before.  ``preview`` is
    the beginning of the first row (smallest id) that holds the node.
    """
    factor = PREPLAY_SPREAD * max(S.STAGES[stage][2], 0.1)
    act = cue_features(cues, F.lit("life")).withColumn("activation", F.lit(1.0))
    taken = out = None
    for k in range(min(steps, MAX_STEPS)):
        best = act.groupBy("cue_id").agg(F.max(F.struct(F.round("activation", 9).alias("a"), (-F.col("node")).alias("n"))).alias("b")).select("cue_id", (-F.col("b.n")).alias("node"), F.col("b.a").alias("activation"))
        if taken is not None:
            best = best.join(taken, ["cue_id", "node"], "left_anti")
        best = materialize(best, "step")
        step = best.select("cue_id", F.lit(k).alias("step"), "node", "activation")
        out = step if out is None else out.unionByName(step)
        taken = best.select("cue_id", "node") if taken is None else taken.unionByName(best.select("cue_id", "node"))
        # paths that ended keep no activation
        live = act.join(best.select("cue_id"), "cue_id", "left_semi").join(best.select("cue_id", "node"), ["cue_id", "node"], "left_anti")
        sent = best.join(edges, best["node"] == edges["src"]).select("cue_id", F.col("dst").alias("node"), (F.col("activation") * F.col("weight") * factor).alias("activation")).filter(F.col("activation") > EDGE_FLOOR)
        sent = sent.join(best.select("cue_id", "node"), ["cue_id", "node"], "left_anti")
        act = materialize(live.unionByName(sent).groupBy("cue_id", "node").agg(F.max("activation").alias("activation")), "activation")
    if rows is None:
        return out.select("cue_id", "step", "node", F.round("activation", 6).alias("activation"), F.lit(None).cast("string").alias("preview"))
    f = rows.select("engram_id", "content", granules(rich_tokens(F.col("content"), F.col("context"), F.col("outcome")), F.lit("life")).alias("dg")).select("engram_id", "content", F.explode(bound(F.col("dg"))).alias("node"))
    first = f.join(out.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.min(F.struct("engram_id", F.substring("content", 1, PREVIEW).alias("p")))["p"].alias("preview"))
    return out.join(first, "node", "left").select("cue_id", "step", "node", F.round("activation", 6).alias("activation"), "preview")


def terminal(path: DataFrame, most: int = 8) -> DataFrame:
    """(cue_id, previews): the different previews of a path in order, at most ``most``."""
    return path.filter("preview is not null").groupBy("cue_id").agg(F.slice(F.array_sort(F.collect_set("preview")), 1, most).alias("previews"))
