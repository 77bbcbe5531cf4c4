"""Folds over the event log: modulators, stages, sleeps, salience decay, counters.

A fold is ordered by nature: the events of a key pass one after the other
through a small state.  They stream through a task in batches, sorted by the
key's ticks, so a key of any length needs no more memory than its state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.functions import stages as S
from memloom.operators.order import numbered


def ticks(events: DataFrame, key: str = "user_id") -> DataFrame:
    """Events with their logical tick: the place in the log of their key, numbered without sorting a key in one task."""
    return numbered(events, key, ["ts", "event_id"], "tick")


def fold(events: DataFrame, key: str, columns: list[str], start: Callable, step: Callable, out: str) -> DataFrame:
    """Rows that ``step(state, values)`` yields for the events of each key in order of their tick.

    ``start()`` makes a key's state; ``columns`` are the event columns ``step``
    gets; ``out`` is the schema of its tuples, key first.
    """
    names = [c.split()[0] for c in out.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state, first = None, None, True
        for pdf in batches:
            rows = []
            for k, *values in zip(*(pdf[c].tolist() for c in (key, *columns))):
                if first or k != last:
                    last, state, first = k, start(), False
                rows += [(k, *r) for r in step(state, values)]
            yield pd.DataFrame(rows, columns=names)

    return events.select(key, *columns).repartition(key).sortWithinPartitions(key, "tick").mapInPandas(run, out)


def _kind(df: DataFrame, c: str) -> str:
    return df.schema[c].dataType.simpleString()


def modulators(events: DataFrame, key: str = "user_id") -> DataFrame:
    """(key, event_id, dopamine, acetylcholine, norepinephrine): levels before each event.

    ``reward`` (null: none) adds a fifth of itself to dopamine, ``surprise`` a
    quarter to norepinephrine and a tenth to acetylcholine, all cut at 0 and 1;
    an event that ``sleeps`` then damps the first two and lifts the third.
    """
    m = S.MODULATORS
    cut = lambda x: max(0.0, min(1.0, x))

    def step(st, v):
        _, event, reward, surprise, sleeps = v
        yield event, st["d"], st["a"], st["n"]
        if reward is not None and reward == reward:
            st["d"] = cut(st["d"] + 0.2 * reward)
        if surprise is not None and surprise == surprise:
            st["n"], st["a"] = cut(st["n"] + 0.25 * surprise), cut(st["a"] + 0.1 * surprise)
        if sleeps:
            st["d"], st["n"], st["a"] = st["d"] * 0.85, st["n"] * 0.7, min(1.0, st["a"] + 0.05)

    return fold(events, key, ["tick", "event_id", "reward", "surprise", "sleeps"], lambda: {"d": m["dopamine"], "a": m["acetylcholine"], "n": m["norepinephrine"]}, step, f"{key} {_kind(events, key)}, event_id long, dopamine double, acetylcholine double, norepinephrine double")


def stage_timeline(events: DataFrame, key: str = "user_id") -> DataFrame:
    """(key, tick, stage, experiences, sleeps, pruned) after every event: at most one stage is entered per event, when rows, sleeps, ticks and pruned edges suffice."""
    needs = [r[5:9] for r in S.STAGES]

    def step(st, v):
        tick, experience, sleeps, pruned = v
        st["x"] += bool(experience)
        st["s"] += bool(sleeps)
        st["p"] += int(pruned or 0)
        if st["stage"] + 1 < len(needs):
            x, s, t, p = needs[st["stage"] + 1]
            if st["x"] >= x and st["s"] >= s and tick >= t and st["p"] >= p:
                st["stage"] += 1
        yield tick, st["stage"], st["x"], st["s"], st["p"]

    return fold(events, key, ["tick", "experience", "sleeps", "pruned"], lambda: {"x": 0, "s": 0, "p": 0, "stage": 0}, step, f"{key} {_kind(events, key)}, tick long, stage int, experiences long, sleeps long, pruned long")


def stage_report(timeline: DataFrame, key: str = "user_id", edges: int = 0) -> DataFrame:
    """The last state of each key with its stage's table row, pressure of ``edges`` and progress to the next stage."""
    last = timeline.groupBy(key).agg(F.max(F.struct("tick", "stage", "experiences", "sleeps", "pruned")).alias("z")).select(key, "z.*")
    stages = S.stage_table(timeline.sparkSession)
    need = stages.select((F.col("stage") - 1).alias("stage"), F.col("name").alias("next_stage"), F.col("need_rows").alias("_x"), F.col("need_sleeps").alias("_s"), F.col("need_ticks").alias("_t"))
    # seven stages
    r = last.join(F.broadcast(stages.select("stage", "name", "spread", "prune", "max_edges")), "stage").join(F.broadcast(need), "stage", "left")
    part = lambda x, n: F.least(F.lit(1.0), F.col(x) / F.greatest(F.col(n), F.lit(1)))
    p = F.when(F.col("next_stage").isNull(), 1.0).otherwise((part("experiences", "_x") + part("sleeps", "_s") + part("tick", "_t")) / 3)
    return r.withColumn("progress", p).withColumn("pressure", F.least(F.lit(1.0), F.lit(edges) / F.col("max_edges"))).drop("_x", "_s", "_t")


def auto_sleeps(events: DataFrame, key: str = "user_id", interval: int = S.SLEEP_INTERVAL, window: int = S.SLEEP_WINDOW, most: int = S.SLEEPS_PER_WINDOW, pressure: float = 0.0) -> DataFrame:
    """(key, tick, since, in_window, slept) of every tick: a sleep falls due ``interval`` ticks after the last, at most ``most`` per window; pressure at the limit always sleeps."""

    def step(st, v):
        (tick,) = v
        st["since"] += 1
        if tick - st["from"] >= window:
            st["from"], st["n"] = tick, 0
        pressed = pressure >= S.SLEEP_PRESSURE
        slept = pressed or (st["since"] >= interval and st["n"] < most)
        if slept:
            st["since"], st["n"] = 0, st["n"] + 1
        yield tick, st["since"], st["n"], slept

    return fold(events, key, ["tick"], lambda: {"since": 0, "from": 0, "n": 0}, step, f"{key} {_kind(events, key)}, tick long, since long, in_window int, slept boolean")


def salience_decay(rows: DataFrame, sleeps: int) -> DataFrame:
    """(engram_id, weight): salience less one hundredth per sleep; weights at or under one hundredth are dropped."""
    w = F.round(F.col("salience").cast("double"), 6) - S.DECAY * sleeps
    return rows.filter("salience is not null").select("engram_id", w.alias("weight")).filter(F.col("weight") > S.DECAY + 1e-9)


def quota(rows: DataFrame, limit: int = S.QUOTA_ROWS) -> DataFrame:
    """(tenant_id, rows, over): stored rows by tenant against the quota."""
    return rows.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("rows")).withColumn("over", F.col("rows") > limit)


def tag_weights(tags: DataFrame, key: str, sleeps: int = 0) -> DataFrame:
    """(key, weight): tags of a key after ``sleeps`` decays, summed and cut at one; tags at or under one hundredth are gone."""
    w = F.round(F.col("weight").cast("double"), 6) - S.DECAY * sleeps
    live = tags.select(key, w.alias("w")).filter((F.col("w") > S.DECAY + 1e-9) | F.lit(sleeps == 0))
    return live.groupBy(key).agg(F.least(F.lit(1.0), F.sum("w")).alias("weight"))
