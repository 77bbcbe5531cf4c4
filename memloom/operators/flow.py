"""Propagation along weighted edges inside the tasks: each holds the graph as arrays and takes its cues one after another."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.functions import stages as S
from memloom.sources.tables import read_shared, write_shared

#: Edges that a task holds as arrays (about 50 bytes each while they are read); larger graphs go by joins.
MAX_GRAPH_EDGES = 20_000_000


class Graph:
    """Edges by source, and one activation at a time."""

    def __init__(self, path: str):
        parts = [[b[c].to_numpy(zero_copy_only=False) for c in ("src", "dst", "weight")] for b in read_shared(path)]
        src, dst, self.weight = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, (np.int64, np.int64, float)[i]) for i in range(3))
        self.nodes = np.unique(np.concatenate([src, dst]))
        src = np.searchsorted(self.nodes, src)
        o = np.argsort(src, kind="stable")
        self.dst, self.weight = np.searchsorted(self.nodes, dst[o]).astype(np.int32), self.weight[o]
        self.n = len(self.nodes)
        self.count = np.bincount(src, minlength=self.n)
        self.first = np.concatenate([[0], np.cumsum(self.count)])[: self.n]
        self.largest = np.zeros(self.n)
        np.maximum.at(self.largest, src[o], self.weight)
        self.act = np.zeros(self.n)

    def at(self, nodes: np.ndarray) -> np.ndarray:
        """Numbers of nodes, -1 for those without an edge."""
        if not self.n:
            return np.full(len(nodes), -1)
        p = np.minimum(np.searchsorted(self.nodes, nodes), self.n - 1)
        return np.where(self.nodes[p] == nodes, p, -1)

    def run(self, nodes: np.ndarray, start: np.ndarray, factor: float, hops: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of active nodes (their values are in ``act`` until ``clear``), and active nodes outside the graph with their values."""
        p = self.at(nodes)
        out = p < 0
        active = p[~out]
        self.act[active] = start[~out]
        for _ in range(hops):
            # the strongest edge of a source tells whether any of its edges can count
            src = active[self.act[active] * self.largest[active] * factor > S.MIN_DELTA]
            n = self.count[src]
            total = int(n.sum())
            e = np.repeat(self.first[src] - np.concatenate([[0], np.cumsum(n)[:-1]]) if len(src) else src, n) + np.arange(total)
            value = np.repeat(self.act[src], n) * self.weight[e] * factor
            ok = value > S.MIN_DELTA
            d, value = self.dst[e[ok]], value[ok]
            np.add.at(self.act, d, value)
            active = np.unique(np.concatenate([active, d])) if 20 * (len(d) + len(active)) < self.n else np.flatnonzero(self.act)
            fades = self.act[active] <= S.ACTIVATION_FLOOR
            self.act[active[fades]] = 0.0
            active = active[~fades]
        stay = start[out] > S.ACTIVATION_FLOOR if hops else np.ones(int(out.sum()), bool)
        return active, nodes[out][stay], start[out][stay]

    def clear(self, active: np.ndarray) -> None:
        self.act[active] = 0.0


def _cues(b: pa.RecordBatch) -> Iterator[tuple]:
    for c, xs in zip(b["cue_id"].to_pylist(), b["seeds"]):
        s = xs.values
        yield c, s.field("node").to_numpy(zero_copy_only=False), s.field("activation").to_numpy(zero_copy_only=False)


def by_cue(seeds: DataFrame) -> DataFrame:
    """(cue_id, seeds): a cue's nodes and their activations as one list."""
    return seeds.groupBy("cue_id").agg(F.collect_list(F.struct("node", F.col("activation").cast("double").alias("activation"))).alias("seeds"))


def propagate(seeds: DataFrame, path: str, factor: float, hops: int) -> DataFrame:
    """(cue_id, node, activation) after ``hops`` rounds over the edges at ``path``."""

    def run(batches):
        g = None
        for b in batches:
            g = g or Graph(path)
            for c, nodes, start in _cues(b):
                active, others, values = g.run(nodes, start, factor, hops)
                ids, value = np.concatenate([g.nodes[active], others]), np.concatenate([g.act[active], values])
                g.clear(active)
                yield pa.RecordBatch.from_arrays([pa.array([c] * len(ids), b["cue_id"].type), pa.array(ids), pa.array(value)], ["cue_id", "node", "activation"])

    kind, node = (seeds.schema[c].dataType.simpleString() for c in ("cue_id", "node"))
    return by_cue(seeds).repartition(2 * seeds.sparkSession.sparkContext.defaultParallelism).mapInArrow(run, f"cue_id {kind}, node {node}, activation double")


def energies(seeds: DataFrame, path: str, factor: float, hops: int, pairs: DataFrame, bound: DataFrame) -> DataFrame:
    """(cue_id, engram_id, energy): activation after ``hops`` rounds, summed over the features ``fs`` of a row, for ``pairs`` only.

    Of the rows' features a task keeps those that an edge or one of its cues has; the others have no activation.
    """
    rows = write_shared(bound.select("engram_id", "fs"), "features")
    mine = pairs.groupBy("cue_id").agg(F.collect_list("engram_id").alias("rows"))
    kind = seeds.schema["cue_id"].dataType.simpleString()

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        g = Graph(path)
        # seeds that no edge has get numbers after the nodes of the graph
        own = np.unique(np.concatenate([nodes for b in held for _, nodes, _ in _cues(b)]))
        own = own[g.at(own) < 0]
        extra = np.zeros(len(own))
        need = {x for b in held for xs in b["rows"].to_pylist() for x in xs}
        of: dict = {}
        for b in read_shared(rows):
            ends = b["fs"].offsets.to_numpy().tolist()
            flat = b["fs"].values.to_numpy(zero_copy_only=False)
            p = g.at(flat)
            if len(own):
                q = np.minimum(np.searchsorted(own, flat), len(own) - 1)
                p = np.where(p < 0, np.where(own[q] == flat, g.n + q, -1), p)
            for i, x in enumerate(b["engram_id"].to_pylist()):
                if x in need:
                    v = p[ends[i] : ends[i + 1]]
                    of[x] = v[v >= 0].astype(np.int32)
        for b in held:
            lists = b["rows"].to_pylist()
            for (c, nodes, start), xs in zip(_cues(b), lists):
                active, others, values = g.run(nodes, start, factor, hops)
                q = np.searchsorted(own, others)
                extra[q] = values
                got = []
                for x in xs:
                    v = of.get(x, active[:0])
                    inside = v < g.n
                    got.append(float(g.act[v[inside]].sum() + extra[v[~inside] - g.n].sum()))
                extra[q] = 0.0
                g.clear(active)
                yield pa.RecordBatch.from_arrays([pa.array([c] * len(xs), b["cue_id"].type), pa.array(xs, pa.string()), pa.array(got, pa.float64())], ["cue_id", "engram_id", "energy"])

    j = by_cue(seeds).join(mine, "cue_id").repartition(2 * seeds.sparkSession.sparkContext.defaultParallelism)
    return j.mapInArrow(run, f"cue_id {kind}, engram_id string, energy double")
