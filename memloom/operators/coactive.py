"""Wired edges and the rows in which both their ends are active, over compact blocks of numbers.

The features of a row are made in the tasks from its words, twice: once for the edges and
once for an index, in blocks of INDEX_ROWS rows, of the features that are ends of edges.  Edges then meet
the index block by block where they lie, so no feature of a row becomes a table row or moves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.functions import stages as S
from memloom.functions.text import words
from memloom.sources.tables import read_shared, spread, write_shared

try:
    from _md5 import md5
except ImportError:
    from hashlib import md5

#: Rows whose features are made together, rows of a block, edges that meet it at once, pairs of edge and row at once; from so many rows of a block on, a feature is looked up by bits.
STEP_ROWS, INDEX_ROWS, CHUNK_EDGES, CHUNK_PAIRS, HEAVY = 1000, 65_536, 2_000_000, 2_000_000, 512
INDEX_SCHEMA = "nodes binary, ptr binary, rows binary, gates binary"


def texts(rows: DataFrame, life: str, **more: Column) -> DataFrame:
    """``more``, the row's life and the words of its fields and of its summary, by blanks: all that its tokens are made of (see ``functions.text.rich_tokens``)."""
    life_of = F.coalesce(F.col(life), F.lit("")) if life in rows.columns else F.lit(life)
    of = {"content": F.col("content"), "context": F.col("context"), "outcome": F.col("outcome"), "summary": F.substring(F.coalesce(F.col("content"), F.lit("")), 1, 48)}
    return spread(rows).select(*(c.alias(n) for n, c in more.items()), life_of.alias("life"), *(F.array_join(words(c), " ").alias(n) for n, c in of.items()))


def _tokens(life: str, content: str, context: str, outcome: str, summary: str) -> set[str]:
    """The tokens of a row, each after its life."""
    c, x = content.split(), context.split()
    pairs = [f"{a}_{b}" for a, b in zip(c, c[1:])]
    out = {f"{life}|c:{w}" for w in c}
    out.update([f"{life}|x:{w}" for w in x], [f"{life}|o:{w}" for w in outcome.split()], [f"{life}|bg:c:{w}" for w in pairs], [f"{life}|tg:c:{w}_{z}" for w, z in zip(pairs, c[2:])])
    out.add(f"{life}|ctx@{'_'.join(x[:6])}")
    out.add(f"{life}|sum@{'_'.join(summary.split()[:6])}")
    return out


def _distinct(x: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists with ends ``ptr`` in ``x``, each sorted and without repeats, and their ends."""
    at = ptr.tolist()
    for a, b in zip(at, at[1:]):
        x[a:b].sort()
    new = np.append(True, x[1:] != x[:-1])[: len(x)]
    new[ptr[:-1][ptr[:-1] < ptr[1:]]] = True
    return x[new], np.concatenate([[0], np.cumsum(new)])[ptr]


def features(rows: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Granules and bound features of rows by their ``texts``, each with the ends of its lists, some rows at a time (see ``functions.features``)."""
    for lo in range(0, rows.num_rows, STEP_ROWS):
        part = rows.slice(lo, STEP_ROWS)
        of = [_tokens(*t) for t in zip(*(part[c].to_pylist() for c in ("life", "content", "context", "outcome", "summary")))]
        ptr = np.concatenate([[0], np.cumsum([len(ts) for ts in of])])
        half = np.frombuffer(b"".join([md5(t.encode()).digest() for ts in of for t in ts]), ">u8").astype(np.uint64).reshape(-1, 2)
        both = np.stack([half[:, 0] >> np.uint64(4), (half[:, 0] & np.uint64(15)) << np.uint64(56) | half[:, 1] >> np.uint64(8)], 1)
        dg, ends = _distinct(both.astype(np.int64).ravel(), 2 * ptr)
        names = [str(x) for x in dg.tolist()]
        pairs = np.frombuffer(b"".join([md5(f"{a}|{b}".encode()).digest() for a, b in zip(names, names[1:])]), ">u8")[::2]
        pairs = np.append((pairs.astype(np.uint64) >> np.uint64(4)).astype(np.int64), 0)[: len(dg)]
        # every granule but a row's last has a pair
        size = np.diff(ends)
        inner = np.ones(len(dg), bool)
        inner[ends[1:][size > 0] - 1] = False
        starts = np.concatenate([[0], np.cumsum(size + np.maximum(size - 1, 0))])
        row = np.repeat(np.arange(len(size)), size)
        ca3 = np.empty(starts[-1], np.int64)
        place = np.arange(len(dg)) - ends[:-1][row] + starts[:-1][row]
        ca3[place] = dg
        ca3[(place + size[row])[inner]] = pairs[inner]
        yield dg, ends, *_distinct(ca3, starts)


def _first(x: np.ndarray, ends: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``k`` elements of every list as a matrix, and which there are."""
    at = ends[:-1, None] + np.arange(k)
    there = at < ends[1:, None]
    return np.append(x, 0)[np.where(there, at, len(x))], there


def wired(rows: DataFrame, stage: int = 2, life: str = "life_id") -> DataFrame:
    """(src, dst, weight): the edges of ``graph.wiring``, made in the tasks; an edge may stand several times."""
    clique, dg_links, ca3_links = S.STAGES[stage][9:12]
    i, j = np.triu_indices(clique + 1, 1)

    def run(batches):
        for b in batches:
            for dg, ends, ca3, bound_ends in features(b):
                parts = []
                for x, e, k, left, right, w in (
                    (ca3, bound_ends, clique + 1, i, j, S.CLIQUE_WEIGHT),
                    (dg, ends, dg_links + 1, np.arange(dg_links), np.arange(1, dg_links + 1), S.CHAIN_WEIGHT),
                    (ca3, bound_ends, ca3_links + 1, np.arange(ca3_links), np.arange(1, ca3_links + 1), S.BOUND_WEIGHT),
                ):
                    m, there = _first(x, e, k)
                    ok = there[:, right]
                    parts.append((m[:, left][ok], m[:, right][ok], np.full(int(ok.sum()), w)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], ["src", "dst", "weight"])

    return texts(rows, life).mapInArrow(run, "src long, dst long, weight double")


def _ends(edges: DataFrame, bits: int) -> str:
    """Path of the last ``bits`` bits of all ends of edges."""

    def run(batches):
        for b in batches:
            ends = np.concatenate([b[c].to_numpy(zero_copy_only=False) for c in ("src", "dst")])
            yield pa.RecordBatch.from_arrays([pa.array([np.unique(ends & ((1 << bits) - 1)).astype(np.uint32).tobytes()], pa.binary())], ["slots"])

    return write_shared(edges.select("src", "dst").mapInArrow(run, "slots binary"), "ends")


def _table(path: str, bits: int) -> np.ndarray:
    out = np.zeros(1 << (bits - 3), np.uint8)
    for b in read_shared(path):
        for x in b["slots"]:
            s = np.frombuffer(x.as_buffer(), np.uint32)
            byte, bit = s >> 3, np.left_shift(1, s & 7).astype(np.uint8)
            new = np.flatnonzero(np.append(True, byte[1:] != byte[:-1])[: len(s)])
            if len(new):
                out[byte[new]] |= np.bitwise_or.reduceat(bit, new)
    return out


def _block(parts: list) -> pa.RecordBatch:
    node, row, gates = (np.concatenate(x) for x in zip(*parts))
    o = np.argsort(node, kind="stable")
    node, row = node[o], row[o]
    first = np.flatnonzero(np.append(True, node[1:] != node[:-1])[: len(node)])
    cols = [node[first], np.append(first, len(node)).astype(np.uint32), row, gates]
    return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in cols], [c.split()[0] for c in INDEX_SCHEMA.split(", ")])


def _index(rows: DataFrame, gate: Column, life: str, ends: str, bits: int) -> str:
    """Path of the index of the rows' features that may be ends of edges; a few others are in it by chance and meet no edge."""

    def run(batches):
        table, parts, n = _table(ends, bits), [], 0
        for b in batches:
            gates = b["gate"].to_numpy(zero_copy_only=False)
            lo = 0
            for _, _, x, at in features(b):
                k = len(at) - 1
                if n and n + k > INDEX_ROWS:
                    yield _block(parts)
                    parts, n = [], 0
                slot = x & ((1 << bits) - 1)
                known = np.flatnonzero(table[slot >> 3] >> (slot & 7).astype(np.uint8) & 1)
                parts.append((x[known], (n + np.searchsorted(at, known, "right") - 1).astype(np.uint16), gates[lo : lo + k]))
                n, lo = n + k, lo + k
        if n:
            yield _block(parts)

    return write_shared(texts(rows.filter("engram_id is not null"), life, gate=gate).mapInArrow(run, INDEX_SCHEMA), "index")


def _meet(src: np.ndarray, dst: np.ndarray, n: np.ndarray, gain: np.ndarray, x: dict) -> None:
    """Add the rows of a block to the numbers and gains of edges, which stand in the order of ``src``."""
    nodes, ptr, rows, gates = (np.frombuffer(x[c], kind) for c, kind in (("nodes", np.int64), ("ptr", np.uint32), ("rows", np.uint16), ("gates", float)))
    if not len(nodes):
        return

    def find(xs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(nodes, xs), len(nodes) - 1)
        return at, nodes[at] == xs

    at, there = find(src)
    e = np.flatnonzero(there)
    p = at[e]
    q, there = find(dst[e])
    e, p, q = e[there], p[there], q[there]
    df = np.diff(ptr.astype(np.int64))
    few, many = np.where(df[p] <= df[q], p, q), np.where(df[p] <= df[q], q, p)
    # an end in many rows is looked up by bits, others among all pairs of feature and row
    heavy = np.unique(many[df[many] >= HEAVY])
    bits = np.zeros((len(heavy), INDEX_ROWS // 8), np.uint8)
    mark = np.zeros(INDEX_ROWS, bool)
    for h, u in enumerate(heavy.tolist()):
        r = rows[ptr[u] : ptr[u + 1]]
        mark[r] = True
        bits[h] = np.packbits(mark, bitorder="little")
        mark[r] = False
    keys = np.repeat(np.arange(len(nodes)), df) << 16 | rows
    size = df[few]
    total = np.concatenate([[0], np.cumsum(size)])
    lo = 0
    while lo < len(e):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + CHUNK_PAIRS, "right")) - 1)
        k = size[lo:hi]
        edge = np.repeat(np.arange(lo, hi), k)
        row = rows[np.arange(total[hi] - total[lo]) + np.repeat(ptr[few[lo:hi]] - (total[lo:hi] - total[lo]), k)]
        other = many[edge]
        ok = np.zeros(len(edge), bool)
        by_bits = df[other] >= HEAVY
        r = row[by_bits]
        ok[by_bits] = bits[np.searchsorted(heavy, other[by_bits]), r >> 3] >> (r & 7).astype(np.uint8) & 1
        rest = np.flatnonzero(~by_bits)
        key = other[rest] << 16 | row[rest]
        ok[rest] = keys[np.minimum(np.searchsorted(keys, key), len(keys) - 1)] == key
        edge, row = edge[ok] - lo, row[ok]
        n[e[lo:hi]] += np.bincount(edge, minlength=hi - lo)
        gain[e[lo:hi]] += np.bincount(edge, gates[row], hi - lo)
        lo = hi


def co_active(edges: DataFrame, rows: DataFrame, gate: Column, life: str = "life_id") -> DataFrame:
    """``edges`` with n, the number of rows in which both ends are bound features, and gain, the sum of those rows' gates; both zero where there is none.

    A row stands for itself: ids are not compared, rows without one do not count.
    """
    bits = min(30, max(16, (32 * edges.count()).bit_length()))
    path = _index(rows, gate, life, _ends(edges, bits), bits)

    def run(batches):
        held, m = [], 0

        def done():
            t = pa.Table.from_batches(held)
            t = t.take(pa.array(np.argsort(t["src"].to_numpy())))
            src, dst = t["src"].to_numpy(), t["dst"].to_numpy()
            n, gain = np.zeros(len(src), np.int64), np.zeros(len(src))
            for b in read_shared(path):
                for x in b.to_pylist():
                    _meet(src, dst, n, gain, x)
            return t.append_column("n", pa.array(n)).append_column("gain", pa.array(gain)).to_batches(100_000)

        for b in batches:
            held.append(b)
            m += b.num_rows
            if m >= CHUNK_EDGES:
                yield from done()
                held, m = [], 0
        if m:
            yield from done()

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in edges.schema)
    return spread(edges).mapInArrow(run, f"{kinds}, n long, gain double")
