"""Usable vectors, their int8 codes and the exact k most similar by block matrix join.

``top_similar`` cuts the vectors into blocks and joins every pair of blocks
once.  A tile multiplies int8 codes (held in float32, where sums of 64 products
of 7-bit numbers are exact, so the matrix product runs in BLAS) and scales the
whole numbers by the rows' steps; the codes' residual norms bound the error.  Pairs that could reach the
threshold within that bound are computed again in float64, and each row keeps
a heap of its best k, merged over tiles.  The result is exact.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.sources.tables import materialize


def usable_array(c: Column, dim: int = 64) -> Column:
    """The vector has ``dim`` finite numbers, not all zero."""
    big = F.lit(3.5e38)
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) > big))
    return F.coalesce((F.size(c) == dim) & ~bad & F.exists(c, lambda x: x != 0), F.lit(False))


def from_arrays(df: DataFrame, id_col: str, vec: str, dim: int = 64) -> DataFrame:
    """(id, vec binary): little-endian float32 of the usable array vectors, scaled to length one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                v = np.stack(pdf["v"].to_numpy()).astype(np.float64)
                yield pd.DataFrame({"id": pdf["id"].to_numpy(), "vec": _unit_bytes(v)})

    kind = df.schema[id_col].dataType.simpleString()
    return df.filter(usable_array(F.col(vec), dim)).select(F.col(id_col).alias("id"), F.col(vec).alias("v")).mapInPandas(run, f"id {kind}, vec binary")


def from_blobs(df: DataFrame, id_col: str, vec: str, dim_col: str, dim: int = 64) -> DataFrame:
    """(id, vec binary) of blobs that declare and hold ``dim`` finite float32, not all zero."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                v = np.frombuffer(b"".join(bytes(x) for x in pdf["v"]), "<f4").reshape(-1, dim).astype(np.float64)
                ok = np.isfinite(v).all(1) & (v != 0).any(1)
                if ok.any():
                    yield pd.DataFrame({"id": pdf["id"].to_numpy()[ok], "vec": _unit_bytes(v[ok])})

    kind = df.schema[id_col].dataType.simpleString()
    return df.filter((F.col(dim_col) == dim) & (F.octet_length(vec) == 4 * dim) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec).alias("v")).mapInPandas(run, f"id {kind}, vec binary")


def _unit_bytes(v: np.ndarray) -> list[bytes]:
    v = v / np.abs(v).max(1, keepdims=True)
    return [r.tobytes() for r in (v / np.linalg.norm(v, axis=1, keepdims=True)).astype("<f4")]


def matrix(blobs, dim: int = 64) -> np.ndarray:
    return np.frombuffer(b"".join(bytes(b) for b in blobs), "<f4").reshape(-1, dim)


def int8_codes(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (int8), step and residual norm of unit vectors: v = code * step + residual."""
    step = np.abs(v).max(1) / 127.0
    code = np.rint(v / step[:, None]).astype(np.int8)
    err = np.linalg.norm(v.astype(np.float64) - code * step[:, None].astype(np.float64), axis=1)
    return code, step.astype(np.float32), (err + 1e-6).astype(np.float32)


class _Block:
    def __init__(self, ids: np.ndarray, blob: bytes, dim: int):
        self.ids, self.v = ids, np.frombuffer(blob, "<f4").reshape(-1, dim)
        code, self.step, self.err = int8_codes(self.v)
        self.code = code.astype(np.float32)


def _tile(a: _Block, b: _Block, same: bool, k: int, floor: float, heaps: dict) -> None:
    """Best pairs of one tile into ``heaps`` (id -> heap of (cosine, other id reversed))."""
    chunk = 2048
    b_err = float(b.err.max())
    # lower bounds of the k-th best cosine of each row of ``b`` over the chunks so far
    low_b = np.full(len(b.ids), -2.0, np.float32)
    for lo in range(0, len(a.ids), chunk):
        # whole numbers up to 64 * 127 * 127, exact in float32
        prod = a.code[lo : lo + chunk] @ b.code.T
        prod *= a.step[lo : lo + chunk, None]
        prod *= b.step
        n = prod.shape[0]
        if same:
            prod[np.arange(n), lo + np.arange(n)] = -3
        slack = a.err[lo : lo + n] * (1 + b_err) + b_err
        if floor > -1:
            i, j = np.nonzero(prod >= (floor - slack)[:, None])
        else:
            # a row's k-th best product less its error is a lower bound of its k-th best cosine
            kk = min(k, prod.shape[1])
            low_a = np.partition(prod, prod.shape[1] - kk, 1)[:, prod.shape[1] - kk] - slack
            keep = prod + slack[:, None] >= low_a[:, None]
            if not same:
                if n >= k:
                    np.maximum(low_b, np.partition(prod - slack[:, None], n - k, 0)[n - k], out=low_b)
                keep |= prod + slack[:, None] >= low_b
            i, j = np.nonzero(keep)
        if not len(i):
            continue
        cos = np.einsum("ij,ij->i", a.v[lo + i].astype(np.float64), b.v[j].astype(np.float64))
        ok = cos >= floor
        for x, y, c in zip(a.ids[lo + i[ok]].tolist(), b.ids[j[ok]].tolist(), cos[ok].tolist()):
            _push(heaps, x, y, c, k)
            if not same:
                _push(heaps, y, x, c, k)


class _Rev:
    """Orders ids downward, so that of equal cosines the smaller id stays in a heap."""

    __slots__ = ("x",)

    def __init__(self, x):
        self.x = x

    def __lt__(self, o):
        return self.x > o.x

    def __eq__(self, o):
        return self.x == o.x


def _push(heaps: dict, row, other, cos: float, k: int) -> None:
    h = heaps.setdefault(row, [])
    item = (round(cos, 9), _Rev(other))
    if len(h) < k:
        heapq.heappush(h, item)
    elif h[0] < item:
        heapq.heapreplace(h, item)


def top_similar(vectors: DataFrame, k: int, floor: float = -1.0, dim: int = 64, block_rows: int = 8192) -> DataFrame:
    """(id, other, cosine): the k most similar other vectors of every vector, of cosine ``floor`` or more.

    vectors: id (unique, not null), vec as from_arrays/from_blobs.  Of equal
    cosines (to nine digits) the smaller id comes first.  Fewer than two
    vectors give an empty result.
    """
    kind = vectors.schema["id"].dataType.simpleString()
    vectors = materialize(vectors, "vectors")
    n = vectors.count()
    blocks = max(1, -(-n // block_rows))

    def pack(key, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": [key[0]], "ids": [pdf["id"].tolist()], "vecs": [b"".join(bytes(x) for x in pdf["vec"])]})

    packed = vectors.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).groupBy("block").applyInPandas(pack, f"block int, ids array<{kind}>, vecs binary")
    packed = materialize(packed, "blocks")
    # pairs of blocks are numbered, never pairs of rows: blocks * (blocks + 1) / 2 tiles
    ids = vectors.sparkSession.range(blocks).select(F.col("id").cast("int").alias("x"))
    pairs = ids.select("x", F.explode(F.sequence(F.col("x"), F.lit(blocks - 1))).alias("y"))
    tiles = pairs.join(packed.toDF("x", "x_ids", "x_vecs"), "x").join(packed.toDF("y", "y_ids", "y_vecs"), "y")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                heaps: dict = {}
                a = _Block(np.asarray(r.x_ids), bytes(r.x_vecs), dim)
                b = a if r.x == r.y else _Block(np.asarray(r.y_ids), bytes(r.y_vecs), dim)
                _tile(a, b, r.x == r.y, k, floor, heaps)
                out = [(i, o.x, c) for i, h in heaps.items() for c, o in h]
                yield pd.DataFrame(out, columns=["id", "other", "cosine"])

    spark = vectors.sparkSession
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        tiles_n = blocks * (blocks + 1) // 2
        # at most eight tiles a task, whatever the number of rows
        width = max(1, min(tiles_n, max(4 * spark.sparkContext.defaultParallelism, -(-tiles_n // 8))))
        best = materialize(tiles.repartition(width, "x", "y").mapInPandas(run, f"id {kind}, other {kind}, cosine double"), "best")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    top = best.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("cosine")).alias("c"), "other"))), 1, k).alias("t"))
    return top.select("id", F.explode("t").alias("t")).select("id", F.col("t.other").alias("other"), (-F.col("t.c")).alias("cosine"))


def similar_pairs(top: DataFrame) -> DataFrame:
    """Unordered pairs (a, b, cosine), smaller id first, of a ``top_similar`` result."""
    return top.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"), "cosine").groupBy("a", "b").agg(F.max("cosine").alias("cosine"))
