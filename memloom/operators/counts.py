"""Best rows of many cues by shared words, and shared elements of given pairs, over compact blocks of numbers.

Rows are put in the order of their ids and written once as an index: blocks of
INDEX_ROWS rows, each with its words' hashes and, by word, the rows that hold
it.  Cues are spread over the tasks; a task reads the index block by block from
the shared folder and counts for one cue over a whole block at a time, so no
pair of cue and row ever becomes a table row.  Words count by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from memloom.functions.text import words
from memloom.sources.tables import read_shared, write_shared

INDEX_ROWS, GROUP_BLOCKS, CHUNK_CUES, SET_CUES = 65_536, 32, 16_384, 131_072
#: A word in more than one of DENSE rows of a block is added as a whole vector; scores are bounded in steps of STEP.
DENSE, STEP = 40, 1 / 128
#: At most so many words of a chunk's cues are put together, into at most so many phrases.
PHRASE_WORDS, PHRASES = 1024, 512
INDEX_SCHEMA = "ids array<string>, lens binary, agents binary, words binary, ptr binary, rows binary, times binary"


def hashed(ws: Column) -> Column:
    return F.transform(ws, lambda w: F.xxhash64(w))


def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    """Elements and starts of a column of lists of numbers."""
    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lens = c.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return c.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lens)]).astype(np.int64)


def token_words(content: Column, context: Column, outcome: Column) -> Column:
    """Hashes of the words of a row's fields and of its summary, of which ``token_lists`` makes its tokens."""
    of = {"c": words(content), "x": words(context), "o": words(outcome), "s": F.slice(words(F.substring(F.coalesce(content, F.lit("")), 1, 48)), 1, 6)}
    return F.struct(*(hashed(c).alias(n) for n, c in of.items()))


def _mix(a, b) -> np.ndarray:
    """A hash of two hashes, in this order."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x = (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(32)


def token_lists(column) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of ``functions.text.rich_tokens`` and the starts of rows, from ``token_words``; a token may stand twice in its row."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    (c, cp), (x, xp), (o, op), (s, sp) = ((f.astype(np.int64).view(np.uint64), p) for f, p in map(_lists, column.flatten()))
    of = lambda p: np.repeat(np.arange(n), np.diff(p))
    row = of(cp)
    two, three = _mix(c[:-1], c[1:]), _mix(_mix(c[:-2], c[1:-1]), c[2:])
    in_two, in_three = row[1:] == row[:-1], row[2:] == row[:-2]
    parts = [(c, row), (x, of(xp)), (o, of(op)), (two[in_two], row[:-1][in_two]), (three[in_three], row[:-2][in_three])]
    for f, p in ((x, xp), (s, sp)):
        # the first six words in order
        slug = np.zeros(n, np.uint64)
        for k in range(6):
            has = np.flatnonzero(np.diff(p) > k)
            slug[has] = _mix(slug[has], f[p[has] + k])
        parts.append((slug, np.arange(n)))
    flat = np.concatenate([_mix(f, np.uint64(kind + 1)) for kind, (f, _) in enumerate(parts)])
    rows = np.concatenate([r for _, r in parts])
    o = np.argsort(rows.astype(np.uint16) if n <= 65_536 else rows, kind="stable")
    return flat[o].view(np.int64), np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))]).astype(np.int64)


def token_sets(cues: DataFrame, ws: Column) -> DataFrame:
    """(cue_id, fs): hashes of the tokens of every cue, each once, from ``token_words``."""

    def run(batches):
        for b in batches:
            flat, ptr = token_lists(b["ws"])
            row = np.repeat(np.arange(b.num_rows), np.diff(ptr))
            o = np.lexsort((flat, row))
            flat, row = flat[o], row[o]
            new = np.append(True, (flat[1:] != flat[:-1]) | (row[1:] != row[:-1]))[: len(flat)]
            ends = np.concatenate([[0], np.cumsum(np.bincount(row[new], minlength=b.num_rows))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b["cue_id"], pa.ListArray.from_arrays(pa.array(ends), pa.array(flat[new]))], ["cue_id", "fs"])

    return cues.select("cue_id", ws.alias("ws")).mapInArrow(run, f"cue_id {cues.schema['cue_id'].dataType.simpleString()}, fs array<bigint>")


def _postings(t: pa.Table) -> pa.RecordBatch:
    flat, at = _lists(t["ws"])
    row = np.repeat(np.arange(t.num_rows), np.diff(at))
    o = np.argsort(flat, kind="stable")
    flat, row = flat[o], row[o]
    new = np.flatnonzero(np.append(True, (flat[1:] != flat[:-1]) | (row[1:] != row[:-1]))[: len(flat)])
    times, flat, row = np.diff(np.append(new, len(flat))), flat[new], row[new]
    first = np.flatnonzero(np.append(True, flat[1:] != flat[:-1])[: len(flat)])
    agents = t["agent"].combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64)
    parts = [np.diff(at).astype(np.uint32), agents, flat[first], np.append(first, len(flat)).astype(np.uint32), row.astype(np.uint16), times.astype(np.uint32)]
    ids = pa.array([t["id"].to_pylist()], pa.list_(pa.string()))
    return pa.RecordBatch.from_arrays([ids, *(pa.array([x.tobytes()], pa.binary()) for x in parts)], [c.split()[0] for c in INDEX_SCHEMA.split(", ")])


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        while n >= INDEX_ROWS:
            t = pa.Table.from_batches(held)
            yield _postings(t.slice(0, INDEX_ROWS))
            held = t.slice(INDEX_ROWS).to_batches()
            n -= INDEX_ROWS
    if n:
        yield _postings(pa.Table.from_batches(held))


def word_index(rows: DataFrame, ws: Column, agent: Column | None = None, id_col: str = "engram_id") -> str:
    """Path of the index of ``rows`` by the words ``ws``."""
    r = rows.select(F.col(id_col).alias("id"), hashed(ws).alias("ws"), F.lit(0).cast("long").alias("agent") if agent is None else F.xxhash64(agent).alias("agent"))
    s = r.repartitionByRange("id").sortWithinPartitions("id")
    return write_shared(s.mapInArrow(_encode, INDEX_SCHEMA), "index")


class _Block:
    """A block of the index, with the words of a chunk of cues (sorted hashes ``known``) looked up."""

    def __init__(self, x: dict, known: np.ndarray):
        self.lens, self.agents = np.frombuffer(x["lens"], np.uint32), np.frombuffer(x["agents"], np.int64)
        words, ptr = np.frombuffer(x["words"], np.int64), np.frombuffer(x["ptr"], np.uint32)
        rows, times = np.frombuffer(x["rows"], np.uint16), np.frombuffer(x["times"], np.uint32)
        self.n = len(self.lens)
        at = np.searchsorted(words, known)
        here = np.flatnonzero((at < len(words)) & (words[np.minimum(at, len(words) - 1)] == known)) if len(words) else np.zeros(0, int)
        self.rows, self.times = {}, {}
        for u, p in zip(here.tolist(), at[here].tolist()):
            self.rows[u], self.times[u] = rows[ptr[p] : ptr[p + 1]].astype(np.int64), times[ptr[p] : ptr[p + 1]]

    def vectors(self, value: Callable, kind, phrases: list) -> dict:
        """By word the values of all rows where it is frequent, and by phrase the sums of its parts; ``value`` gives those of the rows that hold a word."""
        out, most, known = {}, {}, {x for _, parts in phrases for x in parts}
        for u, r in self.rows.items():
            if len(r) * DENSE > self.n or u in known:
                x = value(u)
                most[u] = int(np.max(x))
                out[u] = np.zeros(self.n, kind if most[u] <= np.iinfo(kind).max else np.uint32)
                out[u][r] = x
        for number, parts in phrases:
            here = [x for x in parts if x in out]
            if here:
                most[number] = sum(most[x] for x in here)
                wide = kind if most[number] <= np.iinfo(kind).max else np.uint32
                out[number] = np.add(out[here[0]], out[here[1]], dtype=wide, casting="unsafe") if len(here) > 1 else out[here[0]]
        return out

    def by_row(self, values: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts of the rows, and the words of each, in order, with their ``values``."""
        us = sorted(self.rows)
        row = np.concatenate([self.rows[u] for u in us] or [np.zeros(0, np.int64)])
        o = np.argsort(row.astype(np.uint16), kind="stable")
        word = np.repeat(np.array(us, np.int32), [len(self.rows[u]) for u in us])[o]
        value = np.concatenate([values[u] for u in us] or [np.zeros(0)])[o]
        return np.concatenate([[0], np.cumsum(np.bincount(row, minlength=self.n))]), word, value


def _numbers(path: str, known: np.ndarray) -> tuple[int, float, np.ndarray]:
    """Rows, mean number of words and how many rows hold each word."""
    n, total, df = 0, 0, np.zeros(len(known), np.int64)
    for b in read_shared(path, ["lens", "words", "ptr"]):
        for x in b.to_pylist():
            lens, words, ptr = np.frombuffer(x["lens"], np.uint32), np.frombuffer(x["words"], np.int64), np.frombuffer(x["ptr"], np.uint32)
            n, total = n + len(lens), total + int(lens.sum())
            at = np.searchsorted(known, words)
            ok = np.flatnonzero(at < len(known))
            ok = ok[known[at[ok]] == words[ok]]
            df[at[ok]] += np.diff(ptr.astype(np.int64))[ok]
    return n, total / n if n and total else 1.0, df


def _phrases(cues: list[list], heavy: np.ndarray, first: int) -> tuple[list[list], list[tuple[int, list]]]:
    """The cues with words that many of them share put together as phrases, and those phrases (number, from ``first``, and two parts).

    Only words of ``heavy`` are put together: a phrase is added as one vector
    where each of its words would have been one.
    """
    at = {u: i for i, u in enumerate(heavy.tolist())}
    own = [[at[u] for u in ws if u in at] for ws in cues]
    n = len(at)
    has, both = np.zeros((n + PHRASES, len(cues)), np.float32), np.zeros((n + PHRASES, n + PHRASES), np.float32)
    has[np.array([i for x in own for i in x], np.int64), np.repeat(np.arange(len(cues)), [len(x) for x in own])] = 1
    both[:n, :n] = has[:n] @ has[:n].T
    np.fill_diagonal(both, 0)
    parts: list = []
    while n and len(parts) < PHRASES:
        m = n + len(parts)
        a, b = divmod(int(both[:m, :m].argmax()), m)
        if both[a, b] < max(2, len(cues) / 200):
            break
        np.multiply(has[a], has[b], out=has[m])
        has[a] -= has[m]
        has[b] -= has[m]
        parts.append((a, b))
        for r in (a, b, m):
            both[r, : m + 1] = has[: m + 1] @ has[r]
            both[r, r] = 0
            both[: m + 1, r] = both[r, : m + 1]
    m = n + len(parts)
    name = np.concatenate([heavy, first + np.arange(len(parts))]).astype(np.int64)
    c, i = np.nonzero(has[:m].T)
    ends = np.searchsorted(c, np.arange(len(cues) + 1)).tolist()
    got, i = name[i].tolist(), None
    out = [got[ends[k] : ends[k + 1]] + [u for u in ws if u not in at] for k, ws in enumerate(cues)]
    return out, [(int(name[n + k]), [int(name[a]), int(name[b])]) for k, (a, b) in enumerate(parts)]


def _heavy(df: np.ndarray, n: int) -> np.ndarray:
    """The words that are worth a vector, the most frequent first."""
    o = np.argsort(-df, kind="stable")[:PHRASE_WORDS]
    return o[df[o] * DENSE > n]


def _merge(best: list, c: int, k: int, score: np.ndarray, place: np.ndarray) -> None:
    """Keep the k best of a cue; later places come with later ids, so of equal scores the first stay."""
    s, p = (score, place) if best[c] is None else (np.concatenate([best[c][0], score]), np.concatenate([best[c][1], place]))
    o = np.argsort(-np.round(s, 9), kind="stable")[:k]
    best[c] = (s[o], p[o])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, n = [], 0
    for b in batches:
        for lo in range(0, b.num_rows, CHUNK_CUES):
            part = b.slice(lo, CHUNK_CUES)
            if n + part.num_rows > CHUNK_CUES:
                yield pa.Table.from_batches(held)
                held, n = [], 0
            held.append(part)
            n += part.num_rows
    if n:
        yield pa.Table.from_batches(held)


def _hits(path: str, files: list, t: pa.Table, k: int, agents: bool):
    flat, ptr = _lists(t["ws"])
    known, flat = np.unique(flat, return_inverse=True)
    cues = [np.unique(flat[a:b], return_counts=True) for a, b in zip(ptr[:-1].tolist(), ptr[1:].tolist())]
    most = [int(w.sum()) for _, w in cues]
    kinds = [np.uint8 if m < 256 else np.uint16 if m < 65_536 else np.uint32 for m in most]
    often = [list(zip(u[w > 1].tolist(), w[w > 1].tolist())) for u, w in cues]
    n, _, df = _numbers(path, known)
    once, phrases = _phrases([u[w == 1].tolist() for u, w in cues], _heavy(df, n), len(known))
    mine = t["agent"].to_pylist()
    best: list = [None] * len(cues)
    floor, start, ids = [0] * len(cues), 0, []
    for x in _blocks(path, files):
        b = _Block(x, known)
        dense = b.vectors(lambda u: 1, np.uint8, phrases)
        only: dict = {}
        for c, kind in enumerate(kinds):
            if most[c] <= floor[c]:
                continue
            acc = np.zeros(b.n, kind)
            for u in once[c]:
                v = dense.get(u)
                if v is not None:
                    np.add(acc, v, out=acc, casting="unsafe")
                elif u in b.rows:
                    acc[b.rows[u]] += kind(1)
            for u, w in often[c]:
                v = dense.get(u)
                if v is not None:
                    np.add(acc, np.multiply(v, kind(w), dtype=kind), out=acc)
                elif u in b.rows:
                    acc[b.rows[u]] += kind(w)
            if agents:
                if mine[c] not in only:
                    only[mine[c]] = (b.agents == mine[c]).astype(np.uint8)
                np.multiply(acc, only[mine[c]], out=acc)
            at = np.flatnonzero(acc > floor[c])
            if not len(at):
                continue
            if len(at) > k:
                hits = acc[at]
                at = at[hits >= np.partition(hits, len(at) - k)[len(at) - k]]
            _merge(best, c, k, acc[at].astype(np.float64), at + start)
            if len(best[c][0]) == k:
                floor[c] = int(best[c][0][-1])
        ids.append(x["ids"])
        start += b.n
    return best, ids


def _bm25(path: str, files: list, t: pa.Table, k: int, k1: float, b_: float):
    flat, ptr = _lists(t["ws"])
    known, flat = np.unique(flat, return_inverse=True)
    n, avg, df = _numbers(path, known)
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    cues = [np.unique(flat[a:b]) for a, b in zip(ptr[:-1].tolist(), ptr[1:].tolist())]
    kinds = [np.uint16 if (idf[u] * (k1 + 1) / STEP + 1).sum() < 65_000 else np.uint32 for u in cues]
    short, phrases = _phrases([u.tolist() for u in cues], _heavy(df, n), len(known))
    best: list = [None] * len(cues)
    mark = np.zeros(len(known), bool)
    floor, start, ids = [0.0] * len(cues), 0, []
    for x in _blocks(path, files):
        b = _Block(x, known)
        norm = k1 * (1 - b_ + b_ * b.lens / avg)
        exact = {u: idf[u] * (b.times[u] * (k1 + 1) / (b.times[u] + norm[r])) for u, r in b.rows.items()}
        # never less than the score: each word is rounded up
        upper = {u: np.ceil(v / STEP).astype(np.uint16 if v.max() < 65_000 * STEP else np.uint32) for u, v in exact.items()}
        dense = b.vectors(lambda u: upper[u], np.uint16, phrases)
        ends, word, part = b.by_row(exact)
        for c, kind in enumerate(kinds):
            acc = np.zeros(b.n, kind)
            for u in short[c]:
                v = dense.get(u)
                if v is not None:
                    np.add(acc, v, out=acc, casting="unsafe")
                elif u in b.rows:
                    acc[b.rows[u]] += upper[u]
            at = np.flatnonzero(acc >= max(1, int((floor[c] - 1e-6) / STEP)))
            if not len(at):
                continue
            if len(at) > k:
                # the k largest bounds are at most a step a word over their scores
                bounds = acc[at].astype(np.int64)
                at = at[bounds >= np.partition(bounds, len(at) - k)[len(at) - k] - len(cues[c])]
            # the words of these rows, one after another
            size = ends[at + 1] - ends[at]
            e = np.repeat(ends[at + 1] - np.cumsum(size), size) + np.arange(size.sum())
            mark[cues[c]] = True
            e, row = e[mark[word[e]]], np.repeat(np.arange(len(at)), size)[mark[word[e]]]
            mark[cues[c]] = False
            score = np.bincount(row, part[e], len(at))
            _merge(best, c, k, score, at + start)
            if len(best[c][0]) == k:
                floor[c] = float(best[c][0][-1])
        ids.append(x["ids"])
        start += b.n
    return best, ids


def _blocks(path: str, numbers: list) -> Iterator[dict]:
    """The blocks of these numbers, in the order of their ids."""
    for number in numbers:
        for b in read_shared(path, part=number):
            yield from b.to_pylist()


def best_by_words(rows: DataFrame, cues: DataFrame, ws: Column, cue_ws: Column, k: int, agents: bool = False, bm25: tuple | None = None, id_col: str = "engram_id") -> DataFrame:
    """(cue_id, engram_id, score, rank): the k best rows of every cue, of equal ones the smaller id.

    The score is the number of the cue's words that a row holds, one repeated
    in the cue as often; with ``bm25`` (k1, b) it is that of BM25 over
    the cue's distinct words.  ``agents`` restricts cues to rows of their agent_id.
    """
    if agents:
        rows, cues = rows.filter("agent_id is not null"), cues.filter("agent_id is not null")
    agent = F.col("agent_id") if agents else None
    path = word_index(rows, ws, agent, id_col)
    spark = rows.sparkSession
    # files follow the order of ids; a task meets at most GROUP_BLOCKS of them for its cues
    files = list(read_shared(path, names=True))
    groups = [files[i : i + GROUP_BLOCKS] for i in range(0, len(files), GROUP_BLOCKS)] or [[]]
    kind = cues.schema["cue_id"].dataType.simpleString()
    c = cues.select("cue_id", hashed(cue_ws).alias("ws"), F.xxhash64("agent_id").alias("agent") if agents else F.lit(0).cast("long").alias("agent")).repartition(2 * spark.sparkContext.defaultParallelism)
    out = None
    for group in groups:

        def run(batches, group=group):
            for t in _chunks(batches):
                best, ids = _bm25(path, group, t, k, *bm25) if bm25 else _hits(path, group, t, k, agents)
                has = [i for i, x in enumerate(best) if x is not None]
                if not has:
                    continue
                names = pa.concat_arrays([pa.array(x, pa.string()) for x in ids])
                n = np.array([len(best[i][0]) for i in has])
                which = t["cue_id"].combine_chunks().take(pa.array(np.repeat(has, n)))
                rank = np.concatenate([np.arange(1, x + 1) for x in n]).astype(np.int32)
                cols = [which, names.take(pa.array(np.concatenate([best[i][1] for i in has]))), pa.array(np.concatenate([best[i][0] for i in has])), pa.array(rank)]
                yield from pa.Table.from_arrays(cols, ["cue_id", id_col, "score", "rank"]).to_batches(100_000)

        got = c.mapInArrow(run, f"cue_id {kind}, {id_col} string, score double, rank int")
        out = got if out is None else out.unionByName(got)
    if len(groups) == 1:
        return out
    w = W.partitionBy("cue_id").orderBy(F.desc(F.round("score", 9)), F.col(id_col))
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def shared_counts(rows: DataFrame, elements: Column, cues: DataFrame, cue_elements: Column, pairs: DataFrame, lists: Callable = _lists) -> DataFrame:
    """(cue_id, engram_id, matched, cue_size): how many of a cue's elements (numbers, each once) a row has, for ``pairs`` only.

    ``lists`` gives the elements and starts of rows from the column ``elements``.
    Every row meets the list of its cues once; the cues' elements are read
    from the shared folder, at most about SET_CUES cues at a time.
    """
    c = cues.select("cue_id", cue_elements.alias("fs"))
    n = cues.count()
    blocks, out = max(1, -(-n // SET_CUES)), None
    for block in range(blocks):
        mine = lambda df: df if blocks == 1 else df.filter(F.pmod(F.xxhash64("cue_id"), F.lit(blocks)) == block)
        path = write_shared(mine(c), "cue_sets")

        def run(batches, path=path):
            names, parts = [], []
            for b in read_shared(path):
                names += b["cue_id"].to_pylist()
                parts.append(_lists(b["fs"]))
            at = {x: i for i, x in enumerate(names)}
            ends = np.cumsum(np.concatenate([[0], *(np.diff(p[1]) for p in parts)])).astype(np.int64).tolist()
            tokens = np.concatenate([p[0] for p in parts] or [np.zeros(0, np.int64)])
            parts.clear()
            # as np.unique with its inverse, with fewer copies held at once
            o = np.argsort(tokens)
            known = tokens[o]
            new = np.append(True, known[1:] != known[:-1])[: len(known)]
            known = known[new]
            tokens = np.empty(len(o), np.int32)
            tokens[o] = np.cumsum(new, dtype=np.int32) - 1
            o = new = None
            mark = np.zeros(len(known) + 1, bool)
            for b in batches:
                flat, ptr = lists(b["fs"])
                pos = np.searchsorted(known, flat)
                pos[known[np.minimum(pos, len(known) - 1)] != flat] = len(known) if len(known) else 0
                ids, cue, row, matched, size = b["engram_id"].to_pylist(), [], [], [], []
                for r, cs in enumerate(b["cues"].to_pylist()):
                    own = pos[ptr[r] : ptr[r + 1]]
                    mark[own] = True
                    mark[len(known)] = False
                    for x in cs:
                        i = at.get(x)
                        if i is not None:
                            cue.append(x), row.append(ids[r]), size.append(ends[i + 1] - ends[i])
                            matched.append(np.count_nonzero(mark[tokens[ends[i] : ends[i + 1]]]))
                    mark[own] = False
                yield pa.RecordBatch.from_arrays([pa.array(cue, b["cues"].type.value_type), pa.array(row, pa.string()), pa.array(matched, pa.int64()), pa.array(size, pa.int32())], ["cue_id", "engram_id", "matched", "cue_size"])

        of_row = mine(pairs.select("cue_id", "engram_id")).groupBy("engram_id").agg(F.collect_list("cue_id").alias("cues"))
        # elements are made after the join, so only the texts move
        r = rows.hint("merge").join(of_row, "engram_id").select("engram_id", elements.alias("fs"), "cues")
        got = r.mapInArrow(run, f"cue_id {cues.schema['cue_id'].dataType.simpleString()}, engram_id string, matched long, cue_size int")
        out = got if out is None else out.unionByName(got)
    return out
