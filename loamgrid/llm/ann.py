"""Nearest neighbours from randomly rotated one-bit codes with an error bound, and exact reranking.

Vectors are taken relative to the nearest of a few centres, which are fitted on
a bounded sample, and rotated by a fixed random map; each keeps one sign bit for
each rotated dimension, its distance from the centre and the inner product of its
direction with its code. A query is rotated and rounded to a few bits, so that
inner products with codes are counts of common bits. They give an estimate of
the distance and, with the correction scalars, a bound on its error; only
vectors that the bound cannot rule out are compared on the original values.

Codes and vectors stay where they are stored. Queries travel, in broadcasts of
a bounded size, with a first limit from the sample; each task keeps the k best
of every query, whose last distance is the limit from then on.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamgrid.llm.common import free, stored


@dataclass(frozen=True)
class OneBit:
    """k: neighbours; bound: width of the error bound in standard deviations; spread, bits: sign bits for each
    dimension, up to so many in all (never fewer than one for each dimension); levels: bits of a rounded query
    coordinate; cells, sample: centres of a dimension, fitted on about so many vectors; rows: of a block;
    query_bytes: of the queries that one pass over the vectors may send along; seed: of rotation and sample."""

    k: int = 10
    bound: float = 3.0
    spread: int = 4
    bits: int = 1024
    levels: int = 4
    cells: int = 32
    sample: int = 4096
    rows: int = 4096
    query_bytes: int = 16 << 20
    seed: int = 7


@functools.cache
def rotation(dim: int, bits: int, seed: int) -> np.ndarray:
    """A random map from ``dim`` to ``bits`` dimensions that keeps all lengths, the same wherever it is made."""
    q, r = np.linalg.qr(np.random.Generator(np.random.PCG64([seed, dim])).standard_normal((bits, dim)))
    return (q * np.sign(np.diag(r))).T


def code_bits(dim: int, how: OneBit) -> int:
    return -(-max(dim, min(how.spread * dim, how.bits)) // 64) * 64


def encode(x: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed sign bits, norms, inner product of each rotated unit vector with its code's unit vector)."""
    y = x @ turn
    norm = np.linalg.norm(x, axis=1)
    inner = np.abs(y).sum(axis=1) / (np.maximum(norm, 1e-300) * np.sqrt(turn.shape[1]))
    return np.packbits(y > 0, axis=1), norm, np.where(norm > 0, inner, 1.0)


def lower_bounds(bits: np.ndarray, norm: np.ndarray, inner: np.ndarray, y: np.ndarray, how: OneBit) -> np.ndarray:
    """Lower bounds on squared distances (query, vector) from codes, for queries ``y`` rotated about the same centre."""
    width = y.shape[1]
    low = y.min(axis=1, keepdims=True)
    step = np.maximum(y.max(axis=1, keepdims=True) - low, 1e-300) / ((1 << how.levels) - 1)
    rounded = np.rint((y - low) / step).astype(np.uint8)
    code = bits.view(np.uint64)
    common = np.zeros((len(y), len(code)), np.int32)
    for j in range(how.levels):
        plane = np.packbits((rounded >> j) & 1, axis=1).view(np.uint64)
        for w in range(code.shape[1]):
            common += np.bitwise_count(plane[:, w, None] & code[None, :, w]).astype(np.int32) << j
    ones = np.bitwise_count(code).sum(axis=1, dtype=np.int64)
    # The code is +1 or -1 by sqrt(width); the rounded query is low + step * rounded.
    dot = (2 * (step * common + low * ones[None, :]) - (step[:, 0] * rounded.sum(axis=1) + low[:, 0] * width)[:, None]) / np.sqrt(width)
    length = np.linalg.norm(y, axis=1)[:, None]
    error = how.bound * np.sqrt(length**2 * np.maximum(1 - inner**2, 0) / (width - 1) + step**2 / 12) / inner
    return norm**2 + length**2 - 2 * norm * (dot / inner + error)


def valid(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v, dim) of the rows that take part: no null, zero or non-finite vector and no null id."""
    v = F.col(vector).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~bad & F.exists("v", lambda x: x != 0)).withColumn("dim", F.size("v"))


def _share(rows: int, wanted: int, seed: int) -> Column:
    """Whether a row is among the ``wanted`` or so of ``rows`` that a hash of its vector picks."""
    return F.xxhash64("v", F.lit(seed)) / 2.0**64 + 0.5 <= wanted / max(1, rows)


def _centres(x: np.ndarray, how: OneBit) -> np.ndarray:
    """Up to ``cells`` centres of the sample ``x``, by a few rounds of k-means."""
    rng = np.random.Generator(np.random.PCG64(how.seed))
    x = x[np.lexsort(x.T[::-1])]
    c = x[rng.permutation(len(x))[: how.cells]]
    for _ in range(8):
        near = ((x**2).sum(axis=1)[:, None] - 2 * x @ c.T + (c**2).sum(axis=1)[None, :]).argmin(axis=1)
        n = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def _sample(base: DataFrame, rows: int, how: OneBit) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of a bounded sample, by dimension."""
    out: dict[int, list] = {}
    held = 0
    for r in base.where(_share(rows, how.sample, how.seed)).select("dim", "vec_id", "v").toLocalIterator():
        if held < 4 * how.sample:
            out.setdefault(r["dim"], []).append((r["vec_id"], r["v"]))
            held += 1
    return {dim: (np.array([i for i, _ in xs], np.int64), np.array([v for _, v in xs])) for dim, xs in out.items()}


def _index(base: DataFrame, centres: dict[int, np.ndarray], how: OneBit) -> DataFrame:
    """(dim, cell, far, ids, vectors, bits, norm, inner): blocks of one cell, made by the task that reads their rows."""
    sent = base.sparkSession.sparkContext.broadcast(centres)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list] = {}

        def tell(dim: int) -> pd.DataFrame:
            ids, x = (np.array(c) for c in zip(*held.pop(dim), strict=True))
            c = sent.value.get(dim, np.zeros((1, dim)))
            cell = ((c**2).sum(axis=1)[None, :] - 2 * x @ c.T).argmin(axis=1)
            out = []
            for k in np.flatnonzero(np.bincount(cell)):
                at = np.flatnonzero(cell == k)
                bits, norm, inner = encode(x[at] - c[k], rotation(dim, code_bits(dim, how), how.seed))
                out.append((dim, int(k), float(norm.max()), ids[at].astype(np.int64).tobytes(), x[at].tobytes(), bits.tobytes(), norm.tobytes(), inner.tobytes()))
            return pd.DataFrame(out, columns=["dim", "cell", "far", "ids", "vectors", "bits", "norm", "inner"])

        for pdf in batches:
            for i, v, dim in zip(pdf["vec_id"], pdf["v"], pdf["dim"], strict=True):
                held.setdefault(dim, []).append((i, np.asarray(v, np.float64)))
                if len(held[dim]) >= how.rows * 4:
                    yield tell(dim)
        for dim in list(held):
            yield tell(dim)

    return base.select("vec_id", "v", "dim").mapInPandas(pack, "dim int, cell int, far double, ids binary, vectors binary, bits binary, norm binary, inner binary")


class _Best:
    """The k nearest different ids of each query so far, and the distance that a vector must not exceed."""

    def __init__(self, ids: np.ndarray, limit: np.ndarray, k: int):
        self.own, self.limit, self.k = ids, limit.copy(), k
        self.query, self.id, self.far = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.compared = np.zeros(len(ids), np.int64)

    def add(self, query: np.ndarray, ids: np.ndarray, far: np.ndarray) -> None:
        self.compared += np.bincount(query, minlength=len(self.own))
        keep = far <= self.limit[query]
        query, ids, far = (np.concatenate(x) for x in ((self.query, query[keep]), (self.id, ids[keep]), (self.far, far[keep])))
        # The nearest of the rows that share an id, then the k nearest ids; ties go to the smaller id.
        by = np.lexsort((far, ids, query))
        query, ids, far = query[by], ids[by], far[by]
        lead = np.concatenate(([True], (ids[1:] != ids[:-1]) | (query[1:] != query[:-1]))) if len(by) else np.zeros(0, bool)
        query, ids, far = query[lead], ids[lead], far[lead]
        by = np.lexsort((ids, far, query))
        query, ids, far = query[by], ids[by], far[by]
        rank = np.arange(len(by)) - np.searchsorted(query, query)
        keep = rank < self.k
        self.query, self.id, self.far = query[keep], ids[keep], far[keep]
        last = rank == self.k - 1
        self.limit[query[last]] = np.minimum(self.limit[query[last]], far[last])


def _scan(index: DataFrame, queries: dict[int, tuple], centres: dict[int, np.ndarray], how: OneBit) -> DataFrame:
    """(query_id, vec_id, score, compared): the k best of each task, and a row without vec_id for what it compared."""
    sent = index.sparkSession.sparkContext.broadcast((queries, centres))

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        queries, centres = sent.value
        best = {dim: _Best(ids, limit, how.k) for dim, (ids, _, limit) in queries.items()}
        turned: dict[int, np.ndarray] = {}
        for pdf in batches:
            for r in pdf.itertuples():
                if r.dim not in queries:
                    continue
                _, q, _ = queries[r.dim]
                at = best[r.dim]
                turn = rotation(r.dim, code_bits(r.dim, how), how.seed)
                if r.dim not in turned:
                    turned[r.dim] = q @ turn
                centre = centres.get(r.dim, np.zeros((1, r.dim)))[r.cell]
                ids, x = np.frombuffer(r.ids, np.int64), np.frombuffer(r.vectors).reshape(-1, r.dim)
                bits = np.frombuffer(r.bits, np.uint8).reshape(len(ids), -1)
                norm, inner = np.frombuffer(r.norm), np.frombuffer(r.inner)
                # A block whose every vector is farther than the limit, by the triangle inequality, is left out whole.
                some = np.flatnonzero(np.linalg.norm(q - centre, axis=1) - r.far <= at.limit * (1 + 1e-9))
                for s in range(0, len(some), 256):
                    mine = some[s : s + 256]
                    for lo in range(0, len(ids), how.rows):
                        part = slice(lo, lo + how.rows)
                        low = lower_bounds(bits[part], norm[part], inner[part], turned[r.dim][mine] - centre @ turn, how)
                        i, j = np.nonzero((low <= (at.limit[mine] ** 2 * (1 + 1e-9))[:, None]) & (ids[None, part] != at.own[mine][:, None]))
                        for e in range(0, len(i), 1 << 16):
                            a, b = mine[i[e : e + (1 << 16)]], lo + j[e : e + (1 << 16)]
                            at.add(a, ids[b], np.sqrt(((x[b] - q[a]) ** 2).sum(axis=1)))
        for at in best.values():
            yield pd.DataFrame({"query_id": at.own[at.query], "vec_id": pd.array(at.id, "Int64"), "score": at.far, "compared": np.zeros(len(at.id), np.int64)})
            told = np.flatnonzero(at.compared)
            yield pd.DataFrame({"query_id": at.own[told], "vec_id": pd.array([None] * len(told), "Int64"), "score": np.zeros(len(told)), "compared": at.compared[told]})

    return index.mapInPandas(nearest, "query_id long, vec_id long, score double, compared long")


def _first_limits(ids: np.ndarray, q: np.ndarray, sample: tuple[np.ndarray, np.ndarray] | None, k: int) -> np.ndarray:
    """For each query, a distance within which the sample alone has k different ids; infinite if it has fewer."""
    out = np.full(len(q), np.inf)
    if sample is None:
        return out
    known, x = sample
    _, lead = np.unique(known, return_index=True)
    known, x = known[lead], x[lead]
    for s in range(0, len(q), 1024):
        part = q[s : s + 1024]
        square = (part**2).sum(axis=1)[:, None] + (x**2).sum(axis=1)[None, :] - 2 * part @ x.T
        square[ids[s : s + 1024, None] == known[None, :]] = np.inf
        if len(known) >= k:
            # A little more than computed, as the sum of squares cancels.
            scale = (part**2).sum(axis=1) + (x**2).sum(axis=1).max()
            out[s : s + 1024] = np.sqrt(np.maximum(np.partition(square, k - 1, axis=1)[:, k - 1], 0) + 1e-9 * scale)
    return out


def _found(vectors: DataFrame, queries: DataFrame, how: OneBit) -> DataFrame:
    """(query_id, vec_id, score, compared) of all tasks and passes; see _scan()."""
    # Of rows with one and the same vector only the k + 1 smallest ids can be among a query's nearest, its own left out.
    same = Window.partitionBy("v").orderBy("vec_id")
    base = stored(valid(vectors).dropDuplicates(["vec_id", "v"]).withColumn("n", F.row_number().over(same)).where(F.col("n") <= how.k + 1).drop("n"))
    asked = stored(valid(queries).dropDuplicates(["vec_id", "v"]))
    size = asked.agg(F.coalesce(F.sum(F.col("dim").cast("long") * 8), F.lit(0)).alias("bytes")).first()["bytes"]
    sample = _sample(base, base.count(), how)
    centres = {dim: _centres(x, how) for dim, (_, x) in sample.items()}
    index = stored(_index(base, centres, how), [base])
    passes = max(1, -(-int(size) // how.query_bytes))
    out = None
    for p in range(passes):
        sent: dict[int, tuple] = {}
        # A pass sends the queries of one value of a hash: about query_bytes in each.
        rows = asked.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(passes)) == p).toPandas()
        for dim, part in rows.groupby("dim"):
            ids, q = part["vec_id"].to_numpy(np.int64), np.stack(part["v"].to_numpy())
            sent[int(dim)] = ids, q, _first_limits(ids, q, sample.get(int(dim)), how.k)
        found = stored(_scan(index, sent, centres, how))
        out = found if out is None else out.unionByName(found)
    free(index)
    free(asked)
    return out


def search(vectors: DataFrame, queries: DataFrame, how: OneBit = OneBit()) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` nearest found, by Euclidean distance, ties to the smaller vec_id.

    Both inputs have (vec_id, embedding); other columns are left aside. A query
    is never its own candidate, and meets vectors of its own dimension only.
    Vectors that are null, zero or hold null or non-finite components take no
    part on either side. Rows that share a vec_id are one candidate, by the
    nearest of them; as a query such an id gets the nearest of all its vectors.
    Empty tables give none.
    """
    found = _found(vectors, queries, how).where("vec_id IS NOT NULL")
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    by = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return best.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= how.k).select("query_id", "rank", "vec_id", "score")


def compared(vectors: DataFrame, queries: DataFrame, how: OneBit = OneBit()) -> DataFrame:
    """(query_id, compared): how many vectors the bound did not rule out for each query, so that they were compared exactly."""
    return _found(vectors, queries, how).groupBy("query_id").agg(F.sum("compared").alias("compared"))
