"""Nearest neighbours by score-aware anisotropic quantisation.

Unit vectors are cut into pairs of dimensions, each coded by one of 16 centres.
Codes and centres minimise a loss that weighs the residual along the vector more
than the rest, since that part is what large inner products lose.  Queries scan
the four-bit codes of their nearest leaves through tables of partial products
and rerank by exact cosine until no row left can be among the best.  (Guo et al., "Accelerating Large-Scale
Inference with Anisotropic Vector Quantization", 2020.)
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut

SAMPLE_ROWS, ROWS_A_LEAF, MOST_LEAVES, CENTRES = 10_000, 1_000, 1_024, 16
RECALL, LEAST_PROBES, LEAST_ROWS = 0.96, 12, 64
HELD_OUT = 10  # one sample row in so many is not fitted on, but asked to find how many leaves a query needs
SCORE_AT, RERANKED = 0.2, 96  # inner products from SCORE_AT on count; candidates of each block reranked before any bound is known
RERANK_CHUNK, SLACK = 1_024, 1e-4  # rows scored at a time; rounding of the tables' single precision
CANDIDATE_ROWS, QUERY_ROWS, TABLES = 4_096, 4_096, 256  # rows of a block; queries whose tables are held at a time


@dataclass
class Index:
    leaves: np.ndarray  # [leaves, dims], unit
    centres: np.ndarray  # [pairs, 16, 2]
    eta: float  # weight of the parallel residual

    def pairs(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, 2 * len(self.centres) - x.shape[1]))).reshape(len(x), -1, 2)

    def assign(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.leaves.T).argmax(axis=1)

    def codes(self, x: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Codes [n, pairs] of unit vectors: nearest centres first, then one pair after another by the whole loss."""
        p = self.pairs(x)
        off = lambda s: p[:, s, None, :] - self.centres[s]
        code = np.stack([(off(s) ** 2).sum(-1).argmin(1) for s in range(p.shape[1])], axis=1)
        along = self.parallel(p, code)
        total, every = along.sum(axis=1), np.arange(len(x))
        for _ in range(sweeps):
            for s in range(p.shape[1]):
                r = off(s)
                par = (r * p[:, s, None, :]).sum(-1)
                rest = total - par[every, code[:, s]]
                code[:, s] = ((r**2).sum(-1) + (self.eta - 1) * (rest[:, None] + par) ** 2).argmin(1)
                total = rest + par[every, code[:, s]]
        return code.astype(np.uint8)

    def parallel(self, p: np.ndarray, code: np.ndarray) -> np.ndarray:
        """What each pair adds to the residual along the vector."""
        return ((p - self.centres[np.arange(p.shape[1]), code]) * p).sum(-1)

    def errors(self, x: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Inner product of each unit vector with its decoded one, and the length of the decoded one's part across it."""
        p = self.pairs(x)
        decoded = self.centres[np.arange(p.shape[1]), code]
        along = (decoded * p).sum((1, 2))
        return along, np.sqrt(np.maximum((decoded**2).sum((1, 2)) - along**2, 0))

    def tables(self, q: np.ndarray) -> np.ndarray:
        """[n, bytes, 256]: a query's partial products with the two centres in every packed byte."""
        t = np.einsum("nsd,scd->nsc", self.pairs(q), self.centres)
        if t.shape[1] % 2:
            t = np.pad(t, ((0, 0), (0, 1), (0, 0)))
        return (t[:, ::2, :, None] + t[:, 1::2, None, :]).reshape(len(q), t.shape[1] // 2, 256).astype(np.float32)


def packed(code: np.ndarray) -> np.ndarray:
    if code.shape[1] % 2:
        code = np.pad(code, ((0, 0), (0, 1)))
    return code[:, ::2] << 4 | code[:, 1::2]


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow below
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def scaled(x: np.ndarray) -> np.ndarray:
    """Each vector over the power of 2 at its largest component: cosines stay the same to the last bit, and no square overflows or vanishes."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1]) if len(x) else x


def fit(x: np.ndarray, n_leaves: int, rounds: int = 8) -> Index:
    """x: unit vectors of the sample."""
    rng = np.random.default_rng(0)
    d, n_pairs = x.shape[1], -(-x.shape[1] // 2)
    eta = max(1.0, (d - 1) * SCORE_AT**2 / (1 - SCORE_AT**2))
    leaves = x[rng.choice(len(x), min(n_leaves, len(x)), replace=False)]
    for _ in range(rounds):
        own = (x @ leaves.T).argmax(axis=1)
        sums = np.zeros_like(leaves)
        np.add.at(sums, own, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        leaves = np.where(size > 0, sums / np.where(size > 0, size, 1), leaves)
    index = Index(leaves, np.zeros((n_pairs, CENTRES, 2)), eta)
    p = index.pairs(x)
    index.centres = np.stack([p[rng.choice(len(x), CENTRES, replace=len(x) < CENTRES), s] for s in range(n_pairs)])
    for k in range(rounds):
        code = index.codes(x, sweeps=int(k >= rounds // 2))
        total = index.parallel(p, code).sum(axis=1)
        for s in range(n_pairs):
            v, c = p[:, s], code[:, s].astype(int)
            rest = total - ((v - index.centres[s][c]) * v).sum(-1)
            weight = (eta - 1) * (k >= rounds // 2)
            left = np.zeros((CENTRES, 2, 2))
            np.add.at(left, c, np.eye(2) + weight * v[:, :, None] * v[:, None, :])
            right = np.zeros((CENTRES, 2))
            np.add.at(right, c, v * (1 + weight * (rest + (v * v).sum(-1)))[:, None])
            used = np.bincount(c, minlength=CENTRES) > 0
            index.centres[s][used] = np.linalg.solve(left[used], right[used][:, :, None])[:, :, 0]
            total = rest + ((v - index.centres[s][c]) * v).sum(-1)
    return index


def probes_needed(index: Index, rows: np.ndarray, asked: np.ndarray, k: int, recall: float) -> int:
    """The fewest leaves, nearest first, that hold ``recall`` of the ``k`` nearest ``rows`` of ``asked`` (unit vectors that weren't fitted on).

    A sample's neighbours are farther than those among all rows, and so lie in farther leaves: the number errs on the safe side.
    """
    if not len(asked):
        return len(index.leaves)
    own, k, places = index.assign(rows), min(k, len(rows)), []
    for at in range(0, len(asked), TABLES):
        q = asked[at : at + TABLES]
        place = np.argsort(np.argsort(-(q @ index.leaves.T), axis=1, kind="stable"), axis=1)
        best = np.argpartition(-(q @ rows.T), k - 1, axis=1)[:, :k]
        places.append(np.take_along_axis(place, own[best], axis=1).ravel())
    return int(np.quantile(np.concatenate(places), recall, method="higher")) + 1


def rerank(about: np.ndarray, along: np.ndarray, across: np.ndarray, score: Callable[[np.ndarray], np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and exact scores among which are all ``k`` best and their ties.

    A row of cosine s has a coded product of at least along * s - across *
    sqrt(1 - s**2), which grows with s from 0 on where along isn't negative:
    rows below it at the k-th best score are left out, all others are scored.
    """
    n = min(RERANKED, len(about))
    left = np.argsort(-about, kind="stable")
    first = int(np.searchsorted(-about[left], -about[left[n - 1]], side="right")) if n else 0  # the rows tied at the bar too
    rows, scores, bar = [], [], -1.0
    while len(left):
        size = first or RERANK_CHUNK
        for start in range(0, size, RERANK_CHUNK):
            part = left[start : min(size, start + RERANK_CHUNK)]
            rows.append(part)
            scores.append(score(part))
        left, first = left[size:], 0
        best = np.concatenate(scores)
        if len(best) >= k:
            bar = np.partition(best, len(best) - k)[len(best) - k]
        if bar > 0:
            least = along[left] * bar - across[left] * np.sqrt(max(0.0, 1 - bar * bar))
            left = left[(along[left] < 0) | (about[left] >= least - SLACK)]
    return np.concatenate([np.zeros(0, int), *rows]), np.concatenate([np.zeros(0), *scores])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def valid_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, vec of rows whose vector is whole, finite, not zero and of the usual length."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("vec"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & ~F.exists("vec", bad) & F.exists("vec", lambda x: x != 0))
    usual = rows.groupBy(F.size("vec").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.col("rows").desc(), "n").first()
    return rows.filter(F.size("vec") == (usual["n"] if usual else 0))


def nearest(vectors: DataFrame, k: int = 5, every: int = 50, sample_rows: int = SAMPLE_ROWS, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each vector whose vec_id ``every`` divides.

    The leaves and centres are fitted on at most ``sample_rows`` rows, by a hash
    of vec_id; every row is indexed.  Queries probe as many leaves as hold
    ``recall`` of the neighbours of sample rows that were kept from fitting.  Vectors that are null, zero, or hold null
    or non-finite components, and those of an unusual length, take no part;
    very large and very small components do.
    So do rows without a vec_id.  A vec_id that several rows have is asked once,
    with the least of its vectors, and none of its own rows answers it; as
    candidates repeated rows count one by one.  Large leaves are split into
    blocks and meet blocks of queries.  Within the probed leaves the neighbours
    are exact.
    """
    spark = vectors.sparkSession
    rows = valid_vectors(vectors)
    total = rows.count()
    schema = "query_id long, vec_id long, score double"
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).select("vec").toArrow()
    fitted = unit(_matrix(sample.column("vec").combine_chunks()))
    held = np.arange(len(fitted)) % HELD_OUT == HELD_OUT - 1
    kept, fitted = fitted[held], fitted[~held]
    index = fit(fitted, max(1, min(MOST_LEAVES, total // ROWS_A_LEAF)))
    probes = max(LEAST_PROBES, probes_needed(index, fitted, kept, k, recall))

    def encode(batches):
        for b in batches:
            if b.num_rows:
                x = unit(_matrix(b.column("vec")))
                code = index.codes(x)
                codes = pa.array([c.tobytes() for c in packed(code)], pa.binary())
                along, across = index.errors(x, code)
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("vec"), pa.array(index.assign(x).astype(np.int32)), codes, pa.array(along), pa.array(across)], names=["vec_id", "vec", "leaf", "codes", "along", "across"])

    coded = cut(rows.mapInArrow(encode, "vec_id long, vec array<double>, leaf int, codes binary, along double, across double"))
    size = {r.leaf: r.n for r in coded.groupBy("leaf").agg(F.count("*").alias("n")).collect()}  # at most MOST_LEAVES rows
    sizes = np.array([size.get(i, 0) for i in range(len(index.leaves))])

    def probe(batches):
        for b in batches:
            if b.num_rows:
                order = np.argsort(-(unit(_matrix(b.column("vec"))) @ index.leaves.T), axis=1, kind="stable")
                before = np.cumsum(sizes[order], axis=1) - sizes[order]
                take = (np.arange(len(sizes)) < probes) | (before < LEAST_ROWS)
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("vec"), pa.array([o[t].astype(np.int32) for o, t in zip(order, take, strict=True)], pa.list_(pa.int32()))], names=["query_id", "vec", "leaf"])

    asked = coded.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("vec").alias("vec")).mapInArrow(probe, "query_id long, vec array<double>, leaf array<int>")
    asked = asked.withColumn("leaf", F.explode("leaf"))
    load = asked.groupBy("leaf").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("q_blocks"))
    blocks = spark.createDataFrame([(i, max(1, -(-int(n) // CANDIDATE_ROWS))) for i, n in enumerate(sizes)], "leaf int, c_blocks int").join(load, "leaf")
    blocks = F.broadcast(blocks)  # a row a leaf
    own = lambda name, n: F.pmod(F.xxhash64(name), F.col(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = coded.join(blocks, "leaf").select("leaf", own("vec_id", "c_blocks").alias("c"), spread("q_blocks").alias("q"), "vec_id", "vec", "codes", "along", "across")
    right = asked.join(blocks, "leaf").select("leaf", spread("c_blocks").alias("c"), own("query_id", "q_blocks").alias("q"), "query_id", "vec")

    def scan(cands: pa.Table, queries: pa.Table) -> pa.Table:
        out = ([], [], [])
        if cands.num_rows and queries.num_rows:
            cands = cands.sort_by("vec_id")
            ids, x = np.asarray(cands.column("vec_id")), scaled(_matrix(cands.column("vec").combine_chunks()))
            codes = np.frombuffer(b"".join(cands.column("codes").to_pylist()), np.uint8).reshape(len(ids), -1)
            along, across = np.asarray(cands.column("along")), np.asarray(cands.column("across"))
            norm = np.sqrt((x * x).sum(axis=1))
            qs = scaled(_matrix(queries.column("vec").combine_chunks()))
            tables = (table for at in range(0, len(qs), TABLES) for table in index.tables(unit(qs[at : at + TABLES])))
            for q_id, q, table in zip(queries.column("query_id").to_pylist(), qs, tables, strict=True):
                about = sum(table[s][codes[:, s]] for s in range(codes.shape[1]))
                other, size = np.flatnonzero(ids != q_id), np.sqrt(q @ q)
                exact = lambda part: x[other[part]] @ q / (norm[other[part]] * size)  # noqa: B023, E731
                best, score = rerank(about[other], along[other], across[other], exact, k)
                best = other[best]
                top = np.lexsort((ids[best], -score))[:k]
                out[0].extend([q_id] * len(top))
                out[1].extend(ids[best][top])
                out[2].extend(score[top])
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["query_id", "vec_id", "score"])

    keys = ["leaf", "c", "q"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(scan, schema)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
