"""Operator 5: exact top-k inner products, by descending length with rotated partial sums.

Vectors are cut into shells of nearly equal length (16 to an octave) and shells into
blocks. A query meets blocks from long vectors to short. The longest vectors give
each query a first bound on its k-th score; shells whose length times the query's
cannot reach it are never read (Cauchy-Schwarz). The rest are dealt out in lanes of
``LANE`` blocks, each lane meeting a block of queries in descending length with a
rising bound. Within a block all vectors are rotated by the right singular vectors
of the whole table, which puts most of a product into the first coordinates: the partial
product plus the product of the residual lengths bounds the whole one, and only pairs that can
still reach the bound are multiplied out, in exact integers. The singular vectors are the eigenvectors of the
dim x dim matrix of second moments, summed over all vectors in the tasks; they decide how much
is pruned, never the result.

Defined results: vectors that are null, empty or hold null or non-finite
components, and rows without id, take no part; rows that share an id are queries and candidates
each for itself, and each meets the others; vectors meet those of their own dimension; scores beyond 63 bits
raise; an empty table has no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, table

K, EVERY, SCALE = 10, 100, 1024
#: Components of a block of candidates and of a block of queries (every vector travels once for each of the
#: latter that it can matter to); blocks of a lane; vectors that give the first bounds.
BLOCK, QUERIES, LANE, SEED = 1 << 17, 1 << 21, 16, 2048
OCTAVE, NO_LENGTH = 16, -1_000_000
HEAD = 16


def integer_vectors(rows: DataFrame, vec: str = "embedding", key: str = "vec_id", scale: int = SCALE) -> DataFrame:
    """row (a number of its own, once the result is written), vec_id, x (array of longs), dim, length and shell."""
    x = F.transform(F.col(vec), lambda v: F.floor(F.lit(float(scale)) * v.cast("double")))
    ok = F.forall(F.col(vec), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    one = (rows.where(F.col(vec).isNotNull() & (F.size(vec) > 0) & F.col(key).isNotNull()).where(ok)
           .select(F.col(key).cast("long").alias("vec_id"), x.alias("x")))
    out = one.withColumn("row", F.monotonically_increasing_id()).withColumns({"dim": F.size("x"), "length": F.sqrt(F.aggregate(
        "x", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")))})
    shell = F.floor(F.log2("length") * OCTAVE).cast("int")
    return out.withColumn("shell", F.when(F.col("length") > 0, shell).otherwise(NO_LENGTH))


def rotation(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Right singular vectors of all vectors of a dimension, the largest first."""
    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            dims, x = b.column(0).to_numpy(), b.column(1)
            for d in np.unique(dims):
                m = x.filter(pa.array(dims == d)).flatten().to_numpy().reshape(-1, d).astype(float)
                sums[int(d)] = sums.get(int(d), 0.0) + m.T @ m
        for d, m in sums.items():
            yield pa.record_batch([pa.array(np.full(d * d, d), pa.int32()), pa.array(np.arange(d * d)), pa.array(m.ravel())],
                                  ["dim", "cell", "value"])

    sums = (vectors.select("dim", "x").mapInArrow(run, "dim int, cell long, value double")
            .groupBy("dim", "cell").agg(F.sum("value").alias("value")).toArrow())
    dim, cell, value = (sums.column(c).to_numpy() for c in ("dim", "cell", "value"))
    out = {}
    for d in np.unique(dim):
        m = np.zeros(d * d)
        m[cell[dim == d]] = value[dim == d]
        out[int(d)] = np.linalg.eigh(m.reshape(d, d))[1][:, ::-1]
    return out


def _matrix(values: pa.Array, dim: int):
    x = values.field("x").flatten().to_numpy().reshape(-1, dim)
    return values.field("row").to_numpy(), values.field("vec_id").to_numpy(), x


class _Queries:
    """Running top-k of one block of queries against blocks of candidates."""

    def __init__(self, own, ids, x, bound, basis, k):
        self.own, self.ids, self.x, self.basis, self.k = own, ids, x, basis, k
        self.bound = bound.copy()
        self.rot = x @ basis
        self.len = np.sqrt((self.rot ** 2).sum(1))
        self.rest = np.sqrt((self.rot[:, HEAD:] ** 2).sum(1))
        self.best = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in ids]

    def meet(self, own, ids, x):
        rot = x @ self.basis
        length, rest = np.sqrt((rot ** 2).sum(1)), np.sqrt((rot[:, HEAD:] ** 2).sum(1))
        most = float(self.len.max()) * float(length.max())
        if most >= 2.0 ** 62:
            raise OverflowError("inner products beyond 63 bits")
        slack = 1e-9 * most + 1e-6
        live = np.flatnonzero(self.len * length.max() + slack >= self.bound)
        for lo in range(0, len(live), 256):
            q = live[lo:lo + 256]
            upper = self.rot[q, :HEAD] @ rot[:, :HEAD].T + np.outer(self.rest[q], rest)
            near = upper + slack >= self.bound[q][:, None]
            near &= self.own[q][:, None] != own[None, :]
            if most < 2.0 ** 52 and near.mean() > 0.05:      # sums of integers this small are exact in doubles
                score = (self.x[q].astype(float) @ x.T.astype(float)).astype(np.int64)
            else:
                score = np.zeros(near.shape, np.int64)
                i, j = np.nonzero(near)
                for s in range(0, len(i), 50_000):
                    a, b = i[s:s + 50_000], j[s:s + 50_000]
                    score[a, b] = (self.x[q[a]] * x[b]).sum(1)
            for r, n in enumerate(q):
                hit = np.flatnonzero(near[r])
                hit = hit[score[r, hit] >= self.bound[n]]
                if len(hit):
                    s = np.concatenate([self.best[n][0], score[r, hit]])
                    v = np.concatenate([self.best[n][1], ids[hit]])
                    o = np.lexsort((v, -s))[:self.k]
                    self.best[n] = (s[o], v[o])
                    if len(o) == self.k:
                        self.bound[n] = max(self.bound[n], float(s[o[-1]]))

    def rows(self):
        n = [len(s) for s, _ in self.best]
        return pa.record_batch([
            pa.array(np.repeat(self.own, n)), pa.array(np.repeat(self.ids, n)), pa.array(np.concatenate([v for _, v in self.best])),
            pa.array(np.concatenate([s for s, _ in self.best]))], ["query", "query_id", "vec_id", "score"])


def _lanes(bases: dict[int, np.ndarray], k: int):
    """mapInArrow function over rows sorted by lane: first the queries, then blocks by descending length."""
    def run(batches):
        now, at = None, None
        for b in batches:
            lane = list(zip(*(b.column(c).to_pylist() for c in ("dim", "qblock", "lane"))))
            kind, items, bound = b.column("kind").to_pylist(), b.column("items"), b.column("bounds")
            for r in range(b.num_rows):
                vectors = _matrix(items[r].values, lane[r][0])
                if kind[r] == 0:
                    if now:
                        yield now.rows()
                    basis = bases.get(lane[r][0])
                    basis = np.eye(lane[r][0]) if basis is None else basis
                    now, at = _Queries(*vectors, bound[r].values.to_numpy(zero_copy_only=False).astype(float), basis, k), lane[r]
                elif at == lane[r]:
                    now.meet(*vectors)
        if now:
            yield now.rows()
    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    from pyspark.sql import Window
    w = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_k(rows: DataFrame, k: int = K, every: int = EVERY, vec: str = "embedding", key: str = "vec_id") -> DataFrame:
    """query_id, rank, vec_id, score of the k highest integer inner products of every
    row whose id is divisible by ``every`` with all other rows."""
    vectors = table(integer_vectors(rows, vec, key))
    # a shell is a sixteenth of an octave: a few ten thousand at most, whatever the table's size
    shells = vectors.groupBy("dim", "shell").agg(F.count("*").alias("n"), F.max("length").alias("top"))
    shells = sorted(shells.collect(), key=lambda s: (s.dim, -s.shell))
    bases = rotation(vectors)
    seeds, seen, sizes = [], {}, []
    for s in shells:
        size = max(1, BLOCK // s.dim)
        blocks = max(1, -(-s.n // size))
        need = SEED - seen.get(s.dim, 0)
        if need > 0:
            seeds.append((s.dim, s.shell, min(blocks, -(-need // size) + 1)))
            seen[s.dim] = seen.get(s.dim, 0) + s.n
        sizes.append((s.dim, s.shell, blocks, float(s.top)))
    spark = rows.sparkSession
    small = spark.createDataFrame(sizes, "dim int, shell int, blocks int, top double")
    item = F.struct("row", "vec_id", "x")
    block = F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int").alias("block")
    candidates = (vectors.join(small, ["dim", "shell"]).select("dim", "shell", block, item.alias("i"))
                  .groupBy("dim", "shell", "block").agg(F.collect_list("i").alias("items")))
    asked = vectors.where(F.col("vec_id") % every == 0)
    parts = asked.groupBy("dim").agg(F.ceil(F.count("*") * F.col("dim") / F.lit(QUERIES)).cast("long").alias("qblocks"))
    queries = (asked.join(parts, "dim").withColumn("qblock", F.pmod(F.xxhash64("row", F.lit(1)), F.col("qblocks")).cast("int"))
               .drop("qblocks"))

    def meet(queries: DataFrame, pairs: DataFrame) -> DataFrame:
        """queries: with bound; pairs: dim, qblock, shell, block, lane."""
        q = queries.groupBy("dim", "qblock").agg(F.sort_array(F.collect_list(F.struct("row", "vec_id", "x", "bound"))).alias("q"))
        asking = (pairs.select("dim", "qblock", "lane").distinct().join(q, ["dim", "qblock"])
                  .select("dim", "qblock", "lane", F.lit(0).alias("kind"), F.lit(0).alias("shell"),
                          F.transform("q", lambda v: F.struct(*[v[c].alias(c) for c in ("row", "vec_id", "x")])).alias("items"),
                          F.col("q.bound").alias("bounds")))
        met = (pairs.join(candidates, ["dim", "shell", "block"])
               .select("dim", "qblock", "lane", F.lit(1).alias("kind"), "shell", "items",
                       F.array().cast("array<double>").alias("bounds")))
        dealt = (asking.unionByName(met).repartition("dim", "qblock", "lane")
                 .sortWithinPartitions("dim", "qblock", "lane", "kind", F.desc("shell")))
        return dealt.mapInArrow(_lanes(bases, k), "query long, query_id long, vec_id long, score long")

    first = spark.createDataFrame(seeds, "dim int, shell int, blocks int")
    which = queries.select("dim", "qblock").distinct()
    seed_pairs = (which.join(first, "dim").select("dim", "qblock", "shell", F.explode(F.sequence(
        F.lit(0), F.col("blocks") - 1)).alias("block")).withColumn("lane", F.lit(0)))
    start = _best(meet(queries.withColumn("bound", F.lit(-math.inf)), seed_pairs), k)
    bounds = start.where(F.col("rank") == k).select(F.col("query").alias("row"), F.col("score").cast("double").alias("bound"))
    bounded = table(queries.join(bounds, "row", "left").withColumn("bound", F.coalesce("bound", F.lit(-math.inf))))
    # the shortest vector that can still matter to a query of the block
    reach = bounded.groupBy("dim", "qblock").agg(F.min(F.when(
        (F.col("bound") > 0) & (F.col("length") > 0), F.col("bound") / F.col("length")).otherwise(-math.inf)).alias("reach"))
    pairs = (reach.join(small, "dim").where(F.col("top") * (1 + 1e-9) >= F.col("reach"))
             .select("dim", "qblock", "shell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")))
    lanes = max(1, -(-sum(s[2] for s in sizes) // LANE))
    pairs = pairs.withColumn("lane", F.pmod(F.xxhash64("shell", "block"), F.lit(lanes)).cast("int"))
    return _best(meet(bounded, pairs), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op5_norm_sorted_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read_table(spark, sf_dir, "embeddings"))


ORACLE = f"""
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: floor({SCALE} * e::DOUBLE)::BIGINT) AS x
           FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM v q JOIN v c ON q.r <> c.r AND len(q.x) = len(c.x) WHERE q.vec_id % {EVERY} = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) <= {K}"""
