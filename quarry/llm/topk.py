"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are range-partitioned by falling length into buckets of about ``bucket_rows``.
Queries are all of them, or those that ``queries`` selects.

1. Every query meets the bucket of longest vectors: the k-th product found there is a lower
   bound theta(q) of the final k-th product.
2. A query can be reached by a bucket only if the bucket's longest vector is at least
   theta(q) / |q| long. Queries are sorted by that ratio and cut into blocks, so that those
   which need many buckets lie together and don't hold the others up; a block is sent no
   bucket that none of its queries can be reached by.
3. A task holds one block of queries and works through ``CHUNK`` buckets as they stream
   past, so vectors are shipped once a block of queries, and raises theta as it finds more.
   For each query the local cosine threshold theta(q) / (|q| * longest) is computed. Above 1
   the bucket is skipped; from ``COORD_FROM`` on candidates come from coordinate pruning
   (for the query's strongest coordinates only probes whose normalised coordinate lies in
   the feasible interval); below it from length pruning (the bucket's prefix of vectors long
   enough). Candidates' products are then verified in double precision.
4. Each task returns at most k a query; they are merged by id.

Scores are products rounded to 6 digits; ties go to the lower id. A vector isn't its own
neighbour.

Where lengths and directions are all alike nothing can be pruned, and work is the number
of queries times that of vectors: exactness has that price.

Defined cases: rows with a null id, a null or empty vector, a null or non-finite element,
or a dimension that is not the commonest (on a tie the larger) are left out; of several
rows with one id the least vector stands; zero vectors have product 0 with all; extra
columns are ignored, under any names; with fewer than k others a query has that many rows;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import plain, saved, small_side

K = 10
BUCKET_ROWS, QUERY_ROWS, CHUNK = 8192, 32_768, 8
#: Queries are the rows whose id this divides.
EVERY = 20
COORD_FROM, FOCUS = 0.85, 6
SLACK = 1e-6
DIGITS = 6


def clean_vectors(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, v, d, norm), one row an id."""
    vectors, (i, e) = plain(vectors, id_col, vector)
    v = F.col(e).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.where(F.col(i).isNotNull() & (F.size(v) > 0) & ~bad).select(F.col(i).cast("bigint").alias("id"), v.alias("v"))
    rows = rows.withColumn("d", F.size("v"))
    common = rows.groupBy("d").count().orderBy(F.desc("count"), F.desc("d")).first()
    rows = rows.where(F.col("d") == (common["d"] if common else 0)).groupBy("id", "d").agg(F.min("v").alias("v"))
    return rows.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))


def buckets(clean: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``clean`` with its bucket: 0 holds the longest vectors."""
    n = max(1, -(-clean.count() // bucket_rows))
    return saved(clean.repartitionByRange(n, F.desc("norm"), F.asc("id")).sortWithinPartitions(F.desc("norm"), F.asc("id")).withColumn("bucket", F.spark_partition_id()), "buckets")


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best by (score falling, id rising)."""
    if len(score) > k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        at = np.flatnonzero(score >= least)
    else:
        at = np.arange(len(score))
    return at[np.lexsort((ids[at], -score[at]))[:k]]


def search_cell(q, p, theta: np.ndarray, k: int, coord_from: float = COORD_FROM) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query place, probe ids, scores) of each query's best k in bucket ``p``, of products
    that can reach ``theta``."""
    qi, qm, qn = q
    pi, pm, pn = p
    local = np.where(qn * pn[0] > 0, (theta - SLACK) / np.maximum(qn * pn[0], 1e-300), -np.inf)
    unit = None
    by_length = np.flatnonzero((local <= 1) & (local < coord_from) | ~np.isfinite(local))
    for a in range(0, len(by_length), 1024):
        part = by_length[a : a + 1024]
        # length pruning: probes are sorted by falling length
        need = np.where(qn[part] > 0, (theta[part] - SLACK) / np.maximum(qn[part], 1e-300), -np.inf)
        top = int(np.searchsorted(-pn, -need.min(), "right")) if np.isfinite(need.min()) else len(pn)
        products = qm[part] @ pm[:top].T
        for r, x in zip(part, products):
            at = np.flatnonzero(x >= theta[r] - SLACK)
            if len(at) > 4 * k + 16:
                at = np.argpartition(-x, k)[: k + 1]
                at = np.flatnonzero(x >= x[at].min() - SLACK)
            yield from _verified(r, at, qi, qm, pi, pm, theta, k)
    for r in np.flatnonzero((local <= 1) & (local >= coord_from)):
        if unit is None:
            unit = pm / np.maximum(pn, 1e-300)[:, None]
            order = np.argsort(unit, axis=0, kind="stable")
            ranked = np.take_along_axis(unit, order, axis=0)
        t, x = local[r], qm[r] / qn[r]
        focus = np.argsort(-np.abs(x))[:FOCUS]
        spread = np.sqrt(max(0.0, 1 - t * t)) * np.sqrt(np.maximum(0.0, 1 - x[focus] ** 2))
        seen = np.zeros(len(pi), dtype=np.int8)
        for f, s in zip(focus, spread):
            lo, hi = np.searchsorted(ranked[:, f], [x[f] * t - s - 1e-9, np.inf])
            # the upper end holds only below the query's own direction
            hi = np.searchsorted(ranked[:, f], x[f] * t + s + 1e-9, "right") if x[f] < t else len(pi)
            lo = lo if x[f] > -t else 0
            seen[order[lo:hi, f]] += 1
        yield from _verified(r, np.flatnonzero(seen == len(focus)), qi, qm, pi, pm, theta, k)


def _verified(r, at, qi, qm, pi, pm, theta, k):
    at = at[pi[at] != qi[r]]
    if not len(at):
        return
    score = np.round(np.einsum("j,ij->i", qm[r], pm[at]), DIGITS) + 0.0
    best = _best(score, pi[at], k)
    best = best[score[best] >= theta[r] - SLACK]
    if len(best):
        yield r, pi[at[best]], score[best]


class Best:
    """The k best of each query so far."""

    def __init__(self, n: int, k: int) -> None:
        self.ids, self.scores = np.full((n, k), -1, dtype=np.int64), np.full((n, k), -np.inf)

    def add(self, r: int, ids: np.ndarray, scores: np.ndarray) -> float:
        """Merges more of query ``r``; its k-th score now."""
        k = self.ids.shape[1]
        have = self.scores[r] > -np.inf
        ids, scores = np.concatenate([self.ids[r][have], ids]), np.concatenate([self.scores[r][have], scores])
        at = _best(scores, ids, k)
        self.ids[r, : len(at)], self.scores[r, : len(at)] = ids[at], scores[at]
        return float(scores[at[-1]]) if len(at) == k else -np.inf

    def rows(self, own: np.ndarray) -> pa.RecordBatch:
        r, c = np.nonzero(self.scores > -np.inf)
        return pa.RecordBatch.from_arrays([pa.array(own[r]), pa.array(self.ids[r, c]), pa.array(self.scores[r, c])], ["vec_id", "neighbor_id", "score"])


FOUND = "vec_id bigint, neighbor_id bigint, score double"


def _bounds(k: int, first: tuple[np.ndarray, np.ndarray]):
    """Adds theta, from the vectors ``first``."""
    pi, pm = first

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            qi, qm = batch.column(0).to_numpy(), _matrix(batch.column(1))
            theta = np.full(len(qi), -np.inf)
            for a in range(0, len(qi) if len(pi) > k else 0, 1024):
                x = qm[a : a + 1024] @ pm.T
                x[qi[a : a + 1024, None] == pi[None, :]] = -np.inf
                theta[a : a + 1024] = np.partition(x, x.shape[1] - k, axis=1)[:, x.shape[1] - k]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(theta)], ["id", "v", "norm", "theta"])

    return run


def _solve(k: int):
    """Rows sorted by (block, chunk), queries before vectors by bucket -> FOUND."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        job, parts, q, best = None, [], None, None
        theta = np.zeros(0)
        for batch in batches:
            block, chunk, bucket = (batch.column(c).to_numpy() for c in ("block", "chunk", "bucket"))
            cut = np.flatnonzero((block[1:] != block[:-1]) | (chunk[1:] != chunk[:-1]) | (bucket[1:] != bucket[:-1])) + 1
            for a, b in zip(np.concatenate([[0], cut]), np.concatenate([cut, [len(block)]])):
                if a == b:
                    continue
                now, part = (block[a], chunk[a]), batch.slice(a, b - a)
                ids, m, norms = part.column("id").to_numpy(), _matrix(part.column("v")), part.column("norm").to_numpy()
                if now != job:
                    if best is not None:
                        yield best.rows(q[0])
                    job, parts, q, best = now, [], None, None
                if bucket[a] < 0:
                    parts.append((ids, m, norms, part.column("theta").to_numpy()))
                    continue
                if q is None:
                    *q, theta = (np.concatenate(x) for x in zip(*parts))
                    best, theta = Best(len(q[0]), k), theta.copy()
                for r, i, s in search_cell(q, (ids, m, norms), theta, k):
                    theta[r] = max(theta[r], best.add(r, i, s))
        if best is not None:
            yield best.rows(q[0])

    return run


def top_k(vectors: DataFrame, k: int = K, id_col: str = "vec_id", vector: str = "embedding", queries: Column | None = None, bucket_rows: int = BUCKET_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(vec_id, neighbor_id, rank, score): the k largest products of every query.
    ``queries`` is a condition on ``id``; without it all vectors are queries."""
    spark = vectors.sparkSession
    rows = buckets(clean_vectors(vectors, id_col, vector), bucket_rows)
    # a row a bucket to the driver, and one bucket's vectors
    longest = sorted(tuple(r) for r in rows.groupBy("bucket").agg(F.max("norm")).collect())
    if not longest:
        return spark.createDataFrame([], "vec_id bigint, neighbor_id bigint, rank int, score double")
    first = rows.where(F.col("bucket") == longest[0][0]).select("id", "v").toArrow().combine_chunks()
    lead = (first["id"].to_numpy(), np.stack(first["v"].to_numpy()))
    asked = rows.where(queries) if queries is not None else rows
    bound = asked.select("id", "v", "norm").mapInArrow(_bounds(k, lead), "id bigint, v array<double>, norm double, theta double")
    # the least length that can reach a query; without a bound, all can
    reach = F.when(F.col("theta") == float("-inf"), float("-inf")).when(F.col("norm") > 0, F.col("theta") / F.col("norm")).otherwise(F.when(F.col("theta") > 0, float("inf")).otherwise(float("-inf")))
    bound = saved(bound.withColumn("reach", reach), "bounds")
    blocks = max(1, -(-bound.count() // query_rows))
    blocked = saved(bound.repartitionByRange(blocks, "reach", "id").withColumn("block", F.spark_partition_id()), "blocks")
    # a row a block; blocks are in the order of reach, so each needs no more buckets than the one before
    least = [tuple(r) for r in blocked.groupBy("block").agg(F.min("reach")).orderBy("block").collect()]
    lengths = np.array([x for _, x in longest])
    needed = [int((lengths * (1 + 1e-9) + SLACK >= r).sum()) for _, r in least]
    to = spark.createDataFrame([(b, max(1, -(-n // CHUNK))) for (b, _), n in zip(least, needed)], "b_block int, chunks int")
    sent = spark.createDataFrame([(b, i // CHUNK, [g for (g, _), n in zip(least, needed) if n > i]) for i, (b, _) in enumerate(longest)], "b_bucket int, chunk int, blocks array<int>")
    asks = blocked.join(small_side(to, "to"), F.col("block") == F.col("b_block")).select("block", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(-1).alias("bucket"), "id", "v", "norm", "theta")
    gives = rows.join(small_side(sent, "sent"), F.col("bucket") == F.col("b_bucket")).select(F.explode("blocks").alias("block"), "chunk", "bucket", "id", "v", "norm", F.lit(0.0).alias("theta"))
    jobs = asks.unionByName(gives).repartition("block", "chunk").sortWithinPartitions("block", "chunk", "bucket", F.desc("norm"), "id")
    found = jobs.mapInArrow(_solve(k), FOUND)
    rank = F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("score"), F.asc("neighbor_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("vec_id", "neighbor_id", "rank", "score")


def search(vectors: DataFrame) -> DataFrame:
    """:func:`top_k` of the vectors whose id ``EVERY`` divides, among all of them."""
    return top_k(vectors, queries=F.col("id") % EVERY == 0)


SQL = f"""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
p AS (SELECT a.vec_id AS vec_id, b.vec_id AS neighbor_id, round(list_dot_product(a.e, b.e), {DIGITS}) + 0.0 AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % {EVERY} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, neighbor_id)::INT AS rank FROM p)
SELECT vec_id, neighbor_id, rank, score::DOUBLE AS score FROM r WHERE rank <= {K}
"""
