"""Approximate nearest neighbours by a block matrix join over int8 product tiles.

Vectors and queries are quantised to int8 with a scale of their own, before
anything is shuffled; the norm of what quantisation loses is kept. A tile
multiplies a block of queries with a block of vectors; products of int8 values
are whole numbers, exact in float32 up to 2^24, so they run at matrix speed
(longer vectors are multiplied in slices). A product gives the distance of the
quantised vectors, and both losses bound the true distance from below and above.

A heap of the k smallest upper bounds per query runs through a tile, and such
heaps are merged over all tiles: first by partial sorted lists, then per query.
A vector whose lower bound is above the k-th smallest upper bound of a query
cannot be among its k nearest; only the other pairs meet the original
vectors again and are recomputed in double precision. The bounds are safe, so
recall is 1.

Every query is held against all vectors, block by block; a block has a fixed
number of rows, so no task grows with the tables, and equal vectors, however
many, spread over all blocks (a row's block goes by a hash of its id and contents).

Vectors that are null, empty, all zero or hold null or non-finite components
take no part, as query or as candidate. Vectors of different lengths are not
compared. Ties go to the smaller id. A repeated id is a candidate per row but
never its own neighbour, and as a query it is answered once for each different
vector. Components of any finite size: bounds that overflow count as unknown, and a
distance whose squares leave the range of doubles is worked out on scaled
components. Empty tables give an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dnsloom.llm.common import flat_bytes, scratch, settle, spread

#: Rows of a block of queries and of a block of vectors.
QUERY_BLOCK, VECTOR_BLOCK = 2048, 16384
#: Rows of a block that one product takes.
STRIP = 4096
#: What a tile returns: pairs that may be near, with bounds.
FOUND = "q_id long, q_hash long, v_id long, v_hash long, low double, high double"
CODED = "id long, hash long, d int, code binary, scale double, lost double"


def usable(v: Column) -> Column:
    """Whether a vector takes part."""
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.isNotNull() & F.coalesce(sound & F.exists(v, lambda x: x != 0), F.lit(False))


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, and the norm of what is lost, with room for rounding."""
    top = np.abs(x).max(axis=1)
    unit = x / np.maximum(top, 5e-324)[:, None]  # components of -1 to 1, whatever the vector's size
    code = np.rint(np.nan_to_num(unit) * 127)
    scale = top / 127
    lost = np.sqrt(((unit - code / 127) ** 2).sum(axis=1)) * top
    return code.astype(np.int8), scale, lost * (1 + 1e-9) + 1e-15 * top


def _coded(batches):
    """id, hash and the vector's code, from id, hash and v."""
    for batch in batches:
        v = batch.column("v")
        sizes = v.value_lengths().to_numpy(zero_copy_only=False)
        flat = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        begin = np.cumsum(sizes) - sizes
        for d in np.unique(sizes):
            rows = np.flatnonzero(sizes == d)
            code, scale, lost = quantise(flat[begin[rows][:, None] + np.arange(d)[None, :]])
            take = pa.array(rows)
            some = [batch.column("id").take(take), batch.column("hash").take(take), pa.array(np.full(len(rows), d, np.int32)), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(scale), pa.array(lost)]
            yield pa.RecordBatch.from_arrays(some, ["id", "hash", "d", "code", "scale", "lost"])


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whole-number products of int8 rows: slices of up to 1000 components stay exact in float32."""
    out = np.zeros((len(a), len(b)))
    for at in range(0, a.shape[1], 1000):
        out += a[:, at : at + 1000].astype(np.float32) @ b[:, at : at + 1000].astype(np.float32).T
    return out


def tile(q: pd.DataFrame, v: pd.DataFrame, k: int) -> pd.DataFrame:
    """Pairs of a block of queries and a block of vectors (columns of ``CODED``) that may be among a query's k nearest."""
    grid = lambda t: flat_bytes(pa.array(t["code"], pa.binary()))[0].view(np.int8).reshape(len(t), -1)
    qc, qs, ql, q_ids = grid(q), q["scale"].to_numpy(), q["lost"].to_numpy(), q["id"].to_numpy()
    vc_all, vs_all, vl_all, v_ids = grid(v), v["scale"].to_numpy(), v["lost"].to_numpy(), v["id"].to_numpy()
    norm = lambda c, s: (c.astype(np.float64) ** 2).sum(axis=1) * s**2
    heap = np.full((len(q), k), np.inf)  # the k smallest upper bounds of each query
    kept = []
    with np.errstate(all="ignore"):
        qn = norm(qc, qs)
        for at in range(0, len(v), STRIP):
            vc, vs, vl, ids = (x[at : at + STRIP] for x in (vc_all, vs_all, vl_all, v_ids))
            both = qn[:, None] + norm(vc, vs)[None, :]
            square = both - 2 * (qs[:, None] * vs[None, :]) * _products(qc, vc)
            slack = 1e-9 * both + 1e-300
            loss = ql[:, None] + vl[None, :]
            low = np.sqrt(np.maximum(square - slack, 0)) - loss
            high = np.sqrt(np.maximum(square + slack, 0)) + loss
            # What overflows is unknown: it bounds nothing and is recomputed.
            low, high = np.where(np.isfinite(low), low, -1.0), np.where(np.isfinite(high), high, np.inf)
            own = q_ids[:, None] == ids[None, :]
            high[own] = np.inf
            heap = np.partition(np.concatenate([heap, high], axis=1), k - 1, axis=1)[:, :k]
            rows, cols = np.nonzero((low <= heap.max(axis=1)[:, None]) & ~own)
            kept.append((rows, cols + at, low[rows, cols], high[rows, cols]))
    rows, cols, low, high = (np.concatenate(x) for x in zip(*kept, strict=True))
    near = low <= heap.max(axis=1)[rows]
    rows, cols, low, high = rows[near], cols[near], low[near], high[near]
    return pd.DataFrame({"q_id": q_ids[rows], "q_hash": q["hash"].to_numpy()[rows], "v_id": v_ids[cols], "v_hash": v["hash"].to_numpy()[cols], "low": low, "high": high})


def _least(k: int):
    """The k smallest upper bounds of each query of a partition, by a heap per query (their number is that of the partition's queries)."""

    def run(frames):
        heaps: dict[tuple[int, int], list] = {}
        for f in frames:
            f = f.sort_values(["q_id", "q_hash", "high"])
            f = f[f.groupby(["q_id", "q_hash"]).cumcount() < k]
            for i, h, high in zip(f["q_id"].tolist(), f["q_hash"].tolist(), f["high"].tolist(), strict=True):
                heap = heaps.setdefault((i, h), [])
                if len(heap) < k:
                    heapq.heappush(heap, -high)
                else:
                    heapq.heappushpop(heap, -high)
        flat = [(i, h, -x) for (i, h), heap in heaps.items() for x in heap]
        yield pd.DataFrame(flat, columns=["q_id", "q_hash", "high"])

    return run


def distance(q: Column, v: Column) -> Column:
    """Euclidean distance in double precision, components added in order; on scaled components where squares leave the range."""
    gap = F.zip_with(q, v, lambda a, b: a - b)
    plain = F.aggregate(gap, F.lit(0.0), lambda s, x: s + x * x)
    most = F.array_max(F.transform(gap, F.abs))
    inside = lambda m: F.sqrt(F.aggregate(gap, F.lit(0.0), lambda s, x: s + (x / m) * (x / m))) * m
    scaled = F.when(most == 0, F.lit(0.0)).when(most == float("inf"), most).otherwise(inside(most))
    return F.when((plain > 1e-280) & (plain < 1e300), F.sqrt(plain)).otherwise(scaled)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, *, id_col: str = "vec_id", vector_col: str = "embedding", query_block: int = QUERY_BLOCK, vector_block: int = VECTOR_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` nearest of ``vectors`` by Euclidean distance.

    Both tables have ``id_col`` and ``vector_col``. A query is not its own
    neighbour: candidates with its id are left out.
    """

    def sound(df: DataFrame) -> DataFrame:
        v = F.col(vector_col).cast("array<double>")
        some = df.filter(F.col(id_col).isNotNull() & usable(v)).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
        return some.withColumn("hash", F.xxhash64("v"))

    v, q = sound(vectors), sound(queries).dropDuplicates(["id", "hash"])
    v_blocks, q_blocks = spread(vectors.count(), vector_block), spread(queries.count(), query_block)
    # A row's block follows from its id and its contents; each row then meets every block of the other side.
    at = lambda n, seed: F.pmod(F.xxhash64("id", "hash", F.lit(seed)), F.lit(n)).cast("int")
    wide = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    coded = lambda t: t.mapInArrow(_coded, CODED)
    # Repeated rows of one id and contents are dealt over the blocks as well.
    vb = coded(v).withColumn("b", F.pmod(at(v_blocks, 1) + F.monotonically_increasing_id() % 8, F.lit(v_blocks)).cast("int")).withColumn("a", wide(q_blocks))
    qb = coded(q).withColumn("a", at(q_blocks, 2)).withColumn("b", wide(v_blocks))

    def join(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({c: np.zeros(0, t) for c, t in zip(("q_id", "q_hash", "v_id", "v_hash", "low", "high"), (np.int64,) * 4 + (np.float64,) * 2, strict=True)})
        return tile(left, right, k)

    pairs = settle(qb.groupBy("a", "b", "d").cogroup(vb.groupBy("a", "b", "d")).applyInPandas(join, FOUND), "pairs")
    least = pairs.select("q_id", "q_hash", "high").mapInPandas(_least(k), "q_id long, q_hash long, high double")
    order = Window.partitionBy("q_id", "q_hash").orderBy("high")
    bound = least.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") == k).select("q_id", "q_hash", F.col("high").alias("bound"))
    near = pairs.join(bound, ["q_id", "q_hash"], "left").filter(F.col("bound").isNull() | (F.col("low") <= F.col("bound")))
    # Rows of one id and equal contents are one candidate here, as often as they came.
    near = settle(near.groupBy("q_id", "q_hash", "v_id", "v_hash").agg(F.least(F.count(F.lit(1)), F.lit(k)).cast("int").alias("n")), "near")

    def originals(side: str, rows: DataFrame) -> DataFrame:
        wanted = near.select(f"{side}_id", f"{side}_hash").distinct()
        some = rows.join(wanted, (F.col("id") == F.col(f"{side}_id")) & (F.col("hash") == F.col(f"{side}_hash"))).dropDuplicates([f"{side}_id", f"{side}_hash"])
        return some.select(f"{side}_id", f"{side}_hash", F.col("v").alias(f"{side}_v"))

    exact = near.join(originals("q", q), ["q_id", "q_hash"]).join(originals("v", v), ["v_id", "v_hash"])
    scored = exact.select("q_id", "q_hash", "v_id", distance(F.col("q_v"), F.col("v_v")).alias("score"), F.explode(F.sequence(F.lit(1), F.col("n"))).alias("_copy"))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("q_id", "q_hash").orderBy("score", "v_id")))
    return ranked.filter(F.col("rank") <= k).select(F.col("q_id").alias("query_id"), "rank", F.col("v_id").alias("vec_id"), "score")


def op1_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    with scratch(spark):
        return settle(nearest(vectors, vectors.filter("vec_id % 100 = 0")), "nearest", keep=True)


OP1_SQL = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, v.vec_id, list_distance(q.e, v.e) AS score FROM v q JOIN v ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id AND len(q.e) = len(v.e)),
r AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id))::INTEGER AS rank, vec_id, score FROM p)
SELECT * FROM r WHERE rank <= 10
"""
