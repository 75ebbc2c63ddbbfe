"""Exact top-k by inner product: norm-sorted vectors, SVD-rotated partial sums, Cauchy-Schwarz pruning.

Equal vectors form one class: only the k+1 smallest ids of a class can be in any
answer (k, and one more for a query that is itself in the class), so a vector
with very many copies costs one row. Classes are dealt into blocks by falling
length. The first block, of fixed size, gives every query a first k-th score;
a query then meets a block only if |q| * (largest length of the block) can
still reach that score. The queries that reach a block are dealt into slices of fixed size,
so a task holds one block and one slice. Inside a block, rows are processed by falling length in
chunks: rotated leading coordinates are multiplied first, and the rest, bounded
by |q_rest| * |c_rest|, only where the bound reaches the k-th score so far.
Scores are exact integers.

Defined results: null vectors, vectors with null or non-finite components, and
null ids take no part; a repeated (id, vector) row counts once, and rows of one id with different vectors are
candidates (and queries) each; vectors of another dimension than the query's are not its candidates; ties go
to the smaller id; fewer than k candidates give all; an empty table gives none; extra columns are ignored. Components so
large that a product could leave 64 bits, and more than `max_dims` different dimensions, are errors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_groups, materialize

BLOCK = 8192
SLICE = 2048
CHUNK = 1024
SLACK = 1e-6
RESULT = "query_id long, rank int, vec_id long, score long"


def quantized(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id and integer components of the vectors that take part."""
    x = F.transform("embedding", lambda v: F.floor(v.cast("double") * scale).cast("long"))
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    sound = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.coalesce(bad, F.lit(True))
    return vectors.where(sound).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))


def rotation_of(classes: DataFrame, dim: int) -> np.ndarray:
    """Right singular vectors of all vectors of one dimension, from their dim x dim Gram matrix.

    Each partition sends one such matrix to a tree sum, so what the driver gets is dim^2 numbers.
    """

    def partial(it):
        g = np.zeros((dim, dim))
        for b in it:
            m = np.array(b.column(0).to_pylist(), np.float64)
            if len(m):
                g += m.T @ m
        ij = np.arange(dim * dim, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(ij), pa.array(g.ravel())], names=["ij", "v"])

    rows = classes.where(F.size("x") == dim).select("x").mapInArrow(partial, "ij int, v double").groupBy("ij").agg(F.sum("v").alias("v")).collect()
    g = np.zeros(dim * dim)
    for ij, v in rows:
        g[ij] = v
    _, vecs = np.linalg.eigh(g.reshape(dim, dim))
    return vecs[:, ::-1].copy()


def merge_top(pairs: list[tuple[int, int]], k: int) -> list[tuple[int, int]]:
    return sorted(pairs, key=lambda p: (-p[0], p[1]))[:k]


def block_search(q: np.ndarray, c: np.ndarray, ids: list[list[int]], rotation: np.ndarray, floor_of: np.ndarray, k: int, lead: int) -> list[list[tuple[int, int]]]:
    """For each query row the best (score, id) pairs of a block; c falls by length."""
    qr, cr = q @ rotation, c @ rotation
    q_rest, c_rest = np.linalg.norm(qr[:, lead:], axis=1), np.linalg.norm(cr[:, lead:], axis=1)
    q_len, c_len = np.linalg.norm(qr, axis=1), np.linalg.norm(cr, axis=1)
    qi, ci = q.astype(np.int64), c.astype(np.int64)
    best: list[list[tuple[int, int]]] = [[] for _ in q]
    low = floor_of.astype(np.float64).copy()
    for s in range(0, len(c), CHUNK):
        e = min(s + CHUNK, len(c))
        alive = np.flatnonzero(q_len * c_len[s] * (1 + SLACK) + SLACK >= low)
        if not len(alive):
            break  # lengths fall: no later row can reach any query's score
        part = qr[alive, :lead] @ cr[s:e, :lead].T
        bound = part + np.outer(q_rest[alive], c_rest[s:e])
        slack = SLACK * (1 + np.outer(q_len[alive], c_len[s:e]))
        row, col = np.nonzero(bound + slack >= low[alive][:, None])
        score = np.einsum("ij,ij->i", qi[alive[row]], ci[s + col]) if len(row) < 1 << 18 else _scores(qi, ci, alive[row], s + col)
        keep = score >= low[alive[row]]
        row, col, score = row[keep], col[keep], score[keep]
        starts = np.searchsorted(row, np.arange(len(alive) + 1))
        for n, at in enumerate(alive):
            a, b = starts[n], starts[n + 1]
            if a == b:
                continue
            sc = score[a:b]
            if b - a > k:
                cut = np.partition(sc, b - a - k)[b - a - k]
                pick = np.flatnonzero(sc >= cut)
            else:
                pick = range(b - a)
            found = [(int(sc[i]), v) for i in pick for v in ids[s + int(col[a + i])]]
            best[at] = merge_top(best[at] + found, k)
            if len(best[at]) == k:
                low[at] = max(low[at], best[at][-1][0])
    return best


def _scores(qi: np.ndarray, ci: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    out = np.empty(len(rows), np.int64)
    for s in range(0, len(rows), 1 << 18):
        out[s : s + (1 << 18)] = np.einsum("ij,ij->i", qi[rows[s : s + (1 << 18)]], ci[cols[s : s + (1 << 18)]])
    return out


def exact_top_k(vectors: DataFrame, *, k: int = 5, every: int = 50, scale: int = 256, block: int = BLOCK, slice_: int = SLICE, max_dims: int = 64) -> DataFrame:
    """The k best candidates of every query (ids divisible by `every`) by integer inner product."""
    spark = vectors.sparkSession
    rows = materialize(quantized(vectors, scale), "vectors")
    classes = smallest_ids(rows, k + 1)
    most = F.greatest(F.abs(F.array_max("x")), F.abs(F.array_min("x")))
    found = classes.groupBy(F.size("x").alias("d")).agg(F.max(most).alias("m")).limit(max_dims + 1).collect()  # one row a dimension
    if len(found) > max_dims:
        raise ValueError(f"vectors of more than {max_dims} dimensions in one table")
    for d, m in found:
        if d and d * int(m) ** 2 >= 1 << 62:
            raise OverflowError(f"components up to {m} in {d} dimensions: an inner product could leave 64 bits")
    dims = sorted(d for d, _ in found)
    queries = rows.where(F.col("vec_id") % every == 0).distinct()
    out = None
    for dim in dims:
        own = _one_dim(spark, classes.where(F.size("x") == dim), queries.where(F.size("x") == dim), dim, k, block, slice_)
        out = own if out is None else out.unionByName(own)
    return out if out is not None else spark.createDataFrame([], RESULT)


def smallest_ids(rows: DataFrame, n: int) -> DataFrame:
    """(x, ids): the n smallest distinct ids of each class of equal vectors.

    n rounds of a plain minimum: each is combined before its shuffle, so a class of any size stays one row a task.
    """
    found = rows.groupBy("x").agg(F.min("vec_id").alias("last"), F.max("vec_id").alias("top")).withColumn("ids", F.array("last"))
    found = materialize(found, "classes")
    open_ = found.where("top > last")
    if not open_.limit(1).count():
        return found.select("x", "ids")
    for _ in range(n - 1):
        more = rows.join(open_.select(F.col("x").alias("ox"), F.col("last").alias("olast")), F.col("x") == F.col("ox")).where("vec_id > olast").groupBy("x").agg(F.min("vec_id").alias("next"))
        found = materialize(found.join(more, "x", "left").select("x", F.coalesce("next", "last").alias("last"), "top", F.when(F.col("next").isNull(), F.col("ids")).otherwise(F.concat("ids", F.array("next"))).alias("ids")), "classes")
        open_ = found.where("top > last")
        if not open_.limit(1).count():
            break
    return found.select("x", "ids")


def _one_dim(spark, classes: DataFrame, queries: DataFrame, dim: int, k: int, block: int, slice_: int) -> DataFrame:
    if dim == 0:
        return spark.createDataFrame([], RESULT)
    rotation = rotation_of(classes, dim)
    lead = max(1, dim // 4)
    n = classes.count()
    n_blocks = max(1, -(-n // block))
    length = F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v))
    # Range parts by falling length: equal-sized blocks, hot classes are single rows already.
    dealt = classes.withColumn("len", length).repartitionByRange(n_blocks, F.desc("len"), "x").withColumn("block", F.spark_partition_id().cast("long"))
    dealt = materialize(dealt, "blocks")
    tops = dict(dealt.groupBy("block").agg(F.max("len")).collect())  # one row a block
    # Query classes: equal query vectors share one search; each then drops itself.
    wanted = materialize(queries.groupBy("x").agg(F.count("*").alias("n_queries")).withColumn("len", length), "queries")

    def pack(v):
        return v.astype(np.float64).reshape(-1, dim)

    keep = k + 1

    def search(with_floor: bool):
        def each(_key, t):
            side = t.column("side").to_numpy()
            x = pack(t.column("x").combine_chunks().flatten().to_numpy())
            c_at = np.flatnonzero(side == 0)
            q_at = np.flatnonzero(side == 1)
            if not len(c_at) or not len(q_at):
                return
            order = c_at[np.argsort(-np.linalg.norm(x[c_at], axis=1), kind="stable")]
            all_ids = t.column("ids").to_pylist()
            ids = [all_ids[i] for i in order]
            floors = t.column("floor").to_numpy(zero_copy_only=False)[q_at]
            for s in range(0, len(q_at), 512):
                at = q_at[s : s + 512]
                got = block_search(x[at], x[order], ids, rotation, floors[s : s + 512], keep, lead)
                for i, g in zip(at, got):
                    yield x[i].astype(np.int64).tolist(), [{"s": a, "v": b} for a, b in g]

        return each

    found_ddl = "x array<long>, best array<struct<s:long,v:long>>"
    least = float(np.iinfo(np.int64).min // 4)
    first = min(tops, default=0)
    cands = dealt.select("block", F.lit(0).alias("side"), "x", "ids", F.lit(least).alias("floor"))

    def by_slices(asked: DataFrame, with_floor: bool) -> DataFrame:
        """asked: (block, x, floor). A block goes to as many tasks as there are slices of the queries that reach it."""
        slices = asked.groupBy("block").agg(F.ceil(F.count("*") / slice_).cast("long").alias("m"))
        slices = materialize(slices, "slices")  # one row a block
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)).alias("slice")
        spread = cands.join(slices, "block").select("block", "side", "x", "ids", "floor", every)
        own = F.pmod(F.xxhash64("x"), "m").alias("slice")
        mine = asked.join(slices, "block").select("block", F.lit(1).alias("side"), "x", F.lit(None).cast("array<long>").alias("ids"), "floor", own)
        keyed = lambda d: d.select(F.xxhash64("block", "slice").alias("key"), "side", "x", "ids", "floor")
        return by_groups(keyed(spread).unionByName(keyed(mine)), search(with_floor), found_ddl)

    found = materialize(by_slices(wanted.select(F.lit(first).cast("long").alias("block"), "x", F.lit(least).alias("floor")), False), "top")
    if n_blocks > 1:
        score = F.when(F.size("best") >= keep, F.element_at("best", keep)["s"].cast("double")).otherwise(F.lit(least))
        floors = wanted.join(found.select("x", score.alias("floor")), "x", "left").withColumn("floor", F.coalesce("floor", F.lit(least)))
        ids, lengths = np.array(sorted(tops)), np.array([tops[b] for b in sorted(tops)])  # 16 bytes a block; lengths fall

        def reached(it):
            for b in it:
                own, low = b.column(b.schema.get_field_index("len")).to_numpy(), b.column(b.schema.get_field_index("floor")).to_numpy()
                # |q| * length >= floor, with room for rounding; a vector of length 0 scores 0 everywhere.
                least_length = np.where(low > 0, (low - SLACK) / np.maximum(own, 1e-300) * (1 - SLACK), 0)
                n = np.searchsorted(-lengths, -least_length, side="right")
                yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("x")), b.column(b.schema.get_field_index("floor")), pa.array([ids[1:m].tolist() for m in n], pa.list_(pa.int64()))], names=["x", "floor", "blocks"])

        rest = floors.select("x", "len", "floor").mapInArrow(reached, "x array<long>, floor double, blocks array<long>")
        rest = materialize(rest.select("x", "floor", F.explode("blocks").alias("block")), "asked")
        found = found.unionByName(by_slices(rest, True))
    ranked = found.groupBy("x").agg(F.flatten(F.collect_list("best")).alias("best"))
    order = F.slice(F.array_sort(F.transform("best", lambda b: F.struct((-b["s"]).alias("s"), b["v"].alias("v")))), 1, keep)
    ranked = ranked.select("x", order.alias("best"))
    own = queries.join(ranked, "x").select(F.col("vec_id").alias("query_id"), F.slice(F.filter("best", lambda b: b["v"] != F.col("vec_id")), 1, k).alias("best"))
    return own.select("query_id", F.posexplode("best").alias("p", "b")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("b.v").alias("vec_id"), (-F.col("b.s")).alias("score"))

