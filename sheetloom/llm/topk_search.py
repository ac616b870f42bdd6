"""Exact top-k search by inner product: Fagin's threshold algorithm over sorted per-dimension lists.

Each block of vectors carries one sorted list per dimension. For a query, every list is
read from the end that the query's component favours; each vector met is scored in full
by random access, and the walk stops once the threshold (the score of a vector standing
where each list was last read) cannot reach the k-th score found. Blocks of vectors are dealt
into slices by a hash of their first id, and so are blocks of queries; every pair of
slices is a join key and a task of its own, so neither side is ever gathered. A task hands
on k rows per query at most for each of its blocks, and only those that its earlier blocks
do not beat.

Defined results: rows with a null id, a null or empty vector, or a null, NaN or infinite
component take no part; a query is compared with vectors of its own length; candidates
that bear the query's id are left out; repeated rows with other ids each count; of
several queries with one id, the smallest vector is used; an empty table gives no rows;
further columns are not read. Vectors so large that a score could pass 64 bits are refused
with an OverflowError.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetloom.llm.common import named

BLOCK = "dims int, ids binary, rows binary, lists binary"
HIT = "query_id long, vec_id long, score long"


def finite(v: Column) -> Column:
    return F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def integer_vectors(vectors: DataFrame, id_col: str, vec_col: str, scale: float) -> DataFrame:
    """(id long, v array<long>): floor(scale * x) of each component x of the vectors that take part."""
    rows = vectors.select(named(id_col).cast("long").alias("id"), named(vec_col).cast("array<double>").alias("x"))
    return rows.where(F.col("id").isNotNull() & finite(F.col("x"))).select("id", F.transform("x", lambda x: F.floor(x * F.lit(float(scale)))).alias("v"))


def blocks(rows: DataFrame, size: int, lists: bool) -> DataFrame:
    """Packs (id, v) into blocks of up to size rows of equal length; lists: with the sorted lists."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def block(dims: int) -> pa.RecordBatch:
            parts = held.pop(dims)
            ids, mat = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            order = np.argsort(mat, axis=0, kind="stable").astype("<i4").T.tobytes() if lists else b""
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((dims, pa.int32()), (ids.astype("<i8").tobytes(), pa.binary()), (mat.astype("<i8").tobytes(), pa.binary()), (order, pa.binary()))], names=["dims", "ids", "rows", "lists"])

        for batch in batches:
            ids, vec = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            ends = np.asarray(vec.offsets, dtype=np.int64)
            flat, dims = vec.values.to_numpy(zero_copy_only=False), np.diff(ends)
            for d in np.unique(dims).tolist():
                of = np.flatnonzero(dims == d)
                for lo in range(0, len(of), size):
                    take = of[lo : lo + size]
                    held.setdefault(d, []).append((ids[take], flat[ends[take][:, None] + np.arange(d)]))
                    if sum(len(p[0]) for p in held[d]) >= size:
                        yield block(d)
        for d in list(held):
            yield block(d)

    return rows.select("id", "v").mapInArrow(pack, BLOCK)


def walk(q: np.ndarray, own: int, ids: np.ndarray, mat: np.ndarray, order: np.ndarray, k: int, floor: int | None) -> tuple[np.ndarray, np.ndarray, int]:
    """The k best of one block for one query, as (ids, scores, rows scored). floor: a score that k others reach already."""
    n = len(ids)
    seen = ids == own
    dims = np.flatnonzero(q)
    got_i, got_s, depth, step, scored = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, max(16, 2 * k), 0
    while depth < n:
        to = min(n, depth + step) if len(dims) else n
        if len(dims):
            met = np.zeros(n, bool)
            for d in dims:
                met[order[d, depth:to] if q[d] < 0 else order[d, n - to : n - depth]] = True
            new = np.flatnonzero(met & ~seen)
        else:
            new = np.flatnonzero(~seen)
        seen[new] = True
        scored += len(new)
        got_i, got_s = np.concatenate([got_i, ids[new]]), np.concatenate([got_s, mat[new] @ q])
        if len(got_i) > k:
            best = np.lexsort((got_i, -got_s))[:k]
            got_i, got_s = got_i[best], got_s[best]
        depth, step = to, step * 2
        if len(dims):
            last = np.where(q[dims] < 0, order[dims, to - 1], order[dims, n - to])
            bound = int((mat[last, dims] * q[dims]).sum())
            reach = got_s.min() if len(got_i) == k else None
            need = max(x for x in (reach, floor) if x is not None) if reach is not None or floor is not None else None
            if need is not None and bound < need:
                break
    return got_i, got_s, scored


def top_k(vectors: DataFrame, queries: DataFrame, id_col: str, vec_col: str, k: int = 10, scale: float = 1024.0, block_rows: int = 4096, query_rows: int = 1024, slice_rows: int = 65536, slice_queries: int = 16384) -> DataFrame:
    """(query_id, rank, vec_id, score): the k candidates with the highest inner product, ties to the smaller id."""
    own = integer_vectors(queries, id_col, vec_col, scale).groupBy("id").agg(F.min("v").alias("v"))
    rows, asked = (df.agg(F.count("*")).first()[0] for df in (vectors, queries))
    # A slice holds slice_rows vectors; smaller tables are cut further, to have work for every core.
    v_slices = max(-(-rows // slice_rows), min(-(-rows // block_rows), vectors.sparkSession.sparkContext.defaultParallelism), 1)
    q_slices = max(-(-asked // slice_queries), 1)
    dealt = lambda ids, n: F.pmod(F.xxhash64(F.substring(ids, 1, 8)), F.lit(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    keys, tasks = ["dims", "v_slice", "q_slice"], 2 * v_slices * q_slices
    qb = blocks(own, query_rows, lists=False).select("dims", F.col("ids").alias("q_ids"), F.col("rows").alias("q_rows"), dealt("ids", q_slices).alias("q_slice"), all_of(v_slices).alias("v_slice"))
    vb = blocks(integer_vectors(vectors, id_col, vec_col, scale), block_rows, lists=True).withColumn("v_slice", dealt("ids", v_slices)).withColumn("q_slice", all_of(q_slices))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            for row in batch.to_pylist():
                d, ids = row["dims"], np.frombuffer(row["ids"], "<i8")
                mat, order = np.frombuffer(row["rows"], "<i8").reshape(-1, d), np.frombuffer(row["lists"], "<i4").reshape(d, -1)
                q_ids, q_mat = np.frombuffer(row["q_ids"], "<i8"), np.frombuffer(row["q_rows"], "<i8").reshape(-1, d)
                if float(np.abs(mat.astype(float)).max(initial=0)) * float(np.abs(q_mat.astype(float)).max(initial=0)) * d >= 2.0**63:
                    raise OverflowError("a score could pass 64 bits")
                out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
                for own_id, q in zip(q_ids.tolist(), q_mat, strict=True):
                    before = known.get(own_id, np.zeros(0, np.int64))
                    got_i, got_s, _ = walk(q, own_id, ids, mat, order, k, int(before[-1]) if len(before) == k else None)
                    known[own_id] = -np.sort(-np.concatenate([before, got_s]))[:k]
                    if len(known[own_id]) == k:
                        fits = got_s >= known[own_id][-1]
                        got_i, got_s = got_i[fits], got_s[fits]
                    out.append((np.full(len(got_i), own_id), got_i, got_s))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[c] for o in out]).astype(np.int64)) for c in range(3)], names=["query_id", "vec_id", "score"])

    # Both sides are dealt alike beforehand, so that no small slice is merged with others.
    met = vb.repartition(tasks, *keys).join(qb.repartition(tasks, *keys), keys).select("dims", "ids", "rows", "lists", "q_ids", "q_rows")
    hits = met.mapInArrow(search, HIT)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
