"""Exact top-k by inner product: tiles of queries times shards, partial selection, tree merge.

Vectors are packed where they are read into shards, queries into tiles; both are small matrices.
Groups of shards meet groups of tiles by shuffle, each pair in one call, so neither side is ever whole in one task
or on the driver. A call keeps the ``k`` best of each query over all its shards; lists merge in two levels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARD_ROWS, TILE_ROWS = 4096, 256
_PACKED = "dim int, wide boolean, ids binary, matrix binary"


def _whole_numbers(column: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """floor(scale * x) as doubles, flat; the length of each row; which rows take part."""
    column = column.cast(pa.large_list(pa.float64()))
    offsets = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)[offsets[0]:offsets[-1]]  # null: nan
    offsets = offsets - offsets[0]
    with np.errstate(over="ignore", invalid="ignore"):
        flat = np.floor(flat * scale)
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(flat))))
    sizes = np.diff(offsets)
    good = (bad[offsets[1:]] == bad[offsets[:-1]]) & (sizes > 0) & column.is_valid().to_numpy(zero_copy_only=False)
    return flat, offsets, good


def _pack(rows: int, scale: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list] = {}

        def out(dim: int):
            ids = np.concatenate([x for x, _ in waiting[dim]])
            m = np.concatenate([x for _, x in waiting[dim]])
            del waiting[dim]
            order = np.argsort(ids, kind="stable")
            ids, m = ids[order], m[order]
            wide = bool(np.abs(m).max() >= 2**31)
            m = m if wide else m.astype(np.int32)
            return pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), "wide": [wide], "ids": [ids.astype("<i8").tobytes()], "matrix": [m.tobytes()]})

        for batch in batches:
            ids = batch.column(0)
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
            flat, offsets, good = _whole_numbers(batch.column(1), scale)
            sizes = np.diff(offsets)
            for dim in np.unique(sizes[good & known]).tolist():
                at = np.flatnonzero(good & known & (sizes == dim))
                for a in range(0, len(at), rows):
                    part = at[a:a + rows]
                    waiting.setdefault(dim, []).append((ids[part], flat[offsets[part][:, None] + np.arange(dim)]))
                    if sum(len(x) for x, _ in waiting[dim]) >= rows:
                        yield out(dim)
        for dim in list(waiting):
            yield out(dim)

    return pack


def products(q: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-number matrices; beyond a long they stop at its ends."""
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(m).max(initial=0)) * q.shape[1]
    if bound < 2**53:  # every partial sum is exact in a double
        return (q.astype(np.float64) @ m.astype(np.float64).T).astype(np.int64)
    exact = np.vectorize(int, otypes=[object])
    full = exact(q) @ exact(m).T
    return np.clip(full, -(2**63), 2**63 - 1).astype(np.int64)


def best_of(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> np.ndarray:
    """Positions of the ``k`` best other rows; ``ids`` ascend, ties go to the smaller id."""
    at = np.flatnonzero(ids != own)
    s = scores[at]
    if len(s) > k:
        least = np.partition(s, len(s) - k)[len(s) - k]
        above = np.flatnonzero(s > least)
        at = at[np.concatenate((above, np.flatnonzero(s == least)[:k - len(above)]))]
    return at


def _matrices(table: pa.Table, prefix: str = "") -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) of the packed rows of a table, read where they lie."""
    for dim, wide, ids, matrix in zip(*(table.column(c) for c in ("dim", f"{prefix}wide", f"{prefix}ids", f"{prefix}matrix"))):
        kind = np.float64 if wide.as_py() else np.int32
        yield np.frombuffer(ids.as_buffer(), "<i8"), np.frombuffer(matrix.as_buffer(), kind).reshape(-1, dim.as_py())


def _candidates(own: np.ndarray, q: np.ndarray, ids: np.ndarray, m: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of the ``k`` best rows of one shard for each query of one tile; the query is its place in the tile."""
    scores = products(q, m)
    first = np.flatnonzero(np.diff(ids, prepend=ids[0] - 1 if ids[0] > -(2**63) else 0) != 0) if len(ids) > 1 else np.zeros(1, int)
    first[:1] = 0
    if len(first) < len(ids):  # rows that share an id stand for their best
        scores, ids = np.maximum.reduceat(scores, first, axis=1), ids[first]
    found = [best_of(s, ids, x, k) for s, x in zip(scores, own, strict=True)]
    at, who = np.concatenate(found).astype(int), np.repeat(np.arange(len(own)), [len(x) for x in found])
    return who, ids[at], scores[who, at]


def _merged(lists: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best of each query among several lists of (query, id, score); an id of several lists counts once, with its best."""
    who, ids, scores = (np.concatenate(x) for x in zip(*lists))
    order = np.lexsort((~scores, ids, who))  # ~: descending, and the least long has no negative
    who, ids, scores = who[order], ids[order], scores[order]
    new = np.ones(len(who), bool)
    new[1:] = (who[1:] != who[:-1]) | (ids[1:] != ids[:-1])
    who, ids, scores = who[new], ids[new], scores[new]
    order = np.lexsort((ids, ~scores, who))
    who, ids, scores = who[order], ids[order], scores[order]
    kept = np.arange(len(who)) - np.searchsorted(who, who) < k
    return who[kept], ids[kept], scores[kept]


def _multiply(k: int):
    """A function of the shards and the tiles of one deal to the ``k`` best of each query among those shards."""
    def multiply(shards: pa.Table, tiles: pa.Table) -> pa.Table:
        out = []
        for own, q in _matrices(tiles, "q_"):
            best = None
            for ids, m in _matrices(shards):
                found = _candidates(own, q, ids, m, k)
                best = found if best is None else _merged([best, found], k)
            if best is not None:
                out.append((own[best[0]], best[1], best[2]))
        columns = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 3
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])

    return multiply


def _deals(partitions: int, n_rows: int, n_asked: int) -> tuple[int, int]:
    """Groups of shards and of tiles, ``partitions`` pairs of groups at most.

    Each shard goes to every group of tiles and each tile to every group of shards, so what is dealt out is least
    where both sides send as much; a group of shards holds 32 at most, as it passes to Python whole.
    """
    sides = max(1, min(partitions, round((partitions * max(1, n_rows) / max(1, n_asked)) ** 0.5)))
    return max(sides, -(-n_rows // (32 * SHARD_ROWS))), max(1, partitions // sides)


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding", scale: int = 1024,
          groups: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` highest scores of each query among all other rows.

    Components become floor(scale * x), x as double; the score is their exact inner product (past
    the ends of a long: the end). Ties go to the smaller id. Vectors that are null or empty, hold a
    null or a non-finite component, or have a null id take no part; vectors of different lengths do
    not meet. Rows that share an id stand for their best score, as a query for each of their vectors
    together. An empty table, or one without queries, gives no rows. Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("vector"))
    asked = vectors.filter(is_query).select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("vector"))
    n_asked = asked.count()
    by_shard, by_tile = (groups, 1) if groups else _deals(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.count(), n_asked)
    others = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    shards = (rows.mapInArrow(_pack(SHARD_ROWS, scale), _PACKED)
              .select("dim", "wide", "ids", "matrix", F.pmod(F.xxhash64("ids"), F.lit(by_shard)).cast("int").alias("s"), others(by_tile).alias("t")))
    tiles = (asked.repartition(max(1, -(-n_asked // TILE_ROWS))).mapInArrow(_pack(TILE_ROWS, scale), _PACKED)
             .select("dim", F.col("wide").alias("q_wide"), F.col("ids").alias("q_ids"), F.col("matrix").alias("q_matrix"),
                     F.pmod(F.xxhash64("ids"), F.lit(by_tile)).cast("int").alias("t"), others(by_shard).alias("s")))
    # both sides meet by shuffle, whatever their sizes: a tile repeats for each group of shards, which an estimate of its size leaves out
    pairs = by_shard * by_tile
    deal = F.col("dim").cast("long") * pairs + F.col("s") * by_tile + F.col("t")
    dealt = [df.withColumn("deal", deal).drop("s", "t").repartition(pairs, "deal").groupBy("deal") for df in (shards, tiles)]
    lists = dealt[0].cogroup(dealt[1]).applyInArrow(_multiply(k), "query_id long, vec_id long, score long")
    lists = lists.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = [F.col("score").desc(), F.col("vec_id")]
    for keys in (["query_id", F.pmod(F.xxhash64("vec_id"), F.lit(16))], ["query_id"]):
        lists = lists.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)
    return lists.select("query_id", "rank", "vec_id", "score")
