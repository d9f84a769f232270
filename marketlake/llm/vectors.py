"""Vectors in bounded blocks: every stated query meets every block of rows, in tasks of bounded size."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlake.llm.common import small_batches, stored

#: Rows of a data block and of a query block.
DATA_BLOCK = 8192
QUERY_BLOCK = 2048


def usable(vectors: DataFrame) -> DataFrame:
    """``(vec_id, dim, v array<double>)`` of the vectors that are not null or empty and hold finite numbers only.

    Rows that are equal count once. An id that is given with different vectors is a candidate with each of them; as a query it asks
    with the one that is least in array order, and none of its own vectors is its candidate.
    """
    v = F.col("embedding").cast("array<double>")
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(F.col("vec_id").isNotNull()).select("vec_id", v.alias("v")).where(
        F.col("v").isNotNull() & (F.size("v") > 0) & finite).distinct().select("vec_id", F.size("v").alias("dim"), "v")


def search(
        rows: DataFrame, every: int, top: int, score_type: str,
        work: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the best ``top`` of what ``work`` returns for every query in every block.

    Queries are the rows whose id ``every`` divides, candidates all rows of the same dimension. Rows are dealt into blocks by
    a hash of the id, rows to each query block and queries to each data block, so that a task holds one block of either
    kind however many there are; a task returns at most ``top`` rows a query. ``work`` gets ids and matrices of the block's
    rows and of its queries, and returns query positions, row positions and scores.
    """
    small_batches(rows.sparkSession)
    rows = stored(rows, "vectors")
    queries = stored(rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v")).select(
        "vec_id", F.size("v").alias("dim"), "v"), "queries")
    asking = {r["dim"]: r["n"] for r in queries.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    sizes = {r["dim"]: (r["n"], asking.get(r["dim"], 0)) for r in rows.groupBy("dim").agg(F.count("*").alias("n")).orderBy("dim").collect()}
    parts = []
    for dim, (n, q) in sizes.items():
        data_blocks, query_blocks = -(-n // DATA_BLOCK), -(-q // QUERY_BLOCK)
        own = rows.where(F.col("dim") == dim)
        block = lambda salt, k: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(k)).cast("int")  # noqa: E731, B023
        everywhere = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
        if not q:
            continue
        data = own.select(F.lit(dim).alias("dim"), block(1, data_blocks).alias("d"), everywhere(query_blocks).alias("q"), "vec_id", "v")
        asked = queries.where(F.col("dim") == dim).select(
            F.lit(dim).alias("dim"), everywhere(data_blocks).alias("d"), block(2, query_blocks).alias("q"), "vec_id", "v")
        parts.append((data, asked))
    schema = f"query_id long, vec_id long, score {score_type}"
    if not parts:
        return rows.sparkSession.createDataFrame([], f"query_id long, rank int, vec_id long, score {score_type}")

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        kinds = {"query_id": pa.int64(), "vec_id": pa.int64(), "score": pa.float64() if score_type == "double" else pa.int64()}
        if not left.num_rows or not right.num_rows:
            return pa.table({k: pa.array([], t) for k, t in kinds.items()})
        ids, m = _matrix(left)
        query_ids, queries = _matrix(right)
        at, row, score = work(ids, m, query_ids, queries)
        return pa.table({"query_id": query_ids[at], "vec_id": ids[row], "score": pa.array(score, kinds["score"])})

    data, asked = parts[0]
    for more in parts[1:]:
        data, asked = data.union(more[0]), asked.union(more[1])
    found = data.groupBy("dim", "d", "q").cogroup(asked.groupBy("dim", "d", "q")).applyInArrow(both, schema)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids and matrix in ascending order of the ids."""
    table = table.combine_chunks().sort_by([("vec_id", "ascending")])
    ids = np.array(table.column("vec_id"))
    flat = np.array(table.column("v").combine_chunks().flatten())
    return ids, np.ascontiguousarray(flat.reshape(len(ids), -1))


def best(at: np.ndarray, row: np.ndarray, score: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``top`` highest scores of each query position; of equals the smaller row position (ids ascend with it)."""
    order = np.lexsort((row, -score, at))
    at, row, score = at[order], row[order], score[order]
    first = np.concatenate([[True], at[1:] != at[:-1]]) if len(at) else np.zeros(0, bool)
    place = np.arange(len(at)) - np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
    keep = place < top
    return at[keep], row[keep], score[keep]
