"""Exact top-k inner products by norm-bucketed retrieval.

A block's vectors lie in buckets of falling length. A query carries its k-th best product so far; divided by the query's
length and the bucket's greatest, it is the cosine that a row of the bucket has to reach. Above 1 the bucket is left out;
where it is high, coordinate pruning keeps the rows whose strongest coordinates can still reach it; otherwise length
pruning keeps the rows that are long enough. What is left is verified by exact integer products.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from marketlake.llm import vectors

BUCKET = 512
#: Local cosine threshold from which coordinates prune more than lengths, and coordinates looked at.
COORDINATES_FROM = 0.6
FOCUS = 3
#: Bounds are compared with this slack, so that rounding never prunes a row.
SLACK = 1 + 1e-9

_LONG = 2**63 - 1


def quantized(m: np.ndarray) -> np.ndarray:
    """floor(1024 * x) as doubles (exact: 1024 is a power of two)."""
    return np.floor(np.ldexp(m, 10))


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products: in doubles where they hold every sum exactly, otherwise in Python integers."""
    if a.size and b.size and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2**53:
        return (a @ b.T).astype(np.int64)
    whole = [[int(x) for x in row] for row in a.tolist()], [[int(x) for x in row] for row in b.tolist()]
    sums = [[sum(x * y for x, y in zip(p, q, strict=True)) for q in whole[1]] for p in whole[0]]
    return np.array([[max(-_LONG - 1, min(_LONG, s)) for s in row] for row in sums], np.int64).reshape(len(a), len(b))


def _may_reach(asked: np.ndarray, unit: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Coordinate pruning: (query, row) pairs whose strongest coordinates leave room for the cosine ``least``."""
    out = np.ones((len(asked), len(unit)), bool)
    strongest = np.argsort(-np.abs(asked), axis=1)[:, :FOCUS]
    for f in strongest.T:
        q, x = asked[np.arange(len(asked)), f][:, None], unit[:, f].T
        rest = np.sqrt(np.maximum(0, 1 - q * q)) * np.sqrt(np.maximum(0, 1 - x * x))
        out &= (q * x + rest) * SLACK + 1e-9 >= least[:, None]
    return out


def largest(
        ids: np.ndarray, m: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, top: int = 10) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query positions, row positions and products of the ``top`` largest integer products in a block."""
    m, queries = quantized(m), quantized(queries)
    with np.errstate(over="ignore", invalid="ignore"):
        norms, query_norms = np.sqrt((m * m).sum(axis=1)), np.sqrt((queries * queries).sum(axis=1))
        asked = np.nan_to_num(queries / np.where(query_norms > 0, query_norms, 1)[:, None])
        unit = np.nan_to_num(m / np.where(norms > 0, norms, 1)[:, None])
    order = np.argsort(-norms, kind="stable")
    bounded = np.isfinite(norms).all() and np.isfinite(query_norms).all()
    kept = np.full((len(queries), top), -_LONG - 1, np.int64)
    full = np.zeros(len(queries), np.int64)
    found = []
    for start in range(0, len(order), BUCKET):
        bucket = order[start : start + BUCKET]
        longest = norms[bucket[0]]
        reach = query_norms * longest
        with np.errstate(divide="ignore", invalid="ignore"):
            least = np.where(reach > 0, kept[:, 0] / reach, np.where(kept[:, 0] > 0, np.inf, -np.inf))
        open_queries = np.flatnonzero((full < top) | (least <= SLACK)) if bounded else np.arange(len(queries))
        if not len(open_queries):
            continue
        able = np.ones((len(open_queries), len(bucket)), bool)
        if bounded:
            sure = full[open_queries] >= top
            by_place = sure & (least[open_queries] >= COORDINATES_FROM)
            if by_place.any():
                able[by_place] = _may_reach(asked[open_queries[by_place]], unit[bucket], least[open_queries[by_place]])
            by_length = sure & ~by_place & (kept[open_queries, 0] > 0)
            able[by_length] = query_norms[open_queries[by_length], None] * norms[bucket] * SLACK >= kept[open_queries[by_length], 0, None]
        able &= ids[bucket][None, :] != query_ids[open_queries, None]
        some = np.flatnonzero(able.any(axis=0))
        if not len(some):
            continue
        able, bucket = able[:, some], bucket[some]
        scores = _product(queries[open_queries], m[bucket])
        ranked = np.where(able, scores, -_LONG - 1)
        best = np.sort(np.concatenate([kept[open_queries], ranked], axis=1), axis=1)[:, -top:]
        kept[open_queries] = best
        full[open_queries] += able.sum(axis=1)
        at, row = np.nonzero(able & (scores >= best[:, :1]))
        found.append((open_queries[at], bucket[row], scores[at, row]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, row, score = (np.concatenate(x) for x in zip(*found, strict=True))
    return vectors.best(at, row, score, top)


def search(rows: DataFrame, every: int = 100, top: int = 10) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``top`` largest integer inner products of every row whose id ``every`` divides.

    Components are floor(1024 * x); scores are exact, and held at the limits of a long beyond them. Largest first, equal
    scores by the smaller id; the query's own row is no candidate. Vectors that are null, empty, or hold null or non-finite
    numbers take no part, nor do rows without an id; vectors of different dimensions never meet; a zero vector has products
    of 0. Repeated ids: see ``vectors.usable``. Other columns are ignored; an empty table gives no rows.
    """
    return vectors.search(vectors.usable(rows), every, top, "long", lambda *block: largest(*block, top))
