"""Approximate nearest neighbours by a hash-prefix forest.

Every tree gives each vector a long string of sign bits of random projections and keeps a block's strings as a sorted array.
A query descends in all trees to its longest matching prefixes, then ascends in all trees together to shorter ones; rows
whose strings share the prefix become candidates. It stops ascending when shorter prefixes can hardly matter: if the k-th
best candidate so far stands at angle t, a closer row agrees in a bit with probability 1 - t / pi at least, so that all
trees miss it at this depth with probability (1 - p ** depth) ** trees at most. The stop depends on the query's own
neighbours; no number of candidates is capped, and a query that finds nothing close ascends to the root, which is exact.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlake.llm import vectors

TREES = 10
#: Bits of a string.
BITS = 48
#: Chance of missing a row as near as the k-th candidate, at which a query stops.
MISS = 0.06
#: Prefix lengths at which queries look at their candidates, deepest first.
DEPTHS = (48, 40, 32, 24, 20, 16, 14, 12, 10, 9, 8, 7, 6, 5, 4, 3, 2, 1, 0)
#: Depth up to which candidates are few enough to take their products one by one; above it, by matrix.
FEW = 9


def needed_cosine(depth: int, trees: int, miss: float) -> float:
    """The cosine that the k-th candidate must have for a query to stop at ``depth``."""
    return -1.0 if depth == 0 else float(np.cos(np.pi * (1 - (1 - miss ** (1 / trees)) ** (1 / depth))))


def _strings(unit: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """One number a row: the signs of its projections, the first plane's in the highest bit."""
    weights = np.uint64(1) << np.arange(len(planes) - 1, -1, -1, dtype=np.uint64)
    return (unit @ planes.T > 0).astype(np.uint64) @ weights


def longest_prefixes(unit: np.ndarray, queries: np.ndarray, trees: int = TREES, bits: int = BITS, seed: int = 5) -> np.ndarray:
    """For every query and row, the longest prefix (in ``DEPTHS``) that their strings share in any tree."""
    random = np.random.default_rng(seed)
    deepest = np.zeros((len(queries), len(unit)), np.int8)
    for _ in range(trees):
        planes = random.normal(size=(bits, unit.shape[1]))
        strings, asked = _strings(unit, planes), _strings(queries, planes)
        order = np.argsort(strings, kind="stable")
        in_order = strings[order]
        lengths = np.zeros_like(deepest)
        for depth in DEPTHS[-2::-1]:  # descend: every longer prefix is a shorter run of the sorted array
            shift = np.uint64(bits - depth)
            first = (asked >> shift) << shift
            low = np.searchsorted(in_order, first, side="left")
            high = np.searchsorted(in_order, first | ((np.uint64(1) << shift) - np.uint64(1)), side="right")
            matched = np.flatnonzero(high > low)
            if not len(matched):
                break
            for k, a, b in zip(matched.tolist(), low[matched].tolist(), high[matched].tolist(), strict=True):
                lengths[k, a:b] = depth
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        np.maximum(deepest, lengths[:, back], out=deepest)
    return deepest


def _scaled(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows times a power of two (no rounding, no overflow in the squares), and their lengths."""
    _, exponent = np.frexp(np.abs(m).max(axis=1))
    m = np.ldexp(m, -exponent[:, None])
    return m, np.sqrt((m * m).sum(axis=1))


def nearest(
        ids: np.ndarray, m: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, top: int = 5, trees: int = TREES,
        miss: float = MISS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query positions, row positions and exact cosines of the ``top`` nearest candidates in a block."""
    (m, norms), (queries, query_norms) = _scaled(m), _scaled(queries)
    unit, asked = m / norms[:, None], queries / query_norms[:, None]
    deepest = longest_prefixes(unit, asked, trees)
    for k, (a, b) in enumerate(zip(np.searchsorted(ids, query_ids), np.searchsorted(ids, query_ids, side="right"), strict=True)):
        deepest[k, a:b] = -1  # its own rows
    stop = np.full(len(asked), -1)

    def ascend(depths: tuple[int, ...], at: np.ndarray, row: np.ndarray, cosine: np.ndarray) -> None:
        """Stop the queries that have ``top`` candidates as near as each depth needs, deepest depth first."""
        depth_of = deepest[at, row]
        for depth in depths:
            near = (depth_of >= depth) & (cosine >= needed_cosine(depth, trees, miss))
            stop[(stop < 0) & (np.bincount(at[near], minlength=len(asked)) >= top)] = depth

    at, row = np.nonzero(deepest >= FEW)
    ascend(tuple(d for d in DEPTHS if d >= FEW), at, row, (asked[at] * unit[row]).sum(axis=1))
    pairs = [(at[keep], row[keep]) for keep in [deepest[at, row] >= np.where(stop < 0, 127, stop)[at]]]
    rest = np.flatnonzero(stop < 0)
    if len(rest):
        cosine = asked[rest] @ unit.T
        shallow = tuple(d for d in DEPTHS if d < FEW)
        high = tuple(d for d in shallow if needed_cosine(d, trees, miss) > 0.2)
        at, row = np.nonzero(cosine >= needed_cosine(high[-1], trees, miss))
        ascend(high, rest[at], row, cosine[at, row])
        for depth in [d for d in shallow if d not in high]:
            some = np.flatnonzero(stop[rest] < 0)
            enough = (deepest[rest[some]] >= depth) & (cosine[some] >= needed_cosine(depth, trees, miss) - (depth == 0))
            stop[rest[some[enough.sum(axis=1) >= (top if depth else 0)]]] = depth
        cosine[deepest[rest] < stop[rest, None]] = -2
        cosine[deepest[rest] < 0] = -2
        floor = np.partition(cosine, -top, axis=1)[:, -top] if len(ids) >= top else np.full(len(rest), -2.0)
        at, row = np.nonzero((cosine >= floor[:, None] - 1e-9) & (cosine > -1.5))
        pairs.append((rest[at], row))
    at, row = (np.concatenate(x) for x in zip(*pairs, strict=True))
    exact = (queries[at] * m[row]).sum(axis=1) / (query_norms[at] * norms[row])
    return vectors.best(at, row, exact, top)


def search(rows: DataFrame, every: int = 50, top: int = 5, trees: int = TREES, miss: float = MISS) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: up to ``top`` nearest rows by cosine of every row whose id ``every`` divides.

    Nearest first, equal scores by the smaller id; the query's own row is no candidate, an equal vector of another id is.
    The score is the exact cosine of the original vectors in double precision. Vectors that are null, empty, zero, or hold
    null or non-finite numbers take no part, nor do rows without an id; vectors of different dimensions never meet. Repeated
    ids: see ``vectors.usable``. Other columns are ignored; an empty table gives no rows.
    """
    rows = vectors.usable(rows).where(F.exists("v", lambda x: x != 0))
    return vectors.search(rows, every, top, "double", lambda *block: nearest(*block, top, trees, miss))
