"""Regression trees of forests and boosted models, each grown whole in one task from rows that fit it.

Spark's own trees open one level a job and send statistics of all open nodes through a shuffle; below the first levels that costs
far more than the rows themselves. Here the prepared rows are packed once into small codes, every task gets all of them, and trees
(of a forest) or whole fits (of a boosted model) are the tasks. The fits follow Spark's: the same split candidates (of all rows
instead of a sample), variance as impurity, Poisson bags, a third of the slots drawn for each node, the same stopping rules. The random
draws are other ones. Fitted ensembles are written in Spark's format and loaded as Spark models.

Rows beyond ``MOST_BYTES`` are not packed; callers then fit with Spark's distributed trees.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from marketlake.session import package_on_workers, shared_dir
from marketlake.sources.files import file_system

#: Size of the prepared rows (8 bytes a number, 1 a binary slot) up to which a task holds them all.
MOST_BYTES = 256 << 20
#: Rows and cells of histograms that are looked at together.
CHUNK_ROWS, CHUNK_CELLS, JOINT_CELLS = 1 << 17, 1 << 18, 1 << 11
#: Nodes with fewer rows than a number's bins by this factor have the rows sorted instead of all bins filled.
FEW = 3
#: Differences below this share of a node's squares are rounding.
ROUNDING = 1e-12
#: Settings that these fits follow only at their defaults.
PLAIN = {
    "subsamplingRate": 1.0, "impurity": "variance", "minInfoGain": 0.0, "minWeightFractionPerNode": 0.0, "bootstrap": True, "lossType": "squared"}
WIDEST = 255

_BLOCK = pa.schema({"numbers": pa.binary(), "flags": pa.binary(), "label": pa.binary(), "fold": pa.binary(), "rows": pa.int32()})
_PACKED = pa.schema({"part": pa.int32(), "slots": pa.list_(pa.int32()), "values": pa.binary(), "codes": pa.binary(), "width": pa.int32()})
_SUMS = pa.schema({"fit": pa.int32(), "bucket": pa.int32(), "depth": pa.int32(), "sums": pa.binary()})
_ERRORS = pa.schema({"fit": pa.int32(), "size": pa.int32(), "depth": pa.int32(), "error": pa.float64()})
_SPLIT = {"featureIndex": pa.int32(), "leftCategoriesOrThreshold": pa.list_(pa.float64()), "numCategories": pa.int32()}
_NODE = {
    "id": pa.int32(), "prediction": pa.float64(), "impurity": pa.float64(), "impurityStats": pa.list_(pa.float64()), "rawCount": pa.int64(),
    "gain": pa.float64(), "leftChild": pa.int32(), "rightChild": pa.int32(), "split": pa.struct(_SPLIT)}
_NODES = pa.schema({"treeID": pa.int32(), "nodeData": pa.struct(_NODE)})


@dataclass
class Columns:
    """Rows as codes, one line a column. A number's code is its bin; exclusive binary slots share a column, whose code is 1 + the place of the set one."""

    codes: np.ndarray
    slots: list[np.ndarray]
    #: Upper ends of a number's bins; None for binary slots.
    ends: list[np.ndarray | None]

    def __post_init__(self):
        self.widths = [len(s) + 1 if e is None else len(e) + 1 for s, e in zip(self.slots, self.ends, strict=True)]
        #: Neighbouring columns whose codes together make at most ``JOINT_CELLS`` cells, and the cell of each row.
        self.joint: list[tuple[list[int], np.ndarray]] = []
        cells = JOINT_CELLS + 1
        for c, width in enumerate(self.widths):
            if cells * width > JOINT_CELLS:
                self.joint.append(([c], self.codes[c].astype(np.uint16)))
                cells = width
            else:
                columns, cell = self.joint[-1]
                self.joint[-1] = ([*columns, c], cell * np.uint16(width) + self.codes[c])
                cells *= width

    @property
    def size(self) -> int:
        return sum(map(len, self.slots))


@dataclass
class Level:
    """The nodes of one depth, from the left: count, sum and squares of their rows, and how they split (``left`` < 0: not at all)."""

    count: np.ndarray
    total: np.ndarray
    squares: np.ndarray
    column: np.ndarray
    code: np.ndarray
    gain: np.ndarray
    #: Place of the left child in the next level; the right one follows it.
    left: np.ndarray


def split_ends(values: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """Spark's split candidates of a number with these distinct sorted values and their counts: halfway between neighbours, at most ``most``."""
    values, counts = values[counts > 0], counts[counts > 0]
    middle = (values[:-1] + values[1:]) / 2
    if len(middle) <= most:
        return middle
    below = np.cumsum(counts)
    both, stride = below[:-1] + below[1:], below[-1] / (most + 1)
    found, at, target = [], 0, stride
    while (at := max(at, int(np.searchsorted(both, 2 * target, "right")))) < len(middle):
        found.append(middle[at])
        at, target = at + 1, target + stride
    return np.array(found)


class Packed:
    """All rows of a packed table in this task."""

    def __init__(self, table: pa.Table):
        lines = sorted(table.select(["part", "slots", "values", "codes", "width"]).to_pylist(), key=lambda x: x["part"])
        self.label, self.fold = (np.frombuffer(x["codes"], t) for x, t in zip(lines, (np.float64, np.int32)))
        self.columns = [
            (np.array(x["slots"]), None if x["values"] is None else np.frombuffer(x["values"]), np.frombuffer(x["codes"], f"u{x['width']}"))
            for x in lines[2:]]

    def binned(self, rows: np.ndarray, bins: int) -> Columns:
        """Codes of all rows, with the bins that the given ones make."""
        codes, ends = [], []
        for _, values, code in self.columns:
            if values is None:
                codes.append(code)
                ends.append(None)
            else:
                ends.append(split_ends(values, np.bincount(code[rows], minlength=len(values)), bins - 1))
                codes.append(np.searchsorted(ends[-1], values, "left").astype(np.uint8)[code])
        return Columns(np.array(codes, np.uint8), [s for s, _, _ in self.columns], ends)


def _small(codes: np.ndarray) -> np.ndarray:
    return codes.astype(np.min_scalar_type(int(codes.max(initial=0))))


def pack(rows: DataFrame, count: int, *estimators) -> DataFrame | None:
    """``features``, ``label`` and ``fold`` of all rows as one line a column, or nothing if they are too many for a task or need Spark's own fits.

    The order of the rows is that of their values: partitioning does not show in what is drawn for them.
    """
    attrs = rows.schema["features"].metadata.get("ml_attr", {}).get("attrs", {})
    size = rows.schema["features"].metadata.get("ml_attr", {}).get("num_attrs")
    binary = [a["idx"] for a in attrs.get("binary", [])]
    if size is None or "nominal" in attrs or not all(_plain(e) for e in estimators) or count * (8 * (size - len(binary)) + len(binary)) > MOST_BYTES:
        return None
    package_on_workers(rows.sparkSession)
    numbers = [k for k in range(size) if k not in set(binary)]

    def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            if batch["label"].null_count or batch["x"].null_count:
                raise ValueError("labels and features must not be null")
            x, label = batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(-1, size), batch["label"].to_numpy(zero_copy_only=False)
            if not (np.isfinite(x).all() and np.isfinite(label).all()):
                raise ValueError("labels and features must be finite")
            parts = (x[:, numbers], x[:, binary].astype(np.uint8), label, batch["fold"].to_numpy(zero_copy_only=False).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [*[pa.array([p.tobytes()], pa.binary()) for p in parts], pa.array([len(x)], pa.int32())], ["numbers", "flags", "label", "fold", "rows"])

    def lines(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [b for batch in batches for b in batch.to_pylist()]
        if not found:
            return
        x, flags = (np.concatenate([np.frombuffer(b[n], t).reshape(b["rows"], -1) for b in found])
                    for n, t in (("numbers", np.float64), ("flags", np.uint8)))
        label, fold = (np.concatenate([np.frombuffer(b[n], t) for b in found]) for n, t in (("label", np.float64), ("fold", np.int32)))
        columns = []
        for k, slot in enumerate(numbers):
            values, code = np.unique(x[:, k], return_inverse=True)
            columns.append(([slot], values.tobytes(), _small(code)))
        code, slots = np.zeros(len(label), np.uint8), []
        for k, slot in enumerate(binary):
            on = flags[:, k] > 0
            if slots and (len(slots) == WIDEST or code[on].any()):
                columns.append((slots, None, code))
                code, slots = np.zeros(len(label), np.uint8), []
            slots = [*slots, slot]
            code[on] = len(slots)
        if slots:
            columns.append((slots, None, code))
        order = np.lexsort([*[c for _, _, c in columns], label, fold])
        columns = [([], None, label), ([], None, fold), *columns]
        for part, (slots, values, code) in enumerate(columns):
            yield pa.RecordBatch.from_pylist(
                [{"part": part, "slots": slots, "values": values, "codes": code[order].tobytes(), "width": code.itemsize}], _PACKED)

    split = rows.select(vector_to_array("features").alias("x"), "label", "fold").mapInArrow(blocks, from_arrow_schema(_BLOCK))
    return split.repartition(1).mapInArrow(lines, from_arrow_schema(_PACKED)).persist(StorageLevel.MEMORY_AND_DISK)


def _plain(estimator) -> bool:
    kept = all(estimator.getOrDefault(n) == v for n, v in PLAIN.items() if estimator.hasParam(n))
    strategy = "auto" if isinstance(estimator, RandomForestRegressor) else "all"
    weighted = any(estimator.hasParam(n) and estimator.isDefined(n) for n in ("weightCol", "validationIndicatorCol"))
    return kept and not weighted and estimator.getMaxBins() <= WIDEST and estimator.getFeatureSubsetStrategy() == strategy


def _run(packed: DataFrame, jobs: list[dict], work: Callable[[dict, Packed], Iterator[pa.RecordBatch]], schema: pa.Schema) -> DataFrame:
    """``work`` on each job, one task a job; each task gets all packed rows by a broadcast."""
    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [b for b in batches if len(b)]
        if found:
            table = pa.Table.from_batches(found)
            yield from work(jobs[table["id"][0].as_py()], Packed(table))

    return packed.sparkSession.range(0, len(jobs), 1, len(jobs)).crossJoin(F.broadcast(packed)).mapInArrow(each, from_arrow_schema(schema))


def _chunks(sizes: np.ndarray, nodes: int) -> Iterator[tuple[int, int]]:
    ends, first = np.cumsum(sizes), 0
    while first < len(sizes):
        before = ends[first - 1] if first else 0
        last = min(max(int(np.searchsorted(ends, before + CHUNK_ROWS, "right")), first + 1), first + nodes, len(sizes))
        yield first, last
        first = last


def _joint_counts(x: Columns, rows, sizes, wy, w) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """(count, sum) of the rows by node and code for each column: one pass over the rows for several columns together."""
    nodes, found = len(sizes), {}
    for columns, cell in x.joint:
        shape = [nodes, *[x.widths[c] for c in columns]]
        cells = int(np.prod(shape[1:]))
        key = np.repeat(np.arange(nodes) * cells, sizes) + cell[rows]
        tables = [np.bincount(key, v, nodes * cells).reshape(shape) for v in (w, wy)]
        for axis, c in enumerate(columns, 1):
            others = tuple(k for k in range(1, len(shape)) if k != axis)
            found[c] = tuple(t.sum(axis=others) for t in tables)
    return found


def _best_splits(x: Columns, rows, sizes, wy, wr, count, total, least: int, some: int, rng):
    """(gain, column, code) of the best split of each node; ``rows`` lie node by node."""
    nodes, first = len(sizes), np.cumsum(sizes) - sizes
    base = total * total / count
    gain, column, code = np.zeros(nodes), np.full(nodes, -1), np.zeros(nodes, np.int64)
    drawn = None
    if some < x.size:
        drawn = rng.random((nodes, x.size))
        drawn = drawn <= np.partition(drawn, some - 1, axis=1)[:, some - 1:some]
    every = np.arange(nodes)
    joint = _joint_counts(x, rows, sizes, wy, wr) if nodes * JOINT_CELLS <= len(rows) else {}
    for c, (slots, ends, width) in enumerate(zip(x.slots, x.ends, x.widths, strict=True)):
        if width < 2:
            continue
        of, sz, r, r_wy, r_wr = every, sizes, rows, wy, wr
        if drawn is not None and ends is not None:
            of = np.flatnonzero(drawn[:, slots[0]])
            if not len(of):
                continue
        if len(of) < nodes and not joint:
            sz = sizes[of]
            mine = np.arange(sz.sum()) + np.repeat(first[of] - (np.cumsum(sz) - sz), sz)
            r, r_wy, r_wr = rows[mine], wy[mine], None if wr is None else wr[mine]
        here, n_of, s_of = len(of), count[of], total[of]
        key = None if joint else np.repeat(np.arange(here) * width, sz) + x.codes[c][r]
        if not joint and ends is not None and len(r) * FEW < here * width:
            found, best = _best_between(key, sz, width, r_wy, r_wr, n_of, s_of, least)
        else:
            n, s = (v[of] for v in joint[c]) if joint else (np.bincount(key, v, here * width).reshape(here, width) for v in (r_wr, r_wy))
            if ends is None:
                n, s = n[:, 1:], s[:, 1:]
            else:
                n, s = np.cumsum(n, axis=1)[:, :-1], np.cumsum(s, axis=1)[:, :-1]
            score = _score(n, s, n_of[:, None], s_of[:, None], least, drawn[:, slots] if drawn is not None and ends is None else True)
            best = score.argmax(axis=1)
            found, best = score[np.arange(here), best], best + (ends is None)
        found = found - base[of]
        better = found > gain[of]
        chosen = of[better]
        gain[chosen], column[chosen], code[chosen] = found[better], c, best[better]
    return gain, column, code


def _score(n, s, count, total, least: int, allowed):
    """What the squares of a node's two sides gain when its first holds ``n`` rows with sum ``s``."""
    rest, others = count - n, total - s
    allowed = (n >= least) & (rest >= least) & allowed
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(allowed, s * s / n + others * others / rest, -np.inf)


def _best_between(key, sizes, width: int, wy, w, count, total, least: int):
    """(score, code) of the best split of a number in nodes of fewer rows than it has bins: only ends of runs of equal codes are looked at."""
    place = int(len(key)).bit_length()
    order = np.sort((key << place) + np.arange(len(key)))  # numbers sort faster than their places
    key, order, ends = order >> place, order & ((1 << place) - 1), np.cumsum(sizes)
    first = ends - sizes
    n = np.arange(1.0, len(key) + 1) if w is None else np.cumsum(w[order])
    s = np.cumsum(wy[order])
    before_n, before_s = (np.repeat(np.where(first > 0, v[first - 1], 0.0), sizes) for v in (n, s))
    last = np.append(key[1:] != key[:-1], True)
    score = _score(n - before_n, s - before_s, np.repeat(count, sizes), np.repeat(total, sizes), least, last)
    found = np.maximum.reduceat(score, first)
    at = np.flatnonzero(score == np.repeat(found, sizes))[::-1]
    node = np.repeat(np.arange(len(sizes)), sizes)
    best = np.zeros(len(sizes), np.int64)
    best[node[at]] = key[at] - node[at] * width
    return found, best


def _goes_right(x: Columns, column: np.ndarray, code: np.ndarray, repeats: np.ndarray | None, rows: np.ndarray) -> np.ndarray:
    """Whether the rows go right at splits of these columns and codes: one a row, or one for as many rows as ``repeats`` says."""
    binary = np.array([e is None for e in x.ends])[column]
    above, most, start = (code - binary).astype(np.int16), np.where(binary, code, WIDEST + 1).astype(np.int16), column * x.codes.shape[1]
    if repeats is not None:
        above, most, start = (np.repeat(v, repeats) for v in (above, most, start))
    value = x.codes.ravel()[start + rows]
    return (value > above) & (value <= most)


def grow(x: Columns, rows: np.ndarray, y: np.ndarray, w: np.ndarray | None, depth: int, least: int, some: int, rng, leaf: np.ndarray | None = None) -> list[Level]:
    """The tree of the given rows, level by level; ``leaf`` takes the mean of each row's leaf.

    The rows of a node lie together, so a level costs one pass over the rows that are still in open nodes, however many these are.
    """
    levels, sizes = [], np.array([len(rows)])
    while True:
        nodes, first = len(sizes), np.cumsum(sizes) - sizes
        yr, wr = y[rows], None if w is None else w[rows]
        wy = yr if w is None else wr * yr
        count = sizes.astype(float) if w is None else np.add.reduceat(wr, first)
        total, squares = np.add.reduceat(wy, first), np.add.reduceat(wy * yr, first)
        level = Level(count, total, squares, np.full(nodes, -1), np.zeros(nodes, np.int64), np.full(nodes, -1.0), np.full(nodes, -1))
        levels.append(level)
        tried = (count >= 2 * least) & (squares - total * total / count > ROUNDING * squares) & (len(levels) <= depth)
        for a, b in _chunks(sizes, max(1, CHUNK_CELLS // max(x.widths))):
            of = np.flatnonzero(tried[a:b])
            if not len(of):
                continue
            part = slice(first[a], first[b - 1] + sizes[b - 1])
            mine, mine_wy, mine_wr = rows[part], wy[part], None if w is None else wr[part]
            if len(of) < b - a:
                inner = np.repeat(tried[a:b], sizes[a:b])
                mine, mine_wy, mine_wr = mine[inner], mine_wy[inner], None if w is None else mine_wr[inner]
            of += a
            found, column, code = _best_splits(x, mine, sizes[of], mine_wy, mine_wr, count[of], total[of], least, some, rng)
            good = found > ROUNDING * squares[of]
            level.column[of[good]], level.code[of[good]], level.gain[of[good]] = column[good], code[good], found[good] / count[of[good]]
        inner = level.column >= 0
        split = np.flatnonzero(inner)
        level.left[split] = 2 * np.arange(len(split))
        if len(split) < nodes:
            stays = np.repeat(inner, sizes)
            if leaf is not None:
                leaf[rows[~stays]] = np.repeat((total / count)[~inner], sizes[~inner])
            if not len(split):
                return levels
            rows, sizes = rows[stays], sizes[split]
        right = _goes_right(x, level.column[split], level.code[split], sizes, rows)
        # The left rows of a node move to the front of its range, the right ones behind them, both in their order.
        left_rows, right_rows = rows[~right], rows[right]
        rights = np.add.reduceat(right, np.cumsum(sizes) - sizes, dtype=np.int64)
        lefts = sizes - rights
        moved = np.empty_like(rows)
        moved[np.arange(len(left_rows)) + np.repeat(np.cumsum(rights) - rights, lefts)] = left_rows
        moved[np.arange(len(right_rows)) + np.repeat(np.cumsum(lefts), rights)] = right_rows
        rows, sizes = moved, np.column_stack([lefts, rights]).ravel()


def predicted(x: Columns, levels: list[Level], rows: np.ndarray, depths: list[int]) -> list[np.ndarray]:
    """What the tree, cut at each of the depths, says of the rows."""
    value = np.empty(len(rows))
    alive, node, found = np.arange(len(rows)), np.zeros(len(rows), np.int64), {}
    for d, level in enumerate(levels):
        value[alive] = (level.total / level.count)[node]
        if d in depths:
            found[d] = value.copy()
        inner = level.left[node] >= 0
        alive, node = alive[inner], node[inner]
        node = level.left[node] + _goes_right(x, level.column[node], level.code[node], None, rows[alive])
    return [found.get(d, value) for d in depths]


def _bag(packed: Packed, train: np.ndarray, seed: int, tree: int):
    rng = np.random.default_rng([seed % (1 << 32), tree])
    weight = np.zeros(len(packed.label))
    weight[train] = rng.poisson(1.0, len(train))
    if not weight.any():
        weight[train] = 1.0
    return weight, rng


def _drawn(size: int, trees: int) -> int:
    """Slots drawn for a node: a third, or all for a single tree."""
    return size if trees == 1 else -(-size // 3)


def _parts(first: int, last: int, parts: int) -> list[tuple[int, int]]:
    edges = np.linspace(first, last, min(parts, last - first) + 1).astype(int)
    return [(int(a), int(b)) for a, b in zip(edges[:-1], edges[1:])]


def _cores(df: DataFrame) -> int:
    return df.sparkSession.sparkContext.defaultParallelism


def forest_search(packed: DataFrame, estimator: RandomForestRegressor, fits: list[tuple[dict, int]], sizes: list[int], depths: list[int]) -> list[dict[tuple[int, int], float]]:
    """For each (parameters, held fold) the mean squared error on the held rows of the first ``size`` trees cut at ``depth``, for all of both."""
    bounds, seed = [0, *sorted(set(sizes))], estimator.getSeed()
    parts = -(-4 * _cores(packed) // (len(fits) * (len(bounds) - 1)))
    most, deepest = bounds[-1], max(depths)
    cuts = sorted(set(depths))
    jobs = [
        {"fit": k, "fold": fold, "bucket": bucket, "trees": trees, "least": p.getMinInstancesPerNode(), "bins": p.getMaxBins()}
        for k, (params, fold) in enumerate(fits) for p in [_with(estimator, params)]
        for bucket in range(len(bounds) - 1) for trees in _parts(bounds[bucket], bounds[bucket + 1], parts)]

    def work(job: dict, rows: Packed) -> Iterator[pa.RecordBatch]:
        train, held = np.flatnonzero(rows.fold != job["fold"]), np.flatnonzero(rows.fold == job["fold"])
        x, center = rows.binned(train, job["bins"]), rows.label[train].mean()
        y, sums = rows.label - center, [np.zeros(len(held)) for _ in cuts]
        for tree in range(*job["trees"]):
            w, rng = _bag(rows, train, seed, tree)
            levels = grow(x, np.flatnonzero(w), y, w, deepest, job["least"], _drawn(x.size, most), rng)
            for into, values in zip(sums, predicted(x, levels, held, cuts), strict=True):
                into += values
        lines = [(job["bucket"], d, s) for d, s in zip(cuts, sums, strict=True)] + [(-1, 0, y[held])] * (job["trees"][0] == 0)
        yield pa.RecordBatch.from_pylist(
            [{"fit": job["fit"], "bucket": b, "depth": d, "sums": s.tobytes()} for b, d, s in lines], _SUMS)

    def errors(table: pa.Table) -> pa.Table:
        labels, sums = None, {}
        for line in table.to_pylist():
            values = np.frombuffer(line["sums"])
            if line["bucket"] < 0:
                labels = values
            else:
                sums.setdefault((line["depth"], line["bucket"]), []).append(values)
        found = []
        for d in cuts:
            whole = np.zeros(len(labels))
            for bucket, size in enumerate(bounds[1:]):
                whole = whole + sum(sorted(sums[d, bucket], key=lambda v: v.tobytes()))
                error = float(((whole / size - labels) ** 2).mean()) if len(labels) else None
                found.append({"fit": table["fit"][0].as_py(), "size": size, "depth": d, "error": error})
        return pa.Table.from_pylist(found, _ERRORS)

    return _by_fit(_run(packed, jobs, work, _SUMS).groupBy("fit").applyInArrow(errors, from_arrow_schema(_ERRORS)), len(fits), lambda r: (r["size"], r["depth"]))


def _with(estimator, params: dict):
    return estimator.copy({getattr(estimator, k): v for k, v in params.items()})


def _by_fit(errors: DataFrame, fits: int, key) -> list[dict]:
    """One small row a fit and inner value reaches the driver."""
    found = [{} for _ in range(fits)]
    for row in errors.collect():
        found[row["fit"]][key(row)] = row["error"]
    return found


def _boosted(rows: Packed, train: np.ndarray, x: Columns, p: dict) -> Iterator[tuple[list[Level], float, float]]:
    """(tree, its weight, what to add to its means), round by round: the first tree fits the labels, each later one twice the residuals."""
    center = rows.label[train].mean()
    label, now, leaf = rows.label, np.zeros(len(rows.label)), np.zeros(len(rows.label))
    for k in range(p["rounds"]):
        shift, weight = (center, 1.0) if k == 0 else (0.0, p["step"])
        y = label - center if k == 0 else 2.0 * (label - now)
        levels = grow(x, train, y, None, p["depth"], p["least"], x.size, None, leaf)
        now += weight * (leaf + shift)
        yield levels, weight, shift


def _boosting_settings(estimator: GBTRegressor) -> dict:
    return {"rounds": estimator.getMaxIter(), "step": estimator.getStepSize(), "depth": estimator.getMaxDepth(),
            "least": estimator.getMinInstancesPerNode(), "bins": estimator.getMaxBins()}


def boosting_search(packed: DataFrame, estimator: GBTRegressor, fits: list[tuple[dict, int]], rounds: list[int]) -> list[dict[tuple[int], float]]:
    """For each (parameters, held fold) the mean squared error on the held rows after each number of rounds."""
    jobs = [_boosting_settings(_with(estimator, params | {"maxIter": max(rounds)})) | {"fit": k, "fold": fold} for k, (params, fold) in enumerate(fits)]
    jobs.sort(key=lambda j: -j["depth"])  # the longest first

    def work(job: dict, rows: Packed) -> Iterator[pa.RecordBatch]:
        train, held = np.flatnonzero(rows.fold != job["fold"]), np.flatnonzero(rows.fold == job["fold"])
        x = rows.binned(train, job["bins"])
        now, found = np.zeros(len(held)), []
        for k, (levels, weight, shift) in enumerate(_boosted(rows, train, x, job), 1):
            now += weight * (predicted(x, levels, held, [job["depth"]])[0] + shift)
            if k in rounds:
                error = float(((rows.label[held] - now) ** 2).mean()) if len(held) else None
                found.append({"fit": job["fit"], "size": k, "depth": job["depth"], "error": error})
        yield pa.RecordBatch.from_pylist(found, _ERRORS)

    return _by_fit(_run(packed, jobs, work, _ERRORS), len(fits), lambda r: (r["size"],))


def _nodes(tree: int, x: Columns, levels: list[Level], shift: float) -> pa.RecordBatch:
    """The tree's nodes in Spark's format, numbered level by level; ``shift`` was taken off the labels."""
    start = np.cumsum([0, *[len(v.count) for v in levels]])
    count, total, squares, column, code, gain = (
        np.concatenate([getattr(v, n) for v in levels]) for n in ("count", "total", "squares", "column", "code", "gain"))
    left = np.concatenate([np.where(v.left < 0, -1, v.left + s) for v, s in zip(levels, start[1:], strict=True)])
    slot, at, categories = np.full(len(count), -1), np.zeros(len(count)), np.full(len(count), -1)
    for c, (slots, ends) in enumerate(zip(x.slots, x.ends, strict=True)):
        mine = column == c
        slot[mine] = slots[0] if ends is not None else slots[code[mine] - 1]
        if ends is None:
            categories[mine] = 2  # the left side is category 0
        else:
            at[mine] = ends[code[mine]]
    mean = total / count
    stats = np.column_stack([count, total + shift * count, squares + 2 * shift * total + shift * shift * count])
    lists = lambda values, sizes: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values))
    inner = left >= 0
    data = {
        "id": np.arange(len(count)), "prediction": mean + shift, "impurity": np.maximum(squares / count - mean * mean, 0.0),
        "impurityStats": lists(stats.ravel(), np.full(len(count), 3)), "rawCount": count, "gain": gain, "leftChild": left,
        "rightChild": np.where(inner, left + 1, -1)}
    split = {"featureIndex": slot, "leftCategoriesOrThreshold": lists(at[inner], inner.astype(int)), "numCategories": categories}
    data["split"] = _struct(split, _SPLIT)
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(count), tree), pa.int32()), _struct(data, _NODE)], schema=_NODES)


def _struct(data: dict, kinds: dict) -> pa.StructArray:
    columns = [(v if isinstance(v, pa.Array) else pa.array(v)).cast(kinds[n]) for n, v in data.items()]
    return pa.StructArray.from_arrays(columns, fields=[pa.field(n, k) for n, k in kinds.items()])


def fit_forest(packed: DataFrame, rows: DataFrame, estimator: RandomForestRegressor) -> RandomForestRegressionModel:
    """The estimator's forest on all packed rows."""
    number, seed = estimator.getNumTrees(), estimator.getSeed()
    settings = {"least": estimator.getMinInstancesPerNode(), "depth": estimator.getMaxDepth(), "bins": estimator.getMaxBins()}
    jobs = [settings | {"trees": trees} for trees in _parts(0, number, 2 * _cores(packed))]

    def work(job: dict, rows: Packed) -> Iterator[pa.RecordBatch]:
        train = np.arange(len(rows.label))
        x, center = rows.binned(train, job["bins"]), rows.label.mean()
        for tree in range(*job["trees"]):
            w, rng = _bag(rows, train, seed, tree)
            levels = grow(x, np.flatnonzero(w), rows.label - center, w, job["depth"], job["least"], _drawn(x.size, number), rng)
            yield _nodes(tree, x, levels, center)

    return _as_spark(_run(packed, jobs, work, _NODES), rows, estimator, "numTrees", [1.0] * number, RandomForestRegressionModel)


def fit_boosting(packed: DataFrame, rows: DataFrame, estimator: GBTRegressor) -> GBTRegressionModel:
    """The estimator's boosted trees on all packed rows, in one task."""
    job = _boosting_settings(estimator)

    def work(job: dict, rows: Packed) -> Iterator[pa.RecordBatch]:
        train = np.arange(len(rows.label))
        x = rows.binned(train, job["bins"])
        for tree, (levels, _, shift) in enumerate(_boosted(rows, train, x, job)):
            yield _nodes(tree, x, levels, shift)

    weights = [1.0] + [job["step"]] * (job["rounds"] - 1)
    return _as_spark(_run(packed, [job], work, _NODES), rows, estimator, "maxIter", weights, GBTRegressionModel)


def _as_spark(nodes: DataFrame, rows: DataFrame, estimator, size: str, weights: list[float], model):
    """A Spark model of the nodes: Spark's own files of a small fit, with these trees and the estimator's settings."""
    spark = rows.sparkSession
    path = f"{shared_dir(spark)}/model-trees/{uuid.uuid4().hex}"
    small = _with(estimator, {size: 1, "maxDepth": 0})
    small.fit(rows.limit(10).coalesce(1)).write().save(f"{path}/small")
    try:
        known = json.loads(spark.read.text(f"{path}/small/metadata").first()[0])
        tree = spark.read.parquet(f"{path}/small/treesMetadata").first()
        settings = {size: len(weights), "maxDepth": estimator.getMaxDepth()}
        known["paramMap"] |= settings
        known["numTrees"] = len(weights)
        of_tree = json.loads(tree[1])
        of_tree["paramMap"] |= {"maxDepth": settings["maxDepth"]}
        spark.createDataFrame([(json.dumps(known),)], "value string").coalesce(1).write.text(f"{path}/whole/metadata")
        spark.createDataFrame(
            [(k, json.dumps(of_tree | {"uid": f"{of_tree['uid']}_{k}"}), w) for k, w in enumerate(weights)], "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/whole/treesMetadata")
        nodes.write.parquet(f"{path}/whole/data")
        return model.load(f"{path}/whole")
    finally:
        fs, target = file_system(spark, path)
        fs.delete(target, True)
