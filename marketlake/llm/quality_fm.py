"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlake.llm.common import give_back_memory, list_column, per_batch, small_batches, texts_of
from marketlake.llm.labelled import LEAST_CALIBRATION, WordCodes, plain_words, training_sample

#: Hashed words, rank of the interactions, bins of a statistic.
WORD_SLOTS = 1 << 18
RANK = 4
BINS = 10
EPOCHS = 12
STATISTICS = (
    "words", "bytes a word", "lines", "bytes a line", "punctuation", "rare punctuation", "digits", "capitals", "distinct words",
    "share of the commonest word", "distinct lines", "words ending a sentence", "bytes beyond ASCII",
    "commonest rare mark a word", "words like the one before")

#: Marks that sentences seldom need.
_RARE = [c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "!'(),-.:;?\""]
_codes = WordCodes(lambda h, _: h & (WORD_SLOTS - 1))


def _statistics(text: bytes, n_words: int, n_distinct: int, most: int, again: int) -> list[float]:
    b = np.bincount(np.frombuffer(text, np.uint8), minlength=256) if text else np.zeros(256, np.int64)
    size, lines = max(1, len(text)), text.split(b"\n")
    marks = b[33:48].sum() + b[58:65].sum() + b[91:97].sum() + b[123:127].sum()
    plain = b[33] + b[39] + b[44] + b[45] + b[46] + b[63]
    return [
        n_words, len(text) / max(1, n_words), len(lines), len(text) / len(lines), marks / size, (marks - plain) / size, b[48:58].sum() / size,
        b[65:91].sum() / size, n_distinct / max(1, n_words), most / max(1, n_words), len(set(lines)) / len(lines),
        (b[46] + b[33] + b[63]) / max(1, n_words), b[128:].sum() / size, max(b[c] for c in _RARE) / max(1, n_words), again / max(1, n_words)]


@dataclass
class Features:
    """Rows of a batch: word slots with values (L2 norm 1 a row), and statistics."""

    slots: np.ndarray
    values: np.ndarray
    lengths: np.ndarray
    statistics: np.ndarray


def features(texts: list[bytes], metadata: list[np.ndarray]) -> Features:
    """Slots and values of the words of whole texts; metadata columns follow the statistics."""
    words = [plain_words(t) for t in texts]
    sizes = np.array([len(w) for w in words])
    codes = np.concatenate([np.fromiter(map(_codes.__getitem__, w), np.int64, len(w)) for w in words])
    rows = np.repeat(np.arange(len(texts)), sizes)
    keys, n = np.unique(rows * WORD_SLOTS + codes, return_counts=True)
    rows, slots = keys // WORD_SLOTS, keys % WORD_SLOTS
    values = np.sqrt(n.astype(np.float64))
    values /= np.sqrt(np.bincount(rows, values**2, len(texts)))[rows]
    lengths = np.bincount(rows, minlength=len(texts))
    most = np.zeros(len(texts), np.int64)
    np.maximum.at(most, rows, n)
    same = (codes[1:] == codes[:-1]) & (np.repeat(np.arange(len(texts)), sizes)[1:] == np.repeat(np.arange(len(texts)), sizes)[:-1])
    again = np.bincount(np.repeat(np.arange(len(texts)), sizes)[1:][same], minlength=len(texts))
    found = [_statistics(*x) for x in zip(texts, sizes, lengths, most, again, strict=True)]
    return Features(slots, values, lengths, np.column_stack([np.array(found), *metadata]))


@dataclass
class Machine:
    """A fitted machine: edges of the bins, weights, interaction vectors, intercept."""

    edges: list[np.ndarray]
    weights: np.ndarray
    vectors: np.ndarray
    intercept: float

    def rows(self, f: Features) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Feature ids, values and first places of the rows, words before statistics (which are never missing)."""
        n, k = f.statistics.shape
        bins = np.empty((n, k), np.int64)
        for j, edges in enumerate(self.edges):
            x = f.statistics[:, j]
            bins[:, j] = WORD_SLOTS + j * (BINS + 1) + np.where(np.isnan(x), BINS, np.searchsorted(edges, x, side="right"))
        order = np.argsort(np.concatenate([np.repeat(np.arange(n), f.lengths), np.repeat(np.arange(n), k)]), kind="stable")
        ids = np.concatenate([f.slots, bins.ravel()])[order]
        values = np.concatenate([f.values, np.full(n * k, 0.5)])[order]
        starts = np.concatenate([[0], np.cumsum(f.lengths + k)[:-1]]).astype(np.int64)
        return ids, values, starts

    def logits(self, ids: np.ndarray, values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Linear time: the pairs' sum is half of (square of the sum less sum of the squares)."""
        vx = self.vectors[ids] * values[:, None]
        s = np.add.reduceat(vx, starts)
        pairs = 0.5 * (s**2 - np.add.reduceat(vx**2, starts)).sum(axis=1)
        return self.intercept + np.add.reduceat(self.weights[ids] * values, starts) + pairs, vx, s

    def scores(self, f: Features) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(*self.rows(f))[0], -30, 30)))


def fit(f: Features, label: np.ndarray, counts: dict[int, int], threshold: float = 0.5, epochs: int = EPOCHS) -> Machine:
    """Adagrad on the log loss; a quarter of the sample only moves the intercept, so that ``threshold`` divides the classes best (with
    too few rows of a class in it, the whole sample does).

    Errors of the two classes count by their shares in the corpus.
    """
    random = np.random.default_rng(7)
    edges = [np.unique(np.nanquantile(x, np.linspace(0, 1, BINS + 1)[1:-1])) if np.isfinite(x).any() else np.zeros(0) for x in f.statistics.T]
    size = WORD_SLOTS + len(edges) * (BINS + 1)
    m = Machine(edges, np.zeros(size), np.zeros((size, RANK)), 0.0)
    ids, values, starts = m.rows(f)
    seen = np.unique(ids)
    m.vectors[seen] = random.normal(0, 0.05, (len(seen), RANK))
    stops = np.append(starts[1:], len(ids))
    order = random.permutation(len(label))
    held, used = order[: len(order) // 4], order[len(order) // 4 :]

    def rows_of(some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.concatenate([np.arange(starts[k], stops[k]) for k in some])
        lengths = stops[some] - starts[some]
        return ids[at], values[at], np.concatenate([[0], np.cumsum(lengths)[:-1]])

    past_w, past_v, past_b = np.full(size, 1e-2), np.full((size, RANK), 1e-2), 1e-2
    for _ in range(epochs):
        for some in np.array_split(random.permutation(used), max(1, len(used) // 48)):
            lengths = stops[some] - starts[some]
            i, x, begin = rows_of(some)
            z, vx, s = m.logits(i, x, begin)
            g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - label[some]
            gx = np.repeat(g / len(some), lengths) * x
            own, where = np.unique(i, return_inverse=True)
            dw = np.bincount(where, gx) + 1e-6 * m.weights[own]
            gv = gx[:, None] * (np.repeat(s, lengths, axis=0) - vx)
            dv = np.column_stack([np.bincount(where, gv[:, k]) for k in range(RANK)]) + 1e-5 * m.vectors[own]
            past_w[own] += dw**2
            past_v[own] += dv**2
            past_b += g.mean() ** 2
            m.weights[own] -= 0.1 * dw / np.sqrt(past_w[own])
            m.vectors[own] -= 0.02 * dv / np.sqrt(past_v[own])
            m.intercept -= 0.1 * g.mean() / np.sqrt(past_b)
    if min(int((label[held] == k).sum()) for k in (0, 1)) < LEAST_CALIBRATION:
        held = order
    m.intercept += np.log(threshold / (1 - threshold)) - _best_cut(m.logits(*rows_of(held))[0], label[held], counts)
    return m


def _best_cut(logit: np.ndarray, label: np.ndarray, counts: dict[int, int]) -> float:
    """The logit of fewest errors, each class weighed to its rows in the corpus; in the middle of the widest such gap."""
    order = np.argsort(logit, kind="stable")
    z, one = logit[order], label[order] == 1
    share = [counts.get(k, 0) / max(1, int((label == k).sum())) for k in (0, 1)]
    below = np.concatenate([[0.0], np.cumsum(one * share[1])])
    above = np.concatenate([[0.0], np.cumsum(~one * share[0])])
    wrong = below + above[-1] - above
    edges = np.concatenate([[z[0] - 1], z, [z[-1] + 1]])
    gaps = np.where(np.isclose(wrong, wrong.min()), edges[1:] - edges[:-1], -1)
    k = int(gaps.argmax())
    return float((edges[k] + edges[k + 1]) / 2)


def _numbers(batch: pa.RecordBatch, names: tuple[str, ...]) -> list[np.ndarray]:
    return [np.array(batch.column(c).cast(pa.float64()).to_pylist(), np.float64) for c in names]


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", metadata: tuple[str, ...] = (), threshold: float = 0.5) -> Machine | float:
    """A machine fitted on the bounded sample; with one class only, that class's share (0.5 without any label)."""
    small_batches(docs.sparkSession)
    sample, counts = training_sample(docs.select("doc_id", "text", *metadata), labels, target)
    if len(counts) < 2:
        return 0.5 if not counts else float(next(iter(counts)))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        f = features(texts_of(batch.column("text")), _numbers(batch, metadata))
        return pa.record_batch({
            "doc_id": batch.column("doc_id"), "label": batch.column("__label"), "slots": list_column(f.slots, f.lengths, pa.int32()),
            "values": list_column(f.values, f.lengths, pa.float64()),
            "statistics": list_column(f.statistics.ravel(), [f.statistics.shape[1]] * len(f.statistics), pa.float64())})

    got = sample.mapInArrow(per_batch(work), "doc_id long, label int, slots array<int>, values array<double>, statistics array<double>")
    got = got.toArrow().combine_chunks().sort_by([("doc_id", "ascending")])
    lists = {c: got.column(c).combine_chunks() for c in ("slots", "values", "statistics")}
    f = Features(
        np.array(lists["slots"].flatten()).astype(np.int64), np.array(lists["values"].flatten()),
        np.array(lists["slots"].value_lengths()), np.array(lists["statistics"].flatten()).reshape(got.num_rows, -1))
    return fit(f, np.array(got.column("label")).astype(np.float64), counts, threshold)


def score_documents(
        docs: DataFrame, labels: DataFrame, target: str = "quality", metadata: tuple[str, ...] = (), threshold: float = 0.5,
        name: str = "__score") -> DataFrame:
    """All columns of ``docs`` and ``name``: 0 to 1, higher where label 1 is likelier, the classes divided at ``threshold``.

    The score comes from the whole text and the named numeric columns.

    Null and empty texts are scored by their statistics alone; a missing metadata value has a bin of its own. Every row is
    scored by itself, so repeated rows have equal scores; an empty table gives no rows. Without labels of both classes the
    score is the share of class 1 (0.5 without any label). Labels of held-out rows are never read.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, target, metadata, threshold))
    give_back_memory()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = model.value
        if isinstance(m, float):
            return batch.append_column(name, pa.array(np.full(batch.num_rows, m)))
        return batch.append_column(name, pa.array(m.scores(features(texts_of(batch.column("text")), _numbers(batch, metadata)))))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(per_batch(work), docs.withColumn(name, F.lit(0.0)).schema)
