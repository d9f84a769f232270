"""Toxicity: a convolutional text classifier in numpy, its thresholds calibrated by language.

All labelled documents that are not held out are learnt from: word counts, parameters and thresholds come from Spark jobs over them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlake.llm.common import drop, give_back_memory, list_column, per_batch, small_batches, stored, texts_of
from marketlake.llm.labelled import LEAST_CALIBRATION, WordCodes, labelled_documents, plain_words

#: Filter widths in words, filters of each width, embedding size, passes over the labelled documents.
WIDTHS = (1, 2, 3)
FILTERS = 8
DIMENSION = 8
EPOCHS = 6
#: Labelled documents a word is in at least to have an embedding of its own; all other words share the zero vector.
LEAST_DOCS = 4
#: Standard errors of a word's log odds that count as noise; words within them share the zero vector too.
NOISE = 2.0
#: Documents that are learnt from one after another, shards side by side.
SHARD_ROWS = 4096
#: Whole numbers a unit of a parameter, bins a unit of a logit.
UNIT = 2.0**32
BINS = 1024

#: Common function words by which a text's language is told (the language column is never read).
FUNCTION_WORDS = {
    "en": "the and of to in is it that for was with as are this by be on or at from an have",
    "fr": "le la les des et est une que dans pour pas sur ce qui au par du elle il ne se avec",
    "de": "der die das und ist nicht ein eine mit den von zu für auf im sich dem auch es an werden",
    "es": "el los las y es que por una con para del se no su al lo como más pero sus sobre",
}
LANGUAGES = tuple(FUNCTION_WORDS)
_LANGUAGE_BITS: dict[bytes, int] = {}
for _k, _words in enumerate(FUNCTION_WORDS.values()):
    for _w in _words.split():
        _LANGUAGE_BITS[_w.encode()] = _LANGUAGE_BITS.get(_w.encode(), 0) | 1 << _k

#: Zero words between documents, so that no filter sees two of them.
PAD = max(WIDTHS) - 1


@dataclass
class Words:
    """Words of a batch as codes, ``PAD`` zeros after each document; first places and languages of the documents."""

    codes: np.ndarray
    starts: np.ndarray
    languages: np.ndarray


def _padded(codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    pad = np.zeros(PAD + 1, np.int64)
    lengths = np.array([len(c) for c in codes])
    flat = np.concatenate([x for c in codes for x in (c, pad)])
    return flat, np.concatenate([[0], np.cumsum(lengths + PAD + 1)[:-1]])


def _languages(bits: list[np.ndarray]) -> np.ndarray:
    votes = np.array([[int(((b >> k) & 1).sum()) for k in range(len(LANGUAGES))] for b in bits])
    return np.where(votes.max(axis=1) > 0, votes.argmax(axis=1), len(LANGUAGES))


def _joined(codes: list[np.ndarray], bits: list[np.ndarray]) -> Words:
    return Words(*_padded(codes), _languages(bits))


@dataclass
class Network:
    """Embeddings of the hashed words kept, filters of each width, output weights, one threshold a language."""

    hashes: np.ndarray
    embeddings: np.ndarray
    filters: list[np.ndarray]
    biases: np.ndarray
    output: np.ndarray
    intercept: float
    thresholds: np.ndarray

    def coder(self) -> WordCodes:
        """Word to slot (0: unknown), its language bits above."""
        slots = {int(h): k + 1 for k, h in enumerate(self.hashes)}
        return WordCodes(lambda h, w: slots.get(h, 0) | _LANGUAGE_BITS.get(w, 0) << 24)

    def words(self, texts: list[bytes], coder: WordCodes) -> Words:
        codes = [np.fromiter(map(coder.__getitem__, w), np.int64, len(w)) for w in map(plain_words, texts)]
        return _joined([c & 0xFFFFFF for c in codes], [c >> 24 for c in codes])

    def pooled(self, w: Words) -> tuple[np.ndarray, list[np.ndarray]]:
        """Largest response of every filter in every document, and the responses."""
        best, all_responses = [], []
        for k, filters in enumerate(self.filters):
            width = len(filters)
            parts = [(self.embeddings @ filters[j])[w.codes] for j in range(width)]
            responses = np.full((len(w.codes), FILTERS), 0.0, np.float32) + self.biases[k]
            for j, part in enumerate(parts):
                responses[: len(part) - j] += part[j:]
            for j in range(1, PAD + 1):  # a window from here would reach into the next document
                responses[np.append(w.starts[1:], len(w.codes)) - j] = -np.inf
            best.append(np.maximum.reduceat(responses, w.starts))
            all_responses.append(responses)
        return np.maximum(np.concatenate(best, axis=1), 0), all_responses

    def logits(self, w: Words) -> np.ndarray:
        return self.pooled(w)[0].astype(np.float64) @ self.output + self.intercept

    def scores(self, w: Words) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(w) - self.thresholds[w.languages], -30, 30)))


def _shortened(codes: np.ndarray) -> np.ndarray:
    """The codes without the inner parts of long runs of zeros: every window with a known word stays, and others give no response."""
    known = codes != 0
    near = known.copy()
    for j in range(1, PAD + 1):
        near[j:] |= known[:-j]
        near[:-j] |= known[j:]
    return codes[near]


@dataclass
class State:
    """Parameters in rows of ``DIMENSION`` (embeddings, filters, output, intercept) and their sums of squared gradients."""

    hashes: np.ndarray
    values: np.ndarray
    past: np.ndarray

    @staticmethod
    def start(hashes: np.ndarray, log_odds: np.ndarray) -> State:
        """The first component of a word starts as its shrunken log odds, the others at random."""
        random = np.random.default_rng(11)
        table = random.normal(0, 0.1, (len(hashes) + 1, DIMENSION))
        table[1:, 0] = np.clip(np.sign(log_odds) * np.maximum(np.abs(log_odds) - NOISE, 0) / 3, -2, 2)
        table[0] = 0
        filters = [random.normal(0, 0.15, (w, DIMENSION, FILTERS)) for w in WIDTHS]
        for f in filters:
            f[0, 0, : FILTERS // 2] += 1
        output = random.normal(0, 0.1, len(WIDTHS) * FILTERS)
        output[np.arange(len(WIDTHS) * FILTERS) % FILTERS < FILTERS // 2] += 0.3
        rest = np.concatenate([*(f.ravel() for f in filters), output, [-2.0], np.zeros(DIMENSION - 1)])
        values = np.concatenate([table, rest.reshape(-1, DIMENSION)])
        return State(hashes, values, np.full_like(values, 1e-3))

    def parts(self, rows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
        """Views of the embeddings, filters, output and intercept in ``values`` or ``past``."""
        n, rest = len(self.hashes) + 1, rows[len(self.hashes) + 1 :].reshape(-1)
        cuts = np.cumsum([0, *(w * DIMENSION * FILTERS for w in WIDTHS), len(WIDTHS) * FILTERS])
        filters = [rest[a:b].reshape(w, DIMENSION, FILTERS) for a, b, w in zip(cuts, cuts[1:], WIDTHS, strict=False)]
        return rows[:n], filters, rest[cuts[-2] : cuts[-1]], rest[cuts[-1] : cuts[-1] + 1]

    def network(self, thresholds: np.ndarray) -> Network:
        table, filters, output, intercept = self.parts(self.values)
        return Network(
            self.hashes, table.astype(np.float32), [f.astype(np.float32) for f in filters], np.full(len(WIDTHS), -0.1, np.float32),
            output, float(intercept[0]), thresholds)


def learn(state: State, codes: list[np.ndarray], label: np.ndarray, random: np.random.Generator) -> State:
    """One pass of Adagrad on the log loss with max pooling over some documents; only rows of their words are touched."""
    new = State(state.hashes, state.values.copy(), state.past.copy())
    table, filters, output, intercept = new.parts(new.values)
    past_table, past, past_out, past_b = new.parts(new.past)
    none, seen, place = np.zeros(len(LANGUAGES) + 1), np.zeros(len(table), bool), np.zeros(len(table), np.int64)
    for some in np.array_split(random.permutation(len(label)), max(1, len(label) // 32)):
        flat, starts = _padded([codes[k] for k in some])
        seen[flat] = True
        own = np.flatnonzero(seen)  # the pads make 0 the first
        seen[own], place[own] = False, np.arange(len(own))
        slots = place[flat]
        w = Words(slots, starts, none)
        net = Network(own, table[own].astype(np.float32), [f.astype(np.float32) for f in filters], np.full(len(WIDTHS), -0.1, np.float32),
                      output, float(intercept[0]), none)
        pooled, responses = net.pooled(w)
        g = (1 / (1 + np.exp(-np.clip(pooled @ output + intercept[0], -30, 30))) - label[some]) / len(some)
        d_out = pooled.T @ g
        d_pool = g[:, None] * output * (pooled > 0)
        stops = np.append(starts[1:], len(slots))
        d_table = np.zeros((len(own), DIMENSION))
        for k, width in enumerate(WIDTHS):
            at = np.stack([s + responses[k][s:e].argmax(axis=0) for s, e in zip(starts, stops, strict=True)])
            d = d_pool[:, k * FILTERS : (k + 1) * FILTERS]
            for j in range(width):
                slot = slots[np.minimum(at + j, len(slots) - 1)]
                d_filter = np.einsum("bf,bfd->df", d, table[own[slot]])
                np.add.at(d_table, slot, d[:, :, None] * filters[k][j].T[None])
                past[k][j] += d_filter**2
                filters[k][j] -= 0.05 * d_filter / np.sqrt(past[k][j])
        d_table[0] = 0
        past_table[own] += d_table**2
        table[own] -= 0.05 * d_table / np.sqrt(past_table[own])
        past_out += d_out**2
        output -= 0.05 * d_out / np.sqrt(past_out)
        past_b += g.sum() ** 2
        intercept -= 0.05 * g.sum() / np.sqrt(past_b)
    return new


def _shard_rows(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[np.ndarray]]]:
    """``(shard, labels, languages, codes of each document)`` of the shards of a batch, one after another."""
    for k in range(batch.num_rows):
        label, language, sizes, codes = (np.array(batch.column(c).slice(k, 1).flatten()) for c in ("label", "language", "sizes", "codes"))
        yield batch.column("shard")[k].as_py(), label, language, np.split(codes, np.cumsum(sizes)[:-1])


def fit(shards: DataFrame, state: State, epochs: int = EPOCHS) -> Network:
    """A network learnt from every document of ``shards (shard, label, language, sizes, codes)``, thresholds from all of them.

    In each epoch every shard goes over its own documents from the common parameters; the changes of a parameter row are averaged
    over the shards that changed it. Changes are summed as whole numbers of 2^-32, so that no result depends on their order.
    """
    context, size = shards.sparkSession.sparkContext, 2 * DIMENSION
    names = [f"c{k}" for k in range(size)]
    for epoch in range(epochs):
        common = context.broadcast(state)

        def work(batch: pa.RecordBatch, common=common, epoch=epoch) -> pa.RecordBatch:
            before, rows, changes = common.value, [], []
            for shard, label, _, codes in _shard_rows(batch):
                after = learn(before, codes, label, np.random.default_rng([11, epoch, shard]))
                change = np.concatenate([after.values - before.values, after.past - before.past], axis=1)
                rows.append(np.flatnonzero(change.any(axis=1)))
                changes.append(np.rint(change[rows[-1]] * UNIT).astype(np.int64))
            found = np.concatenate(changes)
            return pa.record_batch({"row": pa.array(np.concatenate(rows)), **{c: pa.array(found[:, k]) for k, c in enumerate(names)}})

        changed = shards.mapInArrow(per_batch(work), "row long, " + ", ".join(f"{c} long" for c in names))
        got = changed.groupBy("row").agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in names)).toArrow()
        rows = np.array(got.column("row"))
        mean = np.column_stack([np.array(got.column(c)) for c in names]) / UNIT / np.array(got.column("n"))[:, None]
        state.values[rows] += mean[:, :DIMENSION]
        state.past[rows] += mean[:, DIMENSION:]
        common.unpersist()
    net = state.network(np.zeros(len(LANGUAGES) + 1))
    shared = context.broadcast(net)

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        language, label, bins = [], [], []
        for _, labels, languages, codes in _shard_rows(batch):
            language.append(languages)
            label.append(labels.astype(np.int64))
            for k in range(0, len(codes), 100):
                logit = shared.value.logits(Words(*_padded(codes[k : k + 100]), languages[k : k + 100]))
                bins.append(np.floor(np.clip(logit, -30, 30) * BINS).astype(np.int64))
        return pa.record_batch({c: pa.array(np.concatenate(x)) for c, x in (("language", language), ("bin", bins), ("label", label))})

    placed = shards.mapInArrow(per_batch(place), "language long, bin long, label long")
    placed = placed.groupBy("language", "bin").agg(F.sum("label").alias("one"), F.sum(1 - F.col("label")).alias("zero")).toArrow()
    net.thresholds = thresholds(*(np.array(placed.column(c)) for c in ("language", "bin", "one", "zero")))
    shared.unpersist()
    return net


def thresholds(language: np.ndarray, place: np.ndarray, one: np.ndarray, zero: np.ndarray) -> np.ndarray:
    """The logit of best F1 for each language (too few rows: of all languages), from how many rows of each class lie in a bin."""

    def best(rows: np.ndarray) -> float:
        places, at = np.unique(place[rows], return_inverse=True)
        hit, miss = (np.cumsum(np.bincount(at, x[rows])[::-1]) for x in (one, zero))
        z = places[::-1]
        k = int((2 * hit / np.maximum(hit[-1] + hit + miss, 1e-9)).argmax())
        return float((z[k] + z[k + 1] + 1) / 2 / BINS if k + 1 < len(z) else z[k] / BINS - 1)

    every = best(np.arange(len(place)))
    out = np.full(len(LANGUAGES) + 1, every)
    for k in range(len(LANGUAGES)):
        rows = np.flatnonzero(language == k)
        if min(one[rows].sum(), zero[rows].sum()) >= LEAST_CALIBRATION:
            out[k] = best(rows)
    return out


def _hashed(docs: DataFrame, labels: DataFrame, target: str) -> DataFrame:
    """``(doc_id, label, language, hashes)`` of every document with a label to learn from, stored."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = [plain_words(t) for t in texts_of(batch.column("text"))]
        coder = WordCodes(lambda h, _: h)
        hashes = [np.fromiter(map(coder.__getitem__, w), np.uint64, len(w)) for w in words]
        bits = [np.fromiter((_LANGUAGE_BITS.get(x, 0) for x in w), np.int64, len(w)) for w in words]
        return pa.record_batch({
            "doc_id": batch.column("doc_id"), "label": batch.column("__label"), "language": pa.array(_languages(bits)),
            "hashes": list_column(np.concatenate(hashes).view(np.int64), [len(w) for w in words], pa.int64())})

    rows = labelled_documents(docs.select("doc_id", "text"), labels, target)
    return stored(rows.mapInArrow(per_batch(work), "doc_id long, label int, language long, hashes array<long>"), "labelled")


def _vocabulary(rows: DataFrame, counts: dict[int, int]) -> State:
    """The words whose log odds over all labelled documents stand out from noise, with the parameters to start from."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column("hashes")
        hashes, of = np.array(lists.flatten()), np.repeat(np.arange(len(lists)), np.array(lists.value_lengths()))
        order = np.lexsort((of, hashes))
        hashes, of = hashes[order], of[order]
        once = np.ones(len(of), bool)
        once[1:] = (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1])
        label = np.array(batch.column("label"))[of[once]]
        words, at = np.unique(hashes[once], return_inverse=True)
        one, every = np.bincount(at, label, len(words)).astype(np.int64), np.bincount(at, minlength=len(words))
        return pa.record_batch({"word": pa.array(words), "one": pa.array(one), "zero": pa.array(every - one)})

    found = rows.mapInArrow(per_batch(work), "word long, one long, zero long").groupBy("word").agg(F.sum("one").alias("one"), F.sum("zero").alias("zero"))
    one, zero = F.col("one") + 0.5, F.col("zero") + 0.5
    odds = F.log(one / (counts[1] + 1)) - F.log(zero / (counts[0] + 1))
    found = found.where(F.col("one") + F.col("zero") >= LEAST_DOCS).select("word", (odds / F.sqrt(1 / one + 1 / zero)).alias("odds"))
    got = found.where(F.abs("odds") > NOISE).toArrow()
    hashes = np.array(got.column("word"), np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return State.start(hashes[order], np.array(got.column("odds"), np.float64)[order])


def _shards(rows: DataFrame, hashes: np.ndarray, n: int) -> DataFrame:
    """``(shard, label, language, sizes, codes)``: the documents of a shard in one row by ascending id, stored."""
    known = rows.sparkSession.sparkContext.broadcast(hashes)

    def code(batch: pa.RecordBatch) -> pa.RecordBatch:
        own, lists, codes = known.value, batch.column("hashes"), []
        for h in np.split(np.array(lists.flatten()).view(np.uint64), np.cumsum(np.array(lists.value_lengths()))[:-1]):
            at = np.minimum(np.searchsorted(own, h), len(own) - 1)
            codes.append(_shortened(np.where(own[at] == h, at + 1, 0)) if len(own) else np.zeros(0, np.int64))
        kept = {c: batch.column(c) for c in ("shard", "doc_id", "label", "language")}
        return pa.record_batch({**kept, "codes": list_column(np.concatenate(codes), [len(c) for c in codes], pa.int32())})

    def together(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by([("doc_id", "ascending")])
        codes = table.column("codes").combine_chunks()
        one = {"shard": table.column("shard")[:1].combine_chunks(), "sizes": codes.value_lengths(), "codes": codes.flatten()}
        one |= {c: table.column(c).combine_chunks() for c in ("label", "language")}
        lists = {c: list_column(np.array(one[c]), [len(one[c])], one[c].type) for c in ("label", "language", "sizes", "codes")}
        return pa.table({"shard": one["shard"], **lists})

    coded = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(n))).mapInArrow(
        per_batch(code), "shard long, doc_id long, label int, language long, codes array<int>")
    return stored(coded.groupBy("shard").applyInArrow(
        together, "shard long, label array<int>, language array<long>, sizes array<int>, codes array<int>"), "shards")


def train(docs: DataFrame, labels: DataFrame, target: str = "toxic") -> Network | float:
    """A network fitted on all documents with a label to learn from; with one class only, that class's share (0 without any label)."""
    small_batches(docs.sparkSession)
    rows = _hashed(docs, labels, target)
    counts = {int(r[0]): int(r[1]) for r in rows.groupBy("label").count().collect()}
    if len(counts) < 2:
        drop(rows)
        return 0.0 if not counts else float(next(iter(counts)))
    state = _vocabulary(rows, counts)
    shards = _shards(rows, state.hashes, -(-sum(counts.values()) // SHARD_ROWS))
    drop(rows)
    net = fit(shards, state)
    drop(shards)
    return net


def score_documents(docs: DataFrame, labels: DataFrame, target: str = "toxic", name: str = "__score") -> DataFrame:
    """All columns of ``docs`` and ``name``: 0 to 1, 0.5 at the threshold of the text's language.

    The whole text is read; its language is told from its function words. Null and empty texts have no filter response and
    are scored by the intercept. Rows are scored by themselves; an empty table gives no rows. Without labels of both
    classes the score is the share of class 1 (0 without any label). Labels of held-out rows are never read.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, target))
    give_back_memory()
    coders: list[WordCodes] = []

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        net = model.value
        if isinstance(net, float):
            return batch.append_column(name, pa.array(np.full(batch.num_rows, net)))
        if not coders:
            coders.append(net.coder())
        texts, scores = texts_of(batch.column("text")), []
        for some in _portions(texts):
            scores.append(net.scores(net.words(some, coders[0])))
        return batch.append_column(name, pa.array(np.concatenate(scores)))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(per_batch(work), docs.withColumn(name, F.lit(0.0)).schema)


def _portions(texts: list[bytes], size: int = 1_000_000) -> list[list[bytes]]:
    """Consecutive texts of about ``size`` bytes, so that the responses stay small."""
    out, held = [[]], 0
    for t in texts:
        if held and held + len(t) > size:
            out.append([])
            held = 0
        out[-1].append(t)
        held += len(t)
    return out
