"""Repeated spans: word windows that stand verbatim at an earlier place, wherever the lines break.

Only words count: A-Z lower-cased, split on ASCII white space. Windows of ``size`` words that occur more than once are
found exactly, by 64-bit hashes; nothing is capped or sampled:

1. Every window chooses an anchor in itself, the ``ANCHOR_WORDS`` words of least hash (of equals the last). Equal windows
   choose equal anchors at equal offsets, so a window can only be repeated if its anchor is.
2. The windows of a text that choose the same anchor form a block. Blocks with equal first and last windows are copies:
   all windows of a copy but the first are repeated, without a look at them.
3. Windows are written out one by one only for the first copy of the blocks whose anchor has different blocks, and for
   copies that may overlap the first. The first place of a window is among these, as it is in the first copy of a block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlake.llm import shingles
from marketlake.llm.common import drop, per_batch, portions, small_batches, stored, texts_of
from marketlake.llm.substring_dedup import remove_repeats, with_length

#: Words of a window: shorter repetitions are common phrases, not copied passages.
MIN_WORDS = 50
ANCHOR_WORDS = 15
#: Bytes of text that are hashed at once.
PORTION = 2 << 20

_FACTOR = 0x9E3779B97F4A7C15


def rolled(hashes: np.ndarray, size: int) -> np.ndarray:
    """The hash of every ``size`` words in a row, by doubling."""
    out, done = None, 0
    power, width = hashes, 1
    while True:
        shift = np.uint64(pow(_FACTOR, width, 2**64))
        if size & width:
            if out is None:
                out = power
            else:
                n = len(power) - done
                out = out[:n] * shift + power[done:]
            done += width
        if done == size:
            return out[: len(hashes) - size + 1]
        power, width = power[:-width] * shift + power[width:], 2 * width


def last_least(x: np.ndarray, width: int) -> np.ndarray:
    """Position of the least of every ``width`` values in a row, of equals the last."""
    least, at, have = x, np.arange(len(x)), 1
    while have < width:
        step = min(have, width - have)  # two overlapping runs cover a longer one
        right = least[step:] <= least[:-step]
        least, at = np.where(right, least[step:], least[:-step]), np.where(right, at[step:], at[:-step])
        have += step
    return at


def word_blocks(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """(first window, number of windows, anchor hash, block hash) of each block of one text, given whole or as its words, and the
    hashes of all windows."""
    hashes = shingles.hashed_words(texts)[0]
    if len(hashes) < size:
        return None
    windows = shingles._mixed(rolled(hashes, size))
    width = min(ANCHOR_WORDS, size)
    anchors = shingles._mixed(rolled(hashes, width))
    chosen = last_least(anchors, size - width + 1)
    starts = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
    many = np.diff(np.append(starts, len(chosen)))
    blocks = shingles._mixed(
        (windows[starts] * np.uint64(_FACTOR) + windows[starts + many - 1]) * np.uint64(_FACTOR) + many.astype(np.uint64))
    return starts, many, anchors[chosen[starts]], blocks, windows


def many_blocks(texts: list[bytes], size: int) -> tuple[np.ndarray, ...] | None:
    """``(text, first window, number of windows, anchor hash, block hash)`` of the blocks of many texts, hashed side by side."""
    hashes, counts = shingles.hashed_words(texts)
    if not len(counts) or counts.max() < size:
        return None
    begin = np.cumsum(counts) - counts
    text = np.repeat(np.arange(len(texts)), np.maximum(counts - size + 1, 0))
    before = np.cumsum(np.maximum(counts - size + 1, 0)) - np.maximum(counts - size + 1, 0)
    at = np.arange(len(text)) - before[text]
    flat = begin[text] + at  # windows within one text
    width = min(ANCHOR_WORDS, size)
    windows = shingles._mixed(rolled(hashes, size))[flat]
    anchors = shingles._mixed(rolled(hashes, width))
    chosen = last_least(anchors, size - width + 1)[flat]
    starts = np.flatnonzero(np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (text[1:] != text[:-1])]))
    many = np.diff(np.append(starts, len(chosen)))
    blocks = shingles._mixed(
        (windows[starts] * np.uint64(_FACTOR) + windows[starts + many - 1]) * np.uint64(_FACTOR) + many.astype(np.uint64))
    return text[starts], at[starts], many, anchors[chosen[starts]], blocks


def _blocks(docs: DataFrame, size: int) -> DataFrame:
    """``(doc_id, h, at, many, key, block)`` of every block of every text, stored."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        parts = []
        for first, part in portions(texts_of(batch.column("text")), PORTION):
            if (found := many_blocks(part, size)) is not None:
                parts.append((found[0] + first, *found[1:]))
        if not parts:
            return None
        rows, at, many, key, block = (np.concatenate(x) for x in zip(*parts, strict=True))
        take = pa.array(rows)
        return pa.record_batch({
            "doc_id": batch.column("doc_id").take(take), "h": batch.column("h").take(take), "at": pa.array(at.astype(np.int32)),
            "many": pa.array(many.astype(np.int32)), "key": pa.array(key.view(np.int64)), "block": pa.array(block.view(np.int64))})

    return stored(docs.mapInArrow(per_batch(work), "doc_id long, h long, at int, many int, key long, block long"), "blocks")


def _windows(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """``(doc_id, h, at, window)`` of the windows of the wanted blocks ``(doc_id, h, at)``."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        rows, places, out = [], [], []
        for k, (text, starts) in enumerate(zip(texts_of(batch.column("text")), batch.column("starts").to_pylist(), strict=True)):
            first, many, _, _, windows = word_blocks([text], size)
            for b in np.flatnonzero(np.isin(first, starts)):
                at = np.arange(first[b], first[b] + many[b])
                rows.append(np.full(len(at), k))
                places.append(at)
                out.append(windows[at])
        take = pa.array(np.concatenate(rows))
        return pa.record_batch({
            "doc_id": batch.column("doc_id").take(take), "h": batch.column("h").take(take),
            "at": pa.array(np.concatenate(places).astype(np.int32)), "window": pa.array(np.concatenate(out).view(np.int64))})

    starts = wanted.groupBy("doc_id", "h").agg(F.collect_set("at").alias("starts"))
    return docs.join(starts, ["doc_id", "h"]).select("doc_id", "h", "text", "starts").mapInArrow(
        per_batch(work), "doc_id long, h long, at int, window long")


def repeated_windows(docs: DataFrame, size: int = MIN_WORDS) -> DataFrame:
    """``(doc_id, h, at, many)``: runs of windows, by the number of their first word, that stand at an earlier place.

    ``docs`` has ``doc_id`` (not null), ``h`` (a hash of the text, which tells rows of one id apart) and ``text``. Places are
    ordered by (doc_id, h, word); a window that overlaps its own first place is not a repetition.
    """
    small_batches(docs.sparkSession)
    blocks = _blocks(docs, size)
    keys = blocks.groupBy("key").agg(F.count("*").alias("n"), F.min("block").alias("low"), F.max("block").alias("high"))
    keys = keys.where("n > 1").select("key", (F.col("low") != F.col("high")).alias("mixed"))
    shared = stored(blocks.join(keys, "key").select("doc_id", "h", "at", "many", "block", "mixed"), "shared")
    drop(blocks)
    first = shared.groupBy("block").agg(F.min(F.struct("doc_id", "h", "at")).alias("first"))
    placed = shared.join(first, "block")
    later = F.struct("doc_id", "h", "at") > F.col("first")
    near = (F.col("doc_id") == F.col("first.doc_id")) & (F.col("h") == F.col("first.h")) & (F.col("at") < F.col("first.at") + size)
    placed = stored(placed.select("doc_id", "h", "at", "many", "mixed", (later & ~near).alias("copy")), "placed")
    drop(shared)
    single = stored(_windows(docs, placed.where("mixed and not copy"), size), "windows")
    least = single.groupBy("window").agg(F.min(F.struct("doc_id", "h", "at")).alias("first"), F.count("*").alias("n")).where("n > 1")
    found = single.join(least, "window").where(later & ~near).select("doc_id", "h", "at", F.lit(1).alias("many"))
    out = stored(placed.where("copy").select("doc_id", "h", "at", "many").unionByName(found), "spans")
    drop(placed, single)
    return out


def remove_spans(docs: DataFrame, size: int = MIN_WORDS, added: str = "removed_words") -> DataFrame:
    """All columns of ``docs``, ``text`` without its repeated spans, and ``added int``: how many words went.

    A word goes if one of the windows of ``size`` words over it stands, word for word, at an earlier place (by doc_id and
    word, also in the same text) that it does not overlap; so spans of ``size`` words or more go, whatever stands before or
    after them and wherever their lines break. White space after a removed word goes with it, at the end of the text that
    before it; all else stays byte for byte. Null and empty texts, and rows with a null doc_id, are returned as they are.
    Rows that repeat an id and its text keep what the first one keeps. ``n_chars`` is set to the new length where it is there.
    Other columns are kept, whatever their names but that of ``added``; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    hashed = docs.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("h"), "text")
    runs = repeated_windows(hashed, size).groupBy("doc_id", "h").agg(F.collect_list(F.struct("at", "many")).alias("__runs"))
    runs = runs.select(F.col("doc_id").alias("__of"), F.col("h").alias("__h"), "__runs")
    joined = docs.join(runs, (F.col("doc_id") == F.col("__of")) & (F.xxhash64("text") == F.col("__h")), "left").drop("__of", "__h")
    joined = joined.withColumn("__gone", F.lit(0))
    at = joined.columns.index("text")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        runs = batch.column("__runs")
        some = np.flatnonzero(np.array(runs.is_valid()))
        if not len(some):
            return batch
        texts, gone = batch.column(at).cast(pa.binary()).to_pylist(), np.zeros(len(batch), np.int32)
        for k in some:
            texts[k], gone[k] = _without(texts[k], [(r["at"], r["many"]) for r in runs[int(k)].as_py()], size)
        last = batch.num_columns - 1  # the fields stay as they are: all batches of a task have one schema, "not null" included
        batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, pa.binary()).cast(batch.column(at).type))
        return batch.set_column(last, batch.schema.field(last), pa.array(gone))

    out = with_length(joined.mapInArrow(per_batch(work), joined.schema), docs, F.col("__gone") > 0)
    return out.select(*docs.columns, F.col("__gone").alias(added))


def remove_passages(docs: DataFrame, size: int = MIN_WORDS, percent: int = 80, added: tuple[str, str] = ("removed_lines", "removed_words")) -> DataFrame:
    """``docs`` without near-equal lines (``substring_dedup.remove_repeats``), and then without repeated spans of what is left.

    The lines of ``size`` words or more are the paragraphs that are banded, verified and joined in components; spans are the copies
    that no line holds alone: wrapped, or inside longer lines. Odd rows are as in both steps.
    """
    lines, words = added
    first = stored(remove_repeats(docs, size, percent, added="__lines_gone"), "lines_gone")
    return remove_spans(first, size, added="__words_gone").select(
        *docs.columns, F.col("__lines_gone").alias(lines), F.col("__words_gone").alias(words))


def _without(text: bytes, runs: list[tuple[int, int]], size: int) -> tuple[bytes, int]:
    """The text without the words under the runs of windows, and how many words went."""
    raw = np.frombuffer(text, np.uint8)
    word = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    edge = np.diff(np.concatenate([[0], word.astype(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    steps = np.zeros(len(starts) + 1, np.int64)
    for at, many in runs:
        steps[at] += 1
        steps[at + many - 1 + size] -= 1
    gone = np.cumsum(steps)[:-1] > 0
    turns = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
    parts, kept = [], 0
    for a, b in zip(np.flatnonzero(turns == 1), np.flatnonzero(turns == -1), strict=True):
        if b < len(starts):
            parts.append(text[kept : starts[a]])
            kept = starts[b]
        else:
            parts.append(text[kept : ends[a - 1] if a else starts[0]])
            kept = ends[-1]
    return b"".join([*parts, text[kept:]]), int(gone.sum())
