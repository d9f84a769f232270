"""Substring dedup: paragraph min-hash bands, exact Jaccard of what collides, removal by components."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlake.llm import setlinks, shingles
from marketlake.llm.common import per_batch, portions, texts_of

#: Words that a paragraph has at least to be a candidate: shorter ones are common phrases, not copied passages.
MIN_WORDS = 50
#: Bytes of text that are hashed at once.
PORTION = 4 << 20
#: Chance that two paragraphs just at the threshold meet in a band.
RECALL = 0.9999


def paragraphs(min_words: int) -> Callable[[bytes], list[tuple[int, np.ndarray]]]:
    """The lines of a text with ``min_words`` words or more, as (line number, shingle set)."""

    def extract(text: bytes) -> list[tuple[int, np.ndarray]]:
        lines = text.split(b"\n")
        hashes, counts = shingles.hashed_words(lines)
        stops = np.cumsum(counts)
        return [(int(k), shingles.shingle_set_of(hashes[stops[k] - counts[k] : stops[k]])) for k in np.flatnonzero(counts >= min_words)]

    return extract


def paragraph_signatures(min_words: int) -> Callable[[list[bytes], shingles.Banding], tuple[np.ndarray, ...]]:
    """What ``paragraphs`` and the banding give line by line, for all lines of many texts at once."""
    size = shingles.WORDS_PER_SHINGLE
    if min_words < size:
        raise ValueError(f"paragraphs of fewer than {size} words have no shingle of that size")

    def run(texts: list[bytes], banding: shingles.Banding) -> tuple[np.ndarray, ...]:
        found = []
        for first, part in portions(texts, PORTION):
            at, pos, lines = [], [], []
            for k, text in enumerate(part, first):
                for p, line in enumerate(text.split(b"\n")):
                    if len(line) >= 2 * min_words - 1:
                        at.append(k)
                        pos.append(p)
                        lines.append(line)
            hashes, counts = shingles.hashed_words(lines)
            enough = counts >= min_words
            if enough.any():
                signed = _signed(hashes[np.repeat(enough, counts)], counts[enough], banding)
                found.append((np.array(at)[enough], np.array(pos)[enough], *signed))
        if not found:
            none = np.zeros(0, np.int64)
            return none, none, none, none, np.zeros((0, banding.bands), np.int64)
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    return run


def _signed(hashes: np.ndarray, counts: np.ndarray, banding: shingles.Banding) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(n, node, keys)`` of lines whose hashed words stand one after another."""
    sizes = counts - shingles.WORDS_PER_SHINGLE + 1
    line = np.repeat(np.arange(len(counts)), sizes)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    values = shingles.rolling_of(hashes)[np.arange(len(line)) + (np.cumsum(counts) - counts - starts)[line]]
    keys = banding.many_keys(values, starts)
    for a, n in zip(starts.tolist(), sizes.tolist(), strict=True):
        values[a : a + n].sort()
    once = np.concatenate([[True], (values[1:] != values[:-1]) | (line[1:] != line[:-1])])
    values, n = values[once], np.bincount(line[once], minlength=len(counts))
    cuts = np.concatenate([[0], np.cumsum(n)]).tolist()
    nodes = b"".join(shingles.set_key(values[a:b])[:8] for a, b in zip(cuts, cuts[1:], strict=False))
    return n, np.frombuffer(nodes, np.int64), keys


def repeated_paragraphs(docs: DataFrame, min_words: int = MIN_WORDS, percent: int = 80, recall: float = RECALL) -> DataFrame:
    """``(doc_id, pos, root, first_doc, first_pos)``: every paragraph that a near-equal earlier one makes superfluous.

    Paragraphs are lines; ``pos`` is the line number from 0. Near-equal paragraphs (Jaccard of 5-word shingles at least
    ``percent`` %, exactly) form components, and the first place by (doc_id, line) of a component stays.
    """
    docs = docs.select("doc_id", "text").where("doc_id is not null")
    rule = setlinks.SetRule(paragraphs(min_words), shingles.Banding.tuned(percent / 100, recall), percent, many=paragraph_signatures(min_words))
    sigs, roots = setlinks.groups(docs, rule)
    places = sigs.select("doc_id", "pos", "node").join(roots, "node", "left").select(
        "doc_id", "pos", F.coalesce("root", "node").alias("root"))
    first = places.groupBy("root").agg(F.min(F.struct("doc_id", "pos")).alias("first"), F.count("*").alias("n")).where("n > 1")
    return places.join(first, "root").where("doc_id != first.doc_id or pos != first.pos").select(
        "doc_id", "pos", "root", F.col("first.doc_id").alias("first_doc"), F.col("first.pos").alias("first_pos"))


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS, percent: int = 80, added: str = "removed_lines") -> DataFrame:
    """All columns of ``docs``, ``text`` without the superfluous paragraphs, and ``added array<int>``: the lines that went.

    Every copy of a passage but the first goes with its line; all other lines stay byte for byte and in order. Null and
    empty texts, and rows with a null doc_id, are returned as they are. Rows that repeat a doc_id share their line numbers,
    so a repeated row keeps what the first one keeps. ``n_chars`` is set to the new length where the column is there. Other
    columns are kept, whatever their names but that of ``added``; an empty table gives no rows.
    """
    lines = repeated_paragraphs(docs, min_words, percent).groupBy("doc_id").agg(F.collect_set("pos").alias("lines"))
    lines = lines.select(F.col("doc_id").alias("__of"), F.sort_array("lines").alias("__lines"))
    joined = docs.join(lines, F.col("doc_id") == F.col("__of"), "left").drop("__of")
    at = joined.columns.index("text")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        gone = batch.column("__lines").to_pylist()
        if not any(gone):
            return batch
        texts = [_without(t, set(g)) if g else t for t, g in zip(batch.column(at).cast(pa.binary()).to_pylist(), gone, strict=True)]
        return batch.set_column(at, batch.schema.field(at), pa.array(texts, pa.binary()).cast(batch.column(at).type))

    out = joined.mapInArrow(per_batch(work), joined.schema)
    return with_length(out, docs, F.size("__lines") > 0).select(*docs.columns, F.coalesce("__lines", F.array().cast("array<int>")).alias(added))


def with_length(out: DataFrame, docs: DataFrame, changed: Column) -> DataFrame:
    """``n_chars``, where ``docs`` has it, as the length of the texts that changed."""
    if "n_chars" not in docs.columns:
        return out
    length = F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.withColumn("n_chars", F.coalesce(length, "n_chars"))


def _without(text: bytes, lines: set[int]) -> bytes:
    return b"\n".join(x for k, x in enumerate(text.split(b"\n")) if k not in lines)

