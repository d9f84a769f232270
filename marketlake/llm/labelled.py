"""Bounded training samples of labelled documents, and word splitting shared by the classifiers."""

from __future__ import annotations

import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlake.llm.common import held_out

#: Labelled rows of each class that a classifier is fitted on at most, and characters of text of each class.
SAMPLE_ROWS = 1500
SAMPLE_CHARS = 8_000_000
#: Part of a class's characters that one text may take; longer texts come last, if there is room.
ROW_SHARE = 16
#: Words a worker remembers; emptied beyond it (no result depends on it).
REMEMBERED_WORDS = 150_000

#: Calibration rows of the rarer class below which the whole sample calibrates.
LEAST_CALIBRATION = 8

_SPLIT = bytes(c + 32 if 65 <= c <= 90 else 32 if c < 48 or 58 <= c < 65 or 91 <= c < 97 or 123 <= c < 128 else c for c in range(256))


def plain_words(text: bytes) -> list[bytes]:
    """Lower-cased words without ASCII punctuation."""
    return text.translate(_SPLIT).split()


class WordCodes(dict):
    """Codes of words, remembered: ``code(hash of the word, word)``."""

    def __init__(self, code):
        self.code = code

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED_WORDS:
            self.clear()
        value = self[word] = self.code(xxhash.xxh3_64_intdigest(word), word)
        return value


def labelled_documents(docs: DataFrame, labels: DataFrame, target: str) -> DataFrame:
    """``(docs columns and __label)`` of all documents with a label to learn from, one row an id.

    Labels and rows that repeat an id count as in ``training_sample``.
    """
    known = labels.where(F.col(target).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(
        F.max(target).cast("int").alias("__label"))
    found = docs.join(known, "doc_id")
    one = found.groupBy("doc_id").agg(F.min_by(F.struct(*found.columns), F.xxhash64("text")).alias("__row"))
    return one.select("__row.*")


def training_sample(
        docs: DataFrame, labels: DataFrame, target: str, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> tuple[DataFrame, dict[int, int]]:
    """``(docs columns and __label)`` of the sampled documents, and how many labelled documents each class has.

    Only labels of rows that are not held out count; of repeated labels the larger holds, of rows that repeat an id the one of
    least text hash. In each class the rows of least hash of the id are taken, up to ``rows`` rows and ``chars`` characters of
    whole texts; texts of more than 1/``ROW_SHARE`` of the characters stand behind all others, so that one costs no other row
    its place. At least one row of a class is taken.
    """
    known = labels.where(F.col(target).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(
        F.max(target).cast("int").alias("__label"))
    sizes = docs.groupBy("doc_id").agg(F.max(F.coalesce(F.length("text"), F.lit(0))).alias("__size"))
    known = known.join(sizes, "doc_id").withColumns({"__order": F.xxhash64("doc_id"), "__long": F.col("__size") > chars // ROW_SHARE})
    counts = {int(r[0]): int(r[1]) for r in known.groupBy("__label").count().collect()}
    order = ("__long", "__order", "doc_id")
    parts = [known.where(F.col("__label") == k).orderBy(*order).limit(rows) for k in (0, 1)]
    running = Window.partitionBy("__label").orderBy(*order)
    chosen = parts[0].union(parts[1]).withColumn("__total", F.sum("__size").over(running))
    chosen = chosen.withColumn("__place", F.row_number().over(running))
    chosen = chosen.where((F.col("__total") <= chars) | (F.col("__place") <= 1)).select("doc_id", "__label")
    found = docs.join(F.broadcast(chosen), "doc_id")
    one = found.groupBy("doc_id").agg(F.min_by(F.struct(*found.columns), F.xxhash64("text")).alias("__row"))
    return one.select("__row.*"), counts
