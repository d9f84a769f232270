"""N-gram Jaccard join: size-banded tiles, hashed bitmap signatures, exact intersection of sorted arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlake.llm import setlinks, shingles
from marketlake.llm.common import stored

#: A pair just at the threshold fails to meet in any band once in 30 million times; more similar pairs, more rarely.
RECALL = 1 - 3.3e-8


def join_groups(docs: DataFrame, percent: int = 80, recall: float = RECALL) -> DataFrame:
    """``(doc_id, n_shingles, component_id)``: the near-duplicate group of every row of ``docs``.

    A text's set holds its distinct 5-word shingles (A-Z lower-cased, words split on ASCII white space); a text of fewer
    words is one shingle; null and empty texts have an empty set and link with nothing. Two texts link if
    100 * intersection >= percent * union, exactly. Candidates come from min-hash bands, whose chance of missing a pair is
    ``1 - recall`` at the threshold; bit counts of parity bitmaps then bound the overlap from above, and the sorted arrays
    decide. ``component_id`` is the smallest doc_id reachable by links, the row's own included.
    A null doc_id is returned with a null component and links nothing. A repeated row is returned as often as it is given.
    Other columns are ignored; an empty table gives no rows.
    """
    return _grouped(docs.select("doc_id", "text"), percent, recall).select("doc_id", "n_shingles", "component_id")


def _grouped(docs: DataFrame, percent: int, recall: float) -> DataFrame:
    """``(doc_id[, h], n_shingles, component_id, root)``; ``root`` names the component of texts, null for a text without words."""
    names = [c for c in docs.columns if c != "text"]
    rule = setlinks.SetRule(
        setlinks.one_set(shingles.shingle_set), shingles.Banding.tuned(percent / 100, recall), percent, bitmaps=True)
    sigs, roots = setlinks.groups(docs, rule)
    sigs = sigs.select(*names, "n", "node")
    classes = sigs.where("doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
    named = classes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "least")
    named = stored(named, "classes")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(least, "root").select("node", "component_id", "root")
    found = sigs.join(named, "node", "left").select(
        *names, F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"), "root")
    # Rows without a shingle have no signature: as many as their id lacks.
    bare = docs.where(~F.coalesce(F.col("text").rlike("[^\\x20\\x09-\\x0D]"), F.lit(False)))
    return found.unionByName(bare.select(
        *names, F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("root")))


def keep_one(docs: DataFrame, percent: int = 80, recall: float = RECALL) -> DataFrame:
    """The rows of ``docs`` that stand for their group: the document of least id, once.

    Rows that repeat an id are told apart by their texts: each goes or stays with the group of its own text, and of those of
    one group and id the least hash stays. Equal rows of one id stay once. Rows with a null doc_id all stay. All columns are
    kept; an empty table gives no rows.
    """
    hashed = F.xxhash64("text")
    rows = _grouped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", hashed.alias("h")), percent, recall)
    kept = rows.where("doc_id = component_id").groupBy(
        F.col("doc_id").alias("__of"), F.coalesce("root", "h"), F.col("root").isNull()).agg(F.min("h").alias("__h"))
    named = docs.join(kept.select("__of", "__h").distinct(), (F.col("doc_id") == F.col("__of")) & (hashed == F.col("__h")), "left_semi")
    named = named.withColumn("__h", hashed).dropDuplicates(["doc_id", "__h"]).select(docs.columns)
    return named.unionByName(docs.where("doc_id is null"))
