"""Links between near-equal sets, without all pairs: band keys meet, pivots first, size-banded tiles for the rest.

A *node* is a distinct set, named by 64 bits of its hash; copies share a node, so a group of exact copies costs one node
however large it is. Two nodes are compared if a band key brings them together:

1. every node of a bucket is verified against the bucket's least node, its pivot (at most one pair for a node and band);
2. buckets in which nodes other than the pivot still carry different labels are cut into tiles by size band, large tiles
   into pairs of blocks of bounded bytes, and each tile is searched with a union-find, so that a tile of n sets returns
   fewer than n pairs. Nothing is capped: every pair that shares a band key is verified, or both are already connected.

The only loss is that of the bands: see ``Banding.tuned``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlake.llm import shingles as sh
from marketlake.llm.common import drop, list_column, per_batch, small_batches, stored, texts_of
from marketlake.llm.components import components

#: Bytes of sets that one block of a tile holds; a tile task loads two blocks.
BLOCK_BYTES = 8 << 20


@dataclass(frozen=True)
class SetRule:
    """How texts become sets and when sets link: 100 * common >= percent * union."""

    extract: Callable[[bytes], list[tuple[int, np.ndarray]]]
    banding: sh.Banding
    percent: int = 80
    bitmaps: bool = False
    #: ``(text, pos, n, node, keys)`` of many texts at once, where that is cheaper than text by text.
    many: Callable[[list[bytes], sh.Banding], tuple[np.ndarray, ...]] | None = None

    def linked(self, a: np.ndarray, b: np.ndarray) -> bool:
        least = min(len(a), len(b))
        if 100 * least < self.percent * max(len(a), len(b)):
            return False
        both = sh.common(a, b)
        return 100 * both >= self.percent * (len(a) + len(b) - both)


def signatures(docs: DataFrame, rule: SetRule) -> DataFrame:
    """``(doc_id[, h], pos, n, node, keys)`` of every set that is not empty, stored; ``docs`` has ``doc_id``, ``text`` and perhaps ``h``."""
    small_batches(docs.sparkSession)
    extract, banding, names = rule.extract, rule.banding, [c for c in ("doc_id", "h") if c in docs.columns]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        if rule.many:
            at, pos, sizes, nodes, keys = rule.many(texts_of(batch.column("text")), banding)
            return pa.record_batch({
                **{c: batch.column(c).take(pa.array(at)) for c in names}, "pos": pa.array(pos.astype(np.int32)), "n": pa.array(sizes),
                "node": pa.array(nodes), "keys": list_column(keys.ravel(), np.full(len(at), banding.bands), pa.int64())})
        at, pos, sizes, nodes, keys = [], [], [], [], []
        for k, text in enumerate(texts_of(batch.column("text"))):
            for p, values in extract(text):
                if len(values):
                    at.append(k)
                    pos.append(p)
                    sizes.append(len(values))
                    nodes.append(sh.set_key(values)[:8])
                    keys.append(banding.keys(values))
        return pa.record_batch({
            **{c: batch.column(c).take(pa.array(at, pa.int64())) for c in names}, "pos": pa.array(pos, pa.int32()),
            "n": pa.array(sizes, pa.int64()), "node": pa.array(np.frombuffer(b"".join(nodes), np.int64)),
            "keys": list_column(np.concatenate(keys) if keys else np.zeros(0, np.int64), [banding.bands] * len(at), pa.int64())})

    out = docs.mapInArrow(per_batch(work), "".join(f"{c} long, " for c in names) + "pos int, n long, node long, keys array<long>")
    return stored(out, "signatures")


def _sets(docs: DataFrame, wanted: DataFrame, rule: SetRule) -> DataFrame:
    """``(node, n, values, bitmap)`` of the wanted nodes, from the texts of their first places."""
    extract, bitmaps = rule.extract, rule.bitmaps

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for k, (text, places) in enumerate(zip(texts_of(batch.column("text")), batch.column("places").to_pylist(), strict=True)):
            places = set(places)
            rows += [v for p, v in extract(text) if p in places]
        return pa.record_batch({
            "node": pa.array(np.frombuffer(b"".join(sh.set_key(v)[:8] for v in rows), np.int64)),
            "n": pa.array([len(v) for v in rows], pa.int64()), "values": pa.array([v.tobytes() for v in rows], pa.binary()),
            "bitmap": pa.array([sh.parity_bitmap(v).tobytes() if bitmaps else b"" for v in rows], pa.binary())})

    places = wanted.groupBy("doc_id").agg(F.collect_set("pos").alias("places"))
    return docs.join(places, "doc_id").select("text", "places").mapInArrow(
        per_batch(work), "node long, n long, values binary, bitmap binary")


def bound_allows(n_a: int, bits_a: np.ndarray, n_b: int, bits_b: np.ndarray, percent: int) -> bool:
    """Whether the bit counts leave room for a link: differing bits bound the common elements from above."""
    words = min(len(bits_a), len(bits_b))
    differ = int(np.bitwise_count(sh.folded(bits_a, words) ^ sh.folded(bits_b, words)).sum())
    most = (n_a + n_b - differ) // 2
    return 100 * most >= percent * (n_a + n_b - most)


def _verified(pairs: DataFrame, sets: DataFrame, rule: SetRule) -> DataFrame:
    """The rows of ``(a, b)`` whose sets link."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        keep = []
        columns = [batch.column(c).to_pylist() for c in ("va", "vb", "ba", "bb")]
        for k, (va, vb, ba, bb) in enumerate(zip(*columns, strict=True)):
            if rule.bitmaps and not bound_allows(
                    len(va) // 8, np.frombuffer(ba, np.uint64), len(vb) // 8, np.frombuffer(bb, np.uint64), rule.percent):
                continue
            if rule.linked(np.frombuffer(va, np.uint64), np.frombuffer(vb, np.uint64)):
                keep.append(k)
        return batch.select(["a", "b"]).take(pa.array(keep, pa.int64())) if keep else None

    low, high = rule.percent / 100 - 1e-9, 100 / rule.percent + 1e-9
    one = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("values").alias("va"), F.col("bitmap").alias("ba"))
    two = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("values").alias("vb"), F.col("bitmap").alias("bb"))
    sized = sets.select("node", "n").distinct()
    fitting = pairs.join(sized.toDF("a", "n1"), "a").join(sized.toDF("b", "n2"), "b").where(
        (F.col("n1") >= F.col("n2") * low) & (F.col("n1") <= F.col("n2") * high)).select("a", "b")
    return fitting.join(one, "a").join(two, "b").mapInArrow(per_batch(work), "a long, b long")


def _tile_links(rule: SetRule) -> Callable[[pa.Table], pa.Table]:
    """Search of one tile: sets by size, bit counts first, exact intersection then, connected pairs skipped."""

    def search(table: pa.Table) -> pa.Table:
        home = np.array(table.column("home"))
        order = np.lexsort((~home, np.array(table.column("n"))))
        n, home, block = np.array(table.column("n"))[order], home[order], np.array(table.column("salt"))[order]
        node, label = np.array(table.column("node"))[order], np.unique(np.array(table.column("label"))[order], return_inverse=True)[1]
        values = [np.frombuffer(v, np.uint64) for v in table.column("values").take(pa.array(order)).to_pylist()]
        if rule.bitmaps:
            raw = [np.frombuffer(v, np.uint64) for v in table.column("bitmap").take(pa.array(order)).to_pylist()]
            width = min(map(len, raw))
            bits = np.stack([sh.folded(b, width) for b in raw])
        split = int(np.array(table.column("i"))[0]) != int(np.array(table.column("j"))[0])
        left, right = [], []
        for a in range(len(n) - 1):
            stop = int(np.searchsorted(n, n[a] * 100 // rule.percent, side="right"))
            near = slice(a + 1, stop)
            fits = (label[near] != label[a]) & (home[near] | home[a])
            if split:
                fits &= block[near] != block[a]
            if rule.bitmaps and fits.any():
                most = (n[a] + n[near] - np.bitwise_count(bits[near] ^ bits[a]).sum(axis=1)) // 2
                fits &= 100 * most >= rule.percent * (n[a] + n[near] - most)
            for b in np.flatnonzero(fits) + a + 1:
                if label[b] != label[a] and rule.linked(values[a], values[b]):
                    left.append(node[a])
                    right.append(node[b])
                    label[label == label[b]] = label[a]
        return pa.table({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})

    return search


def _rest(members: DataFrame, edges: DataFrame, sets: DataFrame, rule: SetRule) -> tuple[DataFrame, DataFrame]:
    """The stored rows of tiles, and links between nodes of a bucket that the pivots have not connected, tile by tile."""
    first = edges.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("l1"))
    labels = first.join(first.toDF("l1", "l2"), "l1", "left").select("node", F.coalesce("l2", "l1").alias("label"))
    known = members.where("node != pivot").join(labels, "node", "left").select(
        "key", "node", F.coalesce("label", "node").alias("label"))
    open_keys = known.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low != high").select("key")
    sized = sets.select("node", "n").distinct()
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / rule.percent)))
    rows = known.join(open_keys, "key").join(sized, "node").withColumn("band", band)
    rows = rows.select("key", "node", "label", "n", F.explode(F.array(
        F.struct(F.col("band").alias("band"), F.lit(True).alias("home")),
        F.struct((F.col("band") + 1).alias("band"), F.lit(False).alias("home")))).alias("t")).select("key", "node", "label", "t.*", "n")
    tiled = rows = stored(rows, "tiles")
    tiles = rows.groupBy("key", "band").agg(
        F.sum(8 * F.col("n")).alias("bytes"), F.count("*").alias("count"), F.max("home").alias("lived"),
        F.min("label").alias("low"), F.max("label").alias("high")).where("lived and count > 1 and low != high")
    tiles = tiles.select("key", "band", F.ceil(F.col("bytes") / BLOCK_BYTES).cast("int").alias("blocks"))
    rows = rows.join(tiles, ["key", "band"]).withColumn("salt", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", "band", "node", "label", "home", "salt", F.least("salt", "other").alias("i"), F.greatest("salt", "other").alias("j"))
    return tiled, rows.join(sets, "node").groupBy("key", "band", "i", "j").applyInArrow(_tile_links(rule), "a long, b long")


def groups(docs: DataFrame, rule: SetRule) -> tuple[DataFrame, DataFrame]:
    """``(signatures, roots)``: ``(doc_id[, h], pos, n, node)`` of the sets of ``docs``, and ``(node, root)`` for every node that has a link."""
    sigs = signatures(docs, rule)
    nodes = sigs.where("doc_id is not null").groupBy("node").agg(
        F.min(F.struct("doc_id", "pos")).alias("at"), F.any_value("keys").alias("keys"))
    nodes = stored(nodes.select("node", "at.*", "keys"), "nodes")
    slim = stored(sigs.drop("keys"), "signatures")
    drop(sigs)
    keyed = nodes.select(F.explode("keys").alias("key"), "node")
    buckets = keyed.groupBy("key").agg(F.min("node").alias("pivot"), F.max("node").alias("top")).where("pivot < top")
    members = stored(keyed.join(buckets.select("key", "pivot"), "key"), "members")
    wanted = nodes.select("node", "doc_id", "pos").join(members.select("node").distinct(), "node", "left_semi")
    sets = stored(_sets(docs, wanted, rule), "sets")
    pairs = members.where("node != pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    edges = stored(_verified(pairs, sets, rule), "edges")
    rows, rest = _rest(members, edges, sets, rule)
    more = stored(rest, "edges")
    drop(nodes, members, sets, rows)
    roots = components(edges.union(more))
    drop(edges, more)
    return slim, roots


def one_set(make: Callable[[list[bytes]], np.ndarray]) -> Callable[[bytes], list[tuple[int, np.ndarray]]]:
    """The whole text as one set."""

    def extract(text: bytes) -> list[tuple[int, np.ndarray]]:
        return [(0, make(sh.words_of(text)))]

    return extract

