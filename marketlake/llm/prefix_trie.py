"""Conversation prefix trie from sorted conversations, by range minima over their common prefixes.

A conversation is named by a chain of digests, one a turn, each over the turn and the digest before it; so equal prefixes are
equal digests, and conversations sorted by their chains hold the members of every prefix next to each other. Sorted rows are
dealt by ranges. In a block of rows the common prefix with the row before is an array of numbers with a sparse table of range
minima, and each prefix finds the first and the last row of its interval by two binary searches of its own, with no stack and
no order among the prefixes. All figures of a node are sums over the rows of its interval:

* saved tokens: code points of all its rows from its depth on, less those of the nodes that begin in it;
* leaves: rows that the next row neither repeats nor extends; children: rows where a node of the next depth begins.

A node inside a block is final. One that touches the edge of a block is a partial sum; Spark adds these up by node, with a
correction for every edge of two blocks, whose common prefix neither block knows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlake.llm.common import per_batch, small_batches, stored

#: Turns of a block, about; a longer conversation makes a block of its own.
BLOCK_TURNS = 400_000
#: Conversations that a range holds, about.
RANGE_ROWS = 200_000
DIGEST = 16
ROOT = bytes(DIGEST)
NO_ENDS = hashlib.sha256(b"").hexdigest()


def opening_rule(conv_id: Column) -> tuple[Column, Column]:
    """The conversation whose opening is taken over, and how many of its turns."""
    return conv_id - conv_id % 100, (F.crc32(conv_id.cast("string").cast("binary")) % 6).cast("int")


#: Most turns that ``opening_rule`` takes over.
OPENING = 5


def rebuilt(conversations: DataFrame) -> DataFrame:
    """``(conv_id, digests, sizes)``: turn digests and code points of every conversation with its opening exchanged.

    The first h turns are those of another conversation (``opening_rule``), all if it has fewer and none if it does not exist.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    # The length of the role parts role and text; of equal turns the role and then the text's digest decide.
    digest = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), F.md5(text).alias("order"), digest.alias("digest"),
        F.length(text).alias("size"))
    own = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "order", "digest", "size"))).alias("turns"))
    own = stored(own.select("conv_id", F.col("turns.digest").alias("digests"), F.col("turns.size").alias("sizes")), "conversations")
    base, count = opening_rule(F.col("conv_id"))
    openings = own.where(base == F.col("conv_id")).select(
        F.col("conv_id").alias("base"), F.slice("digests", 1, OPENING).alias("first"), F.slice("sizes", 1, OPENING).alias("first_sizes"))
    taken = own.withColumns({"base": base, "h": count}).join(openings, "base", "left")

    def exchanged(opening: str, rest: str) -> Column:
        kept = F.slice(F.col(rest), F.col("h") + 1, F.greatest(F.size(rest) - F.col("h"), F.lit(0)))
        return F.concat(F.coalesce(F.slice(F.col(opening), F.lit(1), F.col("h")), F.slice(F.col(rest), 1, 0)), kept).alias(rest)

    return taken.select("conv_id", exchanged("first", "digests"), exchanged("first_sizes", "sizes"))


def _chained(convs: DataFrame) -> DataFrame:
    """``(conv_id, key, sizes, n)``: the chain of digests as bytes, and the code points of turns as bytes."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys = []
        for digests in batch.column("digests").to_pylist():
            link, chain = ROOT, []
            for d in digests:
                link = hashlib.md5(link + d, usedforsecurity=False).digest()
                chain.append(link)
            keys.append(b"".join(chain))
        sizes = [np.array(s, "<i8").tobytes() for s in batch.column("sizes").to_pylist()]
        return pa.record_batch({
            "conv_id": batch.column("conv_id"), "key": pa.array(keys, pa.binary()), "sizes": pa.array(sizes, pa.binary()),
            "n": pa.array([len(k) // DIGEST for k in keys], pa.int64())})

    return convs.mapInArrow(per_batch(work), "conv_id long, key binary, sizes binary, n long")


class RangeLeast:
    """A sparse table: least value of any range in two look-ups."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while len(self.levels[-1]) > 1 << (len(self.levels) - 1):
            last, step = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(last[:-step], last[step:]))

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The least of the values from ``left`` to ``right``, both included."""
        level = np.frexp((right - left + 1).astype(float))[1] - 1
        out = np.empty(len(left), self.levels[0].dtype)
        for k in np.unique(level):
            at = level == k
            row = self.levels[k]
            out[at] = np.minimum(row[left[at]], row[right[at] - (1 << k) + 1])
        return out

    def reach(self, at: np.ndarray, floor: np.ndarray, step: int) -> np.ndarray:
        """How far one can go from ``at`` (one on at a time, by ``step`` 1 or -1) while all values on the way are ``floor`` or more."""
        size, moved = len(self.levels[0]), np.zeros(len(at), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            width = 1 << k
            begin = at + moved if step > 0 else at - moved - width + 1
            fits = (begin >= 0) & (begin + width <= size)
            row = self.levels[k]
            inside = np.clip(begin, 0, len(row) - 1)
            moved += width * (fits & (row[inside] >= floor))
        return moved


class Block:
    """Sorted conversations of one block: chains end to end, code points of turns, ids."""

    def __init__(self, ids: list[int], keys: list[bytes], sizes: list[bytes]):
        self.ids = np.array(ids, np.int64)
        self.len = np.array([len(k) // DIGEST for k in keys], np.int64)
        self.offset = np.concatenate([[0], np.cumsum(self.len)])
        self.chain = np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2)
        self.total = np.concatenate([[0], np.cumsum(np.frombuffer(b"".join(sizes), "<i8"))])  # code points before a flat turn
        row, flat = np.repeat(np.arange(len(ids)), self.len), np.arange(self.offset[-1])
        depth = flat - self.offset[row]
        before = self.offset[row - 1] + depth
        same = (row > 0) & (depth < self.len[row - 1])
        same[same] = (self.chain[flat[same]] == self.chain[before[same]]).all(axis=1)
        self.common = np.bincount(row[same], minlength=len(ids))  # with the row before; a chain agrees as far as it agrees at all
        self.common[0] = -1

    def prefix(self, row: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Code points of the first ``depth`` turns."""
        return self.total[self.offset[row] + depth] - self.total[self.offset[row]]

    def node(self, row: int, depth: int) -> bytes:
        return self.chain[self.offset[row] + depth - 1].tobytes() if depth else ROOT

    def nodes(self) -> dict[str, np.ndarray]:
        """All prefixes of the block's rows, each with its interval and sums."""
        rows = len(self.ids)
        fresh = self.len - self.common
        at = np.repeat(np.arange(rows), fresh)
        depth = np.arange(len(at)) - np.repeat(np.cumsum(fresh) - fresh, fresh) + self.common[at] + 1
        least, ids = RangeLeast(self.common), RangeLeast(self.ids)
        first, last = at - least.reach(at, depth, -1), at + least.reach(at + 1, depth, 1)
        up = np.maximum(depth - 1, 0)
        up_first, up_last = at - least.reach(at, up, -1), at + least.reach(at + 1, up, 1)
        members = last - first + 1
        whole = self.prefix(np.arange(rows), self.len)
        new = whole - self.prefix(np.arange(rows), np.maximum(self.common, 0))
        sums, news = np.concatenate([[0], np.cumsum(whole)]), np.concatenate([[0], np.cumsum(new)])
        above = self.prefix(first, np.maximum(depth - 1, 0))
        spent = sums[last + 1] - sums[first] - members * above
        begun = news[last + 1] - news[first + 1] + whole[first] - above
        done = np.append(self.common[1:], -1) < self.len
        leaves = np.concatenate([[0], np.cumsum(done)])
        longer = np.flatnonzero(self.len > self.common)  # a row that repeats the one before begins no node
        starts = np.sort((np.maximum(self.common[longer], 0) << 32) + longer) if rows else longer
        children = np.searchsorted(starts, (depth << 32) + last + 1) - np.searchsorted(starts, (depth << 32) + first + 1)
        exact = np.sort((self.len << 32) + np.arange(rows))
        ends = np.searchsorted(exact, (depth << 32) + last + 1) - np.searchsorted(exact, (depth << 32) + first)
        return {
            "row": at, "depth": depth, "first": first, "last": last, "conv_id": ids(first, last), "members": members, "saved": spent - begun,
            "leaves": leaves[last + 1] - leaves[first], "children": children + (self.len[first] > depth), "ends": ends,
            "parent_id": ids(up_first, up_last), "open": (first == 0) | (last == rows - 1),
            "open_parent": (up_first == 0) | (up_last == rows - 1)}

    def ends_text(self, first: int, count: int) -> bytes:
        return ",".join(map(str, self.ids[first : first + count].tolist())).encode()


#: kind: 0 a final node, 1 a partial node, 2 the edges of a block.
_PARTS = """kind int, block long, node binary, parent binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long,
  n_leaves long, saved_tokens long, ends_sha256 string, ends binary, first_key binary, first_sizes binary, last_key binary"""


def _block_rows(number: int, ids: list[int], keys: list[bytes], sizes: list[bytes]) -> pa.RecordBatch:
    block = Block(ids, keys, sizes)
    found = block.nodes()
    row, depth, is_open, ends = (found[c] for c in ("row", "depth", "open", "ends"))
    count, pad = len(row), lambda values, kind: pa.concat_arrays([values, pa.nulls(1, kind)])
    texts: list[bytes | None] = [None] * count
    digests: list[str | None] = [NO_ENDS] * count
    for k in np.flatnonzero(ends):
        text = block.ends_text(int(found["first"][k]), int(ends[k]))
        if is_open[k]:
            texts[k] = text
        else:
            digests[k] = hashlib.sha256(text).hexdigest()
    chain = [ROOT, *(c.tobytes() for c in block.chain)]

    def named(at: np.ndarray, missing: np.ndarray) -> pa.Array:
        return pa.array([None if m else chain[k] for k, m in zip(at.tolist(), missing.tolist(), strict=True)], pa.binary())

    place = block.offset[row] + depth  # of the node's digest, the root's at 0
    whole = {
        "depth": depth, "conv_id": found["conv_id"], "n_convs": found["members"], "n_children": found["children"], "n_leaves": found["leaves"],
        "saved_tokens": found["saved"]}
    return pa.record_batch({
        "kind": pa.array(np.append(is_open.astype(np.int32), np.int32(2))), "block": pa.array(np.full(count + 1, number)),
        "node": pad(named(np.where(depth > 0, place, 0), np.zeros(count, bool)), pa.binary()),
        "parent": pad(named(np.where(depth > 1, place - 1, 0), depth == 0), pa.binary()),
        **{c: pad(pa.array(v, pa.int64()), pa.int64()) for c, v in whole.items()},
        # Known where the parent is whole in this block.
        "parent_conv_id": pad(pa.array(found["parent_id"], pa.int64(), mask=found["open_parent"] | (depth == 0)), pa.int64()),
        "ends_sha256": pa.array([*digests, None], pa.string()), "ends": pa.array([*texts, None], pa.binary()),
        "first_key": pa.array([None] * count + [keys[0]], pa.binary()), "first_sizes": pa.array([None] * count + [sizes[0]], pa.binary()),
        "last_key": pa.array([None] * count + [keys[-1]], pa.binary())}).select(_PART_NAMES)


_PART_NAMES = [field.split()[0] for field in _PARTS.split(",")]


def _blocks(chains: DataFrame, ranges: int, block_turns: int) -> DataFrame:
    """The nodes and edges of every block of the sorted conversations, stored."""
    dealt = chains.repartitionByRange(ranges, "key", "conv_id").sortWithinPartitions("key", "conv_id").select("conv_id", "key", "sizes")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, keys, sizes, turns, number = [], [], [], 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            for i, k, s in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "key", "sizes")), strict=True):
                if ids and turns + len(k) // DIGEST + 1 > block_turns:
                    yield _block_rows(number, ids, keys, sizes)
                    ids, keys, sizes, turns, number = [], [], [], 0, number + 1
                ids.append(i)
                keys.append(k)
                sizes.append(s)
                turns += len(k) // DIGEST + 1
        if ids:
            yield _block_rows(number, ids, keys, sizes)

    return stored(dealt.mapInArrow(work, _PARTS), "trie_blocks")


def _corrections(parts: DataFrame) -> DataFrame:
    """What blocks count twice on the common prefix of one's last and the next one's first row: one row a node and edge."""
    edges = parts.where("kind = 2").select("block", "first_key", "first_sizes", "last_key")
    # One row a block; the window sees no conversations but the two at the edges.
    edges = edges.withColumn("before", F.lag("last_key").over(Window.orderBy("block"))).where("before is not null")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        nodes, depths, saved, children, leaves = [], [], [], [], []
        for first, sizes, last in zip(*(batch.column(c).to_pylist() for c in ("first_key", "first_sizes", "before")), strict=True):
            size, rows = np.frombuffer(sizes, "<i8"), min(len(first), len(last)) // DIGEST
            a, b = (np.frombuffer(x, "<u8").reshape(-1, 2)[:rows] for x in (first, last))
            shared = int((a == b).all(axis=1).sum())
            # A block's first row has been taken to begin its nodes: the shared ones begin before it.
            again = np.concatenate([np.cumsum(size[:shared][::-1])[::-1], [0]])
            nodes += [first[DIGEST * (d - 1) : DIGEST * d] if d else ROOT for d in range(shared + 1)]
            depths += range(shared + 1)
            saved += [int(again[max(d - 1, 0)]) for d in range(shared + 1)]
            children += [-1 if d < shared else 0 for d in range(shared + 1)]
            leaves += [-1 if shared == len(last) // DIGEST else 0] * (shared + 1)
        return pa.record_batch({
            "node": pa.array(nodes, pa.binary()), "depth": pa.array(depths, pa.int64()), "n_children": pa.array(children, pa.int64()),
            "n_leaves": pa.array(leaves, pa.int64()), "saved_tokens": pa.array(saved, pa.int64())})

    return edges.mapInArrow(per_batch(work), "node binary, depth long, n_children long, n_leaves long, saved_tokens long")


def _ends(parts: DataFrame) -> DataFrame:
    """``(node, ends_sha256)`` of the nodes over several blocks, their pieces read one after another."""
    pieces = parts.where("kind = 1 and ends is not null").select("node", "block", "ends")
    dealt = pieces.repartition("node").sortWithinPartitions("node", "block")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, digest = None, None

        def out() -> pa.RecordBatch:
            return pa.record_batch({"node": pa.array([last], pa.binary()), "ends_sha256": [digest.hexdigest()]})

        for batch in batches:
            for node, ends in zip(batch.column("node").to_pylist(), batch.column("ends").to_pylist(), strict=True):
                if node == last:
                    digest.update(b",")
                else:
                    if last is not None:
                        yield out()
                    last, digest = node, hashlib.sha256()
                digest.update(ends)
        if last is not None:
            yield out()

    return dealt.mapInArrow(work, "node binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame, range_rows: int = RANGE_ROWS, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """One row a node: ``(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)``.

    Conversations are ordered by turn (nulls first; of equal turns by role and the text's md5), null roles and texts are empty,
    and their openings are exchanged (``rebuilt``). Each distinct sequence of the first d turns is a node, named by its smallest
    member and d; the root (d = 0) has all conversations, also those without turns. ``n_leaves`` counts childless nodes in the
    node's subtree, itself included; ``saved_tokens`` sums (members - 1) x code points of the last text over the subtree;
    ``ends_sha256`` digests the ids of members of exactly d turns, ascending, joined by commas.
    Rows with a null conv_id are left out, repeated rows are turns of their own, other columns are ignored, and a table without
    conversations has no nodes. One conversation is held as a whole: some 150 bytes a turn, whatever its texts.
    """
    small_batches(conversations.sparkSession)
    chains = stored(_chained(rebuilt(conversations)), "chains")
    parts = _blocks(chains, max(1, -(-chains.count() // range_rows)), block_turns)
    figures = ("n_convs", "n_children", "n_leaves", "saved_tokens")
    partial = parts.where("kind = 1").select("node", "parent", "depth", "conv_id", *figures)
    fixed = _corrections(parts).select(
        "node", F.lit(None).cast("binary").alias("parent"), "depth", F.lit(None).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("n_convs"),
        *figures[1:])
    merged = partial.unionByName(fixed).groupBy("node").agg(
        F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in figures])
    merged = stored(merged.join(_ends(parts), "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS))), "open_nodes")
    final = parts.where("kind = 0")
    columns = ("conv_id", "depth", "parent_conv_id", *figures, "ends_sha256")
    # Nodes right below the edge of a block find their parents among the few that span blocks.
    seeking = final.where("parent_conv_id is null").drop("parent_conv_id").select(merged.columns).unionByName(merged)
    parents = merged.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return final.where("parent_conv_id is not null").select(*columns).unionByName(seeking.join(parents, "parent", "left").select(*columns))
