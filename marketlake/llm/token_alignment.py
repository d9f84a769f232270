"""Alignment of two tokenizers over the bytes of a text, in Arrow tables.

Both token lists of a portion of texts are flattened with the index of their text; a segmented cumulative sum of token
lengths gives every token the byte where it ends. A full outer hash join of the two sides on (text, end byte) holds one row
for each stretch of bytes between two neighbouring ends: such a stretch lies in exactly one token of either side, so the
rows are the links, and the rows found on both sides are the ends of groups.

How many documents hold a pair of ids is counted with ``Table.group_by`` within a portion, and the partial counts are merged
by Spark. The totals return to a portion by its own distinct pairs, not by the pairs of its documents.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlake.llm.bpe_codec import _byte_letters, _gathered, codec
from marketlake.llm.common import list_column, small_batches, stored

SPACE = "▁"
#: Units, and words of A's splitter, that a worker remembers the ids of; emptied beyond it (no result depends on it).
REMEMBERED = 250_000
#: Characters of a unit that is worth remembering.
LONGEST = 200
#: Bytes of text that are aligned at once.
PORTION = 3 << 20
#: Bits of a text's byte offset in a document-end key.
END_BITS = 40

#: What keeps a text in one unit: spaces at the ends or side by side, and characters with which pieces may differ.
_UNSPLIT = re.compile(rb"  |\A | \Z|\xe2\x96\x81|\x00")


def _letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary, for ``str.translate`` of Latin-1 text."""
    return {b: c for c, b in _byte_letters().items()}


class Units:
    """Ids of both tokenizers for units: the words of a text between single spaces, or a text as a whole.

    A unit is encoded as a text of its own, with a space before it. Both tokenizers start anew at a space that follows another
    character (the splitter of A takes it into the word; no piece of B goes on after it, which is checked), so the ids of a text
    are those of its words one after another, unless spaces stand at its ends or side by side.
    """

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.splitter, self.letters = codec(path_a), _letters()
        self.model_a = Tokenizer.from_file(path_a).model
        self.model_b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        size = self.model_b.get_piece_size()
        pieces = [self.model_b.id_to_piece(i) for i in range(size)]
        self.bytes_a = self.splitter.bytes_of
        self.bytes_b = {i: bytes([int(p[3:5], 16)]) if self.model_b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)}
        special = [self.model_b.is_byte(i) or self.model_b.is_control(i) or self.model_b.is_unknown(i) for i in range(size)]
        self.whole = any(SPACE in p.lstrip(SPACE) for p, s in zip(pieces, special, strict=True) if not s)
        self.known: dict[str, tuple[bytes, bytes]] = {}
        self.parts: dict[str, bytes] = {}

    def _part(self, word: str) -> bytes:
        """Ids of a word of A's splitter."""
        found = self.parts.get(word)
        if found is None:
            if len(self.parts) >= REMEMBERED:
                self.parts.clear()
            plain = word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.letters)
            found = array("I", [t.id for t in self.model_a.tokenize(plain)]).tobytes()
            if len(word) <= LONGEST:
                self.parts[word] = found
        return found

    def encode(self, units: list[str]) -> tuple[list[bytes], list[bytes]]:
        """Little-endian 32-bit ids of every unit on both sides."""
        new = [u for u in units if u not in self.known]
        made = dict(zip(new, zip(
            (b"".join(map(self._part, self.splitter._words(" " + u))) for u in new),
            (array("I", ids).tobytes() for ids in self.model_b.encode(new, num_threads=1)), strict=True), strict=True))
        found = [self.known.get(u) or made[u] for u in units]
        if len(self.known) + len(made) > REMEMBERED:
            self.known.clear()
        self.known.update((u, x) for u, x in made.items() if len(u) <= LONGEST)
        return [f[0] for f in found], [f[1] for f in found]

    def __call__(self, texts: list[bytes]) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """``(flat ids, ids of each text)`` on both sides."""
        strings = pa.array(texts, pa.binary()).cast(pa.string())
        apart = np.array([self.whole or _UNSPLIT.search(t) is not None for t in texts], bool)
        together = strings.filter(pa.array(apart))
        lists = pa.concat_arrays([
            pc.split_pattern(strings.filter(pa.array(~apart)), " "), list_column(together, np.ones(len(together), np.int64), pa.string())])
        lists = lists.take(pa.array(np.argsort(np.concatenate([np.flatnonzero(~apart), np.flatnonzero(apart)]))))
        units = pc.list_flatten(lists).dictionary_encode()
        cuts = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(lists), np.int64))])
        sides = []
        for coded in self.encode(units.dictionary.to_pylist()):
            by_unit = list_column(np.frombuffer(b"".join(coded), "<u4"), [len(c) // 4 for c in coded], pa.uint32())
            found = by_unit.take(units.indices)
            counts = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(found), np.int64))])[cuts]
            sides.append((np.asarray(pc.list_flatten(found)), np.diff(counts)))
        return tuple(sides)


class Side:
    """The bytes of a tokenizer's ids, as Arrow arrays by id."""

    def __init__(self, bytes_of: dict[int, bytes]):
        size = max(bytes_of) + 1
        self.bytes = pa.array([bytes_of.get(i, b"") for i in range(size)], pa.large_binary())
        self.sizes = np.array([len(bytes_of.get(i, b"")) for i in range(size)], np.int64)
        self.names = pa.array([f"{i}{mark}" for i in range(size) for mark in ",|;"], pa.large_string())

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return _data(pc.take(self.bytes, pa.array(ids)))[0]


def _data(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a large string or binary array."""
    if not len(strings):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = strings.buffers()
    offsets = np.frombuffer(offsets, np.int64)[strings.offset : strings.offset + len(strings) + 1]
    return np.frombuffer(data, np.uint8)[: offsets[-1]] if data else np.zeros(0, np.uint8), offsets


_loaded: dict[tuple[str, str], tuple[Units, Side, Side]] = {}


def loaded(path_a: str, path_b: str) -> tuple[Units, Side, Side]:
    """One set per worker and files."""
    if (path_a, path_b) not in _loaded:
        units = Units(path_a, path_b)
        _loaded[path_a, path_b] = units, Side(units.bytes_a), Side(units.bytes_b)
    return _loaded[path_a, path_b]


def _ends(lists: pa.ListArray, sizes: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Flat ids, the list each comes from, and where each ends in its list's bytes."""
    ids = pc.list_flatten(lists)
    parent = np.asarray(pc.list_parent_indices(lists), np.int64)
    running = np.cumsum(sizes[np.asarray(ids)])
    counts = np.asarray(pc.list_value_length(lists), np.int64)
    before = np.concatenate([[0], running])[np.cumsum(counts) - counts]
    return ids, parent, running - before[parent]


def _faithful(side: Side, ids: np.ndarray, counts: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """Which token lists spell their text with a space before it."""
    total = np.concatenate([[0], np.cumsum(side.sizes[ids])])[np.concatenate([[0], np.cumsum(counts)])].tolist()
    spelt = side.joined(ids)
    return np.array([bool(t) and total[k + 1] - total[k] == len(t) + 1 and spelt[total[k]] == 32
                     and spelt[total[k] + 1 : total[k + 1]].tobytes() == t for k, t in enumerate(texts)], bool)


class Aligned:
    """The alignment of a portion of texts; texts that the tokens do not spell have none."""

    def __init__(self, texts: list[bytes], units: Units, a: Side, b: Side):
        (ids_a, self.n_a), (ids_b, self.n_b) = units(texts)
        good = _faithful(a, ids_a, self.n_a, texts) & _faithful(b, ids_b, self.n_b, texts)
        if not good.all():
            ids_a, ids_b = ids_a[np.repeat(good, self.n_a)], ids_b[np.repeat(good, self.n_b)]
            self.n_a, self.n_b = self.n_a * good, self.n_b * good
        lists = [list_column(ids, n, pa.uint32()) for ids, n in ((ids_a, self.n_a), (ids_b, self.n_b))]
        flat_a, text_a, end_a = _ends(lists[0], a.sizes)
        flat_b, text_b, end_b = _ends(lists[1], b.sizes)
        key_a, key_b = (text_a << END_BITS) + end_a, (text_b << END_BITS) + end_b
        left = pa.table({"key": key_a, "a": flat_a})
        right = pa.table({"key": key_b, "b": flat_b})
        links = left.join(right, "key", join_type="full outer", use_threads=False).sort_by("key").combine_chunks()
        self.common = links.filter(pc.and_(links["a"].is_valid(), links["b"].is_valid()))["key"].to_numpy()
        # A stretch lies in the token that ends at or after its own end; both sides end with the text.
        self.key = links["key"].to_numpy()
        of_a, of_b = (pc.fill_null_backward(links[c]).to_numpy().astype(np.int64) for c in ("a", "b"))
        self.pair = (of_a << 32) + of_b
        rows = len(texts)
        self.n_groups = np.bincount(self.common >> END_BITS, minlength=rows)
        self.n_links = np.bincount(self.key >> END_BITS, minlength=rows)
        self.names, self.name_offsets = self._spelled(a, b, np.asarray(flat_a), np.asarray(flat_b), key_a, key_b)

    def _spelled(self, a: Side, b: Side, ids_a: np.ndarray, ids_b: np.ndarray, key_a: np.ndarray, key_b: np.ndarray):
        """The bytes ``a1,a2|b1;a3|b2,b3;`` of all texts on end, and where each text begins."""
        group_a, group_b = np.searchsorted(self.common, key_a), np.searchsorted(self.common, key_b)
        groups = len(self.common)
        in_a, in_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
        place_a = np.arange(len(ids_a)) + (np.cumsum(in_b) - in_b)[group_a]
        place_b = np.arange(len(ids_b)) + np.cumsum(in_a)[group_b]
        last_a, last_b = np.cumsum(in_a) - 1, np.cumsum(in_b) - 1
        mark_a, mark_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
        mark_a[last_a], mark_b[last_b] = 1, 2
        order = np.empty(len(ids_a) + len(ids_b), np.int64)
        order[place_a] = 3 * ids_a.astype(np.int64) + mark_a
        order[place_b] = 3 * ids_b.astype(np.int64) + mark_b
        names = a.names if len(a.names) > len(b.names) else b.names
        data, offsets = _data(pc.take(names, pa.array(order)))
        return data, offsets[np.concatenate([[0], np.cumsum(self.n_a + self.n_b)])]

    def spelled(self, k: int) -> bytes:
        """The groups of text ``k``; empty without tokens."""
        return self.names[self.name_offsets[k] : max(self.name_offsets[k], self.name_offsets[k + 1] - 1)].tobytes()

    def pairs(self) -> tuple[pa.Table, pa.Table]:
        """``(text, pair, times)`` in order of the texts, and ``(pair, texts)``."""
        links = pa.table({"text": self.key >> END_BITS, "pair": self.pair})
        held = links.group_by(["text", "pair"], use_threads=False).aggregate([([], "count_all")])
        held = held.rename_columns(["text", "pair", "times"]).sort_by("text").combine_chunks()
        partial = held.group_by("pair", use_threads=False).aggregate([([], "count_all")])
        return held, partial.rename_columns(["pair", "texts"])


_SCHEMA = """portion long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string,
  refs array<int>, times array<int>, pairs array<long>, texts array<long>"""


def _portions(docs: DataFrame, path_a: str, path_b: str, with_groups: bool) -> DataFrame:
    """Stored: one row a document with its distinct pairs by their number in the portion, one row a portion with its pairs."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, a, b = loaded(path_a, path_b)
        for number, (doc_ids, texts) in enumerate(_gathered(batches, PORTION)):
            found = Aligned(texts, units, a, b)
            held, partial = found.pairs()
            refs = pc.index_in(held["pair"], value_set=partial["pair"].combine_chunks()).combine_chunks()
            spelled = [found.spelled(k) for k in range(len(texts))]
            rows, distinct = len(texts), np.bincount(held["text"].to_numpy(), minlength=len(texts))
            extra = lambda values, kind: pa.concat_arrays([values, pa.nulls(1, kind)])
            numbers = {"n_a": found.n_a, "n_b": found.n_b, "n_groups": found.n_groups, "n_links": found.n_links}
            times = held["times"].combine_chunks().cast(pa.int32())
            yield pa.record_batch({
                "portion": pa.array(np.full(rows + 1, (TaskContext.get().partitionId() << 32) + number)),
                "doc_id": extra(doc_ids, doc_ids.type),
                **{c: extra(pa.array(v, pa.int64()), pa.int64()) for c, v in numbers.items()},
                "groups_sha256": pa.array([hashlib.sha256(s).hexdigest() if s else "" for s in spelled] + [None], pa.string()),
                "groups": pa.array([s.decode() for s in spelled] + [None] if with_groups else [None] * (rows + 1), pa.string()),
                "refs": list_column(refs, [*distinct, 0], pa.int32()), "times": list_column(times, [*distinct, 0], pa.int32()),
                "pairs": list_column(partial["pair"].combine_chunks(), [0] * rows + [len(partial)], pa.int64()),
                "texts": list_column(partial["texts"].combine_chunks(), [0] * rows + [len(partial)], pa.int64())})

    small_batches(docs.sparkSession)
    return stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, _SCHEMA), "aligned")


def _pair_counts(portions: DataFrame) -> DataFrame:
    """``(portion, place, pair, n, best)``: how many documents hold the pairs of each portion, from partial counts, stored."""
    partial = portions.where("n_a is null").select(
        "portion", F.posexplode(F.arrays_zip("pairs", "texts")).alias("place", "x")).select(
        "portion", "place", F.col("x.pairs").alias("pair"), F.col("x.texts").alias("texts"))
    counts = stored(partial.groupBy("pair").agg(F.sum("texts").alias("n")), "pair_counts")
    a_id = F.shiftright("pair", 32)
    most = counts.groupBy(a_id.alias("a")).agg(F.max("n").alias("most"))
    ranked = counts.join(most, a_id == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    return partial.select("portion", "place", "pair").join(ranked, "pair")


def pair_counts(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``(a_id, b_id, documents, best)`` of every linked pair: a map between the vocabularies, learnt from all of ``docs``.

    ``best``: no other pair of the same A id is held by more documents.
    """
    counts = _pair_counts(_portions(docs, path_a, path_b, False)).select("pair", "n", "best").distinct()
    return counts.select(
        F.shiftright("pair", 32).alias("a_id"), F.col("pair").bitwiseAND(0xFFFFFFFF).alias("b_id"), F.col("n").alias("documents"), "best")


def align_documents(docs: DataFrame, path_a: str, path_b: str, with_groups: bool = False) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256[, groups])`` of every whole text.

    A is the byte-level BPE of ``path_a`` over a space and the text, B the sentencepiece BPE of ``path_b`` over the text; no
    special tokens, and their strings are plain text. Bytes where tokens of both sides end cut the tokens into groups; a link
    is an A and a B token that share a byte. A pair of ids counts the documents (rows) that hold it linked; ``n_best`` are the
    links whose count is the highest of their A id, ``count_sum`` sums the counts over links. ``groups`` spells ids in order,
    ``a1,a2|b1;a3|b2,b3``, and ``groups_sha256`` digests it; without tokens both are empty.
    Null and empty texts, and texts that A's or B's tokens do not spell (such as those with U+2581), have no tokens and zeros.
    Rows are told apart by place, so repeated rows and null ids are returned, and counted, as often as they are given. Other
    columns are ignored, an empty table gives no rows. A text of any length is one unit: some 100 bytes of memory a byte of it.
    """
    portions = _portions(docs, path_a, path_b, with_groups)
    valued = _pair_counts(portions).select(F.col("portion").alias("of"), "place", "n", "best")
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, groups string"

    def work(rows: pa.Table, values: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        size = len(values)
        n, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
        place = values["place"].to_numpy()
        n[place], best[place] = values["n"].to_numpy(), values["best"].to_numpy(zero_copy_only=False)
        # Offsets, not cast lengths: a table of many documents may come in several chunks.
        out = []
        for part in rows.to_batches():
            refs, times = (np.asarray(pc.list_flatten(part.column(c)), np.int64) for c in ("refs", "times"))
            cuts = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(part.column("refs")), np.int64))])
            sums = [np.concatenate([[0], np.cumsum(times * v[refs])])[cuts] for v in (best, n)]
            made = {"n_best": np.diff(sums[0]), "count_sum": np.diff(sums[1])}
            out.append(pa.record_batch({f: pa.array(made[f]) if f in made else part.column(f) for f in _names(schema)}))
        return pa.Table.from_batches(out, out[0].schema) if out else _empty(schema)

    found = portions.where("n_a is not null").groupBy("portion").cogroup(valued.groupBy("of")).applyInArrow(work, schema)
    return found if with_groups else found.drop("groups")


def _names(schema: str) -> list[str]:
    return [field.split()[0] for field in schema.split(", ")]


def _empty(schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "string": pa.string()}
    return pa.table({name: pa.array([], kinds[kind]) for name, kind in (field.split() for field in schema.split(", "))})
