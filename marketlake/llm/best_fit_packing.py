"""Best-fit packing of tokenized documents by exact complements of lengths.

The plan needs only how many pieces have each length (at most ``limit`` numbers, whatever the corpus). It takes the longest
length left, looks up a single length, a pair or a triple that fills the gap exactly among the lengths still available, and
takes the best fit (the longest length that goes in) when there is none. A pattern found is used as often as the counts
allow, so the number of patterns follows the number of lengths, not of documents. Pieces are then numbered within their
length and find their sequence and offset by that number.
"""

from __future__ import annotations

import json
import os
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlake.llm.bpe_codec import _byte_letters
from marketlake.llm.common import list_column, per_batch, portions, small_batches, stored, texts_of

#: Parts of texts that a worker remembers the ids of; emptied beyond it (no result depends on it).
REMEMBERED = 350_000
#: Bytes of text whose parts are laid out at once.
PORTION = 4 << 20
#: Strings encoded in one call, and what stands between them: a character that white space around makes a token by itself.
WORDS_A_CALL = 2000
MARK = "\x01"
#: Pieces that one numbering task gets at most, about.
ROWS_PER_TASK = 100_000


#: Fixed value: the published splitter of the vocabularies that are read here.
SPLITTER = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: What the splitter takes a byte for; strings between white space that hold an odd byte are left to the library as they are.
_LETTER, _DIGIT, _OTHER, _SPACE, _ODD = range(5)
_KINDS = np.full(256, _ODD, np.uint8)
_KINDS[33:127] = _OTHER
_KINDS[[c for c in range(128) if chr(c).isalpha()]] = _LETTER
_KINDS[[c for c in range(128) if chr(c).isdigit()]] = _DIGIT
_KINDS[list(b" \t\n\r\v\f")] = _SPACE
_KINDS[ord("'")] = _ODD  # may begin an ending of the splitter's
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
#: The first byte of the letters from U+00C0 to U+00FF, and the second ones there that are no letter, or a small one below the others.
_LATIN, _TIMES, _DIVIDED, _SHARP_S = 0xC3, 0x97, 0xB7, 0x9F


def _checked(path: str) -> None:
    """Raise unless the file lower-cases, splits on white space and by ``SPLITTER``, and keeps bytes apart from words."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    steps = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", ())]
    split = (spec["pre_tokenizer"] or {}).get("pretokenizers", ())
    if (steps != ["NFC", "Replace", "Lowercase"] or [s["type"] for s in split] != ["Split", "ByteLevel"] or split[0]["pattern"] != {"Regex": SPLITTER}
            or split[1]["add_prefix_space"] or spec["model"]["type"] != "BPE" or any(t["lstrip"] or t["rstrip"] for t in spec["added_tokens"])):
        raise ValueError("a lower-casing BPE vocabulary that splits on white space is needed")


def _latin(raw: np.ndarray, kinds: np.ndarray, low: np.ndarray) -> None:
    """Enter the letters from U+00C0 to U+00FF, which stay one letter in every step, into the kinds and small letters of ``raw``."""
    at = np.flatnonzero(raw[:-1] == _LATIN)
    second = raw[at + 1]
    letters = (second & 0xC0 == 0x80) & (second != _TIMES) & (second != _DIVIDED)
    at, second = at[letters], second[letters]
    kinds[at] = kinds[at + 1] = _LETTER
    low[at + 1] = np.where(second == _SHARP_S, second, second | 0x20)


def _parts(texts: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Small-lettered parts of all texts as the splitter makes them, which of them are strings for the whole library, and the parts before each text."""
    raw = np.frombuffer(b" ".join([b"", *texts, b""]), np.uint8)
    kinds, low = _KINDS[raw], _LOWER[raw]
    _latin(raw, kinds, low)
    space = kinds == _SPACE
    odd = kinds == _ODD
    odd[:-1] |= (raw[:-1] == ord("<")) & (raw[1:] == ord("|"))  # may begin a special string
    if odd.any():
        turns = np.flatnonzero(space[1:] != space[:-1]) + 1
        held = np.zeros(len(turns) + 1, bool)
        held[1::2] = np.logical_or.reduceat(odd, turns[::2])
        odd = np.repeat(held, np.diff(turns, prepend=0, append=len(raw)))
        kinds[odd] = _ODD
        low = np.where(odd, raw, low)
    begins = kinds == _DIGIT
    begins[1:] |= kinds[1:] != kinds[:-1]
    begins &= ~space
    begins[0] = False
    firsts = np.flatnonzero(begins)
    solid = ~space
    data = low[solid]
    offsets = np.append(np.flatnonzero(begins[solid]), len(data)).astype(np.int32)
    parts = pa.Array.from_buffers(pa.binary(), len(firsts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    starts = np.cumsum([1, *(len(t) + 1 for t in texts)])
    return parts, kinds[firsts] == _ODD, np.searchsorted(firsts, starts)


class ChunkIds:
    """Ids of whole texts by a ``tokenizers`` file that lower-cases and never joins what white space separates."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        _checked(path)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = WhitespaceSplit()
        self.letters = {b: c for c, b in _byte_letters().items()} | {ord("\n"): "\n"}
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)
        suffix = self.tokenizer.model.end_of_word_suffix
        self.last[[k for t, k in self.tokenizer.get_vocab(with_added_tokens=False).items() if suffix and t.endswith(suffix)]] = True
        self.mark = self._ids(MARK)
        self._forget()

    def _forget(self) -> None:
        """Known strings, where in ``ids`` those of each begin, and how many they are."""
        self.known = pa.array([], pa.binary())
        self.starts, self.sizes, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _parts(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number of letters, digits or other characters, which the model takes as they are, by tokens that end a word."""
        spelled = b"\n".join(parts).decode("latin-1").translate(self.letters)
        ids = np.array(self.model.encode_batch_fast([spelled], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) == len(parts):
            return ids, np.diff(ends, prepend=0)
        coded = [np.array(c.ids, "<u4") for c in self.model.encode_batch_fast(spelled.split("\n"), add_special_tokens=False)]
        return np.concatenate(coded), np.array([len(c) for c in coded])

    def _words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number of whole strings, by a mark of one id between them."""
        texts = [w.decode("utf-8", "replace") for w in words]
        ids = self._ids(f" {MARK} ".join(texts))
        cuts = np.flatnonzero(ids == self.mark[0])
        if len(self.mark) == 1 and len(cuts) == len(words) - 1:
            return np.delete(ids, cuts), np.diff(cuts, prepend=-1, append=len(ids)) - 1
        coded = [self._ids(t) for t in texts]  # the mark stands in a word
        return np.concatenate(coded), np.array([len(c) for c in coded])

    def _learn(self, fresh: pa.Array, odd: np.ndarray) -> np.ndarray:
        """Encode many strings that are not known, the ``odd`` ones by the whole library; their places among the known ones."""
        known, sizes, ids = [self.known], [self.sizes], [self.ids]
        places, count = np.zeros(len(fresh), np.int64), len(self.known)
        for encode, ours in ((self._parts, np.flatnonzero(~odd)), (self._words, np.flatnonzero(odd))):
            places[ours] = np.arange(count, count + len(ours))
            count += len(ours)
            chosen = fresh.take(pa.array(ours))
            words = chosen.to_pylist()
            for k in range(0, len(words), WORDS_A_CALL):
                for held, new in zip((ids, sizes), encode(words[k : k + WORDS_A_CALL]), strict=True):
                    held.append(new)
            known.append(chosen)
        self.known, self.sizes, self.ids = pa.concat_arrays(known), np.concatenate(sizes), np.concatenate(ids)
        self.starts = np.cumsum(self.sizes) - self.sizes
        return places

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        return [ids for _, part in portions(texts, PORTION) for ids in self._portion(part)]

    def _portion(self, texts: list[bytes]) -> list[bytes]:
        parts, odd, before = _parts(texts)
        at = np.array(pc.index_in(parts, value_set=self.known).fill_null(-1))
        missing = np.flatnonzero(at < 0)
        fresh = parts.take(pa.array(missing)).dictionary_encode()
        if len(self.known) + len(fresh.dictionary) > REMEMBERED:
            self._forget()
            missing, fresh = np.arange(len(parts)), parts.dictionary_encode()
        if len(missing):
            codes = np.array(fresh.indices)
            left = np.zeros(len(fresh.dictionary), bool)
            left[codes[odd[missing]]] = True
            at[missing] = self._learn(fresh.dictionary, left)[codes]
        starts, sizes = self.starts[at], self.sizes[at]
        ends = np.append(0, np.cumsum(sizes))
        ids = self.ids[np.repeat(starts - ends[:-1], sizes) + np.arange(ends[-1])].tobytes()
        cuts = (4 * ends[before]).tolist()
        return [ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


_encoders: dict[str, ChunkIds] = {}


def chunk_ids(path: str) -> ChunkIds:
    """One per worker and file."""
    if path not in _encoders:
        _encoders[path] = ChunkIds(path)
    return _encoders[path]


def tokenized_pieces(docs: DataFrame, path: str, limit: int = 4096, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32[, ids])`` of every text followed by ``end_id``, cut only beyond ``limit``."""
    small_batches(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        at, piece, size, crc, parts = [], [], [], [], []
        for k, ids in enumerate(chunk_ids(path)(texts_of(batch.column("text")))):
            ids += end
            for p, i in enumerate(range(0, len(ids), 4 * limit)):
                part = ids[i : i + 4 * limit]
                at.append(k)
                piece.append(p)
                size.append(len(part) // 4)
                crc.append(zlib.crc32(part))
                parts.append(part)
        pieces = np.array(piece, np.int32)
        out = {
            "doc_id": batch.column("doc_id").take(pa.array(at, pa.int64())), "piece": pa.array(pieces),
            "start": pa.array(pieces.astype(np.int64) * limit), "length": pa.array(size, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}
        if with_ids:
            out["ids"] = list_column(np.frombuffer(b"".join(parts), "<u4").astype(np.int32), size, pa.int32())
        return pa.record_batch(out)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select("doc_id", "text").mapInArrow(per_batch(work), schema)


def _pair(gap: int, left: np.ndarray) -> list[int]:
    """Two available lengths of that sum, the longer one as long as can be."""
    long = np.arange(gap - 1, (gap + 1) // 2 - 1, -1)
    if not len(long):
        return []
    short = gap - long
    fits = np.flatnonzero((left[long] > 0) & (left[short] > (long == short)))
    return [int(long[fits[0]]), int(short[fits[0]])] if len(fits) else []


def exact_complement(gap: int, left: np.ndarray) -> list[int]:
    """One, two or three available lengths that fill the gap; empty if there are none."""
    if left[gap]:
        return [gap]
    if two := _pair(gap, left):
        return two
    for long in np.flatnonzero(left[: gap - 1])[::-1]:
        if 3 * long < gap:
            break
        left[long] -= 1
        two = _pair(gap - int(long), left)
        left[long] += 1
        if two:
            return [int(long), *two]
    return []


def plan(counts: np.ndarray, limit: int) -> list[tuple[dict[int, int], int]]:
    """Patterns ``({length: how often in a sequence}, sequences)`` that use up ``counts`` (by length, from 0 to ``limit``)."""
    counts, patterns = counts.copy(), []
    while len(lengths := np.flatnonzero(counts)):
        left, longest = counts.copy(), int(lengths[-1])
        left[longest] -= 1
        slots, gap = [longest], limit - longest
        while gap:
            if found := exact_complement(gap, left):
                slots += found
                break
            fitting = np.flatnonzero(left[: gap + 1])
            if not len(fitting):
                break
            best = int(fitting[-1])
            slots.append(best)
            left[best] -= 1
            gap -= best
        pattern = dict(sorted(Counter(slots).items(), reverse=True))
        often = min(int(counts[n]) // k for n, k in pattern.items())
        for n, k in pattern.items():
            counts[n] -= often * k
        patterns.append((pattern, often))
    return patterns


def _places(patterns: list[tuple[dict[int, int], int]]) -> dict[str, np.ndarray]:
    """Runs of piece numbers of a length that go to one place of a pattern, sorted by length and number."""
    rows, used, sequence = [], Counter(), 0
    for pattern, often in patterns:
        offset = 0
        for n, k in pattern.items():
            rows.append((n, used[n], sequence, often, offset))
            used[n] += often * k
            offset += n * k
        sequence += often
    rows = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "first", "sequence", "often", "offset"), rows.T, strict=True))


def pack(docs: DataFrame, path: str, limit: int = 4096, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """The pieces of all documents with ``sequence_id`` and ``offset``: gapless sequences of at most ``limit`` tokens.

    Null and empty texts are the end id alone. Repeated rows are packed as often as they are given, and a null doc_id stays
    null. Other columns are ignored; an empty table gives no rows. ``with_ids`` adds the piece's ids. The driver sees one
    count a length; workers get at most one run a length and pattern.
    """
    spark = docs.sparkSession
    pieces = stored(tokenized_pieces(docs, path, limit, end_id, with_ids), "pieces")
    rows = pieces.count()
    tasks = max(1, -(-rows // ROWS_PER_TASK))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(tasks)).cast("int"))
    counts = stored(salted.groupBy("length", "salt").agg(F.count("*").alias("n")), "counts")
    histogram = np.zeros(limit + 1, np.int64)
    for length, n in counts.groupBy("length").agg(F.sum("n")).collect():
        histogram[length] = n
    places = spark.sparkContext.broadcast(_places(plan(histogram, limit)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("rank", F.row_number().over(within) - 1).join(firsts, ["length", "salt"])
    names = pieces.columns
    ranked = ranked.select(*names, (F.col("rank") + F.col("first")).alias("rank"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        p = places.value
        length, rank = (np.array(batch.column(c)).astype(np.int64) for c in ("length", "rank"))
        run = np.searchsorted((p["length"] << 40) + p["first"], (length << 40) + rank, side="right") - 1
        place, copy = np.divmod(rank - p["first"][run], p["often"][run])
        return pa.record_batch({
            **{c: batch.column(c) for c in names}, "sequence_id": pa.array(p["sequence"][run] + copy),
            "offset": pa.array(p["offset"][run] + place * length)})

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.mapInArrow(per_batch(work), f"{schema}, sequence_id long, offset long")
