"""Byte-level BPE encoding and decoding over a pair occurrence index.

The distinct words of a batch are laid out one after another. An index maps the rank of every adjacent pair to all places
where it stands in the whole batch; ranks are taken in ascending order, all places of a rank are merged from left to right,
and the lists of the two neighbouring pairs of each merge are updated. A merge can only give rise to pairs of higher rank
(checked when the vocabulary is read), so one ascending pass over the active ranks encodes every word exactly.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from marketlake.llm.common import list_column, per_batch, small_batches, texts_of

#: Words a worker remembers the ids of; emptied beyond it (no result depends on it).
REMEMBERED = 400_000
#: Bytes of text whose new words share one occurrence index.
BATCH_TEXT = 8 << 20

#: Fixed value: the published word splitter of byte-level vocabularies.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


#: Bytes that begin letters from U+0540 on; below, all versions of Unicode agree on letters and numbers.
_LATE = re.compile(rb"[\xd5-\xff]")


def _unsettled() -> re.Pattern[str]:
    """Code points that this Python does not know: libraries of other Unicode versions may split them otherwise."""
    codes = [c for c in range(0x540, sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Cn"]
    starts = [c for k, c in enumerate(codes) if k == 0 or codes[k - 1] != c - 1]
    ends = [c for k, c in enumerate(codes) if k + 1 == len(codes) or codes[k + 1] != c + 1]
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts, ends, strict=True)) + "]")


def _byte_letters() -> dict[str, int]:
    """Letters that stand for bytes in the vocabulary: printable ones for themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteBpe:
    """A vocabulary file of ``tokenizers`` (byte-level BPE without normalizer), read without that library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        splitter = spec["pre_tokenizer"]
        if spec["normalizer"] or splitter["type"] != "ByteLevel" or splitter["add_prefix_space"] or not splitter["use_regex"]:
            raise ValueError("a byte-level vocabulary without normalizer and prefix space is needed")
        letters = _byte_letters()
        vocabulary = spec["model"]["vocab"]
        self.bytes_of = {i: bytes(letters[c] for c in token) for token, i in vocabulary.items()}
        byte_id = [vocabulary[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        self.span = max(vocabulary.values()) + 1
        self.byte_ids = np.array(byte_id, np.int64)
        keys: list[int] = []
        self.parts_of: list[tuple[int, int, int]] = []
        made: dict[int, int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            left, right, new = vocabulary[a], vocabulary[b], vocabulary[a + b]
            if max(made.get(left, -1), made.get(right, -1)) >= rank:
                raise ValueError("a merge stands before the merge that makes its part")
            made.setdefault(new, rank)
            keys.append(left * self.span + right)
            self.parts_of.append((left, right, new))
        self.pair_ranks = np.argsort(np.array(keys, np.int64), kind="stable")
        self.pair_keys = np.array(keys, np.int64)[self.pair_ranks]
        specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that take in their surroundings are not handled")
        self.specials = specials
        self.bytes_of |= {i: s.encode() for s, i in specials.items()}
        self.words = regex.compile(WORDS)
        self.path, self.unsettled, self.library = path, _unsettled(), None
        self.parts = regex.compile("(" + "|".join(map(regex.escape, sorted(specials, key=len, reverse=True))) + ")") if specials else None
        self.known: dict[str, tuple[str, bytes]] = {}

    def _words(self, text: str) -> list[str]:
        """Words of a text without special strings; the library splits where code points are too new to be sure."""
        if text.isascii() or not _LATE.search(text.encode("utf-8", "replace")) or not self.unsettled.search(text):
            return self.words.findall(text)
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path).pre_tokenizer
        return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]

    def split(self, text: str) -> list[str]:
        """Words and special strings of a text, in order."""
        if self.parts is None or not any(s in text for s in self.specials):
            return self._words(text)
        out: list[str] = []
        for part in self.parts.split(text):
            out += [part] if part in self.specials else self._words(part)
        return out

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; -1 for pairs that never merge."""
        keys = left.astype(np.int64) * self.span + right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], -1)

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of each word, by one pass over the active ranks of all words."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        sizes = np.array([len(r) for r in raw], np.int64)
        symbol = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        size = len(symbol)
        ends = np.cumsum(sizes)
        after, before = np.arange(1, size + 1), np.arange(-1, size - 1)
        filled = sizes > 0
        after[ends[filled] - 1], before[(ends - sizes)[filled]] = -1, -1
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def enter(places: np.ndarray, ranks: np.ndarray) -> None:
            places, ranks = places[ranks >= 0], ranks[ranks >= 0]
            if not len(ranks):
                return
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            starts = [0, *cuts.tolist(), len(ranks)]
            for a, b in zip(starts, starts[1:], strict=False):
                rank = int(ranks[a])
                if rank in index:
                    index[rank].append(places[a:b])
                else:
                    index[rank] = [places[a:b]]
                    heapq.heappush(active, rank)

        places = np.flatnonzero(after >= 0)
        enter(places, self._ranks(symbol[places], symbol[after[places]]))
        while active:
            rank = heapq.heappop(active)
            lists = index.pop(rank)
            places = np.unique(np.concatenate(lists)) if len(lists) > 1 else lists[0]
            left, right, new = self.parts_of[rank]
            second = after[places]
            good = (symbol[places] == left) & (second >= 0) & (symbol[second] == right)
            places, second = places[good], second[good]
            if left == right and len(places) > 1:  # of overlapping places the left one merges
                chained = np.concatenate([[False], second[:-1] == places[1:]])
                runs = np.maximum.accumulate(np.where(chained, 0, np.arange(len(places))))
                odd = (np.arange(len(places)) - runs) % 2 == 1
                places, second = places[~odd], second[~odd]
            if not len(places):
                continue
            symbol[places], symbol[second] = new, -1
            third = after[second]
            after[places] = third
            inner = third >= 0
            before[third[inner]] = places[inner]
            first = before[places]
            outer = first >= 0
            enter(
                np.concatenate([places[inner], first[outer]]),
                self._ranks(
                    np.concatenate([np.full(inner.sum(), new), symbol[first[outer]]]),
                    np.concatenate([symbol[third[inner]], np.full(outer.sum(), new)])))
        alive = symbol >= 0
        ids = symbol[alive].tolist()
        counts = np.concatenate([[0], np.cumsum(alive)])[np.concatenate([[0], ends])].tolist()
        return [ids[a:b] for a, b in zip(counts, counts[1:], strict=False)]

    def learn(self, texts_words: list[list[str]]) -> None:
        """Encode the words of the batch that are not remembered yet."""
        new = set().union(*texts_words).difference(self.known)
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = set().union(*texts_words)
        words = [w for w in new if w not in self.specials]
        for word, ids in zip(words, self.encode_words(words), strict=True):
            self.known[word] = (",".join(map(str, ids)), self.decode(ids))
        for word in new.intersection(self.specials):
            self.known[word] = (str(self.specials[word]), self.decode([self.specials[word]]))

    def decode(self, ids: list[int]) -> bytes:
        """The bytes that ids stand for; ids outside the vocabulary stand for none, as in the library."""
        return b"".join(self.bytes_of.get(i, b"") for i in ids)

    def text(self, ids: list[int]) -> str:
        """The decoded text; bytes that are no UTF-8 become replacement characters."""
        return self.decode(ids).decode("utf-8", "replace")


_codecs: dict[str, ByteBpe] = {}


def codec(path: str) -> ByteBpe:
    """One per worker and file."""
    if path not in _codecs:
        _codecs[path] = ByteBpe(path)
    return _codecs[path]


def _gathered(batches: Iterator[pa.RecordBatch], size: int = BATCH_TEXT) -> Iterator[tuple[pa.Array, list[bytes]]]:
    """Ids and texts of about ``size`` bytes at a time."""
    ids: list = []
    texts: list[bytes] = []
    held = 0
    for batch in batches:
        for i, t in zip(batch.column("doc_id").to_pylist(), texts_of(batch.column("text")), strict=True):
            if texts and held + len(t) > size:
                yield pa.array(ids, batch.column("doc_id").type), texts
                ids, texts, held = [], [], 0
            ids.append(i)
            texts.append(t)
            held += len(t)
        kind = batch.column("doc_id").type
    if texts:
        yield pa.array(ids, kind), texts


def encode_documents(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids, decoded])`` of every whole text.

    Ids are those of the ``tokenizers`` library without added special tokens; special strings inside a text become their
    own id. ``ids_sha256`` is over the decimal ids joined by commas, ``decoded_sha256`` over the text decoded from the ids.
    A null text is empty: no ids, digests of the empty string. Rows are independent; other columns are ignored.
    """
    small_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, texts in _gathered(batches):
            bpe = codec(path)
            count, ids_digest, text_digest, all_ids, all_texts = [], [], [], [], []
            words = [bpe.split(t.decode("utf-8", "replace")) for t in texts]
            bpe.learn(words)
            for w in words:
                known = list(map(bpe.known.__getitem__, w))
                ids = ",".join([k[0] for k in known])
                decoded = b"".join([k[1] for k in known]).decode("utf-8", "replace")
                count.append(ids.count(",") + 1 if ids else 0)
                ids_digest.append(hashlib.sha256(ids.encode()).hexdigest())
                text_digest.append(hashlib.sha256(decoded.encode()).hexdigest())
                if with_ids:
                    all_ids += map(int, ids.split(",")) if ids else ()
                    all_texts.append(decoded)
            out = {
                "doc_id": doc_ids, "n_tokens": pa.array(count, pa.int64()), "ids_sha256": pa.array(ids_digest, pa.string()),
                "decoded_sha256": pa.array(text_digest, pa.string())}
            if with_ids:
                out |= {"ids": list_column(all_ids, count, pa.int32()), "decoded": pa.array(all_texts, pa.string())}
            yield pa.record_batch(out)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids
    return docs.select("doc_id", "text").mapInArrow(work, schema)


def decode_documents(coded: DataFrame, path: str) -> DataFrame:
    """``(doc_id, text)`` from ``(doc_id, ids)``; null ids give a null text."""
    small_batches(coded.sparkSession)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = codec(path)
        return pa.record_batch({
            "doc_id": batch.column("doc_id"),
            "text": pa.array([None if i is None else bpe.text(i) for i in batch.column("ids").to_pylist()], pa.string())})

    return coded.select("doc_id", "ids").mapInArrow(per_batch(work), "doc_id long, text string")
