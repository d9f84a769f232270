"""Token counts by a finite-state transducer compiled from a sentencepiece BPE model.

**Compilation.** Greedy merging is local: a sequence of pieces is the encoding of its text exactly if every two neighbours
are the encoding of theirs. So the last piece of a prefix is the one piece that ends there and agrees with the last piece
of the prefix before it, and all that the future needs to know of a prefix is, for every suffix of it that begins some
piece, that suffix, the last piece before it, and how many tokens fewer were emitted there. These descriptions are the
states; they are finite in number, since suffixes are no longer than the longest piece. Each transition carries the
difference in emitted tokens. States are determinized when a text first reaches them.

**Running.** Texts are cut into chunks of equal length, and all chunks of a batch step through the transition table side by
side. The state map of a chunk is constant from its first word start on (a word start forgets the state) and depends on the
entry state before it, so the maps compose in a prefix scan: exits of the constant parts first, then the heads from them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from marketlake.llm.common import per_batch, small_batches, texts_of

SPACE = "▁"
#: Characters of a chunk, and of a batch of chunks.
CHUNK = 256
PORTION = 4_000_000
#: States with a full row in the transition table (the first found are the most frequent); later ones are hashed.
ROWS = 1 << 16
#: States beyond which the transducer is compiled anew (no result depends on it).
STATES = 500_000

_PAD, _SPACE_CLASS, _FIRST_CLASS = 0, 5, 6
State = tuple[tuple[str, str | None, int], ...]
#: Before a word and after characters outside the vocabulary: nothing earlier matters.
HARD: State = (("", None, 0),)


class Transitions:
    """Values of 64-bit keys by open addressing in numpy arrays; a value is -1 where a key is not there."""

    def __init__(self) -> None:
        self.keys, self.values, self.size = np.full(1 << 16, -1, np.int64), np.zeros(1 << 16, np.int32), 0

    def _place(self, key: int) -> int:
        mask = len(self.keys) - 1
        at = (key * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> 40 & mask
        while self.keys[at] >= 0 and self.keys[at] != key:
            at = at + 1 & mask
        return at

    def put(self, key: int, value: int) -> None:
        if 2 * self.size >= len(self.keys):
            used = np.flatnonzero(self.keys >= 0)
            keys, values = self.keys[used].tolist(), self.values[used].tolist()
            self.keys, self.values = np.full(2 * len(self.keys), -1, np.int64), np.zeros(2 * len(self.keys), np.int32)
            for k, v in zip(keys, values, strict=True):
                at = self._place(k)
                self.keys[at], self.values[at] = k, v
        at = self._place(key)
        self.size += self.keys[at] < 0
        self.keys[at], self.values[at] = key, value

    def get(self, keys: np.ndarray) -> np.ndarray:
        mask = np.int64(len(self.keys) - 1)
        at = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) & mask
        out = np.full(len(keys), -1, np.int32)
        rest = np.arange(len(keys))
        while len(rest):
            there = self.keys[at[rest]]
            found = there == keys[rest]
            out[rest[found]] = self.values[at[rest[found]]]
            rest = rest[~found & (there >= 0)]
            at[rest] = at[rest] + 1 & mask
        return out


class Transducer:
    """The transducer of a model file; classes 1 to 4 are unknown characters of so many bytes."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(sentencepiece.SentencePieceProcessor(model_file=path).serialized_model_proto())
        rules, trainer = proto.normalizer_spec, proto.trainer_spec
        kinds = type(proto.pieces[0])
        if (trainer.model_type != trainer.BPE or not trainer.byte_fallback or trainer.treat_whitespace_as_suffix or rules.precompiled_charsmap
                or not rules.add_dummy_prefix or rules.remove_extra_whitespaces or not rules.escape_whitespaces):
            raise ValueError("a BPE model with byte fallback, space prefix and no other normalization is needed")
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in proto.pieces):
            raise ValueError("user-defined and unused pieces are not handled")
        self.scores = {p.piece: p.score for p in proto.pieces if p.type == kinds.NORMAL}
        if any(SPACE in p.lstrip(SPACE) for p in self.scores) or any(c not in self.scores for p in self.scores for c in p):
            raise ValueError("pieces over word starts or of unknown characters are not handled")
        self.prefixes = {p[:k]: p[:k] for p in self.scores for k in range(len(p) + 1)}
        self.class_of = np.zeros(0x110000, np.int32)
        codes = np.arange(0x110000)
        self.class_of[:] = 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)
        for c in self.scores:
            if len(c) == 1:
                self.class_of[ord(c)] = -1  # gets a class when it is first seen
        self.class_of[ord(SPACE)] = self.class_of[ord(" ")] = _SPACE_CLASS
        self.letters = ["", "", "", "", "", SPACE]
        self.clear()

    def clear(self) -> None:
        self.states: list[State] = [HARD]
        self.number = {HARD: 0}
        self.triples: dict[tuple[str, str | None, int], tuple[str, str | None, int]] = {}
        self.agreeing: dict[tuple[str | None, str], bool] = {}
        self.table = np.full((ROWS, -(-len(self.letters) // 32) * 32), -1, np.int32)
        self.later = Transitions()

    # Compilation

    def merged(self, text: str) -> list[str]:
        """Pieces of a short text: the best-scored neighbours merge first, the left ones of equals."""
        parts, score = list(text), self.scores.get
        none = float("-inf")
        pairs = [score(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while pairs and (best := max(pairs)) > none:
            at = pairs.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at:
                pairs[at - 1] = score(parts[at - 1] + parts[at], none)
            if at < len(pairs):
                pairs[at] = score(parts[at] + parts[at + 1], none)
        return parts

    def agree(self, last: str | None, piece: str) -> bool:
        """Whether ``last`` and ``piece`` side by side are the encoding of their text."""
        key = last, piece
        if key not in self.agreeing:
            self.agreeing[key] = self.merged((last or "") + piece) == ([piece] if last is None else [last, piece])
        return self.agreeing[key]

    def step(self, state: State, letter: str) -> tuple[State, int]:
        """The next state and the difference in emitted tokens, for a letter of the vocabulary."""
        longer = [(suffix + letter, last, fewer) for suffix, last, fewer in state]
        piece, count = next((s, fewer + 1) for s, last, fewer in longer if s in self.scores and self.agree(last, s))
        out = [(self.prefixes[s], last, fewer - count) for s, last, fewer in longer if s in self.prefixes]
        out.append(("", piece, 0))
        out = [(s, None if s[:1] == SPACE and last and last[-1] != SPACE else last, fewer) for s, last, fewer in out]
        return tuple(self.triples.setdefault(t, t) for t in out), count

    def _compile(self, number: int, kind: int) -> int:
        if kind == _PAD:
            after, count = number, 0
        elif kind < _SPACE_CLASS:
            after, count = 0, kind
        else:
            found, count = self.step(self.states[number], self.letters[kind])
            after = self.number.setdefault(found, len(self.states))
            if after == len(self.states):
                self.states.append(found)
        value = after << 8 | count + 128
        if number < ROWS:
            self.table[number, kind] = value
        else:
            self.later.put(number << 16 | kind, value)
        return value

    def _values(self, state: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        late = np.flatnonzero(state >= ROWS)
        if not len(late):
            return self.table[state, kinds]
        value = self.table[np.minimum(state, ROWS - 1), kinds]
        value[late] = self.later.get(state[late].astype(np.int64) << 16 | kinds[late])
        return value

    # Running

    def classes(self, codes: np.ndarray) -> np.ndarray:
        out = self.class_of[codes]
        if (out < 0).any():
            for code in np.unique(codes[out < 0]):
                self.class_of[code] = len(self.letters)
                self.letters.append(chr(code))
            more = -(-len(self.letters) // 32) * 32 - self.table.shape[1]
            if more > 0:
                self.table = np.concatenate([self.table, np.full((len(self.table), more), -1, np.int32)], axis=1)
            out = self.class_of[codes]
        return out

    def _lockstep(self, rows: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exit states and counts of chunks (columns of ``rows``) from their entry states."""
        count = np.zeros(len(state), np.int64)
        for kinds in rows:
            value = self._values(state, kinds)
            if (value < 0).any():
                for number, kind in {(int(state[k]), int(kinds[k])) for k in np.flatnonzero(value < 0)}:
                    self._compile(number, kind)
                value = self._values(state, kinds)
            state = value >> 8
            count += (value & 255) - 128
        return state, count

    def _walk(self, kinds: np.ndarray, number: int) -> tuple[int, int]:
        """Exit state and count of one chunk."""
        total = 0
        for kind in kinds.tolist():
            value = int(self.table[number, kind]) if number < ROWS else int(self.later.get(np.array([number << 16 | kind]))[0])
            if value < 0:
                value = self._compile(number, kind)
            number = value >> 8
            total += (value & 255) - 128
        return number, total

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        if len(self.states) > STATES:
            self.clear()
        filled = [k for k, t in enumerate(texts) if t]
        out = np.zeros(len(texts), np.int64)
        if not filled:
            return out
        whole = SPACE + SPACE.join(texts[k] for k in filled)
        codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds = self.classes(codes)
        lengths = np.array([len(texts[k]) + 1 for k in filled])
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        opening = (kinds == _SPACE_CLASS) & (np.concatenate([[0], kinds[:-1]]) != _SPACE_CLASS)
        opening[starts] = True
        chunks = -(-lengths // CHUNK)
        text_of = np.repeat(np.arange(len(filled)), chunks)
        within = np.arange(len(text_of)) - np.repeat(np.concatenate([[0], np.cumsum(chunks)[:-1]]), chunks)
        begin = starts[text_of] + within * CHUNK
        places = begin[None, :] + np.arange(CHUNK)[:, None]
        inside = places < (starts + lengths)[text_of][None, :]
        places = np.minimum(places, len(codes) - 1)
        grid = np.where(inside, kinds[places], _PAD)
        openings = opening[places] & inside
        first = np.where(openings.any(axis=0), openings.argmax(axis=0), CHUNK)
        line = np.arange(CHUNK)[:, None]
        exits, count = self._lockstep(np.where(line >= first, grid, _PAD), np.zeros(len(begin), np.int64))
        heads = np.flatnonzero((first > 0) & (first < CHUNK))
        for k in np.flatnonzero(first == CHUNK):  # in order: such a chunk hands its entry state on, changed
            exits[k], count[k] = self._walk(grid[:, k], int(exits[k - 1]))
        if len(heads):
            deepest = int(first[heads].max())
            head_rows = np.where(line[:deepest] < first[heads], grid[:deepest, heads], _PAD)
            count[heads] += self._lockstep(head_rows, exits[heads - 1].astype(np.int64))[1]
        out[filled] = np.bincount(text_of, count, len(filled)).astype(np.int64)
        return out


_transducers: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    """One per worker and file."""
    if path not in _transducers:
        _transducers[path] = Transducer(path)
    return _transducers[path]


def _portions(texts: list[bytes]):
    part, held = [], 0
    for t in texts:
        if part and held + len(t) > PORTION:
            yield part
            part, held = [], 0
        part.append(t.decode("utf-8", "replace"))
        held += len(t)
    yield part


def count_tokens(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` of every whole text, as the model's library counts its pieces.

    No begin, end or control pieces are added, and their strings inside a text are ordinary text. Null and empty texts have
    0 bytes and 0 tokens. Rows are independent; other columns are ignored; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = texts_of(batch.column("text"))
        counts = np.concatenate([transducer(path).counts(part) for part in _portions(texts)])
        return pa.record_batch({
            "doc_id": batch.column("doc_id"), "n_bytes": pa.array([len(t) for t in texts], pa.int64()), "n_tokens": pa.array(counts),
            "over_limit": pa.array(counts > limit)})

    return docs.select("doc_id", "text").mapInArrow(per_batch(work), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
