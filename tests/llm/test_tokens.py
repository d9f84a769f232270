"""Tokenizers, token counts and packing against the libraries."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest

from marketlake.llm import best_fit_packing, bpe_codec, token_counts
from marketlake.llm.queries import vocabulary

ODD = ["", None, " ", "a", "<|endoftext|>", "x<|endoftext|><|endoftext|> y", "<|ENDOFTEXT|> Don't.", "aaaaaaaaaaaaaaaaaaaaaaaaa " * 3,
       "   a  \n\n b\t ", "é" * 50, "日本語のテキスト、です。", "😀😀 ok", "\x01 a \x01", "it's we'll I'd", "x" * 5000, "ab" * 3000, " " * 3000, "<s> </s> <0x0A>",
       "՘a ౜b", "á ́b", "\x85x y\x1cz", "1234 5678", "%%% a.%%% ,. x.", "<|startoftext|>"]


def random_texts(n=300, seed=2):
    r = random.Random(seed)
    pool = [chr(c) for c in [*range(32, 127), 9, 10, 13, 0xE9, 0xDF, 0x4E00, 0x301, 0x2581, 0x430]]
    parts = ["the", "ing", "er", " ", " ", "\n", "tion", "a", "e", "'s", ".", "▁", "ß"]
    return ["".join(r.choice(pool if k % 2 else parts) for _ in range(r.randint(0, 200))) for k in range(n)]


@pytest.fixture(scope="module")
def texts(spark, folder):
    docs = [r[0] for r in spark.read.parquet(f"{folder}/documents.parquet").select("text").limit(100).collect()]
    return ODD + random_texts() + docs


@pytest.fixture(scope="module")
def table(spark, texts):
    rows = [(k, t, "x", 1) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, piece int").repartition(3)


def test_codec_equals_the_library(spark, table, texts):
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    coded = bpe_codec.encode_documents(table, path, with_ids=True)
    got = {r["doc_id"]: r for r in coded.collect()}
    for k, text in enumerate(texts):
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert got[k]["ids"] == ids and got[k]["n_tokens"] == len(ids) and got[k]["decoded"] == decoded == (text or "")
        assert got[k]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[k]["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()
    back = {r["doc_id"]: r["text"] for r in bpe_codec.decode_documents(coded, path).collect()}
    assert back == {k: t or "" for k, t in enumerate(texts)}
    assert bpe_codec.encode_documents(table.limit(0), path).collect() == []


def test_codec_splits_every_letter_as_the_library():
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    splitter, own = Tokenizer.from_file(path).pre_tokenizer, bpe_codec.codec(path)
    for c in [*range(0x3000), *range(0x3000, 0x110000, 211)]:
        if not 0xD800 <= c <= 0xDFFF:
            s = f"a{chr(c)}b1{chr(c)} {chr(c)}"
            assert own.split(s) == [s[a:b] for _, (a, b) in splitter.pre_tokenize_str(s)], hex(c)


def test_counts_equal_the_library(spark, table, texts):
    import sentencepiece

    path = vocabulary("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    got = {r["doc_id"]: tuple(r)[1:] for r in token_counts.count_tokens(table, path, limit=100).collect()}
    for k, text in enumerate(texts):
        n = len(library.encode(text or ""))
        assert got[k] == (len((text or "").encode()), n, n > 100), repr(text)[:80]
    assert token_counts.count_tokens(table.limit(0), path).collect() == []


def test_counts_do_not_depend_on_the_memory(monkeypatch):
    path = vocabulary("piece_bpe_32k.model")
    texts = random_texts(60, 9) + ["x" * 2000, "的" * 700]
    want = token_counts.Transducer(path).counts(texts).tolist()
    monkeypatch.setattr(token_counts, "ROWS", 64)
    monkeypatch.setattr(token_counts, "STATES", 100)
    small = token_counts.Transducer(path)
    assert small.counts(texts).tolist() == want == [int(small.counts([t])[0]) for t in texts]


def test_packing_equals_the_library_and_fills_sequences(spark, table, texts):
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = best_fit_packing.pack(table, path, limit=256).collect()
    pieces = {(r["doc_id"], r["piece"]): r for r in rows}
    assert len(pieces) == len(rows)
    n = 0
    for k, text in enumerate(texts):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        for p in range(0, len(ids), 256):
            r, part = pieces[k, p // 256], ids[p : p + 256]
            assert (r["start"], r["length"], r["ids_crc32"]) == (p, len(part), zlib.crc32(np.array(part, "<u4").tobytes())), repr(text)[:80]
            n += 1
    assert n == len(rows)
    ends = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 256
    assert len(ends) <= -(-sum(r["length"] for r in rows) // 256) + 1
    assert best_fit_packing.pack(table.limit(0), path).collect() == []


def test_pack_repeated_rows_and_ids(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b"), (2, None)], "doc_id long, text string")
    rows = best_fit_packing.pack(df, vocabulary("word_bpe_49k.json"), with_ids=True).collect()
    assert sorted([(r["doc_id"], r["length"]) for r in rows], key=repr) == [(1, 3), (1, 3), (2, 1), (None, 3)]
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == 4 and all(r["ids"][-1] == 1 for r in rows)


def test_words_are_encoded_once_and_only_odd_ones_by_the_whole_library(monkeypatch):
    """All letters from U+00C0 to U+00FF go to the model alone, a string of any text at most once."""
    encoder = best_fit_packing.ChunkIds(vocabulary("word_bpe_49k.json"))
    asked = {"_parts": [], "_words": []}
    for name, words in asked.items():
        real = getattr(encoder, name)
        monkeypatch.setattr(encoder, name, lambda some, real=real, words=words: (words.extend(some), real(some))[1])
    letters = "".join(chr(c) for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7))
    texts = [f"Déjà vu, ÉCOLE école 12. {letters} a×b don't", "déjà VU 2×3 école. don't"]
    got = encoder([t.encode() for t in texts] + [b""])
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in [*texts, ""]]
    assert sorted(asked["_words"]) == sorted(w.encode() for w in ("a×b", "2×3", "don't"))
    assert sorted(asked["_parts"]) == sorted(w.encode() for w in ("déjà", "vu", ",", "école", "1", "2", ".", letters.lower()))


def test_encoded_texts_do_not_depend_on_the_memory(monkeypatch):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    spelled = [chr(c) + end for c in [*range(0x20, 0x250), 0x301, 0x2019, 0x4E00] for end in ("a", "'S b", "\u0301c", "<|endoftext|>D", ".", "9é ")]
    texts = [t or "" for t in ODD] + random_texts(80, 5) + [" ".join(spelled[k : k + 9]) for k in range(0, len(spelled), 9)] + spelled[::7]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    for remembered, portion, call in ((350_000, 4 << 20, 2000), (60, 500, 3), (1, 1, 1)):
        monkeypatch.setattr(best_fit_packing, "REMEMBERED", remembered)
        monkeypatch.setattr(best_fit_packing, "PORTION", portion)
        monkeypatch.setattr(best_fit_packing, "WORDS_A_CALL", call)
        encoder = best_fit_packing.ChunkIds(vocabulary("word_bpe_49k.json"))
        got = [np.frombuffer(g, "<u4").tolist() for g in encoder([t.encode() for t in texts])]
        assert [t for t, g, w in zip(texts, got, want, strict=True) if g != w] == []
    encoder.last[:] = False  # a vocabulary without a suffix
    assert [np.frombuffer(g, "<u4").tolist() for g in encoder([t.encode() for t in texts[:40]])] == want[:40]
    # bytes that are no UTF-8: as the library reads them with replacement characters
    broken = [b"\xc3", b"a\xc3 b", b"\xc3\xc3\xa9 c", b"\xe9\xa9x \xa9", b"\xc3A \xf0\xc3\xa9"]
    assert [np.frombuffer(g, "<u4").tolist() for g in encoder(broken)] == [
        library.encode(b.decode("utf-8", "replace"), add_special_tokens=False).ids for b in broken]


def fewest(counts, limit):
    """Fewest sequences by search, for a handful of pieces."""
    pieces = sorted((n for n, k in enumerate(counts) for _ in range(k)), reverse=True)

    def fits(k, room, bins):
        if k == len(pieces):
            return True
        tried = set()
        for b in range(bins):
            if room[b] >= pieces[k] and room[b] not in tried:
                tried.add(room[b])
                room[b] -= pieces[k]
                if fits(k + 1, room, bins):
                    return True
                room[b] += pieces[k]
        return False

    bins = -(-sum(pieces) // limit)
    while not fits(0, [limit] * bins, bins):
        bins += 1
    return bins


def test_plan_uses_all_pieces_and_few_sequences():
    r = random.Random(4)
    for _ in range(40):
        counts = np.bincount([r.randint(1, 20) for _ in range(12)], minlength=21)
        plan = best_fit_packing.plan(counts, 20)
        used = np.zeros(21, int)
        for pattern, often in plan:
            assert sum(n * k for n, k in pattern.items()) <= 20
            for n, k in pattern.items():
                used[n] += k * often
        assert (used == counts).all()
        assert sum(often for _, often in plan) <= fewest(counts.tolist(), 20) + 1
    left = np.zeros(21, int)
    left[[2, 5, 9]] = 1
    assert best_fit_packing.exact_complement(9, left) == [9] and best_fit_packing.exact_complement(7, left) == [5, 2]
    assert best_fit_packing.exact_complement(16, left) == [9, 5, 2] and best_fit_packing.exact_complement(4, left) == []
