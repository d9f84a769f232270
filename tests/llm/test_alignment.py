"""Cross-tokenizer alignment against the libraries and plain loops."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import pytest

from marketlake.llm import token_alignment
from marketlake.llm.queries import vocabulary
from tests.llm.test_tokens import ODD, random_texts

LINES = ["\n", "\n\na", " \n \n", "a\n", "  ", "   x  ", "\n ", "a \n", "same text", "same text", None, "\0 a", "a▁b", "��"]


def byte_letters():
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    return letters | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}


def tokens_of(text, a, b, letters):
    """(id, bytes) of the tokens of both sides; none where they do not spell the text."""
    if not text:
        return [], []
    coded = a.encode(" " + text, add_special_tokens=False)
    left = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in coded.ids]
    right = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
    whole = b" " + text.encode()
    return (left, right) if b"".join(x for _, x in left) == b"".join(x for _, x in right) == whole else ([], [])


def ranges(tokens):
    at, out = 0, []
    for i, x in tokens:
        out.append((i, at, at + len(x)))
        at += len(x)
    return out


def brute_force(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    letters, rows, links_of = byte_letters(), [], []
    held = defaultdict(set)
    for k, text in enumerate(texts):
        left, right = (ranges(t) for t in tokens_of(text, a, b, letters))
        links = [(i, j) for i, s, e in left for j, t, f in right if max(s, t) < min(e, f)]
        cuts = sorted({e for _, _, e in left} & {f for _, _, f in right})
        groups, low = [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(i) for i, s, e in side if low <= s and e <= cut) for side in (left, right)))
            low = cut
        rows.append([k, len(left), len(right), len(groups), len(links), ";".join(groups)])
        links_of.append(links)
        for pair in links:
            held[pair].add(k)
    count = Counter({pair: len(docs) for pair, docs in held.items()})
    best = defaultdict(int)
    for (i, _), n in count.items():
        best[i] = max(best[i], n)
    out = []
    for row, links in zip(rows, links_of, strict=True):
        digest = hashlib.sha256(row[5].encode()).hexdigest() if row[5] else ""
        out.append((*row[:5], sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), digest, row[5]))
    return out, count, best


@pytest.fixture(scope="module")
def texts(spark, folder):
    docs = [r[0] for r in spark.read.parquet(f"{folder}/documents.parquet").where("length(text) < 1500").select("text").limit(60).collect()]
    return [t for t in ODD if t is None or len(t) < 4000] + LINES + random_texts(150) + docs


def test_equals_plain_loops(spark, texts):
    table = spark.createDataFrame([(k, t, 1, "x") for k, t in enumerate(texts)], "doc_id long, text string, n_a long, portion string").repartition(3)
    paths = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")
    expected, count, best = brute_force(texts)
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups"]
    got = token_alignment.align_documents(table, *paths, with_groups=True)
    assert got.columns == names
    assert sorted(tuple(r) for r in got.collect()) == expected
    pairs = {(r[0], r[1]): (r[2], r[3]) for r in token_alignment.pair_counts(table, *paths).collect()}
    assert pairs == {p: (n, n == best[p[0]]) for p, n in count.items()}


def test_repeated_rows_null_ids_and_an_empty_table(spark):
    paths = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")
    table = spark.createDataFrame([(None, "Hello there"), (7, "Hello there"), (7, "Hello there"), (7, None)], "doc_id long, text string")
    rows = token_alignment.align_documents(table, *paths).collect()
    assert sorted((r["doc_id"] is None, r["n_links"] > 0) for r in rows) == [(False, False), (False, True), (False, True), (True, True)]
    assert all(r["count_sum"] == 3 * r["n_links"] for r in rows)
    assert token_alignment.align_documents(table.limit(0), *paths).collect() == []


def test_one_very_long_text(spark):
    text = "word " * 300_000 + "x" * 100_000
    row = token_alignment.align_documents(
        spark.createDataFrame([(1, text)], "doc_id long, text string"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")).first()
    assert row["n_links"] == row["n_a"] + row["n_b"] - row["n_groups"] and row["n_a"] > 300_000
