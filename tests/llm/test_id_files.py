"""Token id files: Elias-Fano sequences, blocks, and whole tables read back."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marketlake.llm import best_fit_packing, id_files
from marketlake.llm.id_files import EliasFano
from marketlake.llm.queries import vocabulary
from tests.llm.test_tokens import ODD, random_texts


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 2**62), max_size=700), st.integers(0, 62))
def test_select_gives_the_values(values, shift):
    values = np.sort(np.array([v >> shift for v in values], np.int64))
    coded, after = EliasFano.read(memoryview(b"xx" + EliasFano.of(values).tobytes()), 2)
    assert after == len(EliasFano.of(values).tobytes()) + 2
    assert coded.select(np.arange(len(values))).tolist() == values.tolist()
    assert coded.select(np.arange(len(values))[::-7]).tolist() == values[::-7].tolist()


def test_boundaries_take_near_minimal_space():
    ends = np.cumsum(np.random.default_rng(1).integers(1, 2000, 50_000))
    bits = 8 * len(EliasFano.of(ends).tobytes()) / len(ends)
    assert bits < np.log2(ends[-1] / len(ends)) + 2.5


def expected(rows, end_id=2):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    coded = []
    for d, t in rows:
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [end_id], "<u4")
        coded.append((d is not None, d or 0, t is not None, len((t or "").encode()), len(ids), zlib.crc32(ids.tobytes()), d))
    out, start = [], 0
    for _, _, _, _, n, crc, d in sorted(coded, key=lambda x: x[:4]):
        out.append((d, n, crc, start))
        start += n
    return out


@pytest.mark.parametrize(("file_bytes", "block_bytes"), [(1 << 25, 1 << 22), (700, 90)])
def test_files_read_back(spark, tmp_path, monkeypatch, file_bytes, block_bytes):
    texts = ODD + random_texts(200)
    rows = [(k * 37 % 1000 - 300, t) for k, t in enumerate(texts)] + [(None, "null id"), (5000, "x" * 3000), (2**63 - 1, "far"), (-(2**63), "near")]
    monkeypatch.setattr(id_files, "BLOCK_BYTES", block_bytes)
    table = spark.createDataFrame([(*r, 9, "z") for r in rows], "doc_id long, text string, n long, ids string").repartition(3)
    target = str(tmp_path / "files")
    id_files.write_ids(table, vocabulary("word_bpe_49k.json"), target, file_bytes=file_bytes)
    got = id_files.read_ids(spark, target, with_ids=True).collect()
    assert sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got if r["doc_id"] is not None) == sorted(
        (start, d, n, crc) for d, n, crc, start in expected(rows) if d is not None)
    assert [(r["start"], r["n_tokens"]) for r in got if r["doc_id"] is None] == [(0, expected(rows)[0][1])]
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["n_tokens"] for r in got)


def test_one_id_for_all_rows_and_an_empty_table(spark, tmp_path):
    texts = ["a b c"] * 40 + ["d"] * 5 + [None]
    table = spark.createDataFrame([(7, t) for t in texts], "doc_id long, text string")
    id_files.write_ids(table, vocabulary("word_bpe_49k.json"), str(tmp_path / "hot"), file_bytes=16)
    got = id_files.read_ids(spark, str(tmp_path / "hot")).orderBy("start").collect()
    sizes = [r["n_tokens"] for r in got]
    assert sizes == [1] + [2] * 5 + [4] * 40 and [r["start"] for r in got] == [0, *np.cumsum(sizes)[:-1].tolist()] and len(got) == len(texts)
    id_files.write_ids(table.limit(0), vocabulary("word_bpe_49k.json"), str(tmp_path / "none"))
    assert id_files.read_ids(spark, str(tmp_path / "none")).collect() == []


def test_files_of_accented_words(spark, tmp_path):
    """Their ids come from the model alone, without the whole library."""
    rows = [(k, t) for k, t in enumerate(["Éclair, déjà vu 12.", "ÀÇÈÑÖØÜß àçèñöøüÿ", "", "déjà (vu)\n\nGRÜSSE.", None])]
    encoder = best_fit_packing.ChunkIds(vocabulary("word_bpe_49k.json"))
    encoder.tokenizer = None
    ids = [np.append(np.frombuffer(p, "<u4"), 2).astype("<u4") for p in encoder([(t or "").encode() for _, t in rows])]
    assert [(len(i), zlib.crc32(i.tobytes())) for i in ids] == [(n, crc) for _, n, crc, _ in expected(rows)]
    id_files.write_ids(spark.createDataFrame(rows, "doc_id long, text string"), vocabulary("word_bpe_49k.json"), str(tmp_path / "files"))
    got = id_files.read_ids(spark, str(tmp_path / "files")).collect()
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_crc32"], r["start"]) for r in got) == expected(rows)
