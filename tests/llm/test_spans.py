"""Repeated spans against a brute-force search of 50-word windows."""

from __future__ import annotations

import random
import time
from pathlib import Path

import numpy as np
import pytest
from marketlake.llm import common, queries, repeated_spans, shingles, substring_dedup
from pyspark.sql import functions as F


def brute_spans(rows, size=50):
    """{doc_id: the words that stay} by a dictionary of all windows."""
    seen, out = {}, {}
    for i, text in sorted(rows):
        words = text.encode().split()
        keys = [x.lower() for x in words]
        gone = set()
        for p in range(len(words) - size + 1):
            at = seen.setdefault(tuple(keys[p : p + size]), (i, p))
            if at[0] != i or p - at[1] >= size:
                gone.update(range(p, p + size))
        out[i] = [w for k, w in enumerate(words) if k not in gone]
    return out


def check(spark, rows):
    got = {r["doc_id"]: r for r in repeated_spans.remove_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute_spans(rows)
    for i, text in rows:
        assert got[i]["text"].encode().split() == want[i] and got[i]["removed_words"] == len(text.split()) - len(want[i]), i
    return got


def test_wrapped_and_embedded_passages_go(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    passages = [[word() for _ in range(n)] for n in (49, 50, 51, 60, 120)]
    wrap = lambda ws, n: "\n".join(" ".join(ws[k : k + n]) for k in range(0, len(ws), n))
    own = lambda n: " ".join(word() for _ in range(n))
    rows = []
    for passage in passages:
        rows.append(f"{own(20)} {' '.join(passage)} {own(20)}")  # inside a longer line
        rows.append(f"{own(5)}\n{wrap(passage, 7)}\n{own(5)}")  # wrapped
        rows.append(wrap([*own(3).split(), *passage, *own(30).split()], 11).upper())
    long = passages[-1]
    rows += [" ".join(long[k : k + 55]) + " " + own(4) for k in range(0, 65, 5)]  # parts with other ends
    rows += [" ".join(passages[3] + passages[2]), " ".join(long[:60]) + " x " + " ".join(long[60:])]
    rows += ["a b c " * 200, "a b c " * 60, " ".join(passages[2] * 4), "z " * 120]
    got = check(spark, list(enumerate(rows)))
    assert got[4]["text"].split() != rows[4].split() and got[1]["text"] == rows[1]  # 49 words stay


def test_spans_of_the_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert sum(r["removed_words"] > 0 for r in check(spark, rows).values()) > 10


def test_op10_leaves_no_window_twice(spark, folder):
    rows = [(r["doc_id"], r["text"]) for r in queries.op10_substring_dedup(spark, folder).collect()]
    lines = {r["doc_id"]: r["text"] for r in substring_dedup.remove_repeats(
        spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")).collect()}
    want = brute_spans(list(lines.items()))
    assert {i: t.encode().split() for i, t in rows} == want and any(t != lines[i] for i, t in rows)


def test_odd_rows_and_white_space(spark):
    p = " ".join(f"w{k}" for k in range(60))
    q = p.replace(" ", "\r\n")
    rows = [(1, f"a {p}\tb"), (2, f"\n x\n{q}\n  y \n"), (3, f"z  {q}\n"), (4, q), (None, p), (5, None), (6, ""), (7, p), (7, "other"), (7, p),
            (8, f"n {p}"), (8, f"m {p} k")]
    got = sorted(((r["doc_id"] or 0, r["text"]) for r in repeated_spans.remove_spans(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    want = [(1, f"a {p}\tb"), (2, "\n x\ny \n"), (3, "z\n"), (4, ""), (0, p), (5, None), (6, ""), (7, ""), (7, "other"), (7, ""),
            (8, "n"), (8, "m k")]
    assert got == sorted(want, key=repr)
    assert repeated_spans.remove_spans(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_rolled_and_last_least():
    x = np.random.default_rng(1).integers(0, 2**63, 200, dtype=np.uint64)
    for size in (1, 2, 15, 50):
        want = [0] * (201 - size)
        for k in range(len(want)):
            for v in x[k : k + size].tolist():
                want[k] = (want[k] * 0x9E3779B97F4A7C15 + v) % 2**64
        assert repeated_spans.rolled(x, size).tolist() == want
    y = x % np.uint64(5)
    for width in (1, 2, 3, 36):
        assert repeated_spans.last_least(y, width).tolist() == [
            max(range(k, k + width), key=lambda p: (-int(y[p]), p)) for k in range(len(y) - width + 1)]


def test_blocks_of_many_texts_are_those_of_each():
    r = random.Random(8)
    texts = [" ".join(r.choice("abcdefghij") for _ in range(r.choice([0, 10, 49, 50, 51, 300]))).encode() for _ in range(80)]
    text, at, many, anchor, block = repeated_spans.many_blocks(texts, 50)
    for k, t in enumerate(texts):
        one = repeated_spans.word_blocks(t.split(), 50)
        mine = text == k
        assert (one is None and not mine.any()) or [x.tolist() for x in one[:4]] == [x[mine].tolist() for x in (at, many, anchor, block)]


def test_columns_with_clashing_names_are_kept(spark):
    p = " ".join(f"w{k}" for k in range(60))
    own = " ".join(f"v{k}" for k in range(30))
    rows = [(1, p, 7, "a", 120), (2, f"{own} {p}", 8, "b", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, removed_lines int, removed_words string, n_chars long")
    got = repeated_spans.remove_passages(docs, added=("__lines", "__words"))
    assert sorted(tuple(r) for r in got.select(docs.columns).collect()) == [(1, p, 7, "a", 120), (2, own, 8, "b", len(own))]
    assert repeated_spans.remove_passages(docs.limit(0), added=("__lines", "__words")).collect() == []


@pytest.mark.parametrize("nullable", [True, False])
def test_batches_with_and_without_removals_share_a_task(spark, monkeypatch, nullable):
    """Batches of one task must have one schema, also where only some of them lose words or lines."""
    monkeypatch.setattr(common, "BATCH_ROWS", 2)
    p = " ".join(f"w{k}" for k in range(60))
    texts = [f"only {k}" for k in range(7)] + [p, f"q {p}", f"x\n{p}", "last"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    docs = frame if nullable else frame.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    want = {**dict(enumerate(texts)), 8: "q", 9: "x"}
    assert {r["doc_id"]: r["text"] for r in repeated_spans.remove_spans(docs).collect()} == want
    assert {r["doc_id"]: r["text"] for r in substring_dedup.remove_repeats(docs).collect()} == {**want, 8: ""}
    assert {r["doc_id"]: r["text"] for r in repeated_spans.remove_passages(docs).collect()} == {**want, 8: ""}


def test_hashes_name_words():
    r = random.Random(2)
    words = [bytes(r.choice(b"abXY\x00\x1c\xc3\xa9.") for _ in range(n)) for n in range(1, 140) for _ in range(20)]
    space = lambda: bytes(r.choice(b" \t\n\v\f\r") for _ in range(r.randint(1, 3)))
    texts = [b"", b" \n", *(b"".join(space() + w for w in words[k : k + 7]) + r.choice([b"", b" "]) for k in range(0, len(words), 7)), b"\t"]
    hashes, counts = shingles.hashed_words(texts)
    split = [t.lower().split() for t in texts]
    assert counts.tolist() == [len(x) for x in split]
    flat = [w for ws in split for w in ws]
    pairs = set(zip(flat, hashes.tolist(), strict=True))
    assert len(pairs) == len(set(flat)) == len(set(hashes.tolist()))
    assert [len(x) for x in shingles.hashed_words([])] == [0, 0]


def test_stored_tables_leave_no_shuffle_files(spark):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {p.name for d in manager.localDirsString() for p in Path(d).rglob("shuffle_*")}
    setting = lambda: spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None)
    before, was = files(), setting()
    counts = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    table = common.stored(counts, "counts")
    until = time.time() + 10  # executors delete them in the background
    while files() - before and time.time() < until:
        time.sleep(0.1)
    assert not files() - before
    assert sorted(counts.collect()) == sorted(table.collect()) and files() - before  # what is not stored keeps its own
    with pytest.raises(Exception, match="no row"):
        common.stored(spark.range(1).select(F.raise_error(F.lit("no row")).cast("string").alias("x")), "none")
    assert setting() == was
