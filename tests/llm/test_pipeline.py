"""The pipeline: every stage over what its predecessor kept, against plain versions."""

from __future__ import annotations

import zlib

import corpus_pipeline
import numpy as np
import __spark_entry__ as entry
from marketlake.llm import quality_fm, queries, toxicity_cnn
from tests.llm.test_pairs import brute_groups, brute_removed
from tests.llm.test_spans import brute_spans


def test_stages_equal_plain_versions(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept.append(stage(spark, kept[-1], folder).cache())
        assert kept[-1].schema.names == docs.schema.names
    rows = [{r["doc_id"]: r["text"] for r in k.collect()} for k in kept]
    quality = quality_fm.score_documents(docs, labels, metadata=queries.METADATA, threshold=queries.QUALITY_FROM)
    assert set(rows[1]) == {r["doc_id"] for r in quality.collect() if r["__score"] >= queries.QUALITY_FROM}
    toxic = toxicity_cnn.score_documents(kept[1], labels)
    assert set(rows[2]) == {r["doc_id"] for r in toxic.collect() if r["__score"] < queries.TOXIC_FROM}
    groups = brute_groups(list(rows[2].items()))
    assert set(rows[3]) == {i for i, (_, root) in groups.items() if i == root}
    removed = brute_removed(list(rows[3].items()))
    lines = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in removed.get(i, [])) for i, t in rows[3].items()}
    assert {i: t.encode().split() for i, t in rows[4].items()} == brute_spans(list(lines.items())) and rows[4] != lines
    assert all(rows[k + 1].keys() <= rows[k].keys() for k in range(4)) and len(rows[4]) > 0.5 * len(rows[0])


def test_run_packs_the_kept_documents(spark, folder):
    from tokenizers import Tokenizer

    rows = corpus_pipeline.run(spark, folder).collect()
    library = Tokenizer.from_file(queries.vocabulary("word_bpe_49k.json"))
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
    want = {}
    for r in docs.collect():
        ids = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            want[r["doc_id"], k // 4096] = zlib.crc32(np.array(ids[k : k + 4096], "<u4").tobytes())
    assert {(r["doc_id"], r["piece"]): r["ids_crc32"] for r in rows} == want


def test_stages_take_an_empty_table_and_other_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("*", "1 as node", "'x' as score", "2 as removed_lines_before").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.schema.names[-3:] == ["node", "score", "removed_lines_before"] and docs.collect() == []


def test_every_operator_is_registered():
    names = entry.queries()
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{k}" for k in range(1, 14)}
